"""Customer-review analytics as Spark DataFrame jobs.

Every public operator is a plain function from DataFrames to DataFrames; see
``reviewmill.operators`` for the jobs, ``reviewmill.functions`` for column
expressions, ``reviewmill.sources`` for readers and writers and
``reviewmill.streaming`` for the incremental jobs.
"""
