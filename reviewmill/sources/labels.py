"""Label files written by people: every column is text, nothing is guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns of the relevance label file.
RELEVANCE_LABELS = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("etiqueta_texto", T.StringType()),
    T.StructField("notas_revision", T.StringType()),
])


def read_labels(spark: SparkSession, path: str, schema: T.StructType = RELEVANCE_LABELS) -> DataFrame:
    """Labels with "NA" and the like kept as text; only an empty field is null."""
    return spark.read.csv(
        path, schema=schema, header=True, multiLine=True, escape='"', nullValue="", nanValue="", enforceSchema=False
    )
