"""Token-id files: documents in id order, packed with Simple-8b, read back exactly.

A file is a Parquet part whose rows are chunks of whole documents: their ids,
their lengths, the packed words, the first word of every block, and where the
chunk starts within the part.  Parts follow each other in id order.

Edge cases: a null or empty text is the end id alone; a null ``doc_id`` comes
first and stays null; rows with equal ids are all kept, next to each other in
order of their texts; an empty table gives files without chunks and no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import work_path
from . import simple8b
from .encoding import BYTE_BPE, piece_encoder
from .word_ids import slices

END_ID = 2
CHUNK_IDS = 1 << 19
#: Text whose pieces are numbered together.
BYTES_AT_ONCE = 4 << 20

FILE_SCHEMA = """part int, seq int, local_start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>,
    block_offsets binary, words binary"""
READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_token_files(docs: DataFrame, path: str, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` and write its token files to ``path``."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = piece_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, seq, start = None, 0, 0
        names: list = []
        lengths: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            words, offsets = simple8b.pack(ids)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "local_start": [start], "n_ids": [len(ids)],
                "doc_ids": pa.array([names], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "block_offsets": [offsets.tobytes()], "words": [words.astype("<u8").tobytes()],
            })

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for rows in slices(batch, most=BYTES_AT_ONCE):
                for name, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode_column(rows.column("text"))):
                    names.append(name)
                    held.append(ids + end)
                    lengths.append(len(ids) // 4 + 1)
                if sum(lengths) >= CHUNK_IDS:
                    yield flush()
                    seq, start = seq + 1, start + sum(lengths)
                    names, lengths, held = [], [], []
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text") \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text") \
        .withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(chunks, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: where it starts among all ids, how many it has, their checksum."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per part, far fewer than documents: small enough to send to every executor.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                item = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids = simple8b.unpack(
                    np.frombuffer(item["words"], "<u8"), np.frombuffer(item["block_offsets"], np.uint32), item["n_ids"]
                ).astype("<u4")
                counts = np.array(item["lengths"], np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * low:4 * high]) for low, high in zip((ends - counts).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(item["doc_ids"], pa.int64()),
                    "start": pa.array(ends - counts + item["base"] + item["local_start"], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
                })

    return files.join(F.broadcast(bases), "part").select(
        "base", "local_start", "n_ids", "doc_ids", "lengths", "block_offsets", "words"
    ).mapInArrow(documents, READ_SCHEMA)


def token_index(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and report what they hold."""
    spark = docs.sparkSession
    path = work_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
