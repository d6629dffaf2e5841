"""Merkle audit of WARC replicas.

Records stand in files of ``RECORDS`` in order, each with its offset and length.
A leaf hashes a record's offset, length and content; a node hashes the range of
offsets it covers and its ``FAN`` children.  The replicas' roots are compared, and
only below roots that differ the next level is compared, down to the records; a
record that differs is then looked up in the other replica's file by its id.
Nodes that only one replica has differ, whichever replica it is; records that only
the second has are reported as ``extra``.

Edge cases: a null page id comes first and is a record like any other; a null
url or html is an empty one; repeated rows are records of their own, told apart
by their order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from ..session import stored

RECORDS, FAN = 1024, 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text; its bytes are its UTF-8 form."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


#: Pages that the damaged replica has once more.
ADDED = "page_id % 401 = 9"


def records(pages: DataFrame) -> DataFrame:
    """``page_id, content, bytes`` of every page's record: a digest and a length, the text itself goes no further."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), text.alias("text")).select(
        "page_id", F.sha2("text", 256).alias("content"), F.octet_length("text").cast("bigint").alias("bytes"))


def filed(rows: DataFrame) -> DataFrame:
    """Number the records and put ``RECORDS`` into a file: adds ``file_no`` and ``slot``."""
    return numbered(rows, ["page_id", "content"]).select(
        "*", F.floor(F.col("position") / RECORDS).cast("bigint").alias("file_no"),
        (F.col("position") % RECORDS).cast("int").alias("slot")).drop("position")


def with_offsets(rows: DataFrame) -> DataFrame:
    """Close gaps in a file's slots and add the byte offsets and each id's occurrence; windows of one file each."""
    order = Window.partitionBy("file_no").orderBy("slot")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.repartition("file_no").withColumns({
        "at": (F.row_number().over(order) - 1).cast("int"),
        "record_offset": F.coalesce(F.sum("bytes").over(before), F.lit(0)),
    })
    return placed.drop("slot").withColumnRenamed("at", "slot").withColumn(
        "occurrence", F.row_number().over(Window.partitionBy("file_no", "page_id").orderBy("slot")))


def tree(rows: DataFrame) -> list[DataFrame]:
    """The levels of the files' trees, leaves first: ``file_no, node, low, high, digest``."""
    level = rows.select(
        "file_no", F.col("slot").alias("node"), F.col("record_offset").alias("low"),
        (F.col("record_offset") + F.col("bytes")).alias("high"),
        F.sha2(F.concat_ws(":", F.lit("record"), "record_offset", "bytes", "content"), 256).alias("digest"))
    levels, width = [level], RECORDS
    while width > 1:
        width = -(-width // FAN)
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        level = level.groupBy("file_no", F.floor(F.col("node") / FAN).cast("int").alias("parent")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"), children.alias("below")).select(
            "file_no", F.col("parent").alias("node"), "low", "high",
            F.sha2(F.concat_ws(":", F.lit("range"), "low", "high", F.array_join(F.col("below.digest"), ":")), 256).alias("digest"))
        levels.append(level)
    return levels


def differing(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """The places of records that differ or that one replica lacks: from the roots down, only below nodes that differ."""
    open_nodes = None
    for ours, theirs in zip(reversed(first), reversed(second)):
        if open_nodes is not None:
            # Children of open nodes only.
            parents = open_nodes.select("file_no", F.col("node").alias("parent"))
            ours, theirs = [side.withColumn("parent", F.floor(F.col("node") / FAN).cast("int")).join(
                parents, ["file_no", "parent"], "left_semi").drop("parent") for side in (ours, theirs)]
        other = theirs.select("file_no", "node", F.col("digest").alias("theirs"))
        open_nodes = ours.join(other, ["file_no", "node"], "full").where(
            ~F.col("theirs").eqNullSafe(F.col("digest"))).select("file_no", "node")
    return open_nodes.withColumnRenamed("node", "slot")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per record of either replica: ``page_id, file_no, record_offset, n_bytes, status``.

    Both take ``file_no, slot, page_id, content, bytes``.  Status is ``same``; ``moved`` for the same content at another
    offset; ``changed`` for other content; ``missing`` without a record of that id in the other's file; ``extra`` for the
    second's records without one in the first's, with the second's offset.
    """
    ours, theirs = stored(with_offsets(first), "replica"), stored(with_offsets(second), "replica")
    bad = stored(differing(tree(ours), tree(theirs)), "differing").withColumn("differs", F.lit(True))
    other = theirs.join(bad.select("file_no").distinct(), "file_no", "left_semi").select(
        F.col("file_no").alias("other_file"), F.col("page_id").alias("other_id"), F.col("occurrence").alias("other_occurrence"),
        F.col("content").alias("found"), F.col("record_offset").alias("other_offset"), F.col("bytes").alias("other_bytes"))
    marked = ours.join(bad, ["file_no", "slot"], "left")
    same_record = (marked["file_no"] == other["other_file"]) & marked["page_id"].eqNullSafe(other["other_id"]) \
        & (marked["occurrence"] == other["other_occurrence"])
    # One pass for both sides: what the second has in these files meets the first's records, differing or not.
    return marked.join(other, same_record, "full").select(
        F.when(F.col("content").isNull(), F.col("other_id")).otherwise(F.col("page_id")).alias("page_id"),
        F.coalesce("file_no", "other_file").alias("file_no"), F.coalesce("record_offset", "other_offset").alias("record_offset"),
        F.coalesce("bytes", "other_bytes").alias("n_bytes"),
        F.when(F.col("content").isNull(), "extra").when(F.col("differs").isNull(), "same").when(F.col("found").isNull(), "missing")
        .when(F.col("found") == F.col("content"), "moved").otherwise("changed").alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted damage: a byte changed, a record cut in half, a record lost."""
    number = F.col("page_id")
    half = F.substring("html", F.lit(1), F.floor(F.length("html") / 2).cast("int"))
    return pages.where(~(number % 307 == 3) | number.isNull()).select(
        number, "url", F.when(number % 101 == 7, F.overlay("html", F.lit("#"), F.lit(3), F.lit(1)))
        .when(number % 211 == 5, half).otherwise(F.col("html")).alias("html"))


def added(pages: DataFrame) -> DataFrame:
    """Records that only the replica has: some pages once more under an id below 0."""
    return pages.where(ADDED).select((-F.col("page_id") - 1).alias("page_id"), "url", "html")


def replica_audit(pages: DataFrame) -> DataFrame:
    """Audit the pages' records against a damaged replica filed in the same files."""
    first = stored(filed(records(pages)), "records")
    # The replica's records keep their file; ids tell which record is which.
    counted = Window.partitionBy("page_id").orderBy("content")
    copy = records(damaged(pages).unionByName(added(pages))).withColumn("n", F.row_number().over(counted))
    keep = first.withColumn("n", F.row_number().over(counted)).select("page_id", "n", "file_no", "slot")
    # What only the replica has stands at the end of the file of the page it was made from.
    keep = keep.unionByName(keep.where(ADDED).withColumns({
        "page_id": -F.col("page_id") - 1, "slot": F.col("slot") + RECORDS}))
    second = copy.join(keep, F.expr("1=1") & copy["page_id"].eqNullSafe(keep["page_id"]) & (copy["n"] == keep["n"])) \
        .select(copy["page_id"], "content", "bytes", "file_no", "slot")
    return audit(first, second)
