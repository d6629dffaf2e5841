"""Versioned review store on Parquet: bucketed state, append-only versions, one log of revisions.

``data/<revision>`` holds what one revision added: new versions and identities,
each cut by hash into ``bucket=B`` folders, and a manifest.  The manifest holds
the checkpoints (a row per source) and names, per table and bucket, the last full copy of the bucket (its base)
and the revisions that added to it since.  A reader of some records opens the
manifest of one revision and the files of their buckets only, however many
revisions there were; a bucket with ``COMPACTED`` additions is written anew as a
base by the commit that made it so.  Older revisions keep their manifests, so the
state at any of them costs the same to read.

Nothing is visible before its log record, which one writer alone can create (see
``revisions``).  A commit whose number was taken by another reads the new head,
merges again and tries the next number; with an explicit parent it is refused
instead.  The folder of a failed attempt is removed by its writer, or by
``clean`` if that was lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import store as R
from .revisions import REVISIONS, Folder, RevisionLog, StaleParent

SEED_SEQ = 1
SEED = "seed"
BUCKETS = 32
COMPACTED = 8
ATTEMPTS = 20
CHECKPOINTS = T.StructType([
    T.StructField("scope", T.StringType()), T.StructField("value", T.TimestampNTZType()),
    T.StructField("revision", T.StringType()),
])
#: Per table, the columns that choose a row's bucket.
TABLES = {"versions": (S.VERSIONS, ["record_id"]), "identities": (S.IDENTITIES, S.OBSERVATION_KEY)}


def files(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """All files under the paths; the folders' names say nothing a reader needs."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


@dataclass
class Manifest:
    """Where the rows of every bucket are, as of one revision."""

    buckets: int
    #: Rows of ``CHECKPOINTS``, the time as text.
    checkpoints: list[list[str]] = field(default_factory=list)
    #: Per table and bucket: revision of the base (or None), revisions of the additions since.
    parts: dict[str, dict[int, tuple[str | None, list[str]]]] = field(default_factory=lambda: {name: {} for name in TABLES})

    def paths(self, root: str, name: str, wanted: Iterable[int] | None = None) -> list[str]:
        found = []
        for bucket, (base, added) in self.parts[name].items():
            if wanted is None or bucket in wanted:
                found += [f"{root}/data/{base}/{name}-base/bucket={bucket}"] if base else []
                found += [f"{root}/data/{revision}/{name}/bucket={bucket}" for revision in added]
        return found

    def after(self, revision: str, touched: dict[str, list[int]]) -> tuple[Manifest, dict[str, list[int]]]:
        """The manifest once ``revision`` has added to the touched buckets, and the buckets it must compact."""
        parts = {name: {bucket: (base, list(added)) for bucket, (base, added) in table.items()} for name, table in self.parts.items()}
        full: dict[str, list[int]] = {}
        for name, buckets in touched.items():
            for bucket in buckets:
                base, added = parts[name].get(bucket, (None, []))
                parts[name][bucket] = (base, [*added, revision])
                if len(added) + 1 >= COMPACTED:
                    full.setdefault(name, []).append(bucket)
        return Manifest(self.buckets, self.checkpoints, parts), full

    def compacted(self, revision: str, full: dict[str, list[int]]) -> Manifest:
        for name, buckets in full.items():
            for bucket in buckets:
                self.parts[name][bucket] = (revision, [])
        return self

    def to_json(self) -> str:
        return json.dumps({"buckets": self.buckets, "checkpoints": self.checkpoints, "parts": {
            name: [[bucket, base, added] for bucket, (base, added) in sorted(table.items())] for name, table in self.parts.items()}})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(raw["buckets"], raw["checkpoints"], {
            name: {bucket: (base, added) for bucket, base, added in rows} for name, rows in raw["parts"].items()})


@dataclass
class Changes:
    """What one merge adds: written tables, so that they are computed once."""

    versions: DataFrame
    identities: DataFrame
    checkpoints: DataFrame
    counts: dict[str, int]


@dataclass(frozen=True)
class View:
    """The store as of one revision."""

    store: Store
    record: dict
    manifest: Manifest

    def bucket_of(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[name][1]), F.lit(self.manifest.buckets)).cast("int")

    def buckets(self, rows: DataFrame, name: str) -> list[int]:
        """The buckets that hold the rows' keys; at most as many as the store has."""
        return [row["bucket"] for row in rows.select(self.bucket_of(name).alias("bucket")).distinct().collect()]

    def read(self, spark: SparkSession, name: str, wanted: Iterable[int] | None = None) -> DataFrame:
        schema = TABLES[name][0]
        paths = self.manifest.paths(self.store.root, name, wanted)
        return files(spark, schema, paths) if paths else spark.createDataFrame([], schema)

    def identities_of(self, rows: DataFrame) -> DataFrame:
        """Identities in the buckets of the rows' provider ids."""
        return self.read(rows.sparkSession, "identities", self.buckets(rows, "identities"))

    def state_of(self, records: DataFrame) -> DataFrame:
        """Latest versions of the named records, from their buckets alone."""
        found = self.read(records.sparkSession, "versions", self.buckets(records, "versions"))
        return R.as_of(found.join(records.select("record_id").distinct(), "record_id", "left_semi"))

    def state(self, spark: SparkSession) -> DataFrame:
        """Latest versions of all records."""
        return R.as_of(self.read(spark, "versions"))

    def checkpoints(self, spark: SparkSession) -> DataFrame:
        rows = [(scope, datetime.fromisoformat(value), revision) for scope, value, revision in self.manifest.checkpoints]
        return spark.createDataFrame(rows, CHECKPOINTS)


@dataclass(frozen=True)
class Store:
    """A store under one folder."""

    root: str

    @property
    def folder(self) -> Folder:
        return Folder(self.root)

    @property
    def log(self) -> RevisionLog:
        return RevisionLog(self.folder)

    # -- reading -----------------------------------------------------------

    def revisions(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(record[name] for name in REVISIONS.fieldNames()) for record in self.log.records(spark)], REVISIONS)

    def is_empty(self, spark: SparkSession) -> bool:
        return not self.log.numbers(spark)

    def view(self, spark: SparkSession, record: dict | None = None) -> View:
        """The store at a revision record, by default the newest."""
        record = record or self.log.head(spark)
        if record is None:
            raise KeyError(f"the store {self.root} has no revision")
        return View(self, record, Manifest.from_json(self.folder.text(spark, f"data/{record['id']}/manifest.json")))

    def revision(self, spark: SparkSession, operation: str) -> dict | None:
        """The record of an operation."""
        return next((record for record in self.log.records(spark) if record["operation"] == operation), None)

    def seq_of(self, spark: SparkSession, operation: str) -> int:
        """Revision number of an operation; an unknown one is an error."""
        return self._known(spark, operation)["seq"]

    def _known(self, spark: SparkSession, operation: str) -> dict:
        record = self.revision(spark, operation)
        if record is None:
            raise KeyError(f"no revision of operation {operation}")
        return record

    def at(self, spark: SparkSession, operation: str) -> DataFrame:
        """The state as the named operation left it."""
        return self.view(spark, self._known(spark, operation)).state(spark)

    def state(self, spark: SparkSession) -> DataFrame:
        return self.view(spark).state(spark)

    def identities(self, spark: SparkSession) -> DataFrame:
        return self.view(spark).read(spark, "identities")

    def checkpoints(self, spark: SparkSession) -> DataFrame:
        return self.view(spark).checkpoints(spark)

    def versions(self, spark: SparkSession) -> DataFrame:
        """The whole history: every version that a revision added."""
        ids = [record["id"] for record in self.log.records(spark)]
        return files(spark, S.VERSIONS, [f"{self.root}/data/{revision}/versions" for revision in ids])

    # -- writing -----------------------------------------------------------

    def initialize(self, spark: SparkSession, identities: DataFrame | None = None, seed: DataFrame | None = None,
                   buckets: int = BUCKETS) -> None:
        """A new store with the seed's rows as its first revision; a store that has revisions is refused.

        ``seed`` is a raw table; its records must be unique.  ``identities`` may name more provider ids than it holds.
        ``buckets`` is fixed for the store's life; a bucket should be a few hundred megabytes when the store is full.
        """
        if not self.is_empty(spark):
            raise ValueError(f"the store {self.root} is not empty")
        versions = R.empty_state(spark)
        known = identities if identities is not None else R.empty_identities(spark)
        if seed is not None:
            problems = R.seed_problems(seed).limit(5).collect()
            if problems:
                raise ValueError(f"seed records without or with repeated ids: {[row['record_id'] for row in problems]}")
            versions = R.seed_versions(seed, SEED_SEQ)
            known = known.unionByName(R.seed_identities(seed)).dropDuplicates(S.OBSERVATION_KEY)
        changes = Changes(versions, known, spark.createDataFrame([], CHECKPOINTS), dict.fromkeys(S.OUTCOMES, 0))
        if not self._write(spark, Manifest(buckets), changes, {"seq": SEED_SEQ, "parent": None, "operation": SEED, "digest": ""}):
            raise ValueError(f"the store {self.root} is not empty")

    def commit(self, spark: SparkSession, operation: str, digest: str, merge: Callable[[View, int], Changes],
               parent: str | None = None) -> dict:
        """Add one revision and return its record; ``merge(view, seq)`` makes the changes against a view of the store.

        An operation that is committed already returns its revision if digest (and parent, where given) are the same
        and is refused if not.  ``parent`` is the id of the revision the caller has seen: if the store has moved on,
        the commit is refused.  Without it the merge is made against whatever is newest, again if need be.
        """
        for _ in range(ATTEMPTS):
            view, prior = self.view(spark), self.revision(spark, operation)
            if prior:
                if prior["digest"] != digest or parent not in (None, prior["parent"]):
                    raise ValueError(f"operation {operation} was committed with other rows or another parent")
                return prior
            if parent not in (None, view.record["id"]):
                raise StaleParent(f"the store has moved on from revision {parent}")
            seq = view.record["seq"] + 1
            record = {"seq": seq, "parent": view.record["id"], "operation": operation, "digest": digest}
            written = self._write(spark, view.manifest, merge(view, seq), record)
            if written:
                return written
            if parent is not None:
                raise StaleParent(f"the store has moved on from revision {parent}")
        raise StaleParent(f"{ATTEMPTS} other writers were faster than {operation}")

    def _write(self, spark: SparkSession, manifest: Manifest, changes: Changes, record: dict) -> dict | None:
        """Write a revision's folder and take its number; None if another writer has it."""
        record = {**record, "id": uuid.uuid4().hex, "committed_at": datetime.now(UTC).isoformat(timespec="milliseconds"), **changes.counts}
        home = f"{self.root}/data/{record['id']}"
        view = View(self, record, manifest)
        for name, rows in (("versions", changes.versions), ("identities", changes.identities)):
            self._bucketed(view, rows.select(TABLES[name][0].fieldNames()), name, f"{home}/{name}")
        touched = {name: [int(part.removeprefix("bucket=")) for part in self.folder.names(spark, f"data/{record['id']}/{name}")
                          if part.startswith("bucket=")] for name in TABLES}
        manifest, full = manifest.after(record["id"], touched)
        for name, buckets in full.items():
            rows = View(self, record, manifest).read(spark, name, buckets)
            self._bucketed(view, R.as_of(rows).select(S.VERSIONS.fieldNames()) if name == "versions" else rows, name, f"{home}/{name}-base")
        # One row per source.
        manifest.checkpoints = [[row["scope"], row["value"].isoformat(), row["revision"]]
                                for row in changes.checkpoints.select("scope", "value", "revision").collect()]
        self.folder.write(spark, f"data/{record['id']}/manifest.json", manifest.compacted(record["id"], full).to_json())
        if self.log.append(spark, record):
            return record
        self.folder.drop(spark, f"data/{record['id']}")
        return None

    @staticmethod
    def _bucketed(view: View, rows: DataFrame, name: str, path: str) -> None:
        # Rebalanced, so that small buckets share a task and a large one is split.
        rows.withColumn("bucket", view.bucket_of(name)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)

    def clean(self, spark: SparkSession) -> list[str]:
        """Remove folders of attempts that never became revisions; only while nobody writes."""
        known = {record["id"] for record in self.log.records(spark)}
        lost = [name for name in self.folder.names(spark, "data") if name not in known]
        for name in lost:
            self.folder.drop(spark, f"data/{name}")
        return lost
