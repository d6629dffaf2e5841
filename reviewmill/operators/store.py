"""Versioned raw store: set-based reconciliation, as-of reads, checkpoints.

The store is a handful of tables.  ``versions`` is an append-only log of
accepted review versions keyed by ``record_id`` and the revision number
``seq``; ``identities`` maps a provider's own id to a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.dates import parse_utc
from ..functions.hashing import ordered_digest
from ..functions.numbers import n
from .ordered import BLOCK, BLOCK_WIDTH, with_blocks

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# What a first insert records about its origin.
SCHEMA_VERSION, COLLECTED_VIA = "unified-update-v1", "newest"
LANGUAGE_BASIS = {"play": "requested lang=es; not detected", "apple_rss": "MX storefront; language unknown"}


# -- seeding ---------------------------------------------------------------

def seed_problems(seed: DataFrame) -> DataFrame:
    """Records without an id, and ids that occur more than once."""
    return seed.groupBy("record_id").agg(n().alias("copies")).where(
        F.col("record_id").isNull() | (F.col("copies") > 1)
    )


def seed_identities(seed: DataFrame) -> DataFrame:
    """One identity per provider id found in the seed's per-provider columns; a provider without columns has none."""
    options = []
    for provider in S.STORE_PROVIDERS:
        if f"{provider}__source_id" not in seed.columns:
            continue
        native = F.col(f"{provider}__source_id")
        target = F.col(f"{provider}__target") if f"{provider}__target" in seed.columns else F.lit(None)
        app = F.when(target != "", target).otherwise(F.col("app_id"))
        options.append(F.when(native.isNotNull(), F.struct(
            F.lit(provider).alias("provider"), app.cast("string").alias("app_id"),
            native.cast("string").alias("source_id"), F.col("record_id").cast("string").alias("record_id"),
        )))
    if not options:
        return empty_identities(seed.sparkSession)
    return seed.select(F.explode(F.array_compact(F.array(*options))).alias("i")).select("i.*")


def seed_versions(seed: DataFrame, seq: int) -> DataFrame:
    """The seed's rows as the versions of revision ``seq``; provider columns go into ``native`` as text."""
    native = [c for c in seed.columns if "__" in c]
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in native]
    pairs = F.array_compact(F.array(*entries)) if entries else F.array()
    kinds = {field.name: field.dataType for field in S.VERSIONS}
    sources = {
        "native": F.map_from_entries(pairs) if entries else F.create_map().cast("map<string,string>"), "seq": F.lit(seq),
    }
    if "source_record_ids_json" in seed.columns:
        sources["source_record_ids"] = F.from_json("source_record_ids_json", "array<string>")
    for name in ("record_date", "updated_at", "collected_at"):
        if name in seed.columns:
            sources[name] = parse_utc(F.col(name).cast("string"))
    return seed.select(*[
        sources.get(name, F.col(name) if name in seed.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in kinds.items()
    ])


# -- reading ---------------------------------------------------------------

def as_of(versions: DataFrame, seq: int | Column | None = None) -> DataFrame:
    """Latest version of every record at a revision (all revisions by default)."""
    rows = versions if seq is None else versions.where(F.col("seq") <= seq)
    payload = [c for c in versions.columns if c != "record_id"]
    return rows.groupBy("record_id").agg(F.max_by(F.struct(*payload), "seq").alias("v")).select("record_id", "v.*")


def revision_diff(versions: DataFrame, old: int, new: int) -> DataFrame:
    """Records added or changed between two revisions, with their version counts."""
    inside = versions.where(F.col("seq") <= new)
    per_record = inside.groupBy("record_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), n().alias("versions")
    )
    return per_record.where(F.col("last_seq") > old).select(
        "record_id", "versions", "first_seq", "last_seq",
        F.when(F.col("first_seq") > old, "added").otherwise("changed").alias("change"),
    )


def revision_sizes(versions: DataFrame) -> DataFrame:
    return versions.groupBy("seq").agg(n().alias("rows"))


# -- reconciliation --------------------------------------------------------

def _native(provider: Column, field: str) -> Column:
    return F.try_element_at("native", F.concat(provider, F.lit(f"__{field}")))


def _fingerprint(source) -> Column:
    """Hash of the fields that make a version; a missing field differs from an empty one."""
    return F.sha2(F.to_json(F.struct(*[source(field).cast("string").alias(field) for field in S.CONTENT_FIELDS])), 256)


def resolve(observations: DataFrame, identities: DataFrame) -> DataFrame:
    """Attach the record each observation belongs to."""
    fallback = F.concat_ws(":", *S.OBSERVATION_KEY)
    return observations.join(
        identities.withColumnRenamed("record_id", "known_id"), S.OBSERVATION_KEY, "left"
    ).withColumn("record_id", F.coalesce("known_id", fallback)).drop("known_id")


def classify(
    observations: DataFrame, identities: DataFrame, state: DataFrame, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Outcome of every observation of a batch against the current state.

    Per record and provider, in batch order: *stale* if older than the newest
    date seen so far, *duplicates* if content and date equal the last row that
    was not stale, else *inserted* or *edited*.  A stored record without a date
    absorbs equal content until the first difference.

    Rows are sorted once, by record, provider and block of the batch order; what a
    block hands on to the next ones is one narrow row, and only records of several
    blocks have any.  Rows that are resolved already keep their ``record_id``.
    """
    columns = [c for c in observations.columns if c != "record_id"]
    keys, provider = ["record_id", "provider"], F.col("provider")
    rows = observations if "record_id" in observations.columns else resolve(observations, identities)
    rows = rows.join(state.select("record_id", "native"), "record_id", "left").select(
        *columns, "record_id",
        F.col("native").isNotNull().alias("_known"),
        _fingerprint(F.col).alias("_content"),
        F.when(F.col("native").isNotNull(), _fingerprint(lambda f: _native(provider, f))).alias("_stored"),
        parse_utc(_native(provider, "updated_at")).alias("_stored_at"),
    )
    undated = F.col("_known") & F.col("_stored_at").isNull()
    rows = with_blocks(rows, "batch_order", width).withColumns({
        "_undated": undated, "_differs": undated & (F.col("_content") != F.col("_stored")),
        "_row": F.struct(F.col("updated_at").alias("at"), "batch_order", F.col("_content").alias("content")),
    })
    inside = Window.partitionBy(*keys, BLOCK).orderBy("batch_order")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_differed", F.max("_differs").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.when(~F.col("_undated") | F.col("_differed"), F.col("_row"))
    # Rows that are not stale never go back in time, so the last of them is the earlier row with the newest date,
    # latest in the batch: one maximum gives both the date to beat and the content to compare with.
    rows = rows.withColumns({"_all": F.max("_row").over(earlier), "_from": F.max(changed).over(earlier)})

    blocks = rows.groupBy(*keys, BLOCK).agg(
        F.max("_undated").alias("_undated"), F.max("_differs").alias("_differs"),
        F.max("_row").alias("_all"), F.max(changed).alias("_from"))
    over = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_differed_before", F.max("_differs").over(over))
    newest = F.when(~F.col("_undated") | F.coalesce("_differed_before", F.lit(False)), F.col("_all")).otherwise(F.col("_from"))
    carried = blocks.withColumn("_newest_before", F.max(newest).over(over)).where(F.col("_differed_before").isNotNull()) \
        .select(*keys, BLOCK, "_differed_before", "_newest_before")
    rows = rows.join(carried, [*keys, BLOCK], "left")

    all_count = ~F.col("_undated") | F.coalesce("_differed_before", F.lit(False))
    live = all_count | F.col("_differed")
    last = F.greatest(F.when(all_count, F.col("_all")).otherwise(F.col("_from")), F.col("_newest_before"))
    rows = rows.withColumns({"_live": live, "_newest": last})
    from_batch = F.col("_newest").isNotNull() & (
        F.col("_stored_at").isNull() | (F.col("_newest.at") >= F.col("_stored_at"))
    )
    bar = F.when(from_batch, F.col("_newest.at")).otherwise(F.col("_stored_at"))
    previous = F.when(from_batch, F.col("_newest.content")).otherwise(F.col("_stored"))
    seen = F.col("_newest").isNotNull()
    stale = F.col("_live") & F.coalesce(F.col("updated_at") < bar, F.lit(False))
    duplicate = ~F.col("_live") | (
        (F.col("_known") | seen) & previous.eqNullSafe(F.col("_content"))
        & F.coalesce(F.col("updated_at") == bar, F.lit(False))
    )
    outcome = (
        F.when(stale, "stale")
        .when(duplicate, "duplicates")
        .when(F.col("_known") | seen, "edited")
        .otherwise("inserted")
    )
    return rows.select(*columns, "record_id", outcome.alias("outcome"))


def outcome_counts(classified: DataFrame) -> DataFrame:
    """Outcomes per provider and for the whole batch."""
    per_provider = classified.groupBy("provider").agg(
        *[n(F.col("outcome") == o).alias(o) for o in S.OUTCOMES]
    )
    total = per_provider.agg(*[F.coalesce(F.sum(o), F.lit(0)).alias(o) for o in S.OUTCOMES])
    return per_provider.unionByName(total.withColumn("provider", F.lit("(all)")))


def next_versions(classified: DataFrame, state: DataFrame, seq: int | Column) -> DataFrame:
    """The rows one batch appends to ``versions``: the last accepted row per record.

    Each provider's own columns are laid over the stored ones, so a record fed by
    two providers keeps both; defaults are set on the first insert only.
    """
    accepted = classified.where(F.col("outcome").isin("inserted", "edited"))
    fields = [c for c in classified.columns if c not in ("record_id", "outcome")]
    row = F.struct(*fields)
    provenance = [c for c in S.PROVENANCE if c in classified.columns]

    def overlay(o):
        prefix = F.concat(o["provider"], F.lit("__"))
        values = {
            "source_id": o["source_id"], "target": o["app_id"], "provider_record_id": o["source_id"],
            "locale": o["country"], "text": o["text"], "title": o["title"], "rating": o["rating"].cast("string"),
            "app_version": o["app_version"], "updated_at": F.date_format(o["updated_at"], ISO),
            "fetched_at": F.date_format(o["fetched_at"], ISO),
            "source": F.when(o["provider"] == "apple_rss", "appstore").otherwise("playstore"),
            "schema_version": F.lit(SCHEMA_VERSION), "collected_via": F.lit(COLLECTED_VIA),
            **{name: o[name].cast("string") for name in provenance},
        }
        return F.map_from_arrays(
            F.array(*[F.concat(prefix, F.lit(name)) for name in values]), F.array(*values.values())
        )

    merged = accepted.groupBy("record_id").agg(*[
        F.max_by(row, F.when(F.col("provider") == p, F.col("batch_order"))).alias(p) for p in S.STORE_PROVIDERS
    ], F.max_by(row, "batch_order").alias("o"))
    old = state.select("record_id", F.struct(*[c for c in state.columns if c != "record_id"]).alias("old"))
    rows = merged.join(old, "record_id", "left")
    o = F.col("o")
    is_new = F.col("old").isNull()
    empty = F.create_map().cast("map<string,string>")
    overlays = F.map_concat(
        F.coalesce(F.when(F.col("play").isNotNull(), overlay(F.col("play"))), empty),
        F.coalesce(F.when(F.col("apple_rss").isNotNull(), overlay(F.col("apple_rss"))), empty),
    )
    kept = F.map_filter(F.coalesce(F.col("old.native"), empty), lambda k, _: ~F.map_contains_key(F.col("overlays"), k))
    rows = rows.withColumn("overlays", overlays)

    def default(value: Column, name: str) -> Column:
        return F.when(is_new, value).otherwise(F.col(f"old.{name}"))

    basis = F.lit(None).cast("string")
    for provider, text in LANGUAGE_BASIS.items():
        basis = F.when(o["provider"] == provider, text).otherwise(basis)
    return rows.select(
        "record_id",
        F.when(o["provider"] == "apple_rss", "app_store").otherwise("google_play").alias("platform"),
        o["app_id"].alias("app_id"),
        F.upper(o["country"]).alias("country"),
        o["text"].alias("text"), o["title"].alias("title"), o["rating"].alias("rating"),
        o["updated_at"].alias("record_date"),
        F.lit("source_updated_at").alias("date_basis"), F.lit("second").alias("date_precision"),
        F.lit("UTC").alias("date_timezone"),
        default(F.lit(None).cast("string"), "language").alias("language"),
        default(basis, "language_basis").alias("language_basis"),
        default(F.lit("app_target_match"), "relevance").alias("relevance"),
        o["provider"].alias("preferred_provider"),
        default(F.lit("provider_identity"), "identity_basis").alias("identity_basis"),
        default(F.lit(1), "source_count").alias("source_count"),
        default(F.array("record_id"), "source_record_ids").alias("source_record_ids"),
        o["updated_at"].alias("updated_at"), o["fetched_at"].alias("collected_at"),
        F.map_concat(kept, F.col("overlays")).alias("native"),
        F.lit(seq).cast("bigint").alias("seq") if not isinstance(seq, Column) else seq.cast("bigint").alias("seq"),
    )


def new_identities(classified: DataFrame, identities: DataFrame) -> DataFrame:
    """Identities of accepted observations that the store does not hold yet."""
    seen = classified.where(F.col("outcome").isin("inserted", "edited")).select(
        *S.OBSERVATION_KEY, "record_id"
    ).dropDuplicates(S.OBSERVATION_KEY)
    return seen.join(identities, S.OBSERVATION_KEY, "left_anti")


def empty_state(spark) -> DataFrame:
    return spark.createDataFrame([], S.VERSIONS)


def empty_identities(spark) -> DataFrame:
    return spark.createDataFrame([], S.IDENTITIES)


# -- batch rules -----------------------------------------------------------

def batch_gate(sources: DataFrame) -> DataFrame:
    """Whether a batch may commit: both store providers present, every source successful."""
    return sources.agg(
        n(F.col("status") == "success").alias("successful"), n(~F.col("status").eqNullSafe("success")).alias("failed"),
        *[F.coalesce(F.bool_or(F.col("provider") == p), F.lit(False)).alias(f"has_{p}") for p in S.STORE_PROVIDERS],
        n(~F.col("provider").isin(S.STORE_PROVIDERS)).alias("foreign"),
    ).withColumn("may_commit", (F.col("failed") == 0) & (F.col("foreign") == 0) & F.col("has_apple_rss") & F.col("has_play"))


def observations_digest(observations: DataFrame) -> DataFrame:
    cells = [c for c in observations.columns if c != "batch_order"]
    return ordered_digest(observations, "batch_order", cells)


def upsert_checkpoints(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest value per scope with the revision that set it; equal values take the later one."""
    both = stored.withColumn("_turn", F.lit(0)).unionByName(incoming.withColumn("_turn", F.lit(1)))
    return both.groupBy("scope").agg(
        F.max("value").alias("value"), F.max_by("revision", F.struct("value", "_turn")).alias("revision")
    )


def storefront(row_locale: Column, row_country: Column) -> Column:
    """Storefront of a row: country of a JSON locale, a plain locale, else the row's country."""
    locale = F.trim(row_locale)
    country = F.when(locale.startswith("{"), F.get_json_object(locale, "$.country")).when(
        locale != "", locale
    ).otherwise(row_country)
    return F.coalesce(F.lower(F.trim(country)), F.lit(""))


def incremental_boundary(
    rows: DataFrame, sources: DataFrame, checkpoints: DataFrame, overlap_days: int, since: str | None = None
) -> DataFrame:
    """Where each source resumes: explicit, else its checkpoint, else its newest native date.

    ``rows`` needs ``provider, target, locale, country, updated_at``; an overlap
    is taken off unless the start is explicit.  A source without any date gets a
    null boundary.
    """
    if since is not None:
        return sources.select("provider", "app_id", "country", F.lit(since).cast("timestamp_ntz").alias("since"), F.lit("explicit").alias("basis"))
    newest = rows.groupBy(
        "provider", F.col("target").alias("app_id"), storefront(F.col("locale"), F.col("country")).alias("country")
    ).agg(F.max("updated_at").alias("newest"))
    scope = F.concat_ws(":", "provider", "app_id", F.lower("country"))
    asked = sources.withColumn("country", F.lower("country")).withColumn("scope", scope)
    start = F.coalesce(F.col("value"), F.col("newest"))
    return asked.join(checkpoints.select("scope", "value"), "scope", "left").join(
        newest, ["provider", "app_id", "country"], "left"
    ).select(
        "provider", "app_id", "country",
        (start - F.make_dt_interval(F.lit(overlap_days))).alias("since"), F.lit("overlap").alias("basis"),
    )


def in_window(provider: Column, updated_at: Column, since: Column, until: Column) -> Column:
    """Rows a fetch keeps; one provider's feed has no usable start date."""
    return (updated_at <= until) & ((provider == "apple_rss") | (updated_at >= since))


def page_coverage(paged: DataFrame, since: Column, until: Column) -> DataFrame:
    """Per provider and page: rows, rows kept, date range, whole page before the start."""
    keep = in_window(F.col("provider"), F.col("updated_at"), since, until)
    return paged.groupBy("provider", "page").agg(
        n().alias("rows"), n(keep).alias("kept"), F.min("updated_at").alias("oldest"), F.max("updated_at").alias("newest")
    ).withColumn("stops_here", (F.col("provider") == "play") & (F.col("newest") < since))


def source_coverage(pages: DataFrame, since: Column) -> DataFrame:
    """Per provider: the first page that ends the fetch, and whether the feed left a gap."""
    return pages.groupBy("provider").agg(
        F.sum("rows").alias("rows"), F.min("oldest").alias("oldest"),
        F.min(F.when(F.col("stops_here"), F.col("page"))).alias("last_page"),
    ).withColumn("has_gap", (F.col("provider") == "apple_rss") & F.coalesce(F.col("oldest") > since, F.lit(True)))


def quarantine(observations: DataFrame, max_items: int | None = None) -> DataFrame:
    """Observations that break the intake rules, with the rule each one breaks."""
    rule = F.when(F.coalesce(F.col("source_id"), F.lit("")) == "", "missing_source_id").when(
        F.col("rating").isNotNull() & ~F.col("rating").between(1, 5), "invalid_rating"
    )
    bad = observations.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(
        "provider", F.col("batch_order").cast("bigint").alias("batch_order"), "rule"
    )
    if max_items is None:
        return bad
    over = observations.groupBy("provider").agg(n().alias("rows")).where(F.col("rows") > max_items).select(
        "provider", F.lit(None).cast("bigint").alias("batch_order"), F.lit("over_item_limit").alias("rule")
    )
    return bad.unionByName(over)
