"""Topics from groups: numbering, terms, weights, keywords, representatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..functions.numbers import n
from ..session import discard, lookup, small_inputs, stored
from .ordered import BLOCK_WIDTH, after, top_per_group, with_blocks
from .postings import (REVIEWS_A_PART, WORDS_A_BUCKET, bucket_counts, bucket_postings, postings, review_sums, summed_counts, summed_products,
                       term_bucket)

UNASSIGNED = -1
TOP_KEYWORDS = 10
CANDIDATES = 30


def topic_numbers(rows: DataFrame) -> DataFrame:
    """One topic per group: 0 is the largest, the unassigned rows stay ``-1``.

    The ranking window reads one row per group.
    """
    sizes = rows.groupBy("cluster_id").agg(n().alias("reviews"))
    assigned = F.col("cluster_id") != UNASSIGNED
    rank = F.row_number().over(Window.orderBy(F.when(assigned, 0).otherwise(1), F.desc("reviews"), "cluster_id"))
    return sizes.select(
        "cluster_id", F.when(assigned, rank - 1).otherwise(F.lit(UNASSIGNED)).cast("int").alias("topic_id"), "reviews"
    )


def with_topics(rows: DataFrame) -> DataFrame:
    """Attach topic numbers; the unassigned group may hold most rows, so no shuffle on it."""
    return rows.join(lookup(topic_numbers(rows).select("cluster_id", "topic_id")), "cluster_id")


def mapping_problems(rows: DataFrame) -> DataFrame:
    """Groups with several topics, topics with several groups."""
    pairs = rows.groupBy("cluster_id", "topic_id").agg(n().alias("rows"))
    groups = pairs.groupBy("cluster_id").agg(n().alias("c")).where(F.col("c") > 1).select(F.lit("group").alias("kind"), F.col("cluster_id").alias("value"))
    topics = pairs.groupBy("topic_id").agg(n().alias("c")).where(F.col("c") > 1).select(F.lit("topic").alias("kind"), F.col("topic_id").alias("value"))
    return groups.unionByName(topics)


# -- terms and weights -----------------------------------------------------

def review_terms(rows: DataFrame) -> DataFrame:
    """Every term occurrence of every review: words and pairs inside the review."""
    words = F.col("words") if "words" in rows.columns else X.kept_terms(F.col("text"))
    kept = rows.select("topic_id", "source_row", words.alias("kept"))
    return kept.select("topic_id", "source_row", F.explode(F.concat("kept", X.bigrams(F.col("kept")))).alias("term"))


def with_terms(rows: DataFrame) -> DataFrame:
    """The rows' kept words, cut once and written: ``topic_id, source_row, words``, their number, the first and the last.

    The steps below take such a table as well as rows with texts.
    """
    if "words" in rows.columns:
        return rows
    kept = rows.select("topic_id", "source_row", X.kept_terms(F.col("text")).alias("words"))
    return stored(kept.select("*", F.size("words").alias("n"), F.get("words", F.lit(0)).alias("first"),
                              F.get("words", F.size("words") - 1).alias("last")), "words", "zstd")


def _buckets(worded: DataFrame) -> int:
    """Buckets of terms for all these words."""
    return 1 + (worded.agg(F.sum(F.col("n").cast("bigint")).alias("n")).first()["n"] or 0) // WORDS_A_BUCKET


def border_pairs(rows: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Pairs across review borders: last word of one review, first of the topic's next."""
    edges = with_terms(rows).where("n > 0").select("topic_id", "source_row", "first", "last")
    linked = after(with_blocks(edges, "source_row", width), ["topic_id"], "source_row", {"following": F.struct("source_row", "first")})
    return linked.where(F.col("following").isNotNull()).select(
        "topic_id", F.concat("last", F.lit(" "), F.col("following.first")).alias("term")
    )


def class_terms(rows: DataFrame, width: int = BLOCK_WIDTH, totals: bool = False) -> DataFrame:
    """Term counts per topic, as if its reviews were one text in row order; ``totals`` adds those of all topics, ``f``.

    The counts of slices of reviews meet in buckets of terms and are summed up there.
    """
    small_inputs(rows.sparkSession)
    worded = with_terms(rows)
    buckets = _buckets(worded)
    borders = border_pairs(worded, width).select(
        term_bucket(F.col("term"), buckets).alias("bucket"), F.array("term").alias("terms"), F.array("topic_id").alias("topics"),
        F.array(F.lit(1).cast("bigint")).alias("tfs"))
    counts = summed_counts(bucket_counts(worded, buckets).unionByName(borders))
    return counts if totals else counts.drop("f")


def weighted_terms(counts: DataFrame) -> DataFrame:
    """Class-based weight of every term: ``sqrt(tf / words) * ln(1 + A / f)``.

    ``A`` is the whole part of the mean words per topic.  A term has at most one
    row per topic, which bounds the window that sums ``f``, unless the counts
    carry it.  The counts are written with ``f``, because several steps read
    them, each its own columns; a weight is then worked out of its own row.
    """
    if "f" not in counts.columns:
        counts = counts.withColumn("f", F.sum("tf").over(Window.partitionBy("term")))
    counts = stored(counts, "counts")
    return _weights(counts, lookup(counts.groupBy("topic_id").agg(F.sum("tf").alias("words"))))


def _weights(counts: DataFrame, words: DataFrame) -> DataFrame:
    average = words.agg(F.floor(F.avg("words")).cast("bigint").alias("a")).scalar()
    rows = counts.withColumn("average", average).join(words, "topic_id")
    idf = F.log(1.0 + F.col("average").cast("double") / F.col("f"))
    return rows.withColumn("idf", idf).withColumn(
        "weight", F.sqrt(F.col("tf").cast("double") / F.col("words")) * F.col("idf")
    )


def _summed(rows: DataFrame, width: int, listed: bool, leading: int = 0) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The sums of ``summed_products`` over all terms, every topic's number of words, and written steps that the sums read."""
    small_inputs(rows.sparkSession)
    worded = with_terms(rows)
    buckets = _buckets(worded)
    borders = stored(border_pairs(worded, width), "borders")
    # A topic has its words, the pairs inside its reviews and those across their borders.
    inside = F.col("n") + F.greatest(F.col("n") - 1, F.lit(0))
    words = lookup(worded.select("topic_id", inside.cast("bigint").alias("words")).unionByName(borders.select("topic_id", F.lit(1).cast("bigint").alias("words")))
                   .groupBy("topic_id").agg(F.sum("words").alias("words")).where("words > 0"))
    average = words.agg(F.floor(F.avg("words")).cast("bigint").alias("a")).first()["a"]
    totals = words.withColumnRenamed("words", "total")
    sent = bucket_postings(worded.join(totals, "topic_id"), buckets)
    kinds = dict(sent.dtypes)
    across = borders.join(totals, "topic_id").select(
        term_bucket(F.col("term"), buckets).alias("bucket"), F.array("term").alias("terms"), F.array("topic_id").alias("topics"),
        F.array(F.lit(0)).alias("sizes"), F.array("topic_id").alias("owners"), F.array("total").alias("totals"),
        F.array().cast(kinds["reviews"]).alias("reviews"), F.array().cast(kinds["times"]).alias("times"))
    found = summed_products(sent.unionByName(across), float(average or 0), 1 + worded.count() // REVIEWS_A_PART, listed, leading)
    return found, words, [borders, *([] if worded is rows else [worded])]


def scored_terms(rows: DataFrame, width: int = BLOCK_WIDTH, listed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The weights of ``weighted_terms(class_terms(rows))`` and ``topic_id, source_row, product, square`` for ``review_scores``.

    Counts and postings go to the buckets of terms together, and a bucket knows its terms' weights as soon as it has summed
    their counts, so no term is joined with its weight afterwards.  Topics must not be null.  Without ``listed`` the weights
    are not written term by term, and the first table has their ``length`` for each topic.
    """
    found, words, read = _summed(rows, width, listed)
    if not listed:
        sums = stored(review_sums(found), "products")
        discard(*read)
        return _lengths(sums), _of_reviews(sums)
    found = stored(found, "products")
    discard(*read)
    return _weights(_counts(found), words), review_sums(found).select("topic_id", "source_row", "product", "square")


def leading_scores(rows: DataFrame, k: int, width: int = BLOCK_WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights, every topic's ``length`` and products as ``scored_terms`` has them, the weights without terms that are surely
    not among a topic's first ``k``: a term is in one bucket, so the first of all are among the first of the buckets.
    """
    found, words, read = _summed(rows, width, listed=False, leading=k)
    found = stored(found, "products")
    discard(*read)
    weights, sums = stored(_weights(_counts(found), words), "leading"), stored(review_sums(found), "sums")
    discard(found)
    return weights, _lengths(sums), _of_reviews(sums)


def _counts(found: DataFrame) -> DataFrame:
    return found.where(F.col("term").isNotNull()).select("topic_id", "term", "tf", "f")


def _lengths(sums: DataFrame) -> DataFrame:
    return sums.where("part < 0").select("topic_id", F.sqrt("square").alias("length"))


def _of_reviews(sums: DataFrame) -> DataFrame:
    return sums.where("part >= 0").select("topic_id", "source_row", "product", "square")


def contenders(weights: DataFrame, by: str, k: int) -> DataFrame:
    """The terms that can be among a topic's first ``k`` by a column, so that few terms are sorted.

    The largest values of hashed parts of a topic belong to different terms, so the ``k``-th of them is a bound.
    """
    parts = weights.groupBy("topic_id", F.pmod(F.xxhash64("term"), F.lit(16 * k)).alias("part")).agg(F.max(by).alias("best"))
    bounds = top_per_group(parts, ["topic_id"], [F.desc("best")], k).where(F.col("rank") == k).select("topic_id", F.col("best").alias("_bound"))
    return weights.join(lookup(bounds), "topic_id", "left").where(F.col("_bound").isNull() | (F.col(by) >= F.col("_bound"))).drop("_bound")


def leading_terms(weights: DataFrame, by: str, k: int) -> DataFrame:
    """The first ``k`` terms of each topic by a column, ties in order of the terms."""
    return top_per_group(contenders(weights, by, k), ["topic_id"], [F.desc(by), F.asc("term")], k)


def keywords(weights: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    return leading_terms(weights, "weight", k)


def keyword_lists(ranked: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """Keywords of each topic in rank order; at most ``k`` per topic."""
    listed = ranked.where(F.col("rank") <= k).groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k")
    )
    return listed.select("topic_id", F.transform("k", lambda x: x["term"]).alias("keywords"))


def topic_info(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Reviews, name (number and first four keywords) and keywords per topic."""
    sizes = rows.groupBy("topic_id").agg(n().alias("reviews"))
    name = F.concat_ws("_", F.col("topic_id").cast("string"), F.slice("keywords", 1, 4))
    return sizes.join(keyword_lists(ranked), "topic_id", "left").withColumn("name", name)


def term_walk(weights: DataFrame, by_count: int = 12, by_weight: int = 10) -> DataFrame:
    """Leading terms by count or by weight, with both ranks among all terms.

    Only the chosen terms get ranks, by counting the terms ahead of them, so no
    topic's whole vocabulary is ever sorted in one task.
    """
    columns = ["topic_id", "term", "tf", "f", "idf", "weight"]
    first = leading_terms(weights.select(*columns), "tf", by_count).drop("rank")
    second = leading_terms(weights.select(*columns), "weight", by_weight).drop("rank")
    chosen = first.unionByName(second).dropDuplicates(["topic_id", "term"])
    chosen = lookup(chosen)
    others = weights.select("topic_id", F.col("term").alias("o_term"), F.col("tf").alias("o_tf"), F.col("weight").alias("o_weight"))

    def ahead(other: Column, own: Column) -> Column:
        return n((other > own) | ((other == own) & (F.col("o_term") < F.col("term"))))

    ranked = others.join(chosen, "topic_id").groupBy(*columns).agg(
        (ahead(F.col("o_tf"), F.col("tf")) + 1).alias("rank_count"),
        (ahead(F.col("o_weight"), F.col("weight")) + 1).alias("rank_weight"),
    )
    return ranked


def generic_terms(walk: DataFrame, lead: int = 3, lost: int = 20) -> DataFrame:
    """Terms that lead by count but fall far behind by weight."""
    return walk.where((F.col("rank_count") <= lead) & (F.col("rank_weight") > lost))


def tfidf_contrast(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each keyword's weight without the root, and its classic review-level weight."""
    reviews = rows.agg(n().alias("n")).scalar()
    wanted = lookup(ranked.select("term").distinct())
    per_review = review_terms(rows).join(wanted, "term", "left_semi").groupBy("source_row", "term").agg(n().alias("times"))
    classic = per_review.groupBy("term").agg(n().alias("holding"), F.max("times").alias("most"))
    return ranked.join(classic, "term", "left").withColumn("reviews", reviews).select(
        "topic_id", "term", "weight",
        (F.col("tf").cast("double") / F.col("words") * F.col("idf")).alias("plain_weight"),
        F.coalesce("holding", F.lit(0)).alias("holding"),
        F.coalesce(F.col("most") * F.log(F.col("reviews") / F.col("holding").cast("double")), F.lit(0.0)).alias("classic_weight"),
    )


# -- representatives -------------------------------------------------------

def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose number no other row has, and the others."""
    repeated = lookup(rows.groupBy("source_row").agg(n().alias("c")).where("c > 1").select(F.col("source_row").alias("_again")))
    again = F.col("source_row").eqNullSafe(F.col("_again"))
    return rows.join(repeated, again, "left_anti"), rows.join(repeated, again, "left_semi")


def review_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of every review's own weighted terms with its topic's.

    ``rows`` may be the products of ``scored_terms``, whose terms have met their weights.  Other terms meet their weights
    once for many reviews.  Rows that share a number are one review, so their terms are counted together first.  ``weights``
    may be the topics' lengths alone.
    """
    lengths = lookup(weights if "length" in weights.columns else weights.groupBy("topic_id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length")))
    products = rows if "product" in rows.columns else _review_products(rows, weights)
    # The review's word count scales its vector and cancels in the cosine.
    scored = products.groupBy("topic_id", "source_row").agg(F.sum("product").alias("product"), F.sqrt(F.sum("square")).alias("own_length"))
    return scored.join(lengths, "topic_id").select(
        "topic_id", "source_row", (F.col("product") / (F.col("own_length") * F.col("length"))).alias("score")
    )


def _review_products(rows: DataFrame, weights: DataFrame) -> DataFrame:
    small_inputs(rows.sparkSession)
    single, several = _once(rows)
    merged = review_terms(several).groupBy("topic_id", "source_row", "term").agg(n().alias("times")).select(
        "term", "topic_id", F.array(F.struct("source_row", "times")).alias("hits"))
    own = postings(single).unionByName(merged)
    parts = own.join(weights.select("topic_id", "term", "idf", F.col("weight").alias("topic_weight")), ["topic_id", "term"]).select(
        "topic_id", "idf", "topic_weight", F.explode("hits").alias("hit")).select("topic_id", "idf", "topic_weight", "hit.*")
    value = F.sqrt(F.col("times").cast("double")) * F.col("idf")
    return parts.select("topic_id", "source_row", (value * F.col("topic_weight")).alias("product"), (value * value).alias("square"))


def representatives(rows: DataFrame, weights: DataFrame, k: int = 3) -> DataFrame:
    """The reviews whose own words lie closest to their topic's."""
    scores = review_scores(rows, weights).withColumn("closeness", F.round("score", 9))
    return top_per_group(scores, ["topic_id"], [F.desc("closeness"), F.asc("source_row")], k).drop("closeness")


# -- keywords by meaning ---------------------------------------------------

def mean_vector(rows: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """Mean vector per group, combined before the shuffle."""
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(name))


def semantic_candidates(
    rows: DataFrame, vectors: DataFrame, weights: DataFrame, representative: DataFrame, candidates: int = CANDIDATES
) -> DataFrame:
    """Leading terms of each topic with the cosine of term and topic.

    ``vectors`` carries ``source_row, vector``.  A term's vector is the mean of
    the reviews that hold it, a topic's the mean of its representatives.
    """
    leading = lookup(keywords(weights, candidates).select("topic_id", "term", "weight", F.col("rank").alias("count_rank")))
    # A fixed number of terms for each topic, so that a task looks for them alone.
    wanted = sorted(row["term"] for row in leading.select("term").distinct().collect())
    # A review takes its vector once, with the list of its leading terms.
    held = postings(rows, only=wanted).select("term", F.explode("hits.source_row").alias("source_row")) \
        .groupBy("source_row").agg(F.collect_set("term").alias("terms"))
    holding = held.join(vectors, "source_row").select("vector", F.explode("terms").alias("term"))
    term_vectors = mean_vector(holding, ["term"], "vector", "term_vector")
    topic_vectors = mean_vector(representative.join(vectors, "source_row"), ["topic_id"], "vector", "topic_vector")
    joined = leading.join(term_vectors, "term").join(topic_vectors, "topic_id")
    length = V.norm(F.col("term_vector")) * V.norm(F.col("topic_vector"))
    return joined.withColumn("similarity", V.dot(F.col("term_vector"), F.col("topic_vector")) / F.nullif(length, F.lit(0.0)))


def semantic_keywords(candidates: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    return top_per_group(candidates, ["topic_id"], [F.desc("similarity"), F.asc("term")], k)


def diverse_keywords(candidates: DataFrame, diversity: float, k: int = TOP_KEYWORDS) -> DataFrame:
    """Greedy maximal marginal relevance among each topic's candidates.

    A topic's candidates are a fixed small number, so each group fits a task.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["similarity", "term"], ascending=[False, True]).reset_index(drop=True)
        words = np.stack(group["term_vector"].to_numpy())
        words = words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12)
        relevance, likeness = group["similarity"].to_numpy(), words @ words.T
        chosen = [0]
        while len(chosen) < min(k, len(group)):
            rest = [i for i in range(len(group)) if i not in chosen]
            gain = (1 - diversity) * relevance[rest] - diversity * likeness[np.ix_(rest, chosen)].max(axis=1)
            chosen.append(rest[int(np.argmax(gain))])
        picked = group.iloc[chosen]
        return pd.DataFrame({
            "topic_id": picked["topic_id"].astype("int32"), "term": picked["term"],
            "similarity": picked["similarity"], "rank": np.arange(1, len(picked) + 1, dtype="int32"),
        })

    small = candidates.select("topic_id", "term", "similarity", "term_vector")
    return small.groupBy("topic_id").applyInPandas(pick, "topic_id int, term string, similarity double, rank int")


def representation_table(rows: DataFrame, methods: dict[str, DataFrame], first: int = 5) -> DataFrame:
    """The first keywords of each method side by side, per topic."""
    table = rows.where(F.col("topic_id") >= 0).groupBy("topic_id").agg(n().alias("reviews"))
    for name, ranked in methods.items():
        listed = keyword_lists(ranked, first).select("topic_id", F.array_join("keywords", " · ").alias(name))
        table = table.join(listed, "topic_id", "left")
    return table


def topic_search(info: DataFrame, needle: str) -> DataFrame:
    """Topics with a keyword that contains the text."""
    wanted = needle.strip().lower()
    return info.where(F.exists("keywords", lambda k: F.contains(k, F.lit(wanted)))) if wanted else info


def topic_objects(rows: DataFrame, ranked: DataFrame, representative: DataFrame) -> DataFrame:
    """One record per topic: group, size, weighted keywords, representative reviews.

    The member list stays a table (``topic_members``): a topic may hold a large
    part of all reviews, far too many for one array.
    """
    base = rows.where(F.col("topic_id") >= 0).groupBy("topic_id").agg(
        F.min("cluster_id").alias("cluster_id"), F.countDistinct("cluster_id").alias("clusters"), n().alias("review_count"),
        F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"),
    )
    words = ranked.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("weight")).alias("order"), "term"))).alias("k")).select(
        "topic_id", F.transform("k", lambda x: F.struct(x["term"].alias("term"), (-x["order"]).alias("c_tf_idf_weight"))).alias("keywords"))
    examples = representative.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_row"))).alias("e")).select(
        "topic_id", F.transform("e", lambda x: x["source_row"]).alias("representative_rows"))
    return base.join(words, "topic_id", "left").join(examples, "topic_id", "left").withColumns({
        "interpretation_status": F.lit("pending"), "review_status": F.lit("unreviewed"),
    })


def topic_object_problems(objects: DataFrame, rows: DataFrame) -> DataFrame:
    """Topics of several groups, and representatives that are not members."""
    split = objects.where(F.col("clusters") > 1).select("topic_id", F.lit("several_groups").alias("rule"))
    examples = objects.select("topic_id", F.explode("representative_rows").alias("source_row"))
    foreign = examples.join(rows.select("topic_id", "source_row"), ["topic_id", "source_row"], "left_anti").select(
        "topic_id", F.lit("foreign_representative").alias("rule"))
    return split.unionByName(foreign)


def topic_members(rows: DataFrame, topic: int) -> DataFrame:
    """Members of one topic with their group; read them firmest first."""
    return rows.where(F.col("topic_id") == topic).select("topic_id", "cluster_id", "record_id", "source_row", "probability")


def keyword_comparison(before: DataFrame, after_: DataFrame) -> DataFrame:
    """Shared and new keywords between two lists of a topic, with rank movement."""
    left = before.select("topic_id", "term", F.col("rank").alias("rank_before"))
    right = after_.select("topic_id", "term", F.col("rank").alias("rank_after"))
    both = left.join(right, ["topic_id", "term"], "full_outer")
    return both.withColumn(
        "note", F.when(F.col("rank_after").isNull(), "only before").when(F.col("rank_before").isNull(), "only after").otherwise("shared")
    ).withColumn("moved", F.col("rank_before") - F.col("rank_after"))


def keyword_comparison_summary(compared: DataFrame) -> DataFrame:
    """Keywords kept per topic, and the different words in each list."""
    words = compared.select("topic_id", "note", "rank_before", "rank_after", F.explode(F.split("term", " ")).alias("word"))
    distinct = words.groupBy("topic_id").agg(
        F.countDistinct(F.when(F.col("rank_before").isNotNull(), F.col("word"))).alias("words_before"),
        F.countDistinct(F.when(F.col("rank_after").isNotNull(), F.col("word"))).alias("words_after"),
    )
    kept = compared.groupBy("topic_id").agg(
        n(F.col("note") == "shared").alias("kept"), F.count("rank_after").alias("of"))
    return kept.join(distinct, "topic_id")
