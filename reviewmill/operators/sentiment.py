"""Sentiment predictions: scoring, checks, and the reports built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions import text as X
from ..functions.hashing import text_hash
from ..functions.numbers import n, ratio, rounded
from ..session import lookup
from .ordered import top_per_group

PROBABILITIES = [f"p_{label}" for label in S.SENTIMENTS]
MAX_TOKENS = 128
DASH, UNASSIGNED_NAME = "—", "(unassigned)"

Predictor = Callable[[list[str]], np.ndarray]


def argmax_label() -> Column:
    """Winning class; ties go to negative, then neutral, then positive."""
    neg, neu, pos = (F.col(p) for p in PROBABILITIES)
    return F.when((neg >= neu) & (neg >= pos), "negative").when(neu >= pos, "neutral").otherwise("positive")


def softmax(scores: dict[str, str]) -> dict[str, Column]:
    """Probabilities from class scores; columns are matched by class name."""
    columns = {label: F.col(scores[label]).cast("double") for label in S.SENTIMENTS}
    top = F.greatest(*columns.values())
    powers = {label: F.exp(value - top) for label, value in columns.items()}
    total = sum(list(powers.values())[1:], powers["negative"])
    return {f"p_{label}": power / total for label, power in powers.items()}


def classify(
    reviews: DataFrame, predict: Predictor, text: str = "embedding_text",
    prepare: Callable[[str], str] | None = None, max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """One terminal record per review, in Arrow batches.

    Blank text is *excluded* and a preparation error *failed*; neither becomes
    neutral.  ``predict`` returns one row of three probabilities per text.
    """

    def ready(value) -> tuple[str, str | None, str | None]:
        """Status, reason and prepared text of one review."""
        if not isinstance(value, str) or not value.strip():
            return "excluded", "empty_text", None
        try:
            body = prepare(value) if prepare else value
        except (TypeError, ValueError):
            return "failed", "preprocessing_error", None
        return ("classified", None, body) if body.strip() else ("excluded", "empty_preprocessed_text", body)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            states = [ready(value) for value in batch[text]]
            chosen = [at for at, (status, _, _) in enumerate(states) if status == "classified"]
            scores = np.full((len(batch), 3), np.nan)
            if chosen:
                scores[chosen] = np.asarray(predict([states[at][2] for at in chosen]), dtype=float)
            out = pd.DataFrame(scores, columns=PROBABILITIES)
            out.insert(0, "record_id", batch["record_id"].to_numpy())
            out["status"], out["reason"], out["prepared"] = zip(*states) if states else ([], [], [])
            out["tokens"] = np.array([len(body.split()) + 2 if body else 0 for _, _, body in states], dtype="int32")
            yield out[[*out.columns[:6], "tokens", "prepared"]]

    schema = "record_id string, p_negative double, p_neutral double, p_positive double, status string, reason string, tokens int, prepared string"
    scored = reviews.select("record_id", text).mapInPandas(run, schema)
    clean = scored.withColumns({p: F.when(~F.isnan(p), F.col(p)) for p in PROBABILITIES})
    return clean.withColumns({
        "label": F.when(F.col("status") == "classified", argmax_label()),
        "input_hash": text_hash(F.col("prepared")), "truncated": F.col("tokens") > max_tokens,
    }).drop("prepared")


def prediction_problems(predictions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Every rule a prediction record breaks."""
    values = [F.col(p) for p in PROBABILITIES]
    complete = values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull()
    any_value = values[0].isNotNull() | values[1].isNotNull() | values[2].isNotNull()
    outside = [F.isnan(v) | (v < 0) | (v > 1) for v in values]
    classified = F.col("status") == "classified"
    rules = {
        "unknown_status": ~F.coalesce(F.col("status").isin(S.STATUSES), F.lit(False)),
        "probabilities_incomplete": any_value & ~complete,
        "probability_out_of_range": complete & (outside[0] | outside[1] | outside[2]),
        "probabilities_do_not_sum": complete & (F.abs(values[0] + values[1] + values[2] - 1.0) > tolerance),
        "label_is_not_the_winner": classified & complete & ~F.col("label").eqNullSafe(argmax_label()),
        "classified_without_probabilities": classified & ~complete,
        "label_without_classification": ~classified & F.col("label").isNotNull(),
        "reason_on_classified": classified & F.col("reason").isNotNull(),
        "reason_missing": ~classified & F.col("reason").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return predictions.withColumn("rule", F.explode(broken)).select("record_id", "rule")


def join_problems(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Reviews without, and predictions without a review or repeated, counted."""
    ours = rows.groupBy("record_id").agg(n().alias("l"))
    theirs = predictions.groupBy("record_id").agg(n().alias("r"))
    return ours.join(theirs, "record_id", "full_outer").agg(
        n(F.col("r").isNull()).alias("missing"), n(F.col("l").isNull()).alias("unexpected"),
        n(F.col("r") > 1).alias("duplicate_predictions"), n(F.col("l") > 1).alias("duplicate_reviews"),
    )


def topic_sentiment(rows: DataFrame) -> DataFrame:
    """Coverage, label counts, shares and net sentiment per topic.

    ``rows`` carries ``topic_id, status, label``; shares are null where nothing
    was classified.
    """
    classified = F.col("status") == "classified"
    counted = rows.where(F.col("topic_id") >= 0).groupBy("topic_id").agg(
        n().alias("assigned"), *[n(F.col("status") == s).alias(s) for s in S.STATUSES],
        *[n(classified & (F.col("label") == k)).alias(k) for k in S.SENTIMENTS],
    )
    done = F.col("classified")
    return counted.withColumns({
        "classified_fraction": ratio(done, F.col("assigned")),
        **{f"{k}_share": ratio(F.col(k), done) for k in S.SENTIMENTS},
        "net_sentiment": ratio(F.col("positive") - F.col("negative"), done),
    })


def sentiment_by_topic(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Label counts and shares per topic with the topic's name; ``labels``: topic, label, assessment."""
    counted = rows.where(F.col("sentiment").isNotNull()).groupBy("topic_id").agg(
        n().alias("reviews"), *[n(F.col("sentiment") == k).alias(k) for k in S.SENTIMENTS])
    named = counted.join(labels.select("topic_id", F.col("label").alias("feature"), "assessment"), "topic_id", "left")
    loose = F.col("topic_id") == -1
    return named.withColumns({
        **{f"{k}_share": ratio(F.col(k), F.col("reviews")) for k in S.SENTIMENTS},
        "feature": F.when(loose, UNASSIGNED_NAME).otherwise(F.coalesce("feature", F.lit(DASH))),
        "assessment": F.when(loose, DASH).otherwise(F.col("assessment")),
    })


TOPIC_ORDER = ("negative_share", "reviews")


def by_negativity(table: DataFrame) -> DataFrame:
    return table.orderBy(*[F.desc(c) for c in TOPIC_ORDER], "topic_id")


def most_negative_large_topic(table: DataFrame, least: int = 30) -> DataFrame:
    return by_negativity(table.where((F.col("topic_id") >= 0) & (F.col("reviews") >= least))).limit(1)


def overall_mix(rows: DataFrame) -> DataFrame:
    counted = rows.where(F.col("sentiment").isNotNull()).groupBy("sentiment").agg(n().alias("reviews"))
    total = rows.agg(F.count("sentiment").alias("t")).scalar()
    return counted.withColumn("share", ratio(F.col("reviews"), total))


def rating_sentiment(rows: DataFrame) -> DataFrame:
    """Label counts and row shares per star, rated reviews only."""
    counted = rows.where(F.col("rating").isNotNull() & F.col("sentiment").isNotNull()).groupBy("rating").agg(
        n().alias("reviews"), *[n(F.col("sentiment") == k).alias(k) for k in S.SENTIMENTS])
    return counted.withColumns({f"{k}_share": ratio(F.col(k), F.col("reviews")) for k in S.SENTIMENTS})


def expected_label(rating: Column) -> Column:
    return F.when(rating <= 2, "negative").when(rating == 3, "neutral").when(rating.isNotNull(), "positive")


def rating_agreement(rows: DataFrame) -> DataFrame:
    """How often the label agrees with the stars, with and without the middle."""
    rated = rows.where(F.col("rating").isNotNull() & F.col("sentiment").isNotNull())
    polar = (F.col("rating") != 3) & (F.col("sentiment") != "neutral")
    agrees = (F.col("rating") <= 2) == (F.col("sentiment") == "negative")
    hits = expected_label(F.col("rating")) == F.col("sentiment")
    return rated.agg(
        n().alias("rated"), ratio(n(hits), n()).alias("agreement"), n(polar).alias("polar"),
        ratio(n(polar & agrees), n(polar)).alias("polar_agreement"),
    )


def rating_disagreement(rows: DataFrame) -> DataFrame:
    """Five stars but neutral: count, median length (mean of the middle two, and the upper one)."""
    odd = rows.where((F.col("rating") == 5) & (F.col("sentiment") == "neutral"))
    lengths = odd.groupBy(F.length("text").cast("bigint").alias("length")).agg(n().alias("rows"))
    total = lengths.agg(F.sum("rows").alias("t")).scalar()
    middle = lengths.agg(F.percentile("length", F.lit(0.5), F.col("rows")).alias("median"), F.sum("rows").alias("reviews"))
    # One row per different length, so the running sum is a small window.
    ranked = lengths.withColumn("last", F.sum("rows").over(Window.orderBy("length"))).withColumn("total", total)
    at = ranked.where(F.col("last") > F.floor(F.col("total") / 2)).agg(F.min("length").alias("u")).scalar()
    return middle.select(F.coalesce("reviews", F.lit(0)).alias("reviews"), rounded(F.col("median")).alias("median_length"), at.alias("upper_median_length"))


def disagreement_examples(rows: DataFrame, limit: int = 6, characters: int = 60) -> DataFrame:
    odd = rows.where((F.col("rating") == 5) & (F.col("sentiment") == "neutral"))
    return odd.orderBy("source_row").limit(limit).select(
        "record_id", F.substring("text", 1, characters).alias("excerpt"), "p_neutral", "p_positive")


def confidence() -> Column:
    return F.greatest(*PROBABILITIES)


def label_index(label: Column) -> Column:
    return F.when(label == "negative", 0).when(label == "neutral", 1).otherwise(2)


def member_order() -> list[Column]:
    """Label first, most confident first inside a label, then row."""
    return [label_index(F.col("sentiment")).asc(), confidence().desc(), F.col("source_row").asc()]


def margin() -> Column:
    """Best minus second-best probability."""
    ordered = F.sort_array(F.array(*PROBABILITIES), asc=False)
    return ordered[0] - ordered[1]


def domain(platform: Column) -> Column:
    return F.when(platform.isin(S.STORE_PLATFORMS), "stores").when(platform.isin(S.SOCIAL_PLATFORMS), "social")


def classify_by_domain(reviews: DataFrame, predictors: dict[str, Predictor], text: str = "embedding_text") -> DataFrame:
    """Each domain scored by its own model."""
    parts = [
        classify(reviews.where(domain(F.col("platform")) == name), predict, text).withColumn("domain", F.lit(name))
        for name, predict in predictors.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def top_topic_reviews(rows: DataFrame, largest: DataFrame) -> DataFrame:
    """Reviews of the largest topics, to be scored."""
    return rows.join(lookup(largest.select("topic_id")), "topic_id", "left_semi").select("record_id", "topic_id", "platform", "text")


def top_topic_check(rows: DataFrame, largest: DataFrame) -> DataFrame:
    """Selected rows against the topics' own counts."""
    expected = largest.agg(F.sum("reviews").alias("e")).scalar()
    return top_topic_reviews(rows, largest).agg(n().alias("rows"), F.countDistinct("topic_id").alias("topics")).withColumn(
        "expected", expected).withColumn("complete", F.col("rows") == F.col("expected"))


def topic_sentiment_pct(rows: DataFrame, ordered: DataFrame) -> DataFrame:
    """Shares in percent for a fixed topic list, zero where a topic has no reviews."""
    counted = rows.groupBy("topic_id").agg(*[n(F.col("sentiment") == k).alias(k) for k in S.SENTIMENTS], F.count("sentiment").alias("_n"))
    return ordered.select("topic_id").join(counted, "topic_id", "left").select(
        "topic_id", *[F.coalesce(ratio(F.col(k), F.col("_n"), 100), F.lit(0.0)).alias(f"{k}_pct") for k in S.SENTIMENTS])


def spread_examples(rows: DataFrame, largest: DataFrame, representative: DataFrame, pick: int = 6) -> DataFrame:
    """One review from topics spread evenly over the size ranking.

    ``largest`` is a short ranked list (``topic_id, reviews``).
    """
    ranked = largest.withColumn("at", F.row_number().over(Window.orderBy(F.desc("reviews"), "topic_id")) - 1)
    total = largest.agg(n().alias("t")).scalar()
    ranked = ranked.withColumn("total", total).withColumn("count", F.least(F.col("total"), F.lit(pick)))
    steps = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1),
        lambda i: F.floor(i * (F.col("total") - 1) / F.greatest(F.col("count") - 1, F.lit(1))).cast("bigint"),
    )
    chosen = lookup(ranked.where(F.array_contains(steps, F.col("at").cast("bigint"))).select("topic_id", "at"))
    first = lookup(representative.select("source_row", F.lit(0).alias("_first")))
    members = rows.join(chosen, "topic_id").join(first, "source_row", "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    return top_per_group(members, ["topic_id"], [F.asc("_first"), F.asc("source_row")], 1).select(
        "topic_id", "record_id", "text", "sentiment", *PROBABILITIES)


def topic_picks(rows: DataFrame, odd: int = 2) -> DataFrame:
    """Most confident review of each label, and up to two five-star neutral ones, per topic."""
    sure = [confidence().desc(), F.col("source_row").asc()]
    best = top_per_group(rows, ["topic_id", "sentiment"], sure, 1).withColumn("pick", F.col("sentiment"))
    strange = top_per_group(
        rows.where((F.col("rating") == 5) & (F.col("sentiment") == "neutral")), ["topic_id"], sure, odd
    ).withColumn("pick", F.concat(F.lit("five_star_neutral_"), F.col("rank").cast("string")))
    return best.unionByName(strange).select("topic_id", "pick", "record_id", rounded(confidence()).alias("confidence"))
