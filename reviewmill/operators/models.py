"""Supervised models on labelled reviews, their splits and their scores."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions import text as X
from ..functions.numbers import n, ratio, rounded
from ..session import checkpointed, lookup, stored

CLEAR_LABELS = ["relevant", "irrelevant"]
FOLDS = 5


# -- labelled rows ---------------------------------------------------------

def labelled_set(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Clear labels joined to their reviews, one row per text, with a 0/1 target.

    ``labels``: ``record_id, label``; ``rows``: ``record_id, source_row, platform,
    text, vector``.  Copies of a text collapse before the shuffle.
    """
    clear = labels.where(F.col("label").isin(CLEAR_LABELS))
    joined = clear.join(rows, "record_id")
    columns = [c for c in joined.columns if c != "text"]
    first = joined.groupBy("text").agg(F.min_by(F.struct(*columns), "source_row").alias("r"))
    return first.select("text", "r.*").withColumn("target", (F.col("label") == "relevant").cast("int"))


def label_margins(rows: DataFrame) -> DataFrame:
    """Platform by label counts with totals."""
    return rows.cube("platform", "label").agg(n().alias("rows")).select(
        F.coalesce("platform", F.lit("All")).alias("platform"), F.coalesce("label", F.lit("All")).alias("label"), "rows")


def platform_baseline(platform: Column) -> Column:
    """Predicts relevance from the platform alone."""
    return (platform == "x").cast("int")


# -- splits ----------------------------------------------------------------

def _numbered_in_stratum(rows: DataFrame, strata: list[str], key: str, seed: int, modulo: int, name: str) -> DataFrame:
    """Spread each stratum evenly over ``modulo`` parts, in seeded random order.

    A stratum may hold most rows, so it is cut by hash range; each slice deals
    its rows starting where the slices before it stopped.
    """
    draw = F.xxhash64(F.col(key), F.lit(seed))
    sliced = rows.withColumn("_draw", draw).withColumn("_slice", F.shiftrightunsigned("_draw", 48).cast("int"))
    counts = sliced.groupBy(*strata, "_slice").agg(n().alias("_n"))
    ahead = Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*strata, "_slice").orderBy(F.shiftrightunsigned("_draw", 1), key)
    return sliced.withColumn("_at", F.row_number().over(inside) - 1).join(lookup(offsets), [*strata, "_slice"]).withColumn(
        name, F.pmod(F.col("_at") + F.col("_offset"), F.lit(modulo)).cast("int")).drop("_draw", "_slice", "_at", "_offset")


def stratified_folds(rows: DataFrame, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """Adds ``fold``: equal shares of every platform and target in each fold."""
    return _numbered_in_stratum(rows, ["platform", "target"], "record_id", seed, folds, "fold")


def text_group(text: Column) -> Column:
    """Equivalent texts share a group: same letters and digits, case and spaces aside."""
    return F.sha2(X.plain_wording(text), 256)


def grouped_split(rows: DataFrame, train: float, validation: float, test: float, seed: int = 42) -> DataFrame:
    """Adds ``split``; equivalent texts stay together, classes keep their shares.

    A group of copies counts under the label of its first row, so a text that
    fills much of the table is one row here.
    """
    if abs(train + validation + test - 100) > 1e-9 or min(train, validation, test) <= 0:
        raise ValueError("percentages must be positive and sum to 100")
    keyed = rows.withColumn("text_group", text_group(F.col("text")))
    groups = keyed.groupBy("text_group").agg(F.min_by("label", "record_id").alias("group_label"))
    dealt = _numbered_in_stratum(groups, ["group_label"], "text_group", seed, 1000, "_share")
    part = F.when(F.col("_share") < train * 10, "train").when(F.col("_share") < (train + validation) * 10, "validation").otherwise("test")
    # The dealer counts 0, 1, 2 ...; a fixed stride scatters the counts over the range.
    strewn = dealt.withColumn("_share", F.pmod(F.col("_share") * 619, F.lit(1000)))
    return keyed.join(strewn.select("text_group", part.alias("split")), "text_group")


def split_distribution(rows: DataFrame) -> DataFrame:
    """Class shares per split against the source, in percentage points, with the largest gap."""
    counted = rows.groupBy("split", "label").agg(n().alias("rows"))
    totals = counted.groupBy("split").agg(F.sum("rows").alias("split_rows"))
    whole = counted.groupBy("label").agg(F.sum("rows").alias("label_rows"))
    everything = counted.agg(F.sum("rows").alias("t")).scalar()
    shares = counted.join(totals, "split").join(whole, "label").withColumn("all_rows", everything).select(
        "split", "label", "rows", ratio(F.col("rows"), F.col("split_rows"), 100).alias("share_pct"),
        ratio(F.col("label_rows"), F.col("all_rows"), 100).alias("source_pct"))
    return shares.withColumn("difference_pp", rounded(F.col("share_pct") - F.col("source_pct")))


def largest_gap(distribution: DataFrame, limit: float = 5.0) -> DataFrame:
    return distribution.agg(rounded(F.max(F.abs("difference_pp"))).alias("largest_gap")).withColumn("warn", F.col("largest_gap") > limit)


# -- relevance models ------------------------------------------------------

def balanced(rows: DataFrame, label: str = "target") -> DataFrame:
    """Adds ``weight = rows / (classes * rows of the class)``."""
    counts = rows.groupBy(label).agg(n().alias("_c"))
    total = counts.agg(F.sum("_c").alias("t")).scalar()
    classes = counts.agg(n().alias("k")).scalar()
    weights = counts.withColumn("weight", total.cast("double") / (classes * F.col("_c"))).select(label, "weight")
    return rows.join(lookup(weights), label)


def _classifier(kind: str):
    if kind == "logistic":
        return LogisticRegression(featuresCol="scaled", labelCol="target", weightCol="weight", regParam=0.01, maxIter=50)
    return LinearSVC(featuresCol="scaled", labelCol="target", weightCol="weight", regParam=0.01, maxIter=40)


def fit_relevance(rows: DataFrame, kind: str):
    """Scaler and class-balanced classifier, fitted on ``vector`` and ``target``.

    Counts, scaler and classifier read the rows several times, so they are written first.
    """
    points = balanced(stored(rows.select("vector", "target"), "fit")).withColumn("features", array_to_vector("vector"))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, _classifier(kind)]).fit(points)


def score_relevance(model, rows: DataFrame) -> DataFrame:
    """Prediction and decision score (the margin of the positive class)."""
    points = rows.withColumn("features", array_to_vector("vector"))
    return model.transform(points).select(
        *rows.columns, F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("rawPrediction")[1].alias("decision_score"))


def out_of_fold(folded: DataFrame, kind: str, folds: int = FOLDS) -> DataFrame:
    """Every row predicted by the model that did not see its fold."""
    pinned = checkpointed(folded)
    parts = []
    for fold in range(folds):
        model = fit_relevance(pinned.where(F.col("fold") != fold), kind)
        parts.append(score_relevance(model, pinned.where(F.col("fold") == fold)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def relevance_gate(rows: DataFrame) -> DataFrame:
    """Store reviews pass; social ones pass if predicted relevant."""
    keep = F.when(F.col("platform").isin(S.SOCIAL_PLATFORMS), F.coalesce(F.col("prediction") == 1, F.lit(False))).otherwise(True)
    return rows.where(keep)


# -- scores ----------------------------------------------------------------

def confusion(rows: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or []), F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(n().alias("rows"))


def class_scores(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero division scores zero."""
    keys = keys or []
    long = matrix.select(*keys, F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("rows").alias("called"), F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")).select(*keys, "s.*")
    summed = long.groupBy(*keys, "class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.col("hits") / F.nullif(F.col("called").cast("double"), zero), zero)
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("support").cast("double"), zero), zero)
    scored = summed.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(2.0 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), zero), zero)
    return scored.withColumn("f1", f1)


def summary_scores(matrix: DataFrame, keys: list[str] | None = None, positive=1) -> DataFrame:
    """Accuracy, balanced accuracy, the positive class's scores, macro and weighted F1."""
    keys = keys or []
    scores = class_scores(matrix, keys)
    real = F.col("support") > 0
    mine = F.col("class") == positive
    return scores.groupBy(*keys).agg(
        F.sum("support").alias("rows"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        rounded(F.avg(F.when(real, F.col("recall")))).alias("balanced_accuracy"),
        rounded(F.coalesce(F.max(F.when(mine, F.col("precision"))), F.lit(0.0))).alias("precision"),
        rounded(F.coalesce(F.max(F.when(mine, F.col("recall"))), F.lit(0.0))).alias("recall"),
        rounded(F.coalesce(F.max(F.when(mine, F.col("f1"))), F.lit(0.0))).alias("f1"),
        rounded(F.avg("f1")).alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def shared_errors(rows: DataFrame, first: str, second: str) -> DataFrame:
    return rows.where((F.col("target") != F.col(first)) & (F.col("target") != F.col(second)))


def error_counts(rows: DataFrame, first: str, second: str) -> DataFrame:
    wrong = lambda c: F.col("target") != F.col(c)
    return rows.agg(n(wrong(first)).alias("first_errors"), n(wrong(second)).alias("second_errors"), n(wrong(first) & wrong(second)).alias("shared_errors"))


# -- sentiment training ----------------------------------------------------

def stars_to_label(rating: Column) -> Column:
    return F.when(rating <= 2, "negative").when(rating == 3, "neutral").when(rating <= 5, "positive")


def text_features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", X.terms(F.col("text")))


def train_sentiment(rows: DataFrame, grid: dict[str, list] | None = None, features: int = 1 << 14):
    """Best text classifier by macro F1 on the validation part, and the search's scores.

    ``rows``: ``text, label, split``.  The grid is a handful of settings.
    """
    grid = grid or {"regParam": [0.01, 0.1]}
    index = F.array_position(F.array(*[F.lit(s) for s in S.SENTIMENTS]), F.col("label")) - 1
    data = checkpointed(text_features(rows).withColumn("target", index.cast("double")))
    train, validation = data.where("split = 'train'"), data.where("split = 'validation'")
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features)
    idf = IDF(inputCol="tf", outputCol="features")
    base = Pipeline(stages=[tf, idf]).fit(train)
    prepared = checkpointed(base.transform(train).select("features", "target"))
    seen = checkpointed(base.transform(validation).select("features", "target"))
    trials, best = [], None
    for values in product(*grid.values()):
        setting = dict(zip(grid, values))
        model = LogisticRegression(featuresCol="features", labelCol="target", family="multinomial", maxIter=30, **setting).fit(prepared)
        score = macro_f1(model.transform(seen))
        trials.append({"setting": str(setting), "macro_f1": score})
        if best is None or score > best[0]:
            best = (score, model)
    return base, best[1], trials


def macro_f1(predicted: DataFrame) -> float:
    matrix = confusion(predicted, "target", "prediction")
    return summary_scores(matrix).first()["macro_f1"]


def predict_sentiment(base, model, rows: DataFrame) -> DataFrame:
    """``label`` and three probabilities for any rows with ``text``."""
    scored = model.transform(base.transform(text_features(rows)))
    p = vector_to_array("probability")
    return scored.select(*rows.columns, *[p[i].alias(f"p_{name}") for i, name in enumerate(S.SENTIMENTS)],
                         F.element_at(F.array(*[F.lit(s) for s in S.SENTIMENTS]), (F.col("prediction") + 1).cast("int")).alias("predicted"))


# -- languages -------------------------------------------------------------

# Frequent words that mark a language (own choice of profile).
PROFILES = {
    "spanish": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "por", "con", "para", "una", "es", "no"],
    "english": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on", "was", "this", "not"],
    "french": ["le", "les", "des", "et", "un", "une", "du", "est", "dans", "pour", "qui", "sur", "pas", "au", "avec"],
    "german": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "nicht", "ein", "dem"],
}


def language_audit(rows: DataFrame, threshold: float = 0.8, min_letters: int = 20, target: str = "spanish") -> DataFrame:
    """Adds the detected language, its score and a status.

    The score is the language's share of all profile words in the text; texts
    with too few letters, or with no profile word, are *too_short* or *unknown*.
    """
    tokens = X.words(F.col("text"))

    def profile_hits(profile: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda token: token.isin(profile)))

    hits = {name: profile_hits(profile) for name, profile in PROFILES.items()}
    counted = rows.withColumns({f"_h_{name}": value for name, value in hits.items()}).withColumn(
        "letters", F.length(F.regexp_replace("text", r"[^\p{L}]", "")))
    total = sum((F.col(f"_h_{name}") for name in list(PROFILES)[1:]), F.col(f"_h_{list(PROFILES)[0]}"))
    most = F.greatest(*[F.col(f"_h_{name}") for name in PROFILES])
    named = F.lit(None).cast("string")
    for name in reversed(list(PROFILES)):
        named = F.when(F.col(f"_h_{name}") == most, name).otherwise(named)
    scored = counted.withColumns({"_t": total, "_m": most, "_l": named})
    known = F.col("_t") > 0
    scored = scored.withColumns({
        "detected_language": F.when(known, F.col("_l")).otherwise("unknown"), "score": F.when(known, F.col("_m") / F.col("_t")).otherwise(0.0),
    })
    status = F.when(F.col("letters") < min_letters, "too_short").when(~known, "unknown").when(F.col("score") < threshold, "uncertain").when(
        F.col("detected_language") == target, target).otherwise("other_language")
    return scored.withColumn("status", status).drop("_t", "_m", "_l", *[f"_h_{name}" for name in PROFILES])


def language_counts(audited: DataFrame, target: str = "spanish", target_only: bool = False) -> DataFrame:
    """Reviews per status and language, and how many are retained."""
    kept = (F.col("status") == target) if target_only else F.lit(True)
    return audited.groupBy("status", "detected_language").agg(n().alias("reviews"), n(kept).alias("retained"))
