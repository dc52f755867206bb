"""Guest text: a lexicon classifier, the evidence gate and its scores, all in column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import rounded_div


@dataclass(frozen=True)
class Lexicon:
    """Cue words by use; aspects: name, keywords and who acts on it."""

    negative: tuple[str, ...]
    positive: tuple[str, ...]
    severe: tuple[str, ...]
    moderate: tuple[str, ...]
    aspects: tuple[tuple[str, tuple[str, ...], str], ...]
    split: str = r"(?<=[.!?])\s+|\s*[;]\s*|\s+-\s+|\b(?:but|however|though)\b"


def _hits(words: Column, cues: tuple[str, ...]) -> Column:
    """How many of the cues are among the words."""
    return F.size(F.array_intersect(words, F.array(*map(F.lit, cues)))) if cues else F.lit(0)


def classify_aspects(reviews: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(review_id, category, polarity, severity, actionable_by, evidence_span): the first clause for each aspect and polarity.

    A clause with as many positive as negative cues has no polarity. The span is
    the clause's first 200 characters.
    """
    c = reviews.where(F.trim(F.coalesce("review_text", F.lit(""))) != "").select("review_id", F.posexplode(F.split("review_text", lexicon.split)).alias("at", "clause"))
    words = F.filter(F.split(F.lower("clause"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    c = c.withColumn("words", words)
    neg, pos = _hits(F.col("words"), lexicon.negative), _hits(F.col("words"), lexicon.positive)
    c = c.withColumn("polarity", F.when(neg > pos, "negative").when(pos > neg, "positive")).where("polarity is not null")
    severity = F.when(_hits(F.col("words"), lexicon.severe) > 0, "severe").when(_hits(F.col("words"), lexicon.moderate) > 0, "moderate").otherwise("minor")
    found = F.filter(F.array(*[F.when(_hits(F.col("words"), keys) > 0, F.struct(F.lit(name).alias("category"), F.lit(team).alias("team"))) for name, keys, team in lexicon.aspects]), lambda x: x.isNotNull())
    a = c.withColumn("severity", severity).withColumn("a", F.explode(found))
    first = F.min(F.struct("at", "severity", F.substring(F.trim("clause"), 1, 200).alias("span"), F.col("a.team").alias("team")))
    a = a.groupBy("review_id", F.col("a.category").alias("category"), "polarity").agg(first.alias("f"))
    return a.select("review_id", "category", "polarity", F.col("f.severity").alias("severity"), F.when(F.col("polarity") == "negative", F.col("f.team")).alias("actionable_by"), F.col("f.span").alias("evidence_span"))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def verify_evidence(aspects: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): a span must stand in its review, whatever the case and spacing.

    Rejected are spans that do not, unknown reviews and reviews with no aspect at
    all ("omitted"); each with its reason.
    """
    r = reviews.select("review_id", F.col("review_text").alias("source_text"))
    j = aspects.join(r.withColumn("known", F.lit(True)), "review_id", "left")
    span, text = _plain(F.col("evidence_span")), _plain(F.col("source_text"))
    good = F.coalesce((F.length(span) > 0) & F.contains(text, span), F.lit(False))
    j = j.withColumn("ok", F.col("known").isNotNull() & good)
    accepted = j.where("ok").select(*aspects.columns, F.lit(True).alias("evidence_verified"))
    bad = j.where("not ok").select("review_id", "category", F.when(F.col("known").isNull(), "unknown review").otherwise("span not in source").alias("reason"))
    omitted = r.join(aspects.select("review_id").distinct(), "review_id", "left_anti").select("review_id", F.lit(None).cast("string").alias("category"), F.lit("omitted").alias("reason"))
    return accepted, bad.unionByName(omitted)


def score_aspects(pred: DataFrame, gold: DataFrame, by: str | None = None, with_polarity: bool = False) -> DataFrame:
    """TP, FP, FN with precision, recall and F1 over distinct (review, category[, polarity]) pairs, by a column of both or overall."""
    keys = ["review_id", "category", *(["polarity"] if with_polarity else []), *([by] if by and by not in ("category", "polarity") else [])]
    p, g = pred.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    j = p.join(g, keys, "full_outer")
    s = j.groupBy(*([by] if by else [])).agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    pr, rc = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return s.select("*", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6).alias("f1"))


def macro_scores(pred: DataFrame, gold: DataFrame, reviews: DataFrame, by: str) -> DataFrame:
    """By a column of the reviews: TP, FP, FN and the plain mean of the categories' F1 (six places each), so a rare category counts as much as a common one."""
    keys = ["review_id", "category", "polarity"]
    j = pred.select(*keys).distinct().withColumn("p", F.lit(1)).join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full_outer").join(reviews.select("review_id", by), "review_id")
    p, g = F.col("p").isNotNull(), F.col("g").isNotNull()
    c = j.groupBy(by, "category").agg(F.count_if(p & g).alias("tp"), F.count_if(~g).alias("fp"), F.count_if(~p).alias("fn"))
    f1 = rounded_div(2_000_000 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.groupBy(by).agg(F.count("*").alias("categories"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], (rounded_div(F.sum(f1), F.count("*")) / 1e6).alias("macro_f1"))


def polarity_confusion(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Matched aspects by gold and predicted polarity."""
    k = ["review_id", "category"]
    return pred.select(*k, F.col("polarity").alias("predicted")).distinct().join(gold.select(*k, F.col("polarity").alias("gold")).distinct(), k).groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def unsupported_numbers(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Numbers in prose that no supporting value gives at 0 to 3 decimals: (answer_id, number).

    ``answers`` has answer_id and prose; ``facts`` answer_id and value.
    """
    n = answers.select("answer_id", F.explode(F.regexp_extract_all("prose", F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))).alias("raw"))
    n = n.select("answer_id", F.regexp_replace("raw", ",", "").cast("decimal(30,6)").alias("number")).distinct()
    v = facts.select("answer_id", F.explode(F.array(*[F.round(F.col("value").cast("decimal(30,6)"), d).cast("decimal(30,6)") for d in range(4)])).alias("number")).distinct()
    return n.join(v, ["answer_id", "number"], "left_anti")


def aspect_counts(aspects: DataFrame, top: int = 60) -> DataFrame:
    """Counts by category and polarity with the severe and moderate ones."""
    a = aspects.groupBy("category", "polarity").agg(F.count("*").alias("aspects"), F.countDistinct("review_id").alias("reviews"), F.count_if(F.col("severity") == "severe").alias("severe"), F.count_if(F.col("severity") == "moderate").alias("moderate"))
    return a.orderBy(F.desc("aspects"), "category", "polarity").limit(top)


def buried_summary(buried: DataFrame, reviews: DataFrame, half_stars: int = 8) -> DataFrame:
    """Aspects and reviews among buried complaints, their mean rating and their share of well-rated reviews."""
    b = buried.agg(F.count("*").alias("aspects"), F.countDistinct("review_id").alias("reviews"), F.round(F.avg("half_stars") / 2, 4).alias("mean_rating"))
    g = reviews.where(F.col("half_stars") >= half_stars).agg(F.count("*").alias("rated_well"))
    order = Window.orderBy(F.desc("n"), "category")
    top = buried.groupBy("category").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where("r <= 3").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "category"))), lambda x: x["category"]), ",").alias("top_categories"))
    return b.crossJoin(g).crossJoin(top).withColumn("share_pct", F.round(100 * F.col("reviews") / F.nullif(F.col("rated_well"), F.lit(0)), 4))
