"""Scores of structured probes: presence, amounts, grounding, false premises, calibration, agreement, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import scalars as S


def presence(rows: DataFrame, features: list[str]) -> DataFrame:
    """By feature, of columns truth_<f> and answer_<f>: counts, rates, precision, recall, f1. Only yes and no are
    scored; another answer is invalid."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"truth_{f}").alias("t"), F.col(f"answer_{f}").alias("a")) for f in features])).alias("x")).select("x.*")
    scorable, valid = F.col("t").isin("yes", "no"), F.col("t").isin("yes", "no") & F.col("a").isin("yes", "no")
    n = lambda c: F.count(F.when(c, 1))
    yes = lambda t, a: n(valid & (F.col("t") == t) & (F.col("a") == a))
    out = stacked.groupBy("feature").agg(
        yes("yes", "yes").alias("tp"), yes("no", "yes").alias("fp"), yes("no", "no").alias("tn"), yes("yes", "no").alias("fn"),
        n(scorable).alias("n"), n(valid).alias("n_valid"), n(scorable & (F.col("t") == F.col("a"))).alias("exact"),
    )
    p, r = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": p, "recall": r}).withColumn("f1", S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumns({
        "invalid_rate": S.ratio(F.col("n") - F.col("n_valid"), F.col("n")), "exact_accuracy": S.ratio(F.col("exact"), F.col("n")),
        "false_positive_rate": S.ratio(F.col("fp"), F.col("fp") + F.col("tn")),
    }).drop("exact")


def amounts(rows: DataFrame, answer: Column, truth: Column, *by: str) -> DataFrame:
    """Errors of stated percentages: n, n_valid, invalid_rate, signed_error, mae, overestimation_rate."""
    e = answer - truth
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(e).alias("n_valid"), (1 - F.count(e) / F.count(F.lit(1))).alias("invalid_rate"),
        F.avg(e).alias("signed_error"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(e > 0, 1.0).when(e.isNotNull(), 0.0)).alias("overestimation_rate"),
    )


def point_cell(x: Column, y: Column, grid: int = 4) -> Column:
    """Cell of a point given as shares of width and height, row first."""
    at = lambda v: F.least(F.floor(v * grid), F.lit(grid - 1)).cast("string")
    return F.concat_ws(",", at(y), at(x))


def grounding(rows: DataFrame, truth: str, cells: str, points: str, valid: Column, *by: str) -> DataFrame:
    """Pooled cell precision, recall and f1, and precision and recall of points; cells and points are arrays."""
    none = F.array().cast("array<string>")
    r = rows.withColumns({"_v": valid, "_t": F.array_distinct(F.coalesce(F.col(truth), none))})
    r = r.withColumns({"_c": F.when(F.col("_v"), F.array_distinct(F.col(cells))).otherwise(none), "_p": F.when(F.col("_v"), F.col(points)).otherwise(none)})
    hit = F.size(F.array_intersect("_c", "_t"))
    out = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_v"), 0.0).otherwise(1.0)).alias("invalid_rate"),
        F.sum(hit).alias("tp"), F.sum(F.size("_c") - hit).alias("fp"), F.sum(F.size("_t") - hit).alias("fn"),
        F.sum(F.size("_p")).alias("points"), F.sum(F.size(F.filter("_p", lambda c: F.array_contains(F.col("_t"), c)))).alias("hits"),
        F.sum(F.size(F.array_intersect("_p", "_t"))).alias("pointed"), F.sum(F.size("_t")).alias("truth_cells"),
    )
    p, q = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"region_precision": p, "region_recall": q, "point_precision": S.ratio(F.col("hits"), F.col("points")), "point_cell_recall": S.ratio(F.col("pointed"), F.col("truth_cells"))})
    out = out.withColumn("region_f1", S.ratio(2 * F.col("region_precision") * F.col("region_recall"), F.col("region_precision") + F.col("region_recall")))
    return out.select(*by, "n", "invalid_rate", "region_precision", "region_recall", "region_f1", "point_precision", "point_cell_recall")


def false_premise(rows: DataFrame, variant: str, complied: Column) -> DataFrame:
    """Compliance by variant, and on each row the difference of leading and evidence-first prompts."""
    out = rows.groupBy(F.col(variant).alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.count(complied).alias("n_valid"), F.avg(complied.cast("double")).alias("compliance_rate"))
    one = lambda v: F.max(F.when(F.col("variant") == v, F.col("compliance_rate")))
    return out.crossJoin(F.broadcast(out.agg((one("leading") - one("evidence_first")).alias("mitigation_delta"))))  # a row of one


def calibration(rows: DataFrame, confidence: Column, correct: Column, bins: int, *by: str) -> DataFrame:
    """Expected calibration error over equal bins closed on the right; 0 is in the first."""
    b = F.greatest(F.lit(0), F.least(F.ceil(confidence * bins) - 1, F.lit(bins - 1)))
    each = rows.groupBy(*by, b.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(correct.cast("double")).alias("a"))
    return each.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins_used"))


def cohen_kappa(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Agreement of two raters beyond chance; where chance agreement is whole, 1 if they agree wholly, else 0."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col(a).alias("v")).agg(F.sum("n").alias("x"))
    right = cells.groupBy(*by, F.col(b).alias("v")).agg(F.sum("n").alias("y"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("chance"))
    out = total.join(chance, list(by), "left") if by else total.crossJoin(chance)
    po, pe = F.col("same") / F.col("total"), F.coalesce(F.col("chance"), F.lit(0)) / (F.col("total") * F.col("total"))
    return out.select(*by, F.col("total").alias("n"), po.alias("observed"), F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def majority(rows: DataFrame, key: str, vote: str, tie: str = "uncertain") -> DataFrame:
    """Most frequent vote by key; a tie for first is `tie`."""
    counts = rows.groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max("n").alias("top"))
    top = counts.join(best, key).where("n = top").groupBy(key).agg(F.count(F.lit(1)).alias("ties"), F.min(vote).alias("v"))
    return top.select(key, F.when(F.col("ties") > 1, tie).otherwise(F.col("v")).alias("vote"))


#: Words before a term that weaken or deny it (fixed values).
HEDGES = ("possible", "possibly", "perhaps", "maybe", "may", "might", "appear", "appears", "likely")
NEGATIONS = ("no", "not", "without", "absent", "lack", "lacks", "neither", "nor")


def caption_assertions(rows: DataFrame, text: str, terms: dict[str, list[str]]) -> DataFrame:
    """What a caption says of each feature: yes, no or hedged; no where it isn't named, or there is no caption.

    The five words before a sentence's first term of a feature decide, a hedge before a negation; of several
    sentences that name the feature the last one stands.
    """
    sentences = rows.withColumn("_s", F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?<=[.!?;])\s+|\n+"))
    out = []
    for feature, words in terms.items():
        said = F.transform("_s", _stance(rf"\b(?:{'|'.join(words)})s?\b"))
        out.append(F.coalesce(F.try_element_at(F.array_compact(said), F.lit(-1)), F.lit("no")).alias(feature))
    return sentences.select("*", *out).drop("_s")


def _stance(pattern: str):
    """A sentence's word on what the pattern names, NULL if it doesn't name it."""

    def said(s: Column) -> Column:
        at = F.regexp_instr(s, F.lit(pattern))
        before = F.filter(F.split(F.substring(s, F.lit(1), at - 1), r"\s+"), lambda w: w != "")
        near = F.transform(F.slice(before, F.greatest(F.size(before) - 4, F.lit(1)), F.lit(5)), lambda w: F.regexp_replace(w, r"\W", ""))
        has = lambda ws: F.exists(near, lambda w: w.isin(*ws))
        return F.when(at > 0, F.when(has(HEDGES), "hedged").when(has(NEGATIONS), "no").otherwise("yes"))

    return said
