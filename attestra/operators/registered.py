"""Comparisons fixed in advance: paired contrasts, endpoints of every two models, policies against direct answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import extras, inference, scoring

#: A contrast by name: what is compared, the rows of the first condition and those of the second.
Contrasts = dict[str, tuple[Column, Column, Column]]


def contrasts(frame: DataFrame, site: str, model: str, wanted: Contrasts) -> DataFrame:
    """By (contrast, model), and with model NULL over all: n_sites, mean_difference of the first condition less the
    second, standard_error, t and p of a paired test over site means.

    A row may be in several contrasts, and in both conditions of one. All contrasts are one pass: rows become sums by
    (contrast, condition, model, site) before anything is shuffled. Values that aren't finite are left out; a site
    without both conditions drops out, and fewer than two sites or no spread give NULLs. A row without a model counts
    only over all of them.
    """
    parts = [F.when(rows, F.struct(F.lit(name).alias("contrast"), F.lit(k).alias("side"), S.finite(value.cast("double")).alias("x"))) for name, (value, *sides) in wanted.items() for k, rows in enumerate(sides)]
    long = frame.select(F.col(model).alias("model"), F.col(site).alias("site"), F.explode(F.array_compact(F.array(*parts))).alias("r")).select("model", "site", "r.*").where("x is not null")
    sums = long.groupBy("contrast", "model", "site", "side").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    scopes = F.when(F.col("model").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("x"))) / F.sum(F.when(F.col("side") == k, F.col("n")))
    each = sums.withColumn("pooled", F.explode(scopes)).withColumn("model", F.when(~F.col("pooled"), F.col("model"))).groupBy("contrast", "pooled", "model", "site").agg((side(0) - side(1)).alias("d"))
    n, spread = F.count("d"), F.stddev_samp("d")
    out = each.where("d is not null").groupBy("contrast", "pooled", "model").agg(n.alias("n_sites"), F.avg("d").alias("mean_difference"), F.when(n >= 2, spread / F.sqrt(n)).alias("standard_error"))
    return with_p(out.withColumn("t", F.when(F.col("standard_error") > 0, F.col("mean_difference") / F.col("standard_error")))).drop("pooled")


def with_p(rows: DataFrame) -> DataFrame:
    """Adds the two-sided p of t over n_sites. Rows are comparisons, of which there are few."""
    return rows.withColumn("p", inference.t_p_value(F.col("t"), (F.col("n_sites") - 1).cast("double")))


def endpoints(frame: DataFrame, keys: list[str]) -> DataFrame:
    """(model, site_id, endpoint, value): the false positive rate of clean screening, ocrs and efs. An endpoint that a
    site lacks has no row."""
    screening = frame.where("sequence = 'screening' and variant = 'clean' and not true_positive and predicted is not null")
    rates = screening.groupBy("model", "site_id").agg(F.avg("predicted").alias("value")).select("model", "site_id", F.lit("macro_fpr").alias("endpoint"), "value")
    areas = scoring.causal(frame, ["model", "site_id"], keys).select("model", "site_id", "ocrs", "efs")
    return rates.unionByName(areas.unpivot(["model", "site_id"], ["ocrs", "efs"], "endpoint", "value")).where("value is not null")


def endpoint_pairs(values: DataFrame) -> DataFrame:
    """Every two models on every endpoint over the sites both have, with p and, over the whole family, q."""
    named = values.select("endpoint", F.col("model"), F.struct("endpoint", "site_id").alias("unit"), "value")
    pairs = extras.model_pairs(named, "model", "unit", "value", by=F.col("s")["endpoint"].alias("endpoint"))
    return inference.benjamini_hochberg(with_p(pairs).withColumn("_f", F.lit(0)), "p", "_f").drop("_f")


def policy_against_direct(cases: DataFrame, decided: DataFrame, key: str, by: list[str]) -> DataFrame:
    """What a policy changes by group: rates before and after, their difference, coverage and calls.

    cases: (key, *by, label, answer); decided: (key, decision, calls_used). Cases without a decision are left out.
    """
    rows = cases.join(decided.select(key, "decision", "calls_used"), key)
    no, yes_ = ~F.col("label"), lambda c: F.col(c) == "yes"
    answered = lambda c: F.col(c).isin("yes", "no")
    rate = lambda c: S.ratio(F.count(F.when(no & yes_(c), 1)), F.count(F.when(no & answered(c), 1)))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate("answer").alias("direct_false_positive_rate"), rate("decision").alias("policy_false_positive_rate"),
        F.avg(answered("decision").cast("double")).alias("coverage"), F.avg("calls_used").alias("mean_calls"),
        F.avg((yes_("answer") == F.col("label")).cast("double") * answered("answer").cast("double")).alias("direct_strict_accuracy"),
        F.avg((yes_("decision") == F.col("label")).cast("double") * answered("decision").cast("double")).alias("policy_strict_accuracy"),
    )
    return out.withColumn("false_positive_rate_delta", F.col("policy_false_positive_rate") - F.col("direct_false_positive_rate"))
