"""Audits, rule checks, releases and tidy tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_summary(votes: DataFrame, view: list[str], fields: list[str]) -> DataFrame:
    """By field: agreement of the two auditors of a view, share and number of true votes, views with any."""
    bools = [F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields]
    long = votes.select(*view, F.explode(F.array(*bools)).alias("x")).select(*view, "x.field", "x.v")
    each = long.groupBy("field", *view).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("v"), 1)).alias("k"))
    return each.groupBy("field").agg(
        F.count(F.lit(1)).alias("views"), F.sum("n").alias("votes"), F.avg(((F.col("k") == 0) | (F.col("k") == F.col("n"))).cast("double")).alias("agreement"),
        (F.sum("k") / F.sum("n")).alias("prevalence"), F.sum("k").alias("failure_votes"), F.count(F.when(F.col("k") > 0, 1)).alias("failure_views"),
    )


def band_validation(votes: DataFrame, views: DataFrame, view: list[str], case: str, seen: str) -> DataFrame:
    """By case: audited views, share in which nobody, and in which everybody, sees something; unmatched votes
    are a case of their own."""
    each = votes.groupBy(*view).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(seen), 1)).alias("k"))
    met = each.join(views.select(*view, F.col(case).alias("case_type")), view, "left")
    return met.groupBy(F.coalesce("case_type", F.lit("unmatched")).alias("case_type")).agg(
        F.count(F.lit(1)).alias("views"), F.avg((F.col("k") == 0).cast("double")).alias("confirmed"), F.avg((F.col("k") == F.col("n")).cast("double")).alias("contradicted"), (F.sum("k") / F.sum("n")).alias("seen_rate")
    )


def issues(rows: DataFrame, code: str, severity: str, artifact: Column) -> DataFrame:
    """Rows as issues of one rule."""
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), artifact.cast("string").alias("artifact"))


def all_issues(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def missing_combinations(present: DataFrame, keys: DataFrame, **axes: list) -> DataFrame:
    """Combinations of each key with the axes' values that aren't present."""
    wanted = keys.distinct()
    for name, values in axes.items():
        wanted = wanted.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return wanted.join(present.select(*wanted.columns).distinct(), wanted.columns, "left_anti")


def release(rows: DataFrame, allowed: Column, public: list[str], opaque: Column) -> tuple[DataFrame, DataFrame]:
    """What may be given out, and for the rest an escrow list of opaque ids and content hashes."""
    give = rows.where(allowed).select(*public)
    held = rows.where(~F.coalesce(allowed, F.lit(False))).select(F.sha2(opaque.cast("string"), 256).alias("opaque_id"), F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in public]), 256).alias("content_sha256"))
    return give, held


def tidy(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Wide measures as rows (keys, metric, value)."""
    return rows.unpivot([F.col(k) for k in keys], [F.col(v).cast("double").alias(v) for v in values], "metric", "value")


def quantile_bins(rows: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """Adds the number of the quantile bin a value is in, closed on the right, the least value in the first. Edges
    are n - 1 numbers, whatever the rows."""
    edges = rows.agg(F.percentile(value, F.array(*[F.lit(k / n) for k in range(1, n)])).alias("_e"))
    return rows.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter("_e", lambda e: F.col(value) > e)))).drop("_e")
