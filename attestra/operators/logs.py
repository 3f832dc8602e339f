"""Request logs: merging, resuming, content caches, budgets, call plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_report(rows: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """By key: copies, versions (distinct whole rows) and conflict (more than one version). Versions are told
    apart by a digest, so a key's rows never meet in one place as rows."""
    digest = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in payload]), 256)
    each = rows.groupBy(*key, digest.alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*key).agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("versions")).withColumn("conflict", F.col("versions") > 1)


def merge_logs(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key. Identical repeats go; two versions of a key are an error when the plan runs."""
    report = merge_report(rows, key, rows.columns)
    bad = F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("conflicting rows for "), F.concat_ws("/", *[F.col(k).cast("string") for k in key]))).cast("boolean")).otherwise(F.lit(True))
    return rows.dropDuplicates().join(report.where(bad).select(*key), key, "left_semi")


def resume(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned requests that aren't done."""
    return planned.join(done, key, "left_anti")


def cache_hits(rows: DataFrame, call_key: Column, order: list[str], valid: Column) -> DataFrame:
    """Adds cache_hit: an earlier valid row has the same call key. The first valid row of a key is found by an
    aggregate that is combined before the shuffle, so a key that many rows share loads no task."""
    rows = rows.withColumn("_key", call_key).withColumn("_at", F.struct(*order))
    first = rows.where(valid).groupBy("_key").agg(F.min("_at").alias("_first"))
    return rows.join(first, "_key", "left").withColumn("cache_hit", F.coalesce(F.col("_first") < F.col("_at"), F.lit(False))).drop("_key", "_at", "_first")


def running_total(rows: DataFrame, order: str, amount: Column, bucket: int, name: str = "running") -> DataFrame:
    """Sum of amounts up to each row in the order of a whole-numbered column.

    Rows are cut into buckets of the order's range; totals of buckets are summed over first, so that a window
    over all rows never has to be in one task.
    """
    rows = rows.withColumn("_b", F.floor(F.col(order) / bucket)).withColumn("_a", amount)
    totals = rows.groupBy("_b").agg(F.sum("_a").alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_a").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, "_b").withColumn(name, F.col("_before") + own).drop("_b", "_a", "_before")


def call_plan(rows: DataFrame, model: str, retries: int, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> DataFrame:
    """Calls of each model, at worst with every retry, and their cost."""
    from attestra.functions import scalars as S

    return rows.groupBy(F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) * (retries + 1)).alias("worst_calls"),
        F.sum(S.token_cost(tokens_in, tokens_out, F.lit(price_in), F.lit(price_out))).alias("likely_cost"),
        (F.sum(S.token_cost(tokens_in, tokens_out, F.lit(price_in), F.lit(price_out))) * (retries + 1)).alias("worst_cost"),
    )
