"""Selective faithfulness, model pairs, operator agreement, suppression, prompts, spacing, natural order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import inference, scoring


def selective_causal(frame: DataFrame, by: str, keys: list[str], steps: int = 10) -> DataFrame:
    """The causal summary over the most confident tenths of screened keys that were also edited. A key counts with
    its highest confidence; equal ones go by key."""
    edited = frame.where(F.col("sequence").isin(*scoring.DELETIONS)).select(by, *keys).distinct()
    screened = frame.where("sequence = 'screening' and variant = 'clean' and confidence is not null").groupBy(by, *keys).agg(F.max("confidence").alias("c"))
    ranked = screened.join(edited, [by, *keys], "left_semi")
    ranked = scoring.numbered(ranked, [by], F.desc("c"), "c", [F.col(k) for k in keys])
    ranked = ranked.join(F.broadcast(ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"))), by)  # one row a group
    size = lambda k: F.greatest(F.lit(1), F.bround(F.col("n") * k / float(steps)))
    chosen = ranked.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).where(F.col("rn") <= size(F.col("step")))
    coverage = chosen.groupBy(by, "step").agg((F.count(F.lit(1)) / F.max("n")).alias("coverage"), F.min("c").cast("double").alias("confidence_threshold"))
    rows = frame.join(chosen.select(by, "step", *keys), [by, *keys])
    out = scoring.causal(rows, [by, "step"], keys)
    return out.join(coverage, [by, "step"]).select(by, "step", "coverage", "confidence_threshold", "ocrs", "sen", "ses", "efs", "osg")


def model_pairs(values: DataFrame, model: str, site: str, value: str, by: Column | None = None) -> DataFrame:
    """Paired t statistics of every two models over the sites both have; `by` groups them by a part of the site s."""
    one = values.select(F.col(model).alias("a"), F.col(site).alias("s"), F.col(value).alias("x"))
    two = values.select(F.col(model).alias("b"), F.col(site).alias("s"), F.col(value).alias("y"))
    keys = [F.col("a"), F.col("b"), *([] if by is None else [by])]
    d = one.join(two, "s").where("a < b and x is not null and y is not null").select(*keys, (F.col("x") - F.col("y")).alias("d"))
    names = [c for c in d.columns if c != "d"]
    out = d.groupBy(*names).agg(F.count("d").alias("n_sites"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"))
    return out.select(*names, "n_sites", "mean_difference", F.when((F.col("n_sites") >= 2) & (F.col("sd") > 0), F.col("mean_difference") / (F.col("sd") / F.sqrt("n_sites"))).alias("t"))


def operator_agreement(values: DataFrame, operator: str, unit: str, value: str) -> DataFrame:
    """Rank correlation of every two operators over the units both have."""
    one = values.select(F.col(operator).alias("a"), F.col(unit).alias("u"), F.col(value).alias("x"))
    two = values.select(F.col(operator).alias("b"), F.col(unit).alias("u"), F.col(value).alias("y"))
    return inference.spearman(one.join(two, "u").where("a < b"), "x", "y", "a", "b")


def suppression(frame: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Means and ROC areas before and after all evidence is removed. Negatives without an edit keep their first
    answer, positives without one are left out."""
    before = F.avg(F.when(F.col("sequence") == "screening", F.col("p_yes")))
    after = F.avg(F.when((F.col("sequence") == "oracle_deletion") & (F.col("fraction") == 1), F.col("p_yes")))
    each = frame.groupBy(by, *keys).agg(F.max("true_positive").alias("label"), before.alias("before"), after.alias("after")).where("before is not null")
    each = each.withColumn("after", F.when(~F.col("label"), F.coalesce("after", "before")).otherwise(F.col("after"))).where("after is not null")
    means = each.groupBy(by).agg(F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"))
    a, b = (inference.roc_auc(each, "label", c, by).select(by, F.col("auc").alias(f"auc_{c}")) for c in ("before", "after"))
    return means.join(a, by).join(b, by)


def parse_prompt(text: Column, classes: list[str]) -> dict[str, Column]:
    """The class a prompt names (NULL unless exactly one), its grid (the same number twice) and its cell limit."""
    low = F.lower(text)
    named = F.array_compact(F.array(*[F.when(F.regexp_like(low, F.lit(rf"\b{c}s?\b")), F.lit(c)) for c in classes]))
    grid = F.regexp_extract(low, r"\b(\d+)\s*x\s*\1\b", 1)
    limit = F.regexp_extract(low, r"\b(?:at most|up to)\s+(\d+)", 1)
    number = lambda c: F.when(c != "", c.cast("int"))
    return {"target_class": F.when(F.size(named) == 1, named[0]), "grid": number(grid), "max_cells": number(limit)}


def standardized_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest((F.abs(a) + F.abs(b)) / 2, F.lit(1e-6))


def natural_key(name: Column) -> Column:
    """Digits padded to twenty places, so that text order is the order of numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d+$")), F.lpad(p, 20, "0")).otherwise(p)), "")


def top_cells(values: Column, grid: int, k: int) -> Column:
    """Names of the k cells with the largest values, largest first, equal ones in order."""
    indexed = F.transform(values, lambda x, i: F.struct((-x.cast("double")).alias("x"), i.alias("i")))
    best = F.slice(F.array_sort(indexed), 1, k)
    return F.transform(best, lambda s: F.concat_ws(",", F.floor(s["i"] / grid).cast("string"), (s["i"] % grid).cast("string")))


def spaced(rows: DataFrame, group: str, key: str, lat: str, lon: str, metres: float, seed: int) -> DataFrame:
    """(group, key) of a maximal set of sites no two of which are nearer than `metres`, taken in hash order.

    Whether a site is taken depends on those taken before, so a group is one sequence; groups are regions that
    hold a bounded number of sites.
    """
    from attestra.operators.trajectory import _metres

    hashed = rows.select(group, key, lat, lon, F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256).alias("_h"))
    types = dict(rows.dtypes)

    def take(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple] = []
        for k, y, x in pdf.sort_values(["_h", key])[[key, lat, lon]].itertuples(index=False, name=None):
            if all(_metres(y, x, b, c) * S.RADIUS_SITES_M / S.RADIUS_TRACK_M >= metres for _, b, c in taken):
                taken.append((k, y, x))
        return pd.DataFrame([(*keys, t[0]) for t in taken], columns=[group, key])

    return hashed.groupBy(group).applyInPandas(take, f"{group} {types[group]}, {key} {types[key]}")
