"""Scores of answers against truth: rates, localisation, response curves, causal summaries, selective risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import scalars as S

VIEW_KEYS = ["site_id", "view_id", "target_class"]
DELETIONS = ("oracle_deletion", "distractor_deletion", "self_deletion", "self_sufficiency", "random_control", "texture_control")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def performance_columns() -> list[Column]:
    """Fourteen measures as aggregates of one pass. Abstentions count in abstention_rate alone; balanced accuracy
    needs both truths; macro F1 averages the classes that occur in truth or prediction."""
    t, p = F.col("true_positive"), F.col("predicted")
    answered = p.isNotNull()
    tp, fn = _count(answered & t & (p == 1)), _count(answered & t & (p == 0))
    fp, tn = _count(answered & ~t & (p == 1)), _count(answered & ~t & (p == 0))
    pos, neg = tp + fn, fp + tn
    f1_pos, f1_neg = S.ratio(2 * tp, 2 * tp + fp + fn), S.ratio(2 * tn, 2 * tn + fp + fn)
    classes = F.when(tp + fp + fn > 0, 1).otherwise(0) + F.when(tn + fp + fn > 0, 1).otherwise(0)
    return [
        F.when((pos > 0) & (neg > 0), (tp / pos + tn / neg) / 2).alias("balanced_accuracy"),
        S.ratio(fp, neg).alias("false_positive_rate"),
        S.ratio(fn, pos).alias("false_negative_rate"),
        F.avg(F.when(answered, 0.0).otherwise(1.0)).alias("abstention_rate"),
        S.ratio(F.coalesce(f1_pos, F.lit(0.0)) + F.coalesce(f1_neg, F.lit(0.0)), classes).alias("macro_f1"),
        F.avg(F.col("format_failure").cast("double")).alias("format_failure_rate"),
        F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_rate"),
        F.sum("attempts").cast("long").alias("physical_attempts"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.percentile(F.when(~F.col("cache_hit"), F.col("latency_s")), 0.5).alias("median_latency_s"),
        F.count(F.lit(1)).alias("n_queries"),
        F.count_distinct("site_id").alias("n_sites"),
    ]


def performance(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(*performance_columns())


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(*[F.round(F.col(c), digits).alias(c) if k == "double" else F.col(c) for c, k in frame.dtypes])


def localisation(frame: DataFrame, predicted: str, truth: str, pixels: str, grid: int, width_px: int, height_px: int) -> DataFrame:
    """Adds eight measures of predicted against true cells. predicted, truth: arrays of "row,column"; pixels: map
    from cell to the target's pixels in it. Where nothing is predicted or true, agreeing on nothing counts as 1."""
    both = F.size(F.array_intersect(predicted, truth)).cast("double")
    n, m = F.size(F.array_distinct(predicted)).cast("double"), F.size(F.array_distinct(truth)).cast("double")
    union = F.size(F.array_union(predicted, truth)).cast("double")
    frame = frame.withColumns({
        "cell_precision": F.when(n > 0, both / n).otherwise(F.when(m == 0, 1.0).otherwise(0.0)),
        "cell_recall": F.when(m > 0, both / m).otherwise(F.when(n == 0, 1.0).otherwise(0.0)),
        "cell_iou": F.when(union > 0, both / union).otherwise(1.0),
        "cell_count": n,
    })
    p, r = F.col("cell_precision"), F.col("cell_recall")
    target = F.aggregate(F.map_values(F.col(pixels)), F.lit(0.0), lambda a, x: a + x)
    hit = F.aggregate(F.array_distinct(predicted), F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(F.col(pixels), c).cast("double"), F.lit(0.0)))
    area = lambda c: S.cell_area(F.split(c, ",")[0].cast("int"), F.split(c, ",")[1].cast("int"), grid, width_px, height_px)
    chosen = F.aggregate(F.array_distinct(predicted), F.lit(0.0), lambda a, c: a + area(c))
    frame = frame.withColumns({"cell_f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "_target": target, "_hit": hit, "_chosen": chosen})
    whole = F.col("_target") + F.col("_chosen") - F.col("_hit")
    return frame.withColumns({
        "mask_weighted_iou": F.when(whole > 0, F.col("_hit") / whole).otherwise(1.0),
        "evidence_coverage": F.when(F.col("_target") > 0, F.col("_hit") / F.col("_target")).otherwise(F.when(F.col("cell_count") == 0, 1.0).otherwise(0.0)),
        "area_penalized_f1": F.col("cell_f1") * F.greatest(F.lit(0.0), 1 - F.col("cell_count") / float(grid * grid)),
    }).drop("_target", "_hit", "_chosen")


def baselines(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Mean probability of clean, neutral screening rows by key."""
    rows = frame.where((F.col("sequence") == "screening") & (F.col("variant") == "clean") & F.lower("prompt_id").contains("neutral"))
    return rows.groupBy(*keys).agg(F.avg("p_yes").alias("baseline"))


def curve_areas(frame: DataFrame, base: DataFrame, keys: list[str], by: list[str], base_keys: list[str] | None = None) -> DataFrame:
    """Mean over keys of the area under each key's response curve, divided by its largest fraction, for groups `by`.

    A curve is the mean probability by fraction, started at fraction 0 by the key's baseline, which is averaged
    with a measured 0. Keys without a baseline, and curves of one point, are left out.
    """
    groups = [*by, *[k for k in keys if k not in by]]
    points = frame.groupBy(*groups, "fraction").agg(F.avg("p_yes").alias("p")).where("p is not null")
    points = points.join(base, base_keys or keys)
    start = points.groupBy(*groups).agg(F.first("baseline").alias("p")).select(*groups, F.lit(0.0).alias("fraction"), "p")
    curve = points.select(*groups, "fraction", "p").unionByName(start).groupBy(*groups, "fraction").agg(F.avg("p").alias("p"))
    # a curve has few points, so trapezoids are summed in an array rather than over another sort of all rows
    lists = curve.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("fraction", "p"))).alias("c")).where(F.size("c") >= 2)
    pairs = F.zip_with(F.slice("c", 2, F.size("c") - 1), F.slice("c", 1, F.size("c") - 1), lambda x, y: (x["fraction"] - y["fraction"]) * (x["p"] + y["p"]) / 2)
    area = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.element_at("c", -1)["fraction"]
    return lists.groupBy(*by).agg(F.avg(area).alias("auc"))


def causal(frame: DataFrame, by: list[str], keys: list[str] | None = None, base: DataFrame | None = None) -> DataFrame:
    """Areas of the six sequences by group, and what they sum up to: ocrs, sen, ses, efs, osg.

    efs is never missing: without sen or ses it is 0.
    """
    keys = keys or VIEW_KEYS
    all_keys = [*by, *keys]
    base = baselines(frame, all_keys) if base is None else base
    moved = frame.where(F.col("sequence").isin(*DELETIONS))
    areas = curve_areas(moved, base, all_keys, [*by, "sequence"], [k for k in base.columns if k != "baseline"])
    wide = areas.groupBy(*by).pivot("sequence", list(DELETIONS)).agg(F.first("auc"))
    kept = moved.where(F.col("sequence") == "self_sufficiency").join(base, [k for k in base.columns if k != "baseline"])
    ses = kept.groupBy(*by).agg(F.avg(1 - F.abs(F.col("p_yes") - F.col("baseline"))).alias("ses"))
    out = frame.select(*by).distinct().join(wide, by, "left").join(ses, by, "left")
    out = out.withColumn("ocrs", F.col("distractor_deletion") - F.col("oracle_deletion")).withColumn("sen", F.col("random_control") - F.col("self_deletion"))
    none = F.col("sen").isNull() | F.col("ses").isNull()
    out = out.withColumn("efs", F.when(none, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), "sen") * F.greatest(F.lit(0.0), "ses"))))
    return out.select(*by, *[F.col(s).alias(f"auc_{s}") for s in DELETIONS], "ocrs", "sen", "ses", "efs", (F.col("ocrs") - F.col("efs")).alias("osg"))


def numbered(rows: DataFrame, by: list[str], direction: Column, value: str, ties: list[Column], name: str = "rn") -> DataFrame:
    """Adds the number of each row in its group by value (in `direction`), equal values in the order of `ties`.

    Rows are counted by value first and counts are summed over values, so a task sorts rows of one value, not of a group.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*by, value, F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, value).orderBy(*ties))
    return rows.join(before, [*by, value]).withColumn(name, F.col("_before") + own).drop("_before")


def selective_risk(frame: DataFrame, by: list[str], order: list[Column], steps: int = 10) -> DataFrame:
    """Risk over the most confident tenths of answered rows. Sizes round halves to even, at least 1; coverage is
    of all rows. `order` breaks ties, so the result is the same on every run.

    Rows are counted by confidence and counts summed over its values; only the rows of a value in which a tenth ends
    are put in order.
    """
    wrong = ((F.col("predicted") == 1) != F.col("true_positive")).cast("long")
    neg = (~F.col("true_positive")).cast("long")
    answered = frame.where("predicted is not null and confidence is not null").withColumns({"_wrong": wrong, "_neg": neg, "_fp": neg * F.col("predicted").cast("long")})
    parts = ["_wrong", "_neg", "_fp"]
    cells = answered.groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in parts])
    down = Window.partitionBy(*by).orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "confidence", F.col("_n").alias("_size"), *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_before") for c in ["_n", *parts]])
    sizes = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("predicted").isNotNull() & F.col("confidence").isNotNull(), 1)).alias("n"))
    steps_ = sizes.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    steps_ = steps_.withColumn("rn", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("step") / float(steps)).cast("int")))
    cuts = cells.join(steps_, by).where("rn > _n_before and rn <= _n_before + _size")  # one row a step
    inside = answered.join(F.broadcast(cuts.select(*by, "confidence").distinct()), [*by, "confidence"])
    w = Window.partitionBy(*by, "confidence").orderBy(*order)
    run = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c)
    ranked = inside.select(*by, "confidence", F.row_number().over(w).alias("_at"), *[run(c) for c in parts])
    both = ranked.join(cuts, [*by, "confidence"]).where("_at = rn - _n_before")
    wrong, neg, fp = (F.col(c) + F.col(f"{c}_before") for c in parts)
    return both.select(
        *by, "step", (F.col("rn") / F.col("n_all")).alias("coverage"), (wrong / F.col("rn")).alias("selective_risk"),
        S.ratio(fp, neg).alias("selective_false_positive_rate"), F.col("confidence").cast("double").alias("confidence_threshold"),
    )
