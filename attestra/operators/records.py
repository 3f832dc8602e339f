"""Joins that must match, rosters of several hosts, checks of a frame table and of a release, reliability tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.quality_rules import all_issues, issues

#: Answers about a feature, and names of frames (fixed values).
PRESENCE = ("yes", "no", "uncertain")
FRAME_NAME = r"^img_(\d{6,})\.jpg$"


def _must(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    return rows.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def _named(what: str, keys: list[str]) -> Column:
    return F.concat(F.lit(f"{what}: "), F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]))


def unique(rows: DataFrame, keys: list[str], what: str = "repeated key") -> DataFrame:
    """rows; a key that occurs twice is an error when the plan runs. Keys are counted before they are shuffled."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(_must(counts, F.col("_n") > 1, _named(what, keys)).select(*keys), keys, "left_semi")


def attach(left: DataFrame, right: DataFrame, keys: list[str], unmatched: str = "raise", one_to_one: bool = False) -> DataFrame:
    """left with the columns of right. right has one row a key, left too if one_to_one; a left row without a partner is an
    error when the plan runs, or goes (unmatched='drop'), or stays with NULLs ('keep'). A column of both is named
    with _truth where it comes from right. NULL keys match nothing."""
    if unmatched not in ("raise", "drop", "keep"):
        raise ValueError(unmatched)
    renamed = {c: f"{c}_truth" for c in right.columns if c not in keys and c in left.columns}
    right = unique(right, keys).withColumnsRenamed(renamed).withColumn("_met", F.lit(True))
    joined = (unique(left, keys) if one_to_one else left).join(right, keys, "inner" if unmatched == "drop" else "left")
    if unmatched == "raise":
        joined = _must(joined, F.col("_met").isNull(), _named("no partner", keys))
    return joined.drop("_met")


def metadata(index: DataFrame, manifest: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows with their manifest and quality records, both of which must be there."""
    return attach(attach(index, manifest, keys), quality, keys)


def merged_roster(models: DataFrame, key: str, index: str) -> DataFrame:
    """One row per model of several hosts' rosters. Two declarations of a model, or two data sets' digests, are errors."""
    entry = [c for c in models.columns if c != index]
    digest = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in entry]), 256)
    each = models.groupBy(key).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b"), *[F.min(c).alias(c) for c in entry if c != key])
    sets = models.agg(F.min(index).alias(index), F.max(index).alias("_last"))
    sets = _must(sets, F.col(index) != F.col("_last"), F.lit("hosts ran against different data sets")).drop("_last")
    return _must(each, F.col("_a") != F.col("_b"), _named("declared differently", [key])).drop("_a", "_b").crossJoin(F.broadcast(sets))  # one row


def reliability(rows: DataFrame, confidence: Column, correct: Column, bins: int, *by: str) -> DataFrame:
    """Every bin of confidence: lower, upper, n, mean_confidence and accuracy, the last two NULL where it is empty. Bins
    are closed on the right, and 0 is in the first."""
    at = F.greatest(F.lit(0), F.least(F.ceil(confidence * bins) - 1, F.lit(bins - 1))).cast("int")
    met = rows.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))
    all_bins = (rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = all_bins.join(met.where("bin is not null"), [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("bin") / float(bins)).alias("lower"), ((F.col("bin") + 1) / float(bins)).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def nearest_coverage(curve: DataFrame, value: str, target: float, *by: str) -> DataFrame:
    """The value of each curve's point whose coverage is nearest to target; of equally near ones the first step."""
    best = F.min_by(value, F.struct(F.abs(F.col("coverage") - target), F.col("step")))
    return curve.groupBy(*by).agg(best.alias(value))


def frame_issues(frames: DataFrame, phases: list[str], features: list[str], files: DataFrame | None = None, manifest: dict | None = None, grid: int = 4) -> DataFrame:
    """Faults of a table of frames as rows (code, severity, artifact); all are errors.

    frames: image, elapsed_s, phase, lat, lon, segment_id, split, cover, reliable (boolean), cells (array or NULL), a column
    for each feature, and if blocks are to be checked spatial_block. files: (kind, name) with kind image or mask, if
    files are to be looked for. Faults of a row name its image and are found in one pass; faults of the whole table
    have no artifact, and are one each. Values that are NULL where one is needed are faults.
    """
    needed = {"image", "elapsed_s", "phase", "lat", "lon", "segment_id", "split", "cover", "reliable", "cells", *features}
    spark = frames.sparkSession
    one = lambda code, text=None: spark.createDataFrame([(code, "error", text)], "code string, severity string, artifact string")
    if missing := sorted(needed - set(frames.columns)):
        return one("missing_columns", ", ".join(missing))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    second = F.regexp_extract(F.coalesce("image", F.lit("")), FRAME_NAME, 1)
    reliable, held = F.coalesce("reliable", F.lit(False)), F.col("cells").isNotNull()
    inside = F.array(*[F.lit(f"{r},{c}") for r in range(grid) for c in range(grid)])
    rules = {
        "image_second_mismatch": no((second != "") & (second.cast("long") == F.col("elapsed_s"))),
        "unscored_phase": no(F.col("phase").isin(*phases)),
        "invalid_coordinate": no(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)),
        "zero_gps": F.coalesce((F.col("lat") == 0) | (F.col("lon") == 0), F.lit(False)),
        "invalid_cover": no(F.col("cover").between(0, 1)),
        "missing_grid": reliable & ~held,
        "unreliable_grid": ~reliable & held,
        "invalid_grid": held & F.coalesce((F.size(F.array_except("cells", inside)) > 0) | (F.size(F.array_distinct("cells")) < F.size("cells")), F.lit(True)),
    }
    codes = [F.when(c, F.lit(n)) for n, c in rules.items()] + [F.when(no(F.col(f).isin(*PRESENCE)), F.lit("invalid_presence")) for f in features]
    found = [frames.select(F.explode(F.array_compact(F.array(*codes))).alias("code"), F.lit("error").alias("severity"), F.col("image").alias("artifact"))]
    whole = lambda rows, code: rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("artifact"))
    twice = lambda c: frames.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found += [whole(twice("image"), "duplicate_image"), whole(twice("elapsed_s"), "duplicate_second")]
    split = lambda c: frames.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    found += [whole(split(c), code) for c, code in (("spatial_block", "spatial_leakage"), ("segment_id", "segment_leakage")) if c in frames.columns]
    if files is not None:
        names = frames.select("image", F.regexp_replace("image", r"\.[^.]*$", ".png").alias("mask"))
        for kind, column in (("image", "image"), ("mask", "mask")):
            there = files.where(F.col("kind") == kind).select(F.col("name").alias(column))
            found.append(issues(names.join(there, column, "left_anti"), f"missing_{kind}_file", "error", F.col("image")))
    if manifest is None:
        found.append(one("missing_manifest"))
    elif not all(re.fullmatch(r"-?\d+", str(manifest.get(k))) for k in ("n_frames", "effective_segment_count")):
        found.append(one("invalid_manifest"))
    else:
        n = frames.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("segment_id").alias("s"))
        found += [whole(n.where(F.col(c) != int(manifest[k])), code) for c, k, code in (("n", "n_frames", "manifest_count"), ("s", "effective_segment_count", "manifest_segments"))]
    return all_issues(*found)


def release_faults(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, fault) where a release's list (path, sha256, size_bytes) and its files differ: missing, untracked, unsafe_path
    for a path that leaves the folder, changed for another digest or size."""
    a, b = listed.select("path", F.struct("sha256", "size_bytes").alias("a")), actual.select("path", F.struct("sha256", "size_bytes").alias("b"))
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    fault = F.when(F.col("a").isNull(), "untracked").when(unsafe, "unsafe_path").when(F.col("b").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", fault.alias("fault")).where("fault is not null")


def may_be_released(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """rows of keys all of whose sources may be redistributed; one that may not, or a key without sources, is an error."""
    held = sources.groupBy(key).agg(F.count(F.when(F.coalesce(F.col("redistribution"), F.lit("")) != "allowed", 1)).alias("_blocked"))
    joined = rows.join(held, key, "left")
    return _must(joined, F.coalesce("_blocked", F.lit(1)) > 0, _named("may not be redistributed", [key])).drop("_blocked")


def price_pilot(calls: DataFrame, model: str) -> DataFrame:
    """What a trial run cost, by model."""
    return calls.groupBy(F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("format_failure"), 1)).alias("format_failures"), F.avg(F.col("format_failure").cast("double")).alias("format_failure_rate"),
        F.avg("input_tokens").alias("mean_input_tokens"), F.avg("output_tokens").alias("mean_output_tokens"), F.max("input_tokens").alias("max_input_tokens"),
        F.avg("cost_usd").alias("usd_per_call"), F.sum("cost_usd").alias("usd_total"), F.percentile("latency_s", 0.5).alias("median_latency_s"), (F.avg("input_tokens") > 0).alias("tokens_reported"),
    )
