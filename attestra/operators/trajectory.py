"""Telemetry and frames along tracks: clock resets, phases, cleaning, timelines, thinning, segments, splits."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import scalars as S

PHASES = ("Launching", "Floating", "Terminating")


def canonical_phase(raw: Column) -> Column:
    """Trimmed; known phases in title case whatever their case, with either spelling of initializing."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("ground", "initializing", "launching", "floating", "terminating"), F.initcap(low)).when(low == "initialising", "Initializing").otherwise(F.trim(raw))


def reset_segments(rows: DataFrame, track: str, order: str, clock: str) -> DataFrame:
    """Adds segment_id, which goes up by one wherever the clock runs back."""
    w = Window.partitionBy(track).orderBy(order)
    rows = rows.withColumn("_back", F.when(F.col(clock) < F.lag(clock).over(w), 1).otherwise(0))
    return rows.withColumn("segment_id", F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_back")


def segment_audit(rows: DataFrame, track: str, order: str, clock: str, lat: str, lon: str) -> DataFrame:
    """By track and segment: rows, clock range, valid positions, whether the phases first appear in order, and
    whether it is the track's operational segment: of those in order the one with most rows, then the latest."""
    first = [F.min(F.when(F.col("phase") == p, F.col(order))) for p in PHASES]
    ordered = F.coalesce((first[0] <= first[1]) & (first[1] <= first[2]), F.lit(False))
    ok = F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(lat) != 0) & (F.col(lon) != 0)
    out = rows.groupBy(track, "segment_id").agg(F.count(F.lit(1)).alias("row_count"), F.min(clock).alias("start_s"), F.max(clock).alias("end_s"), F.count(F.when(ok, 1)).alias("valid_gps_rows"), ordered.alias("in_order"))
    best = F.max(F.when(F.col("in_order"), F.struct("row_count", "segment_id"))).over(Window.partitionBy(track))
    return out.withColumn("selected", F.coalesce(F.struct("row_count", "segment_id") == best, F.lit(False)) & F.col("in_order"))


def clean(rows: DataFrame, track: str, order: str, clock: str, lat: str, lon: str, channels: list[str]) -> DataFrame:
    """Rows with valid positions, one a second: clocks round halves to even, the last of a second stays. A channel
    that is 0 throughout while the track moves is dead and becomes NULL."""
    rows = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.col(lat) != 0) & (F.col(lon) != 0))
    w = Window.partitionBy(track)
    moves = (F.min(lat).over(w) < F.max(lat).over(w)) | (F.min(lon).over(w) < F.max(lon).over(w))
    dead = {c: F.when(moves & (F.min(c).over(w) == 0) & (F.max(c).over(w) == 0), None).otherwise(F.col(c)) for c in channels}
    rows = rows.withColumns(dead).withColumn(clock, F.bround(clock).cast("long"))
    return keep_last(rows, [track, clock], [order])


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, by an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def timeline(clips: DataFrame, track: str, order: list[str], duration: str) -> DataFrame:
    """Adds start_s and end_s of clips laid end to end."""
    w = Window.partitionBy(track).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return clips.withColumn("end_s", F.sum(duration).over(w)).withColumn("start_s", F.col("end_s") - F.col(duration))


def join_audit(left: DataFrame, right: DataFrame, key: list[str], *by: str) -> DataFrame:
    """How many left rows meet one right row, several, or none."""
    counts = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    met = left.join(counts, key, "left").withColumn("match", F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") == 1, "one").otherwise("many"))
    return met.groupBy(*by, "match").agg(F.count(F.lit(1)).alias("n"))


def exclusion_reason(**flags: Column) -> Column:
    """Names of the flags that hold, joined by +; NULL if none does."""
    return F.nullif(F.concat_ws("+", *[F.when(c, name) for name, c in flags.items()]), F.lit(""))


def _metres(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * S.RADIUS_TRACK_M * math.asin(math.sqrt(min(1.0, a)))


def thin(rows: DataFrame, track: str, clock: str, lat: str, lon: str, phash: str, distance_m: float = 500, hamming: int = 8, min_interval: int = 60, max_interval: int | None = None) -> DataFrame:
    """(track, clock, reason) of frames kept: the first, and each that is at least min_interval after the last one
    kept and has moved, changed or waited enough. What is kept depends on what was, so a track is one sequence;
    tracks are independent groups."""

    def one(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for row in pdf.sort_values(clock, kind="stable").itertuples(index=False):
            now = (getattr(row, clock), getattr(row, lat), getattr(row, lon), getattr(row, phash))
            if last is None:
                reason = "first"
            elif now[0] - last[0] < min_interval:
                continue
            else:
                tests = (("distance", _metres(last[1], last[2], now[1], now[2]) >= distance_m), ("perceptual", (int(last[3]) ^ int(now[3])).bit_count() > hamming), ("max_interval", max_interval is not None and now[0] - last[0] >= max_interval))
                reason = "+".join(name for name, ok in tests if ok)
            if reason:
                out.append((*keys, now[0], reason))
                last = now
        return pd.DataFrame(out, columns=[track, clock, "reason"])

    types = dict(rows.dtypes)
    return rows.select(track, clock, lat, lon, phash).groupBy(track).applyInPandas(one, f"{track} {types[track]}, {clock} {types[clock]}, reason string")


def segments(rows: DataFrame, track: str, clock: str, lat: str, lon: str, phase: str, max_gap: int = 600, max_jump_m: float = 10_000, max_duration: int | None = 600) -> DataFrame:
    """Adds segment_no: a new segment at a gap, a jump, a change of phase, or max_duration after a segment began.

    Gaps, jumps and phases are windows; only the duration rule depends on where a segment began, so it alone runs
    in Python, over those of the already cut pieces that last so long, each a group of its own.
    """
    w = Window.partitionBy(track).orderBy(clock)
    before = lambda c: F.lag(c).over(w)
    jump = S.haversine_m(before(lat), before(lon), F.col(lat), F.col(lon), S.RADIUS_TRACK_M) > max_jump_m
    cut = (F.col(clock) - before(clock) > max_gap) | jump | (F.col(phase) != before(phase))
    pieces = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("_piece", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if max_duration is not None:

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(clock, kind="stable")
            start, marks = None, []
            for t in pdf[clock]:
                over = start is not None and t - start >= max_duration
                if start is None or over:
                    start = t
                marks.append(int(over))
            return pdf.assign(_over=marks)

        whole = Window.partitionBy(track, "_piece")
        pieces = pieces.withColumn("_long", F.max(clock).over(whole) - F.min(clock).over(whole) >= max_duration)
        long = pieces.where("_long").drop("_long")
        keep = ", ".join(f"{c} {k}" for c, k in long.dtypes)
        short = pieces.where("not _long").drop("_long").withColumn("_over", F.lit(0))
        pieces = short.unionByName(long.groupBy(track, "_piece").applyInPandas(one, keep + ", _over int"))
    else:
        pieces = pieces.withColumn("_over", F.lit(0))
    step = F.sum(F.col("_cut") + F.col("_over")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("segment_no", step.cast("int")).drop("_cut", "_piece", "_over")


def geographic_splits(rows: DataFrame, track: str, clock: str, lat: str, lon: str, segment: str, block_m: float = 5_000, train: float = 0.7, validation: float = 0.15, seed: int = 2026) -> DataFrame:
    """Adds spatial_block, split (one for a whole block) and refined, segments cut where the split changes."""
    rows = rows.withColumn("spatial_block", S.spatial_block(F.col(lat), F.col(lon), block_m))
    rows = rows.withColumn("split", S.split_of(S.hash_fraction(seed, F.col("spatial_block")), train, validation))
    w = Window.partitionBy(track).orderBy(clock)
    change = (F.col(segment) != F.lag(segment).over(w)) | (F.col("split") != F.lag("split").over(w))
    rows = rows.withColumn("_c", F.coalesce(change, F.lit(False)).cast("int"))
    return rows.withColumn("refined", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_c")
