"""Streams: idempotent ingest of request logs, gap sessions, and thinning with state kept by track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def once_each(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten once they are `late`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def gap_sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key that end after a gap: begin, end, rows."""
    s = F.session_window(F.col(at), gap)
    out = stream.withWatermark(at, late).groupBy(F.col(key), s.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def thin_stream(stream: DataFrame, track: str, clock: str, lat: str, lon: str, distance_m: float = 500, min_interval: int = 60) -> DataFrame:
    """(track, clock, reason) of rows kept by distance from the last one kept, which is each track's state. Rows of a
    batch are taken in clock order; rows at or before the last one kept are skipped."""
    from attestra.operators.trajectory import _metres

    types = dict(stream.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(clock, kind="stable")
        for t, y, x in zip(rows[clock], rows[lat], rows[lon]):
            if last is None:
                reason = "first"
            elif t - last[0] < min_interval or _metres(last[1], last[2], y, x) < distance_m:
                continue
            else:
                reason = "distance"
            last = (int(t), float(y), float(x))
            out.append((*key, t, reason))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[track, clock, "reason"])

    return stream.select(track, clock, lat, lon).groupBy(track).applyInPandasWithState(step, f"{track} {types[track]}, {clock} {types[clock]}, reason string", "t long, y double, x double", "append", GroupStateTimeout.NoTimeout)
