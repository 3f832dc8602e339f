"""Readers and writers. Schemas are given, never inferred, and what doesn't fit is an error when the plan runs."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Telemetry columns and the header names they go by, in order of preference (fixed values).
TELEMETRY_NAMES = {
    "phase": ("flightphase", "phase"),
    "elapsed_s": ("elapsedtime", "elapsed", "second", "seconds"),
    "packets": ("packets", "packet"),
    "time": ("worldviewtime", "wvtime", "time", "timestamp"),
    "lat": ("worldviewlatitude", "wvlatitude", "latitude", "lat"),
    "lon": ("worldviewlongitude", "wvlongitude", "longitude", "lon", "long"),
    "alt_m": ("worldviewaltitude", "wvaltitude", "altitude", "altitudem", "altm"),
    "speed": ("wvspeed", "speed"),
    "heading": ("wvheading", "heading"),
    "velocity_down": ("wvvelocitydown", "velocitydown", "veldown"),
    "pressure": ("wvpressure", "pressure"),
    "temperature": ("wvtemperature", "temperature", "temp"),
    "violet": ("violet",),
    "blue": ("blue",),
    "green": ("green",),
    "yellow": ("yellow",),
    "orange": ("orange",),
    "red": ("red",),
}
#: Columns a log must have, and lines within which its header stands (fixed values).
REQUIRED = ("phase", "elapsed_s", "lat", "lon", "alt_m")
HEADER_WITHIN = 200


def json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped. strict: a key that the schema lacks is an error that names the file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    if strict:
        extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in schema.fieldNames()]))
        bad = F.json_object_keys("value").isNull() | (F.size(extra) > 0)
        raw = raw.where(F.when(bad, F.raise_error(F.concat(F.lit("not a record of this schema: "), F.col("_file"))).cast("boolean")).otherwise(F.lit(True)))
    return raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Keys in sorted order; the folder appears when all of it is written."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def normal_header(name: str) -> str:
    return "".join(c for c in name.strip().lower() if c.isascii() and (c.isalpha() or c.isdigit()))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """A telemetry log: preamble, a header within 200 lines, then rows; later headers are dropped as their clock is
    no number. Columns get their canonical names; numbers that aren't are NULL; `seq` is the place in the file.

    The header alone is read by the driver; rows are split where they are read.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    head = lines.orderBy("seq").limit(HEADER_WITHIN + 1).collect()
    found = next((r for r in head if {"elapsedtime", "flightphase"} <= {normal_header(x) for x in _cells(r["value"])}), None)
    if found is None:
        raise ValueError(f"no telemetry header in {path}")
    names = [normal_header(x) for x in _cells(found["value"])]
    mark = _delimiter(found["value"])
    places = {target: next(names.index(a) for a in aliases if a in names) for target, aliases in TELEMETRY_NAMES.items() if any(a in names for a in aliases)}
    missing = [c for c in REQUIRED if c not in places]
    if missing:
        raise ValueError(f"telemetry without {missing}")
    cells = lines.where(F.col("seq") > found["seq"]).select("seq", F.from_csv("value", ", ".join(f"c{k} string" for k in range(len(names))), {"sep": mark}).alias("c"))
    text = ("phase", "time")
    cols = [F.col(f"c.c{k}").alias(n) if n in text else F.trim(F.col(f"c.c{k}")).try_cast("double").alias(n) for n, k in places.items()]
    return cells.select("seq", *cols).where("elapsed_s is not null")


def _delimiter(line: str) -> str:
    return max(",\t;|", key=line.count)


def _cells(line: str) -> list[str]:
    return next(csv.reader([line], delimiter=_delimiter(line)), [])


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, elapsed_s) of image files img_<second>.jpg in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.select("path", F.regexp_extract("path", r"img_(\d{6,})\.jpg$", 1).alias("s")).where("s <> ''").select("path", F.col("s").cast("long").alias("elapsed_s"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def control_points(spark: SparkSession, path: str) -> DataFrame:
    """Enabled control points: point, map_x, map_y, image_x, image_y, role. Lines that begin with # are comments.

    Without a role column the last two are holdouts and the rest are fitted, and fewer than six are an error; other
    roles than fit and holdout, missing columns and coordinates that are no number are errors too.
    """
    from pyspark.sql import Window

    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    alias = {"mapx": "map_x", "mapy": "map_y", "imagex": "image_x", "imagey": "image_y", "sourcex": "image_x", "pixelx": "image_x", "sourcey": "image_y", "pixely": "image_y"}
    rows = rows.toDF(*[alias.get(normal_header(c), c.strip().lower()) for c in rows.columns]).withColumn("point", F.monotonically_increasing_id())
    places = ("map_x", "map_y", "image_x", "image_y")
    if missing := [c for c in places if c not in rows.columns]:
        raise ValueError(f"control points without {missing} in {path}")
    if "enable" in rows.columns:
        rows = rows.where(F.lower(F.trim("enable")).isin("1", "true"))
    if "role" not in rows.columns:
        if rows.count() < 6:
            raise ValueError(f"fewer than six enabled control points in {path}")
        last = F.row_number().over(Window.orderBy(F.desc("point")))  # a hand-made list of points
        rows = rows.withColumn("role", F.when(last <= 2, "holdout").otherwise("fit"))
    elif unknown := [r[0] for r in rows.where("role is null or role not in ('fit', 'holdout')").select("role").distinct().collect()]:
        raise ValueError(f"unknown control-point roles {unknown} in {path}")
    return rows.select("point", *[F.col(c).cast("double").alias(c) for c in places], "role")
