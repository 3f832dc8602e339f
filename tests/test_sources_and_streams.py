"""Readers, kernels and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from attestra.functions import kernels as K
from attestra.sources import readers as R
from attestra.streaming import ingest

SCHEMA = StructType([StructField("id", LongType()), StructField("v", StringType())])


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n\n{"v": "y", "id": 2}\n')
    assert sorted(map(tuple, R.json_lines(spark, str(tmp_path), SCHEMA).collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "b.jsonl").write_text('{"id": 3, "extra": 1}\n')
    with pytest.raises(Exception, match="not a record"):
        R.json_lines(spark, str(tmp_path), SCHEMA).collect()
    (tmp_path / "b.jsonl").write_text('{"id": "three"}\n')
    with pytest.raises(Exception):
        R.json_lines(spark, str(tmp_path), SCHEMA).collect()


def test_json_round_trip(spark, tmp_path):
    R.write_json_lines(spark.createDataFrame([(1, "x")], SCHEMA).select("v", "id"), str(tmp_path / "out"))
    line = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert list(json.loads(line)) == ["id", "v"]
    (tmp_path / "doc.json").write_text('{\n "id": 5,\n "v": "z"\n}')
    assert tuple(R.json_document(spark, str(tmp_path / "doc.json"), SCHEMA).first()) == (5, "z")


def test_telemetry(spark, tmp_path):
    text = "Log of a flight\nmade today\nFlight Phase,Elapsed Time,Latitude,Longitude,Altitude,Temp\nGround,0,34.0,-110.0,100,x\nLaunching,1.5,34.1,-110.1,200,3\nFlight Phase,Elapsed Time,Latitude,Longitude,Altitude,Temp\nFloating,3,,-110.2,300\n"
    (tmp_path / "t.csv").write_text(text)
    rows = R.telemetry(spark, str(tmp_path / "t.csv")).orderBy("seq").collect()
    assert [(r.phase, r.elapsed_s, r.lat, r.temperature) for r in rows] == [("Ground", 0.0, 34.0, None), ("Launching", 1.5, 34.1, 3.0), ("Floating", 3.0, None, None)]
    (tmp_path / "u.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no telemetry header"):
        R.telemetry(spark, str(tmp_path / "u.csv"))


def test_files(spark, tmp_path):
    for n, data in (("img_000012.jpg", b"a"), ("img_12.jpg", b"b"), ("note.txt", b"c")):
        (tmp_path / n).write_bytes(data)
    assert [r.elapsed_s for r in R.frames(spark, str(tmp_path)).collect()] == [12]
    assert {r.size for r in R.inventory(spark, str(tmp_path)).collect()} == {1}
    points = tmp_path / "p.csv"
    points.write_text("#CRS: none\nmapX,mapY,sourceX,sourceY,enable\n" + "".join(f"{k},{k},{k},{k},{int(k != 1)}\n" for k in range(7)))
    roles = [(r.map_x, r.role) for r in R.control_points(spark, str(points)).orderBy("point").collect()]
    assert roles == [(k, "fit") for k in (0.0, 2.0, 3.0, 4.0)] + [(5.0, "holdout"), (6.0, "holdout")]
    points.write_text("image_x,image_y,map_x,map_y,role\n1,2,3,4,holdout\n5,6,7,8,fit\n")
    assert [tuple(r)[1:] for r in R.control_points(spark, str(points)).orderBy("point").collect()] == [(3.0, 4.0, 1.0, 2.0, "holdout"), (7.0, 8.0, 5.0, 6.0, "fit")]
    for wrong in ("image_x,image_y,map_x,map_y\n1,2,3,4\n", "image_x,image_y,map_x,map_y,role\n1,2,3,4,other\n", "image_x,image_y,map_x\n1,2,3\n"):
        points.write_text(wrong)
        with pytest.raises(ValueError):
            R.control_points(spark, str(points))


def test_quoted_cells_of_a_log(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text('preamble\n"Flight Phase",Elapsed Time,Latitude,Longitude,Altitude\n"climb, fast",1,2.5,3.5,"4"\n')
    assert [(r.phase, r.elapsed_s, r.lat, r.alt_m) for r in R.telemetry(spark, str(log)).collect()] == [("climb, fast", 1.0, 2.5, 4.0)]


def test_null_parts_of_a_request(spark):
    from pyspark.sql import functions as F

    from attestra.functions import scalars

    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert rows.select(scalars.request_id(F.col("x"), F.col("y"), F.col("z"))).distinct().count() == 2


def test_kernels(spark):
    mask = np.zeros((8, 8), bool)
    mask[0, :4] = mask[3:5, 3:5] = True
    assert K.overlap(mask, mask) == (1.0, 1.0) and K.overlap(mask & False, mask & False) == (1.0, 1.0)
    assert sorted(K.components(mask)) == [4, 4] and K.components(np.eye(3, dtype=bool)) == [1, 1, 1]
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    ring[2, 2] = True
    assert K.components(ring) == [16, 1]
    assert K.grid_cells(mask, 4, 0.01) == ["0,0", "0,1", "1,1", "1,2", "2,1", "2,2"]
    assert K.border_distances(mask) == (0.0, 3.0) and K.border_distances(mask & False) == (0.0, 0.0)
    rgb = np.array([[[0, 255, 0], [255, 0, 0], [10, 10, 20]]])
    assert K.visible_vegetation(rgb).tolist() == [[1.0, -1.0, 0.0]]
    index = K.visible_vegetation(rgb)
    assert K.best_threshold([index], [np.array([[True, False, False]])], np.array([-2.0, 0.0, 0.5])) == (0.0, 1.0)
    assert K.sharpness(np.full((4, 4), 9)) == 0 and K.exposure(np.full((4, 4), 255))["clipped_bright"] == 1
    rows = spark.createDataFrame([([1, 1, 0, 1], 2, 2), ([1], 2, 2), (None, 1, 1)], "p array<int>, h int, w int")
    got = rows.select(K.mask_udf(lambda m: len(K.components(m)), "int")("p", "h", "w")).collect()
    assert [r[0] for r in got] == [1, None, None]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"id": i % 3, "at": f"2024-01-01T00:{m:02d}:00Z"} for i, m in enumerate((0, 1, 2, 3, 20, 21))]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = StructType([StructField("id", LongType()), StructField("at", StringType())])

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    stream = ingest.log_stream(spark, str(src), schema).withColumn("at", F.to_timestamp("at"))
    assert sorted(r.id for r in run(ingest.once_each(stream, "id", "at"), "once")) == [0, 1, 2]
    got = run(ingest.gap_sessions(stream.withColumn("id", F.lit(1)), "id", "at", "5 minutes", "0 seconds"), "sessions")
    assert [r.n for r in got] in ([4], [4, 2])
    track = stream.select(F.lit(1).alias("track"), F.unix_seconds("at").alias("s"), (34 + F.col("id") / 10).alias("lat"), F.lit(-110.0).alias("lon"))
    assert len(run(ingest.thin_stream(track, "track", "s", "lat", "lon"), "thin")) == 6
