"""What ended steps leave in memory."""

import time

from pyspark.sql import functions as F

from attestra.llm import common


def test_broadcasts_of_ended_steps_go(spark, ws):
    """Row filters of some MB each: those of earlier steps aren't kept."""
    held = lambda: sum(x.memUsed() for x in spark.sparkContext._jsc.sc().env().blockManager().master().getStorageStatus())
    common.free_ended(spark)
    time.sleep(1)
    begun = held()
    rows = spark.range(400_000)
    for k in range(2 * common.FREE_AFTER):
        ws.save(common.flag_possible(rows, F.col("id") + k, rows, F.col("id")).where("_maybe").select("id"), f"step{k}")
        if k == 0:
            one = held() - begun
    for _ in range(20):  # they are freed soon, not at once
        time.sleep(0.2)
        if held() - begun <= one:
            break
    assert one > 1 << 20 and held() - begun <= one
