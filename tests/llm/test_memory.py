"""Python workers get small batches while scratch tables are made."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import common

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(spark):
    """Rows and bytes of each batch in which 30 MB of text reach a worker."""

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    texts = spark.range(0, 6_000, numPartitions=1).select(F.repeat(F.concat(F.lit("word "), "id"), 1_000).alias("text"))
    return texts.mapInArrow(work, "n long, size long")


def test_workers_get_small_batches(spark, ws):
    before = spark.conf.get(LIMIT)
    n, largest = ws.save(_sizes(spark), "sizes").agg(F.sum("n"), F.max("size")).first()
    assert n == 6_000 and largest <= 2 * common.BATCH_BYTES
    assert spark.conf.get(LIMIT) == before


def test_limit_of_the_session_comes_back_and_a_lower_one_holds(spark, ws):
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "256k")
        _, largest = ws.save(_sizes(spark), "sizes").agg(F.sum("n"), F.max("size")).first()
        assert largest <= 1 << 19
        with pytest.raises(Exception, match="boom"):
            ws.save(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")), "fails")
        assert spark.conf.get(LIMIT) == "256k"
    finally:
        spark.conf.set(LIMIT, before)


def test_what_a_stage_returns_is_written_in_small_batches(spark):
    before = spark.conf.get(LIMIT)
    try:
        ws = corpus_pipeline._scratch(spark, 0, "test")
        n, largest = _sizes(spark).agg(F.sum("n"), F.max("size")).first()
        assert n == 6_000 and largest <= 2 * common.BATCH_BYTES
        ws.delete()
    finally:
        spark.conf.set(LIMIT, before)
