"""Columns of a table that have the names used inside come back with their values and types."""

import corpus_pipeline
from attestra.llm import near_dedup, substring_dedup
from attestra.llm.exact_dedup import ExactDedup

NAMES = ("id", "h", "sha", "maybe", "kid", "kh", "ksha", "spans", "row", "held", "at")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"__att_{n} string, __att_{n}_ string" for n in NAMES)


def table(spark):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text), (2, text.upper()), (3, text + " more"), (4, "short"), (5, None)]
    return spark.createDataFrame([(i, t, "en", "s", 0, *(f"{i}-{k}" for k in range(2 * len(NAMES)))) for i, t in rows], SCHEMA)


def untouched(df, out):
    assert out.dtypes == df.dtypes
    for r in out.collect():
        assert list(r)[5:] == [f"{r.doc_id}-{k}" for k in range(2 * len(NAMES))]
    return sorted(r.doc_id for r in out.collect())


def test_kept_rows(ws, spark):
    df = table(spark)
    assert untouched(df, ExactDedup(ws).kept_rows(df)) == [1, 3, 4, 5]
    assert untouched(df, near_dedup.kept_rows(ws, df)) == [1, 4, 5]


def test_without_repeats(ws, spark):
    df = table(spark)
    assert untouched(df, substring_dedup.without_repeats(ws, df)) == [1, 2, 3, 4, 5]


def test_a_stage_leaves_results_of_others(ws, spark, sf_dir):
    df = table(spark)
    lazy = ExactDedup(ws).decisions(df)
    corpus_pipeline.drop_near_copies(spark, df, sf_dir)
    corpus_pipeline.cut_repeats(spark, df, sf_dir)
    assert lazy.count() == 5


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
