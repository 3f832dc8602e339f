"""Hand-computed values of scoring, tracks and policies."""

import math

import pytest
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import logs, policy, probes, scoring
from attestra.operators import trajectory as T

CURVE = "site_id string, view_id string, target_class string, sequence string, variant string, prompt_id string, fraction double, p_yes double"


def causal_rows(spark, drop=()):
    base = ("s", "v", "water")
    rows = [(*base, "screening", "clean", "neutral_v4", 0.0, 0.9)]
    for name, half, whole in (("oracle_deletion", 0.4, 0.1), ("distractor_deletion", 0.9, 0.9), ("self_deletion", 0.5, 0.2), ("self_sufficiency", 0.9, 0.8), ("random_control", 0.8, 0.9), ("texture_control", 0.7, 0.7)):
        if name not in drop:
            rows += [(*base, name, "clean", "neutral_v4", 0.5, half), (*base, name, "clean", "neutral_v4", 1.0, whole)]
    return spark.createDataFrame(rows, CURVE).withColumn("model", F.lit("m"))


def test_areas_and_summary(spark):
    r = scoring.causal(causal_rows(spark), ["model"]).first()
    assert r.auc_oracle_deletion == pytest.approx((0.9 + 0.4) / 2 * 0.5 + (0.4 + 0.1) / 2 * 0.5)
    assert r.auc_distractor_deletion == pytest.approx(0.9)
    assert r.ocrs == pytest.approx(0.9 - r.auc_oracle_deletion)
    assert r.sen == pytest.approx(r.auc_random_control - r.auc_self_deletion)
    assert r.ses == pytest.approx((1.0 + 0.9) / 2)
    assert r.efs == pytest.approx(math.sqrt(r.sen * r.ses)) and r.osg == pytest.approx(r.ocrs - r.efs)


def test_efs_is_never_missing(spark):
    r = scoring.causal(causal_rows(spark, drop=("random_control",)), ["model"]).first()
    assert r.sen is None and r.efs == 0.0 and r.osg == pytest.approx(r.ocrs)


def test_area_divides_by_the_largest_fraction_and_averages_a_measured_zero(spark):
    rows = causal_rows(spark).where("sequence = 'oracle_deletion' and fraction = 0.5 or sequence = 'screening'")
    zero = rows.where("sequence = 'screening'").withColumns({"sequence": F.lit("oracle_deletion"), "p_yes": F.lit(0.5)})
    base = scoring.baselines(rows, ["model", *scoring.VIEW_KEYS])
    both = rows.where("sequence <> 'screening'").unionByName(zero)
    r = scoring.curve_areas(both, base, ["model", *scoring.VIEW_KEYS], ["model"], ["model", *scoring.VIEW_KEYS]).first()
    assert r.auc == pytest.approx(((0.9 + 0.5) / 2 + 0.4) / 2)


def test_probabilities(spark):
    rows = spark.createDataFrame([("yes", 90), ("no", 90), ("abstain", 90), (None, None)], "answer string, confidence int")
    got = rows.select(S.yes_probability(F.col("answer"), F.col("confidence")), S.binary_answer(F.col("answer"))).collect()
    assert [tuple(r) for r in got] == [(0.9, 1.0), (pytest.approx(0.1), 0.0), (0.5, None), (0.5, None)]


def test_cell_edges_round_half_to_even(spark):
    edges = [r[0] for r in spark.range(7).select(S.cell_edge(F.col("id"), 1024, 6)).collect()]
    assert edges == [round(k * 1024 / 6) for k in range(7)]
    assert spark.range(1).select(S.cell_edge(F.lit(1), 5, 2)).first()[0] == 2


def test_localisation_of_nothing(spark):
    kind = "p array<string>, t array<string>, px map<string,int>"
    rows = spark.createDataFrame([([], [], {}), (["0,0"], [], {}), ([], ["0,0"], {"0,0": 5}), (["0,0", "0,0"], ["0,0"], {"0,0": 4})], kind)
    got = scoring.localisation(rows, "p", "t", "px", 2, 4, 4).collect()
    assert [(r.cell_precision, r.cell_recall, r.cell_f1, r.cell_iou, r.evidence_coverage) for r in got] == [(1, 1, 1, 1, 1), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (1, 1, 1, 1, 1)]
    assert got[3].mask_weighted_iou == 1.0 and got[3].area_penalized_f1 == 0.75 and got[0].mask_weighted_iou == 1.0


def test_performance_needs_both_truths(spark):
    cols = "model string, site_id long, true_positive boolean, predicted double, format_failure boolean, cache_hit boolean, attempts long, input_tokens long, output_tokens long, cost_usd double, latency_s double"
    row = lambda m, t, p: (m, 1, t, p, False, False, 1, 2, 3, 0.5, 1.0)
    rows = spark.createDataFrame([row("a", True, 1.0), row("a", True, 0.0), row("b", True, 1.0), row("b", False, 1.0), row("b", False, None)], cols)
    got = {r.model: r for r in scoring.performance(rows, "model").collect()}
    assert got["a"].balanced_accuracy is None and got["a"].false_negative_rate == 0.5 and got["a"].false_positive_rate is None
    assert got["b"].balanced_accuracy == 0.5 and got["b"].abstention_rate == pytest.approx(1 / 3) and got["b"].macro_f1 == pytest.approx((2 / 3 + 0) / 2)


def test_selective_risk_sizes(spark):
    rows = spark.createDataFrame([("m", k, k % 2 == 0, 1.0, i) for i, k in enumerate(range(25))], "model string, confidence int, true_positive boolean, predicted double, i long")
    got = scoring.selective_risk(rows, ["model"], [F.col("i")]).orderBy("step").collect()
    assert [round(r.coverage * 25) for r in got] == [max(1, round(25 * k / 10)) for k in range(1, 11)]
    assert got[-1].selective_risk == pytest.approx(12 / 25) and got[0].confidence_threshold == 23.0


def test_merge_of_logs(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    assert sorted(map(tuple, logs.merge_logs(rows, ["id"]).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="conflicting rows"):
        logs.merge_logs(rows.unionByName(spark.createDataFrame([(2, "c")], "id long, v string")), ["id"]).collect()


def test_running_total_matches_a_window(spark):
    rows = spark.range(0, 1000, 7).withColumn("amount", F.col("id") % 13)
    got = [r.running for r in logs.running_total(rows, "id", F.col("amount"), 50).orderBy("id").collect()]
    total, want = 0, []
    for k in range(0, 1000, 7):
        total += k % 13
        want.append(total)
    assert got == want


def test_cache_hits(spark):
    rows = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "k", True), (4, "j", True), (5, None, True)], "seq long, k string, ok boolean")
    got = {r.seq: r.cache_hit for r in logs.cache_hits(rows, F.col("k"), ["seq"], F.col("ok")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_thinning(spark):
    rows = spark.createDataFrame([(1, s, 34.0 + d, -110.0, h) for s, d, h in ((0, 0.0, 0), (30, 0.1, 0), (120, 0.02, 0), (200, 0.0201, 0), (300, 0.0202, 0x1FF))], "track long, s long, lat double, lon double, phash long")
    got = [tuple(r)[1:] for r in T.thin(rows, "track", "s", "lat", "lon", "phash").orderBy("s").collect()]
    assert got == [(0, "first"), (120, "distance"), (300, "perceptual")]


def test_segments_bound_duration(spark):
    rows = spark.createDataFrame([(1, s, 34.0, -110.0, "Floating" if s < 1500 else "Terminating") for s in range(0, 2400, 60)], "track long, s long, lat double, lon double, phase string")
    got = T.segments(rows, "track", "s", "lat", "lon", "phase").groupBy("segment_no").agg(F.min("s").alias("a"), F.max("s").alias("b")).orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [(0, 540), (600, 1140), (1200, 1440), (1500, 2040), (2100, 2340)]


def test_track_recovery(spark):
    data = [(0, 0, "Ground"), (1, 5, "Ground"), (2, 0, "Launching"), (3, 6806, "floating "), (4, 6807, "Floating"), (5, 25688, "terminating"), (6, 1, "Ground")]
    rows = spark.createDataFrame([(1, *r, 34.0 + r[0], -110.0, 0.0) for r in data], "track long, seq long, clock long, phase string, lat double, lon double, speed double").withColumn("phase", T.canonical_phase(F.col("phase")))
    seg = T.reset_segments(rows, "track", "seq", "clock")
    audit = T.segment_audit(seg, "track", "seq", "clock", "lat", "lon").orderBy("segment_id").collect()
    assert [(r.row_count, r.in_order, r.selected) for r in audit] == [(2, False, False), (4, True, True), (1, False, False)]
    kept = T.clean(seg.where("segment_id = 1").drop("segment_id"), "track", "seq", "clock", "lat", "lon", ["speed"]).orderBy("clock").collect()
    assert [r.clock for r in kept] == [0, 6806, 6807, 25688] and all(r.speed is None for r in kept)


def test_distance_of_a_missing_place_is_missing(spark):
    rows = spark.createDataFrame([(34.0, None), (34.0, 34.0)], "a double, b double")
    got = [r[0] for r in rows.select(S.haversine_m(F.col("a"), F.lit(0.0), F.col("b"), F.lit(0.0))).collect()]
    assert got == [None, 0.0]


def test_policy(spark):
    cols = "label boolean, answer string, confidence int, stages int, necessity double, sufficiency double, nuisance double"
    rows = spark.createDataFrame([(True, "yes", 90, 3, 0.5, 0.9, 0.04), (True, "yes", 50, 3, 0.5, 0.9, 0.04), (False, "yes", 90, 1, None, None, None), (False, "no", 10, 0, None, None, None)], cols)
    got = [(r.decision, r.reason, r.calls_used) for r in policy.decide(rows, 0.2, 0.7, 0.2, 60).collect()]
    assert got == [("yes", "accepted", 4), ("abstain", "failed_confidence", 1), ("abstain", "incomplete", 2), ("no", "passed_through", 1)]
    grid = policy.evaluate_grid(rows)
    assert grid.count() == 1440
    best = grid.where("point = 0").first()
    assert best.coverage == 0.75 and best.balanced_accuracy == 1.0 and best.n_answered == 3
    assert policy.frontier(grid).count() >= 1


def test_calibration_bins_are_closed_on_the_right(spark):
    rows = spark.createDataFrame([(0.0, True), (0.1, True), (0.10001, False), (1.0, True)], "c double, ok boolean")
    r = probes.calibration(rows, F.col("c"), F.col("ok"), 10).first()
    assert r.bins_used == 3 and r.ece == pytest.approx((2 * 0.95 + 0.10001 + 0.0) / 4)


def test_kappa_and_votes(spark):
    same = spark.createDataFrame([("y", "y")] * 3, "a string, b string")
    assert probes.cohen_kappa(same, "a", "b").first().kappa == 1.0
    mixed = spark.createDataFrame([("y", "y"), ("y", "n"), ("n", "n"), ("n", "y")], "a string, b string")
    assert probes.cohen_kappa(mixed, "a", "b").first().kappa == 0.0
    votes = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")], "k long, v string")
    assert {r.k: r.vote for r in probes.majority(votes, "k", "v").collect()} == {1: "a", 2: "uncertain"}


def test_captions(spark):
    texts = ["A river runs by. No roads here.", "There may be a river.", "A road; later no road at all.", "river without roads", None, "Without any of the long list of words before it, a river."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: (r.water, r.road) for r in probes.caption_assertions(rows, "text", {"water": ["river"], "road": ["road"]}).collect()}
    assert got == {0: ("yes", "no"), 1: ("hedged", "no"), 2: ("no", "no"), 3: ("yes", "no"), 4: ("no", "no"), 5: ("yes", "no")}
