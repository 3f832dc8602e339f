"""Ranks, tests, intervals and fits against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import cohort, inference
from attestra.operators import quality_rules as Q


def test_student_t():
    for t, df, p in ((2.2281388, 10, 0.05), (12.7062047, 1, 0.05), (0.0, 5, 1.0), (2.0, 1e6, 0.0455)):
        assert inference.t_two_sided(t, df) == pytest.approx(p, abs=2e-4)
    assert math.isnan(inference.t_two_sided(float("nan"), 3))


def test_paired_comparison(spark):
    d = [0.1, 0.3, 0.2]
    rows = spark.createDataFrame([(s, c, 0.5 + (x if c == "a" else 0)) for s, x in enumerate(d) for c in "ab"] + [(9, "a", 1.0)], "site long, cond string, v double")
    r = inference.paired_comparison(rows, "site", "cond", "v", "a", "b").first()
    assert r.n_sites == 3 and r.mean_difference == pytest.approx(0.2) and r.t == pytest.approx(0.2 / (0.1 / math.sqrt(3)))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.9, float("nan")]
    rows = spark.createDataFrame([(i, "f", x) for i, x in enumerate(p)], "i long, f string, p double")
    got = {r.i: r.q for r in inference.benjamini_hochberg(rows, "p", "f").collect()}
    assert got[3] is None and got[5] is None
    assert [got[i] for i in (0, 1, 2, 4)] == [pytest.approx(x) for x in (0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.9)]


def test_ranks_and_roc(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 9, 200)
    rows = spark.createDataFrame([(int(a), float(b), float(b * b)) for a, b in zip(y, s)], "y int, s double, z double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert inference.roc_auc(rows, "y", "s").first().auc == pytest.approx(want)
    assert inference.spearman(rows, "s", "z").first().rho == pytest.approx(1.0)
    assert inference.spearman(rows.limit(2), "s", "z").first().rho is None


def test_bootstrap_by_weights_is_resampling(spark):
    units = [("g1", "a"), ("g1", "b"), ("g2", "c"), ("g2", "d")]
    values = {"a": (1.0, 2.0), "b": (0.0, 1.0), "c": (3.0, 3.0), "d": (1.0, 4.0)}
    weights = inference.bootstrap_weights(spark, units, 50, 3)
    stats = spark.createDataFrame([(u, *v) for u, v in values.items()], "u string, a double, b double")
    r = inference.bootstrap_ratio(stats, weights, "u", "a", "b").first()
    draws = {}
    for w in weights.collect():
        draws.setdefault(w.replicate, []).append((w.unit, w.w))
    ratios = [sum(w * values[u][0] for u, w in d) / sum(w * values[u][1] for u, w in d) for d in draws.values()]
    assert r.estimate == pytest.approx(0.5) and r.iterations == 50
    assert (r.low, r.high) == (pytest.approx(np.quantile(ratios, 0.025)), pytest.approx(np.quantile(ratios, 0.975)))


def test_logistic_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000).round(1)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    rows = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, y)] + [("one", 1.0, 1.0)] * 20, "m string, x double, y double")
    got = {r.m: r for r in inference.grouped_logistic(rows, F.col("x"), "y", "m").collect()}
    assert got["m"].slope == pytest.approx(2, abs=0.2) and got["one"].slope is None
    w = inference.logistic(np.column_stack([np.ones(3000), x]), y)
    assert got["m"].slope == pytest.approx(w[1]) and got["m"].intercept == pytest.approx(w[0])


def test_clustered_ols(spark):
    rng = np.random.default_rng(2)
    g, x = rng.integers(0, 12, 400), rng.normal(size=400)
    y = 1 + 2 * x + rng.normal(size=12)[g] + rng.normal(size=400)
    rows = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g int, x double, y double")
    got = {r.term: r for r in inference.clustered_ols(rows, "y", ["x"], "g").collect()}
    design = np.column_stack([np.ones(400), x])
    inverse = np.linalg.inv(design.T @ design)
    beta = inverse @ design.T @ y
    e = y - design @ beta
    meat = sum(np.outer(design[g == k].T @ e[g == k], design[g == k].T @ e[g == k]) for k in range(12))
    error = np.sqrt(np.diag(inverse @ meat @ inverse) * 12 / 11 * 399 / 398)
    assert got["x"].coefficient == pytest.approx(beta[1]) and got["x"].standard_error == pytest.approx(error[1])


def _crowded(spark):
    """Sites that share few places, some of them without a place, a key or a split."""
    rng = np.random.default_rng(4)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(30, 30.2, 12), rng.uniform(-110.2, -110, 12))]
    rows = [(k, *at[int(rng.integers(12))], ["x", "y", "z"][int(rng.integers(3))]) for k in rng.permutation(160).tolist()]
    return rows, spark.createDataFrame([*rows, (None, *at[0], "x"), (500, None, at[0][1], "x"), (501, *at[0], None)], "k long, lat double, lon double, s string")


def test_close_pairs_tests_places_not_sites(spark):
    rows, sites = _crowded(spark)
    got = sorted(map(tuple, cohort.close_pairs(sites.where("k < 500"), "k", "lat", "lon", 5000, 32, digits=3).collect()))
    want = [(p[0], q[0], round(d, 3)) for p in rows for q in rows if p[0] < q[0] and (d := _metres(p, q)) < 5000]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], abs=0.002)
    near = cohort._close_places(sites, "lat", "lon", 5000, 32).count()
    assert near <= 12 * 13 // 2  # a distance is taken for pairs of places, however many sites they have


@pytest.mark.parametrize("keys", [50_000, 3])
def test_close_splits_counts_pairs(spark, monkeypatch, keys):
    monkeypatch.setattr(cohort, "KEYS", keys)
    rows, sites = _crowded(spark)
    want = {}
    for p in rows:
        for q in rows:
            if p[0] < q[0] and p[3] != q[3] and (d := _metres(p, q)) < 5000:
                n, least = want.get(f"{p[3]}/{q[3]}", (0, d))
                want[f"{p[3]}/{q[3]}"] = (n + 1, min(least, d))
    got = {r.splits: (r.n, r.nearest_m) for r in cohort.close_splits(sites, "k", "s", "lat", "lon", 5000, 32).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1], abs=1e-6) for k, v in got.items())


def _metres(p, q):
    a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
    return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


@pytest.mark.parametrize("bins", [4096, 2])
def test_spread_orders_few_values(spark, monkeypatch, bins):
    """Medians as percentile() gives them, with NULL, NaN, infinities and values far apart, from a plan without it."""
    monkeypatch.setattr(cohort, "BINS", bins)
    rng = np.random.default_rng(5)
    v = [*rng.normal(0, 1, 300).tolist(), *[2.0] * 90, 1e300, -1e308, 1.7e308, float("inf"), float("-inf"), float("nan"), None, None]
    rows = [(["p", "q", None][k % 3], k % 4, x) for k, x in enumerate(v)] + [("void", 9, None), ("one", 10, 5.0), ("two", 10, 7.0), ("nan", 11, float("nan")), ("inf", 12, float("inf")), ("inf", 12, float("inf"))]
    frame = spark.createDataFrame(rows, "a string, b int, v double")
    got = cohort.spread(frame, F.col("v"), "a", "b")
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = frame.groupingSets([[], [F.col("a")], [F.col("b")]], F.col("a"), F.col("b")).agg(F.percentile("v", 0.5).alias("median"), F.max("v").alias("maximum"), F.count("v").alias("n"))
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_close_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    at = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(30, 32, 250), rng.uniform(-111, -109, 250)))]
    rows = spark.createDataFrame(at, "k long, lat double, lon double")
    got = {(r.a, r.b) for r in cohort.close_pairs(rows, "k", "lat", "lon", 9000, 32).collect()}

    def metres(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = {(p[0], q[0]) for p in at for q in at if p[0] < q[0] and metres(p, q) < 9000}
    assert got == want and want


def test_release_and_rules(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", None)], "id long, v string, ok boolean")
    give, held = Q.release(rows, F.col("ok"), ["id", "v"], F.col("id"))
    assert [r.id for r in give.collect()] == [1] and held.count() == 2 and held.columns == ["opaque_id", "content_sha256"]
    present = spark.createDataFrame([(1, "x"), (2, "y")], "k long, axis string")
    assert sorted(map(tuple, Q.missing_combinations(present, present.select("k"), axis=["x", "y"]).collect())) == [(1, "y"), (2, "x")]


def test_quantile_bins_put_the_least_value_in_the_first(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(1, 9)] + [(None,)], "x double")
    got = {r.x: r.bin for r in Q.quantile_bins(rows, "x", 4, "bin").collect()}
    assert [got[float(k)] for k in range(1, 9)] == [0, 0, 1, 1, 2, 2, 3, 3] and got[None] is None
