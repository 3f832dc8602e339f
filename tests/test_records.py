"""Joins that must match, checks, forms of text, registered comparisons and policies."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import forms
from attestra.operators import policy, records, registered


def _row(df):
    return df.first().asDict()


def test_attach_raises_drops_and_keeps(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "image string, x int")
    right = spark.createDataFrame([("a", 9)], "image string, x int")
    with pytest.raises(Exception, match="no partner"):
        records.attach(left, right, ["image"]).collect()
    assert [tuple(r) for r in records.attach(left, right, ["image"], "drop").collect()] == [("a", 1, 9)]
    assert sorted(r["x"] for r in records.attach(left, right, ["image"], "keep").collect()) == [1, 2, 3]
    assert records.attach(left, right, ["image"]).columns == ["image", "x", "x_truth"]
    with pytest.raises(Exception, match="repeated key"):
        records.attach(left, right.unionByName(right), ["image"], "keep").collect()
    with pytest.raises(Exception, match="repeated key"):
        records.attach(left.where("x = 1").unionByName(left), right, ["image"], "drop", one_to_one=True).collect()


def test_roster_conflicts(spark):
    made = lambda *rows: records.merged_roster(spark.createDataFrame(rows, "id string, role string, data string"), "id", "data")
    assert [tuple(r) for r in made(("m", "p", "d"), ("m", "p", "d"), ("n", None, None)).orderBy("id").collect()] == [("m", "p", "d"), ("n", None, "d")]
    with pytest.raises(Exception, match="declared differently"):
        made(("m", "p", "d"), ("m", "q", "d")).collect()
    with pytest.raises(Exception, match="different data sets"):
        made(("m", "p", "d"), ("n", "p", "e")).collect()


def test_frame_issues_of_clean_and_faulty_tables(spark):
    schema = "image string, elapsed_s long, phase string, lat double, lon double, segment_id int, split string, cover double, reliable boolean, cells array<string>, spatial_block string, water string"
    good = [("img_000001.jpg", 1, "up", 36.0, -112.0, 1, "train", 0.5, True, ["0,0"], "x", "yes"), ("img_000002.jpg", 2, "up", 36.0, -112.0, 1, "train", 0.5, False, None, "x", "no")]
    sums = {"n_frames": 2, "effective_segment_count": 1}
    check = lambda rows, manifest=None: sorted({r["code"] for r in records.frame_issues(spark.createDataFrame(rows, schema), ["up"], ["water"], manifest=manifest).collect()})
    assert check(good, sums) == []
    assert check(good) == ["missing_manifest"]
    assert check(good, {"n_frames": "two"}) == ["invalid_manifest"]
    bad = [("img_000002.jpg", 2, None, 0.0, None, 1, "test", None, None, ["0,0", "0,0"], "x", None)]
    assert check(good + bad, sums) == sorted(["unscored_phase", "invalid_coordinate", "zero_gps", "invalid_cover", "unreliable_grid", "invalid_grid", "invalid_presence", "duplicate_image", "duplicate_second", "spatial_leakage", "segment_leakage", "manifest_count"])
    lacking = spark.createDataFrame([(1,)], "image int")
    assert _row(records.frame_issues(lacking, ["up"], ["water"]))["code"] == "missing_columns"


def test_release_is_blocked(spark):
    rows = spark.createDataFrame([("a",)], "site string")
    sources = lambda *words: spark.createDataFrame([("a", w) for w in words], "site string, redistribution string")
    assert records.may_be_released(rows, sources("allowed", "allowed"), "site").count() == 1
    for words in (("allowed", "restricted"), ("allowed", None), ()):
        with pytest.raises(Exception, match="redistributed"):
            records.may_be_released(rows, sources(*words), "site").collect()


def test_empty_bins_and_nearest_coverage(spark):
    rows = spark.createDataFrame([(0.0, True), (0.1, False), (1.0, True)], "c double, ok boolean")
    bins = records.reliability(rows, F.col("c"), F.col("ok"), 10).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [2, *[0] * 8, 1] and bins[1]["accuracy"] is None and bins[0]["accuracy"] == 0.5
    curve = spark.createDataFrame([("m", 1, 0.7, 5.0), ("m", 2, 0.9, 6.0)], "model string, step int, coverage double, risk double")
    assert _row(records.nearest_coverage(curve, "risk", 0.8, "model"))["risk"] in (5.0, 6.0)
    assert _row(records.nearest_coverage(curve, "risk", 0.85, "model"))["risk"] == 6.0


def test_forms(spark):
    one = spark.createDataFrame([(" Yes", "N", "maybe", "['a', \"b c\"]", "Lake shore road", None)], "y string, n string, other string, list string, label string, nothing string")
    got = _row(one.select(
        forms.boolean(F.col("y")).alias("y"), forms.boolean(F.col("n")).alias("n"), forms.boolean(F.col("other"), strict=False).alias("other"), forms.boolean(F.col("nothing")).alias("nothing"),
        forms.words_of_list(F.col("list")).alias("list"), forms.words_of_list(F.col("label")).alias("no_list"), forms.label_class(F.col("label")).alias("classes"),
        forms.eligible(F.lit("grounding"), F.col("y")).alias("e"), forms.eligible(F.lit("grounding"), F.col("nothing")).alias("f"), forms.eligible(F.lit("presence"), F.col("nothing")).alias("g"),
        forms.registration_threshold_m(F.lit(32.0)).alias("m"), forms.answer_faults(F.array(F.lit("9,9"), F.lit("0,0")), F.lit(None), 8, 1).alias("faults"), forms.latex(F.lit("a\\b_c")).alias("latex"),
    ))
    assert got == {"y": True, "n": False, "other": None, "nothing": None, "list": ["a", "b c"], "no_list": None, "classes": ["water", "road"], "e": True, "f": False, "g": True, "m": 2.0, "faults": ["outside_grid", "ranking_differs", "over_budget"], "latex": "a\\textbackslash{}b\\_c"}
    for bad in (forms.boolean(F.col("other")), forms.registration_threshold_m(F.lit(0.0))):
        with pytest.raises(Exception, match="neither yes nor no|must be positive"):
            one.select(bad).collect()


def test_contrasts_pool_rows_by_site_before_pairing(spark):
    rows = [("m", 1, "a", 1.0), ("m", 1, "b", 0.0), ("n", 1, "a", 0.0), ("n", 1, "a", 0.5), ("m", 2, "a", 1.0), ("m", 2, "b", 0.5), ("m", 3, "a", 9.0), ("m", 4, "b", float("nan")), (None, 2, "b", 0.0)]
    frame = spark.createDataFrame(rows, "model string, site int, side string, x double")
    out = {r["model"]: r for r in registered.contrasts(frame, "site", "model", {"c": (F.col("x"), F.col("side") == "a", F.col("side") == "b")}).collect()}
    assert set(out) == {None, "m"}
    assert out["m"]["n_sites"] == 2 and out["m"]["mean_difference"] == pytest.approx(0.75)  # 1.0 and 0.5
    assert out[None]["mean_difference"] == pytest.approx((0.5 + 0.75) / 2)
    assert out["m"]["t"] == pytest.approx(3.0) and out["m"]["p"] == pytest.approx(0.204832764699133)


def test_policy_is_tuned_on_development_alone(spark):
    schema = "case_id int, label boolean, answer string, confidence int, stages int, necessity double, sufficiency double, nuisance double"
    rows = [(1, True, "yes", 95, 3, 0.6, 0.9, 0.0), (2, False, "yes", 60, 3, 0.0, 0.6, 0.3), (3, False, "no", 80, 0, None, None, None)]
    others = [(k, True, "yes", 60, 3, 0.0, 0.6, 0.3) for k in range(10, 40)]
    best = policy.tune(spark.createDataFrame(rows + others, schema), F.col("case_id") < 10)
    assert best.count() == 1 and _row(best)["balanced_accuracy"] == 1.0 and _row(best)["n_cases"] == 3
    assert policy.tune(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    fixed = spark.createDataFrame([(0.1, 0.7, 0.2, 50)], "necessity_min double, sufficiency_min double, nuisance_max double, confidence_min int")
    got = {(r["case_id"], r["variant"]): r["decision"] for r in policy.ablate(spark.createDataFrame(rows, schema), fixed).collect()}
    assert len(got) == 12 and got[2, "full"] == "abstain" and got[1, "full"] == "yes" and got[3, "nuisance_only"] == "no"
