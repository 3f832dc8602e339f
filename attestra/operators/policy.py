"""Decision policies: thresholds on how an answer holds up when its evidence is removed, kept or left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import scalars as S

#: The grid of policies: 6 x 6 x 8 x 5 points (fixed values).
NECESSITY = [k * 0.1 for k in range(6)]
SUFFICIENCY = [0.5 + k * 0.1 for k in range(6)]
NUISANCE = [0.05 + k * 0.05 for k in range(8)]
CONFIDENCE = [50, 60, 70, 80, 90]


def scores(p0: Column, p1: Column, p2: Column, p3: Column) -> tuple[Column, Column, Column]:
    """necessity, sufficiency, nuisance of the probabilities first, without, with only, and beside the evidence."""
    clip = lambda x, lo: F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(1.0), x)))
    return clip(p0 - p1, -1.0), clip(1 - F.abs(p0 - p2), -1.0), clip(F.abs(p0 - p3), 0.0)


def decide(cases: DataFrame, necessity_min: float | Column, sufficiency_min: float | Column, nuisance_max: float | Column, confidence_min: int | Column) -> DataFrame:
    """Adds decision, calls_used and reason to cases (answer, confidence, necessity, sufficiency, nuisance, stages).

    Only a yes is checked; without all stages it is an abstention that cost what was asked.
    """
    checks = [("confidence", F.col("confidence") >= confidence_min), ("necessity", F.col("necessity") >= necessity_min), ("sufficiency", F.col("sufficiency") >= sufficiency_min), ("nuisance", F.col("nuisance") <= nuisance_max)]
    through = F.col("answer") != "yes"
    reason, calls = F.when(through, "passed_through").when(F.col("stages") < 3, "incomplete"), F.when(through, 1).when(F.col("stages") < 3, 1 + F.col("stages"))
    for k, (name, ok) in enumerate(checks):
        reason, calls = reason.when(~ok, f"failed_{name}"), calls.when(~ok, k + 1)
    rows = cases.withColumn("reason", reason.otherwise("accepted")).withColumn("calls_used", calls.otherwise(4))
    return rows.withColumn("decision", F.when(through, F.col("answer")).when(F.col("reason") == "accepted", "yes").otherwise("abstain"))


def grid(spark: SparkSession) -> DataFrame:
    """All policies as steps along each threshold, numbered in order."""
    nested = [(i, j, k, m) for i in range(len(NECESSITY)) for j in range(len(SUFFICIENCY)) for k in range(len(NUISANCE)) for m in range(len(CONFIDENCE))]
    return spark.createDataFrame([(n, *x) for n, x in enumerate(nested)], "point int, ni int, si int, ui int, ci int")


def evaluate_grid(cases: DataFrame) -> DataFrame:
    """Measures of every policy on cases.

    A case is reduced to how far along each threshold it passes, and cases are counted by that; there are fewer
    than 7 x 7 x 9 x 6 such counts for each label and kind however many cases, and these are what meets the grid.
    """
    passed = lambda c, steps: sum([(F.col(c) >= t).cast("int") for t in steps[1:]], (F.col(c) >= steps[0]).cast("int"))
    kind = F.when(F.col("answer") != "yes", F.col("answer")).when(F.col("stages") < 3, "incomplete").otherwise("checked")
    full = F.col("kind") == "checked"
    cells = cases.withColumn("kind", kind).select(
        "label", "kind", F.when(F.col("kind") == "incomplete", F.col("stages")).otherwise(0).alias("stages"),
        F.when(full, passed("necessity", NECESSITY)).otherwise(0).alias("n_to"), F.when(full, passed("sufficiency", SUFFICIENCY)).otherwise(0).alias("s_to"),
        F.when(full, len(NUISANCE) - sum([(F.col("nuisance") <= t).cast("int") for t in NUISANCE[1:]], (F.col("nuisance") <= NUISANCE[0]).cast("int"))).otherwise(0).alias("u_from"),
        F.when(full, passed("confidence", CONFIDENCE)).otherwise(0).alias("c_to"),
    )
    counts = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("w"))
    each = counts.crossJoin(F.broadcast(grid(cases.sparkSession)))  # 1,440 rows, always
    c, n, s, u = F.col("ci") < F.col("c_to"), F.col("ni") < F.col("n_to"), F.col("si") < F.col("s_to"), F.col("ui") >= F.col("u_from")
    yes = full & c & n & s & u
    calls = F.when(F.col("kind") == "incomplete", 1 + F.col("stages")).when(~full | ~c, 1).when(~n, 2).when(~s, 3).otherwise(4)
    total = lambda condition: F.sum(F.when(condition, F.col("w")).otherwise(0))
    no = F.col("kind") == "no"
    out = each.groupBy("point", "ni", "si", "ui", "ci").agg(
        total(F.lit(True)).alias("n_cases"), total(yes | no).alias("n_answered"), F.sum(calls * F.col("w")).alias("calls"),
        total(yes & F.col("label")).alias("tp"), total(yes & ~F.col("label")).alias("fp"), total(no & F.col("label")).alias("fn"), total(no & ~F.col("label")).alias("tn"),
    )
    tpr, tnr = S.ratio(F.col("tp"), F.col("tp") + F.col("fn")), S.ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return out.select(
        "point", (F.col("ni") * 0.1).alias("necessity_min"), (0.5 + F.col("si") * 0.1).alias("sufficiency_min"), (0.05 + F.col("ui") * 0.05).alias("nuisance_max"), (50 + F.col("ci") * 10).alias("confidence_min"),
        ((F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0))) / 2).alias("balanced_accuracy"), (F.col("n_answered") / F.col("n_cases")).alias("coverage"),
        (1 - tnr).alias("false_positive_rate"), (1 - tpr).alias("false_negative_rate"), (F.col("calls") / F.col("n_cases")).alias("mean_calls"), S.ratio(F.col("calls"), F.col("n_answered")).alias("calls_per_answer"),
        "n_cases", "n_answered",
    )


def frontier(points: DataFrame) -> DataFrame:
    """Policies that no other beats in accuracy and coverage at no more calls; of equal ones the first."""
    same = [F.round(F.coalesce(F.col(c), F.lit(-1.0)), 12).alias(f"_{c}") for c in ("balanced_accuracy", "coverage", "mean_calls", "false_positive_rate", "false_negative_rate")]
    first = points.groupBy(*same).agg(F.min("point").alias("point"))
    p = points.join(first.select("point"), "point", "left_semi")
    o = p.select(F.col("balanced_accuracy").alias("a"), F.col("coverage").alias("c"), F.col("mean_calls").alias("m"))
    better = (F.col("a") >= F.col("balanced_accuracy")) & (F.col("c") >= F.col("coverage")) & (F.col("m") <= F.col("mean_calls"))
    strictly = (F.col("a") > F.col("balanced_accuracy")) | (F.col("c") > F.col("coverage")) | (F.col("m") < F.col("mean_calls"))
    return p.join(F.broadcast(o), better & strictly, "left_anti")  # both sides have 1,440 rows at most


def tune(cases: DataFrame, development: Column) -> DataFrame:
    """The policy to use, chosen on development cases alone: most accurate, then widest, then cheapest of those that
    none beats; one row, or none without development cases."""
    best = frontier(evaluate_grid(cases.where(development)))
    return best.orderBy(F.desc("balanced_accuracy"), F.desc("coverage"), "mean_calls", "point").limit(1)  # the operator picks one


def ablate(cases: DataFrame, policy: DataFrame) -> DataFrame:
    """Decisions of each case under a policy (one row with its four thresholds) and with one of its three checks alone,
    as rows (*, variant, reason, calls_used, decision). A check that is off has a threshold nothing fails."""
    n, s, u = (F.col(c).cast("double") for c in ("necessity_min", "sufficiency_min", "nuisance_max"))
    least, most = F.lit(-1.0), F.lit(1.0)
    made = [("full", n, s, u), ("necessity_only", n, least, most), ("sufficiency_only", least, s, most), ("nuisance_only", least, least, u)]
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), a.alias("n_"), b.alias("s_"), c.alias("u_")) for v, a, b, c in made]))
    rows = cases.crossJoin(F.broadcast(policy.select(variants.alias("_v"), F.col("confidence_min").alias("_c"))))  # four rows
    rows = decide(rows, F.col("_v.n_"), F.col("_v.s_"), F.col("_v.u_"), F.col("_c"))
    return rows.withColumn("variant", F.col("_v.variant")).drop("_v", "_c")
