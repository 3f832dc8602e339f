"""Queries 1 to 13: scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import scoring as P
from attestra.plans.proxy import SCORED, scored
from attestra.plans.registry import Tables, query

_R = P.rounded


@query(f"with {SCORED} select model, answer, confidence, count(*) as n, round(avg(p_yes), 6) as mean_p_yes, round(avg(predicted), 6) as mean_predicted from scored group by all")
def q01_probabilities(t: Tables) -> DataFrame:
    """Answers as probabilities and as binary values."""
    return _R(scored(t).groupBy("model", "answer", "confidence").agg(F.count(F.lit(1)).alias("n"), F.avg("p_yes").alias("mean_p_yes"), F.avg("predicted").alias("mean_predicted")))


@query("""
select l_returnflag as model, coalesce(r.role, 'unregistered') as role, count(*) as n, count(v.view_id) as n_joined
from lineitem left join (select 'A' as m, 'primary' as role union all select 'N', 'reference') r on l_returnflag = r.m
left join (select p_partkey as view_id from part where p_size > 5) v on l_partkey = v.view_id group by all
""")
def q02_truth_join(t: Tables) -> DataFrame:
    """Predictions with truth by view, and with model roles, missing ones being unregistered."""
    roles = t.spark.createDataFrame([("A", "primary"), ("N", "reference")], "model string, role string")
    views = t.part.where("p_size > 5").select(F.col("p_partkey").alias("view_id"))
    rows = t.lineitem.select(F.col("l_returnflag").alias("model"), "l_partkey").join(F.broadcast(roles), "model", "left")
    rows = rows.join(views, F.col("l_partkey") == F.col("view_id"), "left")
    return rows.groupBy("model", F.coalesce("role", F.lit("unregistered")).alias("role")).agg(F.count(F.lit(1)).alias("n"), F.count("view_id").alias("n_joined"))


_PERFORMANCE = """
 count(*) filter (where predicted = 1 and true_positive) as tp, count(*) filter (where predicted = 0 and true_positive) as fn,
 count(*) filter (where predicted = 1 and not true_positive) as fp, count(*) filter (where predicted = 0 and not true_positive) as tn,
 round(avg(case when predicted is null then 1e0 else 0e0 end), 6) as abstention_rate,
 round(avg(cast(format_failure as int)), 6) as format_failure_rate, round(avg(cast(cache_hit as int)), 6) as cache_hit_rate,
 cast(sum(attempts) as bigint) as physical_attempts, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
 round(sum(cost_usd), 6) as cost_usd, round(median(latency_s) filter (where not cache_hit), 6) as median_latency_s,
 count(*) as n_queries, count(distinct site_id) as n_sites from scored
"""
_RATES = """
 round(case when tp + fn > 0 and fp + tn > 0 then (tp / cast(tp + fn as double) + tn / cast(fp + tn as double)) / 2 end, 6) as balanced_accuracy,
 round(fp / cast(nullif(fp + tn, 0) as double), 6) as false_positive_rate, round(fn / cast(nullif(tp + fn, 0) as double), 6) as false_negative_rate, abstention_rate,
 round((coalesce(2 * tp / cast(nullif(2 * tp + fp + fn, 0) as double), 0) + coalesce(2 * tn / cast(nullif(2 * tn + fp + fn, 0) as double), 0))
   / nullif(cast(tp + fp + fn > 0 as int) + cast(tn + fp + fn > 0 as int), 0), 6) as macro_f1,
 format_failure_rate, cache_hit_rate, physical_attempts, input_tokens, output_tokens, cost_usd, median_latency_s, n_queries, n_sites
"""


@query(f"with {SCORED}, c as (select model, {_PERFORMANCE} group by model) select model, {_RATES} from c")
def q03_performance(t: Tables) -> DataFrame:
    """Fourteen performance measures of each model."""
    return _R(P.performance(scored(t), "model"))


@query(f"with {SCORED}, c as (select model, target_class, site_group, variant, {_PERFORMANCE} group by grouping sets ((model, target_class), (model, site_group), (model, variant))) select model, target_class, site_group, variant, {_RATES} from c")
def q04_performance_by_key(t: Tables) -> DataFrame:
    """The same measures by class, by group and by variant, in one pass over grouping sets."""
    keys = [F.col(k) for k in ("model", "target_class", "site_group", "variant")]
    sets = [[keys[0], k] for k in keys[1:]]
    return _R(scored(t).groupingSets(sets, *keys).agg(*P.performance_columns()))


_GRID, _W, _H = 8, 100, 75


@query(f"""
with e as (select vec_id, [cast(x as double) for x in embedding] as e from embeddings),
ix as (select vec_id, e, unnest(range(64)) as i from e),
c as (select vec_id, i // 8 as r, i % 8 as k, e[i + 1] as x from ix),
pred as (select vec_id, list(r || ',' || k) as cells from c where x > 0.15 group by 1),
truth as (select vec_id, list(r || ',' || k) as cells from c where x > 0.1 and (r + k) % 2 = 0 group by 1),
px as (select vec_id, r || ',' || k as cell, cast(floor(x * 100) as int) as n from c where x > 0.1 and (r + k) % 2 = 0),
m as (select e.vec_id, coalesce(p.cells, []) as p, coalesce(t.cells, []) as t from e left join pred p using (vec_id) left join truth t using (vec_id)),
a as (select c.vec_id, sum((round_even((r + 1) * {_H} / {_GRID}e0, 0) - round_even(r * {_H} / {_GRID}e0, 0)) * (round_even((k + 1) * {_W} / {_GRID}e0, 0) - round_even(k * {_W} / {_GRID}e0, 0))) as chosen from c where x > 0.15 group by 1),
h as (select px.vec_id, sum(n) as target, coalesce(sum(n) filter (where list_contains(m.p, cell)), 0) as hit from px join m using (vec_id) group by 1),
b as (select m.vec_id, cast(len(p) as double) as n, cast(len(t) as double) as m, cast(len(list_intersect(p, t)) as double) as bo, coalesce(target, 0) as target, coalesce(hit, 0) as hit, coalesce(chosen, 0) as chosen
      from m left join a using (vec_id) left join h using (vec_id)),
s as (select *, case when n > 0 then bo / n when m = 0 then 1e0 else 0e0 end as p_, case when m > 0 then bo / m when n = 0 then 1e0 else 0e0 end as r_ from b),
f as (select *, case when p_ + r_ > 0 then 2 * p_ * r_ / (p_ + r_) else 0e0 end as f_ from s)
select vec_id, round(p_, 6) as cell_precision, round(r_, 6) as cell_recall, round(f_, 6) as cell_f1,
 round(case when n + m - bo > 0 then bo / (n + m - bo) else 1e0 end, 6) as cell_iou, n as cell_count,
 round(case when target + chosen - hit > 0 then hit / (target + chosen - hit) else 1e0 end, 6) as mask_weighted_iou,
 round(case when target > 0 then hit / cast(target as double) when n = 0 then 1e0 else 0e0 end, 6) as evidence_coverage,
 round(f_ * greatest(0, 1 - n / {_GRID * _GRID}e0), 6) as area_penalized_f1 from f
""")
def q05_localisation(t: Tables) -> DataFrame:
    """Eight localisation measures; cells are the places of large components of an embedding on an 8 x 8 grid."""
    cell = lambda i: F.concat_ws(",", F.floor(i / _GRID).cast("string"), (i % _GRID).cast("string"))
    indexed = F.transform(F.col("embedding"), lambda x, i: F.struct(x.cast("double").alias("x"), i.alias("i")))
    even = lambda s: (F.floor(s["i"] / _GRID) + s["i"] % _GRID) % 2 == 0
    true = F.filter(F.col("e"), lambda s: (s["x"] > 0.1) & even(s))
    rows = t.embeddings.select("vec_id", indexed.alias("e")).select(
        "vec_id",
        F.transform(F.filter(F.col("e"), lambda s: s["x"] > 0.15), lambda s: cell(s["i"])).alias("p"),
        F.transform(true, lambda s: cell(s["i"])).alias("t"),
        F.map_from_entries(F.transform(true, lambda s: F.struct(cell(s["i"]), F.floor(s["x"] * 100).cast("int")))).alias("px"),
    )
    return _R(P.localisation(rows, "p", "t", "px", _GRID, _W, _H).drop("p", "t", "px"))


_KEYS = "site_id, view_id, target_class"
_BASE = f"base as (select model, {_KEYS}, avg(p_yes) as baseline from scored where sequence = 'screening' and variant = 'clean' and prompt_id like '%neutral%' group by all)"


def _area_sql(by: str, name: str = "areas", source: str = "scored", base: str = "base", on: str = "model") -> str:
    """Areas of response curves by `by`, of which `on` are also keys of the baseline."""
    keys = f"{by}, {_KEYS}" if by else _KEYS
    return f"""
{name}_p as (select {keys}, fraction, avg(p_yes) as p from {source} where sequence <> 'screening' group by all),
{name}_j as (select {name}_p.*, baseline from {name}_p join {base} using ({on}{', ' if on else ''}{_KEYS})),
{name}_c as (select {keys}, fraction, p from {name}_j union all select distinct {keys}, 0e0, baseline from {name}_j),
{name}_m as (select {keys}, fraction, avg(p) as p from {name}_c group by all),
{name}_w as (select *, lag(fraction) over w as f0, lag(p) over w as p0 from {name}_m window w as (partition by {keys} order by fraction)),
{name}_a as (select {keys}, sum((fraction - f0) * (p + p0) / 2) / max(fraction) as a from {name}_w group by all having count(*) >= 2),
{name} as (select {by or "1 as one"}, avg(a) as auc from {name}_a group by all)"""


@query(f"with {SCORED}, {_BASE}, {_area_sql('model, sequence')} select model, sequence, round(auc, 6) as auc from areas")
def q06_curve_areas(t: Tables) -> DataFrame:
    """Area under response curves by model and sequence."""
    rows = scored(t)
    keys = ["model", *P.VIEW_KEYS]
    return _R(P.curve_areas(rows.where("sequence <> 'screening'"), P.baselines(rows, keys), keys, ["model", "sequence"], keys))


def _causal_sql(by: str, source: str = "scored", base: str = "base", on: str = "model", areas: str = "areas") -> str:
    one = lambda s: f"max(auc) filter (where sequence = '{s}')"
    return f"""
{areas}_s as (select {by}, avg(1 - abs(p_yes - baseline)) as ses from {source} join {base} using ({on}, {_KEYS}) where sequence = 'self_sufficiency' group by all),
{areas}_g as (select distinct {by} from {source}),
{areas}_x as (select {by}, {", ".join(f"{one(s)} as auc_{s}" for s in P.DELETIONS)} from {areas} group by all),
{areas}_y as (select *, auc_distractor_deletion - auc_oracle_deletion as ocrs, auc_random_control - auc_self_deletion as sen
  from {areas}_g left join {areas}_x using ({by}) left join {areas}_s using ({by})),
{areas}_z as (select *, case when sen is null or ses is null then 0e0 else sqrt(greatest(0, sen) * greatest(0, ses)) end as efs from {areas}_y)
select {by}, {", ".join(f"round(auc_{s}, 6) as auc_{s}" for s in P.DELETIONS)}, round(ocrs, 6) as ocrs, round(sen, 6) as sen, round(ses, 6) as ses, round(efs, 6) as efs, round(ocrs - efs, 6) as osg from {areas}_z"""


@query(f"with {SCORED}, {_BASE}, {_area_sql('model, sequence')}, {_causal_sql('model')}")
def q07_causal_summary(t: Tables) -> DataFrame:
    """Six areas of each model and ocrs, sen, ses, efs, osg."""
    return _R(P.causal(scored(t), ["model"]))


@query(f"with {SCORED}, {_BASE}, {_area_sql('model, operator, sequence')}, {_causal_sql('model, operator')}")
def q08_sensitivity_grid(t: Tables) -> DataFrame:
    """The causal summary by operator, with baselines over all operators."""
    rows = scored(t)
    return _R(P.causal(rows, ["model", "operator"], base=P.baselines(rows, ["model", *P.VIEW_KEYS])))


@query(f"""
with {SCORED} select model, round(avg(predicted) filter (where extinction), 6) as extinction_positive_rate,
 round(avg(predicted) filter (where sequence = 'oracle_deletion' and fraction = 1 and true_positive), 6) as survival_rate from scored group by model
""")
def q09_extinction_and_survival(t: Tables) -> DataFrame:
    """Positive answers where nothing is visible, and after all evidence is removed."""
    gone = (F.col("sequence") == "oracle_deletion") & (F.col("fraction") == 1) & F.col("true_positive")
    return _R(scored(t).groupBy("model").agg(F.avg(F.when(F.col("extinction"), F.col("predicted"))).alias("extinction_positive_rate"), F.avg(F.when(gone, F.col("predicted"))).alias("survival_rate")))


_TIES = ["order_id", "line", "part_id", "site_id"]


@query(f"""
with {SCORED}, a as (select *, row_number() over w as rn, sum(case when (predicted = 1) <> true_positive then 1 else 0 end) over w as wrong,
 sum(case when not true_positive then 1 else 0 end) over w as neg, sum(case when not true_positive then predicted else 0 end) over w as fp
 from scored where predicted is not null window w as (partition by model order by confidence desc, order_id, line, part_id, site_id, cost_usd rows unbounded preceding)),
s as (select model, count(*) as n_all, count(predicted) as n from scored group by model),
g as (select *, unnest(range(1, 11)) as step from s), k as (select *, greatest(1, cast(round_even(n * step / 10e0, 0) as int)) as rn from g)
select model, cast(step as int) as step, round(rn / cast(n_all as double), 6) as coverage, round(wrong / cast(rn as double), 6) as selective_risk,
 round(fp / nullif(neg, 0), 6) as selective_false_positive_rate, cast(confidence as double) as confidence_threshold
from a join k using (model, rn)
""")
def q10_selective_risk(t: Tables) -> DataFrame:
    """Risk, false positives and threshold over the most confident tenths."""
    return _R(P.selective_risk(scored(t), ["model"], [F.col(c) for c in [*_TIES, "cost_usd"]]))


@query(f"""
with {SCORED} select model, round(avg(predicted) filter (where prompt_id like '%false%') - avg(predicted) filter (where prompt_id like '%neutral%'), 6) as prompt_prior_gap
from scored where not true_positive group by model
""")
def q10b_prompt_prior_gap(t: Tables) -> DataFrame:
    """How much more often a false premise than a neutral prompt gets yes where nothing is there; not paired."""
    p = lambda s: F.avg(F.when(F.lower("prompt_id").contains(s), F.col("predicted")))
    return _R(scored(t).where("not true_positive").groupBy("model").agg((p("false") - p("neutral")).alias("prompt_prior_gap")))


@query(f"""
with {SCORED}, c as (select model, {_KEYS}, altitude_m, gsd, width_px, avg(p_yes) filter (where prompt_id like '%neutral%') as neutral, avg(p_yes) filter (where prompt_id like '%false%') as false_premise
 from scored where sequence = 'screening' group by all),
p as (select *, false_premise - neutral as gap, ln(gsd) as x from c where neutral is not null and false_premise is not null)
select model, altitude_m, count(*) as n_pairs, round(avg(gap), 6) as mean_gap, round(any_value(slope), 6) as slope_per_log_gsd
from p join (select model, case when count(distinct altitude_m) >= 2 then regr_slope(gap, x) end as slope from p group by model) s using (model) group by all
""")
def q11_prompt_profile(t: Tables) -> DataFrame:
    """Paired prompt gap by altitude with its slope over the log of ground resolution."""
    keys = ["model", *P.VIEW_KEYS, "altitude_m", "gsd", "width_px"]
    rows = scored(t).where("sequence = 'screening'")
    mean = lambda s: F.avg(F.when(F.lower("prompt_id").contains(s), F.col("p_yes")))
    pairs = rows.groupBy(*keys).agg(mean("neutral").alias("neutral"), mean("false").alias("false_premise")).where("neutral is not null and false_premise is not null")
    pairs = pairs.withColumn("gap", F.col("false_premise") - F.col("neutral")).withColumn("x", F.log("gsd"))
    slopes = pairs.groupBy("model").agg(F.when(F.count_distinct("altitude_m") >= 2, F.regr_slope("gap", "x")).alias("slope"))
    out = pairs.groupBy("model", "altitude_m").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("gap").alias("mean_gap")).join(slopes, "model")
    return _R(out.select("model", "altitude_m", "n_pairs", "mean_gap", F.col("slope").alias("slope_per_log_gsd")))


@query("""
with s as (select c_nationkey as stratum, c_custkey, row_number() over (partition by c_nationkey order by sha256('7:' || c_custkey), c_custkey) as round_ from customer)
select c_custkey, stratum, cast(round_ as int) as round from s order by round_, stratum limit 60
""")
def q12_round_robin(t: Tables) -> DataFrame:
    """Stratified pick: one of each stratum a round, by content hash, until 60 are taken."""
    w = Window.partitionBy("c_nationkey").orderBy(F.sha2(F.concat_ws(":", F.lit("7"), F.col("c_custkey").cast("string")), 256), "c_custkey")
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("stratum"), F.row_number().over(w).alias("round"))
    return rows.orderBy("round", "stratum").limit(60)


@query("""
with s as (select c_nationkey as stratum, c_custkey, row_number() over (partition by c_nationkey order by sha256('7:' || c_custkey), c_custkey) as rn, count(*) over (partition by c_nationkey) as n from customer),
k as (select *, round_even(0.2e0 * n, 0) as d from s)
select c_custkey, stratum, case when rn <= d then 'development' when rn <= 2 * d then 'validation' else 'test' end as split from k
""")
def q12b_stratified_splits(t: Tables) -> DataFrame:
    """A fifth of each stratum for development, a fifth for validation, the rest for test."""
    by = Window.partitionBy("c_nationkey")
    rn = F.row_number().over(by.orderBy(F.sha2(F.concat_ws(":", F.lit("7"), F.col("c_custkey").cast("string")), 256), "c_custkey"))
    d = F.bround(F.lit(0.2) * F.col("n"))
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("stratum"), rn.alias("rn"), F.count(F.lit(1)).over(by).alias("n"))
    return rows.select("c_custkey", "stratum", F.when(F.col("rn") <= d, "development").when(F.col("rn") <= 2 * d, "validation").otherwise("test").alias("split"))


@query(f"""
with {SCORED}, r as (select model, width_px, p_yes,
 rank() over (partition by model order by width_px) + (count(*) over (partition by model, width_px) - 1) / 2e0 as rx,
 rank() over (partition by model order by p_yes) + (count(*) over (partition by model, p_yes) - 1) / 2e0 as ry from scored where sequence = 'texture_control'),
m as (select model, corr(rx, ry) as rho, avg(p_yes) filter (where width_px >= 2) as visible, avg(p_yes) filter (where width_px < 2) as sub_pixel from r group by model)
select model, round(rho, 6) as spearman_rho, round(visible, 6) as mean_visible, round(sub_pixel, 6) as mean_sub_pixel, coalesce(rho > 0 and visible > sub_pixel, false) as passed from m
""")
def q13_width_control(t: Tables) -> DataFrame:
    """Positive control: do answers rise with the width of what was inserted?"""
    from attestra.operators.inference import average_ranks

    rows = scored(t).where("sequence = 'texture_control'").select("model", "width_px", "p_yes")
    ranked = average_ranks(average_ranks(rows.select("model", "width_px", "p_yes"), "width_px", "rx", "model"), "p_yes", "ry", "model")
    out = ranked.groupBy("model").agg(
        F.corr("rx", "ry").alias("spearman_rho"), F.avg(F.when(F.col("width_px") >= 2, F.col("p_yes"))).alias("mean_visible"), F.avg(F.when(F.col("width_px") < 2, F.col("p_yes"))).alias("mean_sub_pixel")
    )
    return _R(out.withColumn("passed", F.coalesce((F.col("spearman_rho") > 0) & (F.col("mean_visible") > F.col("mean_sub_pixel")), F.lit(False))))
