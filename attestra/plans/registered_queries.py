"""Comparisons fixed in advance, tuned policies and what they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import policy
from attestra.operators import registered as G
from attestra.operators.scoring import VIEW_KEYS
from attestra.operators.scoring import rounded as _R
from attestra.plans.log_queries import _CASES, _GRID, cases
from attestra.plans.proxy import SCORED, scored, t_p_sql
from attestra.plans.registry import Tables, query
from attestra.plans.scoring_queries import _KEYS, _area_sql, _causal_sql


_CONTRASTS_SQL = """
r as (select 'clean_minus_degraded_accuracy' as contrast, case variant when 'clean' then 0 when 'degraded' then 1 end as side, model, site_id, case when predicted is not null then cast((predicted = 1) = true_positive as int) * 1e0 end as x from scored where sequence = 'screening'
 union all select 'low_minus_high_altitude_accuracy', case altitude_m when (select min(altitude_m) from scored where sequence = 'screening' and variant = 'clean') then 0 when (select max(altitude_m) from scored where sequence = 'screening' and variant = 'clean') then 1 end, model, site_id, case when predicted is not null then cast((predicted = 1) = true_positive as int) * 1e0 end from scored where sequence = 'screening' and variant = 'clean'
 union all select 'false_premise_minus_neutral_yes_probability', case when prompt_id like 'false%' then 0 else 1 end, model, site_id, p_yes from scored where not true_positive
 union all select 'original_minus_target_deleted_yes_probability', case when sequence = 'screening' and variant = 'clean' then 0 when sequence = 'oracle_deletion' and fraction = 1 then 1 end, model, site_id, p_yes from scored
 union all select 'distractor_minus_target_deleted_yes_probability', case when sequence = 'distractor_deletion' and fraction = 1 then 0 when sequence = 'oracle_deletion' and fraction = 1 then 1 end, model, site_id, p_yes from scored),
s as (select contrast, null as model, site_id, avg(x) filter (where side = 0) - avg(x) filter (where side = 1) as d from r group by all union all select contrast, model, site_id, avg(x) filter (where side = 0) - avg(x) filter (where side = 1) from r group by all),
c as (select contrast, model, count(d) as n_sites, avg(d) as mean_difference, case when count(d) >= 2 then stddev_samp(d) / sqrt(count(d)) end as standard_error from s where d is not null group by all),
t as (select *, case when standard_error > 0 then mean_difference / standard_error end as t, n_sites - 1 as df from c)"""


@query(f"with {SCORED}, {_CONTRASTS_SQL} select contrast, model, n_sites, round(mean_difference, 6) as mean_difference, round(standard_error, 6) as standard_error, round(t, 6) as t, round({t_p_sql('t', 'df')}, 6) as p from t")
def q49d_registered_contrasts(t: Tables) -> DataFrame:
    """Five paired contrasts, of each model and of all."""
    rows = scored(t)
    screened = F.col("sequence") == "screening"
    clean = screened & (F.col("variant") == "clean")
    ends = rows.where(clean).agg(F.min("altitude_m").alias("lowest"), F.max("altitude_m").alias("highest"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    correct = F.when(F.col("predicted").isNotNull(), ((F.col("predicted") == 1) == F.col("true_positive")).cast("double"))
    whole = F.col("fraction") == 1
    target, distractor = (F.col("sequence") == "oracle_deletion") & whole, (F.col("sequence") == "distractor_deletion") & whole
    false, negative = F.col("prompt_id").startswith("false"), ~F.col("true_positive")
    wanted = {
        "clean_minus_degraded_accuracy": (correct, clean, screened & (F.col("variant") == "degraded")),
        "low_minus_high_altitude_accuracy": (correct, clean & (F.col("altitude_m") == F.col("lowest")), clean & (F.col("altitude_m") == F.col("highest")) & (F.col("lowest") < F.col("highest"))),
        "false_premise_minus_neutral_yes_probability": (F.col("p_yes"), negative & false, negative & ~false),
        "original_minus_target_deleted_yes_probability": (F.col("p_yes"), clean, target),
        "distractor_minus_target_deleted_yes_probability": (F.col("p_yes"), distractor, target),
    }
    return _R(G.contrasts(rows, "site_id", "model", wanted))


_SITE_BASE = f"base as (select model, {_KEYS}, avg(p_yes) as baseline from scored where sequence = 'screening' and variant = 'clean' and prompt_id like '%neutral%' group by all)"
# a site is one of the curve's keys already, so areas go by model and sequence inside each site
_SITE_AREAS = _area_sql("model, sequence").replace("areas as (select model, sequence, avg(a) as auc from areas_a group by all)", "areas as (select model, site_id, sequence, avg(a) as auc from areas_a group by all)")
_SITE_CAUSAL = _causal_sql("model, site_id").rpartition("select model, site_id")[0].rstrip()


@query(f"""
with {SCORED}, {_SITE_BASE}, {_SITE_AREAS}, {_SITE_CAUSAL},
v as (select model, site_id, 'macro_fpr' as endpoint, avg(predicted) as x from scored where sequence = 'screening' and variant = 'clean' and not true_positive and predicted is not null group by all
 union all select model, site_id, 'ocrs', ocrs from areas_z union all select model, site_id, 'efs', efs from areas_z),
d as (select p.endpoint, p.model as a, q.model as b, p.x - q.x as d from v p join v q on p.endpoint = q.endpoint and p.site_id = q.site_id and p.model < q.model where p.x is not null and q.x is not null),
c as (select endpoint, a, b, count(*) as n_sites, avg(d) as mean_difference, case when count(*) >= 2 and stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end as t, count(*) - 1 as df from d group by all),
p as (select *, {t_p_sql('t', 'df')} as p from c), k as (select *, row_number() over (partition by p is null order by p) as rk, count(p) over () as m from p),
q as (select *, min(p * m / rk) over (partition by p is null order by rk desc rows unbounded preceding) as q from k)
select endpoint, a, b, n_sites, round(mean_difference, 6) as mean_difference, round(t, 6) as t, round(p, 6) as p, round(case when p is not null then least(1, q) end, 6) as q from q
""")
def q49e_endpoint_pairs(t: Tables) -> DataFrame:
    """Three endpoints of every two models, with false discovery rates over all of them."""
    rows = scored(t)
    return _R(G.endpoint_pairs(G.endpoints(rows, [k for k in VIEW_KEYS if k != "site_id"])))


_DEVELOPMENT = _CASES.replace("\ncases as (", "\nall_cases as (") + ", cases as (select * from all_cases where case_id % 3 = 0)"
_BEST = f"""{_DEVELOPMENT}, {_GRID}, best as (select * from points p where not exists (select 1 from points o where o.balanced_accuracy >= p.balanced_accuracy and o.coverage >= p.coverage and o.mean_calls <= p.mean_calls
 and (o.balanced_accuracy > p.balanced_accuracy or o.coverage > p.coverage or o.mean_calls < p.mean_calls)) order by balanced_accuracy desc, coverage desc, mean_calls, point limit 1)"""


@query(f"with {_BEST} select point, confidence_min, round(necessity_min, 6) as necessity_min, round(sufficiency_min, 6) as sufficiency_min, round(nuisance_max, 6) as nuisance_max, round(balanced_accuracy, 6) as balanced_accuracy, round(coverage, 6) as coverage, round(mean_calls, 6) as mean_calls, n_cases from best")
def q23c_policy_tuned(t: Tables) -> DataFrame:
    """The policy chosen on development cases."""
    return _R(policy.tune(cases(t), F.col("case_id") % 3 == 0).select("point", "confidence_min", "necessity_min", "sufficiency_min", "nuisance_max", "balanced_accuracy", "coverage", "mean_calls", "n_cases"))


_DECIDED = """
v as (select *, unnest(['full', 'necessity_only', 'sufficiency_only', 'nuisance_only']) as variant from all_cases, (select necessity_min, sufficiency_min, nuisance_max, confidence_min from best)),
u as (select *, case when variant in ('full', 'necessity_only') then necessity_min else -1 end as n_, case when variant in ('full', 'sufficiency_only') then sufficiency_min else -1 end as s_, case when variant in ('full', 'nuisance_only') then nuisance_max else 1 end as u_ from v),
x as (select *, case when answer <> 'yes' then 'passed_through' when stages < 3 then 'incomplete' when confidence < confidence_min then 'failed_confidence' when necessity < n_ then 'failed_necessity' when sufficiency < s_ then 'failed_sufficiency' when nuisance > u_ then 'failed_nuisance' else 'accepted' end as reason from u),
y as (select *, case when answer <> 'yes' then answer when reason = 'accepted' then 'yes' else 'abstain' end as decision, case reason when 'passed_through' then 1 when 'incomplete' then 1 + stages when 'failed_confidence' then 1 when 'failed_necessity' then 2 when 'failed_sufficiency' then 3 else 4 end as calls_used from x)"""


@query(f"with {_BEST}, {_DECIDED} select variant, reason, decision, calls_used, count(*) as n from y group by all")
def q23d_policy_ablation(t: Tables) -> DataFrame:
    """The tuned policy beside each of its checks alone."""
    all_cases = cases(t)
    rows = policy.ablate(all_cases, policy.tune(all_cases, F.col("case_id") % 3 == 0))
    return rows.groupBy("variant", "reason", "decision", "calls_used").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
with {_BEST}, {_DECIDED}, z as (select case when case_id % 2 = 0 then 'neutral' else 'false_premise' end as prompt, label, answer, decision, calls_used from y where variant = 'full'),
h as (select prompt, count(*) as n, count(*) filter (where not label and answer = 'yes') / cast(nullif(count(*) filter (where not label and answer <> 'abstain'), 0) as double) as a, count(*) filter (where not label and decision = 'yes') / cast(nullif(count(*) filter (where not label and decision <> 'abstain'), 0) as double) as b,
 avg(cast(decision <> 'abstain' as int)) as c, avg(calls_used) as d, avg(cast(answer <> 'abstain' and (answer = 'yes') = label as int)) as e, avg(cast(decision <> 'abstain' and (decision = 'yes') = label as int)) as f from z group by 1)
select prompt, n, round(a, 6) as direct_false_positive_rate, round(b, 6) as policy_false_positive_rate, round(b - a, 6) as false_positive_rate_delta, round(c, 6) as coverage, round(d, 6) as mean_calls, round(e, 6) as direct_strict_accuracy, round(f, 6) as policy_strict_accuracy from h
""")
def q23e_policy_effect(t: Tables) -> DataFrame:
    """What the tuned policy changes, by prompt."""
    all_cases = cases(t).withColumn("prompt", F.when(F.col("case_id") % 2 == 0, "neutral").otherwise("false_premise"))
    decided = policy.ablate(all_cases, policy.tune(all_cases, F.col("case_id") % 3 == 0)).where("variant = 'full'")
    return _R(G.policy_against_direct(all_cases, decided, "case_id", ["prompt"]))
