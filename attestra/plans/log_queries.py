"""Queries 14 to 23: logs, structured probes, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import logs, policy, probes
from attestra.operators.scoring import rounded as _R
from attestra.plans.proxy import pick
from attestra.plans.registry import Tables, query


@query("""
with e as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) as n from lineitem group by all),
k as (select l_orderkey, l_linenumber, sum(n) as copies, count(*) as versions from e group by all)
select l_linenumber, cast(copies as bigint) as copies, versions, versions > 1 as conflict, count(*) as ids from k group by all
""")
def q14_log_merge(t: Tables) -> DataFrame:
    """Logs of several hosts by request: copies, versions and conflicts."""
    key = ["l_orderkey", "l_linenumber"]
    parts = [t.lineitem.where(F.col("l_suppkey") % 3 == k).select(*key, "l_partkey", "l_suppkey", "l_quantity") for k in range(3)]
    report = logs.merge_report(parts[0].unionByName(parts[1]).unionByName(parts[2]), key, ["l_partkey", "l_suppkey", "l_quantity"])
    return report.groupBy("l_linenumber", "copies", "versions", "conflict").agg(F.count(F.lit(1)).alias("ids"))


@query("""
select o_orderpriority, count(*) as planned, count(*) filter (where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)) as left_to_do from orders group by 1
""")
def q15_resume(t: Tables) -> DataFrame:
    """Requests that are planned and not done yet."""
    done = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    planned = t.orders.select("o_orderkey", "o_orderpriority")
    left = logs.resume(planned, done, ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("left_to_do"))
    out = planned.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("planned")).join(left, "o_orderpriority", "left")
    return out.select("o_orderpriority", "planned", F.coalesce("left_to_do", F.lit(0)).alias("left_to_do"))


@query("""
with k as (select conv_id, turn, sha256(role || chr(0) || text) as call_key, length(text) > 0 as valid from conversations),
f as (select *, min(case when valid then conv_id * 1000 + turn end) over (partition by call_key) as first_ from k)
select conv_id, turn, call_key, coalesce(first_ < conv_id * 1000 + turn, false) as cache_hit from f
""")
def q15b_content_cache(t: Tables) -> DataFrame:
    """Calls that an earlier valid call with the same content answers."""
    key = S.request_id(F.col("role"), F.col("text"))
    rows = t.conversations.select("conv_id", "turn", key.alias("call_key"), (F.length("text") > 0).alias("valid"))
    return logs.cache_hits(rows, F.col("call_key"), ["conv_id", "turn"], F.col("valid")).select("conv_id", "turn", "call_key", "cache_hit")


@query("""
with r as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, sum(cast(round(o_totalprice * 100) as bigint)) over (order by o_orderkey rows unbounded preceding) as running from orders)
select o_orderkey, cents, cast(running as bigint) as running from r where running <= (select sum(cast(round(o_totalprice * 100) as bigint)) // 3 from orders)
""")
def q16_budget_prefix(t: Tables) -> DataFrame:
    """Requests in order up to a hard cap on cost: a third of what all would cost."""
    rows = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    cap = rows.agg(F.expr("sum(cents) div 3").alias("cap"))
    return logs.running_total(rows, "o_orderkey", F.col("cents"), 10_000).crossJoin(F.broadcast(cap)).where("running <= cap").drop("cap")  # cap is one row


@query("""
select o_orderpriority as model, count(*) as calls, count(*) * 4 as worst_calls, round(sum(((o_orderkey % 1500) * 2.5e0 + (o_custkey % 100) * 10e0) / 1e6), 6) as likely_cost,
 round(sum(((o_orderkey % 1500) * 2.5e0 + (o_custkey % 100) * 10e0) / 1e6) * 4, 6) as worst_cost from orders group by 1
""")
def q16b_call_plan(t: Tables) -> DataFrame:
    """Calls and costs by model, likely and at worst."""
    return _R(logs.call_plan(t.orders, "o_orderpriority", 3, F.col("o_orderkey") % 1500, F.col("o_custkey") % 100, 2.5, 10.0))


_F = {"urban": 0, "water": 1, "forest": 2}
_PRESENCE = " union all ".join(
    f"select '{f}' as feature, case (o_orderkey + {k}) % 5 when 0 then 'uncertain' when 1 then 'yes' when 2 then 'yes' else 'no' end as t, case (o_custkey + {k}) % 4 when 0 then null when 1 then 'yes' when 2 then 'no' else 'maybe' end as a from orders"
    for f, k in _F.items()
)


@query(f"""
with x as ({_PRESENCE}), v as (select *, coalesce(t in ('yes', 'no') and a in ('yes', 'no'), false) as valid from x),
c as (select feature, count(*) filter (where valid and t = 'yes' and a = 'yes') as tp, count(*) filter (where valid and t = 'no' and a = 'yes') as fp,
 count(*) filter (where valid and t = 'no' and a = 'no') as tn, count(*) filter (where valid and t = 'yes' and a = 'no') as fn,
 count(*) filter (where t in ('yes', 'no')) as n, count(*) filter (where valid) as n_valid, count(*) filter (where t in ('yes', 'no') and t = a) as exact from v group by 1),
r as (select *, tp / cast(nullif(tp + fp, 0) as double) as p, tp / cast(nullif(tp + fn, 0) as double) as q from c)
select feature, tp, fp, tn, fn, n, n_valid, round(p, 6) as precision, round(q, 6) as recall, round(2 * p * q / nullif(p + q, 0), 6) as f1,
 round((n - n_valid) / cast(n as double), 6) as invalid_rate, round(exact / cast(n as double), 6) as exact_accuracy, round(fp / cast(nullif(fp + tn, 0) as double), 6) as false_positive_rate from r
""")
def q17_presence(t: Tables) -> DataFrame:
    """Presence answers of three features."""
    truth = lambda k: pick((F.col("o_orderkey") + k) % 5, "uncertain", "yes", "yes", "no")
    answer = lambda k: F.when((F.col("o_custkey") + k) % 4 == 1, "yes").when((F.col("o_custkey") + k) % 4 == 2, "no").when((F.col("o_custkey") + k) % 4 == 3, "maybe")
    rows = t.orders.select(*[truth(k).alias(f"truth_{f}") for f, k in _F.items()], *[answer(k).alias(f"answer_{f}") for f, k in _F.items()])
    return _R(probes.presence(rows, list(_F)))


@query("""
with e as (select o_orderpriority as variant, case when o_custkey % 7 <> 0 then cast(o_custkey % 101 as double) end - (o_orderkey % 100) as e from orders)
select variant, count(*) as n, count(e) as n_valid, round(1 - count(e) / cast(count(*) as double), 6) as invalid_rate, round(avg(e), 6) as signed_error, round(avg(abs(e)), 6) as mae,
 round(avg(case when e > 0 then 1e0 when e is not null then 0e0 end), 6) as overestimation_rate from e group by 1
""")
def q18_amounts(t: Tables) -> DataFrame:
    """Errors of stated percentages."""
    answer = F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 101).cast("double"))
    return _R(probes.amounts(t.orders.withColumnRenamed("o_orderpriority", "variant"), answer, F.col("o_orderkey") % 100, "variant"))


@query("""
with e as (select vec_id, label, vec_id % 10 <> 0 as valid, [cast(x as double) for x in embedding] as e from embeddings),
s as (select vec_id, label, valid, [(i // 4) || ',' || (i % 4) for i in range(16) if e[i + 1] > 0.05] as t, [(i // 4) || ',' || (i % 4) for i in range(16) if e[i + 17] > 0.05] as c,
 [cast(least(floor(abs(e[2 * i + 34]) * 16), 3) as int) || ',' || cast(least(floor(abs(e[2 * i + 33]) * 16), 3) as int) for i in range(4)] as p from e),
m as (select label, valid, t, case when valid then c else [] end as c, case when valid then p else [] end as p from s),
k as (select label, count(*) as n, avg(case when valid then 0e0 else 1e0 end) as invalid_rate, sum(len(list_intersect(c, t))) as tp, sum(len(c)) as nc, sum(len(t)) as nt,
 sum(len(p)) as np, sum(len([x for x in p if list_contains(t, x)])) as hits, sum(len(list_intersect(list_distinct(p), t))) as pointed from m group by 1),
r as (select *, tp / cast(nullif(nc, 0) as double) as pr, tp / cast(nullif(nt, 0) as double) as re from k)
select label, n, round(invalid_rate, 6) as invalid_rate, round(pr, 6) as region_precision, round(re, 6) as region_recall, round(2 * pr * re / nullif(pr + re, 0), 6) as region_f1,
 round(hits / cast(nullif(np, 0) as double), 6) as point_precision, round(pointed / cast(nullif(nt, 0) as double), 6) as point_cell_recall from r
""")
def q19_grounding(t: Tables) -> DataFrame:
    """Cells and points against true cells, pooled by label."""
    cell = lambda i: F.concat_ws(",", F.floor(i / 4).cast("string"), (i % 4).cast("string"))
    places = lambda at: F.transform(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.element_at("embedding", i + at).cast("double") > 0.05), cell)
    share = lambda k: F.abs(F.element_at("embedding", k).cast("double")) * 4
    points = F.array(*[probes.point_cell(share(33 + 2 * i), share(34 + 2 * i)) for i in range(4)])
    rows = t.embeddings.select("label", "vec_id", places(1).alias("truth"), places(17).alias("cells"), points.alias("points"))
    return _R(probes.grounding(rows, "truth", "cells", "points", F.col("vec_id") % 10 != 0, "label"))


@query("""
with v as (select case o_orderkey % 3 when 0 then 'leading' when 1 then 'evidence_first' else 'plain' end as variant, case o_custkey % 5 when 0 then null when 1 then 1e0 when 2 then 1e0 else 0e0 end as c from orders),
s as (select variant, count(*) as n, count(c) as n_valid, avg(c) as compliance_rate from v group by 1)
select variant, n, n_valid, round(compliance_rate, 6) as compliance_rate, round(max(compliance_rate) filter (where variant = 'leading') over () - max(compliance_rate) filter (where variant = 'evidence_first') over (), 6) as mitigation_delta from s
""")
def q20_false_premise(t: Tables) -> DataFrame:
    """Compliance with a false premise by prompt variant."""
    complied = F.when(F.col("o_custkey") % 5 == 0, None).otherwise((F.col("o_custkey") % 5).isin(1, 2))
    rows = t.orders.select(pick(F.col("o_orderkey") % 3, "leading", "evidence_first", "plain").alias("variant"), complied.alias("complied"))
    return _R(probes.false_premise(rows, "variant", F.col("complied")))


@query("""
with b as (select l_returnflag as mechanism, l_quantity / 50e0 as c, case when l_partkey % 3 = 0 then 1e0 else 0e0 end as a from lineitem),
g as (select mechanism, greatest(0, least(cast(ceil(c * 10) as int) - 1, 9)) as bin, count(*) as n, avg(c) as c, avg(a) as a from b group by all)
select mechanism, round(sum(n * abs(a - c)) / sum(n), 6) as ece, cast(sum(n) as bigint) as n, count(*) as bins_used from g group by 1
""")
def q21_calibration(t: Tables) -> DataFrame:
    """Expected calibration error by mechanism."""
    rows = t.lineitem.withColumnRenamed("l_returnflag", "mechanism")
    return _R(probes.calibration(rows, F.col("l_quantity") / 50.0, F.col("l_partkey") % 3 == 0, 10, "mechanism"))


def cases(t: Tables) -> DataFrame:
    """Orders as cases; their lines 1 to 4 are the stages, of which some lack."""
    code = F.col("l_partkey") * 100 + F.floor("l_quantity").cast("long")
    stage = lambda k: F.max(F.when(F.col("l_linenumber") == k, code))
    lines = t.lineitem.where("l_linenumber <= 4").groupBy("l_orderkey").agg(*[stage(k + 1).alias(f"s{k}") for k in range(4)]).where("s0 is not null")
    answer = lambda c: F.when(F.floor(F.col(c) / 100) % 10 == 0, "abstain").when(F.floor(F.col(c) / 100) % 2 == 0, "yes").otherwise("no")
    confidence = lambda c: F.col(c) % 100 * 2
    p = [F.when(F.col(f"s{k}").isNotNull(), S.yes_probability(answer(f"s{k}"), confidence(f"s{k}"))) for k in range(4)]
    n, s, u = policy.scores(*p)
    stages = sum([F.col(f"s{k}").isNotNull().cast("int") for k in (2, 3)], F.col("s1").isNotNull().cast("int"))
    rows = lines.join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("l_orderkey").alias("case_id"), (F.col("o_orderstatus") != "F").alias("label"), answer("s0").alias("answer"), confidence("s0").alias("confidence"), stages.alias("stages"), n.alias("necessity"), s.alias("sufficiency"), u.alias("nuisance"))


_P = lambda k: f"case when s{k} is not null then case when s{k} // 100 % 10 = 0 then 0.5e0 when s{k} // 100 % 2 = 0 then (s{k} % 100 * 2) / 100e0 else 1 - (s{k} % 100 * 2) / 100e0 end end"
_CASES = f"""
lines as (select l_orderkey, {", ".join(f"max(l_partkey * 100 + cast(floor(l_quantity) as bigint)) filter (where l_linenumber = {k + 1}) as s{k}" for k in range(4))} from lineitem group by 1 having s0 is not null),
probs as (select *, {", ".join(f"{_P(k)} as p{k}" for k in range(4))} from lines),
cases as (select l_orderkey as case_id, o_orderstatus <> 'F' as label, case when s0 // 100 % 10 = 0 then 'abstain' when s0 // 100 % 2 = 0 then 'yes' else 'no' end as answer, s0 % 100 * 2 as confidence,
 cast(s1 is not null as int) + cast(s2 is not null as int) + cast(s3 is not null as int) as stages,
 case when p1 is not null then greatest(-1, least(1, p0 - p1)) end as necessity, case when p2 is not null then greatest(-1, least(1, 1 - abs(p0 - p2))) end as sufficiency, case when p3 is not null then greatest(0, least(1, abs(p0 - p3))) end as nuisance
 from probs join orders on l_orderkey = o_orderkey)"""
_GRID = f"""
grid as (select cast(row_number() over (order by ni, si, ui, ci) - 1 as int) as point, ni, si, ui, ci from range(6) a(ni), range(6) b(si), range(8) c(ui), range(5) d(ci)),
m as (select point, ni * 0.1e0 as necessity_min, 0.5e0 + si * 0.1e0 as sufficiency_min, 0.05e0 + ui * 0.05e0 as nuisance_max, cast(50 + ci * 10 as int) as confidence_min from grid),
w as (select label, answer, confidence, stages, necessity, sufficiency, nuisance, count(*) as w from cases group by all),
d as (select m.*, w.*, answer = 'yes' and stages = 3 as checked, answer = 'no' as no_ from m, w),
e as (select *, checked and confidence >= confidence_min and necessity >= necessity_min and sufficiency >= sufficiency_min and nuisance <= nuisance_max as yes_,
 case when answer <> 'yes' then 1 when stages < 3 then 1 + stages when confidence < confidence_min then 1 when necessity < necessity_min then 2 when sufficiency < sufficiency_min then 3 else 4 end as calls from d),
g as (select point, necessity_min, sufficiency_min, nuisance_max, confidence_min, cast(sum(w) as bigint) as n_cases, coalesce(cast(sum(w) filter (where yes_ or no_) as bigint), 0) as n_answered, sum(calls * w) as calls,
 coalesce(sum(w) filter (where yes_ and label), 0) as tp, coalesce(sum(w) filter (where yes_ and not label), 0) as fp, coalesce(sum(w) filter (where no_ and label), 0) as fn, coalesce(sum(w) filter (where no_ and not label), 0) as tn from e group by all),
r as (select *, tp / cast(nullif(tp + fn, 0) as double) as tpr, tn / cast(nullif(tn + fp, 0) as double) as tnr from g),
points as (select point, necessity_min, sufficiency_min, nuisance_max, confidence_min, (coalesce(tpr, 0) + coalesce(tnr, 0)) / 2 as balanced_accuracy, n_answered / cast(n_cases as double) as coverage,
 1 - tnr as false_positive_rate, 1 - tpr as false_negative_rate, calls / cast(n_cases as double) as mean_calls, calls / cast(nullif(n_answered, 0) as double) as calls_per_answer, n_cases, n_answered from r)"""
_POINT = ", ".join(f"round({c}, 6) as {c}" for c in ("necessity_min", "sufficiency_min", "nuisance_max", "balanced_accuracy", "coverage", "false_positive_rate", "false_negative_rate", "mean_calls", "calls_per_answer")) + ", point, confidence_min, n_cases, n_answered"


@query(f"with {_CASES}, {_GRID} select {_POINT} from points")
def q22_policy_grid(t: Tables) -> DataFrame:
    """Accuracy, coverage and calls of 1,440 policies."""
    return _R(policy.evaluate_grid(cases(t)))


@query(f"""
with {_CASES}, {_GRID}, u as (select * from points where point in (select min(point) from points group by round(balanced_accuracy, 12), round(coverage, 12), round(mean_calls, 12), round(coalesce(false_positive_rate, -1), 12), round(coalesce(false_negative_rate, -1), 12)))
select {_POINT} from u p where not exists (select 1 from u o where o.balanced_accuracy >= p.balanced_accuracy and o.coverage >= p.coverage and o.mean_calls <= p.mean_calls
 and (o.balanced_accuracy > p.balanced_accuracy or o.coverage > p.coverage or o.mean_calls < p.mean_calls))
""")
def q23_policy_frontier(t: Tables) -> DataFrame:
    """Policies that none beats."""
    return _R(policy.frontier(policy.evaluate_grid(cases(t))))


@query(f"""
with {_CASES}, d as (select *, case when answer <> 'yes' then 'passed_through' when stages < 3 then 'incomplete' when confidence < 60 then 'failed_confidence' when necessity < 0.2e0 then 'failed_necessity'
 when sufficiency < 0.7e0 then 'failed_sufficiency' when nuisance > 0.2e0 then 'failed_nuisance' else 'accepted' end as reason from cases)
select reason, case when answer <> 'yes' then answer when reason = 'accepted' then 'yes' else 'abstain' end as decision,
 case reason when 'passed_through' then 1 when 'incomplete' then 1 + stages when 'failed_confidence' then 1 when 'failed_necessity' then 2 when 'failed_sufficiency' then 3 else 4 end as calls_used, count(*) as n from d group by all
""")
def q23b_policy_decisions(t: Tables) -> DataFrame:
    """What one policy decides, why and after how many calls."""
    return policy.decide(cases(t), 0.2, 0.7, 0.2, 60).groupBy("reason", "decision", "calls_used").agg(F.count(F.lit(1)).alias("n"))
