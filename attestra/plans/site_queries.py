"""Queries 35 to 56: sites, quality rules, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import cohort, inference
from attestra.operators import quality_rules as Q
from attestra.operators.scoring import rounded as _R
from attestra.plans.proxy import SCORED, pick, scored, t_p_sql
from attestra.plans.registry import Tables, query

_ALT = [3000.0, 4500.0, 12000.0, 24000.0]


@query("""
select s_suppkey as site_id, a.a as altitude_m, g.g as geometry, 'view_a' || replace(case when a.a % 1000 = 0 then cast(cast(a.a / 1000 as int) as varchar) else cast(a.a / 1000 as varchar) end, '.', 'p') || 'km_' || g.g as view_id,
 round(2 * a.a * tan(radians(60e0) / 2) / 768, 6) as gsd, round(2 * a.a * tan(radians(60e0) / 2), 6) as ground_width_m
from supplier, (select unnest([3000e0, 4500e0, 12000e0, 24000e0]) as a) a, (select unnest(['nadir', 'oblique']) as g) g
""")
def q35_view_lattice(t: Tables) -> DataFrame:
    """Sites at four altitudes and two geometries."""
    return _R(cohort.view_lattice(t.supplier.select(F.col("s_suppkey").alias("site_id")), _ALT, ["nadir", "oblique"], 60.0, 768))


def _places(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", "c_nationkey", (30 + k * 7919 % 10000 / F.lit(5000.0)).alias("lat"), (-110 + k * 104729 % 10000 / F.lit(5000.0)).alias("lon"), pick(k % 3, "development", "validation", "test").alias("split"))


_PLACES = "places as (select c_custkey, c_nationkey, 30 + c_custkey * 7919 % 10000 / 5000e0 as lat, -110 + c_custkey * 104729 % 10000 / 5000e0 as lon, case c_custkey % 3 when 0 then 'development' when 1 then 'validation' else 'test' end as split from customer)"
_D = "2 * 6371008.8e0 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"with {_PLACES} select a.c_custkey as a, b.c_custkey as b, round({_D}, 3) as distance_m from places a join places b on a.c_custkey < b.c_custkey and {_D} < 5000")
def q36_close_sites(t: Tables) -> DataFrame:
    """Sites nearer than five kilometres."""
    return cohort.close_pairs(_places(t), "c_custkey", "lat", "lon", 5000.0, 40.0, digits=3)


@query(f"with {_PLACES} select a.split || '/' || b.split as splits, count(*) as n, round(min({_D}), 3) as nearest_m from places a join places b on a.c_custkey < b.c_custkey and a.split <> b.split and {_D} < 5000 group by 1")
def q36b_split_independence(t: Tables) -> DataFrame:
    """Pairs of sites of different splits that are too near."""
    return _R(cohort.close_splits(_places(t), "c_custkey", "split", "lat", "lon", 5000.0, 40.0), 3)


@query("""
with r as (select l_partkey as identifier, l_suppkey as site, case l_suppkey % 3 when 0 then 'development' when 1 then 'validation' else 'test' end as split from lineitem)
select identifier, string_agg(distinct split, '+' order by split) as splits, count(distinct split) as n_splits, count(distinct site) as n_sites from r group by 1 having count(distinct split) > 1
""")
def q37_leakage(t: Tables) -> DataFrame:
    """Source ids that sites of several splits share."""
    rows = t.lineitem.select("l_partkey", "l_suppkey", pick(F.col("l_suppkey") % 3, "development", "validation", "test").alias("split"))
    return cohort.leakage(rows, "l_partkey", "split", "l_suppkey")


@query("""
select n_name as site_group, c_mktsegment as target_class, count(*) as n, count(*) filter (where c_acctbal >= 4500) as positive, count(*) filter (where c_acctbal < 4500) as negative,
 count(*) = 12 as meets_quota, count(*) filter (where c_acctbal >= 4500) = count(*) filter (where c_acctbal < 4500) as balanced from customer join nation on c_nationkey = n_nationkey group by all
""")
def q37b_quota(t: Tables) -> DataFrame:
    """Sites by group and class against a quota."""
    return cohort.quota(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name", "c_mktsegment", F.col("c_acctbal") >= 4500, 12)


@query(f"""
with {_PLACES}, f as (select *, round(lat, 7) as y, round(lon, 7) as x from places), n as (select min(c_custkey) as c_custkey, y, x from f where c_custkey % 3 <> 0 and not exists (select 1 from f e where e.c_custkey % 3 = 0 and e.y = f.y and e.x = f.x) group by y, x)
select c_custkey, round(y, 6) as lat, round(x, 6) as lon, row_number() over (order by c_custkey) + 499 as number from n
""")
def q38_append_candidates(t: Tables) -> DataFrame:
    """Candidates at new places, numbered on."""
    places = _places(t)
    out = cohort.append_candidates(places.where("c_custkey % 3 = 0"), places.where("c_custkey % 3 <> 0"), "c_custkey", "lat", "lon", 500)
    return _R(out.withColumn("number", F.col("number").cast("long")))


@query("""
with r as (select case l_linenumber % 2 when 0 then 'nadir' else 'oblique' end as geometry, 3000e0 * (1 + l_linenumber % 4) as altitude_m, l_quantity * l_extendedprice / 100 / (3000e0 * (1 + l_linenumber % 4)) as v from lineitem)
select altitude_m, geometry, round(median(v), 6) as median, round(max(v), 6) as maximum, count(v) as n from r group by grouping sets ((), (altitude_m), (geometry))
""")
def q39_relief(t: Tables) -> DataFrame:
    """Relief displacement overall, by altitude and by geometry."""
    rows = t.lineitem.select(pick(F.col("l_linenumber") % 2, "nadir", "oblique").alias("geometry"), (3000.0 * (1 + F.col("l_linenumber") % 4)).alias("altitude_m"), "l_quantity", "l_extendedprice")
    return _R(cohort.spread(rows, cohort.displacement_px(F.col("l_quantity") * F.col("l_extendedprice") / 100, F.lit(1.0), F.col("altitude_m")), "altitude_m", "geometry"))


_GATES = "g as (select l_returnflag as stratum, abs(date_diff('day', o_orderdate, l_shipdate)) <= 60 as g1, l_discount >= 0.02 as g2, l_quantity >= 5 as g3, l_tax <= 0.07 as g4 from lineitem join orders on l_orderkey = o_orderkey)"


def _gates(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return cohort.gates(rows.withColumnRenamed("l_returnflag", "stratum"), g1=F.abs(F.date_diff("l_shipdate", "o_orderdate")) <= 60, g2=F.col("l_discount") >= 0.02, g3=F.col("l_quantity") >= 5, g4=F.col("l_tax") <= 0.07)


@query(f"""
with {_GATES}, s as (select stratum, unnest([struct_pack(scenario := 'all', ok := g1 and g2 and g3 and g4), struct_pack(scenario := 'g1', ok := g2 and g3 and g4), struct_pack(scenario := 'g2', ok := g1 and g3 and g4), struct_pack(scenario := 'g3', ok := g1 and g2 and g4), struct_pack(scenario := 'g4', ok := g1 and g2 and g3)]) as s from g)
select s.scenario as scenario, stratum, count(*) filter (where s.ok) as accepted, count(*) as total from s group by all
""")
def q40_gate_ablation(t: Tables) -> DataFrame:
    """What each gate takes."""
    return cohort.gate_ablation(_gates(t), ["g1", "g2", "g3", "g4"], "stratum")


@query(f"with {_GATES}, r as (select stratum, unnest(case when g1 and g2 and g3 and g4 then ['none'] else [x for x in [case when not g1 then 'G1' end, case when not g2 then 'G2' end, case when not g3 then 'G3' end, case when not g4 then 'G4' end] if x is not null] end) as reason from g) select stratum, reason, count(*) as n from r group by all")
def q40b_gate_reasons(t: Tables) -> DataFrame:
    """Reasons of rejection by stratum."""
    return _gates(t).select("stratum", F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("none")))).alias("reason")).groupBy("stratum", "reason").agg(F.count(F.lit(1)).alias("n"))


_VOTES = "votes as (select o_orderkey as view, a as auditor, (o_orderkey * 31 + a * 17) % 11 < 2 as overlay_misaligned, (o_custkey + a * 5) % 7 = 0 as unresolvable, (o_orderkey + a) % 13 = 0 as edit_artifact from orders, (select unnest([1, 2]) as a))"


def _votes(t: Tables) -> DataFrame:
    o, c, a = F.col("o_orderkey"), F.col("o_custkey"), F.col("auditor")
    rows = t.orders.select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("auditor"))
    return rows.select(o.alias("view"), "auditor", ((o * 31 + a * 17) % 11 < 2).alias("overlay_misaligned"), ((c + a * 5) % 7 == 0).alias("unresolvable"), ((o + a) % 13 == 0).alias("edit_artifact"))


@query(f"""
with {_VOTES}, l as (unpivot votes on overlay_misaligned, unresolvable, edit_artifact into name field value v), e as (select field, view, count(*) as n, count(*) filter (where v) as k from l group by all)
select field, count(*) as views, cast(sum(n) as bigint) as votes, round(avg(case when k = 0 or k = n then 1e0 else 0e0 end), 6) as agreement, round(sum(k) / cast(sum(n) as double), 6) as prevalence, cast(sum(k) as bigint) as failure_votes, count(*) filter (where k > 0) as failure_views from e group by 1
""")
def q41_audit_agreement(t: Tables) -> DataFrame:
    """Agreement and votes of two auditors."""
    return _R(Q.audit_summary(_votes(t), ["view"], ["overlay_misaligned", "unresolvable", "edit_artifact"]))


@query(f"""
with {_VOTES}, e as (select view, count(*) as n, count(*) filter (where not unresolvable) as k from votes group by 1), m as (select e.*, case when o_orderkey % 10 = 0 then null when o_orderstatus = 'F' then 'extinction' when o_orderstatus = 'O' then 'positive' else 'negative' end as case_type from e join orders on view = o_orderkey)
select coalesce(case_type, 'unmatched') as case_type, count(*) as views, round(avg(cast(k = 0 as int)), 6) as confirmed, round(avg(cast(k = n as int)), 6) as contradicted, round(sum(k) / cast(sum(n) as double), 6) as seen_rate from m group by 1
""")
def q42_band_validation(t: Tables) -> DataFrame:
    """Whether auditors see nothing where nothing should be seen."""
    votes = _votes(t).withColumn("seen", ~F.col("unresolvable"))
    views = t.orders.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("view"), F.when(F.col("o_orderstatus") == "F", "extinction").when(F.col("o_orderstatus") == "O", "positive").otherwise("negative").alias("case_type"))
    return _R(Q.band_validation(votes, views, ["view"], "case_type", "seen"))


@query("""
with i as (
 select 'duplicate_key' as code, 'error' as severity, l_orderkey || '/' || l_linenumber as artifact from lineitem group by l_orderkey, l_linenumber having count(*) > 1
 union all select 'discount_high', 'warning', cast(l_orderkey as varchar) from lineitem where l_discount > 0.095
 union all select 'order_without_lines', 'error', cast(o_orderkey as varchar) from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
 union all select 'shipped_before_ordered', 'error', cast(l_orderkey as varchar) from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate
 union all select 'missing_line', 'warning', k.o_orderkey || '/' || n from (select distinct o_orderkey from orders) k, range(1, 5) r(n) where not exists (select 1 from lineitem where l_orderkey = k.o_orderkey and l_linenumber = n))
select code, severity, count(*) as n, min(artifact) as first_artifact from i group by all
""")
def q43_rules(t: Tables) -> DataFrame:
    """Issues of several rules, counted."""
    lines = t.lineitem
    dup = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    orders = t.orders.select("o_orderkey", "o_orderdate")
    present = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"))
    gaps = Q.missing_combinations(present, orders.select("o_orderkey"), line=[1, 2, 3, 4])
    found = Q.all_issues(
        Q.issues(dup, "duplicate_key", "error", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))),
        Q.issues(lines.where("l_discount > 0.095"), "discount_high", "warning", F.col("l_orderkey")),
        Q.issues(orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti"), "order_without_lines", "error", F.col("o_orderkey")),
        Q.issues(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate"), "shipped_before_ordered", "error", F.col("l_orderkey")),
        Q.issues(gaps, "missing_line", "warning", F.concat_ws("/", F.col("o_orderkey").cast("string"), F.col("line").cast("string"))),
    )
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("artifact").alias("first_artifact"))


@query("""
select sha256(cast(page_id as varchar)) as opaque_id, sha256(page_id || chr(0) || coalesce(url, '')) as content_sha256 from pages where url not like 'https:%'
""")
def q44_escrow(t: Tables) -> DataFrame:
    """Hashes alone of what may not be given out."""
    return Q.release(t.pages, F.col("url").startswith("https:"), ["page_id", "url"], F.col("page_id"))[1]


@query(f"with {SCORED}, m as (select model, avg(p_yes) as mean_p, avg(latency_s) as latency, cast(count(*) as double) as n from scored group by 1) select model, metric, round(value, 6) as value from (unpivot m on mean_p, latency, n into name metric value value)")
def q44b_tidy_metrics(t: Tables) -> DataFrame:
    """Measures as rows."""
    wide = scored(t).groupBy("model").agg(F.avg("p_yes").alias("mean_p"), F.avg("latency_s").alias("latency"), F.count(F.lit(1)).alias("n"))
    return _R(Q.tidy(wide, ["model"], ["mean_p", "latency", "n"]))


@query("""
with e as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as e from customer), b as (select c_custkey, c_acctbal, len([x for x in e if c_acctbal > x]) as bin from customer, e),
j as (select bin, ln(o_totalprice + 1) as y, c_acctbal / 1000 as x from b join orders on c_custkey = o_custkey)
select cast(bin as int) as bin, count(*) as n, round(avg(y), 6) as mean_y, round(case when count(*) >= 3 and count(distinct x) >= 2 then regr_slope(y, x) end, 6) as slope from j group by 1
""")
def q45_stratified_trends(t: Tables) -> DataFrame:
    """Slopes inside quantile bins."""
    bins = Q.quantile_bins(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 4, "bin")
    rows = bins.join(t.orders.select("o_custkey", "o_totalprice"), F.col("c_custkey") == F.col("o_custkey")).select("bin", F.log(F.col("o_totalprice") + 1).alias("y"), (F.col("c_acctbal") / 1000).alias("x"))
    slope = F.when((F.count(F.lit(1)) >= 3) & (F.count_distinct("x") >= 2), F.regr_slope("y", "x"))
    return _R(rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), slope.alias("slope")))


@query("""
with p as (select p_partkey, p_size, case when p_partkey % 17 <> 0 then (p_partkey * 7919 % 10007) / 10007e0 end as p from part),
r as (select *, row_number() over (partition by p_size, p is null order by p, p_partkey) as rk, count(p) over (partition by p_size, p is null) as m from p),
q as (select *, min(p * m / rk) over (partition by p_size, p is null order by rk desc rows unbounded preceding) as q from r)
select p_partkey, round(p, 6) as p, round(case when p is not null then least(1, q) end, 6) as q from q
""")
def q46_benjamini_hochberg(t: Tables) -> DataFrame:
    """False discovery rates within families."""
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", "p_size", F.when(k % 17 != 0, k * 7919 % 10007 / F.lit(10007.0)).alias("p"))
    return _R(inference.benjamini_hochberg(rows, "p", "p_size").select("p_partkey", "p", "q"))


#: As many replicates as the reported intervals take.
REPLICATES = 2_000


def _weights_sql(units: str, seed: int) -> str:
    """Common table expressions up to drawn(r, unit, w), from a query for (g, unit)."""
    draw = lambda parts: f"cast('0x' || substr(md5('{seed}:' || {parts}), 1, 8) as bigint)"
    return f"""
own as (select g, unit, row_number() over (partition by g order by unit) - 1 as pos, count(*) over (partition by g) as size from (select distinct g, unit from ({units}))),
grp as (select g, max(size) as size, row_number() over (order by g) - 1 as number from own group by g),
slot as (select r, k, {draw("r || ':' || k")} % (select count(*) from grp) as number from range({REPLICATES}) x(r), (select number as k from grp)),
place as (select r, k, g, size, unnest(range(size)) as s from slot join grp using (number)),
drawn as (select r, unit, count(*) as w from (select r, g, {draw("r || ':' || k || ':' || s")} % size as pos from place) join own using (g, pos) group by all)"""


@query(f"""
with {SCORED}, {_weights_sql("select r_name as g, cast(s_suppkey as varchar) as unit from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey", 7)},
sums as (select model, cast(site_id as varchar) as unit, sum(predicted) as a, sum(1e0) as b from scored where predicted is not null and not true_positive group by all),
each as (select model, r, sum(w * a) / nullif(sum(w * b), 0) as x from sums join drawn using (unit) group by all),
i as (select model, count(x) as iterations, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high from each where x is not null group by 1)
select model, round(e.estimate, 6) as estimate, round(low, 6) as low, round(high, 6) as high, iterations from (select model, sum(a) / nullif(sum(b), 0) as estimate from sums group by 1) e join i using (model)
""")
def q47_hierarchical_bootstrap(t: Tables) -> DataFrame:
    """Interval of the false positive rate, resampling groups and then sites in them."""
    rows = scored(t).where("predicted is not null and not true_positive").select("model", "site_id", "predicted", F.lit(1.0).alias("one"))
    sites = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "s_suppkey")
    return _R(inference.bootstrap_ratio(rows, inference.bootstrap_weights(t.spark, sites, REPLICATES, 7), "site_id", "predicted", "one", "model"))


@query(f"""
with {_weights_sql("select 'all' as g, strftime(l_shipdate, '%Y-%m') as unit from lineitem", 11)},
sums as (select strftime(l_shipdate, '%Y-%m') as unit, sum(l_extendedprice) as a, sum(1e0) as b from lineitem group by 1),
each as (select r, sum(w * a) / nullif(sum(w * b), 0) as x from sums join drawn using (unit) group by all)
select (select round(sum(a) / sum(b), 6) from sums) as estimate, round(quantile_cont(x, 0.025), 6) as low, round(quantile_cont(x, 0.975), 6) as high, count(x) as iterations from each
""")
def q48_segment_bootstrap(t: Tables) -> DataFrame:
    """Interval of mean price a line, resampling ship modes of time (months)."""
    rows = t.lineitem.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", F.lit(1.0).alias("one"))
    return _R(inference.bootstrap_ratio(rows, inference.bootstrap_weights(t.spark, rows.select(F.lit("all"), "month"), REPLICATES, 11), "month", "l_extendedprice", "one"))


@query(f"""
with {SCORED}, m as (select model, site_id, avg(p_yes) filter (where variant = 'clean') as a, avg(p_yes) filter (where variant = 'degraded') as b from scored group by all), d as (select model, a - b as d from m where a is not null and b is not null)
select model, count(*) as n_sites, round(avg(d), 6) as mean_difference, round(case when count(*) >= 2 then stddev_samp(d) / sqrt(count(*)) end, 6) as standard_error, round(case when count(*) >= 2 and stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end, 6) as t from d group by 1
""")
def q49_paired_comparison(t: Tables) -> DataFrame:
    """Clean against degraded by site."""
    return _R(inference.paired_comparison(scored(t), "site_id", "variant", "p_yes", "clean", "degraded", "model"))


@query(f"""
with {SCORED}, m as (select model, site_id, avg(p_yes) filter (where variant = 'clean') as a, avg(p_yes) filter (where variant = 'degraded') as b from scored group by all), d as (select model, a - b as d from m where a is not null and b is not null),
c as (select model, count(*) as n_sites, avg(d) as mean_difference, case when count(*) >= 2 then stddev_samp(d) / sqrt(count(*)) end as standard_error, count(*) - 1 as df from d group by 1),
t as (select *, case when standard_error > 0 then mean_difference / standard_error end as t from c), p as (select *, {t_p_sql('t', 'df')} as p from t),
k as (select *, row_number() over (partition by p is null order by p) as rk, count(p) over () as m from p), q as (select *, min(p * m / rk) over (partition by p is null order by rk desc rows unbounded preceding) as q from k)
select model, 'paired' as family, n_sites, round(mean_difference, 6) as mean_difference, round(standard_error, 6) as standard_error, round(t, 6) as t, round(p, 6) as p, round(case when p is not null then least(1, q) end, 6) as q from q
""")
def q49b_paired_p_values(t: Tables) -> DataFrame:
    """The same with two-sided p-values of Student's t and their false discovery rates."""
    rows = inference.paired_comparison(scored(t), "site_id", "variant", "p_yes", "clean", "degraded", "model").withColumn("p", inference.t_p_value(F.col("t"), (F.col("n_sites") - 1).cast("double")))
    return _R(inference.benjamini_hochberg(rows.withColumn("family", F.lit("paired")), "p", "family"))


@query(f"""
with {SCORED}, m as (select model, site_id, avg(p_yes) as x, avg(latency_s) as y from scored group by all),
r as (select model, rank() over (partition by model order by x) + (count(*) over (partition by model, x) - 1) / 2e0 as rx, rank() over (partition by model order by y) + (count(*) over (partition by model, y) - 1) / 2e0 as ry from (select model, round(x, 9) as x, round(y, 9) as y from m))
select model, count(*) as n, round(case when count(*) >= 3 then corr(rx, ry) end, 6) as rho from r group by 1
""")
def q50_spearman(t: Tables) -> DataFrame:
    """Rank correlation over sites."""
    means = scored(t).groupBy("model", "site_id").agg(F.round(F.avg("p_yes"), 9).alias("x"), F.round(F.avg("latency_s"), 9).alias("y"))
    return _R(inference.spearman(means, "x", "y", "model"))


@query(None)
def q51_acuity(t: Tables) -> DataFrame:
    """Width at which answers turn positive: a logistic fit on the log of width."""
    rows = scored(t).where("width_px > 0")
    out = inference.grouped_logistic(rows, F.log("width_px"), "predicted", "model")
    return _R(out.withColumn("threshold_width_px", F.when(F.abs("slope") > 1e-9, F.exp(-F.col("intercept") / F.col("slope")))))


@query(f"""
with {SCORED}, r as (select model, true_positive as y, rank() over (partition by model order by p_yes) + (count(*) over (partition by model, p_yes) - 1) / 2e0 as rk from scored),
s as (select model, sum(rk) filter (where y) as r, count(*) filter (where y) as p, count(*) filter (where not y) as q from r group by 1)
select model, round((r - p * (p + 1) / 2e0) / nullif(p * q, 0), 6) as auc, p + q as n from s
""")
def q52_roc_auc(t: Tables) -> DataFrame:
    """Area under the ROC curve of stated probabilities."""
    return _R(inference.roc_auc(scored(t), "true_positive", "p_yes", "model"))


@query(f"""
with {SCORED}, b as (select target_class, avg(cast(true_positive as int)) filter (where site_id % 5 = 0) as rate from scored group by 1),
p as (select target_class, true_positive as y, unnest(['always_yes', 'always_no', 'base_rate']) as baseline, rate from scored join b using (target_class) where site_id % 5 <> 0)
select baseline, target_class, count(*) as n, round(avg(case when (case baseline when 'always_yes' then true when 'always_no' then false else rate >= 0.5 end) = y then 1e0 else 0e0 end), 6) as accuracy from p group by all
""")
def q53_baselines(t: Tables) -> DataFrame:
    """Always yes, always no, and the development sites' majority of a class."""
    rows = scored(t).select("target_class", "site_id", "true_positive")
    rates = rows.where("site_id % 5 = 0").groupBy("target_class").agg(F.avg(F.col("true_positive").cast("int")).alias("rate"))
    says = F.explode(F.array(F.struct(F.lit("always_yes").alias("baseline"), F.lit(True).alias("says")), F.struct(F.lit("always_no").alias("baseline"), F.lit(False).alias("says")), F.struct(F.lit("base_rate").alias("baseline"), (F.col("rate") >= 0.5).alias("says"))))
    each = rows.where("site_id % 5 <> 0").join(F.broadcast(rates), "target_class").select("target_class", "true_positive", says.alias("s"))  # one row a class
    return _R(each.groupBy("s.baseline", "target_class").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("s.says") == F.col("true_positive")).cast("double")).alias("accuracy")))


@query(None)
def q53b_geographic_prior(t: Tables) -> DataFrame:
    """A logistic prior on place, fitted on development sites and scored on the others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = t.customer.select("c_custkey", (F.col("c_acctbal") > 4500).cast("double").alias("label"), (F.col("c_nationkey") / 25).alias("lon"), (F.col("c_custkey") % 97 / 97).alias("lat"))
    table = VectorAssembler(inputCols=["lon", "lat"], outputCol="features").transform(rows)
    train = table.where("c_custkey % 5 = 0")
    n = train.count()
    model = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=50).fit(train)
    return _R(model.transform(table.where("c_custkey % 5 <> 0")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")))


@query(f"""
with {SCORED}, m as (select model, count(*) filter (where predicted is not null) as n, count(distinct site_id) filter (where predicted is not null) as sites, count(distinct predicted) as outcomes from scored group by 1)
select model, n, sites, case when n < 100 then 'too_few_rows' when sites < 10 then 'too_few_sites' when outcomes < 2 then 'one_outcome' else 'eligible' end as status from m
""")
def q54_mixed_effects_status(t: Tables) -> DataFrame:
    """Whether a mixed model could be fitted; none is, as Spark has none."""
    ok = F.col("predicted").isNotNull()
    out = scored(t).groupBy("model").agg(F.count(F.when(ok, 1)).alias("n"), F.count_distinct(F.when(ok, F.col("site_id"))).alias("sites"), F.count_distinct("predicted").alias("outcomes"))
    return out.select("model", "n", "sites", F.when(F.col("n") < 100, "too_few_rows").when(F.col("sites") < 10, "too_few_sites").when(F.col("outcomes") < 2, "one_outcome").otherwise("eligible").alias("status"))


@query(None)
def q55_edit_classifier(t: Tables) -> DataFrame:
    """Can edits be told from originals? A forest over grouped folds, and its ROC area on held-out folds."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    e = t.embeddings.select("vec_id", (F.col("label") % 2).cast("double").alias("label"), (F.col("vec_id") % 3).alias("fold"), *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(8)])
    table = VectorAssembler(inputCols=[f"x{i}" for i in range(8)], outputCol="features").transform(e)
    out = None
    for fold in range(3):
        model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=7).fit(table.where(F.col("fold") != fold))
        got = model.transform(table.where(F.col("fold") == fold)).select("label", vector_to_array("probability")[1].alias("score"))
        out = got if out is None else out.unionByName(got)
    return _R(inference.roc_auc(out, "label", "score"))


@query(None)
def q56_clustered_ols(t: Tables) -> DataFrame:
    """Linear association with errors clustered by site."""
    rows = scored(t).select("site_id", "p_yes", "width_px", F.log("gsd").alias("log_gsd"))
    return _R(inference.clustered_ols(rows, "p_yes", ["width_px", "log_gsd"], "site_id"))
