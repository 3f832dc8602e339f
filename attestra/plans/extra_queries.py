"""Further queries over the scored, site and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators import extras as X
from attestra.operators import scoring as P
from attestra.operators.scoring import rounded as _R
from attestra.plans.proxy import SCORED, scored
from attestra.plans.registry import Tables, query
from attestra.plans.scoring_queries import _KEYS, _area_sql, _causal_sql
from attestra.plans.site_queries import _places

_ON = "model, step"


@query(f"""
with {SCORED}, e as (select distinct model, {_KEYS} from scored where sequence <> 'screening'),
c as (select model, {_KEYS}, max(confidence) as c from scored where sequence = 'screening' and variant = 'clean' group by all),
r as (select c.*, row_number() over (partition by model order by c desc, {_KEYS}) as rn, count(*) over (partition by model) as n from c semi join e using (model, {_KEYS})),
k as (select *, unnest(range(1, 11)) as step from r), chosen as (select * from k where rn <= greatest(1, round_even(n * step / 10e0, 0))),
cov as (select model, step, count(*) / cast(max(n) as double) as coverage, cast(min(c) as double) as confidence_threshold from chosen group by all),
sel as (select scored.*, step from scored join chosen using (model, {_KEYS})),
base as (select model, step, {_KEYS}, avg(p_yes) as baseline from sel where sequence = 'screening' and variant = 'clean' and prompt_id like '%neutral%' group by all),
{_area_sql("model, step, sequence", source="sel", on=_ON)}, {_causal_sql(_ON, "sel", "base", _ON).rpartition("select " + _ON)[0].rstrip()},
fin as (select * from areas_z) select model, cast(step as int) as step, round(coverage, 6) as coverage, confidence_threshold, round(ocrs, 6) as ocrs, round(sen, 6) as sen, round(ses, 6) as ses, round(efs, 6) as efs, round(ocrs - efs, 6) as osg from fin join cov using (model, step)
""")
def q10c_selective_causal(t: Tables) -> DataFrame:
    """The causal summary over the most confident tenths of views."""
    return _R(X.selective_causal(scored(t), "model", P.VIEW_KEYS))


@query(f"""
with {SCORED}, v as (select model, site_id, avg(predicted) as x from scored where not true_positive and predicted is not null group by all),
d as (select p.model as a, q.model as b, p.x - q.x as d from v p join v q on p.site_id = q.site_id and p.model < q.model)
select a, b, count(*) as n_sites, round(avg(d), 6) as mean_difference, round(case when count(*) >= 2 and stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end, 6) as t from d group by all
""")
def q49c_model_pairs(t: Tables) -> DataFrame:
    """False positive rates of every two models by site."""
    values = scored(t).where("not true_positive and predicted is not null").groupBy("model", "site_id").agg(F.avg("predicted").alias("x"))
    return _R(X.model_pairs(values, "model", "site_id", "x"))


@query(f"""
with {SCORED}, v as (select operator, site_id, round(avg(p_yes), 9) as x from scored group by all), j as (select p.operator as a, q.operator as b, p.x as x, q.x as y from v p join v q on p.site_id = q.site_id and p.operator < q.operator),
r as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2e0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2e0 as ry from j)
select a, b, count(*) as n, round(case when count(*) >= 3 then corr(rx, ry) end, 6) as rho from r group by all
""")
def q50b_operator_agreement(t: Tables) -> DataFrame:
    """Do operators rank sites alike?"""
    values = scored(t).groupBy("operator", "site_id").agg(F.round(F.avg("p_yes"), 9).alias("x"))
    return _R(X.operator_agreement(values, "operator", "site_id", "x"))


_AUC = "(select model, (sum(rk) filter (where label) - count(*) filter (where label) * (count(*) filter (where label) + 1) / 2e0) / nullif(count(*) filter (where label) * count(*) filter (where not label), 0) as auc from (select model, label, rank() over (partition by model order by {c}) + (count(*) over (partition by model, {c}) - 1) / 2e0 as rk from f) group by 1)"


@query(f"""
with {SCORED}, e as (select model, {_KEYS}, bool_or(true_positive) as label, avg(p_yes) filter (where sequence = 'screening') as before, avg(p_yes) filter (where sequence = 'oracle_deletion' and fraction = 1) as after from scored group by all),
f as (select model, label, round(before, 9) as before, round(case when not label then coalesce(after, before) else after end, 9) as after from e where before is not null and (not label or after is not null))
select m.model as model, round(mean_before, 6) as mean_before, round(mean_after, 6) as mean_after, round(x.auc, 6) as auc_before, round(y.auc, 6) as auc_after
from (select model, avg(before) as mean_before, avg(after) as mean_after from f group by 1) m join {_AUC.format(c="before")} x on m.model = x.model join {_AUC.format(c="after")} y on m.model = y.model
""")
def q52b_suppression(t: Tables) -> DataFrame:
    """What removing all evidence does to answers and to their ranking."""
    return _R(X.suppression(scored(t), "model", P.VIEW_KEYS))


@query("""
with p as (select o_orderkey, case o_orderkey % 4 when 0 then 'Is there any Road here?' when 1 then 'Roads or water?' when 2 then 'Mark water' else 'Look' end || ' Use a ' || (o_orderkey % 3 * 2 + 4) || 'x' || (case when o_orderkey % 5 = 0 then 9 else o_orderkey % 3 * 2 + 4 end) || ' grid, ' || case when o_orderkey % 2 = 0 then 'at most ' else 'up to ' end || (o_orderkey % 7) || ' cells' as t from orders),
x as (select o_orderkey, lower(t) as t from p), c as (select *, regexp_matches(t, '\\broads?\\b') as r, regexp_matches(t, '\\bwaters?\\b') as w, regexp_extract(t, '(\\d+)x(\\d+)', 1) as g1, regexp_extract(t, '(\\d+)x(\\d+)', 2) as g2 from x)
select o_orderkey, case when r and not w then 'road' when w and not r then 'water' end as target_class, case when g1 = g2 then cast(g1 as int) end as grid, cast(regexp_extract(t, '(?:at most|up to)\\s+(\\d+)', 1) as int) as max_cells from c
""")
def q33c_prompt_parse(t: Tables) -> DataFrame:
    """Class, grid and cell limit of prompts."""
    k = F.col("o_orderkey")
    size = (k % 3 * 2 + 4).cast("string")
    ask = F.when(k % 4 == 0, "Is there any Road here?").when(k % 4 == 1, "Roads or water?").when(k % 4 == 2, "Mark water").otherwise("Look")
    text = F.concat(ask, F.lit(" Use a "), size, F.lit("x"), F.when(k % 5 == 0, F.lit("9")).otherwise(size), F.lit(" grid, "), F.when(k % 2 == 0, "at most ").otherwise("up to "), (k % 7).cast("string"), F.lit(" cells"))
    return t.orders.select("o_orderkey", text.alias("t")).withColumns(X.parse_prompt(F.col("t"), ["road", "water"])).drop("t")


@query("select page_id, strlen(html) as size, sha256(html) as sha256 from pages")
def q44c_inventory(t: Tables) -> DataFrame:
    """Sizes and digests of contents."""
    return t.pages.select("page_id", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("sha256"))


@query("""
select l_returnflag as stratum, round(avg(abs(l_extendedprice / 1000 - p_retailprice) / greatest((abs(l_extendedprice / 1000) + abs(p_retailprice)) / 2, 1e-6)), 6) as smd_price,
 round(avg(abs(l_quantity - p_size) / greatest((abs(l_quantity) + abs(p_size)) / 2, 1e-6)), 6) as smd_size from lineitem join part on l_partkey = p_partkey group by 1
""")
def q43b_balance(t: Tables) -> DataFrame:
    """Standardized differences of matched regions."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    price, size = X.standardized_difference(F.col("l_extendedprice") / 1000, F.col("p_retailprice")), X.standardized_difference(F.col("l_quantity"), F.col("p_size"))
    return _R(rows.groupBy(F.col("l_returnflag").alias("stratum")).agg(F.avg(price).alias("smd_price"), F.avg(size).alias("smd_size")))


@query("""
with n as (select o_custkey, o_orderkey, 'Clip' || (o_orderkey % 13) || '_part' || o_orderkey from orders)
select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey % 13, o_orderkey) as int) as place from n
""")
def q27b_natural_order(t: Tables) -> DataFrame:
    """Clips in the order of the numbers in their names."""
    name = F.concat(F.lit("Clip"), (F.col("o_orderkey") % 13).cast("string"), F.lit("_part"), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(X.natural_key(name))).alias("place"))


@query("""
with i as (select vec_id, cast(embedding[k + 1] as double) as x, k from embeddings, range(64) r(k)), o as (select *, row_number() over (partition by vec_id order by x desc, k) as rn from i)
select vec_id, string_agg((k // 8) || ',' || (k % 8), ' ' order by rn) as cells from o where rn <= 5 group by 1
""")
def q19b_top_cells(t: Tables) -> DataFrame:
    """The five cells with the largest scores."""
    return t.embeddings.select("vec_id", F.array_join(X.top_cells(F.col("embedding"), 8, 5), " ").alias("cells"))


@query("""
with w as (select unnest(['trail', 'road', 'river']) as feature, unnest([2e0, 12e0, 60e0]) as width_m), a as (select unnest([3000e0, 6000e0, 12000e0, 24000e0]) as altitude_m)
select r_name, feature, altitude_m, round(width_m / (2 * altitude_m * tan(radians(60e0) / 2) / 768), 6) as apparent_px, width_m / (2 * altitude_m * tan(radians(60e0) / 2) / 768) < 1 as extinct from region, w, a
""")
def q35b_extinction_ladder(t: Tables) -> DataFrame:
    """At which altitude features become narrower than a pixel."""
    widths = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(m).alias("width_m")) for n, m in (("trail", 2.0), ("road", 12.0), ("river", 60.0))]))
    rows = t.region.select("r_name", widths.alias("w")).select("r_name", "w.*", F.explode(F.array(*[F.lit(a) for a in (3000.0, 6000.0, 12000.0, 24000.0)])).alias("altitude_m"))
    px = F.col("width_m") / S.ground_sample_m(F.col("altitude_m"), 60.0, 768)
    return _R(rows.select("r_name", "feature", "altitude_m", px.alias("apparent_px"), (px < 1).alias("extinct")))


@query(None)
def q36c_spaced_sites(t: Tables) -> DataFrame:
    """Sites of each nation no two of which are within twenty kilometres."""
    return X.spaced(_places(t), "c_nationkey", "c_custkey", "lat", "lon", 20_000, 5)


@query(f"with {SCORED}, m as (select model, avg(p_yes) as a, avg(latency_s) as b from scored group by 1) select case when model = 'A' then 'frontier' else 'open' end as model_class, count(*) as models, round(avg(a), 6) as mean_p, round(avg(b), 6) as mean_latency from m group by 1")
def q04b_model_classes(t: Tables) -> DataFrame:
    """Means of models' measures by class of model."""
    each = scored(t).groupBy("model").agg(F.avg("p_yes").alias("a"), F.avg("latency_s").alias("b"))
    return _R(each.groupBy(F.when(F.col("model") == "A", "frontier").otherwise("open").alias("model_class")).agg(F.count(F.lit(1)).alias("models"), S.finite_mean(F.col("a")).alias("mean_p"), S.finite_mean(F.col("b")).alias("mean_latency")))
