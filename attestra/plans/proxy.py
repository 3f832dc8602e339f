"""Stand-ins for the evaluation tables, derived from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.plans.registry import Tables

SEQUENCES = ("screening", "oracle_deletion", "distractor_deletion", "self_deletion", "self_sufficiency", "random_control", "texture_control")
FOV, WIDTH_PX = 60.0, 768


def pick(index, *names):
    out = F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        out = F.when(index == k, names[k]).otherwise(out)
    return out


def scored(t: Tables) -> DataFrame:
    """One row per scored answer. Dimensions are joined by their keys; only columns in use are read."""
    site = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("site_id"), F.col("r_name").alias("site_group"))
    part = t.part.select("p_partkey", F.col("p_size").alias("p_size"))
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    rows = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(site, F.col("l_suppkey") == F.col("site_id"))
    answer = F.when(F.col("l_partkey") % 10 == 0, "abstain").when(F.col("l_partkey") % 2 == 0, "yes").otherwise("no")
    confidence = F.floor(F.col("l_quantity") * 2).cast("int")
    altitude = 3000.0 * (1 + F.round(F.col("l_discount") * 100))
    return rows.select(
        F.col("l_returnflag").alias("model"),
        F.when(F.col("l_linestatus") == "O", "clean").otherwise("degraded").alias("variant"),
        "site_id", "site_group",
        (F.col("p_size") % 2).alias("view_id"),
        pick(F.col("p_partkey") % 3, "water", "road", "field").alias("target_class"),
        (F.col("o_orderstatus") != "F").alias("true_positive"),
        answer.alias("answer"), confidence.alias("confidence"),
        (F.col("l_linenumber") / F.lit(7.0)).alias("fraction"),
        pick(F.floor(F.col("l_quantity")).cast("int") % 7, *SEQUENCES).alias("sequence"),
        pick(F.col("l_orderkey") % 2, "neutral_v4", "false_premise_v4").alias("prompt_id"),
        pick(F.col("l_orderkey") % 3, "blur", "texture", "frequency").alias("operator"),
        F.col("p_size").cast("double").alias("width_px"),
        (F.col("p_size") <= 2).alias("extinction"),
        altitude.alias("altitude_m"), S.ground_sample_m(altitude, FOV, WIDTH_PX).alias("gsd"),
        (F.col("l_extendedprice") / 1e6).alias("cost_usd"), F.col("l_tax").alias("latency_s"),
        (F.col("l_orderkey") % 5 == 0).alias("cache_hit"), (F.col("l_partkey") % 1500).alias("input_tokens"),
        (F.col("l_suppkey") % 100).alias("output_tokens"), (1 + F.col("l_linenumber") % 3).alias("attempts"),
        (F.col("l_orderkey") % 97 == 0).alias("format_failure"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        S.yes_probability(answer, confidence).alias("p_yes"), S.binary_answer(answer).alias("predicted"),
    )


SCORED = """
scored as (
select l_returnflag as model, case when l_linestatus = 'O' then 'clean' else 'degraded' end as variant,
 s_suppkey as site_id, r_name as site_group, p_size % 2 as view_id,
 case p_partkey % 3 when 0 then 'water' when 1 then 'road' else 'field' end as target_class,
 o_orderstatus <> 'F' as true_positive,
 case when l_partkey % 10 = 0 then 'abstain' when l_partkey % 2 = 0 then 'yes' else 'no' end as answer,
 cast(floor(l_quantity * 2) as int) as confidence, l_linenumber / 7e0 as fraction,
 case cast(floor(l_quantity) as int) % 7 when 0 then 'screening' when 1 then 'oracle_deletion' when 2 then 'distractor_deletion' when 3 then 'self_deletion' when 4 then 'self_sufficiency' when 5 then 'random_control' else 'texture_control' end as sequence,
 case when l_orderkey % 2 = 0 then 'neutral_v4' else 'false_premise_v4' end as prompt_id,
 case l_orderkey % 3 when 0 then 'blur' when 1 then 'texture' else 'frequency' end as operator,
 cast(p_size as double) as width_px, p_size <= 2 as extinction,
 3000e0 * (1 + round(l_discount * 100)) as altitude_m,
 2 * 3000e0 * (1 + round(l_discount * 100)) * tan(radians(60e0) / 2) / 768e0 as gsd,
 l_extendedprice / 1e6 as cost_usd, l_tax as latency_s, l_orderkey % 5 = 0 as cache_hit,
 l_partkey % 1500 as input_tokens, l_suppkey % 100 as output_tokens, 1 + l_linenumber % 3 as attempts,
 l_orderkey % 97 = 0 as format_failure, l_orderkey as order_id, l_linenumber as line, l_partkey as part_id,
 case when l_partkey % 10 = 0 then 0.5e0 when l_partkey % 2 = 0 then floor(l_quantity * 2) / 100e0 else 1 - floor(l_quantity * 2) / 100e0 end as p_yes,
 case when l_partkey % 10 = 0 then null when l_partkey % 2 = 0 then 1e0 else 0e0 end as predicted
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
"""


def t_p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, by the finite series in the cosine of atan(t / sqrt(df))."""
    cos, sin, angle = f"(1 / sqrt(1 + {t} * {t} / {df}))", f"(abs({t}) / sqrt({df} + {t} * {t}))", f"atan(abs({t}) / sqrt({df}))"
    term = lambda up, down, power: f"exp(lgamma({up}) - lgamma({down})) * pow({cos}, {power})"
    even = f"{sin} * coalesce(list_sum([{term('k + 0.5e0', 'k + 1e0', '2 * k')} for k in range({df} // 2)]), 0) / sqrt(pi())"
    odd = f"2 / pi() * ({angle} + {sin} * coalesce(list_sum([{term('k + 1e0', 'k + 1.5e0', '2 * k + 1')} for k in range(({df} - 1) // 2)]), 0) * sqrt(pi()) / 2)"
    return f"case when {t} is not null and {df} > 0 then 1 - case when {df} % 2 = 0 then {even} else {odd} end end"
