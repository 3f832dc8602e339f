"""Joins that must match, checks of frames and releases, reliability, trial costs, forms of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import forms
from attestra.operators import records as R
from attestra.operators.scoring import rounded as _R
from attestra.plans.proxy import SCORED, scored
from attestra.plans.registry import Tables, query


@query("""
with m as (select p_partkey, p_size, p_retailprice, l.n as lines, l.q as mean_quantity from part join (select l_partkey, count(*) as n, avg(l_quantity) as q from lineitem group by 1) l on p_partkey = l_partkey)
select p_size, count(*) as views, cast(sum(lines) as bigint) as lines, round(avg(mean_quantity), 6) as mean_quantity, round(avg(p_retailprice), 6) as mean_price from m group by 1
""")
def q02b_metadata_join(t: Tables) -> DataFrame:
    """Index rows with their manifest and quality records."""
    lines = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("lines"), F.avg("l_quantity").alias("mean_quantity"))
    index = t.part.select("p_partkey", "p_size").join(lines.select("p_partkey"), "p_partkey", "left_semi")
    rows = R.metadata(index, t.part.select("p_partkey", "p_retailprice"), lines, ["p_partkey"])
    return _R(rows.groupBy("p_size").agg(F.count(F.lit(1)).alias("views"), F.sum("lines").alias("lines"), F.avg("mean_quantity").alias("mean_quantity"), F.avg("p_retailprice").alias("mean_price")))


@query(f"""
with {SCORED}, b as (select model, confidence / 100e0 as c, (predicted = 1) = true_positive as ok from scored where predicted is not null),
k as (select model, greatest(0, least(cast(ceil(c * 10) as int) - 1, 9)) as bin, count(*) as n, avg(c) as mc, avg(cast(ok as int)) as acc from b group by all),
g as (select model, cast(bin as int) as bin from (select distinct model from b), range(10) r(bin))
select g.model as model, g.bin as bin, round(g.bin / 10e0, 6) as lower, round((g.bin + 1) / 10e0, 6) as upper, coalesce(n, 0) as n, round(mc, 6) as mean_confidence, round(acc, 6) as accuracy from g left join k on g.model = k.model and g.bin = k.bin
""")
def q21b_reliability(t: Tables) -> DataFrame:
    """Stated confidence against accuracy by bin."""
    rows = scored(t).where("predicted is not null")
    return _R(R.reliability(rows, F.col("confidence") / 100.0, (F.col("predicted") == 1) == F.col("true_positive"), 10, "model"))


@query("""
with f as (select case when o_orderkey % 50 = 0 then 'pic' else 'img' end || '_' || lpad(cast(o_orderkey as varchar), cast(greatest(6, len(cast(o_orderkey as varchar))) as int), '0') || '.jpg' as image,
 o_orderkey + cast(o_orderkey % 41 = 0 as int) as elapsed_s, o_orderstatus as phase, o_custkey % 200 - 95 as lat, o_custkey % 400 - 190 as lon, o_custkey % 1000 as segment_id, o_orderkey % 2 as split, o_totalprice / 300000 as cover,
 o_orderkey % 3 = 0 as reliable, case when o_orderkey % 4 <> 0 then ['0,1', '3,' || (o_orderkey % 5), '2,' || (o_orderkey % 4)] end as cells, case o_orderkey % 37 when 0 then 'maybe' when 1 then null else 'yes' end as water, o_custkey % 77 as spatial_block from orders),
i as (select unnest([case when not coalesce(regexp_full_match(image, 'img_[0-9]{6,}[.]jpg') and try_cast(substr(image, 5, len(image) - 8) as bigint) = elapsed_s, false) then 'image_second_mismatch' end,
  case when phase not in ('F', 'O') then 'unscored_phase' end, case when not (lat between -90 and 90 and lon between -180 and 180) then 'invalid_coordinate' end, case when lat = 0 or lon = 0 then 'zero_gps' end,
  case when not cover between 0 and 1 then 'invalid_cover' end, case when reliable and cells is null then 'missing_grid' end, case when not reliable and cells is not null then 'unreliable_grid' end,
  case when cells is not null and (cells[2] = '3,4' or len(list_distinct(cells)) < 3) then 'invalid_grid' end, case when coalesce(water not in ('yes', 'no', 'uncertain'), true) then 'invalid_presence' end]) as code, image as artifact from f
 union all select 'duplicate_image', null where exists (select 1 from f group by image having count(*) > 1) union all select 'duplicate_second', null where exists (select 1 from f group by elapsed_s having count(*) > 1)
 union all select 'spatial_leakage', null where exists (select 1 from f group by spatial_block having count(distinct split) > 1) union all select 'segment_leakage', null where exists (select 1 from f group by segment_id having count(distinct split) > 1)
 union all select 'missing_mask_file', image from f where elapsed_s % 7 = 0 union all select 'manifest_count', null where (select count(*) from f) <> 1 union all select 'manifest_segments', null where (select count(distinct segment_id) from f) <> 1)
select code, 'error' as severity, count(*) as n, min(artifact) as first_artifact from i where code is not null group by 1
""")
def q43c_frame_rules(t: Tables) -> DataFrame:
    """Faults of a table of frames, counted."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.lpad(o.cast("string"), F.greatest(F.lit(6), F.length(o.cast("string"))), F.lit("0"))
    frames = t.orders.select(
        F.concat(F.when(o % 50 == 0, "pic").otherwise("img"), F.lit("_"), number, F.lit(".jpg")).alias("image"), (o + (o % 41 == 0).cast("int")).alias("elapsed_s"), F.col("o_orderstatus").alias("phase"),
        (c % 200 - 95).alias("lat"), (c % 400 - 190).alias("lon"), (c % 1000).alias("segment_id"), (o % 2).alias("split"), (F.col("o_totalprice") / 300000).alias("cover"), (o % 3 == 0).alias("reliable"),
        F.when(o % 4 != 0, F.array(F.lit("0,1"), F.concat(F.lit("3,"), (o % 5).cast("string")), F.concat(F.lit("2,"), (o % 4).cast("string")))).alias("cells"),
        F.when(o % 37 == 0, "maybe").when(o % 37 != 1, "yes").alias("water"), (c % 77).alias("spatial_block"),
    )
    masks = frames.where("elapsed_s % 7 <> 0").select(F.lit("mask").alias("kind"), F.regexp_replace("image", "jpg$", "png").alias("name"))
    files = masks.unionByName(frames.select(F.lit("image").alias("kind"), F.col("image").alias("name")))
    found = R.frame_issues(frames, ["F", "O"], ["water"], files, {"n_frames": 1, "effective_segment_count": 1})
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("artifact").alias("first_artifact"))


@query("""
with a as (select case when page_id % 11 = 0 then '../' else 'pages/' end || page_id as path, sha256(html) as sha256, strlen(html) as size_bytes from pages where page_id % 7 <> 0),
b as (select case when page_id % 11 = 0 then '../' else 'pages/' end || page_id as path, sha256(html) as sha256, strlen(html) + cast(page_id % 13 = 0 as int) as size_bytes from pages where page_id % 5 <> 0),
j as (select coalesce(a.path, b.path) as path, case when a.path is null then 'untracked' when a.path like '../%' then 'unsafe_path' when b.path is null then 'missing' when a.sha256 <> b.sha256 or a.size_bytes <> b.size_bytes then 'changed' end as fault from a full join b on a.path = b.path)
select path, fault from j where fault is not null
""")
def q44d_release_faults(t: Tables) -> DataFrame:
    """Where a release's list and its files differ. Each side lacks some files; that is the case to be found."""
    k = F.col("page_id")
    made = t.pages.select("page_id", F.concat(F.when(k % 11 == 0, "../").otherwise("pages/"), k.cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size_bytes"))
    return R.release_faults(made.where(k % 7 != 0).drop("page_id"), made.where(k % 5 != 0).withColumn("size_bytes", F.col("size_bytes") + (k % 13 == 0).cast("int")).drop("page_id"))


@query(f"""
with {SCORED} select model, count(*) as calls, count(*) filter (where format_failure) as format_failures, round(avg(cast(format_failure as int)), 6) as format_failure_rate, round(avg(input_tokens), 6) as mean_input_tokens, round(avg(output_tokens), 6) as mean_output_tokens,
 max(input_tokens) as max_input_tokens, round(avg(cost_usd), 6) as usd_per_call, round(sum(cost_usd), 6) as usd_total, round(median(latency_s), 6) as median_latency_s, avg(input_tokens) > 0 as tokens_reported from scored group by 1
""")
def q18b_price_pilot(t: Tables) -> DataFrame:
    """What a trial run cost."""
    return _R(R.price_pilot(scored(t), "model"))


@query("""
with p as (select o_orderkey as k, 'Mark {target} on a {n}x{n} grid, {{at most}} {k}' as template, o_orderpriority as target, o_orderkey % 8 + 2 as n from orders),
q as (select k, replace(replace(replace(replace(replace(template, '{target}', target), '{n}', cast(n as varchar)), '{{', '['), '}}', ']'), '{k}', cast(k as varchar)) as t, target from p)
select k, replace(replace(t, '[', '{'), ']', '}') as prompt, 'EP__' || trim(regexp_replace(upper(target), '[^A-Z0-9]+', '_', 'g'), '_') as variable,
 replace(replace(replace(replace(replace(replace(t || '_$5 & 3%', '[', '{'), ']', '}'), '&', '\\&'), '%', '\\%'), '$', '\\$'), '_', '\\_') as latex,
 case when k % 3 = 0 then 'src:' || k else 'src:sha256:' || substr(sha256(target), 1, 24) end as feature_id,
 sha256('m' || chr(0) || case when k % 2 = 0 then 'NO_IMAGE' else target end || chr(0) || 's' || chr(0) || replace(replace(t, '[', '{'), ']', '}') || chr(0) || '0' || chr(0) || '256' || chr(0) || 'None' || chr(0) || '{}') as call_key from q
""")
def q33d_forms(t: Tables) -> DataFrame:
    """Prompts, names, ids and keys made of orders."""
    k, target = F.col("o_orderkey"), F.col("o_orderpriority")
    text = forms.prompt(F.lit("Mark {target} on a {n}x{n} grid, {{at most}} {k}"), target=target, n=k % 8 + 2, k=k)
    key = forms.call_key(F.lit("m"), target, F.when(k % 2 == 0, "no_image").otherwise("plain"), F.lit("s"), text, F.lit(0), F.lit(256), F.lit(None), F.lit("{}"))
    properties = F.when(k % 3 == 0, F.create_map(F.lit("OBJECTID"), k.cast("string"), F.lit("OID"), F.lit(""))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return t.orders.select(
        k.alias("k"), text.alias("prompt"), forms.variable_name("EP__", target).alias("variable"), forms.latex(F.concat(text, F.lit("_$5 & 3%"))).alias("latex"),
        forms.feature_id(properties, target, "src").alias("feature_id"), key.alias("call_key"),
    )


@query("""
with a as (select l_orderkey, l_linenumber, [(l_partkey % 10) || ',' || (l_suppkey % 8), (l_partkey % 3) || ',' || (l_suppkey % 2)] as e, case when l_linenumber % 2 = 0 then [(l_partkey % 3) || ',' || (l_suppkey % 2), (l_partkey % 10) || ',' || (l_suppkey % 8)] else ['0,0'] end as r from lineitem),
f as (select *, unnest([case when e[1] = e[2] then 'evidence_repeats' end, case when len(r) = 2 and r[1] = r[2] then 'ranking_repeats' end, case when cast(split_part(e[1], ',', 1) as int) > 7 then 'outside_grid' end,
 case when len([x for x in e if not list_contains(r, x)]) + len([x for x in r if not list_contains(e, x)]) > 0 then 'ranking_differs' end, case when len(e) > 1 then 'over_budget' end]) as fault from a)
select fault, count(*) as n from f where fault is not null group by 1
""")
def q19c_answer_faults(t: Tables) -> DataFrame:
    """What is wrong with the cells that answers name."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    far, near = F.concat_ws(",", (p % 10).cast("string"), (s % 8).cast("string")), F.concat_ws(",", (p % 3).cast("string"), (s % 2).cast("string"))
    ranking = F.when(F.col("l_linenumber") % 2 == 0, F.array(near, far)).otherwise(F.array(F.lit("0,0")))
    return t.lineitem.select(F.explode(forms.answer_faults(F.array(far, near), ranking, 8, 1)).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("""
with q as (select l_returnflag as flag, quantile_cont(l_quantity, 0.95) as s95, quantile_cont(l_quantity, 0.05) as s05, quantile_cont(l_discount, 0.95) as d95, quantile_cont(l_discount, 0.25) as d25, quantile_cont(l_tax, 0.05) as t05, quantile_cont(l_tax, 0.5) as t50, quantile_cont(l_tax, 0.95) as t95 from lineitem group by 1)
select flag, round(greatest(1.2, least(3.5, sqrt(s95 / greatest(s05, 1)) / 2)), 6) as blur_max, round(greatest(0.18, least(0.5, 0.15 + d95 - d25)), 6) as haze_max, round(greatest(0.3, least(0.85, t05 / greatest(t50, 1e-3))), 6) as saturation_min, round(greatest(0.3, least(0.85, t05 / greatest(t50, 1e-3))), 6) as contrast_min,
 cast(floor(greatest(20, least(60, 75 - t95 * 600))) as int) as jpeg_min, round(greatest(-2, least(-0.4, log2(greatest(t05, 0.02) / 0.5))), 6) as dark_ev, round(greatest(0.4, least(2, log2(greatest(s95 / 50, 0.5) / 0.5))), 6) as bright_ev from q
""")
def q39b_degradation_limits(t: Tables) -> DataFrame:
    """Strengths of degradations from quantiles of measures."""
    of = lambda c, p: F.percentile(c, p)
    q = {
        "laplacian_variance_95": of("l_quantity", 0.95), "laplacian_variance_05": of("l_quantity", 0.05), "dark_channel_mean_95": of("l_discount", 0.95), "dark_channel_mean_25": of("l_discount", 0.25),
        "saturation_mean_05": of("l_tax", 0.05), "saturation_mean_50": of("l_tax", 0.5), "contrast_std_05": of("l_tax", 0.05), "contrast_std_50": of("l_tax", 0.5), "jpeg_blockiness_95": of("l_tax", 0.95),
        "luminance_mean_05": of("l_tax", 0.05), "luminance_mean_95": of("l_quantity", 0.95) / 50,
    }
    return _R(t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(*[c.alias(n) for n, c in forms.degradation_limits(q).items()]))
