"""Queries 24 to 34: tracks, agreement, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import probes
from attestra.operators import trajectory as T
from attestra.operators.scoring import rounded as _R
from attestra.plans.registry import Tables, query


def telemetry(t: Tables) -> DataFrame:
    """Events as telemetry of one track a user; the clock starts anew every week, positions are sometimes missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    lat = F.when(k == 0, 0.0).when(k == 1, None).otherwise(34 + F.col("value") / 500)
    return t.events.select(
        F.col("user_id").alias("track"), F.col("event_id").alias("seq"), F.floor(seconds).cast("long").alias("second"), (seconds % 604800).alias("elapsed_s"),
        T.canonical_phase(F.when(F.col("event_type") == "click", " launching").when(F.col("event_type") == "view", "FLOATING").when(F.col("event_type") == "purchase", "Terminating").when(F.col("event_type") == "signup", "initialising").otherwise("Ground")).alias("phase"),
        lat.alias("lat"), (-110 + k / 100).alias("lon"), F.lit(0.0).alias("speed"), F.col("value").alias("alt"), (F.col("event_id") * 2654435761 % 4294967296).alias("phash"),
    )


_TELEMETRY = """
telemetry as (select user_id as track, event_id as seq, cast(floor((epoch_us(ts) - 1704067200000000) / 1e6) as bigint) as second, ((epoch_us(ts) - 1704067200000000) / 1e6) % 604800 as elapsed_s,
 case event_type when 'click' then 'Launching' when 'view' then 'Floating' when 'purchase' then 'Terminating' when 'signup' then 'Initializing' else 'Ground' end as phase,
 case cast(props->>'k' as int) when 0 then 0e0 when 1 then null else 34 + value / 500 end as lat, -110 + cast(props->>'k' as int) / 100e0 as lon, 0e0 as speed, value as alt, event_id * 2654435761 % 4294967296 as phash from events),
seg as (select *, cast(sum(back) over (partition by track order by seq rows unbounded preceding) as int) as segment_id from (select *, case when elapsed_s < lag(elapsed_s) over (partition by track order by seq) then 1 else 0 end as back from telemetry))"""
_AUDIT = """
firsts as (select track, segment_id, count(*) as row_count, min(elapsed_s) as start_s, max(elapsed_s) as end_s, count(*) filter (where lat <> 0 and lon <> 0) as valid_gps_rows,
 coalesce(min(seq) filter (where phase = 'Launching') <= min(seq) filter (where phase = 'Floating') and min(seq) filter (where phase = 'Floating') <= min(seq) filter (where phase = 'Terminating'), false) as in_order from seg group by all),
audit as (select *, in_order and row_number() over (partition by track order by in_order desc, row_count desc, segment_id desc) = 1 as selected from firsts)"""


def _segmented(t: Tables) -> DataFrame:
    return T.reset_segments(telemetry(t), "track", "seq", "elapsed_s")


def _operational(t: Tables) -> DataFrame:
    rows = _segmented(t)
    audit = T.segment_audit(rows, "track", "seq", "elapsed_s", "lat", "lon").where("selected").select("track", "segment_id")
    return rows.join(audit, ["track", "segment_id"], "left_semi")


@query(f"with {_TELEMETRY} select track, segment_id, count(*) as n, round(max(elapsed_s), 6) as last_s from seg group by all")
def q24_reset_segments(t: Tables) -> DataFrame:
    """Sessions between clock resets."""
    return _R(_segmented(t).groupBy("track", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.max("elapsed_s").alias("last_s")))


@query(f"with {_TELEMETRY}, {_AUDIT} select track, segment_id, row_count, round(start_s, 6) as start_s, round(end_s, 6) as end_s, valid_gps_rows, in_order, selected from audit")
def q25_operational_segment(t: Tables) -> DataFrame:
    """Audit of sessions and the operational one of each track."""
    return _R(T.segment_audit(_segmented(t), "track", "seq", "elapsed_s", "lat", "lon"))


@query(f"""
with {_TELEMETRY}, {_AUDIT}, op as (select seg.* from seg join audit using (track, segment_id) where selected and lat <> 0 and lon <> 0),
d as (select *, cast(round_even(elapsed_s, 0) as bigint) as clock, case when (min(lat) over w < max(lat) over w or min(lon) over w < max(lon) over w) and min(speed) over w = 0 and max(speed) over w = 0 then null else speed end as live,
 case when (min(lat) over w < max(lat) over w or min(lon) over w < max(lon) over w) and min(alt) over w = 0 and max(alt) over w = 0 then null else alt end as alt_ from op window w as (partition by track))
select track, clock as elapsed_s, phase, round(lat, 6) as lat, round(lon, 6) as lon, live as speed, round(alt_, 6) as alt from d qualify row_number() over (partition by track, clock order by seq desc) = 1
""")
def q26_clean_telemetry(t: Tables) -> DataFrame:
    """Valid positions of operational sessions, a row a second, dead channels blank."""
    rows = _operational(t).select("track", "elapsed_s", "seq", "phase", "lat", "lon", "speed", "alt")
    return _R(T.clean(rows, "track", "seq", "elapsed_s", "lat", "lon", ["speed", "alt"]).drop("seq"))


@query("""
with c as (select o_custkey as track, o_orderkey as clip, cast(o_orderkey % 90 + 10 as bigint) as duration, sum(cast(o_orderkey % 90 + 10 as bigint)) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) as end_s from orders),
f as (select track, clip, cast(end_s - duration as bigint) as start_s, cast(end_s as bigint) as end_s, cast((end_s - duration) // 60 as bigint) as minute from c)
select track, minute, clip, start_s, end_s from f qualify row_number() over (partition by track, minute order by clip desc) = 1
""")
def q27_clip_timeline(t: Tables) -> DataFrame:
    """Clips laid end to end; of clips that begin in one minute the last stays."""
    clips = t.orders.select(F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("clip"), "o_orderdate", (F.col("o_orderkey") % 90 + 10).alias("duration"))
    laid = T.timeline(clips, "track", ["o_orderdate", "clip"], "duration").withColumn("minute", F.floor(F.col("start_s") / 60))
    return T.keep_last(laid.select("track", "minute", "clip", "start_s", "end_s"), ["track", "minute"], ["clip"])


@query("""
with r as (select l_orderkey as k, count(*) as n from lineitem where l_quantity > 40 group by 1)
select o_orderstatus, case when n is null then 'unmatched' when n = 1 then 'one' else 'many' end as match, count(*) as n from orders left join r on o_orderkey = k group by all
""")
def q28_join_audit(t: Tables) -> DataFrame:
    """Frames that meet one telemetry row, several, or none."""
    right = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.join_audit(t.orders.select("o_orderkey", "o_orderstatus"), right, ["o_orderkey"], "o_orderstatus")


@query("""
with w as (select min(l_shipdate) as a, max(l_shipdate) as b from lineitem where l_returnflag = 'A'), e as (select lineitem.* from lineitem, w where l_shipdate between a and b and l_quantity >= 5)
select l_linestatus, count(*) as n, """ + ", ".join(f"round(quantile_cont({c}, {q}), 6) as {n}_{int(q * 100)}" for n, c in (("price", "l_extendedprice"), ("quantity", "l_quantity")) for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from e group by 1")
def q29_quality_quantiles(t: Tables) -> DataFrame:
    """Five quantiles of measures over rows whose midpoint is in the eligible period."""
    span = t.lineitem.where("l_returnflag = 'A'").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    rows = t.lineitem.crossJoin(F.broadcast(span)).where("l_shipdate between a and b and l_quantity >= 5")  # span is one row
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    aggs = [F.percentile(c, F.array(*[F.lit(q) for q in qs])).alias(n) for n, c in (("price", "l_extendedprice"), ("quantity", "l_quantity"))]
    out = rows.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), *aggs)
    return _R(out.select("l_linestatus", "n", *[F.col(n)[i].alias(f"{n}_{int(q * 100)}") for n in ("price", "quantity") for i, q in enumerate(qs)]))


@query("""
with p as (select l_orderkey, count(*) as n_lines, max(l_discount) > 0.08 as cloud_heavy, max(l_tax) > 0.07 as clarity_heavy, min(l_quantity) < 3 as partial from lineitem group by 1),
m as (select o_orderkey, o_orderstatus, n_lines, nullif(concat_ws('+', case when cloud_heavy then 'cloud_heavy' end, case when clarity_heavy then 'clarity_heavy' end, case when partial then 'partial' end), '') as exclusion_reason
 from orders join p on o_orderkey = l_orderkey) select * from m
""")
def q30_master_table(t: Tables) -> DataFrame:
    """Frames with their labels and why they are left out, if they are."""
    flags = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), (F.max("l_discount") > 0.08).alias("a"), (F.max("l_tax") > 0.07).alias("b"), (F.min("l_quantity") < 3).alias("c"))
    rows = t.orders.select("o_orderkey", "o_orderstatus").join(flags, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select("o_orderkey", "o_orderstatus", "n_lines", T.exclusion_reason(cloud_heavy=F.col("a"), clarity_heavy=F.col("b"), partial=F.col("c")).alias("exclusion_reason"))


_HAV = "2 * 6371000e0 * asin(sqrt(least(1, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query(f"""
with recursive {_TELEMETRY}, v as (select track, second, lat, lon, phash, row_number() over (partition by track order by second) as rn from telemetry where lat <> 0 qualify row_number() over (partition by track, second order by seq desc) = 1),
n as (select *, row_number() over (partition by track order by second) as i from v),
s as (select track, i, second, lat, lon, phash, 'first' as reason from n where i = 1
 union all
 select s.track, n.i, case when k then n.second else s.second end, case when k then n.lat else s.lat end, case when k then n.lon else s.lon end, case when k then n.phash else s.phash end, case when k then r end
 from s join n on n.track = s.track and n.i = s.i + 1,
 lateral (select {_HAV.format(a='s', b='n')} >= 150000 as moved, bit_count(xor(s.phash, n.phash)) > 18 as changed, n.second - s.second >= 200000 as forced) t,
 lateral (select concat_ws('+', case when moved then 'distance' end, case when changed then 'perceptual' end, case when forced then 'max_interval' end) as r) q, lateral (select n.second - s.second >= 3600 and r <> '' as k) z)
select track, second, reason from s where reason is not null
""")
def q31_thinning(t: Tables) -> DataFrame:
    """Frames kept by distance, change and time from the last one kept."""
    rows = telemetry(t).where("lat <> 0").select("track", "second", "seq", "lat", "lon", "phash")
    return T.thin(T.keep_last(rows, ["track", "second"], ["seq"]), "track", "second", "lat", "lon", "phash", 150_000, 18, 3600, 200_000)


@query(f"""
with recursive {_TELEMETRY}, v as (select track, second, lat, lon, phase from telemetry where lat <> 0 qualify row_number() over (partition by track, second order by seq desc) = 1),
n as (select *, row_number() over (partition by track order by second) as i from v),
s as (select track, i, second, lat, lon, phase, second as start_s, 0 as segment_no from n where i = 1
 union all
 select n.track, n.i, n.second, n.lat, n.lon, n.phase, case when c then n.second else s.start_s end, s.segment_no + cast(c as int)
 from s join n on n.track = s.track and n.i = s.i + 1,
 lateral (select n.second - s.second > 40000 or {_HAV.format(a='s', b='n')} > 60000 or n.phase <> s.phase or n.second - s.start_s >= 50000 as c) t)
select track, segment_no, count(*) as n, min(second) as start_s, max(second) as end_s from s group by all
""")
def q31b_segments(t: Tables) -> DataFrame:
    """Segments bounded by gaps, jumps, phases and duration."""
    rows = telemetry(t).where("lat <> 0").select("track", "second", "seq", "lat", "lon", "phase")
    out = T.segments(T.keep_last(rows, ["track", "second"], ["seq"]), "track", "second", "lat", "lon", "phase", 40_000, 60_000, 50_000)
    return out.groupBy("track", "segment_no").agg(F.count(F.lit(1)).alias("n"), F.min("second").alias("start_s"), F.max("second").alias("end_s"))


@query("""
with j as (select source, quality as a, toxic as b from labels join documents using (doc_id)), c as (select source, a, b, count(*) as n from j group by all),
t as (select source, sum(n) as total, sum(n) filter (where a = b) as same from c group by 1), l as (select source, a as v, sum(n) as x from c group by all), r as (select source, b as v, sum(n) as y from c group by all),
e as (select source, sum(x * y) as chance from l join r using (source, v) group by 1),
k as (select source, total, coalesce(same, 0) / cast(total as double) as po, coalesce(chance, 0) / cast(total * total as double) as pe from t left join e using (source))
select source, cast(total as bigint) as n, round(po, 6) as observed, round(case when pe >= 1 then case when po >= 1 then 1e0 else 0e0 end else (po - pe) / (1 - pe) end, 6) as kappa from k
""")
def q32_kappa(t: Tables) -> DataFrame:
    """Agreement of two annotators beyond chance."""
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return _R(probes.cohen_kappa(rows, "quality", "toxic", "source"))


@query("""
with c as (select l_orderkey, l_returnflag as v, count(*) as n from lineitem group by all), m as (select *, max(n) over (partition by l_orderkey) as top from c),
r as (select l_orderkey, count(*) as ties, min(v) as v from m where n = top group by 1) select case when ties > 1 then 'uncertain' else v end as vote, count(*) as n from r group by 1
""")
def q32b_majority_vote(t: Tables) -> DataFrame:
    """Most frequent vote by item, ties being uncertain."""
    return probes.majority(t.lineitem, "l_orderkey", "l_returnflag").groupBy("vote").agg(F.count(F.lit(1)).alias("n"))


_TERMS = {"definite": ["the", "der", "die", "das", "le", "la"], "plain": ["of", "und", "et", "de"]}


@query(None)
def q33_caption_assertions(t: Tables) -> DataFrame:
    """What captions say of each feature; negations and hedges count in the five words before a term."""
    return probes.caption_assertions(t.documents.select("doc_id", "text"), "text", _TERMS).drop("text")


@query("""
with v as (select l_orderkey as item, l_returnflag as said, mode(l_linestatus) as m from lineitem group by all),
p as (select l_orderkey as item, l_linestatus as s, count(*) as n from lineitem group by all),
a as (select item, s as adjudicated from p qualify row_number() over (partition by item order by n desc, s) = 1),
j as (select o_orderkey as item, case when o_orderstatus = 'F' then 'F' else 'O' end as predicted from orders)
select count(*) as n, round(avg(cast(predicted = adjudicated as int)), 6) as agreement,
 round(count(*) filter (where predicted = 'O' and adjudicated = 'O') / cast(count(*) filter (where predicted = 'O') as double), 6) as precision,
 round(count(*) filter (where predicted = 'O' and adjudicated = 'O') / cast(count(*) filter (where adjudicated = 'O') as double), 6) as recall
from j join a using (item)
""")
def q33b_judge_validation(t: Tables) -> DataFrame:
    """A judge's labels against adjudicated ones; of equally frequent votes the smallest stands."""
    truth = t.lineitem.groupBy(F.col("l_orderkey").alias("item")).agg(F.mode("l_linestatus", True).alias("adjudicated"))
    rows = t.orders.select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("predicted")).join(truth, "item")
    p, a = F.col("predicted") == "O", F.col("adjudicated") == "O"
    n = lambda c: F.count(F.when(c, 1))
    return _R(rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("adjudicated")).cast("int")).alias("agreement"), (n(p & a) / n(p)).alias("precision"), (n(p & a) / n(a)).alias("recall")))


@query(f"""
with {_TELEMETRY}, v as (select track, second, lat, lon, segment_id from seg where lat <> 0 qualify row_number() over (partition by track, second order by seq desc) = 1),
b as (select *, cast(floor(lat / (5000e0 / 111320e0)) as bigint) || ':' || cast(floor(lon / (5000e0 / (111320e0 * greatest(cos(radians(lat)), 0.1e0)))) as bigint) as spatial_block from v),
h as (select *, cast(cast('0x' || substr(sha256('2026:' || spatial_block), 1, 16) as ubigint) as double) / 18446744073709551616e0 as u from b),
s as (select *, case when u < 0.7e0 then 'train' when u < 0.7e0 + 0.15e0 then 'validation' else 'test' end as split from h),
c as (select *, case when segment_id <> lag(segment_id) over w or split <> lag(split) over w then 1 else 0 end as c from s window w as (partition by track order by second))
select track, second, spatial_block, split, cast(sum(c) over (partition by track order by second rows unbounded preceding) as int) as refined from c
""")
def q34_spatial_splits(t: Tables) -> DataFrame:
    """Splits by spatial block, and segments cut where the split changes."""
    rows = T.keep_last(_segmented(t).where("lat <> 0").select("track", "second", "seq", "lat", "lon", "segment_id"), ["track", "second"], ["seq"])
    return T.geographic_splits(rows, "track", "second", "lat", "lon", "segment_id").select("track", "second", "spatial_block", "split", "refined")
