"""Sites: lattices of views, separation, quotas, leakage, candidates, gates, relief."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import scalars as S
from attestra.operators.logs import running_total


def view_lattice(sites: DataFrame, altitudes_m: list[float], geometries: list[str], fov: float, width_px: int) -> DataFrame:
    """Every site at every altitude and geometry, with view_id, ground width and ground resolution."""
    views = [F.struct(F.lit(float(a)).alias("altitude_m"), F.lit(g).alias("geometry"), F.lit(f"view_a{a / 1000:g}km_{g}".replace(".", "p")).alias("view_id")) for a in altitudes_m for g in geometries]
    rows = sites.withColumn("_v", F.explode(F.array(*views))).select("*", "_v.*").drop("_v")
    gsd = S.ground_sample_m(F.col("altitude_m"), fov, width_px)
    return rows.withColumns({"gsd": gsd, "ground_width_m": gsd * width_px})


def _close_places(sites: DataFrame, lat: str, lon: str, metres: float, max_lat: float) -> DataFrame:
    """Pairs (p, q, distance_m) of distinct places nearer than `metres`, each once (p not after q), and every place with itself.

    Places are put in cells at least that wide at every latitude up to max_lat, so a pair is in neighbouring
    cells; one side goes to its nine neighbours and the join is on cells. Sites at the same place are one here, so
    a distance is taken once for all of them.
    """
    dlat = metres / 110_000.0
    dlon = dlat / max(math.cos(math.radians(max_lat)), 0.01)
    at = sites.select(F.col(lat).alias("y"), F.col(lon).alias("x")).where("y is not null and x is not null").distinct()
    at = at.withColumns({"r": F.floor(F.col("y") / dlat), "c": F.floor(F.col("x") / dlon)})
    around = F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = at.select(F.col("y").alias("y2"), F.col("x").alias("x2"), F.explode(around).alias("n")).select("y2", "x2", "n.r", "n.c")
    p, q = F.struct(F.col("y"), F.col("x")), F.struct(F.col("y2").alias("y"), F.col("x2").alias("x"))
    d = S.haversine_m(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"))
    return at.join(other, ["r", "c"]).where(p <= q).select(p.alias("p"), q.alias("q"), d.alias("distance_m")).where(F.col("distance_m") < metres)


def close_pairs(sites: DataFrame, key: str, lat: str, lon: str, metres: float, max_lat: float, digits: int | None = None) -> DataFrame:
    """Pairs (a < b) of sites nearer than `metres`, with the distance, rounded if digits are given.

    Pairs of distinct places are found first and then given their sites, so that a candidate is tested, and a
    distance taken and rounded, once for all sites of two places. What is left is the pairs themselves.
    """
    near = _close_places(sites, lat, lon, metres, max_lat)
    if digits is not None:
        near = near.withColumn("distance_m", F.round("distance_m", digits))
    place = F.struct(F.col(lat).alias("y"), F.col(lon).alias("x"))
    own = sites.where(F.col(key).isNotNull()).select(place.alias("p"), F.col(key).alias("k"))
    near = near.withColumn("same", F.col("p") == F.col("q"))
    met = near.join(own.hint("shuffle_hash"), "p").drop("p").join(own.toDF("q", "k2").hint("shuffle_hash"), "q").where("k < k2 or not same and k <> k2")
    return met.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), "distance_m")


#: Keys of sites at one place and of one split that are in one row.
KEYS = 50_000


def close_splits(sites: DataFrame, key: str, split: str, lat: str, lon: str, metres: float, max_lat: float) -> DataFrame:
    """By splits of the site with the smaller key and of the other one ("a/b"): pairs of sites of different splits nearer
    than `metres`, and the least distance.

    Pairs are counted, not made: of two places, how many keys of one are below keys of the other is told by their
    sorted keys. Keys of a place are dealt to rows of about KEYS.
    """
    near = _close_places(sites, lat, lon, metres, max_lat)
    place = F.struct(F.col(lat).alias("y"), F.col(lon).alias("x"))
    rows = sites.where(F.col(key).isNotNull() & F.col(split).isNotNull()).select(place.alias("p"), F.col(split).alias("s"), F.col(key).alias("k"))
    many = rows.groupBy("p", "s").agg(F.ceil(F.count(F.lit(1)) / KEYS).alias("parts")).where("parts > 1")
    dealt = rows.join(many, ["p", "s"], "left").withColumn("part", F.pmod(F.xxhash64("k"), F.coalesce("parts", F.lit(1))))
    own = dealt.groupBy("p", "s", "part").agg(F.array_sort(F.collect_list("k")).alias("ks")).drop("part")
    met = near.join(own, "p").join(own.toDF("q", "s2", "ks2"), "q").where("p = q and s < s2 or p <> q and s <> s2")

    def count(batches):
        for batch in batches:
            below, above = [], []
            for x, y in zip(batch.column(3), batch.column(4)):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                at, to = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right")
                below.append(int(at.sum()))
                above.append(len(x) * len(y) - int(to.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(below, pa.int64()), pa.array(above, pa.int64())], ["s", "s2", "distance_m", "below", "above"])

    kind = sites.schema[split].dataType.simpleString()
    n = met.select("s", "s2", "distance_m", "ks", "ks2").mapInArrow(count, f"s {kind}, s2 {kind}, distance_m double, below long, above long")
    each = F.explode(F.array(F.struct(F.col("s").alias("sa"), F.col("s2").alias("sb"), F.col("below").alias("n")), F.struct(F.col("s2").alias("sa"), F.col("s").alias("sb"), F.col("above").alias("n"))))
    n = n.select("distance_m", each.alias("e")).select("distance_m", "e.*").where("n > 0")
    return n.groupBy(F.concat_ws("/", "sa", "sb").alias("splits")).agg(F.sum("n").alias("n"), F.min("distance_m").alias("nearest_m"))


def leakage(rows: DataFrame, identifier: str, split: str, site: str) -> DataFrame:
    """Identifiers that sites of more than one split share."""
    out = rows.groupBy(F.col(identifier).alias("identifier")).agg(F.array_join(F.array_sort(F.collect_set(split)), "+").alias("splits"), F.count_distinct(split).alias("n_splits"), F.count_distinct(site).alias("n_sites"))
    return out.where("n_splits > 1")


def quota(rows: DataFrame, group: str, cls: str, positive: Column, per_class: int) -> DataFrame:
    """Sites by group and class: how many, whether as many as asked, and whether positives and negatives balance."""
    p, n = F.count(F.when(positive, 1)), F.count(F.when(~positive, 1))
    return rows.groupBy(F.col(group).alias("site_group"), F.col(cls).alias("target_class")).agg(F.count(F.lit(1)).alias("n"), p.alias("positive"), n.alias("negative"), (F.count(F.lit(1)) == per_class).alias("meets_quota"), (p == n).alias("balanced"))


def append_candidates(existing: DataFrame, found: DataFrame, key: str, lat: str, lon: str, first: int) -> DataFrame:
    """Candidates at places (to seven decimals) that aren't listed yet, one for a place, numbered from `first`."""
    place = lambda d: d.withColumn("_p", F.struct(F.round(lat, 7).alias("y"), F.round(lon, 7).alias("x")))
    new = place(found).join(place(existing).select("_p"), "_p", "left_anti")
    one = new.groupBy("_p").agg(F.min(key).alias(key)).select(key, F.col("_p.y").alias(lat), F.col("_p.x").alias(lon))
    return running_total(one, key, F.lit(1), 100_000, "_n").withColumn("number", F.col("_n") - 1 + first).drop("_n")


def gates(rows: DataFrame, **passed: Column) -> DataFrame:
    """Adds a column for each gate, accepted (all of them hold) and reasons (names of those that don't)."""
    rows = rows.withColumns(passed)
    accepted = F.lit(True)
    for name in passed:
        accepted = accepted & F.col(name)
    return rows.withColumns({"accepted": accepted, "reasons": F.array_compact(F.array(*[F.when(~F.col(n), n.upper()) for n in passed]))})


def gate_ablation(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
    """Accepted and total with all gates and with each one left out, in one pass."""
    scenarios = [F.struct(F.lit(s).alias("scenario"), _all([n for n in names if n != s]).alias("ok")) for s in ("all", *names)]
    each = rows.select(*by, F.explode(F.array(*scenarios)).alias("_s")).select(*by, "_s.scenario", "_s.ok")
    return each.groupBy("scenario", *by).agg(F.count(F.when(F.col("ok"), 1)).alias("accepted"), F.count(F.lit(1)).alias("total"))


def _all(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n)
    return out


def displacement_px(radius_px: Column, relief_m: Column, altitude_m: Column) -> Column:
    """How far relief moves a point that is radius_px off the centre."""
    return radius_px * relief_m / altitude_m


#: Bins of a range in which a median is looked for.
BINS = 4096


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Bin of a value in a range of finite values; equal and larger values are in no lower bin, NaN is the largest."""
    part = F.floor((v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0)) * BINS)
    inf = float("inf")
    return F.when(F.isnan(v), BINS + 1).when(v == inf, BINS).when(v == -inf, -1).when(v == hi, BINS - 1).otherwise(F.coalesce(F.least(part, F.lit(BINS - 1)), F.lit(0))).cast("int")


def spread(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Median and maximum overall and by each key.

    Values are counted in bins of their range, and then in bins of those bins that hold a middle rank; only distinct
    values of the latter are put in order. Rows are read four times, and no group's values meet in one task.
    """
    data = rows.select(*keys, value.alias("_v"))
    sets = [[], *[[k] for k in keys]]
    of = lambda k, s: F.col(k) if k in s else F.lit(None).cast(rows.schema[k].dataType)

    def by_sets(d: DataFrame) -> DataFrame:
        """Every row once for each grouping set (_s), without the other keys."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("_s"), *[of(k, s).alias(k) for k in keys]) for i, s in enumerate(sets)])).alias("_e")
        return d.select(each, *[c for c in d.columns if c not in keys]).select("_e.*", *[c for c in d.columns if c not in keys])

    def met(d: DataFrame, other: DataFrame, *more: str) -> DataFrame:
        """Rows of d with what other has for their group and for columns more."""
        names = ["_s", *keys, *more]
        right = other.select(*[F.col(c).alias(f"_o{c}") for c in names], *[c for c in other.columns if c not in names])
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_o{c}"))
        return d.join(right, same).drop(*[f"_o{c}" for c in names])

    finite = F.when(~F.isnan("_d") & (F.abs("_d") < float("inf")), F.col("_d"))
    each = data.withColumn("_d", F.col("_v").cast("double")).groupBy(*keys).agg(F.max("_v").alias("maximum"), F.count("_v").alias("n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    groups = by_sets(each).groupBy("_s", *keys).agg(F.max("maximum").alias("maximum"), F.sum("n").alias("n"))
    ends = each.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    ranks = groups.select("_s", *keys, F.expr("(n - 1) div 2").alias("_a"), F.expr("n div 2").alias("_b")).where("n > 0")

    def middle(counts: DataFrame, *order: str) -> DataFrame:
        """Rows of counts (_c) that hold a middle rank of their group, which has _before lower values."""
        upto = F.sum("_c").over(Window.partitionBy("_s", *keys).orderBy(*order))
        return counts.withColumn("_before", F.col("_base") + upto - F.col("_c")).where("_before <= _b and _before + _c > _a")

    known = [F.count(F.lit(1)).alias("_c"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi")]
    binned = data.where("_v is not null").select(*keys, F.col("_v").cast("double").alias("_d")).join(F.broadcast(ends)).withColumn("_bin", _bin(F.col("_d"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    first = by_sets(binned.groupBy(*keys, "_bin").agg(*known)).groupBy("_s", *keys, "_bin").agg(F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    first = middle(met(first, ranks.withColumn("_base", F.lit(0))), "_bin").select("_s", *keys, "_bin", "_lo", "_hi", "_a", "_b", "_before")
    # all bins that are left for any group: BINS + 3 at most
    left = binned.join(F.broadcast(first.select("_bin").distinct()), "_bin", "left_semi").groupBy(*keys, "_bin", "_d").agg(F.count(F.lit(1)).alias("_c"))
    left = met(by_sets(left), first, "_bin").withColumn("_part", _bin(F.col("_d"), F.col("_lo"), F.col("_hi")))
    base = Window.partitionBy("_s", *keys)
    lowest = lambda d: d.withColumn("_base", F.min("_before").over(base)).drop("_before")
    second = left.groupBy("_s", *keys, "_bin", "_part", "_a", "_b", "_before").agg(F.sum("_c").alias("_c"))
    second = middle(lowest(second), "_bin", "_part").select("_s", *keys, "_bin", "_part", "_before")
    third = met(left.drop("_before", "_lo", "_hi"), second, "_bin", "_part").groupBy("_s", *keys, "_bin", "_part", "_d", "_a", "_b", "_before").agg(F.sum("_c").alias("_c"))
    third = middle(lowest(third), "_bin", "_part", "_d").groupBy("_s", *keys).agg(F.min("_d").alias("_x"), F.max("_d").alias("_y"))
    median = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(F.lit(0.5) * F.col("_x") + F.lit(0.5) * F.col("_y"))
    right = third.select(*[F.col(c).alias(f"_o{c}") for c in ("_s", *keys)], median.alias("median"))
    same = F.lit(True)
    for c in ("_s", *keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_o{c}"))
    return groups.join(right, same, "left").select(*keys, "median", "maximum", "n")


def round_robin(rows: DataFrame, stratum: str, key: str, seed: int, n: int) -> DataFrame:
    """n rows, one of each stratum a round, in the order of a content hash."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)
    return rows.withColumn("round", F.row_number().over(w)).orderBy("round", stratum).limit(n)
