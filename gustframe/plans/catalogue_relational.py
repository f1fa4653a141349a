"""Queries of projections, filters, joins, aggregates, sets and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gustframe.functions import nulls, text
from gustframe.operators import quality, relational, reshape, sampling, stats
from gustframe.operators.curves import at_ticks
from gustframe.operators.geo import nearest
from gustframe.functions.wind import ticks
from gustframe.plans.registry import FEED, HOLES, Tables, epoch, query, r6


@query("select event_id, user_id as station_id, value as wind_speed, value * 3.6 as wind_speed_kmh, 'synthetic' as source from events")
def q_project_rename_drop(t: Tables):
    df = relational.rename_known(t("events"), {"user_id": "station_id", "value": "wind_speed", "absent": "x"}).drop("props", "absent")
    return relational.drop_matching(df, "event_type", "ts").withColumns({"wind_speed_kmh": F.col("wind_speed") * 3.6, "source": F.lit("synthetic")})


@query("select event_id, epoch_us(ts) // 1000000 as t from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-11'")
def q_time_slice(t: Tables):
    from gustframe.functions.times import in_days

    return t.stations().filter(in_days("timestamp", "2024-01-05", "2024-01-10")).select("event_id", epoch("timestamp").alias("t"))


@query(
    """with o as (select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderdate end as von, case when o_orderkey % 7 <> 0 then o_orderdate + interval 400 day end as bis from orders)
select o_orderkey from o where (bis is null or bis >= timestamp '1996-01-01') and (von is null or von <= timestamp '1996-06-01')"""
)
def q_interval_filter_null_kept(t: Tables):
    d = F.col("o_orderdate")
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, d).alias("von"), F.when(F.col("o_orderkey") % 7 != 0, d + F.expr("interval 400 days")).alias("bis"))
    return relational.valid_interval(o, "von", "bis", F.lit("1996-06-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("with e as (select event_id, case when event_id % 7 <> 0 then value end as v from events) select event_id from e where not coalesce(v > 100, false)")
def q_drop_condition(t: Tables):
    return relational.drop_where(t.stations(holes=7), F.col("v") > 100).select("event_id")


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag in ('A', 'N') and l_linestatus not in ('F')")
def q_in_notin(t: Tables):
    return t("lineitem").filter(F.col("l_returnflag").isin("A", "N") & ~F.col("l_linestatus").isin("F")).select("l_orderkey", "l_linenumber")


@query(
    """with e as (select event_id, case when event_id % 7 <> 0 then value end as a, case when event_id % 5 <> 0 then value * 2 end as b from events)
select event_id, (a is null or b is null) as any_null, coalesce(a < 50, false) and coalesce(b < 50, false) as all_below from e where not (a is null and b is null)"""
)
def q_any_all_columns(t: Tables):
    e = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("value") * 2).alias("b"))
    return e.na.drop("all", subset=["a", "b"]).select("event_id", nulls.any_null("a", "b").alias("any_null"), nulls.all_below(50, "a", "b").alias("all_below"))


@query("with e as (select event_id, value from events where event_id % 7 <> 0 and event_id % 5 <> 0) select event_id, value from e")
def q_dropna(t: Tables):
    e = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.lit(1)).alias("b"))
    return e.na.drop("any").select("event_id", "value")


@query(
    """with e as (select event_id, nullif(nullif(case when event_id % 11 = 0 then -999.0::double when event_id % 13 = 0 then -9999.0::double else value end, -999), -9999) as v from events)
select event_id, coalesce(v, 0.0::double) as filled, case when v is not null then least(greatest(v, 5.0::double), 60.0::double) end as clipped,
  case when v < 20 then 0.0::double else v end as floored, case when v > 100 then 'high' when v > 40 then 'mid' else 'low' end as band from e"""
)
def q_fill_sentinel_clip(t: Tables):
    i = F.col("event_id")
    e = t("events").select(i, F.when(i % 11 == 0, -999.0).when(i % 13 == 0, -9999.0).otherwise(F.col("value")).alias("v"))
    e = nulls.sentinels_to_null(e, ["v"])
    return e.select("event_id", F.coalesce("v", F.lit(0.0)).alias("filled"), nulls.clip("v", 5, 60).alias("clipped"), nulls.zero_below("v", 20).alias("floored"), F.when(F.col("v") > 100, "high").when(F.col("v") > 40, "mid").otherwise("low").alias("band"))


@query("select n_nationkey, case n_regionkey when 0 then 'south' when 1 then 'west' when 3 then 'centre' else 'Other' end as zone from nation")
def q_map_default(t: Tables):
    return t("nation").select("n_nationkey", nulls.mapped("n_regionkey", {0: "south", 1: "west", 3: "centre"}).alias("zone"))


@query("select l_orderkey, l_linenumber, c_custkey, o_totalprice from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey")
def q_multiway_inner(t: Tables):
    l, o, c = t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), t("orders"), t("customer").withColumnRenamed("c_custkey", "o_custkey")
    return relational.join_all([l, o], ["o_orderkey"]).join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", F.col("o_custkey").alias("c_custkey"), "o_totalprice")


_DAILY = """with d as (select user_id as station_id, (epoch_us(ts) // 86400000000) as day, event_type, count(*)::bigint as n, round(avg(value), 6) as v from events group by all),
a as (select station_id, day, n, v from d where event_type = (select min(event_type) from events)), b as (select station_id, day, n, v from d where event_type = (select max(event_type) from events))"""


def _daily(t: Tables):
    d = t.stations().groupBy("station_id", F.expr("unix_seconds(timestamp) div 86400").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("v"))
    ends = t("events").agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    d = d.crossJoin(F.broadcast(ends))
    return d.filter("event_type = lo").select("station_id", "day", "n", "v"), d.filter("event_type = hi").select("station_id", "day", "n", "v")


@query(_DAILY + " select station_id, day, a.n, a.v, b.v as v_b from a left join b using (station_id, day)")
def q_left_equi(t: Tables):
    a, b = _daily(t)
    return relational.aligned(a.withColumn("v_b", F.lit(0.0)), b.select("station_id", "day", F.col("v").alias("v_b")), ["station_id", "day"], "v_b")


@query(_DAILY + " select station_id, day, a.n, a.v, b.n as n_b, b.v as v_b from a join b using (station_id, day)")
def q_inner_suffix(t: Tables):
    a, b = _daily(t)
    return relational.join_suffixed(a, b, ["station_id", "day"], "_b")


@query(_DAILY + " select station_id, day, a.v, b.v as v_b, a.v - b.v as diff from a full join b using (station_id, day)")
def q_full_outer(t: Tables):
    a, b = _daily(t)
    return relational.join_all([a.drop("n"), b.select("station_id", "day", F.col("v").alias("v_b"))], ["station_id", "day"], "full_outer").withColumn("diff", F.col("v") - F.col("v_b"))


@query("select event_id, c as tick, case when c between 0 and 2500 then c * 2.0::double end as curve_w from (select event_id, round_even(value / 20 * 100, 0)::int as c from events)")
def q_float_tick_join(t: Tables):
    curve = t.spark.range(0, 2501).select(F.lit("a").alias("turbine"), F.col("id").cast("int").alias("ws_c"), (F.col("id") * 2.0).alias("power_w"))
    e = t("events").select("event_id", ticks(F.col("value") / 20).alias("tick"), F.lit("a").alias("turbine"))
    return at_ticks(e, curve, "tick").select("event_id", "tick", "curve_w")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def q_semi(t: Tables):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def q_anti(t: Tables):
    """Customers who never had an urgent order."""
    urgent = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderpriority") == "1-URGENT")
    return t("customer").join(t("orders"), urgent, "left_anti").select("c_custkey")


@query("select s_suppkey, n_name, n_regionkey from supplier join nation on s_nationkey = n_nationkey")
def q_dim_lookup(t: Tables):
    s = t("supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return relational.lookup(s, t("nation"), "n_nationkey", ["n_name", "n_regionkey"]).select("s_suppkey", "n_name", "n_regionkey")


_NEAR = """with s as (select s_suppkey, 47 + s_suppkey % 80 / 10.0::double as lat, 6 + s_suppkey * 7 % 90 / 10.0::double as lon from supplier),
p as (select n_nationkey, 47.3::double + n_nationkey * 3 % 25 / 3.0::double as plat, 6.1::double + n_nationkey * 5 % 25 / 2.7::double as plon from nation),
d as (select s_suppkey, n_nationkey, 2 * 6371.0088::double * asin(least(1.0::double, sqrt(power(sin((radians(plat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2)))) as distance from s, p),
r as (select *, row_number() over (partition by s_suppkey order by distance, n_nationkey) as rank from d)"""


def _near(t: Tables, k: int):
    s = t("supplier").select("s_suppkey", (47 + F.col("s_suppkey") % 80 / 10.0).alias("latitude"), (6 + F.col("s_suppkey") * 7 % 90 / 10.0).alias("longitude"))
    n = F.col("n_nationkey")
    p = t("nation").select(n, (F.lit(47.3) + n * 3 % 25 / 3.0).alias("p_latitude"), (F.lit(6.1) + n * 5 % 25 / 2.7).alias("p_longitude"))
    return nearest(s, p, "s_suppkey", k, tie="n_nationkey").select("s_suppkey", "n_nationkey", r6("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_NEAR + " select s_suppkey, n_nationkey, round(distance, 4) as distance, rank from r where rank = 1")
def q_nearest(t: Tables):
    return _near(t, 1)


@query(_NEAR + " select s_suppkey, n_nationkey, round(distance, 4) as distance, rank from r where rank <= 3")
def q_knearest(t: Tables):
    return _near(t, 3)


@query("select p_partkey, tilt, azimuth, round(p_retailprice * cos(radians(tilt)), 6) as scaled from part, (values (25.0::double, 180.0::double), (35.0::double, 90.0::double), (45.0::double, 270.0::double)) g(tilt, azimuth)")
def q_cross_grid(t: Tables):
    grid = t.spark.createDataFrame([(25.0, 180.0), (35.0, 90.0), (45.0, 270.0)], "tilt double, azimuth double")
    return relational.with_grid(t("part").select("p_partkey", "p_retailprice"), grid).select("p_partkey", "tilt", "azimuth", r6(F.col("p_retailprice") * F.cos(F.radians("tilt"))).alias("scaled"))


@query(
    """with d as (select distinct user_id || ':' || strftime(ts, '%Y-%m-%d') as g, event_type as k from events), s as (select g, count(*) as n from d group by 1)
select a.k as a, b.k as b, count(*)::bigint as n from d a join d b using (g) join s using (g) where a.k <> b.k or s.n = 1 group by 1, 2"""
)
def q_pair_matrix(t: Tables):
    daily = t.stations().select(F.concat_ws(":", F.col("station_id").cast("string"), F.date_format("timestamp", "yyyy-MM-dd")).alias("g"), "event_type")
    return relational.pair_counts(daily, "g", "event_type")


@query(f"with f as ({HOLES}) select station_id, round(avg((v is null)::int), 6) as share from f group by 1")
def q_null_share(t: Tables):
    return quality.null_shares(t.stations(holes=7), "station_id", ["v"]).select("station_id", r6("v").alias("share"))


@query(f"with f as ({HOLES}), s as (select station_id from f group by 1 having avg((v is null)::int) <= 0.14) select event_id from f where station_id in (select station_id from s)")
def q_threshold_filter(t: Tables):
    return quality.complete_enough(t.stations(holes=7), "station_id", ["v"], 0.14).select("event_id")


@query("select user_id as station_id from events group by 1 having count(case when value > 120 then value end) > 0 and count(case when value < 2 then value end) > 0")
def q_never_empty(t: Tables):
    f = t.stations().select("station_id", F.when(F.col("v") > 120, F.col("v")).alias("high"), F.when(F.col("v") < 2, F.col("v")).alias("low"))
    return quality.never_empty(f, "station_id", ["high", "low"])


@query(
    f"""with f as ({HOLES}), s as (select avg((v is null)::int) as worst from f group by station_id), t as (select (i * 0.005)::double as threshold from range(0, 61) r(i))
select round(threshold, 6) as threshold, count(*) filter (where worst <= threshold)::bigint as n from t, s group by 1"""
)
def q_sweep(t: Tables):
    return quality.survivors(t.stations(holes=7), "station_id", ["v"], [i * 0.005 for i in range(61)]).select(r6("threshold").alias("threshold"), "n")


@query(
    """with f as (select user_id as station_id, case when event_id % 7 <> 0 then value end as a, case when event_id % 5 <> 0 then value end as b from events)
select station_id, round(avg((a is null)::int) * 100, 6) as a, round(avg((b is null)::int) * 100, 6) as b, round((avg((a is null)::int) + avg((b is null)::int)) * 50, 6) as mean from f group by 1"""
)
def q_missing_rank(t: Tables):
    f = t("events").select(F.col("user_id").alias("station_id"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("b"))
    return quality.missing_ranking(f, "station_id", ["a", "b"]).select("station_id", *[r6(c).alias(c) for c in ("a", "b", "mean")])


@query("with g as (select user_id, count(*) as size from events group by 1) select size::bigint as size, count(*)::bigint as groups from g group by 1")
def q_group_sizes(t: Tables):
    return relational.sizes_of_sizes(t("events"), "user_id")


@query("select event_type, count(distinct user_id)::bigint as users, count(*)::bigint as n from events group by 1")
def q_distinct_count(t: Tables):
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    """with e as (select user_id || ':' || strftime(ts, '%Y-%m-%d') as g, event_type from events)
select g from e group by 1 having count(distinct event_type) = 3 and bool_and(event_type in ('click', 'purchase', 'view'))"""
)
def q_division(t: Tables):
    """The days of users that hold exactly three kinds of events."""
    e = t.stations().select(F.concat_ws(":", F.col("station_id").cast("string"), F.date_format("timestamp", "yyyy-MM-dd")).alias("g"), "event_type")
    return relational.divide(e, "g", "event_type", ["click", "purchase", "view"])


@query("select user_id, count(*) filter (where l = 1)::bigint as low, count(*) filter (where l = 2)::bigint as mid, count(*) filter (where l = 3)::bigint as high from (select user_id, case when value < 20 then 1 when value < 80 then 2 else 3 end as l from events) group by 1")
def q_crosstab(t: Tables):
    e = t("events").select("user_id", F.when(F.col("value") < 20, "low").when(F.col("value") < 80, "mid").otherwise("high").alias("l"))
    return relational.crosstab(e, "user_id", "l", ["low", "mid", "high"])


@query(
    """select year(l_shipdate)::bigint as year, l_returnflag, round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount) + 0.0, 6) as avg_disc,
max(l_quantity) as max_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_tax), 4) as sum_tax from lineitem group by 1, 2"""
)
def q_multi_agg(t: Tables):
    return t("lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year"), "l_returnflag").agg(
        r6(F.avg("l_quantity")).alias("avg_qty"), r6(F.avg("l_extendedprice"), 4).alias("avg_price"), r6(F.avg("l_discount") + 0.0).alias("avg_disc"),
        F.max("l_quantity").alias("max_qty"), r6(F.sum("l_extendedprice"), 2).alias("sum_price"), r6(F.sum("l_tax"), 4).alias("sum_tax"),
    )


@query("select (epoch_us(ts) // 3600000000) as hour, round(avg(value), 6) as v, round(avg(event_id), 4) as e from events group by 1")
def q_group_mean(t: Tables):
    return t("events").groupBy(F.expr("unix_seconds(cast(ts as timestamp)) div 3600").alias("hour")).agg(r6(F.avg("value")).alias("v"), r6(F.avg("event_id"), 4).alias("e"))


@query("select distinct o_custkey, o_orderstatus from orders")
def q_dedup(t: Tables):
    return t("orders").select("o_custkey", "o_orderstatus").dropDuplicates()


_UPSERT = """with old as (select o_orderkey as k, o_totalprice as p from orders where o_orderkey % 3 <> 0), raw as (select o_orderkey as k, o_totalprice * 2 as p from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0),
new as (select k, p from (select *, row_number() over (partition by k order by p) as n from (select * from raw union all select k, p + 1 from raw where k % 4 = 0)) where n = 1)"""


def _upsert(t: Tables):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    raw = o.filter("k % 2 = 0 or k % 3 = 0").withColumn("p", F.col("p") * 2)
    return o.filter("k % 3 <> 0"), raw.unionByName(raw.filter("k % 4 = 0").withColumn("p", F.col("p") + 1))


@query(_UPSERT + " select k, p from old union all select k, p from new where k not in (select k from old)")
def q_upsert_nothing(t: Tables):
    return relational.upsert(*_upsert(t), ["k"], update=False)


@query(_UPSERT + " select k, p from new union all select k, p from old where k not in (select k from new)")
def q_upsert_update(t: Tables):
    return relational.upsert_windowed(*_upsert(t), ["k"])


@query("select sum(case when l_quantity > 25 then l_extendedprice else 0 end)::bigint as above, round(sum(l_extendedprice) / 1e6, 6) as total, round(stddev_samp(l_extendedprice), 4) as dev, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem")
def q_scalar_aggregates(t: Tables):
    p = F.col("l_extendedprice")
    return t("lineitem").agg(F.round(F.sum(F.when(F.col("l_quantity") > 25, p).otherwise(0.0)), 0).cast("long").alias("above"), r6(F.sum(p) / 1e6).alias("total"), r6(F.stddev_samp(p), 4).alias("dev"), F.min(p).alias("low"), F.max(p).alias("high"))


@query(
    """with x as (select l_returnflag, l_extendedprice as y, l_quantity * 1500 as p from lineitem)
select l_returnflag, round(1 - sum((y - p) * (y - p)) / (sum(y * y) - count(*) * power(avg(y), 2)), 6) as r2, round(avg(abs(y - p)) / 1000, 6) as mae, round(avg(p - y), 4) as bias from x group by 1"""
)
def q_r2_mae(t: Tables):
    x = t("lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return x.groupBy("l_returnflag").agg(r6(stats.r2("y", "p")).alias("r2"), r6(stats.mae("y", "p", 1000.0)).alias("mae"), r6(F.avg(F.col("p") - F.col("y")), 4).alias("bias"))


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by 1")
def q_regr(t: Tables):
    return t("lineitem").groupBy("l_returnflag").agg(r6(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), r6(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("select " + ", ".join([f"round(sum(power(x, {k})), 2) as sx{k}" for k in range(7)] + [f"round(sum(power(x, {k}) * y), 2) as sxy{k}" for k in range(4)]) + " from (select l_quantity / 50 as x, l_tax as y from lineitem)")
def q_polyfit_moments(t: Tables):
    m = stats.moments(t("lineitem").select((F.col("l_quantity") / 50).alias("x"), F.col("l_tax").alias("y")), "x", "y")
    return m.select(*[r6(c, 2).alias(c) for c in m.columns])


@query("with q as (select quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b from events) select event_id, value from events, q where value > a and value < b")
def q_quantile_trim(t: Tables):
    return stats.trim(t("events").select("event_id", "value"), "value")


_BINS = """with e as (select min(value) as a, max(value) as b, count(*) as n from events), w as (select *, (b - a) / 50 as w from e),
c as (select least(floor((value - a) / w)::int, 49) as bin, count(*) as c from events, w group by 1)"""


@query(_BINS + " select i::int as bin, round(a + i * w, 6) as \"left\", round(coalesce(c, 0) / (n * w), 9) as value from range(0, 50) r(i) cross join w left join c on c.bin = i")
def q_hist_density(t: Tables):
    return stats.histogram(t("events"), "value", 50, "density").select("bin", r6("left").alias("left"), r6("value", 9).alias("value"))


@query(
    """with e as (select l_extendedprice as x from lineitem), b as (select floor(x / 2500)::bigint as bin, count(*) as c from e group by 1),
r as (select unnest(range((select min(bin) from b), (select max(bin) from b) + 1)) as bin), n as (select count(*) as n from e)
select r.bin, r.bin * 2500.0::double as "left", coalesce(c, 0)::double as hits, round(coalesce(c, 0) / n::double, 9) as probability, round(coalesce(c, 0) * 100 / n::double, 7) as percent, round(coalesce(c, 0) / (n * 2500.0::double), 12) as density from r cross join n left join b using (bin)"""
)
def q_hist_by_width(t: Tables):
    """Bins of 2 500 from a multiple of it, by all four norms."""
    norms = {"count": "hits", "probability": "probability", "percent": "percent", "density": "density"}
    each = [stats.histogram_by_width(t("lineitem"), "l_extendedprice", 2500.0, norm).withColumnRenamed("value", name) for norm, name in norms.items()]
    out = reduce(lambda a, b: a.join(b.drop("left"), "bin"), each)
    return out.select("bin", "left", "hits", r6("probability", 9).alias("probability"), r6("percent", 7).alias("percent"), r6("density", 12).alias("density"))


@query(
    """with e as (select l_quantity as p, l_quantity * (1 + l_discount) as q from lineitem), x as (select min(least(p, q)) as a, max(greatest(p, q)) as b from e), w as (select *, (b - a) / 50 as w from x),
l as (select 1 as k, p as v from e union all select 2, q from e), c as (select least(floor((v - a) / w)::int, 49) as bin, count(*) filter (where k = 1) as np, count(*) filter (where k = 2) as nq from l, w group by 1),
t as (select sum(np) as tp, sum(nq) as tq from c) select round(sum((np / (tp * w) + 1e-10) * ln((np / (tp * w) + 1e-10) / (nq / (tq * w) + 1e-10))), 6) as kl from c, t, w"""
)
def q_kl(t: Tables):
    e = t("lineitem").select(F.col("l_quantity").alias("p"), (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("q"))
    return stats.kl_divergence(e, "p", "q").select(r6("kl").alias("kl"))


_BOX = """with q as (select event_type, count(value) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from events group by 1)"""


@query(_BOX + " select event_type, n::bigint as n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3 from q")
def q_boxplot(t: Tables):
    return stats.box_stats(t("events"), ["event_type"], "value").select("event_type", "n", *[r6(c).alias(c) for c in ("q1", "median", "q3")])


@query(
    """with e as (select case when event_id % 4 <> 0 then event_type end as k, case when event_type <> 'view' and event_id % 3 <> 0 then value end as v from events)
select k, count(v)::bigint as n, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median from e group by 1"""
)
def q_quantiles_with_odd_groups(t: Tables):
    """A group without a key and one without a value are groups too."""
    i = F.col("event_id")
    e = t("events").select(F.when(i % 4 != 0, F.col("event_type")).alias("k"), F.when((F.col("event_type") != "view") & (i % 3 != 0), F.col("value")).alias("v"))
    return stats.quantiles(e, ["k"], "v", [0.25, 0.5]).select("k", "n", r6(F.col("q")[0]).alias("q1"), r6(F.col("q")[1]).alias("median"))


@query(_BOX + " select event_type, round(min(value) filter (where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as low, round(max(value) filter (where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as high from events join q using (event_type) group by 1")
def q_boxplot_whiskers(t: Tables):
    return stats.box_stats(t("events"), ["event_type"], "value").select("event_type", r6("low").alias("low"), r6("high").alias("high"))


@query("with c as (select (round_even(value / 5, 0) * 5)::double as bin, count(*) as n from events group by 1) select bin, n::bigint as n, round(n * 100.0::double / (select sum(n) from c), 6) as percent from c")
def q_rel_freq(t: Tables):
    return stats.relative_frequency(t("events"), nulls.bin_even("value", 5)).select("bin", "n", r6("percent").alias("percent"))


@query("select (round_even(l_extendedprice / 500, 0) * 500)::double as bin, round(avg(l_quantity), 6) as qty, count(*)::bigint as n from lineitem group by 1")
def q_bin_half_even(t: Tables):
    return t("lineitem").groupBy(nulls.bin_even("l_extendedprice", 500).alias("bin")).agg(r6(F.avg("l_quantity")).alias("qty"), F.count(F.lit(1)).alias("n"))


@query("select event_id, round_even(value / 7 * 100, 0) / 100 as v2 from events")
def q_round2(t: Tables):
    return t("events").select("event_id", nulls.round_even(F.col("value") / 7, 2).alias("v2"))


@query("select hour(ts)::bigint as hour, month(ts)::bigint as month, count(*)::bigint as n, round(avg(value), 6) as v from events group by 1, 2")
def q_calendar_groups(t: Tables):
    return t("events").groupBy(F.hour("ts").cast("long").alias("hour"), F.month("ts").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("v"))


@query("select l_returnflag, round(sum(l_extendedprice) / 1e6, 6) as energy, round(sum(l_quantity) / 1e6, 6) as volume from lineitem group by rollup(l_returnflag)")
def q_park_totals_rollup(t: Tables):
    e = stats.energy_totals(t("lineitem").select("l_returnflag", F.col("l_extendedprice").alias("energy"), F.col("l_quantity").alias("volume")), "l_returnflag", ["energy", "volume"])
    return e.select("l_returnflag", r6("energy").alias("energy"), r6("volume").alias("volume"))


@query("select o_orderkey, round(avg(l_quantity), 6) as v, round(sum(pi() * power(l_quantity / 2, 2)), 4) as area, round(sum(l_extendedprice), 2) as power from orders join lineitem on o_orderkey = l_orderkey group by 1")
def q_park_means(t: Tables):
    from gustframe.functions.wind import rotor_area

    j = t("orders").select(F.col("o_orderkey")).join(t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return j.groupBy("o_orderkey").agg(r6(F.avg("l_quantity")).alias("v"), r6(F.sum(rotor_area("l_quantity")), 4).alias("area"), r6(F.sum("l_extendedprice"), 2).alias("power"))


@query("select n_regionkey as park, round(avg(n_nationkey + 0.5), 6) as latitude, round(avg(n_nationkey * 2), 6) as longitude from nation group by 1")
def q_centroid(t: Tables):
    from gustframe.operators.geo import centroids

    n = t("nation").select(F.col("n_regionkey").alias("park"), (F.col("n_nationkey") + 0.5).alias("latitude"), (F.col("n_nationkey") * 2).alias("longitude"))
    return centroids(n, "park").select("park", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"))


@query("select l_orderkey, l_linenumber, round(l_tax + l_discount + l_quantity, 6) as total, round((l_tax + l_discount + l_quantity) / 3, 6) as mean from lineitem")
def q_row_reduce(t: Tables):
    cols = ("l_tax", "l_discount", "l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(nulls.row_sum(*cols)).alias("total"), r6(nulls.row_mean(*cols)).alias("mean"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def q_topn(t: Tables):
    return sampling.top_n(t("orders").select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey")


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 2")
def q_topn_of_each(t: Tables):
    return sampling.top_n_of_each(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 2, F.desc("o_totalprice"), "o_orderkey")


@query("select o_custkey, arg_min(o_orderkey, o_totalprice) as o_orderkey, strftime(max(o_orderdate), '%Y-%m-%d') as last from orders group by 1")
def q_argmin(t: Tables):
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", "o_totalprice").alias("o_orderkey"), F.max("o_orderdate").cast("date").cast("string").alias("last"))


@query()
def q_hash_sample(t: Tables):
    return sampling.sample(t("orders").select("o_orderkey"), "o_orderkey", 100, seed=3)


@query("select c_nationkey::bigint as k, 'c' as src from customer union all select s_nationkey::bigint, 's' from supplier union all select n_nationkey::bigint, null from nation")
def q_union_all(t: Tables):
    parts = [t("customer").select(F.col("c_nationkey").cast("long").alias("k"), F.lit("c").alias("src")), t("supplier").select(F.col("s_nationkey").cast("long").alias("k"), F.lit("s").alias("src")), t("nation").select(F.col("n_nationkey").cast("long").alias("k"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def q_union_distinct(t: Tables):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("select p_size::bigint as k from part except select s_nationkey from supplier")
def q_except(t: Tables):
    return t("part").select(F.col("p_size").cast("long").alias("k")).subtract(t("supplier").select(F.col("s_nationkey").cast("long")))


@query("select n_nationkey as k from nation intersect select s_nationkey from supplier")
def q_intersect(t: Tables):
    return t("nation").select(F.col("n_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("select l_orderkey, l_linenumber, name, value from (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax from lineitem) unpivot (value for name in (l_quantity, l_extendedprice, l_tax))")
def q_unpivot(t: Tables):
    return reshape.melt(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_tax"])


@query("select o_custkey, max(o_totalprice) filter (where o_orderstatus = 'F') as power_tF, max(o_totalprice) filter (where o_orderstatus = 'O') as power_tO, max(o_totalprice) filter (where o_orderstatus = 'P') as power_tP from orders group by 1")
def q_pivot_wide(t: Tables):
    best = t("orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("power"))
    return reshape.widen(best, ["o_custkey"], "o_orderstatus", ["power"], ["F", "O", "P"])


@query(
    """select l_orderkey, l_linenumber, 'price' as name, round(l_extendedprice - l_quantity, 6) as difference, round(abs(l_extendedprice - l_quantity), 6) as absolute from lineitem
union all select l_orderkey, l_linenumber, 'tax', round(l_tax - l_discount, 6) + 0.0, round(abs(l_tax - l_discount), 6) + 0.0 from lineitem"""
)
def q_pairwise_diff(t: Tables):
    d = reshape.pair_differences(t("lineitem"), ["l_orderkey", "l_linenumber"], {"price": ("l_extendedprice", "l_quantity"), "tax": ("l_tax", "l_discount")})
    return d.select("l_orderkey", "l_linenumber", "name", (r6("difference") + 0.0).alias("difference"), (r6("absolute") + 0.0).alias("absolute"))


@query("select park, i as turbine_no, t as turbine, h as hub_height from (select n_nationkey as park, unnest([1, 2, 3]) as i, unnest(['a' || n_regionkey, 'b', 'c']) as t, unnest([60.0::double, 80.0::double + n_nationkey, 100.0::double]) as h from nation)")
def q_park_arrays(t: Tables):
    p = t("nation").select(F.col("n_nationkey").alias("park"), F.array(F.concat(F.lit("a"), F.col("n_regionkey").cast("string")), F.lit("b"), F.lit("c")).alias("turbines"), F.array(F.lit(60.0), 80.0 + F.col("n_nationkey"), F.lit(100.0)).alias("hub_heights"))
    return reshape.park(p)


@query("select p_partkey, lpad(p_partkey::varchar, greatest(5, length(p_partkey::varchar))::int, '0') as id5, lower(trim(p_name)) as lowered, length(p_name)::int as n, p_brand || '-' || p_size::varchar as label, contains(p_name, 'e') as has_e from part")
def q_strings(t: Tables):
    return t("part").select("p_partkey", text.station_id("p_partkey").alias("id5"), F.lower(F.trim("p_name")).alias("lowered"), F.length("p_name").alias("n"), F.format_string("%s-%d", "p_brand", "p_size").alias("label"), F.contains("p_name", F.lit("e")).alias("has_e"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from part")
def q_slug(t: Tables):
    return t("part").select("p_partkey", text.slug(F.concat("p_type", F.lit(" / "), "p_brand")).alias("slug"))


@query(
    """with u as (select page_id, 'data/raw/' || page_id::varchar || '_x/produkt_' || (20200000 + page_id)::varchar || '_00' || lpad((page_id % 1000)::varchar, 3, '0') || '.txt' as p from pages)
select page_id, nullif(regexp_extract(p, '_(\\d{5})\\.txt$', 1), '') as station, string_split_regex(p, '[/_.]')[-2] as tail, nullif(regexp_extract(p, '_(\\d{7})_', 1), '') as none from u"""
)
def q_regex(t: Tables):
    i = F.col("page_id").cast("string")
    p = F.concat(F.lit("data/raw/"), i, F.lit("_x/produkt_"), (F.col("page_id") + 20200000).cast("string"), F.lit("_00"), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit(".txt"))
    return t("pages").select("page_id", text.found(p, r"_(\d{5})\.txt$").alias("station"), text.part(p, "/_.", -2).alias("tail"), text.found(p, r"_(\d{7})_").alias("none"))


@query(
    """with u as (select page_id, case when page_id % 5 = 0 then 'bad_name' else '5' || (page_id % 10)::varchar || '_' || lpad((page_id * 37 % 10000)::varchar, 4, '0') || '_0' || (page_id % 9)::varchar || '_2500_ML' end as n from pages)
select page_id, case when page_id % 5 <> 0 then split_part(n, '_', 1)::int + split_part(n, '_', 2)::int / 10000.0::double end as lat, case when page_id % 5 <> 0 then split_part(n, '_', 3)::int + 0.25::double end as lon from u"""
)
def q_gridname(t: Tables):
    k = F.col("page_id")
    n = F.when(k % 5 == 0, "bad_name").otherwise(F.concat(F.lit("5"), (k % 10).cast("string"), F.lit("_"), F.lpad((k * 37 % 10000).cast("string"), 4, "0"), F.lit("_0"), (k % 9).cast("string"), F.lit("_2500_ML")))
    lat, lon = text.grid_point(F.concat(F.lit("/x/"), n, F.lit(".csv")))
    return t("pages").select("page_id", lat.alias("lat"), lon.alias("lon"))


@query("select p_partkey, try_cast(replace(case when p_partkey % 10 = 0 then 'n/a' else replace(p_retailprice::varchar, '.', ',') end, ',', '.') as double) as price from part")
def q_decimal_comma(t: Tables):
    return t("part").select("p_partkey", text.decimal_comma(F.when(F.col("p_partkey") % 10 == 0, "n/a").otherwise(F.translate(F.col("p_retailprice").cast("string"), ".", ","))).alias("price"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def q_json_props(t: Tables):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then case n_nationkey when 4 then 'Nord' else 'Other' end else n_name end as maker from nation")
def q_number_or_text(t: Tables):
    mixed = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise(F.col("n_name"))
    return t("nation").select("n_nationkey", text.number_or_text(mixed, {4: "Nord"}).alias("maker"))


@query("select o_orderkey, strftime(o_orderdate::date + 30, '%Y-%m-%d') as later, year(o_orderdate)::bigint as year, dayofyear(o_orderdate)::bigint as doy, strftime(o_orderdate, '%Y%m%d%H%M') as stamp from orders")
def q_dates(t: Tables):
    from gustframe.functions.times import day_after

    return t("orders").select("o_orderkey", day_after("o_orderdate", 30).alias("later"), F.year("o_orderdate").cast("long").alias("year"), F.dayofyear("o_orderdate").cast("long").alias("doy"), F.date_format("o_orderdate", "yyyyMMddHHmm").alias("stamp"))


@query("select event_id, epoch_us(ts) // 1000000 + (event_id % 48) * 3600 as valid from events")
def q_leadtime(t: Tables):
    from gustframe.functions.times import valid_time

    return t("events").select("event_id", epoch(valid_time("ts", F.col("event_id") % 48)).alias("valid"))


_AGE = "(epoch_us(timestamp '2024-12-31') - epoch_us(o_orderdate)) // 86400000000"


@query(f"select o_orderkey, ({_AGE})::bigint as days, round({_AGE} / 365.25::double, 9) as years, round({_AGE} / 365.0::double, 9) as years365 from orders")
def q_age_days(t: Tables):
    from gustframe.functions.times import age_days, age_years

    now = F.lit("2024-12-31").cast("timestamp_ntz")
    return t("orders").select("o_orderkey", age_days(now, F.col("o_orderdate")).alias("days"), r6(age_years(now, F.col("o_orderdate")), 9).alias("years"), r6(age_years(now, F.col("o_orderdate"), 365), 9).alias("years365"))


@query("select s_suppkey, n_name, s_acctbal as altitude, null::varchar as commissioning_date from supplier join nation on s_nationkey = n_nationkey")
def q_param_projection(t: Tables):
    s = t("supplier").select("s_suppkey", F.struct(F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("altitude"), F.lit(None).cast("date").alias("commissioning_date")).alias("p")).select("s_suppkey", "p.*")
    return relational.lookup(s, t("nation"), "n_nationkey", ["n_name"]).select("s_suppkey", "n_name", "altitude", F.col("commissioning_date").cast("string").alias("commissioning_date"))


@query("select o_orderkey, round(datediff('day', o_orderdate::date, date '2024-12-31') / 365.0::double, 9) as age from orders where o_orderstatus <> 'P'")
def q_lifetime_age(t: Tables):
    from gustframe.functions.times import years_since

    return t("orders").filter(F.col("o_orderstatus") != "P").select("o_orderkey", r6(years_since("o_orderdate", F.lit("2024-12-31").cast("date")), 9).alias("age"))


@query("with f as (select strftime(ts, '%Y-%m-%d') as day, case when event_id % 97 <> 0 then value end as a, case when event_id % 193 <> 0 then value end as b from events) select day, count(*) filter (where a is null)::bigint as a, count(*) filter (where b is null)::bigint as b from f group by 1 having bool_or(a is null or b is null)")
def q_daily_nulls(t: Tables):
    f = t("events").select("ts", F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 193 != 0, F.col("value")).alias("b"))
    return quality.daily_nulls(f, "ts", ["a", "b"]).withColumn("day", F.col("day").cast("string"))


@query(
    """with l as (select user_id, strftime(ts, '%Y-%m-%d') as day, event_type, arg_max('p' || event_id::varchar, event_id) as p from events where event_type in ('click', 'error', 'view') group by 1, 2, 3)
select user_id || ':' || day as g, array_to_string(list(p order by event_type), '|') as paths from l group by 1"""
)
def q_path_matrix(t: Tables):
    e = t("events").withColumn("path", F.concat(F.lit("p"), F.col("event_id").cast("string"))).withColumn("g", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    three = ["click", "error", "view"]
    found = relational.path_matrix(e.filter(F.col("event_type").isin(*three)), "g", "event_type", "path", "event_id", three)
    return found.select("g", F.array_join("paths", "|").alias("paths"))


@query("select l_orderkey, round(sum(l_extendedprice) / 1e9, 9) as gwh from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' group by 1")
def q_year_energy(t: Tables):
    from gustframe.functions.times import in_days

    return t("lineitem").filter(in_days(F.col("l_shipdate").cast("timestamp"), "1996-01-01", "1996-12-31")).groupBy("l_orderkey").agg(r6(F.sum("l_extendedprice") / 1e9, 9).alias("gwh"))


@query(
    """with l as (select c_custkey, c_nationkey as k, row_number() over (partition by c_nationkey order by c_custkey) as n from customer),
r as (select s_suppkey, s_nationkey as k, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) as n from supplier) select c_custkey, s_suppkey from l left join r using (k, n)"""
)
def q_second_match(t: Tables):
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), "s_acctbal")
    return relational.second_match(c, s, "k", "s_acctbal").select("c_custkey", "s_suppkey")


@query("select r.r_name, array_to_string(list(n_name order by n_name), ',') as nations from nation join region r on n_regionkey = r_regionkey group by 1")
def q_collect_list(t: Tables):
    j = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query(f"select distinct station_id from ({FEED})")
def q_distinct_ids(t: Tables):
    return t.stations().select("station_id").distinct()


@query("select n_nationkey, list_sort(list_distinct(list_concat(['wind', 'air', r_name], ['air', n_name, 'wind']))) as both_lists from nation join region on n_regionkey = r_regionkey")
def q_union_lists(t: Tables):
    """Two lists of variables as one, each entry once."""
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", F.array_sort(F.array_union(F.array(F.lit("wind"), F.lit("air"), "r_name"), F.array(F.lit("air"), "n_name", F.lit("wind")))).alias("both_lists"))


@query(
    """select event_id, epoch_us(((ts at time zone 'Europe/Berlin') at time zone 'UTC')) // 1000000 as utc, epoch_us(((ts at time zone 'UTC') at time zone 'Europe/Berlin')) // 1000000 as berlin,
epoch_us(strptime(strftime(ts, '%Y%m%d%H%M'), '%Y%m%d%H%M')) // 1000000 as stamp from events"""
)
def q_zones(t: Tables):
    """A wall clock's stamps as moments and back, and stamps by pattern."""
    from gustframe.functions.times import in_utc, local_time, stamp

    ts = F.col("ts").cast("timestamp")
    return t("events").select("event_id", epoch(in_utc(ts, "Europe/Berlin")).alias("utc"), epoch(local_time(ts, "Europe/Berlin")).alias("berlin"), epoch(stamp(F.date_format(ts, "yyyyMMddHHmm"))).alias("stamp"))


@query("select event_id, strftime(make_timestamp((epoch_us(ts) - floor((event_id % 300) / 10.0::double * 365.25::double * 86400000000)::bigint)::bigint), '%Y-%m-%d') as since, (value * 1000)::bigint::varchar as whole from events where true")
def q_commissioned(t: Tables):
    from gustframe.functions.times import commissioned

    return t("events").select("event_id", commissioned(F.col("ts").cast("timestamp"), F.col("event_id") % 300 / 10.0).cast("string").alias("since"), text.integral(F.rint(F.col("value") * 1000)).alias("whole"))


@query("select count(*)::bigint as part, (select count(*) from orders)::bigint as whole from (select o_orderkey from orders limit 100)")
def q_sample_and_rest(t: Tables):
    """A sample and its complement are together the table, each row once."""
    o = t("orders").select("o_orderkey")
    part = sampling.sample(o, "o_orderkey", 100, seed=3)
    rest = sampling.complement(o, part, "o_orderkey")
    both = part.withColumn("part", F.lit(1)).unionByName(rest.withColumn("part", F.lit(0))).groupBy("o_orderkey").agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return both.agg(F.sum("part").alias("part"), F.count(F.lit(1)).alias("whole"))


def _minor(rows: tuple[int, ...], replaced: int | None) -> str:
    """The determinant of the first columns of moments m0..m6 for some rows, one of them replaced by the sums with y."""

    def cell(i: int, j: int) -> str:
        return f"y{i}" if j == replaced else f"m{i + j}"

    j = 4 - len(rows)
    if len(rows) == 1:
        return cell(rows[0], j)
    return "(" + " + ".join(f"{'-' if n % 2 else ''}{cell(i, j)} * {_minor(tuple(r for r in rows if r != i), replaced)}" for n, i in enumerate(rows)) + ")"


_Z = "(l_quantity - 25.5::double) / 14.5::double"


@query(
    f"with s as (select {', '.join(f'avg(power({_Z}, {k})) as m{k}' for k in range(7))}, {', '.join(f'avg(power({_Z}, {k}) * l_extendedprice / 1000) as y{k}' for k in range(4))} from lineitem), "
    f"d as (select {_minor((0, 1, 2, 3), None)} as d, {', '.join(f'{_minor((0, 1, 2, 3), j)} as d{j}' for j in range(4))} from s) "
    "select " + ", ".join(f"round(d{j} / d, 5) as c{j}" for j in range(4)) + " from d"
)
def q_polyfit_cubic(t: Tables):
    """A cubic through all line items' prices by quantity."""
    z = (F.col("l_quantity") - 25.5) / 14.5
    c = stats.polyfit(t("lineitem").select(z.alias("z"), (F.col("l_extendedprice") / 1000).alias("y")), "z", "y", 3)
    return t.spark.createDataFrame([tuple(round(float(x), 5) for x in c[::-1])], "c0 double, c1 double, c2 double, c3 double")


@query(
    """with m as (select sum(1.0::double) as n, sum(l_quantity) as sx, sum(l_quantity * l_quantity) as sxx, sum(l_extendedprice) as sy, sum(l_quantity * l_extendedprice) as sxy from lineitem)
select 1::bigint as power, round((n * sxy - sx * sy) / (n * sxx - sx * sx), 3) as coefficient from m union all select 0, round((sxx * sy - sx * sxy) / (n * sxx - sx * sx), 3) from m"""
)
def q_polyfit(t: Tables):
    """A straight line by the same moments as a cubic."""
    found = stats.polyfit(t("lineitem"), "l_quantity", "l_extendedprice", 1)
    return t.spark.createDataFrame([(1 - i, float(c)) for i, c in enumerate(found)], "power long, c double").select("power", r6("c", 3).alias("coefficient"))


@query(
    """select lpad((s_suppkey % 100000)::varchar, 5, '0') as station_id, '2001-02-03' as valid_from, case s_suppkey % 3 when 0 then '2024-05-01' end as valid_to, round(s_acctbal, 2) as height, (40 + s_nationkey)::double as latitude, s_name as name, 'wind' as variable from supplier"""
)
def q_registry_lines(t: Tables):
    """Fixed-width lines, as the registry has them, made from suppliers and read: every third with an end, one without, one with no day of a calendar."""
    from gustframe.sources.files import registry_lines

    line = F.concat(
        F.lpad((F.col("s_suppkey") % 100000).cast("string"), 5, "0"), F.when(F.col("s_suppkey") % 3 == 0, " 20010203 20240501 ").when(F.col("s_suppkey") % 3 == 1, " 20010203          ").otherwise(" 20010203 20240231 "), F.lpad(F.format_string("%.2f", "s_acctbal"), 14, " "),
        F.lpad((40 + F.col("s_nationkey")).cast("string"), 12, " "), F.lpad(F.lit("10.5"), 10, " "), F.lit(" "), F.rpad("s_name", 41, " "), F.lit("Nord"),
    )
    head = t.spark.createDataFrame([("Stations_id von_datum",), ("----------- ---------",)], "line string")
    rows = registry_lines(t("supplier").select(line.alias("line")).unionByName(head).withColumn("path", F.lit("file:/data/wind/list.txt")))
    return rows.select("station_id", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), r6("height", 2).alias("height"), "latitude", "name", "variable")


@query(
    """select lpad(user_id::varchar, greatest(5, length(user_id::varchar))::int, '0') as station_id, epoch_us(date_trunc('minute', ts)) // 1000000 as t, case when event_id % 7 <> 0 then round(value, 2) end as speed from events"""
)
def q_measured(t: Tables):
    """Raw rows as files of measurements have them: ids without zeros, stamps to the minute, -999 for missing."""
    from gustframe.sources.files import measured

    raw = t("events").select(
        F.col("user_id").cast("string").alias("STATIONS_ID"), F.date_format("ts", "yyyyMMddHHmm").alias("MESS_DATUM"), F.lit(3.0).alias("QN"),
        F.when(F.col("event_id") % 7 != 0, F.round("value", 2)).otherwise(-999.0).alias("FF_10"), F.lit("eor").alias("eor"),
    )
    return measured(raw).select("station_id", epoch("timestamp").alias("t"), F.col("FF_10").alias("speed"))


@query("select page_id, '{labels: [\"' || page_id::varchar || '\", \"}\"], data: {x: ' || (page_id % 7)::varchar || '}}' as body, page_id::varchar as label, page_id % 7 as x from pages")
def q_page_objects(t: Tables):
    """The object after a marker in a page's script, by matching braces, then read."""
    from gustframe.sources.files import html_objects

    i = F.col("page_id").cast("string")
    page = F.concat(F.lit('<p>{no}</p><script>var chart = {labels: ["'), i, F.lit('", "}"], data: {x: '), (F.col("page_id") % 7).cast("string"), F.lit("}}; var other = {};</script>"))
    found = html_objects(t("pages").select("page_id", page.alias("html")), "html", "var chart")
    parsed = found.withColumn("o", text.chart_object("body", "labels array<string>, data struct<x: long>"))
    return parsed.select("page_id", "body", F.col("o.labels")[0].alias("label"), F.col("o.data.x").alias("x"))


@query("select s_suppkey, s_name as name, round(s_acctbal, 2) as power from supplier")
def q_xml_units(t: Tables):
    """Elements read by a list of tags; others are passed over."""
    unit = F.concat(F.lit("<Unit><Other>1</Other><Name>"), "s_name", F.lit("</Name><Power>"), F.round("s_acctbal", 2).cast("string"), F.lit("</Power></Unit>"))
    return t("supplier").select("s_suppkey", F.from_xml(unit, "Name string, Power double").alias("u")).select("s_suppkey", F.col("u.Name").alias("name"), F.col("u.Power").alias("power"))
