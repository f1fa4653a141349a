"""Queries of time grids, as-of joins, ordered sequences and recurrences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gustframe.operators import relational, sequences, stats
from gustframe.operators.asof import asof_backward, clip_to_range
from gustframe.operators.impute import impute_in_blocks
from gustframe.operators.timegrid import resample
from gustframe.plans.registry import FEED, HOLES, Tables, epoch, query, r6, rounded


def _grid(step: int, origin: str, aggs: str, holes: bool = False, fill: dict[str, str] | None = None) -> str:
    """Resampling in SQL: bins of `step` seconds from each series' first row, or from midnight."""
    us = step * 1_000_000
    start = "min(epoch_us(ts)) over (partition by station_id)" if origin == "start" else f"(min(epoch_us(ts)) over (partition by station_id) // {us}) * {us}"
    out = ", ".join(f"{e} as {n}" for n, e in (fill or {}).items())
    return f"""with f as ({HOLES if holes else FEED}), o as (select *, epoch_us(ts) as u, {start} as s from f), b as (select *, (u - s) // {us} as bin from o),
g as (select station_id, s, bin, {aggs} from b group by 1, 2, 3), m as (select station_id, s, max(bin) as n from b group by 1, 2),
sp as (select station_id, s, unnest(range(0, n + 1)) as bin from m)
select station_id, ((s + bin * {us}) // 1000000)::bigint as t, {out} from sp left join g using (station_id, s, bin)"""


@query(_grid(3600, "start", "avg(v) as v", fill={"v": "round(v, 6)"}))
def q_resample_start(t: Tables):
    return resample(t.stations(), "station_id", "timestamp", {"v": "mean"}, partial=True).select("station_id", epoch("timestamp").alias("t"), r6("v").alias("v"))


@query(_grid(3600, "start", "sum(v) as rain, avg(v) as duration", holes=True, fill={"rain": "round(coalesce(rain, 0), 6)", "duration": "round(duration, 6)"}))
def q_resample_mixed(t: Tables):
    f = t.stations(holes=7).select("station_id", "timestamp", F.col("v").alias("rain"), F.col("v").alias("duration"))
    out = resample(f, "station_id", "timestamp", {"rain": "sum", "duration": "mean"}, partial=True)
    return out.select("station_id", epoch("timestamp").alias("t"), r6("rain").alias("rain"), r6("duration").alias("duration"))


@query(_grid(3600, "midnight", "avg(v) as v", fill={"v": "round(v, 6)"}))
def q_resample_hour(t: Tables):
    return resample(t.stations(), "station_id", "timestamp", {"v": "mean"}, origin="midnight", partial=True).select("station_id", epoch("timestamp").alias("t"), r6("v").alias("v"))


@query(_grid(1800, "start", "avg(v) as v, max(v) as top", fill={"v": "round(v, 6)", "top": "top"}))
def q_resample_30min(t: Tables):
    f = t.stations().withColumn("top", F.col("v"))
    return resample(f, "station_id", "timestamp", {"v": "mean", "top": "max"}, 1800, partial=True).select("station_id", epoch("timestamp").alias("t"), r6("v").alias("v"), "top")


# Both sides are all events: the right ones happen ten minutes later, or earlier for odd users, and every fifth has no value.
_SIDES = f"""with l as ({FEED}), r as (select station_id, ts + case when station_id % 2 = 0 then interval '10 minutes' else interval '-10 minutes' end as ts, case when event_id % 5 <> 0 then v end as w, v as pm from l)"""


def _sides(t: Tables):
    f = t.stations()
    later = F.timestamp_micros(F.unix_micros("timestamp") + F.when(F.col("station_id") % 2 == 0, 600_000_000).otherwise(-600_000_000))
    return f, f.select("station_id", later.alias("timestamp"), F.when(F.col("event_id") % 5 != 0, F.col("v")).alias("w_vert"), F.col("v").alias("pm"))


@query(_SIDES + " select event_id, l.station_id, v, w as w_vert from l asof left join r on l.station_id = r.station_id and l.ts >= r.ts")
def q_asof_backward(t: Tables):
    left, right = _sides(t)
    return asof_backward(left, right, "station_id", "timestamp", ["w_vert"]).select("event_id", "station_id", "v", "w_vert")


@query(_SIDES + ", m as (select station_id, min(ts) as a, max(ts) as b from r group by 1) select event_id, w as w_vert from l join m on l.station_id = m.station_id and l.ts between a and b asof left join r on l.station_id = r.station_id and l.ts >= r.ts")
def q_asof_range_clip(t: Tables):
    left, right = _sides(t)
    return asof_backward(clip_to_range(left, right, "station_id", "timestamp"), right, "station_id", "timestamp", ["w_vert"]).select("event_id", "w_vert")


@query(
    _SIDES
    + """, r0 as (select *, (epoch_us(ts) - min(epoch_us(ts)) over (partition by station_id)) // 3600000000 as bin, min(epoch_us(ts)) over (partition by station_id) as s from r),
g as (select station_id, s, bin, avg(pm) as pm from r0 group by all), m as (select station_id, s, max(bin) as n from r0 group by all), sp as (select station_id, s, unnest(range(0, n + 1)) as bin from m),
h as (select station_id, make_timestamp((s + bin * 3600000000)::bigint) as ts, pm from sp left join g using (station_id, s, bin))
select event_id, round(pm, 6) as pm from l asof left join h on l.station_id = h.station_id and l.ts >= h.ts"""
)
def q_asof_resampled(t: Tables):
    left, right = _sides(t)
    hourly = resample(right.select("station_id", "timestamp", "pm"), "station_id", "timestamp", {"pm": "mean"}, fill="first", partial=True)
    return asof_backward(left, hourly, "station_id", "timestamp", ["pm"]).select("event_id", r6("pm").alias("pm"))


@query(f"with f as ({FEED}) select event_id, v / case when max(v) over (partition by station_id) > 400 then 100.0::double else 1.0::double end as v from f")
def q_group_max_scale(t: Tables):
    w = W.partitionBy("station_id")
    return t.stations().select("event_id", (F.col("v") / F.when(F.max("v").over(w) > 400, 100.0).otherwise(1.0)).alias("v"))


@query(
    f"""with f as ({FEED}), w as (select event_id, row_number() over (partition by station_id order by ts) - 1 as i, count(*) over (partition by station_id) as n,
  min(epoch_us(ts)) over (partition by station_id) as a, max(epoch_us(ts)) over (partition by station_id) as b from f),
y as (select *, power(1 - 0.0063::double, ((a - epoch_us(timestamp '2010-06-01')) // 86400000000) / 365.25::double) as s, power(1 - 0.0063::double, ((b - epoch_us(timestamp '2010-06-01')) // 86400000000) / 365.25::double) as e from w)
select event_id, round(s + (e - s) * coalesce(i / nullif(n - 1, 0), 0), 9) as degradation from y"""
)
def q_ageing(t: Tables):
    out = sequences.ageing(t.stations(), "station_id", "timestamp", F.lit("2010-06-01").cast("timestamp"))
    return out.select("event_id", r6("degradation", 9).alias("degradation"))


@query(
    f"""with w as (select event_id, station_id, epoch_us(ts) as u, row_number() over (partition by station_id order by ts) - 1 as i, count(*) over (partition by station_id) as n,
  min(epoch_us(ts)) over (partition by station_id) as a, max(epoch_us(ts)) over (partition by station_id) as b, (station_id % 30 + 0.5)::double as age from ({FEED})),
y as (select *, power(1 - 0.0063::double, age) as s, ((a - (age * 365.25::double * 86400000000)::bigint) // 86400000000) * 86400000000 as since from w),
z as (select *, power(1 - 0.0063::double, ((b - since) // 86400000000) / 365.25::double) as e from y)
select event_id, round(s + (e - s) * coalesce(i / nullif(n - 1, 0), 0), 9) as degradation, strftime(make_timestamp(since), '%Y-%m-%d') as since from z"""
)
def q_ageing_from_age(t: Tables):
    """Where no date is known, the age at the first stamp gives it."""
    out = sequences.ageing_from(t.stations(), "station_id", "timestamp", F.col("station_id") % 30 + 0.5)
    return out.select("event_id", r6("degradation", 9).alias("degradation"), F.col("commissioned").cast("string").alias("since"))


@query(
    f"""with recursive f as ({FEED}), r as (select station_id, row_number() over (partition by station_id order by ts) as i, v, case when v > 60 then 1 else 0 end as rain, event_id % 11 as mins from f),
w(station_id, i, dust) as (select station_id, i, 4.0::double from r where i = 1 union all
  select r.station_id, r.i, case when rain >= 1 then dust * (1 - 0.8::double * mins / 10) else dust + v / 1000 end from w join r on r.station_id = w.station_id and r.i = w.i + 1)
select station_id, round(arg_max(dust, i), 6) as dust from w group by 1"""
)
def q_soiling(t: Tables):
    f = t.stations().select("station_id", "timestamp", F.when(F.col("v") > 60, 1.0).otherwise(0.0).alias("rain"), (F.col("event_id") % 11).cast("double").alias("mins"), (F.col("v") / 1000).alias("settled"))
    return sequences.final_dust(f, "station_id", "timestamp", "rain", "mins", "settled", 4.0, 1.0, 0.8, 10).select("station_id", r6("dust").alias("dust"))


@query(
    f"""with recursive f as ({FEED}), r as (select station_id, event_id, row_number() over (partition by station_id order by ts) as i, v, case when v > 60 then 1 else 0 end as rain, event_id % 11 as mins from f),
w(station_id, i, event_id, dust) as (select station_id, i, event_id, 4.0::double from r where i = 1 union all
  select r.station_id, r.i, r.event_id, case when rain >= 1 then dust * (1 - 0.8::double * mins / 10) else dust + v / 1000 end from w join r on r.station_id = w.station_id and r.i = w.i + 1)
select event_id, round(dust, 6) as dust from w"""
)
def q_soiling_rows(t: Tables):
    f = t.stations().select("event_id", "station_id", "timestamp", F.when(F.col("v") > 60, 1.0).otherwise(0.0).alias("rain"), (F.col("event_id") % 11).cast("double").alias("mins"), (F.col("v") / 1000).alias("settled"))
    return sequences.dust(f, ["station_id"], "timestamp", "rain", "mins", "settled", 4.0, 1.0, 0.8, 10).select("event_id", r6("dust").alias("dust"))


@query(
    f"""with recursive f as ({FEED}), r as (select event_id, station_id, row_number() over (partition by station_id order by ts) as i, v, lag(v) over (partition by station_id order by ts) as p from f),
w(station_id, i, event_id, tail, shown) as (select station_id, i, event_id, 0.0::double, v from r where i = 1 union all
  select r.station_id, r.i, r.event_id, case when v < p then tail * exp(-600 / greatest(300.0::double, 1200 * (1 + 0.1::double * (3 - v / 20)))) else v end,
    case when v < p then tail * exp(-600 / greatest(300.0::double, 1200 * (1 + 0.1::double * (3 - v / 20)))) else v end
  from w join r on r.station_id = w.station_id and r.i = w.i + 1)
select event_id, round(shown, 6) as smoothed from w"""
)
def q_inertia(t: Tables):
    f = t.stations().withColumn("speed", F.col("v") / 20)
    return sequences.inertia(f, "station_id", "timestamp", "v", "speed", 600, 1200, 0.1, 3, 300).select("event_id", r6("smoothed").alias("smoothed"))


@query(f"with f as ({HOLES}) select event_id, last_value(v ignore nulls) over (partition by station_id order by ts rows unbounded preceding) as v from f")
def q_ffill(t: Tables):
    return sequences.forward_fill(t.stations(holes=7), "station_id", "timestamp", ["v"]).select("event_id", "v")


@query("with s as (select p_size as size, count(*) as n, max(p_retailprice) as top from part where p_size % 3 <> 0 group by 1) select 1 as grp, i::int as size, coalesce(n, 0)::double as n, coalesce(top, 0.0::double) as top from range(0, 56) r(i) left join s on s.size = i")
def q_reindex(t: Tables):
    s = t("part").filter("p_size % 3 <> 0").groupBy(F.lit(1).alias("grp"), F.col("p_size").alias("size")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("p_retailprice").alias("top"))
    return sequences.reindex(s, "grp", "size", F.lit(55), 0.0)


@query("select p_partkey, case when n = 1 then p_brand else p_brand || '_' || n::varchar end as unique_name from (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) as n from part)")
def q_dup_counter(t: Tables):
    return sequences.duplicate_names(t("part"), "p_brand", "p_partkey", "unique_name").select("p_partkey", "unique_name")


@query(f"with f as ({FEED}) select station_id, min(epoch_us(ts) // 1000000) filter (where v > 200) as first, max(epoch_us(ts) // 1000000) filter (where v > 200) as last from f group by 1")
def q_nonzero_bounds(t: Tables):
    f = t.stations().select("station_id", epoch("timestamp").alias("i"), (F.col("v") - 200).alias("over"))
    return sequences.nonzero_bounds(f, "station_id", "i", "over")


@query(f"with f as ({FEED}) select event_id, coalesce(v < lag(v) over (partition by station_id order by ts), false) as fell from f")
def q_prev_compare(t: Tables):
    return t.stations().select("event_id", sequences.fell("v", "station_id", "timestamp").alias("fell"))


@query(f"with f as ({FEED}), n as (select station_id, ts, row_number() over (partition by station_id order by ts) as i from f) select station_id, round((max(epoch_us(ts)) filter (where i = 2) - max(epoch_us(ts)) filter (where i = 1)) / 1e6, 6) as step from n group by 1")
def q_sampling_step(t: Tables):
    return t.stations().select("station_id", r6(sequences.sampling_step("timestamp", "station_id")).alias("step")).distinct()


_CURVE_SQL = """with c as (select user_id % 7 as turbine, (event_id % 400 * 6)::int as ws_c, max(case when event_id % 400 * 6 < 300 then 0 else value * 10 end) as power_w from events group by 1, 2),
s as (select i as turbine, case when i % 2 = 0 then 20 + i end::double as cut_out from range(0, 7) r(i)),
k as (select c.turbine, min(ws_c) filter (where power_w > 0) as f, max((round_even(coalesce(cut_out, 25) * 100, 0))::int) as o from c join s using (turbine) group by 1),
g as (select k.*, i::int as ws_c from k, range(0, (select max(o) + 1 from k)) r(i)),
j as (select g.*, last_value(power_w ignore nulls) over (partition by g.turbine order by g.ws_c rows unbounded preceding) as p from g left join c on c.turbine = g.turbine and c.ws_c = g.ws_c)"""


@query(_CURVE_SQL + " select turbine::bigint as turbine, ws_c, case when ws_c > o or f is null or ws_c < f then 0.0::double else p end as power_w, f / 100.0::double as cut_in from j")
def q_curve_postprocess(t: Tables):
    tick = (F.col("event_id") % 400 * 6).cast("int")
    c = t("events").groupBy((F.col("user_id") % 7).alias("turbine"), tick.alias("ws_c")).agg(F.max(F.when(tick < 300, 0.0).otherwise(F.col("value") * 10)).alias("power_w"))
    s = t.spark.range(7).select(F.col("id").alias("turbine"), F.when(F.col("id") % 2 == 0, 20.0 + F.col("id")).alias("cut_out"))
    return sequences.post_process_curves(c, s)


@query(f"with f as ({FEED}) select event_id, round((v * 0.9::double) * avg(v) over (partition by station_id) / v * 100, 6) as wclf from f")
def q_wclf(t: Tables):
    f = t.stations().withColumn("aged", F.col("v") * 0.9)
    return sequences.load_factor_corrected(f, "station_id", "aged", "v").select("event_id", r6("wclf").alias("wclf"))


@query(
    f"""with f as ({FEED}), y as (select station_id, floor(((epoch_us(ts) - epoch_us(timestamp '2020-01-10')) // 86400000000) / 365.25::double)::int as age_year, v * 0.97::double as a, v as n from f)
select station_id, age_year, round((sum(a) - sum(n)) * 100 / sum(n), 6) as reduction from y group by 1, 2"""
)
def q_aep(t: Tables):
    from gustframe.functions.times import age_years
    from gustframe.plans.evaluate import ageing_effect

    f = t.stations().withColumn("age_years", age_years("timestamp", F.lit("2020-01-10").cast("timestamp")))
    aged = f.select("station_id", "timestamp", "age_years", (F.col("v") * 0.97).alias("power"))
    out = ageing_effect(aged, f.select("station_id", "timestamp", F.col("v").alias("power")), "station_id", "timestamp")
    return out.select("station_id", "age_year", r6("reduction").alias("reduction"))


@query("select user_id, 41 + dense_rank() over (order by user_id) as seed from (select distinct user_id from events)")
def q_running_seed(t: Tables):
    return sequences.running_seed(t("events").select("user_id").distinct(), "user_id", 42).select("user_id", F.col("seed").cast("long").alias("seed"))


@query(
    f"""with f as ({FEED}) select event_id, round((v - avg(v) over (partition by station_id)) / case when stddev_pop(v) over (partition by station_id) = 0 then 1 else stddev_pop(v) over (partition by station_id) end, 6) as z,
round(sin(2 * pi() * hour(ts) / 24), 9) as hour_sin, round(cos(2 * pi() * month(ts) / 12), 9) as month_cos from f"""
)
def q_cyclic_scale(t: Tables):
    from gustframe.functions.times import cyclic

    c = cyclic("timestamp")
    f = stats.standardise(t.stations().withColumn("z", F.col("v")), "station_id", ["z"])
    return f.select("event_id", r6("z").alias("z"), r6(c["hour_sin"], 9).alias("hour_sin"), r6(c["month_cos"], 9).alias("month_cos"))


@query(
    """with p as (select user_id as station_id, (epoch_us(ts) // 1800000000) as b, value as s, case when event_id % 3 <> 0 then value * 0.8::double + event_id % 7 end as r from events),
h as (select station_id, b, avg(s) as s, avg(r) as r from p group by 1, 2), j as (select * from h where r is not null)
select station_id, round(1 - sum((r - s) * (r - s)) / (sum(r * r) - count(*) * power(avg(r), 2)), 5) as r2, round(avg(abs(r - s)) / 500, 6) as mae, round(avg(s - r), 6) as bias, round(sum(s), 4) as energy_synthetic, round(sum(r), 4) as energy_real, count(*)::bigint as n
from j group by 1 having count(*) > 5"""
)
def q_evaluation(t: Tables):
    from gustframe.plans.evaluate import scores

    p = t("events").select(F.col("user_id").alias("station_id"), F.expr("unix_seconds(cast(ts as timestamp)) div 1800").alias("b"), F.col("value").alias("s"), F.when(F.col("event_id") % 3 != 0, F.col("value") * 0.8 + F.col("event_id") % 7).alias("r"))
    h = p.groupBy("station_id", "b").agg(F.avg("s").alias("synthetic"), F.avg("r").alias("real"))
    capacity = h.select("station_id").distinct().withColumn("capacity", F.lit(500.0))
    out = scores(h, "station_id", capacity).filter("n > 5")
    return out.select("station_id", rounded("r2", 5).alias("r2"), rounded("mae").alias("mae"), rounded("bias").alias("bias"), rounded("energy_synthetic", 4).alias("energy_synthetic"), rounded("energy_real", 4).alias("energy_real"), "n")


def _filled(c: str) -> str:
    """Values of c, holes by the mean of the five nearest rows that have it."""
    apart = [f"a.z{n} - b.z{n}" for n in ("v", "u")]
    times = " + ".join(f"power(a.{n} - b.{n}, 2)" for n in ("hs", "hc", "ms", "mc"))
    both = " + ".join(f"({x} is not null)::int" for x in apart)
    squares = " + ".join(f"coalesce(power({x}, 2), 0)" for x in apart)
    return f"""d{c} as (select a.event_id, b.z{c} as z, row_number() over (partition by a.event_id order by round(({squares} + {times}) * 6 / ({both} + 4), 9), b.ts, b.z{c}) as n
  from z a join z b on a.station_id = b.station_id and a.z{c} is null and b.z{c} is not null),
f{c} as (select event_id, avg(z) as z from d{c} where n <= 5 group by 1)"""


def _unit(c: str) -> str:
    return f"(x.{c} - avg(x.{c}) over w) / coalesce(nullif(stddev_pop(x.{c}) over w, 0), 1)"


@query(
    f"""with x as (select event_id, station_id, ts, v, case when event_id % 5 <> 0 then v * 2 + event_id % 3 end as u,
  sin(hour(ts) * 2 * pi() / 24) as h1, cos(hour(ts) * 2 * pi() / 24) as h2, sin(month(ts) * 2 * pi() / 12) as m1, cos(month(ts) * 2 * pi() / 12) as m2 from ({HOLES})),
z as (select event_id, station_id, ts, v, u, {_unit("v")} as zv, {_unit("u")} as zu, {_unit("h1")} as hs, {_unit("h2")} as hc, {_unit("m1")} as ms, {_unit("m2")} as mc,
  avg(v) over w as mv, stddev_pop(v) over w as sv, avg(u) over w as mu, stddev_pop(u) over w as su from x window w as (partition by station_id)),
{_filled("v")}, {_filled("u")},
y as (select z.event_id, station_id, coalesce(v, coalesce(fv.z, 0) * coalesce(nullif(sv, 0), 1) + mv) as v, coalesce(u, coalesce(fu.z, 0) * coalesce(nullif(su, 0), 1) + mu) as u
  from z left join fv using (event_id) left join fu using (event_id))
select event_id, station_id, round(case when abs(v) < 0.01 then 0 else v end, 6) as v, round(case when abs(u) < 0.01 then 0 else u end, 6) as u from y"""
)
def q_knn_impute(t: Tables):
    f = t.stations(holes=7).withColumn("u", F.when(F.col("event_id") % 5 != 0, F.col("v") * 2 + F.col("event_id") % 3))
    return impute_in_blocks(f, "station_id", "timestamp", ["v", "u"]).select("event_id", "station_id", r6("v").alias("v"), r6("u").alias("u"))


@query(
    """with registry as (select s_suppkey % 40 as station_id, case s_suppkey % 3 when 0 then 'wind' when 1 then 'solar' else 'air' end as variable from supplier)
select station_id from registry where variable in ('wind', 'air') group by 1 having count(distinct variable) = 2"""
)
def q_valid_stations(t: Tables):
    from gustframe.plans.ingest import valid_stations

    k = F.col("s_suppkey")
    registry = t("supplier").select((k % 40).alias("station_id"), F.when(k % 3 == 0, "wind").when(k % 3 == 1, "solar").otherwise("air").alias("variable"), F.lit("1990-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return valid_stations(registry, ["wind", "air"], F.lit("2000-01-01").cast("date"), F.lit("2024-01-01").cast("date"))


@query(
    f"""with f as ({FEED}) select station_id, epoch_us(ts) // 1000000 as t, max(v) as wind_speed, max(case when event_id % 3 <> 0 then v * 2 end) as temperature from f where ts >= timestamp '2024-01-05' group by station_id, ts"""
)
def q_variable_frames(t: Tables):
    """Two variables of all events, side by side: one row for each station and stamp."""
    from gustframe.plans.ingest import frames

    f = t.stations()
    a = f.select("station_id", "timestamp", F.col("v").alias("FF_10"))
    b = f.select("station_id", "timestamp", F.when(F.col("event_id") % 3 != 0, F.col("v") * 2).alias("TT_10"))
    out = frames([a, b], {"FF_10": "wind_speed", "TT_10": "temperature"}, first="2024-01-05")
    return out.select("station_id", epoch("timestamp").alias("t"), "wind_speed", "temperature")
