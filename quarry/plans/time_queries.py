"""Queries of dates, times of day, timestamps and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import times as T
from .registry import query, scalars

#: Months, days and microseconds of an interval, in DuckDB.
_M = "(12 * date_part('year', {0}) + date_part('month', {0}))::INT"
_D = "date_part('day', {0})::INT"
_U = "((date_part('hour', {0}) * 60 + date_part('minute', {0})) * 60000000 + date_part('microsecond', {0}))::BIGINT"


def _parts(name, make, sql):
    """The three parts of an interval as columns."""
    return {f"{name}_{f[0]}": (lambda f=f: make().getField(f), q.format(f"({sql})")) for f, q in (("months", _M), ("days", _D), ("micros", _U))}


_t = lambda: F.col("o_orderdate") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int), cast(o_custkey % 60 as int), cast(o_orderkey % 7 as decimal(18,6)))")
_T = "(o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_custkey % 60) + to_seconds(o_orderkey % 7))"
_fix = lambda x: F.lit(x).cast("timestamp_ntz")
scalars(
    "fn_interval_differences", "orders", "o_orderkey",
    **_parts("sub", lambda: T.subtract(_t(), _fix("1995-03-31 12:30:00")), f"{_T} - TIMESTAMP '1995-03-31 12:30:00'"), **_parts("age", lambda: T.age(_t(), _fix("1992-01-31 20:15:00")), f"age({_T}, TIMESTAMP '1992-01-31 20:15:00')"),
    **_parts("age2", lambda: T.age(_fix("1995-02-28 00:00:00"), "o_orderdate"), "age(TIMESTAMP '1995-02-28 00:00:00', o_orderdate)"),
)
_i = lambda: T.make_interval(months=F.col("o_orderkey") % 5, days=F.col("o_custkey") % 9, hours=F.col("o_orderkey") % 30, secs=F.col("o_custkey") % 50)
_I = "(to_months((o_orderkey % 5)::INT) + to_days((o_custkey % 9)::INT) + to_hours(o_orderkey % 30) + to_seconds(o_custkey % 50))"
scalars(
    "fn_interval_arithmetic", "orders", "o_orderkey",
    **_parts("make", _i, _I), **_parts("plus", lambda: T.plus(_i(), S.interval(months=2, days=40, hours=30)), f"{_I} + INTERVAL 2 month + INTERVAL 40 day + INTERVAL 30 hour"), **_parts("minus", lambda: T.minus(_i(), S.interval(months=1, days=1, hours=1)), f"{_I} - (INTERVAL 1 month + INTERVAL 1 day + INTERVAL 1 hour)"),
    neg=(lambda: T.negative(_i()).getField("days"), "-(o_custkey % 9)::INT"), **_parts("times", lambda: T.times(_i(), 3), f"{_I} * 3"), halfdays=(lambda: T.divided(T.make_interval(months=F.col("o_orderkey") % 5), 2).getField("days"), "((o_orderkey % 5) % 2 * 15)::INT"),
    halftime=(lambda: T.times(T.make_interval(days=F.col("o_custkey") % 9), 0.5).getField("micros"), "((o_custkey % 9) % 2 * 43200000000)::BIGINT"), jm=(lambda: T.justify_interval(T.make_interval(days=F.col("o_custkey") % 90, hours=F.col("o_orderkey") % 50)).getField("months"), "((o_custkey % 90 + (o_orderkey % 50) // 24) // 30)::INT"),
    jd=(lambda: T.justify_interval(T.make_interval(months=1, hours=-(F.col("o_orderkey") % 50))).getField("days"), "CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 30 - ((o_orderkey % 50 + 23) // 24) END::INT"),
    jh=(lambda: S.justify_hours(T.make_interval(hours=F.col("o_orderkey") % 70)).getField("days"), "((o_orderkey % 70) // 24)::INT"), jds=(lambda: S.justify_days(T.make_interval(days=F.col("o_orderkey") % 70)).getField("months"), "((o_orderkey % 70) // 30)::INT"),
    ky=(lambda: S.interval_key(_i()) > S.interval_key(S.interval(months=2)), f"{_I} > INTERVAL 2 month"), big=(lambda: T.larger(_i(), S.interval(days=60)).getField("days"), f"CASE WHEN {_I} >= INTERVAL 60 day THEN (o_custkey % 9)::INT ELSE 60 END"), small=(lambda: T.smaller(_i(), S.interval(days=60)).getField("days"), f"CASE WHEN {_I} <= INTERVAL 60 day THEN (o_custkey % 9)::INT ELSE 60 END"),
    txt=(lambda: T.interval_text(T.make_interval(days=F.col("o_custkey") % 9 + 2, mins=F.col("o_orderkey") % 600 + 1)), "(o_custkey % 9 + 2) || ' days ' || strftime(TIMESTAMP '2000-01-01' + to_minutes(o_orderkey % 600 + 1), '%H:%M:%S')"),
)
scalars(
    "fn_times_of_day", "orders", "o_orderkey",
    mk=(lambda: T.time_text(T.make_time(F.col("o_orderkey") % 24, F.col("o_custkey") % 60, F.lit(7))), "make_time(o_orderkey % 24, o_custkey % 60, 7)::VARCHAR"), of=(lambda: T.time_text(T.time_of(_t())), f"({_T}::TIME)::VARCHAR"),
    add=(lambda: T.time_text(T.time_plus(T.time_of(_t()), S.interval(days=1, hours=20))), f"({_T}::TIME + INTERVAL 20 hour)::VARCHAR"), sub=(lambda: T.time_minus(T.time_of(_t()), T.make_time(12, 0, 0)).getField("micros"), f"date_diff('microsecond', TIME '12:00:00', {_T}::TIME)"),
    it=(lambda: T.time_text(T.interval_time(S.interval(days=3, hours=26))), "'02:00:00'"), ti=(lambda: T.time_interval(T.time_of(_t())).getField("micros"), f"date_diff('microsecond', TIME '00:00:00', {_T}::TIME)"), at=(lambda: T.at(F.to_date("o_orderdate"), T.make_time(F.col("o_orderkey") % 24, 30, 0)), "o_orderdate::DATE + make_time(o_orderkey % 24, 30, 0)"),
    atz=(lambda: T.at_zoned(F.to_date("o_orderdate"), T.timetz(T.make_time(F.col("o_orderkey") % 24, 0, 0), 3600)).cast("timestamp_ntz"), "o_orderdate::DATE + make_time(o_orderkey % 24, 0, 0) - INTERVAL 1 hour"),
    cmp=(lambda: T.timetz_key(T.timetz(T.time_of(_t()), 3600)) < T.timetz_key(T.timetz(T.make_time(12, 0, 0), 0)), f"{_T}::TIME <= TIME '13:00:00'"), lt=(lambda: T.time_of(_t()) < T.make_time(12, 30, 0), f"{_T}::TIME < TIME '12:30:00'"), big=(lambda: T.time_text(F.greatest(T.time_of(_t()), T.make_time(12, 0, 0))), f"greatest({_T}::TIME, TIME '12:00:00')::VARCHAR"),
)
scalars(
    "fn_timestamps", "orders", "o_orderkey",
    tz=(lambda: T.make_timestamptz(F.year("o_orderdate"), 7, 4, F.col("o_orderkey") % 24, 5, 6.5, "America/New_York").cast("timestamp_ntz"), "make_timestamp(year(o_orderdate), 7, 4, o_orderkey % 24, 5, 6.5) + INTERVAL 4 hour"), utc=(lambda: T.make_timestamptz(F.year("o_orderdate"), 7, 4, 1, 5, 6).cast("timestamp_ntz"), "make_timestamp(year(o_orderdate), 7, 4, 1, 5, 6)"),
    pt=(lambda: T.to_timestamp(S.to_char(_t(), "DD Mon YYYY HH24:MI:SS"), "DD Mon YYYY HH24:MI:SS"), f"strptime(strftime({_T}, '%d %b %Y %H:%M:%S'), '%d %b %Y %H:%M:%S')"), fin=(lambda: T.is_finite("o_orderdate"), "isfinite(o_orderdate)"), inf=(lambda: T.is_finite(F.when(F.col("o_orderkey") % 2 == 0, F.lit(T.LATEST)).otherwise("2000-01-01").cast("timestamp_ntz")), "isfinite(CASE WHEN o_orderkey % 2 = 0 THEN 'infinity'::TIMESTAMP ELSE TIMESTAMP '2000-01-01' END)"),
    rnd=(lambda: T.rounded(_t() + F.expr("make_dt_interval(0, 0, 0, cast((o_custkey % 100) / 100.0 as decimal(18,6)))"), 0), f"{_T} + to_seconds(CASE WHEN o_custkey % 100 >= 50 THEN 1 ELSE 0 END)"), now=(lambda: (T.now() == T.statement_timestamp()) & (F.col("o_orderdate") < T.now()), "o_orderdate < now()::TIMESTAMP"), clock=(lambda: (T.clock_timestamp() >= T.now()) & (F.col("o_orderdate") < T.clock_timestamp()), "o_orderdate < current_localtimestamp()"),
    day=(lambda: F.datediff(F.current_date(), F.to_date("o_orderdate")).cast("long"), "(now()::TIMESTAMP::DATE - o_orderdate::DATE)::BIGINT"), lt=(lambda: T.local_time().between(0, S.DAY), "localtime BETWEEN TIME '00:00:00' AND TIME '24:00:00'"), tod=(lambda: F.substring(T.time_of_day(), -3, 3) == "UTC", "current_setting('TimeZone') IS NOT NULL"),
    dts=(lambda: F.to_date(F.lit("1995-01-01")) < F.col("o_orderdate"), "DATE '1995-01-01' < o_orderdate"), dtz=(lambda: F.col("o_orderdate").cast("timestamp") >= F.lit("1995-01-01T00:00:00+01:00").cast("timestamp"), "o_orderdate >= TIMESTAMP '1994-12-31 23:00:00'"), cast=(lambda: _t().cast("date"), f"{_T}::DATE"), slept=(lambda: T.sleep(0.01).isNull(), "true"),
)
scalars(
    "fn_older_times", "orders", "o_orderkey",
    a=(lambda: T.abstime(_t()), f"floor(epoch({_T}))::INT"), r=(lambda: T.reltime(T.make_interval(months=F.col("o_orderkey") % 30, days=F.col("o_custkey") % 9)), "((o_orderkey % 30) // 12 * 31557600 + (o_orderkey % 30) % 12 * 2592000 + (o_custkey % 9) * 86400)::INT"),
    ov=(lambda: T.tinterval_overlaps(T.tinterval(T.abstime("o_orderdate"), T.abstime(_t())), T.tinterval(F.lit(788918400), F.lit(820454400))), f"epoch(o_orderdate) <= 820454400 AND epoch({_T}) >= 788918400"), co=(lambda: T.tinterval_contains(T.tinterval(F.lit(820454400), F.lit(788918400)), T.tinterval(T.abstime("o_orderdate"), T.abstime(_t()))), f"epoch(o_orderdate) >= 788918400 AND floor(epoch({_T})) <= 820454400"),
    le=(lambda: T.tinterval_length(T.tinterval(T.abstime("o_orderdate"), T.abstime(_t()))), f"(floor(epoch({_T})) - epoch(o_orderdate))::INT"),
)


@query("SELECT n_nationkey, unnest(generate_series(TIMESTAMP '2000-01-31' + to_days(n_nationkey::INT), TIMESTAMP '2000-03-01', INTERVAL 18 hour)) AS at FROM nation")
def fn_time_series(t):
    start = S.add_interval(F.lit("2000-01-31").cast("timestamp_ntz"), T.make_interval(days=F.col("n_nationkey")))
    return t.nation.select("n_nationkey", F.explode(T.series(start, F.lit("2000-03-01"), S.interval(hours=18))).alias("at"))


@query("SELECT unnest(['Asia/Tokyo', 'America/New_York', 'Europe/Berlin']) AS name, unnest([32400, -18000, 3600]) AS least")
def timezone_names(t):
    """Zones with their least offset of a year."""
    z = T.timezone_names(t.spark).where(F.col("name").isin("Asia/Tokyo", "America/New_York", "Europe/Berlin"))
    return z.select("name", (F.col("utc_offset") - F.when(F.col("is_dst"), 3600).otherwise(0)).alias("least"))
