"""Dates, times of day, timestamps and intervals.

An interval is a struct (months, days, micros) as in scalar.py; a time of day is its microseconds since midnight, as bigint;
a time with a zone is a struct (micros, offset) with the zone's seconds east.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import DAY, _c, add_interval, template

#: What stands for the timestamps and dates infinity and -infinity.
LATEST, EARLIEST = "9999-12-31 23:59:59.999999", "0001-01-01 00:00:00"


def _struct(months, days, micros) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0) -> Column:
    """From numbers or columns."""
    n = {k: x if isinstance(x, Column) else F.lit(x) for k, x in locals().items()}
    micros = (n["hours"].cast("long") * 3600 + n["mins"].cast("long") * 60) * 1_000_000 + F.round(n["secs"].cast("decimal(18,6)") * 1_000_000).cast("long")
    return _struct(12 * n["years"] + n["months"], 7 * n["weeks"] + n["days"], micros)


# The clock


def now() -> Column:
    """The query's start; equal wherever it stands in a query. Also transaction_timestamp and CURRENT_TIMESTAMP."""
    return F.now()


statement_timestamp = now


def clock_timestamp() -> Column:
    """The time at which a batch of rows is read."""
    @F.pandas_udf("timestamp")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([pd.Timestamp.now(tz="UTC").tz_localize(None)] * len(x))

    return run(F.lit(0))


def time_of_day() -> Column:
    """timeofday(): the clock as text."""
    return F.date_format(clock_timestamp(), "EEE MMM dd HH:mm:ss.SSSSSS yyyy z")


def local_time() -> Column:
    """LOCALTIME."""
    return time_of(F.localtimestamp())


def sleep(seconds: float) -> Column:
    """pg_sleep: once for a batch of rows; null, as void."""
    import time

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        time.sleep(seconds)
        return pd.Series([None] * len(x), dtype=object)

    return run(F.lit(0))


def timezone_names(spark):
    """pg_timezone_names: (name, utc_offset in seconds, is_dst) at the query's start."""
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo, available_timezones

    at = datetime.now(timezone.utc)
    rows = []
    for name in sorted(available_timezones()):
        t = at.astimezone(ZoneInfo(name))
        rows.append((name, t.tzname(), int(t.utcoffset().total_seconds()), bool(t.dst())))
    return spark.createDataFrame(rows, "name string, abbrev string, utc_offset int, is_dst boolean")


# Differences


def _micros(t) -> Column:
    return F.unix_micros(_c(t).cast("timestamp_ntz").cast("timestamp"))


def subtract(a, b) -> Column:
    """timestamp - timestamp: days and time, both towards zero."""
    n = _micros(a) - _micros(b)
    days = F.when(n < 0, -F.floor(-n / DAY)).otherwise(F.floor(n / DAY)).cast("long")
    return _struct(F.lit(0), days, n - days * DAY)


def age(later, earlier) -> Column:
    """Years, months and days as a calendar counts them; a month that is borrowed has the length of the earlier time's."""
    a, b = _c(later).cast("timestamp_ntz"), _c(earlier).cast("timestamp_ntz")
    big, least = F.greatest(a, b), F.least(a, b)
    of_day = lambda t: _micros(t) - _micros(F.date_trunc("day", t))
    micros = of_day(big) - of_day(least)
    days = F.day(big) - F.day(least) - F.when(micros < 0, 1).otherwise(0)
    months = 12 * (F.year(big) - F.year(least)) + F.month(big) - F.month(least) - F.when(days < 0, 1).otherwise(0)
    days = F.when(days < 0, days + F.day(F.last_day(least))).otherwise(days)
    micros = F.when(micros < 0, micros + DAY).otherwise(micros)
    sign = F.when(a < b, -1).otherwise(1)
    return _struct(sign * months, sign * days, sign * micros)


# Interval arithmetic


def plus(a, b) -> Column:
    return _struct(*(_c(a).getField(f) + _c(b).getField(f) for f in ("months", "days", "micros")))


def minus(a, b) -> Column:
    return _struct(*(_c(a).getField(f) - _c(b).getField(f) for f in ("months", "days", "micros")))


def negative(a) -> Column:
    return _struct(*(-_c(a).getField(f) for f in ("months", "days", "micros")))


def times(a, factor) -> Column:
    """interval * number: a part of a month becomes days of 30, a part of a day time."""
    f = factor if isinstance(factor, Column) else F.lit(factor)
    f = f.cast("decimal(18,6)")
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    months, days = _c(a).getField("months") * f, _c(a).getField("days") * f
    more = (months - cut(months)) * 30
    rest = (days - cut(days) + more - cut(more)) * DAY
    return _struct(cut(months), cut(days) + cut(more), F.round(_c(a).getField("micros") * f + rest))


def divided(a, by) -> Column:
    return times(a, 1 / (by if isinstance(by, Column) else F.lit(by)))


def justify_interval(x) -> Column:
    """Time into days, days into months, with one sign throughout."""
    m, d, u = (_c(x).getField(f).cast("long") for f in ("months", "days", "micros"))
    cut = lambda a, n: F.when(a < 0, -F.floor(-a / n)).otherwise(F.floor(a / n)).cast("long")
    d, u = d + cut(u, DAY), u - cut(u, DAY) * DAY
    m, d = m + cut(d, 30), d - cut(d, 30) * 30
    down = (m > 0) & ((d < 0) | ((d == 0) & (u < 0)))
    up = (m < 0) & ((d > 0) | ((d == 0) & (u > 0)))
    m, d = m - F.when(down, 1).when(up, -1).otherwise(0), d + F.when(down, 30).when(up, -30).otherwise(0)
    down, up = (d > 0) & (u < 0), (d < 0) & (u > 0)
    return _struct(m, d - F.when(down, 1).when(up, -1).otherwise(0), u + F.when(down, DAY).when(up, -DAY).otherwise(0))


def interval_text(x) -> Column:
    """As it is shown: 1 year 2 mons 3 days 04:05:06.7."""
    m, d, u = (_c(x).getField(f).cast("long") for f in ("months", "days", "micros"))
    part = lambda n, one, many: F.when(n != 0, F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}"))))
    years = F.when(m < 0, -F.floor(-m / 12)).otherwise(F.floor(m / 12)).cast("long")
    clock = F.concat(F.when(u < 0, F.lit("-")).otherwise(F.lit("")), time_text(F.abs(u), wrap=False))
    shown = F.concat_ws(" ", part(years, "year", "years"), part(m - 12 * years, "mon", "mons"), part(d, "day", "days"), F.when(u != 0, clock))
    return F.when(_c(x).isNotNull(), F.when(shown == "", F.lit("00:00:00")).otherwise(shown))


def larger(a, b) -> Column:
    """The greater of two intervals, a month as 30 days and a day as 24 hours."""
    from .scalar import interval_key

    return F.when(interval_key(_c(a)) >= interval_key(_c(b)), _c(a)).otherwise(_c(b))


def smaller(a, b) -> Column:
    from .scalar import interval_key

    return F.when(interval_key(_c(a)) <= interval_key(_c(b)), _c(a)).otherwise(_c(b))


# Times of day


def make_time(h, m, s) -> Column:
    """An error outside of a day."""
    h, m, s = (x if isinstance(x, Column) else F.lit(x) for x in (h, m, s))
    good = h.between(0, 23) & m.between(0, 59) & (s >= 0) & (s < 60) | ((h == 24) & (m == 0) & (s == 0))
    micros = (h.cast("long") * 3600 + m.cast("long") * 60) * 1_000_000 + F.round(s.cast("decimal(18,6)") * 1_000_000).cast("long")
    return F.when(good, micros).otherwise(F.raise_error(F.lit("time field value out of range")).cast("long"))


def time_of(t) -> Column:
    """timestamp -> time."""
    t = _c(t).cast("timestamp_ntz")
    return _micros(t) - _micros(F.date_trunc("day", t))


def time_text(x, wrap: bool = True) -> Column:
    x = _c(x)
    whole = F.floor(x / 1_000_000).cast("long")
    part = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    hours = F.floor(whole / 3600).cast("long")
    rest = F.rtrim(F.lpad((x % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    return F.concat(part(hours), F.lit(":"), part(F.floor(whole / 60).cast("long") % 60), F.lit(":"), part(whole % 60), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))


def time_plus(x, i) -> Column:
    """time + interval: only the interval's time counts, modulo a day."""
    return F.pmod(_c(x) + _c(i).getField("micros"), F.lit(DAY))


def time_minus(a, b) -> Column:
    """time - time -> interval."""
    return _struct(F.lit(0), F.lit(0), _c(a) - _c(b))


def time_interval(x) -> Column:
    """time -> interval."""
    return _struct(F.lit(0), F.lit(0), _c(x))


def interval_time(i) -> Column:
    """interval -> time."""
    return F.pmod(_c(i).getField("micros"), F.lit(DAY))


def at(date, x) -> Column:
    """date + time -> timestamp."""
    return add_interval(_c(date).cast("timestamp_ntz"), time_interval(x))


def timetz(x, offset) -> Column:
    return F.struct(_c(x).alias("micros"), (offset if isinstance(offset, Column) else F.lit(offset)).alias("offset"))


def timetz_key(x) -> Column:
    """What times with zones compare by: the time in UTC, then the zone."""
    return F.struct((_c(x).getField("micros") - _c(x).getField("offset").cast("long") * 1_000_000).alias("utc"), (-_c(x).getField("offset")).alias("zone"))


def at_zoned(date, x) -> Column:
    """date + time with zone -> timestamp with zone."""
    t = at(date, _c(x).getField("micros")).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(t) - _c(x).getField("offset").cast("long") * 1_000_000)


# Timestamps


def make_timestamptz(y, mo, d, h, mi, s, zone=None) -> Column:
    xs = [x if isinstance(x, Column) else F.lit(x) for x in (y, mo, d, h, mi, s)]
    t = F.make_timestamp_ntz(*xs[:5], xs[5].cast("decimal(8,6)")).cast("timestamp")
    return t if zone is None else F.to_utc_timestamp(t, zone)


def to_timestamp(s, pattern: str) -> Column:
    """Text by a template, as in to_char."""
    return F.to_timestamp_ntz(_c(s), F.lit(template(pattern)))


def is_finite(t) -> Column:
    """Whether a date or timestamp is none of the two that stand for infinity."""
    t = _c(t).cast("timestamp_ntz")
    return (t != F.lit(LATEST).cast("timestamp_ntz")) & (t != F.lit(EARLIEST).cast("timestamp_ntz"))


def rounded(t, digits: int) -> Column:
    """timestamp(digits): halves away from zero."""
    scale = 10 ** (6 - digits)
    return F.timestamp_micros(F.round(_micros(t) / F.lit(scale).cast("decimal(10,0)")).cast("long") * scale).cast("timestamp_ntz")


def series(start, stop, step: Column) -> Column:
    """generate_series of timestamps, for explode; step from make_interval with constants only."""
    i = F.make_interval(months=step.getField("months"), days=step.getField("days"), secs=(step.getField("micros") / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.sequence(_c(start).cast("timestamp_ntz"), _c(stop).cast("timestamp_ntz"), i)


# The older types: abstime is seconds since 1970 as int, reltime seconds, tinterval a struct (lo, hi) of abstimes.


def abstime(t) -> Column:
    return F.floor(_micros(t) / 1_000_000).cast("int")


def reltime(i) -> Column:
    """interval -> seconds, a year as 365.25 days and a month as 30."""
    m = _c(i).getField("months")
    return (F.floor(m / 12) * 31_557_600 + (m % 12) * 2_592_000 + _c(i).getField("days") * 86_400 + F.floor(_c(i).getField("micros") / 1_000_000)).cast("int")


def tinterval(a, b) -> Column:
    return F.struct(F.least(_c(a), _c(b)).alias("lo"), F.greatest(_c(a), _c(b)).alias("hi"))


def tinterval_overlaps(x, y) -> Column:
    return (_c(x).getField("lo") <= _c(y).getField("hi")) & (_c(y).getField("lo") <= _c(x).getField("hi"))


def tinterval_contains(x, y) -> Column:
    """x holds the tinterval y."""
    return (_c(x).getField("lo") <= _c(y).getField("lo")) & (_c(x).getField("hi") >= _c(y).getField("hi"))


def tinterval_length(x) -> Column:
    return _c(x).getField("hi") - _c(x).getField("lo")
