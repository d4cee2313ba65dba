"""Scalar functions as Column expressions, where Spark's own differ in meaning or are missing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


# Strings


def initcap(s) -> Column:
    """Each run of letters and digits starts with a capital; any other character ends a run."""
    parts = F.regexp_extract_all(_c(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def left(s, n: int) -> Column:
    """The first n characters; all but the last -n where n is negative."""
    s = _c(s)
    return F.left(s, F.lit(n)) if n >= 0 else F.left(s, F.greatest(F.length(s) + n, F.lit(0)))


def right(s, n: int) -> Column:
    s = _c(s)
    return F.right(s, F.lit(n)) if n >= 0 else F.right(s, F.greatest(F.length(s) + n, F.lit(0)))


def substr(s, start: int, count: int | None = None) -> Column:
    """Characters start to start + count - 1; positions before the first count as empty."""
    first = max(start, 1)
    if count is None:
        return F.substr(_c(s), F.lit(first))
    if count < 0:
        raise ValueError("negative substring length not allowed")
    return F.substr(_c(s), F.lit(first), F.lit(max(start + count - first, 0)))


def chr_(n) -> Column:
    """The character of a code point, as UTF-8; an error for a surrogate and beyond the last one, which have no text."""
    n = _c(n).cast("int")
    byte = lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")
    part = lambda shift: F.lit(0x80).bitwiseOR(F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)))
    one = byte(n)
    two = F.concat(byte(F.lit(0xC0).bitwiseOR(F.shiftright(n, 6))), byte(part(0)))
    three = F.concat(byte(F.lit(0xE0).bitwiseOR(F.shiftright(n, 12))), byte(part(6)), byte(part(0)))
    four = F.concat(byte(F.lit(0xF0).bitwiseOR(F.shiftright(n, 18))), byte(part(12)), byte(part(6)), byte(part(0)))
    text = F.decode(F.unhex(F.when(n < 0x80, one).when(n < 0x800, two).when(n < 0x10000, three).otherwise(four)), "UTF-8")
    none = ~n.between(0, 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(none, F.raise_error(F.concat(F.lit("requested character not valid for encoding: "), n.cast("string"))).cast("string")).otherwise(text)


def concat(*xs) -> Column:
    """All arguments but nulls."""
    return F.concat_ws("", *(_c(x).cast("string") for x in xs))


def java_regex(pattern: str) -> str:
    r"""An advanced regular expression as Java's: \m and \M are word starts and ends, \y any word edge, \A and \Z the text's."""
    for a, b in ((r"\m", r"\b(?=\w)"), (r"\M", r"\b(?<=\w)"), (r"\y", r"\b"), (r"\Y", r"\B"), ("[[:<:]]", r"\b(?=\w)"), ("[[:>:]]", r"\b(?<=\w)")):
        pattern = pattern.replace(a, b)
    return re.sub(r"\[:(\w+):\]", lambda m: {"alpha": r"\p{Alpha}", "digit": r"\d", "alnum": r"\p{Alnum}", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}"}[m[1]], pattern)


def flagged(pattern: str, flags: str = "") -> str:
    return ("(?i)" if "i" in flags else "") + java_regex(pattern)


def substring_regex(s, pattern: str) -> Column:
    """The first group's text, or the whole match without a group; null where nothing matches."""
    p = java_regex(pattern)
    group = 1 if re.compile(re.sub(r"\\p\{\w+\}", "x", p)).groups else 0
    return F.when(_c(s).rlike(p), F.regexp_extract(_c(s), p, group))


def regexp_replace(s, pattern: str, by: str, flags: str = "") -> Column:
    r"""The first match replaced, all with flag g; \1 is a group and \& the match."""
    by = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$").replace(r"\&", "$0"))
    p = flagged(pattern, flags)
    if "g" in flags:
        return F.regexp_replace(_c(s), p, by)
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}", by)
    return F.regexp_replace(_c(s), f"(?s)^(.*?)({p})", "$1" + shifted)


def regexp_matches(s, pattern: str, flags: str = "") -> Column:
    """All matches as an array, for explode; each the match, or its first group."""
    p = flagged(pattern, flags)
    return F.regexp_extract_all(_c(s), F.lit(p if "(" in pattern else f"({p})"), 1)


def similar_regex(pattern: str, escape: str = "\\") -> str:
    """A SQL pattern (% _ | * + ? {} () []) as a Java regular expression for the whole text."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c in "%_":
            out += ".*" if c == "%" else "."
        elif c in ".^$\\":
            out += "\\" + c
        elif c == "(":
            out += "(?:"
        else:
            out += c
        i += 1
    return f"(?s)^(?:{out})$"


def similar_to(s, pattern: str, escape: str = "\\") -> Column:
    return _c(s).rlike(similar_regex(pattern, escape))


def string_to_array(s, delimiter: str | None, null: str | None = None) -> Column:
    """Pieces between delimiters, characters where it is null, the text whole where it is empty; an empty text has none."""
    s = _c(s)
    if delimiter is None:
        parts = F.filter(F.split(s, ""), lambda x: x != "")
    elif not delimiter:
        parts = F.array(s)
    else:
        parts = F.split(s, re.escape(delimiter) if delimiter.isalnum() else "\\Q" + delimiter + "\\E")
    parts = F.when(s == "", F.array().cast("array<string>")).when(s.isNotNull(), parts)
    return parts if null is None else F.transform(parts, lambda x: F.nullif(x, F.lit(null)))


def to_hex(n) -> Column:
    """Small hexadecimal digits; a negative int as its 32 bits, a bigint as its 64."""
    return F.lower(F.hex(_c(n)))


def quote_literal(s) -> Column:
    s = _c(s).cast("string")
    body = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(F.contains(s, F.lit("\\")), F.lit(" E'")).otherwise(F.lit("'")), body, F.lit("'"))


def quote_nullable(s) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


#: Words that are quoted as identifiers.
RESERVED = """all analyse analyze and any array as asc asymmetric authorization between bigint binary bit boolean both case cast char
character check coalesce collate collation column concurrently constraint create cross current_catalog current_date current_role
current_schema current_time current_timestamp current_user dec decimal default deferrable desc distinct do else end except exists
extract false fetch float for foreign freeze from full grant greatest group grouping having ilike in initially inner inout int integer
intersect interval into is isnull join lateral leading least left like limit localtime localtimestamp national natural nchar none not
notnull null nullif numeric offset on only or order out outer overlaps overlay placing position precision primary real references
returning right row select session_user setof similar smallint some substring symmetric table tablesample then time timestamp to
trailing treat trim true union unique user using values varchar variadic verbose when where window with xmlattributes xmlconcat
xmlelement xmlexists xmlforest xmlparse xmlpi xmlroot xmlserialize""".split()


def quote_ident(s) -> Column:
    s = _c(s)
    return F.when(s.rlike("^[a-z_][a-z0-9_]*$") & ~s.isin(RESERVED), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_(pattern: str, *xs) -> Column:
    """%s, %I and %L with %n$ positions, - and widths; %% is a percent sign."""
    parts, at, next_ = [], 0, 0
    for m in re.finditer(r"%(?:%|(?:(\d+)\$)?(-)?(\d+)?([sIL]))", pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[0] == "%%":
            parts.append(F.lit("%"))
            continue
        i = int(m[1]) - 1 if m[1] else next_
        next_ = i + 1
        x = _c(xs[i])
        x = {"s": lambda: F.coalesce(x.cast("string"), F.lit("")), "I": lambda: quote_ident(x.cast("string")), "L": lambda: quote_nullable(x)}[m[4]]()
        if m[3]:
            n = F.greatest(F.length(x), F.lit(int(m[3])))
            x = F.rpad(x, n, F.lit(" ")) if m[2] else F.lpad(x, n, F.lit(" "))
        parts.append(x)
    return F.concat(*parts, F.lit(pattern[at:]))


# Numbers


def div(a, b) -> Column:
    """Integer division towards zero."""
    a, b = _c(a), _c(b)
    return F.call_function("div", a, b)


def round_float(x) -> Column:
    """To the nearest integer, halves to even."""
    return F.rint(_c(x))


def trunc(x, digits: int = 0) -> Column:
    """Towards zero, of a decimal with so many digits kept."""
    x = _c(x)
    scale = F.lit(10**digits)
    return F.when(x < 0, F.ceil(x * scale) / scale).otherwise(F.floor(x * scale) / scale)


def degree(name: str, x) -> Column:
    """sind, cosd, tand or cotd: exact at multiples of 30 and 45 degrees."""
    x = _c(x)
    turn = F.pmod(x, F.lit(360.0))

    def sine(t: Column) -> Column:
        exact = {0.0: 0.0, 30.0: 0.5, 90.0: 1.0, 150.0: 0.5, 180.0: 0.0, 210.0: -0.5, 270.0: -1.0, 330.0: -0.5}
        out = F.sin(F.radians(t))
        for k, v in exact.items():
            out = F.when(t == k, F.lit(v)).otherwise(out)
        return out

    def cosine(t: Column) -> Column:
        return sine(F.pmod(t + 90.0, F.lit(360.0)))

    def tangent(t: Column) -> Column:
        half = F.pmod(t, F.lit(180.0))
        return F.when(half == 45.0, F.lit(1.0)).when(half == 135.0, F.lit(-1.0)).when(half == 90.0, F.lit(float("inf"))).otherwise(sine(t) / F.nullif(cosine(t), F.lit(0.0)))

    return {"sind": lambda: sine(turn), "cosd": lambda: cosine(turn), "tand": lambda: tangent(turn), "cotd": lambda: 1 / F.nullif(tangent(turn), F.lit(0.0))}[name]()


def width_bucket(x, thresholds: list) -> Column:
    """How many of the ascending thresholds are at or below x."""
    return F.size(F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: t <= _c(x)))


def num_nulls(*xs) -> Column:
    out = F.lit(0)
    for x in xs:
        out = out + _c(x).isNull().cast("int")
    return out


def between_symmetric(x, a, b) -> Column:
    return _c(x).between(F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def row_less(left: list, right: list) -> Column:
    """(a, b, ...) < (c, d, ...) field by field: null where a null decides."""
    out = F.lit(False)
    for a, b in reversed(list(zip(left, right, strict=True))):
        a, b = _c(a), _c(b)
        out = F.when(a == b, out).when(a != b, a < b)
    return out


# Dates. An interval is a struct (months, days, micros).

DAY = 86_400_000_000


def interval(years: int = 0, months: int = 0, weeks: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    micros = round(seconds * 1_000_000) + 60_000_000 * (minutes + 60 * hours)
    return F.struct(F.lit(12 * years + months).alias("months"), F.lit(days + 7 * weeks).alias("days"), F.lit(micros).cast("long").alias("micros"))


def interval_key(x: Column) -> Column:
    """What intervals compare by: a month is 30 days, a day 24 hours."""
    return (x.getField("months") * 30 + x.getField("days")).cast("decimal(38,0)") * DAY + x.getField("micros")


def justify_hours(x: Column) -> Column:
    whole = F.floor(F.abs(x.getField("micros")) / DAY) * F.signum(x.getField("micros").cast("double"))
    return F.struct(x.getField("months").alias("months"), (x.getField("days") + whole).cast("int").alias("days"), (x.getField("micros") - whole * DAY).cast("long").alias("micros"))


def justify_days(x: Column) -> Column:
    whole = F.floor(F.abs(x.getField("days")) / 30) * F.signum(x.getField("days").cast("double"))
    return F.struct((x.getField("months") + whole).cast("int").alias("months"), (x.getField("days") - whole * 30).cast("int").alias("days"), x.getField("micros").alias("micros"))


def add_interval(t, x: Column) -> Column:
    """Months first, with the day cut to the month's end, then days, then time."""
    t = F.add_months(_c(t), x.getField("months")).cast("timestamp_ntz") + (_c(t).cast("timestamp_ntz") - F.date_trunc("day", _c(t)).cast("timestamp_ntz"))
    return t + F.make_dt_interval(x.getField("days")) + F.make_dt_interval(secs=(x.getField("micros") / F.lit(1_000_000)).cast("decimal(18,6)"))


def extract(field: str, t) -> Column:
    t = _c(t)
    year = F.year(t)
    return {
        "dow": lambda: F.dayofweek(t) - 1,
        "isodow": lambda: F.weekday(t) + 1,
        "doy": lambda: F.dayofyear(t),
        "century": lambda: F.floor((year + 99) / 100).cast("int"),
        "decade": lambda: F.floor(year / 10).cast("int"),
        "millennium": lambda: F.floor((year + 999) / 1000).cast("int"),
        "epoch": lambda: F.unix_micros(t.cast("timestamp")) / 1_000_000,
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), t),
    }.get(field, lambda: F.extract(F.lit(field), t))()


def date_trunc(field: str, t) -> Column:
    year = F.year(_c(t))
    start = {"decade": lambda: F.floor(year / 10) * 10, "century": lambda: F.floor((year - 1) / 100) * 100 + 1, "millennium": lambda: F.floor((year - 1) / 1000) * 1000 + 1}
    if field in start:
        return F.make_date(start[field]().cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(field, _c(t)).cast("timestamp_ntz")


#: Parts of to_char templates and the patterns that stand for them.
TEMPLATE = (
    ("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("Month", "MMMM"), ("Mon", "MMM"), ("Day", "EEEE"), ("DDD", "DDD"),
    ("Dy", "EEE"), ("DD", "dd"), ("MI", "mm"), ("MM", "MM"), ("MS", "SSS"), ("US", "SSSSSS"), ("SS", "ss"), ("HH", "hh"), ("YY", "yy"), ("AM", "a"), ("Q", "Q"),
)


def template(pattern: str) -> str:
    """A to_char template as a date pattern; other letters are text."""
    out, i, text = "", 0, ""
    pattern = pattern.replace("FM", "")
    while i < len(pattern):
        hit = next(((a, b) for a, b in TEMPLATE if pattern.startswith(a, i)), None)
        if hit or not pattern[i].isalpha():
            out += f"'{text}'" if text else ""
            text = ""
            out += hit[1] if hit else pattern[i]
            i += len(hit[0]) if hit else 1
        else:
            text += pattern[i]
            i += 1
    return out + (f"'{text}'" if text else "")


def to_char(t, pattern: str) -> Column:
    return F.date_format(_c(t), template(pattern))


def overlaps(s1, e1, s2, e2) -> Column:
    """Whether two periods share a moment; ends may come in either order, and equal ends are a moment."""
    a, b = F.least(_c(s1), _c(e1)), F.greatest(_c(s1), _c(e1))
    c, d = F.least(_c(s2), _c(e2)), F.greatest(_c(s2), _c(e2))
    return F.when(a == c, F.lit(True)).when(a > c, a < d).otherwise(c < b)


# Arrays


def subscript(a, i: int) -> Column:
    """Element i from 1; null outside."""
    return F.get(_c(a), F.lit(i - 1)) if i > 0 else F.get(_c(a), F.lit(-1))


def array_slice(a, low: int, high: int) -> Column:
    low = max(low, 1)
    return F.slice(_c(a), low, max(high - low + 1, 0))


def contains_all(a, b) -> Column:
    """a @> b."""
    return F.size(F.array_except(_c(b), _c(a))) == 0


def array_length(a) -> Column:
    return F.nullif(F.size(_c(a)), F.lit(0))


def array_replace(a, old, new) -> Column:
    return F.transform(_c(a), lambda x: F.when(x.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(x))


def array_position(a, x) -> Column:
    return F.nullif(F.array_position(_c(a), x), F.lit(0))


def array_positions(a, x) -> Column:
    a = _c(a)
    return F.filter(F.transform(a, lambda e, i: F.when(e.eqNullSafe(F.lit(x)), i + 1)), lambda p: p.isNotNull())


def array_fill(value, *dims: int) -> Column:
    out = F.lit(value)
    for n in reversed(dims):
        out = F.array_repeat(out, n)
    return out


def unnest(*arrays: str) -> Column:
    """Several arrays side by side, padded with nulls, for inline()."""
    return F.inline(F.arrays_zip(*arrays))


# JSON


def json_text(j, *path) -> Column:
    """The element at a path of keys and numbers, as text (->> and #>>)."""
    at = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(_c(j), at)


def json_typeof(j) -> Column:
    j = F.trim(_c(j))
    first = F.substring(j, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(j.isin("true", "false"), "boolean").when(j == "null", "null").otherwise("number")


def json_has(j, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(j)), key), F.lit(False))


def build_object(**kv) -> Column:
    return F.to_json(F.struct(*(_c(v).alias(k) for k, v in kv.items())), {"ignoreNullFields": "false"})
