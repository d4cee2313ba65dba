"""Numbers as text by templates, checked arithmetic, money, bit strings, and random numbers."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c

# Templates


def _digits(x: Column, places: int, scale: int) -> tuple[Column, Column]:
    """The digits of |x| before and after the point, rounded halves away from zero; zero has none before it."""
    whole = F.round(F.abs(x.cast("decimal(38,10)")), scale).cast(f"decimal(38,{scale})").cast("string")
    before = F.ltrim(F.split_part(whole, F.lit("."), F.lit(1)), F.lit("0"))
    return before, F.split_part(whole, F.lit("."), F.lit(2)) if scale else F.lit("")


def to_char(x, pattern: str) -> Column:
    """A number by a template of 9 0 . D , G S MI PL PR FM V and RN. A number with too many digits is shown as #."""
    x, fill = _c(x), "FM" not in pattern
    body = pattern.replace("FM", "")
    if body == "RN":
        return roman(x, fill)
    sign = next((s for s in ("MI", "PL", "PR", "S") if s in body), "")
    first, last = body.startswith(sign) if sign else False, body.endswith(sign) if sign else False
    body = body.replace(sign, "", 1) if sign else body
    if "V" in body:
        moved = len(re.findall("[90]", body.split("V")[1]))
        x, body = x.cast("decimal(38,10)") * 10**moved, body.replace("V", "")
    whole, _, part = body.replace("D", ".").replace("G", ",").partition(".")
    places, scale = len(re.findall("[90]", whole)), len(re.findall("[90]", part))
    before, after = _digits(x, places, scale)
    if not scale and "." not in body:
        before = F.when(before == "", F.lit("0")).otherwise(before)
    zero = re.sub("[^90]", "", whole).find("0")
    forced = places - zero if zero >= 0 else 0
    before = F.when(F.length(before) < forced, F.lpad(before, forced, "0")).otherwise(before) if forced else before
    padded = F.lpad(before, max(places, 1), " ") if places else F.lit("")
    shown, at = [], 0
    for c in whole:
        if c in "90":
            at += 1
            shown.append(F.substr(padded, F.lit(at), F.lit(1)))
        elif c == ",":
            shown.append(F.when(F.substr(padded, F.lit(1), F.lit(at)).rlike(r"\d"), F.lit(",")).otherwise(F.lit(" ")))
        else:
            shown.append(F.lit(c))
    head = F.concat(*shown) if shown else F.lit("")
    if scale:
        least = len(re.sub("9+$", "", re.sub("[^90]", "", part)))
        kept = after if fill else F.when(F.length(F.rtrim(after, F.lit("0"))) < least, F.substr(after, F.lit(1), F.lit(least))).otherwise(F.rtrim(after, F.lit("0")))
        tail = F.concat(F.lit("."), kept)
    else:
        tail = F.lit("." if "." in body else "")
    negative = (x < 0) & (F.concat(before, after).rlike("[1-9]"))
    number = F.concat(head, tail)
    bare = F.ltrim(number)
    lead = lambda mark: F.lpad(F.concat(mark, bare), F.length(number) + 1, " ")  # noqa: E731  the sign stands before the first digit
    if sign == "PR":
        out = F.when(negative, F.lpad(F.concat(F.lit("<"), bare, F.lit(">")), F.length(number) + 2, " ")).otherwise(F.concat(F.lit(" "), number, F.lit(" ")))
    elif sign == "MI":
        mark = F.when(negative, F.lit("-")).otherwise(F.lit(" "))
        out = F.concat(mark, number) if first else F.concat(number, mark)
    elif sign == "PL":
        mark = F.when(negative, F.lit(" ")).otherwise(F.lit("+"))
        plain = lead(F.when(negative, F.lit("-")).otherwise(F.lit(" ")))
        out = F.concat(mark, plain) if first else F.concat(plain, mark)
    elif sign == "S":
        mark = F.when(negative, F.lit("-")).otherwise(F.lit("+"))
        out = F.concat(number, mark) if last else lead(mark)
    else:
        out = lead(F.when(negative, F.lit("-")).otherwise(F.lit(" ")))
    hashes = re.sub("[90]", "#", whole) + ("." + re.sub("[90]", "#", part) if scale else "")
    out = F.when(F.length(before) > places, F.lit((" " if not last else "") + hashes)).otherwise(out)
    return out if fill else F.btrim(out)


#: Roman numerals by value.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(x, fill: bool = True) -> Column:
    """1 to 3999, in 15 places."""
    rest, out = F.round(_c(x)).cast("int"), F.lit("")
    for n, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / n).cast("int")))
        rest = rest % n
    good = F.round(_c(x)).between(1, 3999)
    return F.when(good, F.lpad(out, 15, " ") if fill else out).otherwise(F.lit("#" * 15))


def to_number(s, pattern: str) -> Column:
    """The number that to_char shows by a template."""
    body = pattern.replace("D", ".").replace("G", ",")
    scale = len(re.findall("[90]", body.partition(".")[2]))
    kept = F.regexp_replace(_c(s), r"[^0-9.]", "")
    negative = F.contains(_c(s), F.lit("-")) | F.contains(_c(s), F.lit("<"))
    out = kept.cast(f"decimal(38,{scale})")
    return F.when(negative, -out).otherwise(out)


# Checked arithmetic: an error beyond the type's range and for a zero divisor.

#: The bounds of integer types.
BOUNDS = {"smallint": 1 << 15, "int": 1 << 31, "bigint": 1 << 63}


def checked(x, kind: str) -> Column:
    """x as a smallint, int or bigint; an error where it is out of range."""
    x, n = _c(x).cast("decimal(38,0)"), BOUNDS[kind]
    out = F.raise_error(F.lit(f"{kind} out of range")).cast(kind)
    return F.when(x.between(F.lit(-n).cast("decimal(38,0)"), F.lit(n - 1).cast("decimal(38,0)")), x.cast(kind)).when(x.isNotNull(), out)


def add(a, b, kind: str = "int") -> Column:
    return checked(_c(a).cast("decimal(38,0)") + _c(b).cast("decimal(38,0)"), kind)


def subtract(a, b, kind: str = "int") -> Column:
    return checked(_c(a).cast("decimal(38,0)") - _c(b).cast("decimal(38,0)"), kind)


def multiply(a, b, kind: str = "int") -> Column:
    return checked(_c(a).cast("decimal(19,0)") * _c(b).cast("decimal(19,0)"), kind)


def divide(a, b) -> Column:
    """Of floats: an error for a zero divisor, and for an overflow."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    out = F.when(b != 0, a / F.nullif(b, F.lit(0.0)))
    out = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(out)
    over = (F.abs(out) == float("inf")) & (F.abs(a) != float("inf"))
    return F.when(over, F.raise_error(F.lit("value out of range: overflow")).cast("double")).otherwise(out)


def ratio(a, b) -> Column:
    """Of floats, unchecked: infinite or not a number for a zero divisor, whose sign counts, and infinite beyond the range."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.nullif(b, F.lit(0.0)))


def rounded(x, n: int) -> Column:
    """x to n places: the scaled number to a whole one, halves away from zero. A zero keeps its sign, and a number too large to scale stays."""
    scaled = _c(x) * 10.0**n
    even = F.rint(scaled)
    out = F.when(F.abs(scaled - even) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(even) / 10.0**n
    return F.when(F.abs(out) < float("inf"), out).otherwise(_c(x))


def libm(name: str, x) -> Column:
    """asin, acos or atan of the C library, as other engines have them: Java's differ in the last bit here and there."""

    def run(v: pa.Array) -> pa.Array:
        return getattr(pc, name)(v)

    return F.arrow_udf(run, "double")(_c(x).cast("double"))


def arc(name: str, x) -> Column:
    """asind, acosd, atand: degrees, exact for the sines and tangents of multiples of 30 and 45."""
    exact = {"asind": {0.5: 30.0, 1.0: 90.0, -0.5: -30.0, -1.0: -90.0}, "acosd": {1.0: 0.0, 0.5: 60.0, 0.0: 90.0, -1.0: 180.0}, "atand": {1.0: 45.0, -1.0: -45.0}}[name]

    def run(v: pa.Array) -> pa.Array:
        out = pc.multiply(getattr(pc, name[:-1])(v), 180 / math.pi)
        for k, d in exact.items():
            out = pc.if_else(pc.equal(v, k), d, out)
        return out

    return F.arrow_udf(run, "double")(_c(x).cast("double"))


# Money: decimal(19,2)


def money(x) -> Column:
    return F.round(_c(x).cast("decimal(28,9)"), 2).cast("decimal(19,2)")


def money_text(x) -> Column:
    """$1,234.50, a minus before the sign."""
    x = _c(x)
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), F.format_number(F.abs(x), 2))


#: English numbers.
SMALL = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
THOUSANDS = ("", " thousand", " million", " billion", " trillion", " quadrillion")


def money_words(x) -> Column:
    """cash_words: One hundred twenty three dollars and forty five cents."""
    cents = F.abs(_c(x).cast("decimal(19,2)") * 100).cast("long")
    word = lambda n: F.element_at(F.array(*map(F.lit, SMALL)), n.cast("int") + 1)
    tens = lambda n: F.element_at(F.array(*map(F.lit, TENS)), n.cast("int") + 1)
    whole = lambda a, n: F.floor(a / n).cast("long")

    def below_hundred(n: Column) -> Column:
        return F.when(n < 20, word(F.least(n, F.lit(19)))).when(n % 10 == 0, tens(whole(n, 10))).otherwise(F.concat(tens(whole(n, 10)), F.lit(" "), word(n % 10)))

    def below_thousand(n: Column) -> Column:
        hundreds = F.when(n >= 100, F.concat(word(F.least(whole(n, 100), F.lit(19))), F.lit(" hundred")))
        return F.concat_ws(" ", hundreds, F.when(n % 100 > 0, below_hundred(n % 100)))

    dollars, parts = whole(cents, 100), []
    for i in reversed(range(len(THOUSANDS))):
        group = whole(dollars, 1000**i) % 1000
        parts.append(F.when(group > 0, F.concat(below_thousand(group), F.lit(THOUSANDS[i]))))
    text = F.concat_ws(" ", *parts)
    text = F.when(text == "", F.lit("zero")).otherwise(text)
    text = F.concat(F.when(_c(x) < 0, F.lit("minus ")).otherwise(F.lit("")), text, F.when(dollars == 1, F.lit(" dollar and ")).otherwise(F.lit(" dollars and ")), below_hundred(cents % 100), F.when(cents % 100 == 1, F.lit(" cent")).otherwise(F.lit(" cents")))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


# Bit strings: texts of 0 and 1


def bits(n, width: int) -> Column:
    """An integer as so many bits, the last ones."""
    return F.right(F.lpad(F.bin(_c(n).cast("long")), 64, "0"), F.lit(width))


def bits_number(b) -> Column:
    """At most 64 bits as a bigint; the first of 64 is the sign."""
    return F.conv(_c(b), 2, -10).cast("long")


def _zipped(a, b, f) -> Column:
    a, b = _c(a), _c(b)
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    out = F.array_join(F.zip_with(chars(a), chars(b), f), "")
    return F.when(F.length(a) == F.length(b), out).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("cannot combine bit strings of different sizes")).cast("string"))


def bits_and(a, b) -> Column:
    return _zipped(a, b, lambda x, y: F.least(x, y))


def bits_or(a, b) -> Column:
    return _zipped(a, b, lambda x, y: F.greatest(x, y))


def bits_xor(a, b) -> Column:
    return _zipped(a, b, lambda x, y: F.when(x == y, "0").otherwise("1"))


def bits_not(a) -> Column:
    return F.translate(_c(a), "01", "10")


def bits_shift(a, n: int) -> Column:
    """a << n, or a >> -n; the length stays."""
    a, size = _c(a), F.length(_c(a))
    return F.rpad(F.substr(a, F.lit(n + 1)), size, F.lit("0")) if n >= 0 else F.lpad(F.left(a, F.greatest(size + n, F.lit(0))), size, F.lit("0"))


def bits_get(a, i: int) -> Column:
    return F.substr(_c(a), F.lit(i + 1), F.lit(1)).cast("int")


def bits_set(a, i: int, to: int) -> Column:
    return F.overlay(_c(a), F.lit(str(to)), i + 1, 1)


# Random numbers


def random(seed: int | None = None) -> Column:
    """From 0 to 1; with setseed's seed the same numbers for the same partitions."""
    return F.rand() if seed is None else F.rand(seed)


def normal_rand(spark, n: int, mean: float, deviation: float, seed: int | None = None):
    """n rows of normally distributed numbers."""
    z = F.randn() if seed is None else F.randn(seed)
    return spark.range(n).select((z * deviation + mean).alias("x"))


def num_nonnulls(*xs) -> Column:
    out = F.lit(0)
    for x in xs:
        out = out + _c(x).isNotNull().cast("int")
    return out


def row_is_null(*xs) -> Column:
    """ROW(...) IS NULL: all fields are."""
    return num_nonnulls(*xs) == 0


def row_is_not_null(*xs) -> Column:
    """ROW(...) IS NOT NULL: no field is; a row with some nulls is neither."""
    return num_nonnulls(*xs) == len(xs)
