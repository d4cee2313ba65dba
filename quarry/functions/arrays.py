"""Arrays with dimensions and lower bounds, integer arrays, and segments.

A plain array has the lower bound 1 and as many dimensions as arrays are nested; bounds(a, ...) gives others.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c

# Dimensions. dims is the number of dimensions, which the column's type fixes.


def ndims(a, dims: int = 1) -> Column:
    """Null for an empty array."""
    return F.when(F.size(_c(a)) > 0, F.lit(dims))


def length(a, dim: int = 1) -> Column:
    """Elements of a dimension; null for an empty array or a dimension that there isn't."""
    a = _c(a)
    for _ in range(dim - 1):
        a = F.get(a, F.lit(0))
    return F.nullif(F.size(a), F.lit(0))


def lower(a, dim: int = 1, low: int = 1) -> Column:
    return F.when(length(a, dim).isNotNull(), F.lit(low))


def upper(a, dim: int = 1, low: int = 1) -> Column:
    return length(a, dim) + (low - 1)


def dims_text(a, dims: int = 1, lows: tuple[int, ...] = ()) -> Column:
    """array_dims: [1:2][1:3]."""
    lows = lows or (1,) * dims
    parts = [F.concat(F.lit(f"[{low}:"), upper(a, i + 1, low).cast("string"), F.lit("]")) for i, low in enumerate(lows)]
    return F.concat(*parts)


def cardinality(a, dims: int = 1) -> Column:
    """Elements of all dimensions."""
    a = _c(a)
    for _ in range(dims - 1):
        a = F.flatten(a)
    return F.size(a)


def fill(value, sizes: list[int]) -> Column:
    """array_fill; a size of 0 makes an empty array."""
    out = value if isinstance(value, Column) else F.lit(value)
    for n in reversed(sizes):
        out = F.array_repeat(out, n)
    return out


def subscripts(a, dim: int = 1, reverse: bool = False, low: int = 1) -> Column:
    """generate_subscripts, for explode."""
    n = F.coalesce(length(a, dim), F.lit(0))
    up = F.when(n > 0, F.sequence(F.lit(low), n + (low - 1))).otherwise(F.array().cast("array<int>"))
    return F.reverse(up) if reverse else up


def position(a, x, start: int = 1) -> Column:
    """The first place of x from start on; null if there is none."""
    x = x if isinstance(x, Column) else F.lit(x)
    at = F.filter(F.transform(_c(a), lambda e, i: F.when(e.eqNullSafe(x) & (i >= start - 1), i + 1)), lambda p: p.isNotNull())
    return F.get(at, F.lit(0))


def contained(a, b) -> Column:
    """a <@ b; nulls are in nothing."""
    return (F.size(F.array_except(_c(a), _c(b))) == 0) & ~F.exists(_c(a), lambda x: x.isNull())


def less(a, b) -> Column:
    """a < b: element by element with nulls last, then the shorter first."""
    return key(a) < key(b)


def key(a) -> Column:
    """What arrays compare by."""
    return F.transform(_c(a), lambda x: F.struct(x.isNull().alias("n"), x.alias("v")))


def hash_of(a) -> Column:
    """A hash that equal arrays share."""
    return F.xxhash64(F.to_json(F.struct(_c(a).alias("a")), {"ignoreNullFields": "false"}))


# Integer arrays


def icount(a) -> Column:
    return F.size(_c(a))


def sort(a, descending: bool = False) -> Column:
    return F.sort_array(_c(a), not descending)


def uniq(a) -> Column:
    """Without repetitions of neighbours."""
    a = _c(a)
    return F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x))


def idx(a, x) -> Column:
    """The first place of x; 0 if there is none."""
    return F.array_position(_c(a), x).cast("int")


def subarray(a, start: int, count: int | None = None) -> Column:
    """From place start, or from the end where it is negative; count below 0 leaves out so many at the end."""
    a = _c(a)
    first = F.lit(start) if start > 0 else F.greatest(F.size(a) + start + 1, F.lit(1))
    n = F.size(a) if count is None else F.lit(count) if count >= 0 else F.greatest(F.size(a) + count - first + 1, F.lit(0))
    return F.slice(a, first, n)


def plus(a, x) -> Column:
    """a + element or array."""
    return F.concat(_c(a), x)


def minus(a, x) -> Column:
    """a - element, or the sorted set a - b of arrays."""
    if isinstance(x, Column):
        return F.sort_array(F.array_except(_c(a), x))
    return F.filter(_c(a), lambda e: e != x)


def union(a, b) -> Column:
    """a | b: the sorted set."""
    return F.sort_array(F.array_union(_c(a), b if isinstance(b, Column) else F.array(F.lit(b))))


def intersect(a, b) -> Column:
    """a & b: the sorted set."""
    return F.sort_array(F.array_intersect(_c(a), _c(b)))


def matches(a, query: str) -> Column:
    """a @@ query: numbers with & | ! and brackets."""
    tokens, at = re.findall(r"-?\d+|[&|!()]", query), 0

    def take(level: int) -> Column:
        nonlocal at
        if level == 2:
            token, at_ = tokens[at], at + 1
            at = at_
            if token == "!":
                return ~take(2)
            if token == "(":
                out = take(0)
                at += 1
                return out
            return F.array_contains(_c(a), int(token))
        out = take(level + 1)
        while at < len(tokens) and tokens[at] == "|&"[level]:
            at += 1
            more = take(level + 1)
            out = out | more if level == 0 else out & more
        return out

    return take(0)


# Segments: struct(lo, hi), with null for an open end


def seg(lo, hi=None) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = lo if hi is None else hi if isinstance(hi, Column) else F.lit(hi)
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def seg_parse(s) -> Column:
    """A segment from text: 1 .. 2, 1 .., .. 2, 1(+-)0.5 or one number, with ~ < > before numbers left out."""
    s = F.regexp_replace(_c(s), r"[~<>\s]", "")
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    around = s.rlike(rf"^{number}\(\+-\){number}$")
    middle, half = F.regexp_extract(s, rf"^{number}\(", 1).try_cast("double"), F.regexp_extract(s, rf"\){number}$", 1).try_cast("double")
    left, right = F.split_part(s, F.lit(".."), F.lit(1)), F.split_part(s, F.lit(".."), F.lit(2))
    lo = F.when(around, middle - half).otherwise(left.try_cast("double"))
    hi = F.when(around, middle + half).when(F.contains(s, F.lit("..")), right.try_cast("double")).otherwise(left.try_cast("double"))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


_lo = lambda s: F.coalesce(_c(s).getField("lo"), F.lit(float("-inf")))
_hi = lambda s: F.coalesce(_c(s).getField("hi"), F.lit(float("inf")))


def seg_size(s) -> Column:
    return _hi(s) - _lo(s)


def seg_center(s) -> Column:
    return (_lo(s) + _hi(s)) / 2


def seg_overlap(a, b) -> Column:
    return (_lo(a) <= _hi(b)) & (_lo(b) <= _hi(a))


def seg_contains(a, b) -> Column:
    return (_lo(a) <= _lo(b)) & (_hi(a) >= _hi(b))


def seg_left(a, b) -> Column:
    return _hi(a) < _lo(b)


def seg_over_left(a, b) -> Column:
    """a &< b."""
    return _hi(a) <= _hi(b)


def seg_union(a, b) -> Column:
    return F.struct(F.least(_lo(a), _lo(b)).alias("lo"), F.greatest(_hi(a), _hi(b)).alias("hi"))


def seg_inter(a, b) -> Column:
    return F.struct(F.greatest(_lo(a), _lo(b)).alias("lo"), F.least(_hi(a), _hi(b)).alias("hi"))
