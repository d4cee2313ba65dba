"""Types that Spark lacks, as structs and arrays: ranges, addresses, geometry, cubes, key-value maps, trigrams, text search."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c, let

# Ranges: struct(lo, hi, lo_inc, hi_inc); a null bound is infinite. Discrete ones stand as [lo, hi).


def range_(lo, hi, bounds: str = "[)", discrete: bool = False) -> Column:
    lo, hi, lo_inc, hi_inc = _c(lo), _c(hi), bounds[0] == "[", bounds[1] == "]"
    if discrete:
        lo, lo_inc = (lo if lo_inc else lo + 1), True
        hi, hi_inc = (hi + 1 if hi_inc else hi), False
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(lo_inc).alias("lo_inc"), F.lit(hi_inc).alias("hi_inc"))


def _f(r, name: str) -> Column:
    return _c(r).getField(name)


def is_empty(r) -> Column:
    same = (_f(r, "lo") == _f(r, "hi")) & ~(_f(r, "lo_inc") & _f(r, "hi_inc"))
    return F.coalesce((_f(r, "lo") > _f(r, "hi")) | same, F.lit(False))


def before(a, b) -> Column:
    """a << b."""
    touch = (_f(a, "hi") == _f(b, "lo")) & ~(_f(a, "hi_inc") & _f(b, "lo_inc"))
    return F.coalesce((_f(a, "hi") < _f(b, "lo")) | touch, F.lit(False)) & ~is_empty(a) & ~is_empty(b)


def overlap(a, b) -> Column:
    """a && b."""
    return ~before(a, b) & ~before(b, a) & ~is_empty(a) & ~is_empty(b)


def adjacent(a, b) -> Column:
    meet = lambda x, y: F.coalesce((_f(x, "hi") == _f(y, "lo")) & (_f(x, "hi_inc") != _f(y, "lo_inc")), F.lit(False))
    return (meet(a, b) | meet(b, a)) & ~is_empty(a) & ~is_empty(b)


def has(r, x) -> Column:
    """r @> element."""
    x = _c(x)
    low = _f(r, "lo").isNull() | (x > _f(r, "lo")) | ((x == _f(r, "lo")) & _f(r, "lo_inc"))
    high = _f(r, "hi").isNull() | (x < _f(r, "hi")) | ((x == _f(r, "hi")) & _f(r, "hi_inc"))
    return low & high & ~is_empty(r)


def has_range(a, b) -> Column:
    """a @> b; an empty range is in every range."""
    low = _f(a, "lo").isNull() | F.coalesce((_f(a, "lo") < _f(b, "lo")) | ((_f(a, "lo") == _f(b, "lo")) & (_f(a, "lo_inc") | ~_f(b, "lo_inc"))), F.lit(False))
    high = _f(a, "hi").isNull() | F.coalesce((_f(a, "hi") > _f(b, "hi")) | ((_f(a, "hi") == _f(b, "hi")) & (_f(a, "hi_inc") | ~_f(b, "hi_inc"))), F.lit(False))
    return is_empty(b) | (low & high & ~is_empty(a))


def intersection(a, b) -> Column:
    """a * b; null where they share nothing."""
    lo = F.greatest(_f(a, "lo"), _f(b, "lo"))
    hi = F.least(_f(a, "hi"), _f(b, "hi"))
    lo_inc = (~(_f(a, "lo") == lo) | _f(a, "lo_inc")) & (~(_f(b, "lo") == lo) | _f(b, "lo_inc"))
    hi_inc = (~(_f(a, "hi") == hi) | _f(a, "hi_inc")) & (~(_f(b, "hi") == hi) | _f(b, "hi_inc"))
    yes = F.lit(True)
    return F.when(overlap(a, b), F.struct(lo.alias("lo"), hi.alias("hi"), F.coalesce(lo_inc, yes).alias("lo_inc"), F.coalesce(hi_inc, yes).alias("hi_inc")))


def range_merge(a, b) -> Column:
    """The smallest range that holds both; an empty one adds nothing."""
    either = lambda x, y, f: F.when(x.isNotNull() & y.isNotNull(), f(x, y))
    lo, hi = either(_f(a, "lo"), _f(b, "lo"), F.least), either(_f(a, "hi"), _f(b, "hi"), F.greatest)
    inc = lambda r, c, x: (_f(r, c) == x) & _f(r, f"{c}_inc")
    no = F.lit(False)
    both = F.struct(lo.alias("lo"), hi.alias("hi"), F.coalesce(inc(a, "lo", lo) | inc(b, "lo", lo), no).alias("lo_inc"), F.coalesce(inc(a, "hi", hi) | inc(b, "hi", hi), no).alias("hi_inc"))
    return F.when(is_empty(a), _c(b)).when(is_empty(b), _c(a)).otherwise(both)


def union(a, b) -> Column:
    """a + b; an error where a gap lies between them."""
    together = is_empty(a) | is_empty(b) | overlap(a, b) | adjacent(a, b)
    return F.when(together, range_merge(a, b)).otherwise(F.when(F.raise_error(F.lit("result of range union would not be contiguous")).cast("boolean"), range_merge(a, b)))


def difference(a, b) -> Column:
    """a - b; null for nothing left, an error where two parts would be."""
    parts = ~F.coalesce(_f(b, "lo").isNull(), F.lit(False)) & F.coalesce((_f(a, "lo") < _f(b, "lo")) | _f(a, "lo").isNull(), F.lit(False)) & F.coalesce((_f(a, "hi") > _f(b, "hi")) | _f(a, "hi").isNull(), F.lit(False)) & _f(b, "hi").isNotNull() & overlap(a, b)
    left = F.struct(_f(a, "lo").alias("lo"), _f(b, "lo").alias("hi"), _f(a, "lo_inc").alias("lo_inc"), (~_f(b, "lo_inc")).alias("hi_inc"))
    right = F.struct(_f(b, "hi").alias("lo"), _f(a, "hi").alias("hi"), (~_f(b, "hi_inc")).alias("lo_inc"), _f(a, "hi_inc").alias("hi_inc"))
    error = F.raise_error(F.lit("result of range difference would not be contiguous")).cast("boolean")
    out = F.when(~overlap(a, b), _c(a)).when(has_range(b, a), F.lit(None)).when(parts, F.when(error, _c(a)))
    return out.when(F.coalesce(_f(a, "lo") < _f(b, "lo"), _f(b, "lo").isNotNull()) | ((_f(a, "lo") == _f(b, "lo")) & _f(a, "lo_inc") & ~_f(b, "lo_inc")), left).otherwise(right)


def lower_inf(r) -> Column:
    return _f(r, "lo").isNull() & ~is_empty(r)


def upper_inf(r) -> Column:
    return _f(r, "hi").isNull() & ~is_empty(r)


def not_right(a, b) -> Column:
    """a &< b: a doesn't go beyond b's upper bound."""
    beyond = _f(b, "hi").isNotNull() & F.coalesce((_f(a, "hi") > _f(b, "hi")) | ((_f(a, "hi") == _f(b, "hi")) & _f(a, "hi_inc") & ~_f(b, "hi_inc")), F.lit(True))
    return ~beyond & ~is_empty(a) & ~is_empty(b)


def not_left(a, b) -> Column:
    """a &> b: a doesn't begin before b's lower bound."""
    before_ = _f(b, "lo").isNotNull() & F.coalesce((_f(a, "lo") < _f(b, "lo")) | ((_f(a, "lo") == _f(b, "lo")) & _f(a, "lo_inc") & ~_f(b, "lo_inc")), F.lit(True))
    return ~before_ & ~is_empty(a) & ~is_empty(b)


def range_key(r) -> Column:
    """What ranges compare and hash by: empty ones first, then lower bounds, then upper ones, infinite where null."""
    empty = is_empty(r)
    only = lambda x: F.when(~empty, x)
    return F.struct(
        (~empty).alias("some"), only(_f(r, "lo").isNotNull()).alias("lo_known"), only(_f(r, "lo")).alias("lo"), only((~_f(r, "lo_inc")) & _f(r, "lo").isNotNull()).alias("lo_out"),
        only(_f(r, "hi").isNull()).alias("hi_open"), only(_f(r, "hi")).alias("hi"), only(_f(r, "hi_inc") & _f(r, "hi").isNotNull()).alias("hi_in"),
    )


# Network addresses (IPv4): text 'a.b.c.d/n'.


def inet_number(x) -> Column:
    """The address as a bigint."""
    parts = F.split(F.split_part(_c(x), F.lit("/"), F.lit(1)), r"\.")
    return sum((F.get(parts, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(parts, F.lit(0)).cast("long") * (1 << 24))


def inet_text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def masklen(x) -> Column:
    rest = F.split_part(_c(x), F.lit("/"), F.lit(2))
    return F.when(rest == "", 32).otherwise(rest).cast("int")


def host(x) -> Column:
    return F.split_part(_c(x), F.lit("/"), F.lit(1))


def _mask(x) -> Column:
    return F.lit((1 << 32) - 1) - (F.pow(F.lit(2.0), 32 - masklen(x)).cast("long") - 1)


def netmask(x) -> Column:
    return inet_text(_mask(x))


def hostmask(x) -> Column:
    return inet_text(F.lit((1 << 32) - 1) - _mask(x))


def network(x) -> Column:
    return F.concat(inet_text(inet_number(x).bitwiseAND(_mask(x))), F.lit("/"), masklen(x).cast("string"))


def broadcast_address(x) -> Column:
    return F.concat(inet_text(inet_number(x).bitwiseOR(F.lit((1 << 32) - 1) - _mask(x))), F.lit("/"), masklen(x).cast("string"))


def within_network(a, b) -> Column:
    """a <<= b."""
    return (masklen(a) >= masklen(b)) & (inet_number(a).bitwiseAND(_mask(b)) == inet_number(b).bitwiseAND(_mask(b)))


# Geometry: points are struct(x, y), boxes struct(x1, y1, x2, y2) with the larger corner first, circles struct(x, y, r).


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def distance(a, b) -> Column:
    return F.hypot(_f(a, "x") - _f(b, "x"), _f(a, "y") - _f(b, "y"))


#: Fixed value: the largest double, the slope of a vertical line.
LARGEST = 1.7976931348623157e308


def slope(a, b) -> Column:
    return F.when(_f(a, "x") == _f(b, "x"), F.lit(LARGEST)).otherwise((_f(a, "y") - _f(b, "y")) / (_f(a, "x") - _f(b, "x")))


def box(a, b) -> Column:
    return F.struct(F.greatest(_f(a, "x"), _f(b, "x")).alias("x1"), F.greatest(_f(a, "y"), _f(b, "y")).alias("y1"), F.least(_f(a, "x"), _f(b, "x")).alias("x2"), F.least(_f(a, "y"), _f(b, "y")).alias("y2"))


def box_overlap(a, b) -> Column:
    return (_f(a, "x1") >= _f(b, "x2")) & (_f(b, "x1") >= _f(a, "x2")) & (_f(a, "y1") >= _f(b, "y2")) & (_f(b, "y1") >= _f(a, "y2"))


def box_contains(a, b) -> Column:
    return (_f(a, "x1") >= _f(b, "x1")) & (_f(a, "x2") <= _f(b, "x2")) & (_f(a, "y1") >= _f(b, "y1")) & (_f(a, "y2") <= _f(b, "y2"))


def box_area(a) -> Column:
    return (_f(a, "x1") - _f(a, "x2")) * (_f(a, "y1") - _f(a, "y2"))


def box_center(a) -> Column:
    return point((_f(a, "x1") + _f(a, "x2")) / 2, (_f(a, "y1") + _f(a, "y2")) / 2)


def circle_area(c) -> Column:
    return math.pi * _f(c, "r") * _f(c, "r")


def circle_overlap(a, b) -> Column:
    return distance(a, b) <= _f(a, "r") + _f(b, "r")


def circle_distance(a, b) -> Column:
    return F.greatest(distance(a, b) - (_f(a, "r") + _f(b, "r")), F.lit(0.0))


def polygon_area(points) -> Column:
    """Of an array of points, by the shoelace sum."""
    p = _c(points)
    turn = F.transform(p, lambda a, i: a.x * F.get(p, F.pmod(i + 1, F.size(p))).y - a.y * F.get(p, F.pmod(i + 1, F.size(p))).x)
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda s, x: s + x)) / 2


def in_polygon(points, p) -> Column:
    """Whether a point lies inside a polygon, by crossings of a ray."""
    q = _c(points)
    cross = F.transform(q, lambda a, i: F.struct(a.alias("a"), F.get(q, F.pmod(i + 1, F.size(q))).alias("b")))
    hits = F.filter(cross, lambda e: ((e.a.y > _f(p, "y")) != (e.b.y > _f(p, "y"))) & (_f(p, "x") < (e.b.x - e.a.x) * (_f(p, "y") - e.a.y) / (e.b.y - e.a.y) + e.a.x))
    return F.size(hits) % 2 == 1


#: Fixed value: the earth's radius in metres.
EARTH = 6378168.0


def earth_distance(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres on a sphere of radius EARTH."""
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


# Cubes: points as arrays.


def _fold(a, b, f, start=0.0, last=None) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), f), F.lit(start), lambda s, x: s + x, last)


def cube_distance(a, b) -> Column:
    return _fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")), last=F.sqrt)


def taxicab(a, b) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def chebyshev(a, b) -> Column:
    return F.array_max(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def cube_union(a, b) -> Column:
    """(lower, upper) corners of the smallest cube with both points."""
    return F.struct(F.zip_with(_c(a), _c(b), lambda x, y: F.least(x, y)).alias("ll"), F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(x, y)).alias("ur"))


# Key-value maps from text 'k=>v, ...'.


#: One side of a pair: in quotes, where \ escapes, or bare.
_HALF = r'(?:"(?:[^"\\]|\\.)*"|(?:[^\s,=>"\\]|\\.|=(?!>))+)'


def hstore(s) -> Column:
    """A map from text; null where the word NULL stands unquoted; the first of equal keys counts."""
    pair = rf"(?s)({_HALF})\s*=>\s*({_HALF})"
    plain = lambda x: F.regexp_replace(F.when(F.startswith(x, F.lit('"')), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x), r"(?s)\\(.)", "$1")
    keys = F.transform(F.regexp_extract_all(_c(s), F.lit(pair), 1), plain)
    values = F.transform(F.regexp_extract_all(_c(s), F.lit(pair), 2), lambda v: F.when(F.upper(v) != "NULL", plain(v)))
    entries = F.arrays_zip(keys.alias("key"), values.alias("value"))
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x.key), e.key) == i + 1))


def map_text(m) -> Column:
    """A map as text, keys in order of length and then of bytes."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    entries = F.array_sort(F.transform(F.map_entries(_c(m)), lambda e: F.struct(F.octet_length(e.key).alias("n"), e.key.alias("k"), e.value.alias("v"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(quoted(e.k), F.lit("=>"), F.coalesce(quoted(e.v), F.lit("NULL")))), ", ")


def map_slice(m, keys: list[str]) -> Column:
    return F.map_filter(_c(m), lambda k, v: k.isin(*keys))


def map_defined(m, key: str) -> Column:
    """The key is there with a value that isn't null."""
    return F.try_element_at(_c(m), F.lit(key)).isNotNull()


def map_has_all(m, keys: list[str]) -> Column:
    """m ?& keys."""
    return F.size(F.array_intersect(F.map_keys(_c(m)), F.array(*map(F.lit, keys)))) == len(set(keys))


def map_has_any(m, keys: list[str]) -> Column:
    """m ?| keys."""
    return F.arrays_overlap(F.map_keys(_c(m)), F.array(*map(F.lit, keys)))


def map_matrix(m) -> Column:
    """hstore_to_matrix: (key, value) arrays."""
    return F.transform(F.map_entries(_c(m)), lambda e: F.array(e.key, e.value))


def map_json(m) -> Column:
    return F.to_json(_c(m), {"ignoreNullFields": "false"})


def map_minus_map(a, b) -> Column:
    """a without the pairs that b has too."""
    return F.map_filter(_c(a), lambda k, v: ~F.coalesce(F.map_contains_key(_c(b), k) & F.try_element_at(_c(b), k).eqNullSafe(v), F.lit(False)))


def map_contains(a, b) -> Column:
    """a @> b."""
    return F.forall(F.map_entries(_c(b)), lambda e: F.coalesce(F.element_at(_c(a), e.key).eqNullSafe(e.value) & F.map_contains_key(_c(a), e.key), F.lit(False)))


def map_join(a, b) -> Column:
    """a || b, where b's values win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(_c(a)), lambda e: ~F.map_contains_key(_c(b), e.key)), F.map_entries(_c(b))))


def map_minus(a, keys: list[str]) -> Column:
    return F.map_filter(_c(a), lambda k, v: ~k.isin(*keys))


# Label paths 'a.b.c'.


def nlevel(p) -> Column:
    return F.when(_c(p) == "", 0).otherwise(F.size(F.split(_c(p), r"\.")))


def subpath(p, offset: int, length: int | None = None) -> Column:
    parts = F.split(_c(p), r"\.")
    start = F.lit(offset) if offset >= 0 else F.size(parts) + offset
    n = F.size(parts) - start if length is None else (F.lit(length) if length >= 0 else F.size(parts) - start + length)
    return F.array_join(F.slice(parts, start + 1, F.greatest(n, F.lit(0))), ".")


def is_ancestor(a, b) -> Column:
    """a @> b."""
    return (_c(a) == _c(b)) | F.startswith(_c(b), F.concat(_c(a), F.lit(".")))


def lquery(pattern: str) -> str:
    """A path pattern (*, *{n,m}, a|b, !a, %, @, *) as a regular expression over 'x.y.z.'."""
    out = ""
    for item in pattern.split("."):
        m = re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", item)
        if m:
            lo, comma, hi = m[1] or "0" if m[1] is not None else "0", m[2], m[3]
            out += r"(?:[^.]+\.)" + ("*" if m[1] is None and not comma else f"{{{lo}}}" if not comma else f"{{{lo},{hi or ''}}}")
            continue
        negative, item = item.startswith("!"), item.lstrip("!")
        options = []
        for x in item.split("|"):
            flags = re.search(r"[@*%]*$", x)[0]
            body = re.escape(x[: len(x) - len(flags)])
            body = body + r"[^.]*" if "*" in flags else body
            options.append(f"(?i:{body})" if "@" in flags else body)
        out += (rf"(?!(?:{'|'.join(options)})\.)[^.]+\." if negative else rf"(?:{'|'.join(options)})\.")
    return f"^{out}$"


def matches_path(p, pattern: str) -> Column:
    return F.concat(_c(p), F.lit(".")).rlike(lquery(pattern))


def lca(*paths) -> Column:
    """The longest common ancestor: a common prefix that is shorter than each path."""
    parts = [F.split(_c(p), r"\.") for p in paths]
    shortest = F.least(*(F.size(x) for x in parts)) if len(parts) > 1 else F.size(parts[0])
    first = F.slice(parts[0], 1, F.greatest(shortest - 1, F.lit(0)))
    same = F.transform(first, lambda x, i: F.forall(F.array(*(F.get(p, i) for p in parts)), lambda y: y == x))
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(first).cast("long"))
    return F.array_join(F.slice(first, F.lit(1), n.cast("int")), ".")


# Trigrams.


def trigrams(s) -> Column:
    """The distinct trigrams of a text's words, each padded with two blanks before and one after, sorted."""
    words = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3)))))))


def similarity(a, b) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays."""
    both = F.size(F.array_intersect(_c(a), _c(b)))
    all_ = F.size(F.array_union(_c(a), _c(b)))
    return F.when(all_ > 0, both / all_).otherwise(0.0)


# Full text: a tsvector is an array of struct(lexeme, positions), by lexeme.

#: English words that a search leaves out.
STOP = ("a", "about", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "do", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "she", "so", "some", "than", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you", "your")


def to_tsvector(s, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case words with their positions from 1, one sort a text; stop words count in positions but aren't kept."""
    words = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return lexemes(F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p"))), stop)


def lexemes(placed, stop: tuple[str, ...] = ()) -> Column:
    """A tsvector of an array of (w, p)."""
    if stop:
        placed = F.filter(placed, lambda x: ~x.w.isin(*stop))
    return let(F.sort_array(placed), _runs)


def _runs(a: Column) -> Column:
    starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1).w != x.w), i)), lambda i: i.isNotNull())
    with_end = let(starts, lambda st: F.transform(st, lambda i, k: F.struct(i.alias("i"), F.coalesce(F.get(st, k + 1), F.size(a)).alias("e"))))
    return F.transform(with_end, lambda x: F.struct(F.get(a, x.i).w.alias("lexeme"), F.transform(F.slice(a, x.i + 1, x.e - x.i), lambda y: y.p).alias("positions")))


def _tokens(q: str) -> list[str]:
    return re.findall(r"<->|<\d+>|[&|!()]|[^\s&|!()<>]+", q)


def parse_query(q: str):
    """An AST of (op, ...) from & | ! <-> <n> ( ) and words."""
    tokens, at = _tokens(q), 0

    def take(level: int):
        nonlocal at
        if level == 3:
            if tokens[at] == "!":
                at += 1
                return ("!", take(3))
            if tokens[at] == "(":
                at += 1
                out = take(0)
                at += 1
                return out
            at += 1
            return ("w", tokens[at - 1].lower().strip("'"))
        found = take(level + 1)
        while at < len(tokens) and (tokens[at] == "|&"[level] if level < 2 else tokens[at].startswith("<")):
            op = tokens[at]
            at += 1
            found = (op, found, take(level + 1))
        return found

    return take(0) if tokens else None


def ts_match(vector, query) -> Column:
    """vector @@ query; query is text or an AST. Phrases compare positions."""
    v = _c(vector)
    ast = parse_query(query) if isinstance(query, str) else query

    def places(node) -> Column:
        if node[0] == "w":
            return F.flatten(F.transform(F.filter(v, lambda x: x.lexeme == node[1]), lambda x: x.positions))
        gap = 1 if node[0] == "<->" else int(node[0][1:-1])
        return F.array_intersect(F.transform(places(node[1]), lambda p: p + gap), places(node[2]))

    def test(node) -> Column:
        if node[0] == "!":
            return ~test(node[1])
        if node[0] in "&|":
            a, b = test(node[1]), test(node[2])
            return a & b if node[0] == "&" else a | b
        if node[0] == "w":
            return F.exists(v, lambda x: x.lexeme == node[1])
        return F.size(places(node)) > 0

    return test(ast) if ast else F.lit(False)


def plain_query(s: str, stop: tuple[str, ...] = (), op: str = "&"):
    """Words joined by & (plainto_tsquery) or <-> (phraseto_tsquery)."""
    out = None
    for w in re.findall(r"\w+", s.lower()):
        if w not in stop:
            out = ("w", w) if out is None else (op, out, ("w", w))
    return out


def numnode(node) -> int:
    return 0 if node is None else 1 + sum(numnode(x) for x in node[1:] if isinstance(x, tuple))


#: Fixed value: pi squared over six.
RANK_NORM = 1.64493406685


def ts_rank(vector, words: list[str], weight: float = 0.1) -> Column:
    """Word frequencies of a weight, each later place counting by its inverse square, over pi squared sixths."""
    one = lambda w: F.aggregate(
        F.transform(F.flatten(F.transform(F.filter(_c(vector), lambda x: x.lexeme == w), lambda x: x.positions)), lambda p, i: weight / F.pow((i + 1).cast("double"), F.lit(2.0))),
        F.lit(0.0), lambda s, x: s + x,
    )
    return sum((one(w) for w in words[1:]), one(words[0])) / RANK_NORM / len(words)
