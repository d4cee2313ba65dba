"""Addresses, identifiers, book numbers, sounds of words, word similarity, label paths, the earth, digests, and dictionaries of numbers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import EARTH, _f, host, inet_number, inet_text, masklen, network, trigrams, within_network
from .scalar import _c

# Addresses


def set_masklen(x, n) -> Column:
    return F.concat(host(x), F.lit("/"), (n if isinstance(n, Column) else F.lit(n)).cast("string"))


def inet(x) -> Column:
    """As it is shown: a full mask isn't."""
    return F.when(masklen(x) == 32, host(x)).otherwise(F.concat(host(x), F.lit("/"), masklen(x).cast("string")))


def inet_key(x) -> Column:
    """What addresses compare by: the network, then the mask's length, then the address."""
    return F.struct(inet_number(network(x)).alias("net"), masklen(x).alias("len"), inet_number(x).alias("at"))


def inside(a, b) -> Column:
    """a << b."""
    return within_network(a, b) & (masklen(a) > masklen(b))


def inet_overlap(a, b) -> Column:
    """a && b."""
    return within_network(a, b) | within_network(b, a)


def inet_not(x) -> Column:
    return F.concat(inet_text(F.lit((1 << 32) - 1) - inet_number(x)), F.lit("/"), masklen(x).cast("string"))


def _both(a, b, n: Column) -> Column:
    return F.concat(inet_text(n), F.lit("/"), F.greatest(masklen(a), masklen(b)).cast("string"))


def inet_and(a, b) -> Column:
    return _both(a, b, inet_number(a).bitwiseAND(inet_number(b)))


def inet_or(a, b) -> Column:
    return _both(a, b, inet_number(a).bitwiseOR(inet_number(b)))


def inet_plus(x, n) -> Column:
    """An error beyond the last address."""
    to = inet_number(x) + n
    good = to.between(0, (1 << 32) - 1)
    return F.when(good, F.concat(inet_text(to), F.lit("/"), masklen(x).cast("string"))).otherwise(F.raise_error(F.lit("result is out of range")).cast("string"))


def inet_minus(a, b) -> Column:
    """Addresses between two."""
    return inet_number(a) - inet_number(b)


def inet_merge(a, b) -> Column:
    """The smallest network with both."""
    differ = inet_number(a).bitwiseXOR(inet_number(b))
    common = F.when(differ == 0, 32).otherwise(31 - F.floor(F.log2(differ.cast("double"))).cast("int"))
    n = F.least(common, masklen(a), masklen(b)).cast("int")
    return network(set_masklen(a, n))


def abbrev(x) -> Column:
    """A network without its last zeros."""
    octets = F.split(host(network(x)), r"\.")
    kept = F.greatest(F.ceil(masklen(x) / 8), F.lit(1)).cast("int")
    return F.concat(F.array_join(F.slice(octets, F.lit(1), kept), "."), F.lit("/"), masklen(x).cast("string"))


def family(x) -> Column:
    return F.when(F.contains(_c(x), F.lit(":")), 6).otherwise(4)


def macaddr(x) -> Column:
    """Six bytes in small letters with colons, from any of the forms."""
    digits = F.lower(F.regexp_replace(_c(x), "[^0-9A-Fa-f]", ""))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substr(digits, 2 * i + 1, F.lit(2)))
    return F.when(F.length(digits) == 12, F.array_join(pairs, ":")).when(_c(x).isNotNull(), F.raise_error(F.lit("invalid input syntax for type macaddr")).cast("string"))


def macaddr_number(x) -> Column:
    return F.conv(F.replace(macaddr(x), F.lit(":")), 16, 10).cast("long")


def _mac(n: Column) -> Column:
    return macaddr(F.lpad(F.hex(n), 12, "0"))


def macaddr_trunc(x) -> Column:
    """The maker's part: the last three bytes zero."""
    return F.concat(F.substring(macaddr(x), 1, 9), F.lit("00:00:00"))


def macaddr_not(x) -> Column:
    return _mac(F.lit((1 << 48) - 1) - macaddr_number(x))


def macaddr_and(a, b) -> Column:
    return _mac(macaddr_number(a).bitwiseAND(macaddr_number(b)))


def macaddr_or(a, b) -> Column:
    return _mac(macaddr_number(a).bitwiseOR(macaddr_number(b)))


# Identifiers


def uuid(x) -> Column:
    """32 hexadecimal digits in groups, from any of the forms."""
    d = F.lower(F.regexp_replace(_c(x), "[{}-]", ""))
    groups = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(d.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *groups)).when(_c(x).isNotNull(), F.raise_error(F.lit("invalid input syntax for uuid")).cast("string"))


#: Namespaces of names.
NAMESPACES = {"dns": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "url": "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "oid": "6ba7b812-9dad-11d1-80b4-00c04fd430c8", "x500": "6ba7b814-9dad-11d1-80b4-00c04fd430c8"}


def _versioned(digest: Column, version: int) -> Column:
    """A digest's first 16 bytes with a version and the variant set."""
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return uuid(F.concat(F.substring(digest, 1, 12), F.lit(str(version)), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


def uuid_v3(namespace: str, name) -> Column:
    return _versioned(F.md5(F.concat(F.unhex(F.lit(NAMESPACES.get(namespace, namespace).replace("-", ""))), F.encode(_c(name), "UTF-8"))), 3)


def uuid_v5(namespace: str, name) -> Column:
    return _versioned(F.sha1(F.concat(F.unhex(F.lit(NAMESPACES.get(namespace, namespace).replace("-", ""))), F.encode(_c(name), "UTF-8"))), 5)


def uuid_v4() -> Column:
    return F.uuid()


def uuid_v1() -> Column:
    """By the clock: 100 ns since 1582, a random clock sequence and node for the batch (uuid_generate_v1mc)."""

    def run(x: pd.Series) -> pd.Series:
        import uuid as u

        node = u.uuid4().int >> 80 | 1 << 40
        return pd.Series([str(u.uuid1(node)) for _ in range(len(x))])

    return F.pandas_udf(run, "string")(F.lit(0))


def lsn(x) -> Column:
    """pg_lsn as a number: X/Y in hexadecimal."""
    part = lambda i: F.conv(F.split_part(_c(x), F.lit("/"), F.lit(i)), 16, 10).cast("decimal(20,0)")
    return part(1) * (1 << 32) + part(2)


def lsn_minus(a, b) -> Column:
    return lsn(a) - lsn(b)


def oidvector_key(x) -> Column:
    """What vectors of numbers compare by: their length, then number by number."""
    a = F.transform(F.split(F.trim(_c(x)), r"\s+"), lambda n: n.cast("bigint"))
    return F.struct(F.size(a).alias("n"), a.alias("a"))


def tid_key(x) -> Column:
    """(block,place) as what row addresses compare by."""
    part = lambda i: F.regexp_extract(_c(x), r"\((\d+),(\d+)\)", i).cast("bigint")
    return F.struct(part(1).alias("block"), part(2).alias("place"))


# Book and article numbers


def _weighted(digits: Column, weights: list[int]) -> Column:
    return sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def ean13(x) -> Column:
    """13 digits with a right check digit; null else."""
    d = F.regexp_replace(_c(x), "[- ]", "")
    return F.when(d.rlike("^[0-9]{13}$") & (_weighted(F.substring(d, 1, 13), [1, 3] * 6 + [1]) % 10 == 0), d)


def isbn10(x) -> Column:
    """10 digits, the last of which may be X; null where the check digit is wrong."""
    d = F.upper(F.regexp_replace(_c(x), "[- ]", ""))
    last = F.when(F.substring(d, 10, 1) == "X", 10).otherwise(F.substring(d, 10, 1).try_cast("int"))
    return F.when(d.rlike("^[0-9]{9}[0-9X]$") & ((_weighted(d, list(range(10, 1, -1))) + last) % 11 == 0), d)


def isbn13(x) -> Column:
    """An ISBN of 10 or 13 digits as one of 13."""
    short = F.concat(F.lit("978"), F.substring(isbn10(x), 1, 9))
    check = (10 - _weighted(short, [1, 3] * 6) % 10) % 10
    return F.coalesce(F.when(F.startswith(ean13(x), F.lit("978")) | F.startswith(ean13(x), F.lit("979")), ean13(x)), F.concat(short, check.cast("string")))


def issn(x) -> Column:
    d = F.upper(F.regexp_replace(_c(x), "[- ]", ""))
    last = F.when(F.substring(d, 8, 1) == "X", 10).otherwise(F.substring(d, 8, 1).try_cast("int"))
    return F.when(d.rlike("^[0-9]{7}[0-9X]$") & ((_weighted(d, list(range(8, 1, -1))) + last) % 11 == 0), F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4)))


# Sounds


def difference(a, b) -> Column:
    """Places at which two words' Soundex codes agree, 0 to 4."""
    one, two = F.soundex(_c(a)), F.soundex(_c(b))
    return sum((F.when(F.substring(one, i, 1) == F.substring(two, i, 1), 1).otherwise(0) for i in range(1, 5)), F.lit(0))


#: Rules of Metaphone as patterns on capitals and what they sound like, tried in order at each place.
SOUNDS = (
    (r"^(?:AE)", "E", 2), (r"^(?:GN|KN|PN|WR)", None, 1), (r"^X", "S", 1), (r"^WH", "W", 2),
    (r"(?<=M)B$", "", 1), (r"CIA", "X", 1), (r"(?<=S)C(?=[EIY])", "", 1), (r"(?<!S)CH", "X", 2), (r"(?<=S)CH", "K", 2), (r"C(?=[EIY])", "S", 1), (r"C", "K", 1),
    (r"DG(?=[EIY])", "J", 2), (r"D", "T", 1), (r"GH(?=[^AEIOU]|$)", "", 2), (r"G(?=N(?:ED)?$)", "", 1), (r"(?<!G)G(?=[EIY])", "J", 1), (r"G", "K", 1),
    (r"(?<=[CSPTG])H", "", 1), (r"H(?=[AEIOU])", "H", 1), (r"H", "", 1), (r"(?<=C)K", "", 1), (r"PH", "F", 2), (r"Q", "K", 1), (r"SH", "X", 2), (r"S(?=I[OA])", "X", 1),
    (r"T(?=I[OA])", "X", 1), (r"TH", "0", 2), (r"T(?=CH)", "", 1), (r"V", "F", 1), (r"W(?=[AEIOU])", "W", 1), (r"W", "", 1), (r"X", "KS", 1), (r"Y(?=[AEIOU])", "Y", 1), (r"Y", "", 1), (r"Z", "S", 1),
    (r"[FJLMNRBKPST]", "same", 1),
)


def sound(word: str, most: int = 255) -> str:
    """Metaphone of a word."""
    w = re.sub(r"([A-BD-Z])\1+", r"\1", re.sub("[^A-Z]", "", word.upper()))
    out, at = "", 0
    while at < len(w) and len(out) < most:
        if w[at] in "AEIOU" and not (at == 0 and w.startswith("AE")):
            out += w[at] if at == 0 else ""
            at += 1
            continue
        for pattern, to, n in SOUNDS:
            if re.compile(pattern).match(w, at):
                out += w[at] if to == "same" else to or ""
                at += n
                break
        else:
            at += 1
    return out[:most]


def metaphone(s, most: int = 255) -> Column:
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else sound(w, most), na_action=None).astype(object)

    return F.pandas_udf(run, "string")(_c(s))


# Similar words


def word_similarity(a, b) -> Column:
    """The greatest share of a's trigrams that an unbroken run of b's words' trigrams has, of all of both."""

    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _best(x, y) for x, y in zip(one, two, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(_c(a), _c(b))


def _grams(text: str) -> list[str]:
    return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)]


def _best(a: str, b: str) -> float:
    mine, theirs = set(_grams(a)), _grams(b)
    best = 0.0
    for i in range(len(theirs)):
        if theirs[i] not in mine:
            continue
        inside, run = 0, set()
        for g in theirs[i:]:
            if g not in run:
                run.add(g)
                inside += g in mine
            if g in mine:
                best = max(best, inside / (len(mine) + len(run) - inside))
    return best


def similar(a, b, least: float = 0.3) -> Column:
    """a % b: a similarity above the limit, as set_limit gives it."""
    from .kinds import similarity

    return similarity(trigrams(a), trigrams(b)) >= least


def dissimilarity(a, b) -> Column:
    """a <-> b of texts."""
    from .kinds import similarity

    return 1 - similarity(trigrams(a), trigrams(b))


# Label paths


def subltree(p, start: int, end: int) -> Column:
    return F.array_join(F.slice(F.split(_c(p), r"\."), start + 1, end - start), ".")


def path_index(p, q, offset: int = 0) -> Column:
    """The first place at which q's labels stand in p, -1 if there is none."""
    a, b = F.split(_c(p), r"\."), F.split(_c(q), r"\.")
    at = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i >= offset) & (F.slice(a, i + 1, F.size(b)) == b))
    return F.coalesce(F.get(at, F.lit(0)), F.lit(-1))


def path_words(p, q: str) -> Column:
    """p @ q: labels by words with & | ! and brackets; @ any case, * a beginning, % a word of a label."""
    tokens, at = re.findall(r"[&|!()]|[^\s&|!()]+", q), 0

    def one(word: str) -> Column:
        flags = re.search(r"[@*%]*$", word)[0]
        body = re.escape(word[: len(word) - len(flags)])
        pattern = (r"(?:^|.*_)" if "%" in flags else "^") + body + (r"[^_]*(?:_.*)?$" if {"*", "%"} <= set(flags) else r"(?:_.*)?$" if "%" in flags else ".*$" if "*" in flags else "$")
        return F.exists(F.split(_c(p), r"\."), lambda x: x.rlike(("(?i)" if "@" in flags else "") + pattern))

    def take(level: int) -> Column:
        nonlocal at
        if level == 2:
            token = tokens[at]
            at += 1
            if token == "!":
                return ~take(2)
            if token == "(":
                out = take(0)
                at += 1
                return out
            return one(token)
        out = take(level + 1)
        while at < len(tokens) and tokens[at] == "|&"[level]:
            at += 1
            more = take(level + 1)
            out = out | more if level == 0 else out & more
        return out

    return take(0)


# The earth: a point is a cube of three metres


def ll_to_earth(lat, lon) -> Column:
    a, b = F.radians(_c(lat)), F.radians(_c(lon))
    return F.array(EARTH * F.cos(a) * F.cos(b), EARTH * F.cos(a) * F.sin(b), EARTH * F.sin(a))


def latitude(e) -> Column:
    return F.degrees(F.asin(F.get(_c(e), F.lit(2)) / EARTH))


def longitude(e) -> Column:
    return F.degrees(F.atan2(F.get(_c(e), F.lit(1)), F.get(_c(e), F.lit(0))))


def sec_to_gc(x) -> Column:
    """A straight distance as one along the surface."""
    return 2 * EARTH * F.asin(F.least(_c(x) / (2 * EARTH), F.lit(1.0)))


def gc_to_sec(x) -> Column:
    return 2 * EARTH * F.sin(_c(x) / (2 * EARTH))


def earth_box(e, metres) -> Column:
    """(ll, ur) corners of a cube with all points so far along the surface."""
    d = gc_to_sec(metres if isinstance(metres, Column) else F.lit(float(metres)))
    return F.struct(F.transform(_c(e), lambda x: x - d).alias("ll"), F.transform(_c(e), lambda x: x + d).alias("ur"))


def in_cube(c, p) -> Column:
    """c @> p."""
    low = F.forall(F.zip_with(_f(c, "ll"), _c(p), lambda a, x: a <= x), lambda t: t)
    return low & F.forall(F.zip_with(_f(c, "ur"), _c(p), lambda a, x: a >= x), lambda t: t)


def cubes_overlap(a, b) -> Column:
    """a && b of cubes (ll, ur)."""
    one = F.forall(F.zip_with(_f(a, "ll"), _f(b, "ur"), lambda x, y: x <= y), lambda t: t)
    return one & F.forall(F.zip_with(_f(b, "ll"), _f(a, "ur"), lambda x, y: x <= y), lambda t: t)


def cube_inter(a, b) -> Column:
    return F.struct(F.zip_with(_f(a, "ll"), _f(b, "ll"), lambda x, y: F.greatest(x, y)).alias("ll"), F.zip_with(_f(a, "ur"), _f(b, "ur"), lambda x, y: F.least(x, y)).alias("ur"))


def cube_size(c) -> Column:
    """The volume."""
    return F.aggregate(F.zip_with(_f(c, "ll"), _f(c, "ur"), lambda a, b: b - a), F.lit(1.0), lambda s, x: s * x)


def point_degrees(a, b) -> Column:
    """a <@> b: statute miles between points of longitude and latitude."""
    from .kinds import earth_distance

    return earth_distance(_f(a, "y"), _f(a, "x"), _f(b, "y"), _f(b, "x")) * (3958.747716 / EARTH)


# Digests and ciphers


def digest(x, kind: str) -> Column:
    x = _c(x)
    return {"md5": lambda: F.unhex(F.md5(x)), "sha1": lambda: F.unhex(F.sha1(x)), **{f"sha{n}": (lambda n=n: F.unhex(F.sha2(x, n))) for n in (224, 256, 384, 512)}}[kind]()


def hmac(x, key, kind: str) -> Column:
    def run(data: pd.Series, keys: pd.Series) -> pd.Series:
        import hmac as h

        return pd.Series([None if d is None or k is None else h.digest(bytes(k), bytes(d), kind) for d, k in zip(data, keys, strict=True)], dtype=object)

    as_bytes = lambda c: c.cast("binary")
    return F.pandas_udf(run, "binary")(as_bytes(_c(x)), as_bytes(_c(key)))


def encrypt(x, key, mode: str = "ECB", iv: Column | None = None) -> Column:
    """AES of keys with 16, 24 or 32 bytes, padded; CBC with a vector of 16 bytes."""
    return F.aes_encrypt(_c(x), _c(key), F.lit(mode), F.lit("PKCS"), *([iv] if iv is not None else []))


def decrypt(x, key, mode: str = "ECB") -> Column:
    return F.aes_decrypt(_c(x), _c(key), F.lit(mode), F.lit("PKCS"))


# Dictionaries


def dict_int(most: int = 6, reject: bool = False):
    """Integers by their first digits; longer ones as stop words if they are rejected."""
    return lambda w: None if not w.isdigit() else [] if reject and len(w) > most else [w[:most]]


def dict_xsyn(words: dict[str, list[str]], original: bool = True):
    """A word as all its synonyms."""
    return lambda w: None if w.lower() not in words else ([w.lower()] if original else []) + words[w.lower()]


