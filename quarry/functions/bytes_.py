"""Bytes, patterns and identifiers: functions of bytea, and of text that scalar.py doesn't have."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c, java_regex, similar_regex

# Bytes


def get_byte(b, i) -> Column:
    i = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.hex(F.substring(_c(b), i + 1, F.lit(1))), 16, 10).cast("int")


def set_byte(b, i: int, to) -> Column:
    to = to if isinstance(to, Column) else F.lit(to)
    return F.overlay(_c(b), F.unhex(F.lpad(F.hex(to), 2, "0")), i + 1, 1)


def get_bit(b, i: int) -> Column:
    """Bit i from 0, the lowest of each byte first."""
    return F.shiftright(get_byte(b, i // 8), i % 8).bitwiseAND(F.lit(1))


def set_bit(b, i: int, to: int) -> Column:
    old, mask = get_byte(b, i // 8), 1 << (i % 8)
    return set_byte(b, i // 8, old.bitwiseOR(F.lit(mask)) if to else old.bitwiseAND(F.lit(255 - mask)))


def btrim_bytes(b, which: bytes) -> Column:
    """Without the bytes at either end that are among which."""
    one = "(?:" + "|".join(f"{x:02X}" for x in sorted(set(which))) + ")"
    # By whole bytes: pairs of hexadecimal digits.
    return F.unhex(F.regexp_replace(F.regexp_replace(F.hex(_c(b)), f"^{one}+", ""), f"(?<=^(?:[0-9A-F]{{2}}){{0,100000}}){one}+$", ""))


def decode(s, form: str) -> Column:
    """Text as bytes from hex, base64 or escape."""
    s = _c(s)
    if form == "hex":
        return F.unhex(F.regexp_replace(s, r"\s", ""))
    if form == "base64":
        return F.unbase64(F.regexp_replace(s, r"\s", ""))
    if form == "escape":
        parts = F.regexp_extract_all(s, F.lit(r"(?s)(\\[0-3][0-7]{2}|\\\\|[^\\]+)"), 1)
        as_hex = lambda p: F.when(p.rlike(r"^\\[0-3]"), F.lpad(F.conv(F.substr(p, F.lit(2)), 8, 16), 2, "0")).when(p == "\\\\", F.lit("5C")).otherwise(F.hex(p))
        return F.unhex(F.array_join(F.transform(parts, as_hex), ""))
    raise ValueError(f"unrecognized encoding: {form!r}")


def encode(b, form: str) -> Column:
    r"""Bytes as hex, base64 or escape: zero and high bytes as \ooo, a backslash doubled."""
    b = _c(b)
    if form == "hex":
        return F.lower(F.hex(b))
    if form == "base64":
        return F.base64(b)
    if form == "escape":
        pairs = F.regexp_extract_all(F.hex(b), F.lit("([0-9A-F]{2})"), 1)
        as_text = lambda p: F.when((p == "00") | (p >= "80"), F.concat(F.lit("\\"), F.lpad(F.conv(p, 16, 8), 3, "0"))).when(p == "5C", F.lit("\\\\")).otherwise(F.decode(F.unhex(p), "UTF-8"))
        return F.array_join(F.transform(pairs, as_text), "")
    raise ValueError(f"unrecognized encoding: {form!r}")


# Patterns


def regexp_split(s, pattern: str, flags: str = "") -> Column:
    """Pieces between matches, for explode (regexp_split_to_table); an empty match splits characters."""
    return F.split(_c(s), ("(?i)" if "i" in flags else "") + java_regex(pattern), -1)


def regexp_all(s, pattern: str, flags: str = "") -> Column:
    """regexp_matches with flag g: an array of each match's groups (or the match alone), for explode."""
    p = ("(?i)" if "i" in flags else "") + java_regex(pattern)
    groups = re.compile(re.sub(r"\\p\{\w+\}", "x", p)).groups
    if not groups:
        return F.transform(F.regexp_extract_all(_c(s), F.lit(f"({p})"), 1), lambda m: F.array(m))
    each = [F.regexp_extract_all(_c(s), F.lit(p), i) for i in range(1, groups + 1)]
    return F.transform(F.arrays_zip(*(x.alias(f"g{i}") for i, x in enumerate(each))), lambda m: F.array(*(m[f"g{i}"] for i in range(groups))))


def substring_similar(s, pattern: str, escape: str) -> Column:
    """SUBSTRING(s FROM pattern FOR escape): the part between two escaped quotes, where all matches."""
    parts = pattern.split(f'{escape}"')
    if len(parts) != 3:
        raise ValueError("the pattern needs two escaped quotes")
    body = [similar_regex(p, escape).removeprefix("(?s)^(?:").removesuffix(")$") for p in parts]
    first = body[0].replace(".*", ".*?")
    whole = f"(?s)^(?:{first})({body[1]})(?:{body[2]})$"
    return F.when(_c(s).rlike(whole), F.regexp_extract(_c(s), whole, 1))


def like_escape(pattern: str, escape: str) -> str:
    r"""A LIKE pattern with another escape as one with \."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and escape and i + 1 < len(pattern):
            i += 1
            out += ("\\" if pattern[i] in "%_\\" else "") + pattern[i]
        else:
            out += "\\\\" if c == "\\" else c
        i += 1
    return out


# Identifiers and names


def parse_ident(s, strict: bool = True) -> Column:
    """a."B c".d as an array: quoted parts as they are, others in small letters."""
    part = r'(?:"(?:[^"]|"")+"|[A-Za-z_\x80-\x{10FFFF}][A-Za-z0-9_$\x80-\x{10FFFF}]*)'
    s = _c(s)
    whole = rf"^\s*{part}(?:\s*\.\s*{part})*\s*" + ("$" if strict else "")
    parts = F.regexp_extract_all(F.regexp_extract(s, f"({whole})", 1), F.lit(f"({part})"), 1)
    clean = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(p)))
    return F.when(s.rlike(whole), clean).when(s.isNotNull(), F.raise_error(F.lit("string is not a valid identifier")).cast("array<string>"))


def name(s) -> Column:
    """Text as a name: 63 bytes at most, cut between characters."""
    s = _c(s).cast("string")
    size = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda n: F.when(F.octet_length(F.left(s, n)) <= 63, n))
    return F.when(F.octet_length(s) <= 63, s).otherwise(F.left(s, F.array_max(size)))


def char_code(s) -> Column:
    """The type "char": one byte, compared as unsigned; its number runs from -128 to 127."""
    n = get_byte(F.encode(_c(s), "UTF-8"), 0)
    return F.when(_c(s) == "", 0).when(n > 127, n - 256).otherwise(n)


def to_ascii(s) -> Column:
    """Latin letters without accents; other characters beyond ASCII become blanks."""
    return F.regexp_replace(unaccent(s), r"[^\x00-\x7F]", " ")


#: Letters with accents and what stands for them.
ACCENTS = dict(zip("ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīĬĭŁłŃńŇňŌōŐőŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž", "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiIiLlNnNnOoOoRrSsSsSsTtTtUuUuUuZzZzZz", strict=True))
JOINED = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Þ": "TH", "þ": "th"}


def unaccent(s) -> Column:
    """Text without accents."""
    out = F.translate(_c(s), "".join(ACCENTS), "".join(ACCENTS.values()))
    for a, b in JOINED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_part(s, delimiter: str, n: int) -> Column:
    """Field n from 1; empty beyond the last; an error for n below 1."""
    if n < 1:
        raise ValueError("field position must be greater than zero")
    return F.split_part(_c(s), F.lit(delimiter), F.lit(n))
