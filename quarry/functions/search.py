"""Full-text search beyond vectors and matching: dictionaries, weights, query operators, ranks by covers, headlines, token types.

A weighted vector is an array of struct(lexeme, positions, weights), weights being letters beside the positions.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import STOP, lexemes, parse_query
from .scalar import _c, let

# Dictionaries: functions of a word that give its lexemes, [] for a stop word, None for one they don't know.


def simple(stop: tuple[str, ...] = ()):
    return lambda w: [] if w.lower() in stop else [w.lower()]


def synonym(words: dict[str, str]):
    return lambda w: [words[w.lower()]] if w.lower() in words else None


def prefixed(endings: dict[str, tuple[str, ...]], words: set[str]):
    """An affix dictionary: a word is known where it is in words, or becomes one when an ending is replaced."""

    def look(w: str):
        w = w.lower()
        out = [w] if w in words else []
        for ending, others in endings.items():
            if w.endswith(ending):
                out += [w[: len(w) - len(ending)] + o for o in others if w[: len(w) - len(ending)] + o in words]
        return list(dict.fromkeys(out)) or None

    return look


def thesaurus(phrases: dict[str, str]):
    """Word by word only: phrases of one word."""
    return lambda w: phrases[w.lower()].split() if w.lower() in phrases else None


_VOWELS = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    """Where the parts after the first, and after the second, consonant behind a vowel begin."""
    def after(start: int) -> int:
        for i in range(start, len(w) - 1):
            if w[i] in _VOWELS and w[i + 1] not in _VOWELS:
                return i + 2
        return len(w)

    special = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    one = len(special) if special else after(0)
    return one, after(one)


def _short(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


#: Suffixes of the second to fourth steps of the English stemmer, and words it treats apart.
STEP2 = {"ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful", "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
APART = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")


@lru_cache(100_000)
def stem(word: str) -> str:
    """The English stem of a word in small letters."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in APART:
        return APART[w]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].*.s$", w):
        w = w[:-1]
    if w in KEPT:
        return w
    if w.endswith(("eed", "eedly")):
        n = 3 if w.endswith("eed") else 5
        w = w[:-n] + "ee" if len(w) - n >= r1 else w
    else:
        m = re.search("(ed|edly|ing|ingly)$", w)
        if m and re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short(w) and r1 >= len(w):
                w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                if s == "ogi":
                    w = w[:-1] if w[-4:-3] == "l" else w
                elif s == "li":
                    w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
                else:
                    w = w[: len(w) - len(s)] + STEP2[s]
            break
    for s in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(s):
            if s == "ative":
                w = w[:-5] if len(w) - 5 >= r2 else w
            elif len(w) - len(s) >= r1:
                w = w[: len(w) - len(s)] + STEP3[s]
            break
    for s in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: len(w) - len(s)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def snowball(stop: tuple[str, ...] = STOP):
    return lambda w: [] if w.lower() in stop else [stem(w.lower())]


def lexize(dictionaries: list, word: str) -> list[str] | None:
    """ts_lexize: what the first dictionary that knows a word makes of it."""
    for d in dictionaries:
        if (found := d(word)) is not None:
            return found
    return None


def tsvector(s, dictionaries: list) -> Column:
    """to_tsvector by a configuration: each word through its dictionaries; stop words count in positions."""

    def run(words: pd.Series) -> pd.Series:
        memo: dict[str, list[str]] = {}
        out = []
        for ws in words:
            if ws is None:
                out.append(None)
                continue
            for w in set(ws) - memo.keys():
                memo[w] = lexize(dictionaries, w) or []
            out.append([{"w": x, "p": i} for i, w in enumerate(ws, 1) for x in memo[w]])
            if len(memo) > 100_000:
                memo.clear()
        return pd.Series(out, dtype=object)

    words = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return lexemes(F.pandas_udf(run, "array<struct<w: string, p: int>>")(words))


def query(q: str, dictionaries: list):
    """to_tsquery by a configuration: words as their lexemes; stop words go."""

    def changed(node):
        if node is None:
            return None
        if node[0] == "w":
            found = lexize(dictionaries, node[1]) or []
            out = None
            for x in found:
                out = ("w", x) if out is None else ("&", out, ("w", x))
            return out
        if node[0] == "!":
            inner = changed(node[1])
            return None if inner is None else ("!", inner)
        a, b = changed(node[1]), changed(node[2])
        return b if a is None else a if b is None else (node[0], a, b)

    return changed(parse_query(q))


# Query operators


def _ast(q):
    return parse_query(q) if isinstance(q, str) else q


def both(a, b):
    """a && b."""
    return ("&", _ast(a), _ast(b))


def either(a, b):
    """a || b."""
    return ("|", _ast(a), _ast(b))


def negated(a):
    """!! a."""
    return ("!", _ast(a))


def followed(a, b, gap: int = 1):
    """a <-> b."""
    return ("<->" if gap == 1 else f"<{gap}>", _ast(a), _ast(b))


def words_of(q) -> set[str]:
    node = _ast(q)
    return set() if node is None else {node[1]} if node[0] == "w" else set().union(*map(words_of, node[1:]))


def query_contains(a, b) -> bool:
    """a @> b: all of b's words are among a's."""
    return words_of(b) <= words_of(a)


def query_text(q) -> str:
    """A query as it is shown."""
    rank = {"|": 0, "&": 1, "!": 3, "w": 4}

    def show(node, outer: int) -> str:
        if node[0] == "w":
            return f"'{node[1]}'"
        level = rank.get(node[0], 2)
        if node[0] == "!":
            return f"!{show(node[1], 3)}"
        text = f"{show(node[1], level)} {node[0]} {show(node[2], level)}"
        return f"( {text} )" if level < outer else text

    node = _ast(q)
    return "" if node is None else show(node, 0)


def querytree(q) -> str:
    """The part of a query that an index can use: without negations; T if nothing is left."""

    def kept(node):
        if node[0] == "w":
            return node
        if node[0] == "!":
            return None
        a, b = kept(node[1]), kept(node[2])
        if node[0] == "|":
            return None if a is None or b is None else (node[0], a, b)
        return b if a is None else a if b is None else (node[0], a, b)

    node = _ast(q)
    found = kept(node) if node else None
    return query_text(found) if found else "T"


def rewrite(q, target, by):
    """ts_rewrite: each part that equals target becomes by; operands of & and | in any order."""

    def key(node):
        if node[0] in "&|":
            def flat(n):
                return [x for c in n[1:] for x in flat(c)] if n[0] == node[0] else [n]

            return (node[0], tuple(sorted(map(key, flat(node)), key=repr)))
        return (node[0], *(key(c) if isinstance(c, tuple) else c for c in node[1:]))

    target, by = _ast(target), _ast(by)

    def changed(node):
        if key(node) == key(target):
            return by
        if node[0] == "w":
            return node
        parts = [changed(c) for c in node[1:]]
        parts = [p for p in parts if p is not None]
        if node[0] == "!":
            return ("!", parts[0]) if parts else None
        return None if not parts else parts[0] if len(parts) == 1 else (node[0], *parts)

    return changed(_ast(q))


# Weighted vectors


def set_weight(v, letter: str, only: list[str] | None = None) -> Column:
    """All positions, or those of some lexemes, with a weight; others have D."""
    mark = lambda x: F.transform(x.positions, lambda p: F.lit(letter))
    plain = lambda x: F.transform(x.positions, lambda p: F.lit("D"))
    choose = (lambda x: F.when(x.lexeme.isin(*only), mark(x)).otherwise(plain(x))) if only else mark
    return F.transform(_c(v), lambda x: F.struct(x.lexeme.alias("lexeme"), x.positions.alias("positions"), choose(x).alias("weights")))


def strip(v) -> Column:
    """Without positions and weights."""
    return F.transform(_c(v), lambda x: x.lexeme)


def length(v) -> Column:
    return F.size(_c(v))


def joined(a, b) -> Column:
    """a || b of weighted vectors: b's positions follow a's last."""
    def together(s: Column) -> Column:
        last = F.coalesce(F.array_max(F.flatten(F.transform(s.a, lambda x: x.positions))), F.lit(0))
        return let(last, lambda n: let(F.concat(marked(s.a, 0), marked(s.b, n)), lambda all_: let(F.sort_array(all_), merged)))

    def marked(v: Column, by) -> Column:
        return F.flatten(F.transform(v, lambda x: F.transform(F.arrays_zip(x.positions.alias("p"), x.weights.alias("w")), lambda z: F.struct(x.lexeme.alias("l"), (z.p + by).alias("p"), z.w.alias("w")))))

    def merged(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1).l != x.l), i)), lambda i: i.isNotNull())
        ends = let(starts, lambda st: F.transform(st, lambda i, k: F.struct(i.alias("i"), F.coalesce(F.get(st, k + 1), F.size(a)).alias("e"))))
        return F.transform(ends, lambda x: let(F.slice(a, x.i + 1, x.e - x.i), lambda r: F.struct(F.get(r, F.lit(0)).l.alias("lexeme"), F.transform(r, lambda y: y.p).alias("positions"), F.transform(r, lambda y: y.w).alias("weights"))))

    return let(F.struct(_c(a).alias("a"), _c(b).alias("b")), together)


def delete(v, *words: str) -> Column:
    """ts_delete."""
    return F.filter(_c(v), lambda x: ~x.lexeme.isin(*words))


def filtered(v, letters: str) -> Column:
    """ts_filter: positions with one of the weights; lexemes without any go."""
    keep = F.transform(_c(v), lambda x: F.struct(x.lexeme.alias("lexeme"), F.filter(F.arrays_zip(x.positions.alias("p"), x.weights.alias("w")), lambda z: z.w.isin(*letters)).alias("z")))
    return F.transform(F.filter(keep, lambda x: F.size(x.z) > 0), lambda x: F.struct(x.lexeme.alias("lexeme"), F.transform(x.z, lambda z: z.p).alias("positions"), F.transform(x.z, lambda z: z.w).alias("weights")))


def of_array(a) -> Column:
    """array_to_tsvector: lexemes without positions."""
    return F.transform(F.array_sort(F.array_distinct(_c(a))), lambda w: F.struct(w.alias("lexeme"), F.array().cast("array<int>").alias("positions")))


# Ranks and headlines

#: The weights of the letters D, C, B and A.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def rank_cd(s, words: list[str], dictionaries: list | None = None, letters: dict[str, str] | None = None, weights: dict[str, float] = WEIGHTS) -> Column:
    """ts_rank_cd of a text for words joined by &: over all shortest spans with every word, the mean weight by the words in between.

    letters gives words' weights, D for others.
    """
    of = {w: (letters or {}).get(w, "D") for w in words}

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for ws in texts:
            found = None if ws is None else [(i, x, of[x]) for i, w in enumerate(ws, 1) for x in (lexize(dictionaries, w) or [] if dictionaries else [w]) if x in of]
            out.append(None if found is None else _covers(found, words, weights))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(F.regexp_extract_all(F.lower(_c(s)), F.lit(r"([\p{L}\p{N}]+)"), 1))


def _covers(places: list[tuple[int, str, str]], words: list[str], weights: dict[str, float]) -> float:
    total, first, wanted = 0.0, 0, set(words)
    seen: dict[str, int] = {}
    for last, (_, w, _) in enumerate(places):
        seen[w] = last
        if len(seen) == len(wanted):
            begin = min(seen.values())
            if begin >= first:
                span = places[begin : last + 1]
                noise = max(places[last][0] - places[begin][0] - (len(span) - 1), 0)
                total += len(span) / sum(1 / weights[x[2]] for x in span) / (1 + noise)
                first = begin + 1
                del seen[places[begin][1]]
    return total


def headline(s, words: list[str], start: str = "<b>", stop: str = "</b>", most: int | None = None) -> Column:
    """ts_headline: the text with the words marked; with most, that many words from just before the first of them."""
    one = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    marked = F.regexp_replace(_c(s), rf"(?i)(?<![\p{{L}}\p{{N}}])({one})(?![\p{{L}}\p{{N}}])", f"{start}$1{stop}")
    if most is None:
        return marked
    pieces = F.filter(F.split(marked, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(pieces, lambda w: F.contains(w, F.lit(start))), True)
    return F.array_join(F.slice(pieces, F.greatest(at - most // 3, F.lit(1)).cast("int"), F.lit(most)), " ")


# The parser

#: Token types of the parser with their numbers, in the order in which they are tried.
TOKENS = (
    (4, "email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), (5, "url", r"(?:https?://)?[\w-]+(?:\.[\w-]+)+/[^\s<>]*"), (6, "host", r"[A-Za-z][\w-]*(?:\.[A-Za-z][\w-]*)+"),
    (20, "float", r"[-+]?\d+\.\d+"), (21, "int", r"[-+]?\d+(?![\w])"), (1, "asciiword", r"[A-Za-z]+(?![\w])"), (2, "word", r"[^\W\d_]+(?![\w])"), (3, "numword", r"\w+"), (12, "blank", r"\s+|."),
)


def ts_parse(s) -> Column:
    """An array of (tokid, token), for inline."""
    pattern = re.compile("|".join(f"(?P<t{n}>{p})" for n, _, p in TOKENS), re.DOTALL)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"tokid": int(m.lastgroup[1:]), "token": m[0]} for m in pattern.finditer(x)] for x in texts], dtype=object)

    return F.pandas_udf(run, "array<struct<tokid: int, token: string>>")(_c(s))


def token_types(spark):
    """ts_token_type: (tokid, alias)."""
    return spark.createDataFrame(sorted((n, name) for n, name, _ in TOKENS), "tokid int, alias string")


def vector_of(columns: list[str], dictionaries: list):
    """tsvector_update_trigger: a before trigger's function that fills column v from texts."""
    return lambda rows: rows.withColumn("v", tsvector(F.concat_ws(" ", *columns), dictionaries))


