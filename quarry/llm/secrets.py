"""Secret scans: spans found in texts, and corpus-wide ownership of their values."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, rejoined, slices, small, table, texts, trimming, written

#: The base kinds in their order, each with its pattern, the group that is the secret, and its least length.
KINDS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The method's own kind: long mixed tokens, reported unless they are widely copied examples.
OWN = "live"
ORDER = {kind: i for i, kind in enumerate([*(k[0] for k in KINDS), OWN])}
LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Same matches as the base hex pattern with short runs dropped, found without stopping at each letter.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Bits a character from which a token looks random; owners from which a value is a widely copied example; most owners of
#: one that looks live, in however many repositories.
RANDOM_BITS, EXAMPLE_OWNERS, LIVE_OWNERS = 3.2, 4, 1


def entropy(x: str) -> float:
    """Bits a character."""
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values())


def looks_random(x: str) -> bool:
    mixed = any(c.isdigit() for c in x) and any(c.isalpha() for c in x)
    return mixed and entropy(x) >= RANDOM_BITS


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, secret) of the base findings, by start and then by kind."""
    found = []
    for kind, pattern, group, least in KINDS:
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), kind, m.end(), m[group]))
    found.sort(key=lambda x: (x[0], ORDER[x[1]]))
    return found


def own_spans(text: str, base: list) -> list[tuple[int, str, int, str]]:
    """Long tokens that look random and overlap no base finding; one merge of two ascending lists."""
    out, at, reach = [], 0, 0
    for m in LONG_TOKEN.finditer(text):
        # reach: how far the base findings that start before the token's end go.
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and looks_random(m[0]):
            out.append((m.start(), OWN, m.end(), m[0]))
    return out


FOUND = "kinds array<string>, starts array<bigint>, ends array<bigint>, values array<binary>, random array<boolean>"
_KINDS = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.bool_()))


def scanned(docs: DataFrame, text: str, keep: dict[str, str]) -> DataFrame:
    """keep's columns (new name: column) and the text's candidates as parallel arrays; values are 128-bit digests of the secrets."""
    wanted = docs.select(*(F.col(c).alias(n) for n, c in keep.items()), F.col(text).cast("string").alias("__text"))
    out = wanted.drop("__text").schema
    for field in docs.sparkSession.createDataFrame([], FOUND).schema:
        out = out.add(field)

    def found(batches):
        for batch in slices(batches):
            rows = []
            for x in texts(batch.column(len(keep))):
                base = base_spans(x)
                spans = base + own_spans(x, base)
                digests = [hashlib.blake2b(s[3].encode(), digest_size=16).digest() for s in spans]
                rows.append(([s[1] for s in spans], [s[0] for s in spans], [s[2] for s in spans], digests, [looks_random(s[3]) for s in spans]))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=out.fieldNames())

    return wanted.mapInArrow(trimming(found), out)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos, copies, verdict) from (value, owner, repo), counted over the whole corpus; copies are its rows.

    Each repository, then each owner, is counted once by aggregates with partial sums, so a value that a third of all rows
    hold is added up in parts. verdict: example where EXAMPLE_OWNERS or more have it, live where at most LIVE_OWNERS do,
    else shared. A null owner or repository counts as one of its own.
    """
    repos = candidates.select("value", F.struct("owner").alias("o"), F.struct("repo").alias("r")).groupBy("value", "o", "r").agg(F.count("*").alias("rows"))
    owners = repos.groupBy("value", "o").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    out = owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"), F.sum("rows").alias("copies"))
    live = F.col("n_owners") <= LIVE_OWNERS
    return out.withColumn("verdict", F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(live, "live").otherwise("shared"))


def judged(docs: DataFrame, text: str, owner: str, repo: str, keep: dict[str, str]) -> DataFrame:
    """keep's columns and spans: an array of (start, rank, kind, end, random, verdict) for each finding, by start and then by kind.

    Base findings are all there; the method's long tokens but for examples. Null and empty texts have none; repeated
    rows are separate; an empty table gives no rows. The scan is written, so texts are read once.
    """
    found = written(
        scanned(docs, text, keep | {"__owner": owner, "__repo": repo}).withColumn("__row", F.monotonically_increasing_id()), "secrets"
    )
    # An array zipped with its own field names, one element for each finding.
    each = found.where(F.size("kinds") > 0).select(
        "__row", F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.explode(F.arrays_zip("kinds", "starts", "ends", "values", "random")).alias("x")
    )
    each = each.select("__row", "owner", "repo", F.col("x.values").alias("value"), "x.kinds", "x.starts", "x.ends", "x.random")
    verdicts = written(ownership(each).select("value", "copies", "verdict"), "owners")
    with_verdict = rejoined(each.drop("owner", "repo"), verdicts, ["value"])
    with_verdict = with_verdict.where((F.col("kinds") != OWN) | (F.col("verdict") != "example"))
    rank = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))[F.col("kinds")]
    span = F.struct(F.col("starts").alias("start"), rank.alias("rank"), F.col("kinds").alias("kind"), F.col("ends").alias("end"), "random", "verdict")
    spans = with_verdict.groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = found.select(*keep, "__row").join(spans, "__row", "left").drop("__row")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, with source as owner and the document as repository; see judged for nulls and empty texts."""
    out = judged(table(spark, sf_dir, "documents"), "text", "source", "doc_id", {"doc_id": "doc_id"})
    joined = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    n = lambda kind: F.size(of(kind)).cast("long")
    verdict = lambda v: F.size(F.filter("spans", lambda s: s.verdict == v)).cast("long")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(of(*(k[0] for k in KINDS))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        verdict("live").alias("n_live"), verdict("example").alias("n_example"),
    )


def redacted(docs: DataFrame, text: str, owner: str, repo: str) -> DataFrame:
    """docs with each finding's span replaced by [REDACTED], but for values that are widely copied examples.

    Overlapping spans go together. Texts are found again by repo and a hash of the text; rows that agree in both have
    the same findings. Null texts stay null.
    """
    if clash := [c for c in docs.columns if c.lower() in ("__a", "__b", "__ka", "__kb", "__t", "__cuts")]:  # set aside meanwhile
        names = {c: fresh(docs.columns, f"__kept_{i}") for i, c in enumerate(clash)}
        back = {v: k for k, v in names.items()}
        return redacted(docs.withColumnsRenamed(names), *(names.get(c, c) for c in (text, owner, repo))).withColumnsRenamed(back)
    marked = docs.withColumns({"__a": F.col(repo).cast("string"), "__b": F.xxhash64(F.col(text).cast("string"))})
    spans = judged(marked, text, owner, repo, {"__ka": "__a", "__kb": "__b"})
    cuts = F.filter("spans", lambda s: s.verdict != "example")
    plain = F.transform(cuts, lambda s: F.struct(s.start.cast("int").alias("start"), s.end.cast("int").alias("end")))
    hidden = small(written(spans.where(F.size(cuts) > 0).groupBy("__ka", "__kb").agg(F.first(plain).alias("__cuts")), "cuts"))
    joined = marked.withColumn("__t", F.col(text)).join(hidden, F.col("__a").eqNullSafe(F.col("__ka")) & F.col("__b").eqNullSafe(F.col("__kb")), "left")
    # From left to right: x.out is the text so far, x.done where the last span ended.
    clean = """aggregate(__cuts, named_struct('out', '', 'done', 0), (x, s) -> named_struct(
        'out', if(s.end <= x.done, x.out, concat(x.out, if(s.start >= x.done, concat(substring(__t, x.done + 1, s.start - x.done), '[REDACTED]'), ''))),
        'done', greatest(x.done, s.end)), x -> concat(x.out, substring(__t, x.done + 1)))"""
    return joined.withColumn(text, F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(F.expr(clean))).select(*docs.columns)
