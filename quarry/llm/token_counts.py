"""Token counts by section: each document is encoded once, and its tokens go to sections by their place in the text."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode, lexicon
from .common import table


def shares(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, from ascending ends of tokens and of sections that tile the same bytes.

    The interval join: a token overlaps the sections from the one with its first byte to the one with its last.
    The rule: a token that crosses a boundary belongs to the section with most of its bytes, the earliest of equals.
    Crossing tokens count there too. Every token belongs to one section, so the counts add up to the document's.
    """
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    for i in crossing.tolist():
        cuts = np.clip(section_ends[first[i] : last[i] + 1], starts[i], token_ends[i])
        owner[i] = first[i] + int(np.argmax(np.diff(np.concatenate(([starts[i]], cuts)))))
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def by_line(vocabulary, text: str, ids: bytes) -> tuple:
    r"""Counts of the sections that end after each \n; what follows the last is a section too, if it isn't empty."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    tokens, crossing = shares(np.cumsum(vocabulary.lengths[np.frombuffer(ids, "<u4")]), ends)
    # Code points before each end: bytes that begin one.
    begun = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return begun[ends].tolist(), tokens.tolist(), crossing.tolist()


def line_tokens(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    r"""(doc_id, section, start, end, n_tokens, n_crossing) for each line of each text.

    start and end are in code points, end after the line's \n. An empty or null text has no sections and so no rows;
    repeated rows count each for itself; only doc_id and text are read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lines = encode(docs, "text", path, lexicon(docs, "text", path), by_line, "ends array<bigint>, tokens array<bigint>, crossing array<bigint>", ("doc_id",))
    each = lines.select("doc_id", "ends", F.posexplode(F.arrays_zip("ends", "tokens", "crossing")).alias("section", "x"))
    start = F.when(F.col("section") > 0, F.expr("ends[section - 1]")).otherwise(0)
    return each.select("doc_id", "section", start.cast("long").alias("start"), F.col("x.ends").alias("end"), F.col("x.tokens").alias("n_tokens"), F.col("x.crossing").alias("n_crossing"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document; see line_tokens for nulls and empty texts."""
    return line_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
