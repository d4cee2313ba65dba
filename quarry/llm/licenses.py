"""License scans by diagonal voting over word k-gram hashes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import slices, small, table, texts, trimming, written

K = 2
#: Base phrases and their labels. All of a phrase's words must stand consecutively.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Templates of the method, words of public licenses' notices, and their labels.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed artistic license 2 0"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
#: Diagonals so near are one alignment; a template is found when so many of its words stand in their order in a span.
SLACK, LEAST_SHARE = 2, 0.9

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def words(text: str) -> list[bytes]:
    """Words in UTF-8 after A-Z are lower-cased: runs of digits, small letters and characters beyond ASCII."""
    return text.encode().translate(_LOWER).split()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of lower-cased bytes: a polynomial over 64 bits, from running sums of whole bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(raw) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)))
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h ^= h >> np.uint64(29)
        return h * np.uint64(_MIX), starts


_power, _inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept between calls."""
    global _power, _inverse
    if len(_power) < n:
        with np.errstate(over="ignore"):
            grow = np.full(max(n, 1 << 16), _BASE, np.uint64)
            grow[0] = 1
            back = np.full(len(grow), pow(_BASE, -1, 1 << 64), np.uint64)
            back[0] = 1
            _power, _inverse = np.cumprod(grow, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _power, _inverse


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hash of the K words from each word on."""
    n = max(len(hashes) - K + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(K):
            out = out * np.uint64(_BASE) + hashes[i : i + n]
        return out ^ (out >> np.uint64(31))


def templates() -> list[tuple[int, str, list[bytes], bool]]:
    """(number, label, words, whether it is a base phrase)."""
    return [(i, label, words(x), i < len(PHRASES)) for i, (label, x) in enumerate((*PHRASES, *TEMPLATES))]


def positions(spark: SparkSession) -> DataFrame:
    """(gram, template, at): every k-gram of every template; some two hundred rows."""
    rows = [
        (int(g), number, at)
        for number, _, body, _ in templates()
        for at, g in enumerate(gram_hashes(word_hashes(b" ".join(body))[0]).astype(np.int64))
    ]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def hashed(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns and grams: the hash of every rolling k-gram of the text, by its first word's number."""
    wanted = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    out = wanted.drop("__text").schema.add("grams", T.ArrayType(T.LongType()))

    def grams(batches):
        for batch in slices(batches, 256):
            found = [x.encode().translate(_LOWER) for x in texts(batch.column(len(keep)))]
            h, starts = word_hashes(b" ".join(found))
            owner = np.searchsorted(np.cumsum([len(x) + 1 for x in found]), starts, side="right")
            g = gram_hashes(h)
            own = owner[: len(g)] == owner[K - 1 : K - 1 + len(g)]
            counts = np.bincount(owner[: len(g)][own], minlength=len(found))
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(g[own].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], column], names=[*keep, "grams"])

    return wanted.mapInArrow(trimming(grams), out)


def candidates(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns and spans: an array of (template, first, last) for each alignment of each text that has one; words from 0.

    Votes of grams at equal offsets from a template add up to a diagonal; a template's neighbouring diagonals merge. A base
    phrase needs all its grams on one diagonal. Texts that are equal and agree in keep give one row.
    """
    spark = docs.sparkSession
    grams = hashed(docs, text, keep).withColumn("__row", F.monotonically_increasing_id()).select("__row", *keep, F.posexplode("grams").alias("place", "gram"))
    hits = grams.join(F.broadcast(positions(spark)), "gram").withColumn("diagonal", F.col("place") - F.col("at"))
    by = ["__row", *keep, "template"]
    lines = hits.groupBy(*by, "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))
    all_ = templates()
    grams_of = F.array(*(F.lit(len(body) - K + 1) for _, _, body, _ in all_))[F.col("template")]
    phrase = F.col("template") < len(PHRASES)
    lines = lines.where(~phrase | (F.col("votes") == grams_of))
    w = Window.partitionBy(*by).orderBy("diagonal")
    fresh = F.coalesce(phrase | (F.col("diagonal") - F.lag("diagonal").over(w) > SLACK) | (F.col("first") - F.lag("last").over(w) > 2 * grams_of), F.lit(True))
    merged = lines.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    merged = merged.groupBy(*by, "run").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"))
    merged = merged.where(F.col("votes") >= F.when(phrase, grams_of).otherwise(F.ceil(grams_of * (2 * LEAST_SHARE - 1))))
    spans = merged.groupBy("__row", *keep).agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    one = F.row_number().over(Window.partitionBy(*keep).orderBy("__row"))
    return spans.withColumn("n", one).where("n = 1").select(*keep, "spans")


def in_order(body: list[bytes], found: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(body) + 1)
    for x in found:
        last = 0
        for i, b in enumerate(body):
            last, row[i + 1] = row[i + 1], last + 1 if x == b else max(row[i + 1], row[i])
    return row[-1]


def verified(found: list[bytes], spans: list[dict], known: list) -> tuple[list[tuple[int, int]], set[str], float]:
    """(places of base phrases as (first word, template), all labels, best share of a template's words) of a text's words."""
    base, labels, score = [], set(), 0.0
    for s in spans:
        _, label, body, phrase = known[s["template"]]
        first, last = s["first"], s["last"]
        if phrase:
            if found[first : first + len(body)] == body:
                base.append((first, s["template"]))
                labels.add(label)
                score = 1.0
        else:
            share = in_order(body, found[max(first - SLACK, 0) : last + 1 + SLACK]) / len(body)
            if share >= LEAST_SHARE:
                labels.add(label)
                score = max(score, share)
    return base, labels, score


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, the base phrases' places and labels, the method's labels, and the best verified share of a template.

    Null text is empty: no words, no places, empty labels, score 0. Repeated rows are reported each for itself; an empty
    table gives no rows; only doc_id and text are read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("__text_hash", F.xxhash64("text"))
    key = ("doc_id", "__text_hash")
    found = written(candidates(docs, "text", key), "license")
    right = small(found.withColumnsRenamed({"doc_id": "__id", "__text_hash": "__hash"}))
    joined = docs.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text_hash").eqNullSafe(F.col("__hash")), "left").select("doc_id", "text", "spans")
    out = joined.select("doc_id").schema
    for field in docs.sparkSession.createDataFrame([], SCANNED).schema:
        out = out.add(field)
    known = templates()

    def checked(batches):
        for batch in slices(batches):
            rows = []
            for x, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                w = words(x)
                base, labels, score = verified(w, spans or [], known)
                places = [p for p, _ in base]
                names = sorted({known[t][1] for _, t in base})
                rows.append((len(w), len(base), min(places, default=None), max(places, default=None), ",".join(names), ",".join(sorted(labels)), score))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=out.fieldNames())

    return joined.mapInArrow(trimming(checked), out)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings of every document; see scan for nulls, empty and repeated texts."""
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")
