"""BPE encoding and decoding with a lexicon of the corpus's frequent words."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections import Counter
from heapq import nlargest

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe
from .common import held, slices, table, texts, trimming, written

#: Most words in the lexicon, and most characters of one; longer words are merged.
LEXICON_WORDS, WORD_CHARS = 50_000, 64


class Frequent:
    """Counts of a stream's frequent words in bounded memory (Misra and Gries): any word with more than a share of
    1 / size of all words is there, with a count that is short by no more than that share."""

    def __init__(self, size: int):
        self.size, self.counts = size, Counter()

    def add(self, words) -> None:
        self.counts.update(words)
        if len(self.counts) > 4 * self.size:
            self.cut()

    def cut(self) -> None:
        """At most size words stay; each loses the count of the first that goes."""
        if len(self.counts) > self.size:
            less = nlargest(self.size + 1, self.counts.values())[-1]
            self.counts = Counter({w: n - less for w, n in self.counts.items() if n > less})


def word_counts(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(word, n): frequent words of all texts, counted by each task in bounded memory, then added up."""

    def counted(batches):
        found = Frequent(size)
        for batch in slices(batches):
            for x in texts(batch.column(0)):
                found.add(w for w in x.split(" ") if len(w) <= WORD_CHARS)
        found.cut()
        rows = [(w, n) for w, n in found.counts.items() if n > 1]
        yield pa.record_batch({"word": pa.array([w for w, _ in rows], pa.string()), "n": pa.array([n for _, n in rows], pa.int64())})

    each = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(trimming(counted), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of frequent words of all texts, at most size of them.

    A word is what stands between single spaces, with the space before it. Each task counts all its words in bounded memory
    and sends on at most size of them. Their sums fall into steps of an eighth of a power of two, and the lowest step that still
    lets at most size words in is the cut, so no more than those reach the driver however many tasks there are. Which words
    are in makes no difference to any text's ids.
    """
    counts = written(word_counts(docs, text, size).withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "words")
    steps = dict(counts.groupBy("step").count().collect())
    cut, total = 1 << 30, 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > size:
            break
        cut = step
    top = counts.where(F.col("step") >= cut).select("word").collect()
    one = byte_bpe.vocabulary(path).core.encode_ordinary
    return byte_bpe.Lexicon.compiled({f" {w}".encode(): one(f" {w}") for w in (r["word"] for r in top) if not byte_bpe.DOUBTFUL.search(w)})


_sent: set[tuple[str, str]] = set()


def sent(spark: SparkSession, compiled: bytes) -> str:
    """The name by which executors find the lexicon's file: each machine gets it once, whatever its number of workers."""
    name = f"lexicon-{hashlib.sha256(compiled).hexdigest()[:32]}"
    application = spark.sparkContext.applicationId
    if (application, name) in _sent:
        return name
    _sent.add((application, name))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), name)
    with open(path, "wb") as f:
        f.write(compiled)
    spark.sparkContext.addFile(path)
    return name


def encode(docs: DataFrame, text: str, path: str, compiled: bytes, of, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: keep's columns, then what of(vocabulary, text, ids as bytes) returns, in the order of schema.

    Null text is empty. Ties, repeated rows and clashing extra columns make no difference: only keep and text are read.
    """
    spark = docs.sparkSession
    name = sent(spark, compiled)
    wanted = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    out = wanted.drop("__text").schema
    for field in spark.createDataFrame([], schema).schema:
        out = out.add(field)

    def mapped(batches):
        engine = held(("bytes", path, name), lambda: byte_bpe.Encoder(byte_bpe.Vocabulary(path), byte_bpe.Lexicon(SparkFiles.get(name))))
        names = out.fieldNames()[len(keep) :]
        kinds = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}.get(t, pa.int64())) for n, t in ((x.split()[0], x.split()[1]) for x in schema.split(", "))])
        for batch in slices(batches):
            found = texts(batch.column(len(keep)))
            rows = [of(engine.vocabulary, x, ids) for x, ids in zip(found, engine.encode(found), strict=True)]
            columns = [pa.array([r[i] for r in rows], kinds.field(n).type) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, *names])

    return wanted.mapInArrow(trimming(mapped, "bytes"), out)


def round_trip(vocabulary, text: str, ids: bytes) -> tuple:
    decoded = vocabulary.decode(np.frombuffer(ids, "<u4"))
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text as digests; a null or empty text has no ids. An empty table gives no rows."""
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return encode(docs, "text", path, lexicon(docs, "text", path), round_trip, "n_tokens long, ids_sha256 string, decoded_sha256 string", ("doc_id",))
