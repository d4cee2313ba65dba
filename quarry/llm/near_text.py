"""Near duplicates by resemblance of word shingles: SimHash links first, then every other pair of the wanted Jaccard resemblance.

Sets whose SimHash fingerprints are linked by simhash's pigeonhole are compared first. The bits of a pair that just resembles
enough differ in some ten places, which no pigeonhole on 64 bits can afford, so the rest is found by prefixes: shingles stand
in one order, those common in a sample last, and two sets of a resemblance of t or more share one of the first n - ceil(t n)
+ 1 shingles of each, whatever the order, so no pair is lost. Where the first that they share stands bounds what they can
share at all. Who shares a rare one is compared with all others; of a crowd, with one of its texts, then, between groups
only, with all. Each link is made by comparing shingles, not by an estimate.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, fresh, rejoined, slices, small, texts, trimming, written

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Texts of a shingle from which they are a crowd; members of a block, by which a crowd's texts of different groups are compared.
CROWD, BUCKET = 8, 1024
#: Rounds in which a crowd's texts are compared with one of them, another each time, before all that groups leave apart.
HUBS = 3
#: Rows that a task gets at once, and pairs that it holds.
CELL, PAIRS = 8192, 25_000
#: One of so many documents has its shingles counted for the order; fewest of these that make a shingle common, and most common shingles kept.
ORDER_SHARE, COMMON_DOCS, MOST_COMMON = 8, 2, 200_000
#: Cells over which a text's shingles are counted: a sketch from which the least number of unshared shingles follows.
CELLS = 256


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each distinct run of so many words, A-Z as small letters; of all words where they are fewer; none without words."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(len(found) - shingle + 1, 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    one = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([one(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), ">u8").astype(np.uint64))


def unshared(n: int | np.ndarray, similarity: float):
    """Most shingles that only one of two sets of n shingles in all has where they resemble each other so much."""
    return n * (1 - similarity) / (1 + similarity) + 1e-6


def prefix(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In order, the first n - ceil(similarity * n) + 1 of the hashes, rare ones first; common has hashes in order and their counts."""
    names, counts = common
    weight = np.zeros(len(hashes), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        weight = np.where(names[at] == hashes, counts[at], 0)
    # Rounding up less makes the prefix one longer at most, never shorter.
    return hashes[np.lexsort((hashes, weight))][: len(hashes) - ceil(similarity * len(hashes) - 1e-6) + 1]


def sketch(hashes: np.ndarray) -> bytes:
    """How many hashes there are, and how many in each cell, modulo 256."""
    cells = np.bincount((hashes >> np.uint64(65 - CELLS.bit_length())).astype(np.int64), minlength=CELLS)
    return np.uint64(len(hashes)).tobytes() + (cells % 256).astype(np.uint8).tobytes()


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that several documents of a sample have. It decides the order only, so any sample is right."""

    def mapped(batches):
        for batch in slices(batches):
            found = [shingle_hashes(x, shingle) for x in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ORDER_SHARE)) == 0).select("text").mapInArrow(trimming(mapped), "h long")
    often = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_DOCS).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    names = np.array([r["h"] for r in often], np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([r["n"] for r in often], np.int64)[order]


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, hash, fp, n, sim, sketch, prefix) from (doc_id, text): a digest of the set of shingles, empty without words, its size and its SimHash."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))

    def mapped(batches):
        for batch in slices(batches):
            found = [shingle_hashes(x, shingle) for x in texts(batch.column(1))]
            columns = [
                pa.array([xxhash.xxh128_digest(h.tobytes()) if len(h) else b"" for h in found], pa.binary()),
                pa.array([len(h) for h in found], pa.int64()),
                pa.array([simhash.signed(simhash.majority(h.astype(">u8").view(np.uint8).reshape(-1, 8))) for h in found], pa.int64()),
                pa.array([sketch(h) for h in found], pa.binary()),
                pa.array([prefix(h, similarity, shared.value).view(np.int64) if len(h) else [] for h in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "hash", "fp", "n", "sim", "sketch", "prefix"])

    kinds = "doc_id long, hash long, fp binary, n long, sim long, sketch binary, prefix array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(trimming(mapped), kinds)


def ordered(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b), each once and a the smaller, from (id, n, id2, n2): those whose sizes allow the resemblance."""
    near = pairs.where(F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-6)
    return near.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def with_simhash(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): one set of each SimHash with the others of that SimHash, and with one set of each SimHash that is linked to it."""
    firsts = written(sets.groupBy("sim").agg(F.min(F.struct("id", "n")).alias("x"), F.count("*").alias("copies")).select("sim", "x.*", "copies"), "simhashes")
    same = rejoined(sets, firsts.select("sim", F.col("id").alias("id2"), F.col("n").alias("n2"), "copies"), ["sim"]).where("id <> id2")
    linked = simhash.links(firsts.select(F.col("sim").alias("fp")))
    one, two = firsts.select(F.col("sim").alias("u"), "id", "n"), firsts.select(F.col("sim").alias("v"), F.col("id").alias("id2"), F.col("n").alias("n2"))
    return ordered(same.select("id", "n", "id2", "n2").unionAll(linked.join(one, "u").join(two, "v").select("id", "n", "id2", "n2")), similarity)


def with_one(rows: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b): of each shingle, one of its texts, another each turn, with all that are of other groups."""
    hub = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("turn"), F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("label").alias("label2")))
    hubs = rows.groupBy("value").agg(hub.alias("hub"))
    return ordered(rows.join(hubs.select("value", "hub.*"), "value").where("label <> label2"), similarity)


def with_all(rows: DataFrame, bucket: int, similarity: float) -> DataFrame:
    """(a, b): of each shingle, the pairs of different groups whose places, and sketches if there are any, allow the resemblance.

    rows: value, the count c of its texts, id, label, n, pos, and sketch or not. A shingle's texts are dealt over blocks of
    about bucket, and each two blocks stand in one cell. Pairs are made inside a cell and only those that may resemble leave
    it, so a shingle of any size is compared in bounded tasks.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / bucket).cast("int"))
    cells = (rows.agg(F.sum("blocks")).first()[0] or 0) // CELL + 1
    rest = ["id", "label", "n", "pos", *(["sketch"] if "sketch" in rows.columns else [])]
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("lo"), F.greatest("block", x).alias("hi")))
    met = rows.select("value", "blocks", block, *rest).select("value", "block", *rest, F.explode(others).alias("x")).select("value", "x.lo", "x.hi", "block", *rest)
    met = met.withColumn("cell", F.pmod(F.xxhash64("value", "lo", "hi"), F.lit(cells)))

    def compare(t):
        names = ("value", "lo", "hi", "block", "id", "label", "n", "pos")
        columns = {c: t.column(c).to_numpy() for c in names}
        order = np.lexsort([columns[c] for c in ("id", "block", "hi", "lo", "value")])
        value, lo, hi, block, ids, label, n, pos = (columns[c][order] for c in names)
        sketches = None
        if "sketch" in t.column_names:
            sketches = np.frombuffer(b"".join(t.column("sketch").combine_chunks().take(pa.array(order)).to_pylist()), np.uint8).reshape(len(ids), 8 + CELLS)[:, 8:]
        new = np.concatenate(([True], (np.diff(value) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)))
        group = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(ids))[group]
        # A row's partners: those after it in its block, or, in a cell of two blocks, the rows of the second.
        seconds = np.bincount(group, block == hi, group[-1] + 1).astype(np.int64)[group]
        starts = np.where(lo == hi, np.arange(len(ids)) + 1, ends - seconds)
        counts = np.where(block == lo, ends - starts, 0)
        upto, at, found = np.cumsum(counts), 0, []
        while at < len(ids):
            stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
            c = counts[at:stop]
            i = np.repeat(np.arange(at, stop), c)
            j = np.repeat(starts[at:stop] - (np.cumsum(c) - c), c) + np.arange(len(i))
            # What they share from here on, of all that they need to share.
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])
            keep = (label[i] != label[j]) & (most >= (n[i] + n[j]) * similarity / (1 + similarity) - 1e-6)
            i, j = i[keep], j[keep]
            if sketches is not None:
                apart = np.abs((sketches[i] - sketches[j]).view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)
                keep = apart <= unshared(n[i] + n[j], similarity)
                i, j = i[keep], j[keep]
            found.append(np.stack((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])), 1))
            at = stop
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return met.groupBy("cell").applyInArrow(compare, "a long, b long").distinct()


def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): pairs with the column of either's row of a table by id."""
    one = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
    two = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")


def possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the resemblance: cells' counts differ by no more than sets may."""

    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, 8 + CELLS) for i in (2, 3))
            n = sum(np.ascontiguousarray(z[:, :8]).view(np.uint64)[:, 0].astype(np.int64) for z in (x, y))
            apart = np.abs((x[:, 8:] - y[:, 8:]).view(np.int8).astype(np.int64)).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= unshared(n, similarity), pa.bool_()))

    return beside(pairs, classes, "sketch").mapInArrow(trimming(compare), "a long, b long")


def resembling(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets whose texts' shingles have a Jaccard resemblance of at least similarity. sets: id, doc_id, hash."""

    def compare(batches):
        for batch in slices(batches, 128):
            good = []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3)), strict=True):
                one, two = shingle_hashes(x, shingle), shingle_hashes(y, shingle)
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(both >= similarity * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Only texts of these pairs are read on: one of each set, by its row's key.
    wanted = small(written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "wanted"))
    keys = small(written(sets.join(wanted, "id", "left_semi").select("id", F.col("doc_id").alias("key"), "hash"), "keys"))
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    some = hashed.join(keys, (F.col("doc_id") == F.col("key")) & (hashed["hash"] == keys["hash"])).select("id", "text").dropDuplicates(["id"])
    return beside(pairs, written(some, "texts"), "text").mapInArrow(trimming(compare), "a long, b long")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (u, v) more: only what they link between groups is followed."""
    label = lambda n, side: small(found).select(F.col("node").alias(n), F.col("component").alias(side))
    edges = links.join(label("u", "x"), "u", "left").join(label("v", "y"), "v", "left")
    edges = edges.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")).where("u <> v").distinct()
    parts = written(connected_components(edges), "parts")
    nodes = found.unionByName(parts.select("node", F.col("node").alias("component"))).dropDuplicates(["node"])
    to = small(parts).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return written(nodes.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "found")


def parts(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, hash, component) of each row of docs (doc_id, text): rows of a component are near duplicates, or linked by such.

    Equal sets of shingles count as one, named by the number of one of its rows, so ids may repeat. Texts without words are one set.
    """
    own = written(prefixes(docs, shingle, similarity).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    classes = own.groupBy("fp").agg(F.min(F.struct("row", "n", "sim", "doc_id", "hash")).alias("x"), F.count("*").alias("copies"))
    classes = written(classes.select("fp", F.col("x.row").alias("id"), "x.n", "x.sim", "x.doc_id", "x.hash", "copies"), "classes")
    sets = written(classes.where("n > 0").drop("fp"), "sets")
    # One text of each set, and of its prefix what another text's prefix has too.
    lettered = own.select(F.col("row").alias("id"), F.col("n").cast("int").alias("n"), "sketch", "prefix").join(small(sets.select("id")), "id", "left_semi")
    lettered = written(lettered, "lettered")
    each = lettered.select("id", "n", F.posexplode("prefix").alias("pos", "value"))
    met = written(each.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "met")
    # Both sides grow with the input: a shuffle at any size.
    rows = written(each.join(met, "value").withColumn("label", F.col("id")), "rows")
    sketches = lettered.select("id", "sketch")

    def compared(pairs: DataFrame, sketched: bool = False) -> DataFrame:
        near = pairs if sketched else written(possible(written(pairs, "pairs"), sketches, similarity), "possible")
        return written(resembling(near, sets, docs, shingle, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")), "near")

    def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
        """rows with their groups as label, without shingles of one group."""
        at = rows.drop("label").join(small(found).withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        mixed = at.groupBy("value").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
        return written(at.join(small(written(mixed.select("value"), "open")), "value", "left_semi"), "labelled")

    found = written(connected_components(compared(with_simhash(sets, similarity))), "found")
    found = merged(found, compared(with_all(rows.where(F.col("c") <= crowd), bucket, similarity)))
    at = apart(rows.where(F.col("c") > crowd), found)
    for turn in range(HUBS):
        if at.isEmpty():
            break
        found = merged(found, compared(with_one(at, turn, similarity)))
        at = apart(at, found)
    if not at.isEmpty():
        pairs = written(with_all(at.join(sketches, "id"), bucket, similarity), "pairs")
        found = merged(found, compared(pairs, sketched=True))
    of = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", "copies", F.coalesce("component", "id").alias("component"))
    return rejoined(own.select("doc_id", "hash", "fp"), written(of, "components"), ["fp"]).drop("fp")


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")


def groups(docs: DataFrame, doc_id: str, text: str, **how) -> DataFrame:
    """(doc_id, component_id) of each document: the smallest doc_id that near duplicates lead to.

    Texts without words, null ones too, form one group. Repeated rows each come back; an empty table gives no rows; rows
    without a doc_id don't take part; rows that share an id and differ in text are judged apart.
    """
    found = written(parts(_documents(docs, doc_id, text), **how), "groups")
    roots = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("copies"))
    return rejoined(found, written(roots, "roots"), ["component"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id, once if it is repeated.

    Rows are found again by doc_id and a hash of the text. Rows without a doc_id aren't compared and stay.
    """
    a, b, here = fresh(docs.columns, "__a"), fresh(docs.columns, "__b"), fresh(docs.columns, "__here")
    found = written(parts(_documents(docs, doc_id, text)), "groups")
    keepers = found.groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("keeper"), F.count("*").alias("copies"))
    judged = rejoined(found, written(keepers, "keepers"), ["component"]).withColumn("stays", F.struct("doc_id", "hash") == F.col("keeper"))
    judged = written(judged.groupBy("doc_id", "hash", "stays").agg(F.count("*").alias("n")).where("NOT stays OR n > 1"), "judged")
    key = lambda df: small(written(df.select(F.col("doc_id").alias(a), F.col("hash").alias(b)), "gone"))
    marked = docs.withColumn(here, F.xxhash64(F.col(text).cast("string")))
    match = (F.col(doc_id).cast("long") == F.col(a)) & (F.col(here) == F.col(b))
    kept = marked.join(key(judged.where("NOT stays")), match, "left_anti")
    if not judged.where("stays").isEmpty():
        twice = key(judged.where("stays"))
        kept = kept.join(twice, match, "left_anti").unionByName(kept.join(twice, match, "left_semi").dropDuplicates([doc_id, here]))
    return kept.drop(here)
