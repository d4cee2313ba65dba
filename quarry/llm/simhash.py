"""SimHash near-duplicates by the generalised pigeonhole principle, verified exactly, with connected components."""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, rejoined, slices, table, texts, trimming, written

BITS, SEED = 64, 42
#: Most differing bits of a link; words of a shingle.
DISTANCE, SHINGLE = 2, 3
#: Members of a probe's bucket that are compared pair by pair; larger ones go by common neighbours.
BUCKET = 64
#: Cost of one emitted probe against one candidate pair.
PROBE_COST = 4.0


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' XXH64; zero for a text without words. A-Z count as small letters."""
    found = text.encode().lower().split()
    if not found:
        return 0
    n = max(len(found) - shingle + 1, 1)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint8)
    return majority(hashes.reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, rows of eight bytes, the highest first."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a bounded number of hashes is spread into bits at once
        ones += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, text: str, keep: tuple[str, ...], shingle: int = SHINGLE) -> DataFrame:
    """keep's columns and fp: the fingerprint as a signed long. Null text is empty; only keep and text are read."""
    wanted = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def mapped(batches):
        for batch in slices(batches):
            column = pa.array([signed(fingerprint(x, shingle)) for x in texts(batch.column(len(keep)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], column], names=[*keep, "fp"])

    return wanted.mapInArrow(trimming(mapped), wanted.drop("__text").schema.add("fp", "long"))


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(n, how many of the n fingerprints have both bit i and bit j), from one 64 by 64 sum of each task, added by Spark."""

    def counted(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.record_batch({"i": pa.array(range(BITS * BITS + 1), pa.int32()), "n": pa.array([*total.ravel().tolist(), n], pa.int64())})

    rows = distinct.select("fp").mapInArrow(counted, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        found[r["i"]] = r["n"]
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many groups of about equal size, correlated bits together.

    Greedy: a group starts with the free bit that is least correlated with the rest and takes the free bit most correlated with it.
    Bit 0 is the highest.
    """
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        group = [min(free, key=lambda b: (corr[b, free].sum(), b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def mask(bits: list[int]) -> int:
    return signed(sum(1 << (BITS - 1 - b) for b in bits))


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in at most t of the bits, for t from 0 to most, as if bits were independent."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist[: most + 1]).tolist()


def thresholds(costs: list[list[float]], distance: int) -> list[int]:
    """A threshold of -1 or more for each part, least in total cost, that add up to distance - parts + 1.

    costs[i][t + 1] is part i's cost at threshold t. Fingerprints that differ in at most distance bits differ in at most
    its threshold in one part at least: else they'd differ in sum(t + 1) = distance + 1 bits. -1 leaves a part out.
    """
    parts = len(costs)

    @cache
    def best(i: int, budget: int) -> tuple[float, tuple[int, ...]]:
        if i == parts:
            return (0.0, ()) if budget == 0 else (float("inf"), ())
        options = [(costs[i][s] + rest, (s - 1, *chosen)) for s in range(min(budget, len(costs[i]) - 1) + 1) for rest, chosen in [best(i + 1, budget - s)]]
        return min(options)

    return list(best(0, distance + 1)[1])


def plan(distinct: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed: the number of parts and their thresholds that cost least.

    A part's candidate pairs at threshold 0 are counted over all fingerprints; at higher ones that count is scaled by the
    chance of so near a pair. A probe at threshold t is emitted for each value within t bits.
    """
    n, both = bit_counts(distinct)
    p = np.diag(both) / max(n, 1)
    choices = {m: grouped_bits(n, both, m) for m in range(max(distance, 2), distance + 3)}
    flat = [(m, i, bits) for m, groups in choices.items() for i, bits in enumerate(groups)]
    values = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(bits))).alias("v")) for k, (_, _, bits) in enumerate(flat)))
    sizes = distinct.select(F.explode(values).alias("x")).groupBy("x.k", "x.v").agg(F.count("*").alias("c"))
    pairs = dict(sizes.groupBy("k").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).collect())
    best = (float("inf"), [])
    for m, groups in choices.items():
        costs = []
        for i, bits in enumerate(groups):
            exact, chance = pairs.get(flat.index((m, i, bits)), 0.0), within(p[bits], distance)
            probes = [sum(comb(len(bits), j) for j in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0, *((exact + 1) * chance[t] / max(chance[0], 1e-300) + PROBE_COST * n * probes[t] for t in range(distance + 1))])
        chosen = thresholds(costs, distance)
        cost = sum(c[t + 1] for c, t in zip(costs, chosen, strict=True))
        best = min(best, (cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]), key=lambda x: x[0])
    return best[1]


def flips(bits: list[int], most: int) -> list[int]:
    """Masks that change at most so many of the bits."""
    out = [0]
    for _ in range(most):
        out = sorted({x ^ (1 << (BITS - 1 - b)) for x in out for b in bits} | set(out))
    return [signed(x) for x in out]


def probes(distinct: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, home): a fingerprint is at home at its own value of a part and visits the values within the threshold."""
    each = []
    for k, (bits, t) in enumerate(parts):
        own = F.col("fp").bitwiseAND(F.lit(mask(bits)))
        each += [F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(x)).alias("value"), F.lit(x == 0).alias("home")) for x in flips(bits, t)]
    return distinct.select("fp", F.explode(F.array(*each)).alias("x")).select("fp", "x.*")


def near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) fingerprints that connect all that differ in at most distance bits, and no others.

    Buckets of at most BUCKET members are compared pair by pair inside one row. A fingerprint of a larger bucket is linked
    through common neighbours instead: it stands at every value within distance // 2 bits, and one within the rest, and
    who meets there differs in at most distance bits. Such a place has few members however large the bucket is.
    """
    found = written(probes(distinct, plan(distinct, distance)), "probes")
    sizes = found.groupBy("part", "value").agg(F.count("*").alias("n"), F.max("home").alias("any")).where(F.col("any") & (F.col("n") > 1))
    large = written(sizes.where(F.col("n") > BUCKET).select("part", "value"), "large")
    small = found.join(large, ["part", "value"], "left_anti").groupBy("part", "value").agg(F.collect_list(F.struct("fp", "home")).alias("m"))
    small = small.where("size(m) > 1 AND exists(m, x -> x.home)")
    pairs = f"""flatten(transform(m, (x, i) -> transform(filter(m, (y, j) -> j > i AND (x.home OR y.home) AND x.fp <> y.fp
        AND bit_count(x.fp ^ y.fp) <= {distance}), y -> named_struct('u', x.fp, 'v', y.fp))))"""
    exact = small.select(F.explode(F.expr(pairs)).alias("x")).select("x.*")
    crowded = found.join(large, ["part", "value"], "left_semi").select("fp").distinct()
    if distance != 2:
        raise ValueError("large buckets are linked through values one bit away, which is exact for distance 2")
    around = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in flips(list(range(BITS)), 1)))).alias("place"))
    met = around.groupBy("place").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("us")).where("size(us) > 1")
    return exact.unionByName(met.select(F.explode("us").alias("u"), "v").where("u <> v")).distinct()


def grouped(docs: DataFrame, doc_id: str, text: str, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of each document: the smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and are linked like others. Equal fingerprints count as one until the end,
    so copies are never expanded; repeated rows each come back; an empty table gives no rows; other columns aren't read.
    A null doc_id gets its component but is never one.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = written(fingerprints(docs, "text", ("doc_id",), shingle), "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    found = connected_components(links(classes.select("fp"), distance))
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(joined.join(roots, "component").select("fp", "copies", "component_id"), "components")
    return rejoined(own, of, ["fp"]).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see grouped for nulls, empty and repeated texts."""
    out = grouped(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
