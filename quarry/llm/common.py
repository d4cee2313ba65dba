"""Shared plumbing: written intermediate tables, text columns, what workers hold, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import new_path, written

__all__ = ["connected_components", "dropped", "fresh", "held", "new_path", "rejoined", "slices", "small", "table", "texts", "trimming", "written"]

#: A node with more edges than this may be a hub, and at least EDGES / HUB_SHARE of all edges makes it one.
HUB_EDGES, HUB_SHARE = 10_000, 1_000


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a path of new_path before the application ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A written table of so many rows and bytes of files may be broadcast.
MOST_BROADCAST, MOST_BYTES = 500_000, 64 << 20


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table, to be broadcast where its count and its files' size allow it; else the join is Spark's to plan, by a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= MOST_BYTES and df.count() <= most else df


#: A class with at least so many rows, and more than a share of 1 / MOST_HEAVY of them all, is heavy.
HEAVY_ROWS, MOST_HEAVY = 10_000, 100_000


def rejoined(rows: DataFrame, classes: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of classes, a written table that has one row for each value of on and, as copies, its number of rows.

    Few classes are broadcast. Of many, the heavy ones are, of which there are fewer than MOST_HEAVY whatever the input, and
    the others' join is a shuffle in which no key is heavy: a class with a third of all rows stays where its rows are.
    on must not be null; how is inner or left.
    """
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if count <= MOST_BROADCAST:
        return rows.join(F.broadcast(classes.drop("copies")), on, how)
    cut = max(HEAVY_ROWS, total // MOST_HEAVY)
    heavy = F.broadcast(classes.where(F.col("copies") > cut).drop("copies"))
    light = rows.join(heavy.select(*on), on, "left_anti").join(classes.where(F.col("copies") <= cut).drop("copies"), on, how)
    return rows.join(heavy, on).unionByName(light)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """The name, with more underscores before it while a column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(column: pa.Array) -> list[str]:
    """The column's strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows and bytes of text, one row at least, so that a task holds few texts at once."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            stop = min(max(stop, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


_held: dict = {}


def held(key: tuple, make: Callable):
    """What make() returned for the key, kept for a worker's next task. Only the latest is: a worker that goes on to another operator lets go of this one's model."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def trimming(f: Callable, keeps: str = "") -> Callable:
    """f over batches, whose worker gives freed memory back to the system when a partition ends; workers live on between stages.

    What is held for other operators than keeps, the first part of held's key, goes before the first batch, and to the system.
    """

    def run(batches):
        others = [k for k in _held if k[0] != keeps]
        for key in others:
            del _held[key]
        if others:
            _trim()
        yield from f(batches)
        _trim()

    return run


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge to another, by alternating large and small stars.

    edges has columns u and v of bigint; loops, repeats and nulls are ignored. component is the smallest node reachable.
    Each round is written to the shared folder. A hub's smallest neighbour comes from a partial aggregate and reaches the
    hub's edges by a broadcast, which holds fewer than 2 * HUB_SHARE hubs whatever the input's size.
    """
    links = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "links"
    )
    state = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds if state[0] else 0):
        both = links.select(F.col("hi").alias("at"), F.col("lo").alias("to")).unionAll(links.select("lo", "hi"))
        star = _to_smallest(both, state[0]).where("to > at").select(F.col("to").alias("at"), F.col("least").alias("to"))
        star = star.where("at > to").distinct()
        small = _to_smallest(star, state[0])
        links = written(
            small.select(F.when(F.col("to") == F.col("least"), F.col("at")).otherwise(F.col("to")).alias("hi"), F.col("least").alias("lo")).distinct(),
            "links",
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)


def _to_smallest(pairs: DataFrame, n: int) -> DataFrame:
    """pairs (at, to) with least: the smallest of at and all of at's to."""
    least = pairs.groupBy("at").agg(F.least(F.col("at"), F.min("to")).alias("least"), F.count("*").alias("degree"))
    if n <= HUB_EDGES:
        return pairs.join(least.drop("degree"), "at")
    least = written(least, "least")
    cut = max(HUB_EDGES, 2 * n // HUB_SHARE)
    hubs = F.broadcast(least.where(F.col("degree") > cut).drop("degree"))
    rest = pairs.join(hubs, "at", "left_anti").join(least.where(F.col("degree") <= cut).drop("degree"), "at")
    return pairs.join(hubs, "at").unionByName(rest)
