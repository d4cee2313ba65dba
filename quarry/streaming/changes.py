"""Change streams applied to tables, and windows over streams (the latter beyond the reference)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str], is_delete: Column) -> DataFrame:
    """The rows that changes leave: each key's last by order, without those whose last is a delete. Nothing is sorted."""
    rest = F.struct(*changes.columns)
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(rest.alias("row"), is_delete.alias("gone")), F.struct(*order)).alias("x"))
    return last.where("NOT coalesce(x.gone, false)").select("x.row.*")


def applied(table: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], is_delete: Column, keep: str = "remote", stamp: str | None = None) -> DataFrame:
    """table after a batch of changes. On conflict: remote or local wins, or last or first by the column stamp."""
    rest = F.struct(*changes.columns)
    new = changes.groupBy(*keys).agg(F.max_by(F.struct(rest.alias("row"), is_delete.alias("gone")), F.struct(*order)).alias("n"))
    old = table.select(*keys, F.struct(*table.columns).alias("o"))
    both = old.join(new, list(keys), "full")
    wins = {
        "remote": lambda: F.lit(True),
        "local": lambda: F.col("o").isNull(),
        "last": lambda: F.col("o").isNull() | (F.col(f"n.row.{stamp}") >= F.col(f"o.{stamp}")),
        "first": lambda: F.col("o").isNull() | (F.col(f"n.row.{stamp}") < F.col(f"o.{stamp}")),
    }[keep]()
    take = F.col("n").isNotNull() & F.coalesce(wins, F.lit(False))
    kept = both.where(~(take & F.coalesce("n.gone", F.lit(False)))).where(take | F.col("o").isNotNull())
    return kept.select(*(F.when(take, F.col(f"n.row.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in table.columns))


class Applier:
    """A foreachBatch sink that keeps a table's state in the shared folder; a batch that comes again changes nothing."""

    def __init__(self, table: DataFrame, keys: Sequence[str], order: Sequence[str], is_delete: Column, tables: Sequence[str] = (), **conflict):
        self.table, self.done = written(table, "state"), -1
        self.args, self.conflict, self.tables = (keys, order, is_delete), conflict, tables

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.done:
            return
        if self.tables:
            batch = batch.where(F.col("table").isin(*self.tables))
        self.table, self.done = written(applied(self.table, batch, *self.args, **self.conflict), "state"), number


def tumbling(events: DataFrame, time: str, size: str, *keys: str, late: str | None = None):
    """Events grouped by windows of that size and keys; late is how long a stream waits."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if late else e
    return e.groupBy(F.window(time, size).alias("window"), *keys)


