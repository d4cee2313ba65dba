"""Relational operators whose semantics plain Spark doesn't give."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(*keys: str | Column) -> list[Column]:
    """Sort keys with nulls as the largest values: last when ascending, first after a leading '-'."""
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k.asc_nulls_last())
        else:
            out.append(F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last())
    return out


def sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*ordered(*keys))


def limit(df: DataFrame, keys: Sequence[str], count: int | None, offset: int = 0) -> DataFrame:
    """Rows offset to offset + count of the order; count None is all of them. Spark plans it as a top-n."""
    if offset < 0 or (count is not None and count < 0):
        raise ValueError("LIMIT and OFFSET must not be negative")
    out = sort(df, *keys)
    out = out.offset(offset) if offset else out
    return out if count is None else out.limit(count)


def distinct_on(df: DataFrame, by: Sequence[str], *keys: str) -> DataFrame:
    """The first row of each group of by in the order of keys."""
    w = Window.partitionBy(*by).orderBy(*ordered(*keys))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def not_in(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of left whose key is surely not among right's, as NOT IN with nulls: fields compare one by one, a null might match.

    Only equality joins are made: rows are split by which of their fields are null, and the rows of two such patterns join on
    the fields that are null in neither. Where no field is left, one row that says whether right has the pattern decides.
    """
    xs, ys = [x for x, _ in pairs], [f"__r{i}" for i in range(len(pairs))]
    keys = right.select(*(F.col(y).alias(r) for (_, y), r in zip(pairs, ys, strict=True)))
    patterns = [[bool(n >> i & 1) for i in range(len(pairs))] for n in range(1 << len(pairs))]
    is_ = lambda names, nulls: reduce(Column.__and__, [F.col(c).isNull() if n else F.col(c).isNotNull() for c, n in zip(names, nulls, strict=True)])
    flags = F.broadcast(keys.agg(*(F.coalesce(F.bool_or(is_(ys, nulls)), F.lit(False)).alias(f"__p{k}") for k, nulls in enumerate(patterns))))
    parts = []
    for mine in patterns:
        part, none_left = left.where(is_(xs, mine)), []
        for k, theirs in enumerate(patterns):
            both = [i for i in range(len(pairs)) if not mine[i] and not theirs[i]]
            if both:
                other = keys.where(is_(ys, theirs)).select(*(ys[i] for i in both))
                part = part.join(other, reduce(Column.__and__, [F.col(xs[i]) == F.col(ys[i]) for i in both]), "left_anti")
            else:
                none_left.append(f"__p{k}")
        if none_left:
            part = part.crossJoin(flags).where(~reduce(Column.__or__, [F.col(c) for c in none_left]))
        parts.append(part.select(*left.columns))
    return reduce(DataFrame.unionAll, parts)


def compared_to_all(left: DataFrame, x: str, op: str, right: DataFrame, y: str) -> DataFrame:
    """Rows of left with x op ALL (right's y): one row of right's extremes decides, a null among them as unknown."""
    extremes = F.broadcast(right.agg(F.min(y).alias("__lo"), F.max(y).alias("__hi"), F.count("*").alias("__n"), F.count(y).alias("__known")))
    lo, hi, c = F.col("__lo"), F.col("__hi"), F.col(x)
    test = {">": lambda: c > hi, ">=": lambda: c >= hi, "<": lambda: c < lo, "<=": lambda: c <= lo, "=": lambda: (c == lo) & (c == hi)}[op]()
    return left.crossJoin(extremes).where((F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & test)).select(*left.columns)


#: Ranges of time over which an as-of join deals each key's rows.
CHUNKS = 64


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, take: Sequence[str], chunks: int = CHUNKS) -> DataFrame:
    """left with take's columns from the latest row of right at or before left's time, by equal keys; null where there is none.

    Both sides are dealt by key and range of time once and read in one sorted pass; no pair of rows is made. What a range has
    no earlier row for comes from the last row of the key's ranges before, of which there are at most chunks, so a key with a
    third of all rows is no single task's. At equal times right comes first, and of right's rows at one time the largest
    values of take win. Null keys and times match nothing.
    """
    known = lambda df, t: df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, t)]))
    keep, keys = left.columns, [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    number = (lambda c: F.unix_micros(c.cast("timestamp"))) if "time" in dict(right.dtypes)[right_time] else (lambda c: c.cast("double"))
    cuts = known(right, right_time).agg(F.percentile_approx(number(F.col(right_time)), [i / chunks for i in range(1, chunks)], 1000)).first()[0] if chunks > 1 else []
    chunk = lambda c: F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(cuts)))), lambda x: x < number(c))) if cuts else F.lit(0)
    r = known(right, right_time).select(F.lit(None).cast(left.select(F.struct(*keep)).schema[0].dataType).alias("__row"), *keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*take).alias("__take"))
    l = known(left, left_time).select(F.struct(*keep).alias("__row"), *keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__take"].dataType).alias("__take"))
    r, l = (x.withColumn("__chunk", chunk(F.col("__t"))) for x in (r, l))
    w = Window.partitionBy(*names, "__chunk").orderBy("__t", "__side", "__take").rowsBetween(Window.unboundedPreceding, 0)
    found = l.unionByName(r).withColumn("__last", F.last("__take", ignorenulls=True).over(w)).where("__side = 1")
    ends = r.groupBy(*names, "__chunk").agg(F.max(F.struct("__t", "__take")).alias("__end"))
    # The last row of the ranges before each range, for every range of a key that has any: chunks rows a key at most.
    later = F.explode(F.sequence(F.col("__chunk") + 1, F.lit(chunks)))
    before = ends.where(F.col("__chunk") < chunks).select(*names, later.alias("__chunk"), "__end").groupBy(*names, "__chunk").agg(F.max("__end").alias("__before"))
    found = found.join(before, [*names, "__chunk"], "left").withColumn("__last", F.coalesce("__last", "__before.__take"))
    out = found.select("__row.*", *(F.col(f"__last.{c}").alias(c) for c in take))
    rest = left.where(~reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, left_time)]))
    return out.unionByName(rest.select(*keep, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take)))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high. Values fall into cells of that width, and a range stands in each cell that it meets.

    The join is an equi-join on the cell, with the test itself on what meets; choose width near the usual range's length.
    """
    cell = lambda c: F.floor(c.cast("double") / width)
    p = points.withColumn("__cell", cell(F.col(point)))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    return p.join(r, "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")


def overlap_join(left: DataFrame, right: DataFrame, mine: tuple[str, str], theirs: tuple[str, str], width: float) -> DataFrame:
    """Pairs of ranges [low, high) that overlap. A range stands in each cell of that width that it meets; a pair counts in its first.

    Empty ranges and null bounds match nothing. Choose width near the usual range's length.
    """
    cell = lambda c: F.floor(c.cast("double") / width)
    (a, b), (c, d) = mine, theirs
    l = left.where(F.col(a) < F.col(b)).withColumn("__cell", F.explode(F.sequence(cell(F.col(a)), cell(F.col(b)))))
    r = right.where(F.col(c) < F.col(d)).withColumn("__cell", F.explode(F.sequence(cell(F.col(c)), cell(F.col(d)))))
    first = F.greatest(cell(F.col(a)), cell(F.col(c)))
    return l.join(r, "__cell").where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("__cell") == first)).drop("__cell")


def distance_join(left: DataFrame, right: DataFrame, mine: tuple[str, str], theirs: tuple[str, str], most: float) -> DataFrame:
    """Pairs of points at most that far apart, with dist. Points fall into squares of that side; one side also visits the eight around."""
    square = lambda c: F.floor(F.col(c) / most)
    l = left.withColumn("__i", square(mine[0])).withColumn("__j", square(mine[1]))
    near = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    r = right.withColumn("__i", F.explode(F.transform(near, lambda x: x + square(theirs[0])))).withColumn("__j", F.explode(F.transform(near, lambda x: x + square(theirs[1]))))
    dist = F.sqrt(F.pow(F.col(mine[0]) - F.col(theirs[0]), F.lit(2.0)) + F.pow(F.col(mine[1]) - F.col(theirs[1]), F.lit(2.0)))
    return l.join(r, ["__i", "__j"]).withColumn("dist", dist).where(F.col("dist") <= most).drop("__i", "__j")


def nearest_join(left: DataFrame, right: DataFrame, key: str, other: str, mine: tuple[str, str], theirs: tuple[str, str], k: int, reach: float, rounds: int = 40) -> DataFrame:
    """(key, other, dist, place): the k nearest points of right for each of left, ties by other. key must be unique in left.

    Points within a reach are joined by squares; who has too few yet takes part again with twice the reach, so each point
    meets only some multiple of what it needs. Points with null coordinates meet nothing.
    """
    from ..sources.store import written

    known = lambda df, xy: df.where(F.col(xy[0]).isNotNull() & F.col(xy[1]).isNotNull())
    todo, right = known(left, mine).select(key, *mine), known(right, theirs).select(other, *theirs)
    have = right.limit(k).count()
    w, parts = Window.partitionBy(key).orderBy("dist", other), []
    for _ in range(rounds):
        found = written(distance_join(todo, right, mine, theirs, reach).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k))
        full = found.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= have).select(key)
        parts.append(found.join(full, key, "left_semi").select(key, other, "dist", "place"))
        todo = written(todo.join(full, key, "left_anti"))
        if not have or todo.isEmpty():
            return reduce(DataFrame.unionAll, parts)
        reach *= 2
    raise ValueError("points are too far apart for the reach: choose a larger one")


def similarity_join(left: DataFrame, right: DataFrame, mine: str, theirs: str, least: float) -> DataFrame:
    """Pairs of words whose trigrams' similarity is at least that, with sim; each pair once.

    Trigrams stand in order, and two sets so similar share one of the first n - ceil(least n) + 1 of each, so only those are
    joined. Null and empty words match nothing.
    """
    from ..functions.kinds import similarity, trigrams

    def side(df: DataFrame, word: str, n: str) -> DataFrame:
        g = df.withColumn(n, trigrams(word))
        # Hashed order: alphabetic order would put the blanks that most words begin with first.
        spread = F.transform(F.array_sort(F.transform(F.col(n), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), lambda s: s.x)
        return g.withColumn("__spread", spread).withColumn("__prefix", F.slice("__spread", F.lit(1), F.size(n) - F.ceil(F.size(n) * least - 1e-9).cast("int") + 1)).drop("__spread")

    l, r = side(left, mine, "__g"), side(right, theirs, "__h")
    l = l.withColumnRenamed("__prefix", "__p").withColumn("__gram", F.explode("__p"))
    r = r.withColumnRenamed("__prefix", "__q").withColumn("__gram", F.explode("__q"))
    pairs = l.join(r, "__gram").where(F.size("__g").between(F.size("__h") * least - 1e-9, F.size("__h") / least + 1e-9))
    # A pair counts at the first of the grams where the two prefixes meet.
    once = F.col("__gram") == F.get(F.array_intersect("__p", "__q"), F.lit(0))
    found = pairs.where(once).withColumn("sim", similarity("__g", "__h"))
    return found.where(F.col("sim") >= least).drop("__g", "__h", "__p", "__q", "__gram")


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """Aggregates by each set, with columns that a set leaves out null; every () set gives a row on empty input too."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    types = dict(df.dtypes)

    def one(s: Sequence[str]) -> DataFrame:
        out = df.groupBy(*s).agg(*aggregates) if s else df.agg(*aggregates)
        rest = [c for c in out.columns if c not in s]
        return out.select(*(F.col(k) if k in s else F.lit(None).cast(types[k]).alias(k) for k in keys), *rest)

    full = [s for s in sets if s]
    parts = [one(s) for s in sets if not s]
    if full:
        names = one(full[0]).columns[len(keys) :]
        expanded = df.groupingSets([[F.col(c) for c in s] for s in full], *(F.col(k) for k in keys)).agg(*aggregates)
        parts.insert(0, expanded.select(*keys, *names))
    return reduce(DataFrame.unionAll, parts)


def hypothetical(kind: str, column: str, value, nulls_first: bool = False) -> Column:
    """What rank, dense_rank, percent_rank or cume_dist a row with value would have among the group's, in ascending order."""
    c, v = F.col(column), F.lit(value)
    before = F.coalesce(c < v, F.lit(nulls_first))
    if kind == "rank":
        return F.count_if(before) + 1
    if kind == "dense_rank":
        return F.count_distinct(F.when(before, c)) + 1
    if kind == "percent_rank":
        return F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.count_if(before) / F.greatest(F.count("*"), F.lit(1)))
    if kind == "cume_dist":
        return (F.count_if(F.coalesce(c <= v, F.lit(nulls_first))) + 1) / (F.count("*") + 1)
    raise ValueError(kind)


def array_agg(column: str, *keys: str) -> Column:
    """The group's values with nulls, in the order of keys (ascending, nulls last)."""
    parts = [F.struct(F.col(k).isNull().alias(f"n{i}"), F.col(k).alias(f"k{i}")) for i, k in enumerate(keys)]
    packed = F.collect_list(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts)), F.col(column).alias("v")))
    return F.transform(F.array_sort(packed) if keys else packed, lambda x: x.v)


def percentile_disc(df: DataFrame, by: Sequence[str], column: str, share: float, name: str) -> DataFrame:
    """by's columns and name: the first value at or past share of each sorted group, of any sortable type; nulls don't count.

    Equal values are counted first, so a group's distinct values alone meet in a window.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*by)
    upto = F.sum("__n").over(whole.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(whole))
    return placed.where(F.col("__upto") >= F.greatest(F.lit(share) * F.col("__all"), F.lit(1))).groupBy(*by).agg(F.min(column).alias(name))


#: A round of a recursion with at most so many rows is held by the driver; larger ones are written.
HELD_ROWS = 10_000


def _settled(df: DataFrame, large: bool) -> tuple[DataFrame, bool, bool]:
    """(the rows, computed once; whether there are none; whether they were too many to hold)."""
    from ..sources.store import written

    if not large:
        rows = df.limit(HELD_ROWS + 1).collect()
        if len(rows) <= HELD_ROWS:
            return df.sparkSession.createDataFrame(rows, df.schema), not rows, False
    out = written(df)
    return out, out.isEmpty(), True


def recursive(base: DataFrame, step, all_rows: bool = False, most: int = 1000) -> DataFrame:
    """WITH RECURSIVE: base, then step(of the last round's rows) until a round is empty. Without all_rows, rows that were seen go.

    While all rows together are few, the driver holds them and a round is one job. Then rounds are written, and what was
    seen stands in one table but for the last few rounds, so that a round reads it once, in a few files.
    """
    from ..sources.store import written

    spark, names, schema = base.sparkSession, base.columns, base.schema
    seen: dict[str, tuple] = {}
    held: list[tuple] = []
    last, rounds = base, 0
    while rounds <= most:
        rows = (base if not rounds else step(last).select(*names)).limit(HELD_ROWS + 1).collect()
        if len(held) + len(rows) > HELD_ROWS:
            break
        new = [tuple(r) for r in rows] if all_rows else list({repr(tuple(r)): tuple(r) for r in rows if repr(tuple(r)) not in seen}.values())
        if not new:
            return spark.createDataFrame(held, schema)
        held += new
        seen |= {repr(r): r for r in new}
        last, rounds = spark.createDataFrame(new, schema), rounds + 1
    parts = [spark.createDataFrame(held, schema)]
    for _ in range(rounds, most + 1):
        new = base if not rounds else step(last).select(*names)
        if not all_rows:
            before = reduce(DataFrame.unionAll, parts)
            new = new.distinct().join(before, reduce(Column.__and__, [new[c].eqNullSafe(before[c]) for c in names]), "left_anti")
        last, rounds = written(new), rounds + 1
        if last.isEmpty():
            return reduce(DataFrame.unionAll, parts)
        parts.append(last)
        if len(parts) == 16:
            parts = [written(reduce(DataFrame.unionAll, parts))]
    raise RecursionError(f"no end after {most} rounds")


def connect_by(df: DataFrame, key: str, parent: str, start, delimiter: str = "~", most: int = 0) -> DataFrame:
    """(key, parent, level, branch) from start downwards; most levels if above 0, else a cycle is an error."""
    typed = df.select(F.col(key).alias("keyid"), F.col(parent).alias("parent_keyid"))
    kind, large = typed.schema["keyid"].dataType, False
    root = df.sparkSession.range(1).select(F.lit(start).cast(kind).alias("keyid"), F.lit(None).cast(kind).alias("parent_keyid"), F.lit(0).alias("level"), F.array(F.lit(start).cast("string")).alias("path"))
    parts, last, level = [root], root, 0
    while not most or level < most:
        level += 1
        up = last.select(F.col("keyid").alias("__up"), "path")
        new = typed.join(up, F.col("parent_keyid") == F.col("__up")).select("keyid", "parent_keyid", F.lit(level).alias("level"), "path")
        new = new.withColumn("cycle", F.array_contains("path", F.col("keyid").cast("string"))).withColumn("path", F.concat("path", F.array(F.col("keyid").cast("string"))))
        new, empty, large = _settled(new, large)
        if empty:
            break
        if not most and not new.where("cycle").isEmpty():
            raise RecursionError("infinite recursion detected")
        last = new.drop("cycle")
        parts.append(last)
    return reduce(DataFrame.unionAll, parts).withColumn("branch", F.array_join("path", delimiter)).drop("path")


def crosstab(df: DataFrame, row: str, order: str, value: str, columns: int) -> DataFrame:
    """Values of each row name in their order, filled from the left; values beyond the columns are dropped."""
    w = Window.partitionBy(row).orderBy(*ordered(order))
    placed = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= columns)
    out = placed.groupBy(row).pivot("__n", list(range(1, columns + 1))).agg(F.first(value))
    return out.select(F.col(row).alias("row_name"), *(F.col(str(i)).alias(f"category_{i}") for i in range(1, columns + 1)))


def crosstab_by(df: DataFrame, row: str, category: str, value: str, categories: Sequence, *order: str) -> DataFrame:
    """A column for each category; null where a row name has none, the last value by order where it has several, the largest of equals."""
    out = df.groupBy(row).pivot(category, list(categories)).agg(F.max(F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(value).alias("v"))).getField("v"))
    return out.withColumnRenamed(row, "row_name")


def _once(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """source, failing when it runs if a key comes more than once; null keys are no repetition."""
    w = Window.partitionBy(*keys)
    null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    twice = F.raise_error(F.lit("ON CONFLICT DO UPDATE command cannot affect row a second time"))
    counted = source.withColumn("__n", F.when(null, 1).otherwise(F.count("*").over(w)))
    return counted.where(F.when(F.col("__n") > 1, twice.cast("boolean")).otherwise(F.lit(True))).drop("__n")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys): the table as it is afterwards. update None does nothing on conflict.

    In update and where, 'old.c' is the target's column and 'new.c' the source's. With update, a key that comes twice in
    source is an error; without, the first of its rows (in the order of all columns) is inserted. Null keys never conflict.
    """
    if update is not None:
        source = _once(source, keys)
    old, new = target.alias("old"), source.alias("new")
    same = reduce(Column.__and__, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys])
    fresh = new.join(old, same, "left_anti").select(*target.columns)
    if update is None:
        null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*target.columns))
        return target.unionByName(fresh.withColumn("__n", F.when(null, 1).otherwise(rank)).where("__n = 1").drop("__n"))
    hit = F.col(f"new.{keys[0]}").isNotNull() & (where if where is not None else F.lit(True))
    kept = old.join(new, same, "left").select(*(F.when(F.coalesce(hit, F.lit(False)), update[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in update else F.col(f"old.{c}") for c in target.columns))
    return kept.unionByName(fresh)


def updated(target: DataFrame, source: DataFrame, on: Column, update: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """UPDATE target SET ... FROM source WHERE on, columns named old.c and new.c: (the table afterwards, RETURNING the changed rows).

    A row changes once: of several matches that with the least row of source counts, in the order of its columns.
    """
    old, new = target.alias("old"), source.alias("new")
    # Equal rows of target have the same matches, so a row itself is the key.
    row = F.struct(*(F.col(f"old.{c}").alias(c) for c in target.columns))
    hits = old.join(new, on).groupBy(row.alias("__at")).agg(F.min(F.struct(*(F.col(f"new.{c}") for c in source.columns))).alias("__new"))
    joined = target.select(F.struct(*target.columns).alias("old")).join(hits, F.col("old").eqNullSafe(F.col("__at")), "left").select("old", F.col("__new").alias("new"))
    out = joined.select(*(F.when(F.col("new").isNotNull(), update[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in update else F.col(f"old.{c}") for c in target.columns), F.col("new").isNotNull().alias("__changed"))
    return out.drop("__changed"), out.where("__changed").drop("__changed")


def deleted(target: DataFrame, source: DataFrame, on: Column) -> tuple[DataFrame, DataFrame]:
    """DELETE FROM target USING source WHERE on: (the table afterwards, RETURNING the deleted rows)."""
    old, new = target.alias("old"), source.alias("new")
    return old.join(new, on, "left_anti"), old.join(new, on, "left_semi")


def refreshed(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a concurrent refresh changes: rows of fresh or stored with action insert, update or delete."""
    rest = [c for c in fresh.columns if c not in keys]
    a, b = stored.select(*keys, F.struct(*rest).alias("o")), fresh.select(*keys, F.struct(*rest).alias("n"))
    both = a.join(b, list(keys), "full")
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(~F.col("o").eqNullSafe(F.col("n")), "update")
    return both.withColumn("action", action).where("action IS NOT NULL").select(*keys, F.coalesce("n", "o").alias("r"), "action").select(*keys, "r.*", "action")


def rollup(*keys: str) -> list[list[str]]:
    """The sets of ROLLUP."""
    return [list(keys[:n]) for n in range(len(keys), -1, -1)]


def cube(*keys: str) -> list[list[str]]:
    """The sets of CUBE."""
    return [[k for i, k in enumerate(keys) if n >> i & 1] for n in reversed(range(1 << len(keys)))]


def grouping_product(*parts: Sequence[Sequence[str]]) -> list[list[str]]:
    """The sets of several items of GROUP BY: each of one with each of the others, a key once."""
    return reduce(lambda a, b: [list(dict.fromkeys([*x, *y])) for x in a for y in b], parts, [[]])


def grouping_nested(*parts: Sequence[Sequence[str]]) -> list[list[str]]:
    """The sets of GROUPING SETS over other sets: one list after another."""
    return [list(s) for p in parts for s in p]


def union_resolved(*arms: DataFrame, names: Sequence[str], all_rows: bool = False) -> DataFrame:
    """A union whose columns have the type that all arms' go to; a null literal goes to any."""
    return_ = reduce(DataFrame.unionAll, [a.toDF(*names) for a in arms])
    return return_ if all_rows else return_.distinct()


def grouped_by_key(df: DataFrame, key: Sequence[str], dependent: Sequence[str], *aggregates: Column) -> DataFrame:
    """Groups of a key with columns that depend on it, which don't widen what is shuffled and compared."""
    return df.groupBy(*key).agg(*(F.any_value(c).alias(c) for c in dependent), *aggregates)


def crosstab_view(df: DataFrame, row: str, column: str, value: str, most: int = 1600) -> DataFrame:
    """A column for each value of column, in their order; more than most of them is an error."""
    names = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    return df.groupBy(row).pivot(column, names).agg(F.max(value))
