"""Statements over a session: tables with constraints, DML with RETURNING, views, transactions, cursors, prepared statements,
sequences, types, functions, aggregates, operators, triggers, rules, policies, locks and notifications.

A table's state is a written Parquet table that is never changed, so a statement makes a new one, a transaction is a map of
names to states, and a lost executor costs the running statement alone. Names and definitions live in the Engine object.
"""

from __future__ import annotations

import re
import threading
from collections import defaultdict, deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .functions.scalar import _c
from .operators import relational as R
from .sources.store import new_path, written

#: Rows of a group that a user-defined aggregate folds into one state; states of a group are combined.
CHUNK = 10_000


@dataclass
class Table:
    data: DataFrame
    defaults: dict[str, Callable[[], Column]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    keys: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()


@dataclass
class Sequence_:
    start: int = 1
    increment: int = 1
    least: int = 1
    most: int = (1 << 63) - 1
    cycle: bool = False
    last: int | None = None


class Engine:
    """What a server would keep for a database, for one Spark session."""

    def __init__(self, spark: SparkSession, user: str = "owner"):
        self.spark, self.user = spark, user
        self.tables: dict[str, Table] = {}
        self.views: dict[str, tuple[str, str | None]] = {}
        self.materialized: dict[str, tuple[str, DataFrame]] = {}
        self.saved: list[tuple[str | None, dict[str, Table]]] = []
        self.prepared_transactions: dict[str, dict[str, Table]] = {}
        self.statements: dict[str, str] = {}
        self.cursors: dict[str, Cursor] = {}
        self.sequences: dict[str, Sequence_] = {}
        self.last_sequence: str | None = None
        self.triggers: dict[tuple[str, str, str], list[Callable]] = defaultdict(list)
        self.rules: dict[tuple[str, str], Callable] = {}
        self.policies: dict[str, dict[str, str]] = defaultdict(dict)
        self.grants: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.comments: dict[tuple[str, str], str] = {}
        self.operators: dict[str, Callable[..., Column]] = {}
        self.casts: dict[tuple[str, str], Callable[[Column], Column]] = {}
        self.aggregates: dict[str, Aggregate] = {}
        self.enums: dict[str, list[str]] = {}
        self.domains: dict[str, tuple[str, str]] = {}
        self.changes: list[tuple[str, str, DataFrame]] = []
        self.channels: dict[str, deque] = {}
        self.locks: dict[int, tuple[str, int]] = {}
        self._guard = threading.Lock()

    # Tables

    def create_table(self, name: str, data: DataFrame | str, with_data: bool = True, **options) -> None:
        """CREATE TABLE by a DDL schema, or AS a query; options are Table's."""
        df = self.spark.createDataFrame([], data) if isinstance(data, str) else data if with_data else data.limit(0)
        if name in self.tables:
            raise ValueError(f"relation {name!r} already exists")
        self.tables[name] = Table(df, **options)
        self._store(name, df)
        self._fire("ddl_command_end", name, "create")

    def select_into(self, name: str, query: DataFrame) -> None:
        self.create_table(name, query)

    def alter_table(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """ALTER TABLE: a change of the columns as a function of the data."""
        self._store(name, change(self.tables[name].data))

    def drop_table(self, name: str) -> None:
        del self.tables[name]

    def truncate(self, name: str) -> None:
        self._store(name, self.tables[name].data.limit(0))

    def table(self, name: str) -> DataFrame:
        """A table or view as the current user sees it: with SELECT granted, by the policies of the role."""
        if name in self.views:
            return self.query(self.views[name][0])
        if name in self.materialized:
            return self.materialized[name][1]
        df = self.tables[name].data
        if self.user != "owner":
            if not {(self.user, "select"), ("public", "select")} & self.grants[name]:
                raise PermissionError(f"permission denied for relation {name}")
            if name in self.policies:
                seen = [p for role, p in self.policies[name].items() if role in (self.user, "public")]
                df = df.where(" OR ".join(f"({p})" for p in seen) if seen else "false")
        return df

    def query(self, sql: str, **parameters) -> DataFrame:
        """A SELECT over the engine's tables and views, which stand in the text by name."""
        names = {n for n in (*self.tables, *self.views, *self.materialized) if re.search(rf"\b{re.escape(n)}\b", sql)}
        for n in names:
            self.table(n).createOrReplaceTempView(n)
        return self.spark.sql(sql, parameters or None)

    def _store(self, name: str, df: DataFrame) -> None:
        """df as the table's new state, after its constraints; they fail while the state is written."""
        t = self.tables[name]
        for c in t.required:
            df = df.where(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null value in column {c!r} violates not-null constraint")).cast("boolean")).otherwise(True))
        for label, check in t.checks.items():
            df = df.where(F.when(~F.expr(check), F.raise_error(F.lit(f"new row violates check constraint {label!r}")).cast("boolean")).otherwise(True))
        for key in t.keys:
            known = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
            n = F.count("*").over(Window.partitionBy(*key))
            twice = F.raise_error(F.lit(f"duplicate key value violates unique constraint on {', '.join(key)}")).cast("boolean")
            df = df.withColumn("__n", n).where(F.when(known & (F.col("__n") > 1), twice).otherwise(True)).drop("__n")
        t.data = written(df, name)

    # Changes

    def insert(self, name: str, rows: DataFrame | list[dict], returning: Sequence[Column | str] = ()) -> DataFrame | None:
        """INSERT of a query or of VALUES; columns that are left out get their defaults."""
        name, t = self._through(name)
        schema = t.data.schema
        if not isinstance(rows, DataFrame):
            given = list(dict.fromkeys(k for r in rows for k in r))
            rows = self.spark.createDataFrame([tuple(r.get(k) for k in given) for r in rows] or [], T.StructType([schema[k] for k in given]))
        new = rows.select(*((F.col(f.name) if f.name in rows.columns else t.defaults[f.name]() if f.name in t.defaults else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        if rule := self.rules.get((name, "insert")):
            return rule(self, new)
        new = written(self._before(name, "insert", new), "new")
        self._store(name, t.data.unionByName(new))
        return self._after(name, "insert", new, returning)

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], update: dict[str, Column] | None = None, where: Column | None = None) -> None:
        """INSERT ... ON CONFLICT."""
        name, t = self._through(name)
        self._store(name, R.upsert(t.data, rows, keys, update, where))

    def update(self, name: str, changes: dict[str, Column], where: Column | str = "true", returning: Sequence[Column | str] = ()) -> DataFrame | None:
        name, t = self._through(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        old = t.data.where(hit)
        new = old.select(*((changes[c].cast(t.data.schema[c].dataType) if c in changes else F.col(c)).alias(c) for c in t.data.columns))
        if rule := self.rules.get((name, "update")):
            return rule(self, new)
        new = written(self._before(name, "update", new), "new")
        self._store(name, t.data.where(~hit).unionByName(new))
        return self._after(name, "update", new, returning)

    def update_from(self, name: str, source: DataFrame, on: Column, changes: dict[str, Column], returning: Sequence[Column | str] = ()) -> DataFrame | None:
        """UPDATE ... FROM, with columns old.c and new.c."""
        name, t = self._through(name)
        after, changed = R.updated(t.data, source, on, changes)
        changed = written(changed, "new")
        self._store(name, after)
        return self._after(name, "update", changed, returning)

    def update_current(self, name: str, rows: DataFrame, changes: dict[str, Column]) -> None:
        """UPDATE ... WHERE CURRENT OF: the table's rows that a cursor has fetched."""
        t = self.tables[name]
        here = F.struct(*(F.col(f"old.{c}") for c in rows.columns)).eqNullSafe(F.struct(*(F.col(f"new.{c}") for c in rows.columns)))
        self._store(name, R.updated(t.data, rows, here, {c: F.expr(f"old.{x}") if isinstance(x, str) else x for c, x in changes.items()})[0])

    def delete(self, name: str, where: Column | str = "true", returning: Sequence[Column | str] = ()) -> DataFrame | None:
        name, t = self._through(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        old = written(self._before(name, "delete", t.data.where(hit)), "old")
        if rule := self.rules.get((name, "delete")):
            return rule(self, old)
        self._store(name, t.data.where(~hit))
        return self._after(name, "delete", old, returning)

    def delete_using(self, name: str, source: DataFrame, on: Column, returning: Sequence[Column | str] = ()) -> DataFrame | None:
        name, t = self._through(name)
        after, gone = R.deleted(t.data, source, on)
        gone = written(gone, "old")
        self._store(name, after)
        return self._after(name, "delete", gone, returning)

    def with_modified(self, query: Callable[..., DataFrame], **modifying: Callable[[Engine], DataFrame]) -> DataFrame:
        """A data-modifying WITH: all parts see the tables as they were before, the query what the parts return.

        Parts must not change the same table.
        """
        before, found, after = self._state(), {}, {}
        for name, part in modifying.items():
            self.tables = {k: Table(**vars(t)) for k, t in before.items()}
            found[name] = part(self)
            after |= {k: t for k, t in self.tables.items() if k not in before or t.data is not before[k].data}
        self.tables = {k: Table(**vars(t)) for k, t in before.items()}
        out = written(query(self, **found), "with")
        self.tables |= after
        return out

    def _through(self, name: str) -> tuple[str, Table]:
        """A table, or that of a simple view."""
        if name in self.views:
            found = re.fullmatch(r"(?is)\s*select\s+\*\s+from\s+(\w+)(?:\s+where\s+.*)?", self.views[name][0])
            if not found:
                raise ValueError(f"cannot change view {name!r}")
            return self._through(found[1])
        return name, self.tables[name]

    def insert_view(self, view: str, rows: DataFrame) -> None:
        """INSERT into a simple view; with check option its condition must hold for the rows."""
        sql, option = self.views[view]
        where = re.search(r"(?is)\bwhere\b(.*)$", sql)
        if option and where:
            rows = rows.where(F.when(F.coalesce(F.expr(where[1]), F.lit(False)), True).otherwise(F.raise_error(F.lit(f"new row violates check option for view {view!r}")).cast("boolean")))
        self.insert(view, rows)

    def _before(self, name: str, event: str, rows: DataFrame) -> DataFrame:
        for f in self.triggers[name, "before", event]:
            rows = f(rows)
        return rows

    def _after(self, name: str, event: str, rows: DataFrame, returning) -> DataFrame | None:
        self.changes.append((name, event, rows))
        for f in self.triggers[name, "after", event]:
            f(rows)
        return rows.select(*returning) if returning else None

    # Triggers and rules

    def create_trigger(self, table: str, when: str, event: str, function: Callable[[DataFrame], DataFrame | None]) -> None:
        """A function of the changed rows: before it returns the rows to take, after it sees them."""
        self.triggers[table, when, event].append(function)

    def create_event_trigger(self, event: str, function: Callable[[str, str], None]) -> None:
        self.triggers["", event, ""].append(function)

    def _fire(self, event: str, *about) -> None:
        for f in self.triggers["", event, ""]:
            f(*about)

    def create_rule(self, table: str, event: str, instead: Callable[[Engine, DataFrame], DataFrame | None]) -> None:
        """DO INSTEAD."""
        self.rules[table, event] = instead

    # Views

    def create_view(self, name: str, sql: str, replace: bool = False, check_option: str | None = None) -> None:
        if name in self.views and not replace:
            raise ValueError(f"relation {name!r} already exists")
        self.views[name] = sql, check_option

    def view_definition(self, name: str) -> str:
        return self.views[name][0] if name in self.views else self.materialized[name][0]

    def create_materialized_view(self, name: str, sql: str, with_data: bool = True) -> None:
        df = self.query(sql)
        self.materialized[name] = sql, written(df if with_data else df.limit(0), name)

    def refresh(self, name: str, keys: Sequence[str] = ()) -> DataFrame | None:
        """REFRESH MATERIALIZED VIEW; with keys CONCURRENTLY: what changed is returned."""
        sql, old = self.materialized[name]
        new = written(self.query(sql), name)
        self.materialized[name] = sql, new
        return R.refreshed(old, new, keys) if keys else None

    # Transactions

    def _state(self) -> dict[str, Table]:
        return {k: Table(**vars(t)) for k, t in self.tables.items()}

    def begin(self) -> None:
        self.saved.append((None, self._state()))

    def savepoint(self, name: str) -> None:
        self.saved.append((name, self._state()))

    def rollback(self, to: str | None = None) -> None:
        """The whole transaction, or what came after a savepoint, which stays."""
        while self.saved:
            name, state = self.saved.pop()
            if name == to:
                self.tables = {k: Table(**vars(t)) for k, t in state.items()}
                if to is not None:
                    self.saved.append((name, state))
                return
        raise ValueError("no such savepoint" if to else "no transaction in progress")

    def release(self, name: str) -> None:
        at = max(i for i, (n, _) in enumerate(self.saved) if n == name)
        del self.saved[at:]

    def commit(self) -> None:
        while self.saved:
            if self.saved.pop()[0] is None:
                return
        raise ValueError("no transaction in progress")

    def prepare_transaction(self, name: str) -> None:
        """The transaction's changes are set aside until they are committed or rolled back by name."""
        done = self._state()
        self.rollback()
        self.prepared_transactions[name] = {k: t for k, t in done.items() if k not in self.tables or t.data is not self.tables[k].data}

    def commit_prepared(self, name: str) -> None:
        self.tables |= self.prepared_transactions.pop(name)

    def rollback_prepared(self, name: str) -> None:
        del self.prepared_transactions[name]

    # Statements and cursors

    def prepare(self, name: str, sql: str) -> None:
        """PREPARE with $1, $2, ..."""
        self.statements[name] = re.sub(r"\$(\d+)", r":p\1", sql)

    def execute(self, name: str, *values) -> DataFrame:
        return self.query(self.statements[name], **{f"p{i}": v for i, v in enumerate(values, 1)})

    def deallocate(self, name: str) -> None:
        del self.statements[name]

    def explain(self, query: DataFrame | str, mode: str = "formatted", analyze: bool = False) -> str:
        """The plan as text; with analyze the query runs and its rows are counted."""
        df = self.query(query) if isinstance(query, str) else query
        n = f"Rows: {df.count()}\n" if analyze else ""
        return n + df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def declare(self, name: str, query: DataFrame, *order: str) -> None:
        """A scrollable cursor that holds its rows, in that order."""
        self.cursors[name] = Cursor(query, order)

    def fetch(self, name: str, count: int | str = 1) -> DataFrame:
        return self.cursors[name].fetch(count)

    def move(self, name: str, count: int) -> int:
        return self.cursors[name].move(count)

    def close(self, name: str) -> None:
        del self.cursors[name]

    # Sequences

    def create_sequence(self, name: str, start: int = 1, increment: int = 1, least: int | None = None, most: int | None = None, cycle: bool = False) -> None:
        up = increment > 0
        self.sequences[name] = Sequence_(start, increment, (1 if up else -(1 << 63)) if least is None else least, ((1 << 63) - 1 if up else -1) if most is None else most, cycle)

    def nextval(self, name: str) -> int:
        with self._guard:
            s = self.sequences[name]
            n = s.start if s.last is None else s.last + s.increment
            if not s.least <= n <= s.most:
                if not s.cycle:
                    raise OverflowError(f"nextval: reached the limit of sequence {name!r}")
                n = s.least if s.increment > 0 else s.most
            s.last, self.last_sequence = n, name
            return n

    def currval(self, name: str) -> int:
        if self.sequences[name].last is None:
            raise ValueError(f"currval of sequence {name!r} is not yet defined in this session")
        return self.sequences[name].last

    def lastval(self) -> int:
        return self.currval(self.last_sequence)

    def setval(self, name: str, value: int, called: bool = True) -> int:
        s = self.sequences[name]
        s.last = value if called else value - s.increment
        return value

    def numbered(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """df with the sequence's next values: parts are counted first, so no row is moved."""
        s = self.sequences[name]
        part = written(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "numbered")
        sizes = part.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect()
        first, starts = (s.start if s.last is None else s.last + s.increment), {}
        for r in sizes:
            starts[r["__part"]] = first - r["first"] * s.increment
            first += r["n"] * s.increment
        if sizes:
            s.last = first - s.increment
        of = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))[F.col("__part")] if starts else F.lit(0)
        return part.withColumn(column, of + F.col("__at") * s.increment).drop("__part", "__at")

    # Functions, aggregates, operators, casts and types

    def create_function(self, name: str, arguments: str, returns: str, body: str, strict: bool = False) -> None:
        """A SQL function: RETURNS a type by an expression, or TABLE (...) by a query. Arguments may have defaults and names."""
        if strict and not returns.lower().startswith("table"):
            names = [a.split()[0] for a in re.split(r",(?![^(]*\))", arguments) if a.strip()]
            body = f"CASE WHEN {' AND '.join(f'{n} IS NOT NULL' for n in names)} THEN {body} END"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")

    def create_python_function(self, name: str, function: Callable, returns: str) -> None:
        """A function of pandas Series, in Arrow batches."""
        self.spark.udf.register(name, F.pandas_udf(function, returns))

    def create_table_function(self, name: str, handler: type, returns: str) -> None:
        """A set-returning function: a class whose eval yields rows."""
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def do(self, block: str) -> None:
        """DO: a block of the SQL scripting language."""
        self.spark.sql(block)

    def create_aggregate(self, name: str, sfunc, initial: Column, combine, final=lambda s: s) -> None:
        self.aggregates[name] = Aggregate(sfunc, initial, combine, final)

    def aggregate(self, name: str, df: DataFrame, by: Sequence[str], column: str, out: str, *order: str) -> DataFrame:
        return self.aggregates[name].of(df, by, column, out, *order)

    def create_operator(self, symbol: str, function: Callable[..., Column], commutator: str | None = None) -> None:
        self.operators[symbol] = function
        if commutator:
            self.operators.setdefault(commutator, lambda a, b: function(b, a))

    def op(self, symbol: str, *operands) -> Column:
        return self.operators[symbol](*map(_c, operands))

    def create_cast(self, source: str, target: str, function: Callable[[Column], Column]) -> None:
        self.casts[source, target] = function

    def cast(self, x, source: str, target: str) -> Column:
        found = self.casts.get((source, target))
        return found(_c(x)) if found else _c(x).cast(target)

    def create_enum(self, name: str, *labels: str) -> None:
        self.enums[name] = list(labels)

    def add_enum_value(self, name: str, label: str, before: str | None = None) -> None:
        at = self.enums[name].index(before) if before else len(self.enums[name])
        self.enums[name].insert(at, label)

    def enum(self, x, name: str) -> Column:
        """What labels compare by: their place in the declaration; an error for others."""
        labels = F.array(*map(F.lit, self.enums[name]))
        place = F.array_position(labels, _c(x))
        wrong = F.raise_error(F.concat(F.lit(f"invalid input value for enum {name}: "), _c(x))).cast("bigint")
        return F.when(place > 0, place).when(_c(x).isNotNull(), wrong)

    def enum_range(self, name: str, first: str | None = None, last: str | None = None) -> list[str]:
        labels = self.enums[name]
        return labels[labels.index(first) if first else 0 : labels.index(last) + 1 if last else None]

    def create_domain(self, name: str, base: str, check: str = "true") -> None:
        """check: a condition on VALUE."""
        self.domains[name] = base, check

    def domain(self, x, name: str) -> Column:
        base, check = self.domains[name]
        x = _c(x).cast(base)
        good = F.get(F.transform(F.array(x), lambda v: _condition(check, v)), F.lit(0))
        return F.when(F.coalesce(good, F.lit(True)), x).otherwise(F.raise_error(F.lit(f"value for domain {name} violates check constraint")).cast(base))

    # Rights, comments, settings, locks, notifications

    def grant(self, table: str, privilege: str, role: str) -> None:
        self.grants[table].add((role, privilege))

    def revoke(self, table: str, privilege: str, role: str) -> None:
        self.grants[table].discard((role, privilege))

    def create_policy(self, table: str, role: str, using: str) -> None:
        """Row security: a role other than the owner sees the rows for which a policy of it holds."""
        self.policies[table][role] = using

    def comment(self, kind: str, name: str, text: str | None) -> None:
        """COMMENT and SECURITY LABEL."""
        self.comments[kind, name] = text

    def set_config(self, name: str, value: str) -> str:
        self.spark.conf.set(name, value)
        return value

    def current_setting(self, name: str, missing: str | None = None) -> str | None:
        return self.spark.conf.get(name, missing)

    def reset(self, name: str) -> None:
        self.spark.conf.unset(name)

    def discard(self) -> None:
        self.statements.clear()
        self.cursors.clear()
        for n in (*self.tables, *self.views, *self.materialized):
            self.spark.catalog.dropTempView(n)

    def lock(self, key: int, holder: str) -> bool:
        """pg_try_advisory_lock, and LOCK for a table's number; a holder may take it again."""
        with self._guard:
            owner, n = self.locks.get(key, (holder, 0))
            if owner == holder:
                self.locks[key] = holder, n + 1
            return owner == holder

    def unlock(self, key: int, holder: str) -> bool:
        with self._guard:
            owner, n = self.locks.get(key, ("", 0))
            if owner != holder:
                return False
            self.locks.pop(key)
            if n > 1:
                self.locks[key] = holder, n - 1
            return True

    def listen(self, channel: str) -> None:
        self.channels.setdefault(channel, deque())

    def notify(self, channel: str, payload: str = "") -> None:
        if channel in self.channels and payload not in self.channels[channel]:
            self.channels[channel].append(payload)

    def notifications(self, channel: str) -> list[str]:
        out = list(self.channels[channel])
        self.channels[channel].clear()
        return out

    # Maintenance

    def analyze(self, name: str, distinct_error: float = 0.02) -> dict[str, tuple[float, int]]:
        """(share of nulls, estimated distinct values by HyperLogLog) of each column."""
        df = self.tables[name].data
        row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"k_{c}") for c in df.columns), *(F.approx_count_distinct(c, distinct_error).alias(f"d_{c}") for c in df.columns)).first()
        return {c: (1 - row[f"k_{c}"] / row["n"] if row["n"] else 0.0, row[f"d_{c}"]) for c in df.columns}

    def vacuum(self, name: str, files: int | None = None) -> None:
        """VACUUM FULL: the state rewritten in fewer files."""
        df = self.tables[name].data
        self._store(name, df.coalesce(files) if files else df)

    def cluster(self, name: str, *keys: str) -> None:
        """The state rewritten in the order of keys: files then hold ranges, which scans can skip."""
        df = self.tables[name].data
        self._store(name, df.repartitionByRange(*keys).sortWithinPartitions(*keys))

    def relation_size(self, name: str) -> int:
        """Bytes of the state's files."""
        files = self.tables[name].data.inputFiles()
        jvm = self.spark.sparkContext._jvm
        total = 0
        for f in files:
            p = jvm.org.apache.hadoop.fs.Path(f)
            total += p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
        return total


def _condition(check: str, v: Column) -> Column:
    """A condition on VALUE as a Column of v: comparisons, BETWEEN, LIKE, ~ and IN joined by AND."""
    out = F.lit(True)
    for part in re.split(r"(?i)\s+and\s+(?![^(]*\))(?!\S+\s*$(?<=between))", check):
        if part.strip().lower() == "true":
            continue
        m = re.fullmatch(r"(?is)\s*value\s*(<=|>=|<>|=|<|>|~|like)\s*(.+?)\s*", part) or re.fullmatch(r"(?is)\s*length\(value\)\s*(<=|>=|<>|=|<|>)\s*(.+?)\s*", part)
        if not m:
            raise ValueError(f"condition {part!r} isn't understood")
        left = F.length(v) if "length(" in part.lower() else v
        right = F.expr(m[2])
        out = out & {"<=": lambda: left <= right, ">=": lambda: left >= right, "<>": lambda: left != right, "=": lambda: left == right, "<": lambda: left < right, ">": lambda: left > right, "~": lambda: F.rlike(left, right), "like": lambda: F.like(left, right)}[m[1].lower()]()
    return out


class Cursor:
    """A query's rows, numbered once in an order and written; fetches read the numbers they need."""

    def __init__(self, query: DataFrame, order: Sequence[str]):
        self.columns, self.at = query.columns, 0
        ordered = query.orderBy(*R.ordered(*order))
        numbered = ordered.withColumn("__at", F.monotonically_increasing_id())
        # Parts of a sorted table follow each other: a part's first number turns places into 1, 2, 3, ...
        rows = written(numbered.withColumn("__part", F.spark_partition_id()), "cursor")
        sizes = rows.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect()
        shift, total = {}, 0
        for r in sizes:
            shift[r["__part"]] = total + 1 - r["first"]
            total += r["n"]
        of = F.create_map(*(F.lit(x) for kv in shift.items() for x in kv))[F.col("__part")] if shift else F.lit(0)
        self.rows, self.n = rows.withColumn("__at", F.col("__at") + of), total

    def move(self, count: int) -> int:
        """Rows moved over; back if negative."""
        to = min(max(self.at + count, 0), self.n + 1)
        moved = abs(to - self.at) - (to in (0, self.n + 1) and to != self.at)
        self.at = to
        return moved

    def fetch(self, count: int | str = 1) -> DataFrame:
        """next rows, -n: rows before, backwards; 'all', 'first', 'last', 'absolute n', 'relative n'."""
        words = str(count).split()
        if words[0] in ("first", "last", "absolute", "relative"):
            n = int(words[1]) if len(words) > 1 else 1
            to = {"first": 1, "last": self.n, "absolute": n if n >= 0 else self.n + 1 + n, "relative": self.at + n}[words[0]]
            self.at = min(max(to, 0), self.n + 1)
            low, high, back = self.at, self.at, False
        else:
            k = self.n if words[0] == "all" else int(count)
            if k == 0:
                low = high = self.at
                back = False
            elif k > 0:
                low, high, back = self.at + 1, min(self.at + k, self.n), False
                self.at = min(self.at + k, self.n + 1)
            else:
                low, high, back = max(self.at + k, 1), self.at - 1, True
                self.at = max(self.at + k, 0)
        out = self.rows.where(F.col("__at").between(low, high)).orderBy(F.col("__at").desc() if back else "__at")
        return out.select(*self.columns)


@dataclass
class Aggregate:
    """CREATE AGGREGATE: sfunc folds values into a state, combine joins states, final makes the result. All take and give Columns."""

    sfunc: Callable[[Column, Column], Column]
    initial: Column
    combine: Callable[[Column, Column], Column]
    final: Callable[[Column], Column]

    def of(self, df: DataFrame, by: Sequence[str], column: str, out: str, *order: str) -> DataFrame:
        """by's columns and out. Values are folded CHUNK by CHUNK, so no group stands in one row; with order in one, as they come."""
        item = F.struct(*order, F.col(column).alias("__v"))
        chunk = F.lit(0) if order else F.floor(F.monotonically_increasing_id() / CHUNK)
        part = df.withColumn("__chunk", chunk).groupBy(*by, "__chunk").agg(F.sort_array(F.collect_list(item)).alias("__items") if order else F.collect_list(item).alias("__items"))
        states = part.select(*by, F.aggregate("__items", self.initial, lambda s, x: self.sfunc(s, x["__v"])).alias("__state"))
        groups = states.groupBy(*by).agg(F.collect_list("__state").alias("__states")) if by else states.agg(F.collect_list("__state").alias("__states"))
        first = F.coalesce(F.get("__states", F.lit(0)), self.initial)
        joined = F.aggregate(F.slice("__states", 2, F.greatest(F.size("__states") - 1, F.lit(0))), first, self.combine, self.final)
        return groups.select(*by, joined.alias(out))


def decoded(changes: DataFrame, table: str, keys: Sequence[str], form: str = "text") -> DataFrame:
    """(data): changes (action, columns) as a decoding plugin shows them: text lines, or JSON."""
    rest = [c for c in changes.columns if c != "action"]
    kinds = dict(changes.dtypes)
    show = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if kinds[c] == "string" else F.col(c).cast("string"))
    names = lambda cs: F.concat_ws(" ", *(F.concat(F.lit(f"{c}[{kinds[c]}]:"), show(c)) for c in cs))
    if form == "text":
        body = F.when(F.col("action") == "delete", names(keys)).otherwise(names(rest))
        return changes.select(F.concat(F.lit(f"table {table}: "), F.upper("action"), F.lit(": "), body).alias("data"))
    row = F.when(F.col("action") == "delete", F.to_json(F.struct(*keys))).otherwise(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))
    return changes.select(F.concat(F.lit('{"action":"'), "action", F.lit(f'","table":"{table}","row":'), row, F.lit("}")).alias("data"))


# Sharding: rows in folders by ranges of a hash, read by the shards that a key can be in


def shard_of(key, shards: int) -> Column:
    return F.pmod(F.xxhash64(_c(key)), F.lit(shards)).cast("int")


def create_shards(df: DataFrame, key: str, shards: int) -> str:
    """The path of df's rows in that many shards by key."""
    path = new_path(df.sparkSession, "shards")
    placed = df.withColumn("shard", shard_of(key, shards))
    placed.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, key: str, shards: int, values: Sequence | None = None) -> DataFrame:
    """All rows, or those with one of the key's values, for which only the values' shards are read."""
    df = spark.read.parquet(path)
    if values is None:
        return df.drop("shard")
    kind = df.schema[key].dataType
    numbers = [r[0] for r in spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", kind)])).select(shard_of("v", shards)).distinct().collect()]
    return df.where(F.col("shard").isin(numbers) & F.col(key).isin(list(values))).drop("shard")


# Information


def size_pretty(n) -> Column:
    """pg_size_pretty: bytes, then kB, MB, GB and TB from 10 of the larger unit on, halves up."""
    n = _c(n).cast("bigint")
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for i, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        scaled = F.floor((F.abs(n) + F.lit(1 << (10 * i - 1))) / F.lit(1 << (10 * i))) * F.signum(n.cast("double"))
        out = F.when(F.abs(n) >= 10 * (1 << (10 * i)) - (1 << (10 * i - 1)) if i > 1 else F.abs(n) >= 10 * 1024, F.concat(scaled.cast("bigint").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


#: Units of sizes.
UNITS = {"bytes": 0, "b": 0, "kb": 1, "mb": 2, "gb": 3, "tb": 4}


def size_bytes(s) -> Column:
    """pg_size_bytes."""
    number = F.regexp_extract(_c(s), r"^\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).cast("decimal(38,9)")
    unit = F.lower(F.regexp_extract(_c(s), r"([A-Za-z]*)\s*$", 1))
    power = F.create_map(*(F.lit(x) for k, i in UNITS.items() for x in (k, 1024**i)))
    return F.when(unit == "", number).otherwise(number * power[unit]).cast("bigint")


def typeof(x) -> Column:
    return F.typeof(_c(x))


def collation_for(x) -> Column:
    return F.collation(_c(x))


def format_type(kind: str, modifier: int | None = None) -> str:
    """A type's SQL name from its short one, with a modifier."""
    names = {"int2": "smallint", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "bool": "boolean", "varchar": "character varying", "bpchar": "character", "timestamptz": "timestamp with time zone", "timestamp": "timestamp without time zone", "timetz": "time with time zone", "time": "time without time zone", "varbit": "bit varying"}
    body = names.get(kind, kind)
    return body if modifier is None else f"{body}({modifier})"


def keywords(spark: SparkSession) -> DataFrame:
    """pg_get_keywords: (word, reserved)."""
    return spark.sql("SELECT lower(keyword) AS word, reserved FROM sql_keywords()")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """pg_read_binary_file, pg_stat_file and pg_ls_dir: (path, modificationTime, length, content) of files."""
    return spark.read.format("binaryFile").load(path)
