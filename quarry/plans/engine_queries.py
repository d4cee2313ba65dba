"""Queries of statements: DML, views, transactions, cursors, prepared statements, sequences, functions, aggregates, types, sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import engine as E
from ..operators import relational as R
from ..sources import store as S
from .registry import query


def _engine(t) -> E.Engine:
    return E.Engine(t.spark)


@query("SELECT n_nationkey AS k, n_name AS name, 'new' AS state FROM nation UNION ALL SELECT 100, 'x', 'old' UNION ALL SELECT 101, NULL, 'new'")
def dml_insert(t):
    """INSERT of a query, and of rows with defaults."""
    e = _engine(t)
    e.create_table("target", "k bigint, name string, state string", defaults={"state": lambda: F.lit("new")})
    e.insert("target", t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    e.insert("target", [{"k": 100, "name": "x", "state": "old"}])
    e.insert("target", [{"k": 101}])
    return e.table("target")


@query("SELECT c_custkey, round(c_acctbal * 2, 2) AS c_acctbal FROM customer WHERE c_nationkey = 3")
def dml_update_returning(t):
    e = _engine(t)
    e.create_table("c", t.customer)
    return e.update("c", {"c_acctbal": F.round(F.col("c_acctbal") * 2, 2)}, "c_nationkey = 3", returning=["c_custkey", "c_acctbal"])


@query("SELECT c_nationkey, count(*) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS low FROM customer WHERE c_nationkey <> 4 GROUP BY 1 UNION ALL SELECT 4, count(*), 0 FROM customer WHERE c_nationkey = 4 AND c_acctbal >= 0")
def dml_delete(t):
    e = _engine(t)
    e.create_table("c", t.customer)
    e.delete("c", "c_nationkey = 4 AND c_acctbal < 0")
    return e.table("c").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("low"))


@query("SELECT (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS moved, (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS stayed, (SELECT count(*) FROM supplier) AS seen")
def dml_modifying_with(t):
    """WITH moved AS (DELETE ... RETURNING) INSERT: all parts see the tables as they were."""
    e = _engine(t)
    e.create_table("s", t.supplier)
    e.create_table("archive", t.supplier, with_data=False)
    seen = e.with_modified(lambda e, gone: e.table("s").agg(F.count("*").alias("seen")).crossJoin(gone.agg(F.count("*").alias("moved"))), gone=lambda e: e.delete("s", "s_acctbal < 0", returning=["*"]))
    return seen.crossJoin(e.table("s").agg(F.count("*").alias("stayed"))).select("moved", "stayed", "seen")


@query("SELECT (SELECT count(*) FROM region) AS rows, 0::BIGINT AS after, (SELECT count(*) FROM region) AS back, 'truncated' AS note")
def transactions(t):
    """SELECT INTO, TRUNCATE in a transaction, ROLLBACK, a savepoint and a prepared transaction."""
    e = _engine(t)
    e.select_into("r", t.region)
    n = lambda: e.table("r").count()
    rows = n()
    e.begin()
    e.truncate("r")
    after = n()
    e.rollback()
    e.begin()
    e.delete("r", "r_regionkey = 0")
    e.savepoint("s")
    e.truncate("r")
    e.rollback("s")
    e.insert("r", t.region.where("r_regionkey = 0"))
    e.prepare_transaction("two")
    e.commit_prepared("two")
    return t.spark.createDataFrame([(rows, after, n(), "truncated")], "rows bigint, after bigint, back bigint, note string")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 1000")
def views_and_prepared(t):
    """A view over a view, asked by a prepared statement."""
    e = _engine(t)
    e.create_table("c", t.customer)
    e.create_view("seven", "SELECT * FROM c WHERE c_nationkey = 7")
    e.create_view("names", "SELECT c_custkey, c_name, c_acctbal FROM seven")
    e.prepare("rich", "SELECT c_custkey, c_name FROM names WHERE c_acctbal > $1")
    return e.execute("rich", 1000)


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name DESC) AS at FROM nation ORDER BY n_name DESC LIMIT 5 OFFSET 3")
def cursor_fetch(t):
    """MOVE 3, FETCH 5, then back to the first of these and forward again."""
    e = _engine(t)
    e.declare("c", t.nation.select("n_nationkey", "n_name", F.row_number().over(R.Window.orderBy(F.desc("n_name"))).cast("long").alias("at")), "-n_name")
    e.move("c", 3)
    e.fetch("c", 5)
    back = e.fetch("c", -4).count()
    e.move("c", -1)
    return e.fetch("c", back + 1)


@query("SELECT count(*) AS n, min(i) AS lo, max(i) AS hi, count(DISTINCT i) AS d FROM (SELECT 10 + 5 * (row_number() OVER () - 1) AS i FROM customer)")
def sequence_numbers(t):
    """Rows numbered by a sequence, without an order."""
    e = _engine(t)
    e.create_sequence("s", start=10, increment=5)
    return e.numbered(t.customer.repartition(7), "s", "i").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("i").alias("d"))


@query("SELECT s_suppkey, round(s_acctbal * 1.19, 2) AS gross, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 1 END AS next FROM supplier")
def user_functions(t):
    """SQL functions with a default argument, and one that is strict."""
    e = _engine(t)
    e.create_function("gross", "x DOUBLE, rate DOUBLE DEFAULT 1.19", "DOUBLE", "round(x * rate, 2)")
    e.create_function("next_of", "x BIGINT", "BIGINT", "coalesce(x, -1) + 1", strict=True)
    return t.supplier.selectExpr("s_suppkey", "gross(s_acctbal) AS gross", "next_of(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END) AS next")


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE length(n_name) > 6")
def user_table_function(t):
    """RETURNS TABLE by a query, called for each row."""
    e = _engine(t)
    t.nation.createOrReplaceTempView("all_nations")
    e.create_function("long_names", "r BIGINT, least INT", "TABLE (name STRING)", "SELECT n_name FROM all_nations WHERE n_regionkey = r AND length(n_name) > least")
    t.region.createOrReplaceTempView("all_regions")
    return t.spark.sql("SELECT r_name, name AS n_name FROM all_regions, LATERAL long_names(r_regionkey, 6)")


class _Letters:
    def eval(self, s: str):
        for i, c in enumerate(s or ""):
            yield i + 1, c


@query("SELECT r_regionkey, i::INT AS i, substring(r_name, i, 1) AS c FROM region, range(1, 12) r(i) WHERE i <= length(r_name)")
def user_set_function(t):
    """A set-returning function written in Python."""
    e = _engine(t)
    e.create_table_function("letters_of", _Letters, "i int, c string")
    t.region.createOrReplaceTempView("all_regions")
    return t.spark.sql("SELECT r_regionkey, i, c FROM all_regions, LATERAL letters_of(r_name)")


@query("SELECT o_orderpriority, sum(o_custkey * o_custkey)::BIGINT AS squares, max(o_orderkey) - min(o_orderkey) AS spread FROM orders GROUP BY 1")
def user_aggregates(t):
    e = _engine(t)
    zero = F.lit(0).cast("long")
    e.create_aggregate("sum_squares", lambda s, x: s + x * x, zero, lambda a, b: a + b)
    none = F.struct(F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    both = lambda a, lo, hi: F.struct(F.least(a["lo"], lo).alias("lo"), F.greatest(a["hi"], hi).alias("hi"))
    e.create_aggregate("spread", lambda s, x: both(s, x, x), none, lambda a, b: both(a, b["lo"], b["hi"]), lambda s: s["hi"] - s["lo"])
    a = e.aggregate("sum_squares", t.orders, ["o_orderpriority"], "o_custkey", "squares")
    return a.join(e.aggregate("spread", t.orders, ["o_orderpriority"], "o_orderkey", "spread"), "o_orderpriority")


@query("SELECT p_partkey, abs(p_size - 20) AS apart, 'size ' || p_size AS label, p_size BETWEEN 10 AND 30 AS good FROM part")
def user_operators_and_casts(t):
    e = _engine(t)
    e.create_operator("<->", lambda a, b: F.abs(a - b), commutator="<->")
    e.create_cast("int", "label", lambda x: F.concat(F.lit("size "), x.cast("string")))
    e.create_operator("between_sizes", lambda a: a.between(10, 30))
    return t.part.select("p_partkey", e.op("<->", "p_size", F.lit(20)).alias("apart"), e.cast("p_size", "int", "label").alias("label"), e.op("between_sizes", "p_size").alias("good"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::BIGINT AS place, o_orderstatus <> 'P' AS late, round(o_totalprice, 0)::INT AS price FROM orders")
def user_types(t):
    """An enum in an order of its own with a label added, and a domain."""
    e = _engine(t)
    e.create_enum("status", "P", "F")
    e.add_enum_value("status", "O", before="F")
    e.create_domain("price", "int", "VALUE > 0 AND VALUE < 10000000")
    place = e.enum("o_orderstatus", "status")
    return t.orders.select("o_orderkey", place.alias("place"), (place >= e.enum(F.lit("O"), "status")).alias("late"), e.domain(F.round("o_totalprice"), "price").alias("price"))


@query("SELECT n_regionkey AS k, count(*) AS n, 'logged' AS note FROM nation WHERE n_nationkey > 2 GROUP BY 1")
def triggers_and_rules(t):
    """A trigger before the insert that drops rows, one after it that logs, and a rule that logs deletes instead."""
    e = _engine(t)
    e.create_table("n", t.nation, with_data=False)
    e.create_table("log", "k bigint, n bigint")
    e.create_trigger("n", "before", "insert", lambda rows: rows.where("n_nationkey > 2"))
    e.create_trigger("n", "after", "insert", lambda rows: e.insert("log", rows.groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))))
    e.create_rule("n", "delete", lambda e, rows: None)
    e.insert("n", t.nation)
    e.delete("n")
    left = e.table("n").agg(F.count("*").alias("left"))
    return e.table("log").crossJoin(left).select("k", "n", F.when(F.col("left") > 0, "logged").otherwise("gone").alias("note"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 2")
def row_security(t):
    """What a role sees of a table with a policy."""
    e = _engine(t)
    e.create_table("s", t.supplier)
    e.grant("s", "select", "clerk")
    e.create_policy("s", "clerk", "s_nationkey = 2")
    e.user = "clerk"
    return e.table("s").select("s_suppkey")


@query("SELECT 'table nation: ' || CASE WHEN n_nationkey < 3 THEN 'DELETE: n_nationkey[int]:' || n_nationkey ELSE 'INSERT: n_nationkey[int]:' || n_nationkey || ' n_name[string]:''' || n_name || '''' END AS data FROM nation WHERE n_nationkey < 6")
def decoded_changes(t):
    """Changes as a decoding plugin's text."""
    c = t.nation.where("n_nationkey < 6").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") < 3, "delete").otherwise("insert").alias("action"))
    return E.decoded(c, "nation", ["n_nationkey"])


@query("SELECT '{\"action\":\"update\",\"table\":\"region\",\"row\":{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}}' AS data FROM region")
def decoded_changes_json(t):
    return E.decoded(t.region.select("r_regionkey", "r_name", F.lit("update").alias("action")), "region", ["r_regionkey"], "json")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (11, 12, 40)")
def sharded_lookup(t):
    """Rows of three keys, from the shards that can have them."""
    path = E.create_shards(t.orders, "o_custkey", 16)
    return E.read_shards(t.spark, path, "o_custkey", 16, [11, 12, 40]).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q, count(*) AS n FROM lineitem GROUP BY 1")
def sharded_aggregate(t):
    """All shards, aggregated by their key."""
    path = E.create_shards(t.lineitem.select("l_orderkey", "l_quantity"), "l_orderkey", 8)
    return E.read_shards(t.spark, path, "l_orderkey", 8).groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey * 300 < 10240 THEN (p_partkey * 300) || ' bytes' ELSE ((p_partkey * 300 + 512) // 1024) || ' kB' END AS pretty, p_size * 1024 * 1024 AS bytes, 'bigint' AS kind FROM part WHERE p_partkey <= 200")
def size_texts(t):
    x = t.part.where("p_partkey <= 200")
    return x.select("p_partkey", E.size_pretty(F.col("p_partkey") * 300).alias("pretty"), E.size_bytes(F.concat("p_size", F.lit(" MB"))).alias("bytes"), E.typeof("p_partkey").alias("kind"))


@query("SELECT c_custkey, c_acctbal, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def copy_files(t):
    """COPY TO and FROM files of both formats, nulls and empty texts apart."""
    rows = t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_acctbal", "n_name")
    text, csv = S.new_path(t.spark, "copy"), S.new_path(t.spark, "copy")
    S.copy_to(rows, text)
    S.copy_to(S.copy_from(t.spark, text, rows.schema), csv, "csv", header=True, force_quote=False)
    return S.copy_from(t.spark, csv, rows.schema, "csv", header=True)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_partkey)::BIGINT AS p FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def agg_grouping_product(t):
    """GROUP BY ROLLUP (a), ROLLUP (b): each set of one with each of the other."""
    sets = R.grouping_product(R.rollup("l_returnflag"), R.rollup("l_linestatus"))
    return R.grouping_sets(t.lineitem, sets, F.count("*").alias("n"), F.sum("l_partkey").alias("p"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linenumber, l_returnflag), (l_linenumber))")
def agg_grouping_nested(t):
    """GROUPING SETS (ROLLUP with its empty set left out, CUBE of one beside a key): nested sets are put in place."""
    sets = R.grouping_nested([s for s in R.rollup("l_returnflag", "l_linestatus") if s], R.grouping_product([["l_linenumber"]], R.cube("l_returnflag")))
    return R.grouping_sets(t.lineitem, sets, F.count("*").alias("n"))


@query("SELECT l_linestatus, round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx, round(regr_sxy(l_extendedprice, l_quantity), 0) AS sxy, round(regr_syy(l_extendedprice, l_quantity) / 1000, 0) AS syy FROM lineitem GROUP BY l_linestatus")
def agg_regression_sums(t):
    q = t.lineitem.groupBy("l_linestatus")
    return q.agg(F.round(F.regr_sxx("l_extendedprice", "l_quantity"), 2).alias("sxx"), F.round(F.regr_sxy("l_extendedprice", "l_quantity"), 0).alias("sxy"), F.round(F.regr_syy("l_extendedprice", "l_quantity") / 1000, 0).alias("syy"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) > 0 AS some, true AS near FROM lineitem GROUP BY 1")
def agg_distinct_estimate(t):
    """HyperLogLog sketches of parts, joined, within a tenth of the exact count."""
    per = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.hll_sketch_agg("l_partkey").alias("s"))
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("d"))
    est = per.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("e"))
    return est.join(exact, "l_returnflag").select("l_returnflag", (F.col("e") > 0).alias("some"), (F.abs(F.col("e") - F.col("d")) <= 0.1 * F.col("d")).alias("near"))


@query("SELECT n_regionkey, string_agg('<n id=\"' || n_nationkey || '\">' || replace(replace(replace(n_name || ' & <co>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</n>', '' ORDER BY n_nationkey) AS x, min(lower(n_name)) AS least FROM nation GROUP BY 1")
def agg_xml(t):
    """xmlagg of elements in order, and min of text in any case."""
    from ..functions import xml as X

    e = X.element("n", {"id": "n_nationkey"}, X.escaped(F.concat("n_name", F.lit(" & <co>"))))
    return t.nation.withColumn("e", e).groupBy("n_regionkey").agg(X.agg("e", "n_nationkey").alias("x"), F.lower(F.min(F.collate("n_name", "UTF8_LCASE"))).cast("string").alias("least"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey < 50 ORDER BY o_totalprice")
def merge_append(t):
    """An ordered union of two sorted inputs."""
    a, b = (t.orders.where(f"o_custkey < 50 AND o_orderkey % 2 = {i}") for i in (0, 1))
    return R.sort(a.unionAll(b), "o_totalprice").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_nationkey::DOUBLE AS k, n_name AS name FROM nation UNION SELECT c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 20 UNION SELECT 1.5, NULL")
def set_type_resolution(t):
    """Arms of integer, double and unknown types meet in the wider one."""
    return R.union_resolved(t.nation.select("n_nationkey", "n_name"), t.customer.where("c_custkey < 20").select("c_acctbal", "c_mktsegment"), t.spark.sql("SELECT 1.5, NULL"), names=["k", "name"])


@query("SELECT c_custkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_name")
def group_by_primary_key(t):
    """GROUP BY a key: columns that depend on it come along as any of their equal values."""
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return R.grouped_by_key(j, ["c_custkey"], ["n_name"], F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey + 1 AS region, upper(n_name) || n_regionkey AS r FROM nation")
def fn_fields(t):
    """A field taken out of a row, and one put into it."""
    d = t.nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("r"))
    return d.select("n_nationkey", F.col("r.name").alias("name"), (F.col("r.region") + 1).alias("region"), F.concat(F.col("r").withField("name", F.upper("r.name")).getField("name"), "r.region").alias("r"))


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER () - 1 AS place FROM customer) WHERE place IN (0, 7, 40)")
def tid_scan(t):
    """Rows by their place in the file."""
    return S.at_places(t.customer, [0, 7, 40]).select("c_custkey", "c_name")


@query("SELECT s_suppkey, CASE WHEN rn BETWEEN 3 AND 5 THEN 0 ELSE s_acctbal END AS s_acctbal FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM supplier)")
def update_current_of(t):
    """UPDATE of the rows that a cursor stands on."""
    e = _engine(t)
    e.create_table("s", t.supplier.select("s_suppkey", "s_acctbal"))
    e.declare("c", e.table("s"), "-s_acctbal", "s_suppkey")
    e.move("c", 2)
    e.update_current("s", e.fetch("c", 3), {"s_acctbal": F.lit(0.0)})
    return e.table("s")


@query("SELECT n_regionkey, max(CASE WHEN n_nationkey % 2 = 0 THEN n END)::BIGINT AS \"even\", max(CASE WHEN n_nationkey % 2 = 1 THEN n END)::BIGINT AS \"odd\" FROM (SELECT n_regionkey, n_nationkey % 2 AS n_nationkey, count(*) AS n FROM nation GROUP BY 1, 2) GROUP BY 1")
def crosstab_view(t):
    """A result's rows turned into columns, which its own values name."""
    n = t.nation.groupBy("n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("parity")).agg(F.count("*").alias("n"))
    return R.crosstab_view(n, "n_regionkey", "parity", "n")


@query("SELECT p_partkey, 'int' AS size, 'UTF8_BINARY' AS coll, true AS db, p_partkey % 10 = 0 AS tenth FROM part")
def system_functions(t):
    x = t.part
    return x.select("p_partkey", E.typeof("p_size").alias("size"), F.element_at(F.split(E.collation_for("p_name"), r"\."), -1).alias("coll"), (F.current_database().isNotNull() & F.version().startswith("4") & F.current_user().isNotNull()).alias("db"), (F.col("p_partkey") % 10 == 0).alias("tenth"))


@query("SELECT 5::BIGINT AS first, 7::BIGINT AS second, 7::BIGINT AS current, (SELECT count(*) FROM region)::BIGINT * 2 + 7 AS last")
def sequence_calls(t):
    """nextval twice, currval, then as many as there are regions."""
    e = _engine(t)
    e.create_sequence("s", start=5, increment=2)
    first, second = e.nextval("s"), e.nextval("s")
    current = e.currval("s")
    e.numbered(t.region, "s", "i")
    return t.spark.createDataFrame([(first, second, current, e.lastval())], "first bigint, second bigint, current bigint, last bigint")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice > 300000")
def explained(t):
    """A plan whose filters reach the scan, as its text says, and the rows."""
    e = _engine(t)
    e.create_table("o", t.orders)
    df = e.query("SELECT o_orderkey FROM o WHERE o_totalprice > 300000 AND o_orderkey % 3 = 0")
    if "GreaterThan(o_totalprice,300000.0)" not in e.explain(df):
        raise AssertionError("the filter isn't pushed down")
    return df
