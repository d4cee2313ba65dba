"""Queries of the relational operators: scans, joins, aggregates, windows, set operations, recursion, pivots, changes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators import relational as R
from ..sources import store as S
from ..streaming import changes
from .registry import money, query, same_sql


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price,
round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    x = t.lineitem.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return R.sort(x.agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")), "l_returnflag", "l_linestatus")


# Scans, filters and samples
same_sql("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.04 AND l_returnflag IN ('A', 'R')", "lineitem")
same_sql("index_scan_or", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 OR o_custkey = 11 OR (o_totalprice > 400000 AND o_orderstatus = 'F')", "orders")
same_sql("values_scan", "SELECT column1, upper(column2) AS name FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(column1, column2)", "region")
same_sql("result_one_time_filter", "SELECT r_name FROM region WHERE 1 = 2", "region")
same_sql("cte_scan", "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.c_nationkey, a.n FROM c a WHERE a.n >= (SELECT avg(n) FROM c)", "customer")
same_sql("subquery_scan", "SELECT s.k, s.n FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey) s WHERE s.n > 10", "lineitem")


@query("SELECT i, i * i AS sq, row_number() OVER (ORDER BY i) AS ordinality FROM (SELECT unnest(generate_series(3::BIGINT, 30::BIGINT, 3::BIGINT)) AS i)")
def function_scan(t):
    return t.spark.range(1).select(F.posexplode(F.sequence(F.lit(3).cast("long"), F.lit(30).cast("long"), F.lit(3).cast("long"))).alias("o", "i")).select("i", (F.col("i") * F.col("i")).alias("sq"), (F.col("o") + 1).cast("long").alias("ordinality"))


def _share(rows, total, low, high):
    """One row: whether the sample has no row twice and a size between those shares of the table."""
    n = rows.agg(F.count("*").alias("n"), F.count_distinct(*rows.columns).alias("d")).crossJoin(total.agg(F.count("*").alias("all")))
    return n.select((F.col("n") == F.col("d")).alias("once"), ((F.col("n") >= F.col("all") * low) & (F.col("n") <= F.col("all") * high)).alias("near"))


_KEYS = "(SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)"


@query(f"SELECT {_KEYS} AS once, true AS near")
def sample_bernoulli(t):
    """A tenth of the rows, each by itself."""
    rows = S.bernoulli(t.lineitem, 10, seed=7).select("l_orderkey", "l_linenumber")
    return _share(rows, t.lineitem, 0.08, 0.12)


@query("SELECT k, n > 0 AS any_, n = (SELECT count(*) FROM orders WHERE o_orderkey % 8 = k) AS whole FROM (SELECT o_orderkey % 8 AS k, count(*) AS n FROM orders WHERE o_orderkey % 8 IN (0, 1, 2, 3, 4, 5, 6, 7) GROUP BY 1)")
def sample_system(t):
    """Blocks: of a table in eight files, whole files are taken or left; both halves of the chance together are the table."""
    path = S.new_path(t.spark, "blocks")
    t.orders.withColumn("k", F.col("o_orderkey") % 8).repartition(8, "k").write.partitionBy("k").parquet(path)
    table = t.spark.read.parquet(path)
    taken, rest = S.system(table, 50, seed=7), S.system(table, 50, seed=7, rest=True)
    n = taken.unionAll(rest).groupBy("k").agg(F.count("*").alias("n"))
    size = t.orders.groupBy((F.col("o_orderkey") % 8).alias("k")).agg(F.count("*").alias("all"))
    return n.join(size, "k").select(F.col("k").cast("long").alias("k"), (F.col("n") > 0).alias("any_"), (F.col("n") == F.col("all")).alias("whole"))


@query("SELECT 100::BIGINT AS n, 100::BIGINT AS d, (SELECT count(*) FROM orders) AS found")
def sample_rows(t):
    """Exactly 100 rows of the table, none twice."""
    rows = S.system_rows(t.orders, 100, "o_orderkey")
    n = rows.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("d"))
    return n.crossJoin(t.orders.join(rows.select("o_orderkey"), "o_orderkey", "left_semi").unionAll(t.orders.join(rows.select("o_orderkey"), "o_orderkey", "left_anti")).agg(F.count("*").alias("found")))


@query("SELECT true AS some, true AS once")
def sample_time(t):
    """What can be read in ten seconds, no row twice."""
    rows = S.system_time(t.orders, 10_000).select("o_orderkey")
    return rows.agg((F.count("*") > 0).alias("some"), (F.count("*") == F.count_distinct("o_orderkey")).alias("once"))


@query("SELECT c_custkey, c_name, c_acctbal, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def copy_round_trip(t):
    """Text-format lines written and read again."""
    rows = t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "c_acctbal", "n_name")
    return S.copy_parse(rows.select(S.copy_line(rows.schema).alias("value")), rows.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(t):
    path = S.new_path(t.spark, "csv")
    t.nation.write.csv(path, header=True, quoteAll=True)
    return S.csv(t.spark, path, t.nation.schema, header="true")


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def inheritance_scan(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    return S.inherited(["key", "name"], a, t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


# Joins
same_sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0", "orders customer")
same_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey", "orders customer")
same_sql("join_right", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 2", "nation supplier")
same_sql("join_full", "SELECT c.k AS ck, s.k AS sk FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9800) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000) s ON c.k = s.k", "customer supplier")
same_sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders")
same_sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer orders")
same_sql("join_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)", "part lineitem")
same_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <= 1", "region nation")
same_sql("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier")
same_sql("join_using", "SELECT k, a.n AS na, b.n AS nb FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)", "customer supplier")
same_sql("join_natural", "SELECT n_nationkey, n_name FROM nation NATURAL JOIN (SELECT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal > 9900) c", "nation customer")
same_sql("join_lateral", "SELECT n_name, x.c_custkey, x.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x", "nation customer")
same_sql("subquery_scalar", "SELECT p_partkey, p_retailprice - (SELECT avg(p_retailprice) FROM part) > 0 AS above FROM part", "part")
same_sql("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def join_not_in(t):
    return R.not_in(t.supplier, t.customer.where("c_acctbal > 9900"), [("s_nationkey", "c_nationkey")]).select("s_suppkey")


@query("""SELECT o_orderkey FROM (SELECT *, nullif(o_custkey % 7, 0) AS a, nullif(o_orderstatus, 'P') AS b FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM
(SELECT nullif(c_nationkey, 3) AS x, CASE WHEN c_mktsegment = 'BUILDING' THEN 'F' WHEN c_mktsegment = 'MACHINERY' THEN 'O' END AS y FROM customer WHERE c_custkey % 50 = 1 AND c_nationkey < 4) c
WHERE (a = x OR a IS NULL OR x IS NULL) AND (b = y OR b IS NULL OR y IS NULL))""")
def join_not_in_rows(t):
    """(a, b) NOT IN rows with nulls on both sides, field by field."""
    o = t.orders.withColumns({"a": F.nullif(F.col("o_custkey") % 7, F.lit(0)), "b": F.nullif("o_orderstatus", F.lit("P"))})
    y = F.when(F.col("c_mktsegment") == "BUILDING", "F").when(F.col("c_mktsegment") == "MACHINERY", "O")
    c = t.customer.where("c_custkey % 50 = 1 AND c_nationkey < 4").select(F.nullif("c_nationkey", F.lit(3)).alias("x"), y.alias("y"))
    return R.not_in(o, c, [("a", "x"), ("b", "y")]).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey > ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def quantified_all(t):
    return R.compared_to_all(t.supplier, "s_nationkey", ">", t.nation.where("n_regionkey = 0"), "n_nationkey").select("s_suppkey")


@query("""SELECT e.event_id, p.event_id AS before_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'purchase'""")
def join_as_of(t):
    right = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("before_id"))
    return R.as_of(t.events.where("event_type <> 'purchase'"), right, ["user_id"], "ts", "at", ["before_id"]).select("event_id", "before_id")


@query("""SELECT e.event_id, count(*) AS n, min(l.k) AS k FROM events e JOIN (SELECT o_orderkey AS k, o_totalprice / 1000 AS lo, o_totalprice / 1000 + 0.004 AS hi FROM orders) l
ON e.value >= l.lo AND e.value < l.hi GROUP BY e.event_id""")
def join_range(t):
    """All events by the ranges of all orders."""
    r = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("lo"), (F.col("o_totalprice") / 1000 + 0.004).alias("hi"))
    return R.range_join(t.events, r, "value", "lo", "hi", 0.05).groupBy("event_id").agg(F.count("*").alias("n"), F.min("k").alias("k"))


@query("""SELECT a.k, count(*) AS n, min(b.k) AS first FROM (SELECT o_orderkey AS k, o_totalprice AS lo, o_totalprice + 3 AS hi FROM orders) a
JOIN (SELECT c_custkey AS k, c_acctbal * 40 AS lo, c_acctbal * 40 + 5 AS hi FROM customer) b ON a.lo < b.hi AND b.lo < a.hi GROUP BY a.k""")
def join_range_overlap(t):
    """Ranges of orders that overlap ranges of customers (&&), each pair once."""
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("lo"), (F.col("o_totalprice") + 3).alias("hi"))
    b = t.customer.select(F.col("c_custkey").alias("k2"), (F.col("c_acctbal") * 40).alias("lo2"), (F.col("c_acctbal") * 40 + 5).alias("hi2"))
    return R.overlap_join(a, b, ("lo", "hi"), ("lo2", "hi2"), 10.0).groupBy("k").agg(F.count("*").alias("n"), F.min("k2").alias("first"))


@query("""SELECT p_partkey, count(*) AS n FROM part JOIN (SELECT c_custkey, c_acctbal / 20 AS x, c_nationkey * 20 AS y FROM customer) c
ON sqrt(pow(p_size * 10 - x, 2) + pow(p_retailprice / 4 - y, 2)) <= 5 GROUP BY p_partkey""")
def join_spatial(t):
    """Points within a distance of others."""
    a = t.part.select("p_partkey", (F.col("p_size") * 10).cast("double").alias("x"), (F.col("p_retailprice") / 4).alias("y"))
    b = t.customer.select((F.col("c_acctbal") / 20).alias("x2"), (F.col("c_nationkey") * 20).cast("double").alias("y2"))
    return R.distance_join(a, b, ("x", "y"), ("x2", "y2"), 5.0).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, c_custkey, rn AS place FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY pow(s_acctbal - c_acctbal, 2) + pow(50 * s_nationkey - 50 * c_nationkey, 2), c_custkey) AS rn
FROM supplier, customer) WHERE rn <= 3""")
def join_nearest(t):
    """The three nearest customers of each supplier, by balance and nation."""
    a = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 50).cast("double").alias("y"))
    b = t.customer.select("c_custkey", F.col("c_acctbal").alias("x2"), (F.col("c_nationkey") * 50).cast("double").alias("y2"))
    return R.nearest_join(a, b, "s_suppkey", "c_custkey", ("x", "y"), ("x2", "y2"), 3, 100.0).select("s_suppkey", "c_custkey", F.col("place").cast("long").alias("place"))


@query("""WITH g AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, length(p_name) + 2), lambda i: substring('  ' || lower(p_name) || ' ', i, 3))) AS g FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || p_size AS p_name FROM part)),
b AS (SELECT s_suppkey, list_distinct(list_transform(range(1, length(w) + 2), lambda i: substring('  ' || lower(w) || ' ', i, 3))) AS h FROM (SELECT s_suppkey, split_part((SELECT min(p_name) FROM part WHERE p_partkey = s_suppkey), ' ', 1) || (s_suppkey % 50) AS w FROM supplier) WHERE w IS NOT NULL)
SELECT s_suppkey, count(*) AS n FROM g, b WHERE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) >= 0.6 GROUP BY s_suppkey""")
def join_similarity(t):
    """Words whose trigrams resemble each other by 0.6 or more: equal words are compared once, then counted."""
    a = t.part.select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size")).alias("w")).groupBy("w").agg(F.count("*").alias("copies"))
    names = t.part.groupBy(F.col("p_partkey").alias("s_suppkey")).agg(F.min("p_name").alias("p_name"))
    words = t.supplier.select("s_suppkey").join(names, "s_suppkey")
    b = words.select("s_suppkey", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), (F.col("s_suppkey") % 50)).alias("v"))
    found = R.similarity_join(a, b.select("v").distinct(), "w", "v", 0.6).groupBy("v").agg(F.sum("copies").alias("each"))
    return b.join(found, "v").groupBy("s_suppkey").agg(F.sum("each").alias("n"))


# Aggregation
same_sql("agg_group", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS custs, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority", "orders")
same_sql("agg_plain", "SELECT count(*) AS n, min(l_shipdate) AS a, max(l_shipdate) AS z FROM lineitem", "lineitem")
same_sql("agg_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 30 AND min(l_quantity) < 3", "lineitem")
same_sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, count(DISTINCT l_partkey) FILTER (WHERE l_discount = 0) AS parts FROM lineitem GROUP BY l_returnflag", "lineitem")
same_sql("agg_bool_bit", "SELECT c_mktsegment, bool_and(c_acctbal > -999) AS every, bool_or(c_acctbal > 9990) AS some, bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx FROM customer GROUP BY c_mktsegment", "customer")
same_sql("agg_statistics", """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sds, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp,
round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_discount, l_tax), 8) AS cp, round(covar_samp(l_discount, l_tax), 8) AS cs FROM lineitem GROUP BY l_returnflag""", "lineitem")
same_sql("agg_regression", """SELECT l_linestatus, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 5) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_linestatus""", "lineitem")
same_sql("agg_percentile_cont", "SELECT o_orderpriority, percentile_cont(0.25) WITHIN GROUP (ORDER BY o_custkey) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_custkey) AS q2 FROM orders GROUP BY o_orderpriority", "orders")
same_sql("agg_expression_keys", "SELECT l_linenumber % 3 AS g, l_quantity > 25 AS big, count(*) AS n FROM lineitem GROUP BY l_linenumber % 3, l_quantity > 25", "lineitem")


@query("SELECT c_nationkey, max_by(c_custkey, c_acctbal) AS richest, min_by(c_custkey, c_acctbal) AS poorest FROM customer GROUP BY c_nationkey")
def agg_any_value_argmax(t):
    """Of equal balances the smallest key counts, the first in the table's order."""
    balance = F.when(F.col("c_custkey").isNotNull() & F.col("c_acctbal").isNotNull(), F.col("c_acctbal"))
    ranked = lambda sign: F.when(balance.isNotNull(), F.struct(balance, sign * F.col("c_custkey")))
    return t.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", ranked(-1)).alias("richest"), F.min_by("c_custkey", ranked(1)).alias("poorest"))


@query("SELECT n_regionkey, percentile_disc(0.5) WITHIN GROUP (ORDER BY n_name) AS mid, first(n_name ORDER BY n_name) AS one FROM nation GROUP BY n_regionkey")
def agg_percentile_disc_text(t):
    mid = R.percentile_disc(t.nation, ["n_regionkey"], "n_name", 0.5, "mid")
    return mid.join(t.nation.groupBy("n_regionkey").agg(F.min("n_name").alias("one")), "n_regionkey")


@query("""WITH c AS (SELECT n_regionkey, s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey, min(s_nationkey) AS m FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.n_regionkey = c.n_regionkey) GROUP BY n_regionkey""")
def agg_mode(t):
    c = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_regionkey").agg(F.mode("s_nationkey", True).alias("m"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey")
def agg_ordered(t):
    names = F.array_join(F.reverse(F.array_sort(F.collect_list("n_name"))), ",")
    return t.nation.groupBy("n_regionkey").agg(names.alias("names"), R.array_agg("n_nationkey", "n_nationkey").alias("keys"))


@query("SELECT n_regionkey, list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END ORDER BY n_nationkey) AS xs FROM nation GROUP BY n_regionkey")
def agg_array_with_nulls(t):
    return t.nation.withColumn("x", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))).groupBy("n_regionkey").agg(R.array_agg("x", "n_nationkey").alias("xs"))


@query("""SELECT c_mktsegment, count(*) FILTER (c_acctbal < 5000) + 1 AS r, count(DISTINCT c_nationkey) FILTER (c_nationkey < 10) + 1 AS d,
round(count(*) FILTER (c_acctbal < 5000) / count(*), 8) AS p, round((count(*) FILTER (c_acctbal <= 5000) + 1) / (count(*) + 1), 8) AS c FROM customer GROUP BY c_mktsegment""")
def agg_hypothetical(t):
    h = R.hypothetical
    return t.customer.groupBy("c_mktsegment").agg(h("rank", "c_acctbal", 5000.0).alias("r"), h("dense_rank", "c_nationkey", 10).alias("d"), F.round(h("percent_rank", "c_acctbal", 5000.0), 8).alias("p"), F.round(h("cume_dist", "c_acctbal", 5000.0), 8).alias("c"))


for _n, _g in (("agg_rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("agg_cube", "CUBE (l_returnflag, l_linestatus)"), ("agg_grouping_sets", "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")):
    same_sql(_n, f"SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY {_g}", "lineitem")


@query("SELECT NULL::VARCHAR AS l_returnflag, 0::BIGINT AS n FROM range(2)")
def agg_grouping_sets_empty(t):
    return R.grouping_sets(t.lineitem.where("l_quantity < 0"), [["l_returnflag"], [], []], F.count("*").alias("n"))


# Windows
_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey"
same_sql("window_rank", f"SELECT o_orderkey, row_number() {_W}) AS rn, rank() {_W}) AS rk, dense_rank() {_W}) AS dr, ntile(3) {_W}) AS nt, round(percent_rank() {_W}), 8) AS pr, round(cume_dist() {_W}), 8) AS cd FROM orders", "orders")
same_sql("window_offset", f"SELECT o_orderkey, lag(o_totalprice) {_W}) AS a, lead(o_orderkey, 2) {_W}) AS b, lag(o_orderkey, 1, -1) {_W}) AS c FROM orders", "orders")
same_sql("window_value", f"SELECT o_orderkey, first_value(o_orderkey) {_W}) AS f, last_value(o_orderkey) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM orders", "orders")
same_sql("window_frames", f"SELECT o_orderkey, count(*) {_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a, max(o_orderkey) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, min(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS c FROM orders", "orders")
same_sql("window_over_groups", "SELECT l_suppkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY l_suppkey", "lineitem")
same_sql("window_running_share", "SELECT c_custkey, sum(cast(c_acctbal AS decimal(18,2))) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS positive, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM customer", "customer")


# Order, limit, distinct
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def top_n(t):
    return R.limit(t.orders, ["-o_totalprice", "o_orderkey"], 20, 5).select("o_orderkey", "o_totalprice")


@query("SELECT k FROM (SELECT CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey END AS k FROM nation) ORDER BY k NULLS LAST LIMIT 22")
def null_order(t):
    return R.limit(t.nation.select(F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey")).alias("k")), ["k"], 22)


same_sql("distinct", "SELECT DISTINCT p_brand, p_size > 25 AS big FROM part", "part")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return R.distinct_on(t.orders, ["o_custkey"], "-o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


# Set operations and recursion
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier"
for _n, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    same_sql(f"set_{_n}", f"{_A} {_op} {_B}", "customer supplier")


@query("WITH RECURSIVE r(k) AS (SELECT 1::BIGINT UNION SELECT (k * 3 + 1) % 17 FROM r) SELECT k FROM r")
def recursive_union(t):
    return R.recursive(t.spark.range(1, 2).select(F.col("id").alias("k")), lambda d: d.select(((F.col("k") * 3 + 1) % 17).alias("k")))


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def recursive_union_all(t):
    return R.recursive(t.spark.sql("SELECT 1 AS n, 1L AS f"), lambda d: d.where("n < 15").select((F.col("n") + 1).alias("n"), (F.col("f") * (F.col("n") + 1)).alias("f")), all_rows=True)


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS k, p_partkey // 3 AS p FROM part),
r(keyid, parent_keyid, level, branch) AS (SELECT 5::BIGINT, NULL::BIGINT, 0, '5' UNION ALL SELECT k, p, level + 1, branch || '~' || k FROM r JOIN e ON p = keyid) SELECT * FROM r""")
def connect_by(t):
    e = t.part.select(F.col("p_partkey").alias("k"), F.expr("p_partkey div 3").alias("p"))
    return R.connect_by(e, "k", "p", 5)


# Pivots
@query("""SELECT r_name AS row_name, max(n_name) FILTER (i = 1) AS category_1, max(n_name) FILTER (i = 2) AS category_2, max(n_name) FILTER (i = 3) AS category_3
FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name""")
def crosstab(t):
    return R.crosstab(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "r_name", "n_name", "n_name", 3)


@query("SELECT l_returnflag AS row_name, max(n) FILTER (l_linestatus = 'F') AS \"F\", max(n) FILTER (l_linestatus = 'O') AS \"O\" FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def crosstab_by(t):
    return R.crosstab_by(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "l_returnflag", "l_linestatus", "n", ["F", "O"], "n")


# Changes
_SRC = "(SELECT s_suppkey AS c_custkey, s_acctbal AS c_acctbal FROM supplier UNION ALL SELECT 100000000 + s_suppkey, s_acctbal FROM supplier WHERE s_suppkey < 10)"


def _source(t):
    a = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return a.unionAll(t.supplier.where("s_suppkey < 10").select((F.col("s_suppkey") + 100000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal")))


@query(f"""SELECT c.c_custkey, CASE WHEN s.c_custkey IS NOT NULL AND s.c_acctbal > 0 THEN s.c_acctbal ELSE c.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN {_SRC} s USING (c_custkey)
UNION ALL SELECT s.c_custkey, s.c_acctbal FROM {_SRC} s ANTI JOIN customer c USING (c_custkey)""")
def upsert_update(t):
    return R.upsert(t.customer.select("c_custkey", "c_acctbal"), _source(t), ["c_custkey"], {"c_acctbal": F.col("new.c_acctbal")}, F.col("new.c_acctbal") > 0)


@query(f"SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s.c_custkey, s.c_acctbal FROM {_SRC} s ANTI JOIN customer c USING (c_custkey)")
def upsert_nothing(t):
    return R.upsert(t.customer.select("c_custkey", "c_acctbal"), _source(t), ["c_custkey"])


@query("SELECT s_suppkey, round(s_acctbal + n_regionkey, 2) AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3")
def update_from_returning(t):
    changed = R.updated(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), t.nation.where("n_regionkey = 3"), F.col("old.s_nationkey") == F.col("new.n_nationkey"), {"s_acctbal": F.round(F.col("old.s_acctbal") + F.col("new.n_regionkey"), 2)})[1]
    return changed.select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
def delete_using(t):
    return R.deleted(t.supplier, t.nation.where("n_regionkey = 3"), F.col("old.s_nationkey") == F.col("new.n_nationkey"))[0].select("s_suppkey")


@query("""SELECT c_nationkey, n, action FROM (SELECT coalesce(a.c_nationkey, b.c_nationkey) AS c_nationkey, coalesce(b.n, a.n) AS n, CASE WHEN a.n IS NULL THEN 'insert' WHEN b.n IS NULL THEN 'delete' WHEN a.n <> b.n THEN 'update' END AS action
FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 8500 AND c_nationkey > 2 GROUP BY 1) b USING (c_nationkey)) WHERE action IS NOT NULL""")
def matview_refresh(t):
    view = lambda p: t.customer.where(p).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return R.refreshed(view("c_acctbal > 9000"), view("c_acctbal > 8500 AND c_nationkey > 2"), ["c_nationkey"])


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING max_by(event_type, (ts, event_id)) <> 'click'")
def change_apply(t):
    """The last change of each key wins; a click stands for a delete."""
    e = t.events.where("event_type <> 'error'")
    out = changes.latest(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click")
    return out.select("user_id", "event_id")


_OLD_NEW = """(SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1) o
FULL JOIN (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1) n USING (user_id)"""


@query("SELECT user_id, rule, CASE rule WHEN 'remote' THEN coalesce(n.event_id, o.event_id) WHEN 'local' THEN coalesce(o.event_id, n.event_id) "
       "WHEN 'last' THEN CASE WHEN o.event_id IS NULL OR n.ts >= o.ts THEN n.event_id ELSE o.event_id END "
       f"ELSE CASE WHEN o.event_id IS NULL OR n.ts < o.ts THEN n.event_id ELSE o.event_id END END AS event_id FROM {_OLD_NEW}, (VALUES ('remote'), ('local'), ('last'), ('first')) r(rule)")  # fmt: skip
def change_conflicts(t):
    """Purchases applied to a table of clicks by each conflict rule."""
    e = t.events.select("user_id", "event_id", "ts", "event_type")
    table = changes.latest(e.where("event_type = 'click'"), ["user_id"], ["ts", "event_id"], F.lit(False))
    new = e.where("event_type = 'purchase'")
    by = lambda rule: changes.applied(table, new, ["user_id"], ["ts", "event_id"], F.lit(False), keep=rule, stamp="ts").select("user_id", F.lit(rule).alias("rule"), "event_id")
    return by("remote").unionAll(by("local")).unionAll(by("last")).unionAll(by("first"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(t):
    """Beyond the reference: tumbling windows."""
    return changes.tumbling(t.events, "ts", "1 hour", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def window_sessions(t):
    """Beyond the reference: session windows."""
    g = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
