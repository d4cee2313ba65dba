"""Queries of JSON functions, over documents built from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_text as J
from .registry import query, scalars

#: One document of each order, as Spark and as DuckDB write it.
_SQL = """('{"a":' || o_orderkey || ',"b":[' || o_custkey || ',null,"' || o_orderstatus || '"],"c":{"p":"' || o_orderpriority || '","z":null}}')"""


def _j():
    return F.concat(F.lit('{"a":'), "o_orderkey", F.lit(',"b":['), "o_custkey", F.lit(',null,"'), "o_orderstatus", F.lit('"],"c":{"p":"'), "o_orderpriority", F.lit('","z":null}}'))


scalars(
    "fn_json_access", "orders", "o_orderkey",
    valid=(lambda: J.is_valid(_j()), f"json_valid({_SQL})"), bad=(lambda: J.is_valid(F.concat(_j(), F.lit("}"))), f"json_valid({_SQL} || '}}')"),
    k=(lambda: J.get(_j(), "c"), f"({_SQL}::JSON -> 'c')::VARCHAR"), none=(lambda: J.get(_j(), "zz"), f"({_SQL}::JSON -> 'zz')::VARCHAR"), kt=(lambda: J.get_text(_j(), "a"), f"{_SQL}::JSON ->> 'a'"),
    n=(lambda: J.get(J.get(_j(), "b"), 0), f"json_extract({_SQL}, '$.b[0]')::VARCHAR"), neg=(lambda: J.get(J.get(_j(), "b"), -1), f"json_extract({_SQL}, '$.b[#-1]')::VARCHAR"), out=(lambda: J.get(J.get(_j(), "b"), 7), f"json_extract({_SQL}, '$.b[7]')::VARCHAR"),
    nt=(lambda: J.get_text(J.get(_j(), "b"), -1), f"json_extract_string({_SQL}, '$.b[#-1]')"), nul=(lambda: J.get_text(J.get(_j(), "b"), 1), f"nullif(json_extract_string({_SQL}, '$.b[1]'), 'null')"),
    p=(lambda: J.path(_j(), "c", "p"), f"json_extract({_SQL}, '$.c.p')::VARCHAR"), pt=(lambda: J.path_text(_j(), "c", "p"), f"json_extract_string({_SQL}, '$.c.p')"), pn=(lambda: J.path_text(_j(), "b", 2), f"json_extract_string({_SQL}, '$.b[2]')"),
    al=(lambda: J.array_length(J.get(_j(), "b")).cast("long"), f"json_array_length({_SQL}, '$.b')::BIGINT"), ks=(lambda: J.keys(_j()), f"json_keys({_SQL})"),
)


@query(f"SELECT o_orderkey, k AS key, (j -> k)::VARCHAR AS value, CASE WHEN json_type(j -> k) <> 'NULL' THEN j ->> k END AS text FROM (SELECT o_orderkey, j, unnest(json_keys(j)) AS k FROM (SELECT o_orderkey, (({_SQL})::JSON -> 'c') AS j FROM orders))")
def fn_json_each(t):
    d = t.orders.select("o_orderkey", J.get(_j(), "c").alias("j"))
    both = F.arrays_zip(J.each("j").alias("a"), J.each_text("j").alias("b"))
    return d.select("o_orderkey", F.explode(both).alias("x")).select("o_orderkey", "x.a.key", "x.a.value", F.col("x.b.value").alias("text"))


@query(f"SELECT o_orderkey, unnest(json_extract(j, '$.b[*]'))::VARCHAR AS value FROM (SELECT o_orderkey, ({_SQL})::JSON AS j FROM orders)")
def fn_json_elements(t):
    return t.orders.select("o_orderkey", F.explode(J.elements(J.get(_j(), "b"))).alias("value"))


@query(f"SELECT o_orderkey, nullif(unnest(json_extract_string(j, '$.b[*]')), 'null') AS value FROM (SELECT o_orderkey, ({_SQL})::JSON AS j FROM orders)")
def fn_json_elements_text(t):
    return t.orders.select("o_orderkey", F.explode(J.elements_text(J.get(_j(), "b"))).alias("value"))


@query(f"SELECT o_orderkey, unnest(json_keys(({_SQL})::JSON)) AS key FROM orders")
def fn_json_object_keys(t):
    return t.orders.select("o_orderkey", F.explode(J.keys(_j())).alias("key"))


@query("SELECT o_orderkey, o_orderkey AS a, o_custkey AS first, o_orderpriority AS p, NULL::VARCHAR AS missing, o_orderkey AS pa, o_orderstatus AS pd FROM orders")
def fn_json_record(t):
    """json_to_record, and json_populate_record over a row whose field the document lacks."""
    base = F.struct(F.lit(0).cast("long").alias("a"), F.col("o_orderstatus").alias("d"))
    d = t.orders.select("o_orderkey", J.to_record(_j(), "a long, b array<string>, c struct<p: string>, missing string").alias("r"), J.populate(_j(), base, "a long, d string").alias("q"))
    return d.select("o_orderkey", "r.a", F.get("r.b", F.lit(0)).cast("long").alias("first"), F.col("r.c.p").alias("p"), "r.missing", F.col("q.a").alias("pa"), F.col("q.d").alias("pd"))


@query("SELECT o_orderkey, unnest([o_orderkey, o_custkey]) AS k, unnest([o_orderstatus, NULL]) AS s FROM orders")
def fn_json_recordset(t):
    j = F.concat(F.lit('[{"k":'), "o_orderkey", F.lit(',"s":"'), "o_orderstatus", F.lit('"},{"k":'), "o_custkey", F.lit("}]"))
    return t.orders.select("o_orderkey", F.inline(J.to_recordset(j, "k long, s string")))


scalars(
    "fn_json_build", "orders", "o_orderkey",
    s=(lambda: J.of(F.concat("o_orderpriority", F.lit('"\\'))), "to_json(o_orderpriority || '\"\\')::VARCHAR"), n=(lambda: J.of("o_custkey"), "to_json(o_custkey)::VARCHAR"), nul=(lambda: J.of(F.nullif("o_orderstatus", F.lit("F"))), "coalesce(to_json(nullif(o_orderstatus, 'F'))::VARCHAR, 'null')"),
    row=(lambda: J.of_row(k="o_custkey", s=F.nullif("o_orderstatus", F.lit("F")), l=F.array("o_orderkey")), "to_json({'k': o_custkey, 's': nullif(o_orderstatus, 'F'), 'l': [o_orderkey]})::VARCHAR"), arr=(lambda: J.of_array(F.array("o_custkey", F.lit(None).cast("long"))), "to_json([o_custkey, NULL])::VARCHAR"),
    ba=(lambda: J.build_array("o_custkey", "o_orderstatus", F.lit(True), F.lit(None)), "json_array(o_custkey, o_orderstatus, true, NULL)::VARCHAR"), o1=(lambda: J.object_of(F.array(F.lit("a"), "o_orderstatus", F.lit("b"), "o_orderpriority")), "json_object('a', o_orderstatus, 'b', o_orderpriority)::VARCHAR"),
    o2=(lambda: J.object_of(F.array(F.lit("x"), F.lit("y")), F.array("o_orderpriority", F.nullif("o_orderstatus", F.lit("F")))), "json_object('x', o_orderpriority, 'y', nullif(o_orderstatus, 'F'))::VARCHAR"),
)
scalars(
    "fn_jsonb_operators", "orders", "o_orderkey",
    con=(lambda: J.contains(_j(), F.lit('{"c":{"p":"1-URGENT"}}')), f"json_contains({_SQL}, '{{\"c\":{{\"p\":\"1-URGENT\"}}}}')"), cin=(lambda: J.contains(_j(), F.concat(F.lit('{"b":["'), F.lit("F"), F.lit('"]}'))), "o_orderstatus = 'F'"),
    by=(lambda: J.contains(F.lit('{"s":["F","O"],"x":1}'), F.concat(F.lit('{"s":["'), "o_orderstatus", F.lit('"]}'))), "o_orderstatus IN ('F', 'O')"),
    ha=(lambda: J.has_key(_j(), "c"), f"list_contains(json_keys({_SQL}), 'c')"), he=(lambda: J.has_key(J.get(_j(), "b"), "F"), "o_orderstatus = 'F'"), any_=(lambda: J.has_any(J.get(_j(), "b"), ["F", "P"]), "o_orderstatus IN ('F', 'P')"), all_=(lambda: J.has_all(_j(), ["a", "zz"]), f"list_has_all(json_keys({_SQL}), ['a', 'zz'])"),
    mk=(lambda: J.minus(_j(), "b"), f"json_merge_patch({_SQL}, '{{\"b\":null}}')::VARCHAR"), mi=(lambda: J.minus(J.get(_j(), "b"), 0), "'[null,\"' || o_orderstatus || '\"]'"), ms=(lambda: J.minus(J.get(_j(), "b"), "F"), "'[' || o_custkey || ',null' || CASE WHEN o_orderstatus = 'F' THEN ']' ELSE ',\"' || o_orderstatus || '\"]' END"),
    cat=(lambda: J.join(J.get(_j(), "c"), F.concat(F.lit('{"p":'), "o_custkey", F.lit(',"q":[]}'))), "'{\"p\":' || o_custkey || ',\"q\":[],\"z\":null}'"), cata=(lambda: J.join(J.get(_j(), "b"), F.lit('"x"')), f"json_array(json_extract({_SQL}, '$.b[0]'), json_extract({_SQL}, '$.b[1]'), json_extract({_SQL}, '$.b[2]'), 'x')::VARCHAR"),
    eq=(lambda: J.equal(F.concat(F.lit('{"x": 1.0, "y":"'), "o_orderstatus", F.lit('"}')), F.lit('{"y":"F","x":1}')), "o_orderstatus = 'F'"),
    st=(lambda: J.strip_nulls(_j()), "'{\"a\": ' || o_orderkey || ', \"b\": [' || o_custkey || ', null, \"' || o_orderstatus || '\"], \"c\": {\"p\": \"' || o_orderpriority || '\"}}'"),
    se=(lambda: J.set_path(J.get(_j(), "b"), ["-1"], F.lit("[1]")), "'[' || o_custkey || ', null, [1]]'"), sn=(lambda: J.set_path(J.get(_j(), "c"), ["new"], J.of("o_custkey")), "'{\"p\": \"' || o_orderpriority || '\", \"z\": null, \"new\": ' || o_custkey || '}'"), so=(lambda: J.set_path(J.get(_j(), "c"), ["new"], J.of("o_custkey"), create=False), "'{\"p\": \"' || o_orderpriority || '\", \"z\": null}'"),
    ins=(lambda: J.insert_path(J.get(_j(), "b"), ["0"], F.lit('"i"'), after=True), "'[' || o_custkey || ', \"i\", null, \"' || o_orderstatus || '\"]'"), mp=(lambda: J.path(J.minus_path(_j(), ["c", "z"]), "c"), "'{\"p\":\"' || o_orderpriority || '\"}'"),
    pr=(lambda: J.pretty(J.get(_j(), "b")), "'[' || chr(10) || '    ' || o_custkey || ',' || chr(10) || '    null,' || chr(10) || '    \"' || o_orderstatus || '\"' || chr(10) || ']'"), no=(lambda: J.normal(F.concat(F.lit('{"bb":1,"a":"x","a":'), "o_custkey", F.lit("}"))), "'{\"a\": ' || o_custkey || ', \"bb\": 1}'"),
)


@query("""SELECT n_regionkey, to_json(list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END ORDER BY n_nationkey))::VARCHAR AS names, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY n_regionkey""")
def agg_json(t):
    even = t.nation.withColumn("x", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    return even.groupBy("n_regionkey").agg(J.agg("x", "n_nationkey").alias("names"), J.object_agg("n_name", "n_nationkey").alias("keys"))
