"""Queries on odd and larger values against their SQL: what the findings of round 2 are about."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quarry.functions import numbers as N
from quarry.plans.registry import ORACLE_SQL, QUERIES


def same(spark, folder, name, **tables):
    """The query's rows and its SQL's, over these tables; reprs, so that a negative zero shows."""
    c = duckdb.connect(config={"threads": 1})
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, want = QUERIES[name](spark, str(folder)), c.sql(ORACLE_SQL[name])
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_largest_and_smallest_of_equal_balances(spark, tmp_path):
    keys = pa.array([3, 4, 5, 6, 7, 8, None, 9], pa.int64())
    balances = [1.0, 1.0, 2.0, 2.0, None, 5.0, 9.0, None]
    same(spark, tmp_path, "agg_any_value_argmax", customer={"c_custkey": keys, "c_nationkey": pa.array([0, 0, 0, 0, 0, 1, 0, 2], pa.int32()), "c_acctbal": balances})


def test_bit_strings_of_keys_over_16_bits(spark, tmp_path):
    same(spark, tmp_path, "fn_bit_strings", part={"p_partkey": pa.array([1, 65535, 65536, 119_999, 1 << 40], pa.int64()), "p_size": pa.array([1, 2, 3, 4, 50], pa.int32())})
    assert spark.range(1).select(N.bits_number(N.bits(N.F.lit(-5), 64)), N.bits_number(N.F.lit("1" * 16))).first()[:] == (-5, 65535)


def test_checked_numbers_with_nulls_and_close_halves(spark, tmp_path):
    tax = [0.0, 0.01, None, 0.05839828, 0.02, 0.03]
    flags, states = ["A", None, "N", None, "A", None], ["F", "F", "O", "O", None, None]
    long = lambda *x: pa.array(x, pa.int64())
    lines = {"l_orderkey": long(1, 2, 3, 4, 5, 6), "l_partkey": long(1, None, 3, 4, 5, 6), "l_suppkey": long(6, 5, 4, 3, 2, 1), "l_linenumber": pa.array([1, 2, 3, 4, None, 6], pa.int32())}
    lines |= {"l_quantity": [1.0, 50.0, None, 43.36276827391349, 9.0, 2.0], "l_extendedprice": [1.5, None, 2.5, 3.5, 4.5, 5.5], "l_discount": [0.0, 0.1, None, 0.03, 0.04, 0.05], "l_tax": tax}
    same(spark, tmp_path, "fn_checked_numbers", lineitem=lines | {"l_returnflag": flags, "l_linestatus": states})


def test_number_text_of_a_negative_zero(spark, tmp_path):
    balances = [-0.0, 0.0, -0.01, 0.05, -999.99, 9999.99, None]
    same(spark, tmp_path, "fn_number_text", customer={"c_custkey": list(range(7)), "c_nationkey": pa.array([0, 1, 2, 3, 4, 24, 5], pa.int32()), "c_acctbal": balances})


def test_similar_words_are_compared_once(spark, tmp_path):
    """Of 20,000 parts with 2 words and 2,000 suppliers only the words meet: no join gives more rows than parts and suppliers have."""
    n, m = 20_000, 2_000
    names = [f"{'blue' if i % 2 else 'green'} rod" for i in range(n)]
    part = {"p_partkey": list(range(n)), "p_name": names, "p_size": pa.array([i % 3 for i in range(n)], pa.int32())}
    pq.write_table(pa.table(part), f"{tmp_path}/part.parquet")
    pq.write_table(pa.table({"s_suppkey": list(range(m))}), f"{tmp_path}/supplier.parquet")
    df = QUERIES["join_similarity"](spark, str(tmp_path))
    got = {r.s_suppkey: r.n for r in df.collect()}
    gram = lambda w: {f"  {w} "[i : i + 3] for i in range(len(w) + 1)}
    for k in (0, 1, 2, 51, 1_999):
        v = f"{names[k].split()[0]}{k % 50}"
        like = [len(gram(w) & gram(v)) / len(gram(w) | gram(v)) >= 0.6 for w in (f"{x.split()[0]}{s}" for x, s in zip(names[:6], part["p_size"].to_pylist()[:6], strict=True))]
        assert got.get(k, 0) == sum(like[i % 6] for i in range(n))
    rows = []

    def walk(plan):
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        plan = plan.plan() if plan.getClass().getSimpleName().endswith("QueryStageExec") else plan
        if "Join" in plan.getClass().getSimpleName() and plan.metrics().contains("numOutputRows"):
            rows.append(plan.metrics().apply("numOutputRows").value())
        for i in range(plan.children().size()):
            walk(plan.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= n + m, rows


def test_language_bounds_count_all_labelled_documents(spark):
    """The quantile is that of 9,600 or so unlearned documents, not of some 2,000."""
    F, language = N.F, __import__("quarry.llm.language", fromlist=["bounds"])
    n = 10_000
    found = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("aa").alias("lang"), F.lit("aa").alias("p"), (F.col("id") / n).alias("r"))
    left = found.select(F.col("doc_id").alias("id"), "text", "r").where(language.place(7) >= language.SAMPLE_DOCS / n)
    rates = sorted(x.r for x in left.collect())
    assert len(rates) > 9_000
    assert abs(language.bounds(found, "doc_id", "text", "lang", "p", "r")["aa"] - rates[int(0.99 * len(rates))]) < 2 / n
