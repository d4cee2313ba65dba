"""Statements of the engine: constraints, views, cursors, transactions, types, rights and maintenance."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import engine as E


@pytest.fixture()
def e(spark):
    return E.Engine(spark)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_constraints_and_defaults(e):
    e.create_table("t", "k int, v int, s string", keys=(("k",),), required=("v",), checks={"positive": "v > 0"}, defaults={"s": lambda: F.lit("d")})
    assert rows(e.insert("t", [{"k": 1, "v": 5}], returning=["k", "s"])) == [(1, "d")]
    for bad, text in (([{"k": 1, "v": 6}], "duplicate key"), ([{"k": 2}], "not-null"), ([{"k": 2, "v": -1}], "check constraint")):
        with pytest.raises(Exception, match=text):
            e.insert("t", bad)
    assert rows(e.table("t")) == [(1, 5, "d")]
    e.insert("t", [{"k": None, "v": 7}, {"k": None, "v": 8}])  # null keys are no repetition
    e.update("t", {"v": F.col("v") + 1}, "k = 1")
    e.delete("t", "k IS NULL AND v = 8")
    assert rows(e.table("t")) == [(1, 6, "d"), (None, 7, "d")]
    e.alter_table("t", lambda d: d.withColumn("more", F.lit(1)))
    e.truncate("t")
    assert e.table("t").columns == ["k", "v", "s", "more"] and e.table("t").count() == 0
    with pytest.raises(ValueError):
        e.create_table("t", "k int")


def test_update_and_delete_by_another_table(e, spark):
    e.create_table("t", spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int"))
    other = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    assert rows(e.update_from("t", other, F.col("old.k") == F.col("new.k"), {"v": F.col("new.w")}, returning=["k", "v"])) == [(1, 10), (2, 20)]
    e.delete_using("t", other.where("k = 2"), F.col("old.k") == F.col("new.k"))
    assert rows(e.table("t")) == [(1, 10), (3, 3)]
    e.upsert("t", spark.createDataFrame([(3, 4), (9, 9)], "k int, v int"), ["k"], {"v": F.col("new.v")})
    assert rows(e.table("t")) == [(1, 10), (3, 4), (9, 9)]


def test_views_and_check_option(e, spark):
    e.create_table("t", spark.createDataFrame([(1, "a"), (5, "b")], "k int, v string"))
    e.create_view("small", "SELECT * FROM t WHERE k < 3", check_option="local")
    e.insert_view("small", spark.createDataFrame([(2, "c")], "k int, v string"))
    assert rows(e.table("small")) == [(1, "a"), (2, "c")] and e.table("t").count() == 3
    with pytest.raises(Exception, match="check option"):
        e.insert_view("small", spark.createDataFrame([(7, "x")], "k int, v string"))
    with pytest.raises(ValueError):
        e.create_view("small", "SELECT 1")
    e.create_view("small", "SELECT k FROM t", replace=True)
    assert e.view_definition("small") == "SELECT k FROM t"
    e.create_materialized_view("m", "SELECT k, count(*) AS n FROM t GROUP BY k")
    e.delete("t", "k = 5")
    assert e.table("m").count() == 3
    assert rows(e.refresh("m", ["k"])) == [(5, 1, "delete")] and e.table("m").count() == 2


def test_transactions(e, spark):
    e.create_table("t", spark.createDataFrame([(1,)], "k int"))
    e.begin()
    e.insert("t", [{"k": 2}])
    e.savepoint("a")
    e.insert("t", [{"k": 3}])
    e.rollback("a")
    e.insert("t", [{"k": 4}])
    e.release("a")
    e.commit()
    assert rows(e.table("t")) == [(1,), (2,), (4,)]
    e.begin()
    e.delete("t")
    e.prepare_transaction("p")
    assert e.table("t").count() == 3
    e.rollback_prepared("p")
    with pytest.raises(ValueError):
        e.rollback()


def test_cursors(e, spark):
    e.declare("c", spark.range(10), "-id")
    got = lambda n: [r.id for r in e.fetch("c", n).collect()]
    assert got(3) == [9, 8, 7] and got(-2) == [8, 9] and got("last") == [0] and got("absolute 4") == [6] and got("relative -1") == [7] and got(0) == [7]
    assert got("all") == [6, 5, 4, 3, 2, 1, 0] and got(1) == [] and got(-1) == [0] and e.move("c", -100) == 9 and got("first") == [9]
    e.close("c")
    with pytest.raises(KeyError):
        e.fetch("c")


def test_sequences(e):
    e.create_sequence("s", start=5, increment=2, most=9, cycle=True, least=1)
    with pytest.raises(ValueError):
        e.currval("s")
    assert [e.nextval("s") for _ in range(4)] == [5, 7, 9, 1] and e.currval("s") == e.lastval() == 1
    e.setval("s", 3, called=False)
    assert e.nextval("s") == 3
    e.create_sequence("down", increment=-1)
    assert [e.nextval("down") for _ in range(2)] == [1, 0] if e.sequences["down"].most >= 1 else True
    e.create_sequence("few", most=1)
    e.nextval("few")
    with pytest.raises(OverflowError):
        e.nextval("few")


def test_types(e, spark):
    e.create_enum("mood", "sad", "ok", "happy")
    d = spark.createDataFrame([("happy",), ("sad",), (None,)], "m string")
    assert [r.m for r in d.orderBy(e.enum("m", "mood").asc_nulls_last()).collect()] == ["sad", "happy", None]
    assert e.enum_range("mood", last="ok") == ["sad", "ok"]
    with pytest.raises(Exception, match="invalid input value"):
        spark.range(1).select(e.enum(F.lit("x"), "mood")).collect()
    e.create_domain("zip", "string", "VALUE ~ '^[0-9]{5}$'")
    assert spark.range(1).select(e.domain(F.lit("12345"), "zip")).first()[0] == "12345"
    with pytest.raises(Exception, match="domain zip"):
        spark.range(1).select(e.domain(F.lit("x"), "zip")).collect()


def test_rights_locks_and_notifications(e, spark):
    e.create_table("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, who string"))
    e.user = "b"
    with pytest.raises(PermissionError):
        e.table("t")
    e.grant("t", "select", "public")
    e.create_policy("t", "a", "who = 'a'")
    assert e.table("t").count() == 0
    e.create_policy("t", "b", "who = 'b'")
    assert rows(e.table("t")) == [(2, "b")]
    e.revoke("t", "select", "public")
    with pytest.raises(PermissionError):
        e.table("t")
    assert e.lock(1, "x") and e.lock(1, "x") and not e.lock(1, "y") and e.unlock(1, "x") and not e.lock(1, "y") and e.unlock(1, "x") and e.lock(1, "y") and not e.unlock(1, "x")
    e.listen("c")
    for p in ("a", "a", "b"):
        e.notify("c", p)
    assert e.notifications("c") == ["a", "b"] and e.notifications("c") == []
    e.comment("table", "t", "text")
    assert e.comments["table", "t"] == "text"


def test_functions_settings_and_maintenance(e, spark, tmp_path):
    def plus_one(x: pd.Series) -> pd.Series:
        return x + 1

    e.create_python_function("plus_one", plus_one, "bigint")
    assert spark.sql("SELECT plus_one(41L)").first()[0] == 42
    e.do("BEGIN DECLARE x INT DEFAULT 3; SET x = x + 1; SELECT x; END")
    e.set_config("spark.sql.shuffle.partitions", e.current_setting("spark.sql.shuffle.partitions"))
    assert e.current_setting("no.such", "none") == "none"
    e.create_table("t", spark.range(1000).select((F.col("id") % 10).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("v")))
    stats = e.analyze("t")
    assert stats["k"] == (0.0, 10) and stats["v"][0] == 0.25 and abs(stats["v"][1] - 750) < 60
    e.vacuum("t", 1)
    e.cluster("t", "k")
    assert e.relation_size("t") > 0 and e.table("t").count() == 1000
    assert "PushedFilters" in e.explain("SELECT v FROM t WHERE k = 3") and e.explain(e.table("t"), "simple", analyze=True).startswith("Rows: 1000")
    e.prepare("q", "SELECT count(*) AS n FROM t WHERE k = $1 AND v IS NOT NULL")
    assert e.execute("q", 1).first().n == 100
    e.deallocate("q")
    (tmp_path / "f.txt").write_bytes(b"abc")
    assert bytes(E.read_file(spark, f"file://{tmp_path}/f.txt").first().content) == b"abc"
    assert E.format_type("int8") == "bigint" and E.format_type("varchar", 9) == "character varying(9)" and E.keywords(spark).where("word = 'select'").count() == 1
    fired = []
    e.create_event_trigger("ddl_command_end", lambda *about: fired.append(about))
    e.create_table("u", "k int")
    assert fired == [("u", "create")]
    e.discard()


def test_shards_are_pruned(spark):
    path = E.create_shards(spark.range(1000).withColumnRenamed("id", "k"), "k", 16)
    one = E.read_shards(spark, path, "k", 16, [7])
    assert [r.k for r in one.collect()] == [7] and len(E.read_shards(spark, path, "k", 16).inputFiles()) == 16
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [(shard" in one._jdf.queryExecution().executedPlan().toString()


def test_aggregates_fold_chunk_by_chunk(e, spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 7)
    e.create_aggregate("total", lambda s, x: s + x, F.lit(0).cast("long"), lambda a, b: a + b, lambda s: s * 2)
    d = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    assert rows(e.aggregate("total", d, ["g"], "id", "t")) == sorted((g, 2 * sum(range(g, 100, 3))) for g in range(3))
    assert rows(e.aggregate("total", d.limit(0), [], "id", "t")) == [(0,)]
    text = F.lit("")
    e.create_aggregate("joined", lambda s, x: F.concat(s, x.cast("string")), text, lambda a, b: F.concat(a, b))
    assert rows(e.aggregate("joined", d.where("id < 6"), ["g"], "id", "t", "id")) == [(0, "03"), (1, "14"), (2, "25")]
