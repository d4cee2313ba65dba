"""Queries on odd and larger values against their SQL: what the findings of round 3 are about."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_findings_r02 import same

from quarry.plans.registry import ORACLE_SQL, QUERIES


def lines(quantity, price, discount, tax):
    n = len(tax)
    keys = {k: pa.array(range(n), pa.int64()) for k in ("l_orderkey", "l_partkey", "l_suppkey")}
    numbers = {"l_quantity": quantity, "l_extendedprice": price, "l_discount": discount, "l_tax": tax}
    return keys | {"l_linenumber": pa.array(range(n), pa.int32())} | {k: pa.array(v, pa.float64()) for k, v in numbers.items()} | {"l_returnflag": ["N"] * n, "l_linestatus": ["O"] * n}


def test_checked_numbers_where_arcs_differ_in_the_last_bit(spark, tmp_path):
    tax = [0.06762721175979829, 0.07769780915194763, 0.07894033146185864]
    same(spark, tmp_path, "fn_checked_numbers", lineitem=lines([1.0] * 3, [1.0] * 3, [0.05] * 3, tax))


def test_checked_numbers_with_signed_zeros(spark, tmp_path):
    small = [-0.0, 0.0, -1e-14, 1e-14, -0.1, None]
    same(spark, tmp_path, "fn_checked_numbers", lineitem=lines([-0.0001, -1.0, 1.0, 2.0, 1.0, 4.0], small, small, small))


def test_checked_numbers_without_end(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    quantity = [0.0, -0.0, 0.0, 0.0, 1e-300, 1e300, inf, nan, None]
    price = [1.0, 1.0, -1.0, 0.0, 1e300, 5.0, inf, 1.0, 1.0]
    same(spark, tmp_path, "fn_checked_numbers", lineitem=lines(quantity, price, [1e300, inf, -inf, nan, 1.0, -1.0, 2.0, 0.5, -0.5], [0.2, -0.2, 0.1, -0.1, 0.3, inf, nan, 1.0, -1.0]))


def suppliers(*keys):
    return {"s_suppkey": pa.array(keys, pa.int64()), "s_name": [f"Supplier#{k}" for k in keys], "s_nationkey": pa.array([1] * len(keys), pa.int32())}


def test_characters_of_all_code_points(spark, tmp_path):
    """The first, the last before the surrogates, the first after them and the last, as near as the keys come."""
    same(spark, tmp_path, "fn_string_building", supplier=suppliers(-5, 0, 1489, 1545, 30_105))


@pytest.mark.parametrize("key", [1_490, 1_544, 30_106, 115_126, -6])
def test_no_character_is_an_error_of_query_and_sql(spark, tmp_path, key):
    """Surrogates, beyond the last code point, where once another character came of it, and below the first."""
    pq.write_table(pa.table(suppliers(key)), f"{tmp_path}/supplier.parquet")
    code = key * 37 + 200
    with pytest.raises(duckdb.InvalidInputException, match=f"Codepoint {code}$"):
        c = duckdb.connect()
        c.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
        c.sql(ORACLE_SQL["fn_string_building"]).fetchall()
    with pytest.raises(Exception, match=f"not valid for encoding: {code}\\b"):
        QUERIES["fn_string_building"](spark, str(tmp_path)).collect()
