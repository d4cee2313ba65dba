"""JSON as text: access, iteration, records, construction and aggregates by Spark's variants; changes within a document by an Arrow UDF."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c

# Access. A JSON null is the text null, or null where text is asked for.


def _path(*keys) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def _items(v: Column) -> Column:
    """A variant's elements; null where it is no array."""
    return F.try_variant_get(v, "$", "array<variant>")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_valid(j) -> Column:
    """Whether a text is JSON, as its input check decides."""
    # In brackets, so that nothing may follow the value.
    found = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), _c(j), F.lit("]"))), "$", "array<variant>")
    return F.when(_c(j).isNotNull(), F.coalesce(F.size(found) == 1, F.lit(False)))


def get(j, key) -> Column:
    """j -> key or number from 0, a negative one from the end; null where there is none."""
    v = F.parse_json(_c(j))
    if isinstance(key, int):
        items = _items(v)
        return F.to_json(F.get(items, F.lit(key) if key >= 0 else F.size(items) + key))
    return F.to_json(F.try_variant_get(v, _path(key), "variant"))


def get_text(j, key) -> Column:
    """j ->> key or number."""
    found = F.try_parse_json(get(j, key))
    return F.when(~F.is_variant_null(found), F.coalesce(F.try_variant_get(found, "$", "string"), F.to_json(found)))


def path(j, *keys) -> Column:
    """j #> keys; numbers are array places, negative ones from the end."""
    out = _c(j)
    for k in keys:
        out = get(out, k)
    return out


def path_text(j, *keys) -> Column:
    """j #>> keys."""
    return get_text(path(j, *keys[:-1]), keys[-1])


def elements(j) -> Column:
    """json_array_elements as an array of JSON texts, for explode; an error where j is no array."""
    return F.transform(F.parse_json(_c(j)).cast("array<variant>"), lambda v: F.to_json(v))


def elements_text(j) -> Column:
    return F.transform(F.parse_json(_c(j)).cast("array<variant>"), lambda v: F.when(~F.is_variant_null(v), v.cast("string")))


def each(j) -> Column:
    """json_each as an array of (key, value), for inline; keys in order."""
    return F.transform(F.map_entries(F.parse_json(_c(j)).cast("map<string,variant>")), lambda e: F.struct(e.key.alias("key"), F.to_json(e.value).alias("value")))


def each_text(j) -> Column:
    return F.transform(
        F.map_entries(F.parse_json(_c(j)).cast("map<string,variant>")),
        lambda e: F.struct(e.key.alias("key"), F.when(~F.is_variant_null(e.value), e.value.cast("string")).alias("value")),
    )


def keys(j) -> Column:
    """json_object_keys, for explode; in order."""
    return F.map_keys(F.parse_json(_c(j)).cast("map<string,variant>"))


def array_length(j) -> Column:
    return F.size(F.parse_json(_c(j)).cast("array<variant>"))


# Records


def to_record(j, schema: str) -> Column:
    """json_to_record and json_populate_record: a struct of the DDL's fields; missing ones are null, others left out."""
    return F.from_json(_c(j), schema)


def to_recordset(j, schema: str) -> Column:
    """json_to_recordset and json_populate_recordset: an array of structs, for inline."""
    return F.from_json(_c(j), f"array<struct<{', '.join(f'{n}: {k}' for n, k in (x.split() for x in schema.split(',')))}>>")


def populate(j, base: Column, schema: str) -> Column:
    """json_populate_record over a base row: fields that j lacks keep the base's values."""
    names = [x.split()[0] for x in schema.split(",")]
    new, there = to_record(j, schema), keys(j)
    return F.struct(*(F.when(F.array_contains(there, n), new.getField(n)).otherwise(base.getField(n)).alias(n) for n in names))


# Construction


def of(x) -> Column:
    """to_json: any value as JSON; text becomes a string."""
    return F.regexp_extract(F.to_json(F.array(_c(x)), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)


def of_row(**fields) -> Column:
    """row_to_json and json_build_object: the fields in their order, nulls too."""
    return F.to_json(F.struct(*(_c(x).alias(k) for k, x in fields.items())), {"ignoreNullFields": "false"})


def of_array(a) -> Column:
    """array_to_json."""
    return F.to_json(_c(a), {"ignoreNullFields": "false"})


def build_array(*xs) -> Column:
    """json_build_array of values of any types."""
    return F.concat(F.lit("["), F.concat_ws(",", *(of(x) for x in xs)), F.lit("]"))


def object_of(names, values=None) -> Column:
    """json_object: of one array of alternating names and values, or of two arrays; values are strings or null."""
    a = _c(names)
    if values is None:
        at = F.sequence(F.lit(0), F.size(a) - 2, F.lit(2))
        m = F.map_from_arrays(F.transform(at, lambda i: F.get(a, i)), F.transform(at, lambda i: F.get(a, i + 1)))
        return F.when(F.size(a) == 0, "{}").otherwise(F.to_json(m))
    return F.to_json(F.map_from_arrays(a, _c(values)))


def raw(j) -> Column:
    """JSON text as a part of what is built around it, not as a string."""
    return F.parse_json(_c(j))


# Aggregates


def agg(x, *order) -> Column:
    """json_agg: the group's values with nulls, in the order of the columns."""
    rows = F.collect_list(F.struct(*(F.struct(_c(o).isNull().alias("n"), _c(o).alias("o")).alias(f"o{i}") for i, o in enumerate(order)), of(x).alias("x")))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(rows) if order else rows, lambda r: r.x), ","), F.lit("]"))


def object_agg(k, x) -> Column:
    """jsonb_object_agg: one member for each key, in the keys' order; the largest text of a key's values wins."""
    rows = F.array_sort(F.collect_list(F.struct(_c(k).cast("string").alias("k"), of(x).alias("x"))))
    last = F.filter(rows, lambda r, i: ~F.coalesce(F.get(rows, i + 1).k == r.k, F.lit(False)))
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda r: F.concat(of(r.k), F.lit(":"), r.x)), ","), F.lit("}"))


# Operators of jsonb


def has_key(j, key: str) -> Column:
    """j ? key: a key of an object, or a string of an array."""
    v = F.parse_json(_c(j))
    member = F.map_contains_key(_members(v), F.lit(key))
    element = F.exists(_items(v), lambda x: F.coalesce(F.to_json(x) == F.to_json(F.parse_json(F.lit(json.dumps(key)))), F.lit(False)))
    return F.coalesce(member, element, F.lit(False))


def has_any(j, names: list[str]) -> Column:
    """j ?| names."""
    out = F.lit(False)
    for k in names:
        out = out | has_key(j, k)
    return out


def has_all(j, names: list[str]) -> Column:
    """j ?& names."""
    out = F.lit(True)
    for k in names:
        out = out & has_key(j, k)
    return out


def minus(j, key) -> Column:
    """j - key or number: an object without the member, an array without the string or place."""
    v = F.parse_json(_c(j))
    items = _items(v)
    if isinstance(key, int):
        at = F.lit(key) if key >= 0 else F.size(items) + key
        return F.to_json(F.filter(items, lambda x, i: i != at))
    text = F.to_json(F.parse_json(F.lit(json.dumps(key))))
    return F.coalesce(F.to_json(F.map_filter(_members(v), lambda k, x: k != key)), F.to_json(F.filter(items, lambda x: F.to_json(x) != text)))


def join(a, b) -> Column:
    """a || b: members of two objects, where b's win, else elements one after another."""
    x, y = F.parse_json(_c(a)), F.parse_json(_c(b))
    m, n = _members(x), _members(y)
    both = F.map_from_entries(F.concat(F.filter(F.map_entries(m), lambda e: ~F.map_contains_key(n, e.key)), F.map_entries(n)))
    return F.coalesce(F.to_json(F.parse_json(F.to_json(both))), F.to_json(F.concat(F.coalesce(_items(x), F.array(x)), F.coalesce(_items(y), F.array(y)))))


def equal(a, b) -> Column:
    """a = b of jsonb: members in any order, numbers by value."""
    return F.to_json(F.parse_json(_c(a))) == F.to_json(F.parse_json(_c(b)))


def load(text: str):
    return json.loads(text, parse_float=Decimal)


def dump(x, indent: int | None = None, level: int = 0) -> str:
    """Compact text, or indented; keys in the order of jsonb: short ones first, then by bytes."""
    if isinstance(x, dict):
        kv = sorted(x.items(), key=lambda e: (len(e[0].encode()), e[0].encode()))
        parts = [f"{json.dumps(k, ensure_ascii=False)}: {dump(v, indent, level + 1)}" for k, v in kv]
        opened, closed = "{", "}"
    elif isinstance(x, list):
        parts, opened, closed = [dump(v, indent, level + 1) for v in x], "[", "]"
    else:
        return format(x, "f") if isinstance(x, Decimal) else json.dumps(x, ensure_ascii=False)
    if indent is None or not parts:
        return opened + ", ".join(parts) + closed
    pad = "\n" + " " * indent * (level + 1)
    return opened + pad + f",{pad}".join(parts) + "\n" + " " * indent * level + closed


def _within(x, y, top: bool = True) -> bool:
    """x @> y."""
    if isinstance(y, dict):
        return isinstance(x, dict) and all(k in x and _within(x[k], v, False) for k, v in y.items())
    if isinstance(y, list):
        return isinstance(x, list) and all(any(_within(a, b, False) for a in x) for b in y)
    if isinstance(x, list) and top:  # an array holds a bare value of its own
        return any(_same(a, y) for a in x)
    return not isinstance(x, (dict, list)) and _same(x, y)


def _same(a, b) -> bool:
    return (isinstance(a, bool) == isinstance(b, bool)) and not isinstance(a, (dict, list)) and a == b


def _stripped(x):
    if isinstance(x, dict):
        return {k: _stripped(v) for k, v in x.items() if v is not None}
    return [_stripped(v) for v in x] if isinstance(x, list) else x


def _at(x: list, key: str) -> int:
    n = int(key)
    return n if n >= 0 else n + len(x)


def _put(x, where: list[str], new, create: bool, insert: bool, after: bool):
    if not where:
        return x
    key, rest = where[0], where[1:]
    if isinstance(x, dict):
        if rest:
            return x | {key: _put(x[key], rest, new, create, insert, after)} if key in x else x
        if insert and key in x:
            raise ValueError("cannot replace existing key")
        return x | {key: new} if create or key in x else x
    if isinstance(x, list):
        i = _at(x, key)
        if rest:
            return [*x[:i], _put(x[i], rest, new, create, insert, after), *x[i + 1 :]] if 0 <= i < len(x) else x
        if insert:
            i = min(max(i + after, 0), len(x))
            return [*x[:i], new, *x[i:]]
        if 0 <= i < len(x):
            return [*x[:i], new, *x[i + 1 :]]
        return ([new, *x] if i < 0 else [*x, new]) if create else x
    return x


def _without(x, where: list[str]):
    key, rest = where[0], where[1:]
    if isinstance(x, dict) and key in x:
        return x | {key: _without(x[key], rest)} if rest else {k: v for k, v in x.items() if k != key}
    if isinstance(x, list) and 0 <= (i := _at(x, key)) < len(x):
        return [*x[:i], _without(x[i], rest), *x[i + 1 :]] if rest else [*x[:i], *x[i + 1 :]]
    return x


def _changed(f, *columns, returns: str = "string") -> Column:
    """f of the parsed columns, in Arrow batches; null where one is null."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else f(*map(load, row)) for row in zip(*series, strict=True)], dtype=object)

    return F.pandas_udf(run, returns)(*map(_c, columns))


def contains(a, b) -> Column:
    """a @> b, at any depth."""
    return _changed(_within, a, b, returns="boolean")


def strip_nulls(j) -> Column:
    """j without members that are null, at any depth; elements of arrays stay."""
    return _changed(lambda x: dump(_stripped(x)), j)


def set_path(j, where: list[str], new, create: bool = True) -> Column:
    """jsonb_set."""
    return _changed(lambda x, y: dump(_put(x, where, y, create, False, False)), j, new)


def insert_path(j, where: list[str], new, after: bool = False) -> Column:
    """jsonb_insert; an error where an object has the key."""
    return _changed(lambda x, y: dump(_put(x, where, y, True, True, after)), j, new)


def minus_path(j, where: list[str]) -> Column:
    """j #- where."""
    return _changed(lambda x: dump(_without(x, where)), j)


def pretty(j) -> Column:
    """jsonb_pretty: four blanks a level."""
    return _changed(lambda x: dump(x, 4), j)


def normal(j) -> Column:
    """The text of jsonb: the last of equal keys, keys in order."""
    return _changed(dump, j)
