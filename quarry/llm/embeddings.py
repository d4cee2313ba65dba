"""Embedding near-duplicates: sign hashes of random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, rejoined, slices, table, trimming, written

#: PLANES is the least number of planes of a table; RECALL the chance that a pair at the bound meets in one table or more.
COSINE, PLANES, RECALL, SEED = 0.98, 14, 0.9999, 20260
#: Vectors of a bucket that are compared at once, beyond which it is compared block by block; rows that Python gets at once.
BLOCK, CELL = 1024, 4096
EDGES = "kind int, a long, b long, n long"


def shape(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(planes, tables) for n vectors of a label: planes such that an even bucket has at most a few, and the tables that the recall needs.

    A plane parts two vectors with the chance of their angle over pi, so a table of k planes joins a pair at the bound with
    (1 - angle / pi) ** k, and the number of tables grows only with a small power of n.
    """
    planes = min(max(PLANES, math.ceil(math.log2(max(n, 1) / 4))), 30)
    meet = (1 - math.acos(cosine) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def signatures(vectors: np.ndarray, planes: int, tables: int, seed: int) -> np.ndarray:
    """A row of tables numbers for each unit vector: the signs of its products with planes random normals each."""
    normals = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], planes * tables))
    signs = (vectors @ normals > 0).reshape(len(vectors), tables, planes)
    return signs @ (1 << np.arange(planes, dtype=np.int64))


def unit(values: list) -> np.ndarray | None:
    """The unit vector in double precision; None where it is null, empty, zero or holds what isn't finite."""
    if not values or any(x is None for x in values):
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        return None
    most = np.abs(v).max()
    if not most:
        return None
    v = v / most
    return v / np.sqrt(v @ v)


def hashed(vectors: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    """(id, copies, label, vec, sig) of the vectors that can be linked, from (id, copies, label, vec). Floats stay floats, all else is double."""
    single = isinstance(vectors.schema["vec"].dataType.elementType, T.FloatType)
    own = vectors.where("label IS NOT NULL").select("id", "copies", "label", F.col("vec").cast("array<float>" if single else "array<double>").alias("vec"))
    out = T.StructType([*own.schema, T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def mapped(batches):
        for batch in slices(batches, 4096):
            units = [unit(x) for x in batch.column(3).to_pylist()]
            found: list = [None] * len(units)
            for size in {len(u) for u in units if u is not None}:
                at = [i for i, u in enumerate(units) if u is not None and len(u) == size]
                for i, s in zip(at, signatures(np.stack([units[i] for i in at]), planes, tables, seed).tolist(), strict=True):
                    found[i] = s
            kept = batch.take(pa.array([i for i, u in enumerate(units) if u is not None], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for x in found if x is not None], pa.list_(pa.int32()))], names=out.fieldNames())

    return own.mapInArrow(trimming(mapped), out)


def units_of(body: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; the same numbers whatever rows stand beside."""
    body = body.astype(np.float64)
    body /= np.abs(body).max(1, keepdims=True)
    return body / np.sqrt(np.einsum("ij,ij->i", body, body))[:, None]


def compared(left: tuple, right: tuple, same: bool, here: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs with that cosine that meet in table here first. left and right: (vectors, signatures)."""
    products = left[0] @ right[0].T
    i, j = np.nonzero(products >= cosine - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    # The same sum for a pair whatever block it falls in.
    exact = np.einsum("ij,ij->i", left[0][i], right[0][j]) >= cosine
    i, j = i[exact], j[exact]
    if here:
        new = ~(left[1][i, :here] == right[1][j, :here]).any(axis=1)
        i, j = i[new], j[new]
    return i, j


def linked(vectors: DataFrame, cosine: float = COSINE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """((u, v) that connect all linked classes, (id, n_links) of each linked class's representative) from (id, label, vec, copies).

    Vectors of a label that share a table's hash are a bucket. Its members are dealt to blocks of about BLOCK; each pair of
    blocks stands in one cell, so a bucket of any size is compared whole in bounded tasks and no pair leaves its cell: what leaves
    are sums of links and, for each vector, one link to the smallest id that it meets there. A pair counts in the first
    table where it meets. n_links counts the copies of linked classes. Planes and tables follow from the largest label.
    """
    most = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    planes, tables = shape(most, cosine)
    rows = written(hashed(vectors, planes, tables, seed), "signatures")
    placed = rows.select("id", "label", F.posexplode("sig").alias("here", "hash"))
    sizes = placed.groupBy("label", "here", "hash").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("label", "here", "hash", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = written(sizes.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    cells = (sizes.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // CELL + 1
    met = placed.join(sizes.drop("n"), ["label", "here", "hash"])
    met = met.withColumn("block", F.pmod(F.xxhash64("id", "here"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("block", x).alias("lo"), F.greatest("block", x).alias("hi")))
    met = met.select("id", "here", "bucket", "block", F.explode(pairs).alias("x")).join(rows.select("id", "vec", "sig", "copies"), "id")
    met = met.select("id", "here", "bucket", "block", "x.lo", "x.hi", "vec", "sig", "copies")
    met = met.withColumn("cell", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(cells)))

    def compare(t):
        names = ("bucket", "lo", "hi", "id", "here", "block", "copies")
        order = np.lexsort([t.column(c).to_numpy() for c in ("id", "hi", "lo", "bucket")])
        bucket, lo, hi, ids, here, block, copies = (t.column(c).to_numpy()[order] for c in names)
        lists = [t.column(c).combine_chunks().take(pa.array(order)) for c in ("vec", "sig")]
        vec, sig = (x.flatten().to_numpy() for x in lists)
        starts = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy())))
        sig = sig.reshape(len(ids), -1)
        new = (np.diff(bucket) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
        bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(ids)]))
        counted, linked_ = [], []
        for first, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            lengths = np.diff(starts[first : stop + 1])
            for size in np.unique(lengths).tolist():
                at = first + np.flatnonzero(lengths == size)
                body = units_of(vec[starts[at][:, None] + np.arange(size)])
                one, two = np.flatnonzero(block[at] == lo[first]), np.flatnonzero(block[at] == hi[first])
                i, j = compared((body[one], sig[at[one]]), (body[two], sig[at[two]]), lo[first] == hi[first], int(here[first]), cosine)
                if not len(i):
                    continue
                x, y = one[i], two[j]
                n = np.bincount(x, copies[at[y]], len(at)) + np.bincount(y, copies[at[x]], len(at))
                some = np.flatnonzero(n)
                counted.append((ids[at[some]], n[some].astype(np.int64)))
                # A spanning forest of the links found here, so that a bucket sends on fewer edges than it has members.
                linked_ += [(int(ids[at[u]]), int(ids[at[v]])) for u, v in forest(x, y, len(at))]
        a = np.concatenate([c[0] for c in counted]) if counted else np.zeros(0, np.int64)
        n = np.concatenate([c[1] for c in counted]) if counted else np.zeros(0, np.int64)
        # A cell's sums of an id meet before they are sent on.
        a, place = np.unique(a, return_inverse=True)
        n = np.bincount(place, n, len(a)).astype(np.int64) if len(a) else n
        linked_ = sorted(set(linked_))
        kinds = np.concatenate((np.zeros(len(a), np.int32), np.ones(len(linked_), np.int32)))
        u = np.concatenate((a, np.array([x[0] for x in linked_], np.int64)))
        v = np.concatenate((a, np.array([x[1] for x in linked_], np.int64)))
        return pa.table({"kind": pa.array(kinds), "a": pa.array(u), "b": pa.array(v), "n": pa.array(np.concatenate((n, np.zeros(len(linked_), np.int64))))})

    found = written(met.groupBy("cell").applyInArrow(compare, EDGES), "links")
    edges = found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return edges, found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))


def forest(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(root, member) of each member of the components that links x-y make among n; the root is the smallest."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        label = label[label]
        if (label == before).all() and (label[x] == label[y]).all():
            break
    members = np.flatnonzero(label != np.arange(n))
    return list(zip(label[members].tolist(), members.tolist(), strict=True))


def grouped(vectors: DataFrame, vec_id: str, embedding: str, label: str, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) of each row: links to other vectors of an equal label with at least that cosine.

    A vector that is null, empty, zero or holds null, NaN or infinity, or whose label is null, links with nothing. Vectors
    of different lengths never link. Equal vectors of a label are linked with each other and stand as one class until the
    end. Each row is a vector of its own, whatever its vec_id: repeated rows link with each other, and rows that share a
    vec_id and differ are judged apart. A null vec_id takes part, but is no component's id; a component without any other
    has null. An empty table gives no rows; other columns aren't read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("vec"))
    # Equal vectors are found by a 128-bit hash of their components; what can't link has no class.
    finite = F.expr("size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(vec, x -> x <> 0)")
    digest = F.concat(F.xxhash64("vec").cast("string"), F.lit(":"), F.md5(F.to_json(F.struct("vec"))))
    rows = rows.withColumn("class", F.when(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)), digest))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("class IS NOT NULL").groupBy("label", "class").agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    # One row of each class, by the row's number.
    linkable = written(rows.join(classes.select(F.col("id").alias("row"), "id", "copies"), "row").select("id", "label", "vec", "copies"), "linkable")
    edges, n_links = linked(linkable, cosine)
    parts = connected_components(edges).withColumnRenamed("node", "id")
    of = classes.join(n_links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    roots = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of = of.join(roots, "component").select("label", "class", "copies", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    found = rejoined(rows.where("class IS NOT NULL").drop("vec", "row"), written(of, "groups"), ["label", "class"]).select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = rows.where("class IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; see grouped for nulls and what links with nothing."""
    out = grouped(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT x, l.v FROM r JOIN l ON r.y = l.u),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = x LEFT JOIN n ON vec_id = u
"""
