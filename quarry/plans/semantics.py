"""Queries of types that Spark lacks: ranges, addresses, geometry, cubes, maps, paths, trigrams, text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds as K
from .registry import query, scalars

_R = lambda a, b, **k: K.range_(F.col(a) if isinstance(a, str) else F.lit(a), F.col(b) if isinstance(b, str) else F.lit(b), **k)
_own = lambda: K.range_(F.col("p_size"), F.col("p_size") + 10)
_ten = lambda: _R(15, 30)
scalars(
    "range_types", "part", "p_partkey",
    ovl=(lambda: K.overlap(_own(), _ten()), "p_size < 30 AND 15 < p_size + 10"), bef=(lambda: K.before(_own(), _ten()), "p_size + 10 <= 15"), adj=(lambda: K.adjacent(_own(), _ten()), "p_size + 10 = 15 OR p_size = 30"), has=(lambda: K.has(_own(), F.lit(20)), "p_size <= 20 AND 20 < p_size + 10"),
    hr=(lambda: K.has_range(_ten(), _own()), "p_size >= 15 AND p_size + 10 <= 30"), emp=(lambda: K.is_empty(K.range_(F.col("p_size"), F.lit(20))), "p_size >= 20"), ilo=(lambda: K.intersection(_own(), _ten()).getField("lo"), "CASE WHEN p_size < 30 AND 15 < p_size + 10 THEN greatest(p_size, 15) END"),
    ihi=(lambda: K.intersection(_own(), _ten()).getField("hi"), "CASE WHEN p_size < 30 AND 15 < p_size + 10 THEN least(p_size + 10, 30) END"), mlo=(lambda: K.range_merge(_own(), _ten()).getField("lo"), "least(p_size, 15)"), mhi=(lambda: K.range_merge(_own(), _ten()).getField("hi"), "greatest(p_size + 10, 30)"),
    can=(lambda: K.range_(F.col("p_size"), F.lit(60), "(]", discrete=True).getField("lo"), "p_size + 1"), inf=(lambda: K.has(K.range_(F.col("p_size"), F.lit(None).cast("int")), F.lit(25)), "p_size <= 25"),
)
_IP = "('10.' || (c_custkey % 200) || '.' || (c_custkey % 250) || '.' || (c_custkey % 240 + 1) || '/20')"
_ip = lambda: F.concat(F.lit("10."), F.col("c_custkey") % 200, F.lit("."), F.col("c_custkey") % 250, F.lit("."), F.col("c_custkey") % 240 + 1, F.lit("/20"))
scalars(
    "network_types", "customer", "c_custkey",
    ho=(lambda: K.host(_ip()), f"split_part({_IP}, '/', 1)"), ml=(lambda: K.masklen(_ip()), "20"), nm=(lambda: K.netmask(_ip()), "'255.255.240.0'"), hm=(lambda: K.hostmask(_ip()), "'0.0.15.255'"),
    ne=(lambda: K.network(_ip()), "'10.' || (c_custkey % 200) || '.' || ((c_custkey % 250) & 240) || '.0/20'"), br=(lambda: K.broadcast_address(_ip()), "'10.' || (c_custkey % 200) || '.' || ((c_custkey % 250) | 15) || '.255/20'"), wi=(lambda: K.within_network(_ip(), F.lit("10.7.0.0/16")), "c_custkey % 200 = 7"),
)
_p = lambda: K.point(F.col("p_size"), F.col("p_partkey") % 10)
_o = lambda: K.point(F.lit(25), F.lit(5))
_box = lambda: K.box(_p(), K.point(F.col("p_size") + 5, F.lit(12)))
_tri = lambda: F.array(K.point(F.lit(0), F.lit(0)), K.point(F.lit(40), F.lit(0)), K.point(F.lit(0), F.lit(10)))
scalars(
    "geometry", "part", "p_partkey",
    di=(lambda: F.round(K.distance(_p(), _o()), 9), "round(sqrt(pow(p_size - 25, 2) + pow(p_partkey % 10 - 5, 2)), 9)"), ar=(lambda: K.box_area(_box()), "(5 * (12 - p_partkey % 10))::DOUBLE"), cx=(lambda: K.box_center(_box()).getField("x"), "p_size + 2.5::DOUBLE"), ov=(lambda: K.box_overlap(_box(), K.box(K.point(F.lit(20), F.lit(0)), K.point(F.lit(30), F.lit(4)))), "p_size <= 30 AND p_size + 5 >= 20 AND p_partkey % 10 <= 4"),
    ct=(lambda: K.box_contains(K.box(K.point(F.lit(0), F.lit(0)), K.point(F.lit(30), F.lit(20))), _box()), "p_size + 5 <= 30"), ca=(lambda: F.round(K.circle_area(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_size").cast("double").alias("r"))), 6), "round(pi() * p_size * p_size, 6)"), pa=(lambda: K.polygon_area(_tri()), "200.0::DOUBLE"), ip=(lambda: K.in_polygon(_tri(), K.point(F.col("p_size"), F.lit(2.5))), "p_size < 30"),
    ed=(lambda: F.round(K.earth_distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("p_size")), 4), "round(2 * 6378168.0 * asin(abs(sin(radians(p_size) / 2))), 4)"), sl=(lambda: F.round(K.slope(K.point(F.lit(0), F.lit(0)), _p()), 9), "CASE WHEN p_size = 0 THEN 1.7976931348623157e308 ELSE round((p_partkey % 10) / p_size, 9) END"),
)


@query("""SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: pow(x[1]::DOUBLE - x[2]::DOUBLE, 2)))), 7) AS euclid,
round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))), 7) AS taxi, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))), 9) AS cheb
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def cube_distances(t):
    one = [float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]]
    b = F.array(*(F.lit(x) for x in one))
    return t.embeddings.select("vec_id", F.round(K.cube_distance("embedding", b), 7).alias("euclid"), F.round(K.taxicab("embedding", b), 7).alias("taxi"), F.round(K.chebyshev("embedding", b), 9).alias("cheb"))


_h = lambda: F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.col("n_nationkey").cast("string"))
scalars(
    "key_value_maps", "nation", "n_nationkey",
    ge=(lambda: F.element_at(_h(), "a"), "n_name"), no=(lambda: F.try_element_at(_h(), F.lit("z")), "NULL::VARCHAR"), ex=(lambda: F.map_contains_key(_h(), "b"), "true"), ks=(lambda: F.array_sort(F.map_keys(_h())), "['a', 'b']"), vs=(lambda: F.map_values(_h()), "[n_name, n_nationkey::VARCHAR]"),
    co=(lambda: K.map_contains(_h(), F.create_map(F.lit("b"), F.lit("7"))), "n_nationkey = 7"), jo=(lambda: F.element_at(K.map_join(_h(), F.create_map(F.lit("a"), F.lit("new"))), "a"), "'new'"), mi=(lambda: F.size(K.map_minus(_h(), ["a"])), "1"), tx=(lambda: F.element_at(K.hstore(F.lit('a=>1, "b c"=>"x y", d=>NULL')), "a"), "'1'"),
)
_path = lambda: F.concat(F.lit("Top."), F.replace("r_name", F.lit(" "), F.lit("")), F.lit(".x.y"))
scalars(
    "label_paths", "region", "r_regionkey",
    nl=(lambda: K.nlevel(_path()), "4"), sp=(lambda: K.subpath(_path(), 1, 2), "replace(r_name, ' ', '') || '.x'"), sn=(lambda: K.subpath(_path(), -2), "'x.y'"), an=(lambda: K.is_ancestor(F.lit("Top.ASIA"), _path()), "r_name = 'ASIA'"), lq=(lambda: K.matches_path(_path(), "Top.asia@|EUROPE.*{1,2}"), "r_name IN ('ASIA', 'EUROPE')"),
    ng=(lambda: K.matches_path(_path(), "*.!ASIA.x.y"), "r_name <> 'ASIA'"), lc=(lambda: K.lca(_path(), F.lit("Top.ASIA.z")), "CASE WHEN r_name = 'ASIA' THEN 'Top.ASIA' ELSE 'Top' END"),
)


@query("""WITH g AS (SELECT DISTINCT p_partkey, unnest(list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))) AS g FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part)),
n AS (SELECT p_partkey, count(*) AS n FROM g GROUP BY 1), b AS (SELECT g FROM g WHERE p_partkey = 1),
s AS (SELECT p_partkey, count(*) AS c FROM g JOIN b USING (g) GROUP BY 1)
SELECT p_partkey, round(coalesce(c, 0) / (n + (SELECT count(*) FROM b) - coalesce(c, 0)), 9) AS sim FROM n LEFT JOIN s USING (p_partkey)""")
def trigram_similarity(t):
    one = t.part.where("p_partkey = 1").first()["p_name"]
    return t.part.select("p_partkey", F.round(K.similarity(K.trigrams("p_name"), K.trigrams(F.lit(one))), 9).alias("sim"))


scalars(
    "fuzzy_strings", "customer", "c_custkey",
    le=(lambda: F.levenshtein("c_name", F.lit("Customer#7")).cast("long"), "levenshtein(c_name, 'Customer#7')"), lt=(lambda: F.levenshtein("c_name", F.lit("Customer#7"), 3).cast("long"), "CASE WHEN levenshtein(c_name, 'Customer#7') <= 3 THEN levenshtein(c_name, 'Customer#7') ELSE -1 END"), sx=(lambda: F.soundex(F.lit("Robert")), "'R163'"),
)


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') AND NOT regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of([^\\p{L}\\p{N}]|$)') AS hit, regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)') AS phrase FROM documents")
def text_search(t):
    d = t.documents.select("doc_id", K.to_tsvector("text").alias("v"))
    return d.select("doc_id", K.ts_match("v", "the & !of").alias("hit"), K.ts_match("v", "of <-> the").alias("phrase"))


@query("""SELECT word, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents) GROUP BY word""")
def text_statistics(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    per = t.documents.select("doc_id", F.explode(words).alias("word")).groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.count("*").alias("ndoc"), F.sum("n").alias("nentry"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def case_insensitive(t):
    return t.customer.where(F.collate("c_mktsegment", "UTF8_LCASE") == F.lit("Building")).select("c_custkey")
