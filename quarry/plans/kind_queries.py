"""Queries of full-text search, geometry, addresses, identifiers and the smaller extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contrib as C
from ..functions import geometry as G
from ..functions import kinds as K
from ..functions import search as T
from .registry import query, scalars

_p = lambda: K.point(F.col("p_size"), F.col("p_partkey") % 10)
_X, _Y = "p_size", "(p_partkey % 10)"
_at = lambda x, y: K.point(F.lit(float(x)), F.lit(float(y)))
_s = lambda: G.segment(_p(), K.point(F.col("p_size") + 4, F.col("p_partkey") % 10 + 3))
_r = lambda c, n=6: F.round(c, n)
scalars(
    "geometry_points", "part", "p_partkey",
    le=(lambda: G.left(_p(), _at(25, 0)), f"{_X} < 25"), ab=(lambda: G.above(_p(), _at(0, 4)), f"{_Y} > 4"), ve=(lambda: G.vertical(_p(), _at(7, 1)), f"{_X} = 7"), ho=(lambda: G.horizontal(_p(), _at(7, 1)), f"{_Y} = 1"), sa=(lambda: G.same(_p(), _at(7, 1)), f"{_X} = 7 AND {_Y} = 1"),
    ad=(lambda: G.add(_p(), _at(1, 2)).getField("y"), f"({_Y} + 2)::DOUBLE"), su=(lambda: G.subtract(_p(), _at(1, 2)).getField("x"), f"({_X} - 1)::DOUBLE"), mu=(lambda: G.multiply(_p(), _at(1, 2)).getField("x"), f"({_X} - 2 * {_Y})::DOUBLE"), di=(lambda: _r(G.divide(_p(), _at(1, 2)).getField("y")), f"round(({_Y} - 2 * {_X}) / 5, 6)"),
)
scalars(
    "geometry_segments", "part", "p_partkey",
    le=(lambda: G.segment_length(_s()), "5.0::DOUBLE + p_size * 0"), ce=(lambda: G.segment_center(_s()).getField("x"), f"{_X} + 2.0::DOUBLE"), pa=(lambda: G.parallel(_s(), G.segment(_at(0, 0), K.point(F.lit(4), F.col("p_size") % 5))), f"{_X} % 5 = 3"), pe=(lambda: G.perpendicular(_s(), G.segment(_at(0, 0), K.point(F.lit(-3), F.col("p_size") % 5))), f"{_X} % 5 = 4"),
    it=(lambda: G.intersect(G.segment(_p(), K.point(F.col("p_size"), F.lit(20.0))), G.segment(_at(10, 5), _at(30, 5))), f"{_X} BETWEEN 10 AND 30 AND {_Y} <= 5"), on=(lambda: G.on_segment(_p(), G.segment(_at(0, 3), _at(20, 3))), f"{_X} <= 20 AND {_Y} = 3"), cl=(lambda: G.closest_on_segment(_p(), G.segment(_at(10, 0), _at(20, 0))).getField("x"), f"least(greatest({_X}, 10), 20)::DOUBLE"),
    di=(lambda: _r(G.point_segment_distance(_p(), G.segment(_at(10, 0), _at(20, 0)))), f"round(sqrt(pow({_X} - least(greatest({_X}, 10), 20), 2) + pow({_Y}, 2)), 6)"), sd=(lambda: G.segment_distance(G.segment(_p(), K.point(F.col("p_size"), F.lit(20.0))), G.segment(_at(10, -2), _at(100, -2))), f"CASE WHEN {_X} >= 10 THEN {_Y} + 2.0 ELSE round(sqrt(pow(10 - {_X}, 2) + pow({_Y} + 2, 2)), 15) END::DOUBLE"),
)
_l = lambda: G.line(_p(), K.point(F.col("p_size") + 2, F.col("p_partkey") % 10 + 2))  # noqa: E731  slope 1
scalars(
    "geometry_lines", "part", "p_partkey",
    c=(lambda: _l().getField("c"), f"({_Y} - {_X})::DOUBLE"), pa=(lambda: G.lines_parallel(_l(), G.line(_at(0, 0), K.point(F.lit(2), F.col("p_size") % 4))), f"{_X} % 4 = 2"), pe=(lambda: G.lines_perpendicular(_l(), G.line(_at(0, 0), K.point(F.lit(-2), F.col("p_size") % 4))), f"{_X} % 4 = 2"), mx=(lambda: G.lines_meet(_l(), G.line(_at(0, 5), _at(1, 5))).getField("x"), f"(5 - {_Y} + {_X})::DOUBLE"),
    di=(lambda: _r(G.point_line_distance(_at(0, 0), _l())), f"round(abs({_Y} - {_X}) / sqrt(2), 6)"), ld=(lambda: _r(G.lines_distance(_l(), G.line(_at(0, 0), _at(1, 1)))), f"round(abs({_Y} - {_X}) / sqrt(2), 6)"), on=(lambda: G.on_line(_at(3, 3), _l()), f"{_X} = {_Y}"), so=(lambda: G.segment_on_line(G.segment(_at(3, 3), _at(4, 4)), _l()), f"{_X} = {_Y}"), sl=(lambda: _r(G.segment_line_distance(G.segment(_p(), K.point(F.col("p_size"), F.lit(20.0))), G.line(_at(0, 5), _at(1, 5)))), f"greatest({_Y} - 5, 0)::DOUBLE"),
    ve=(lambda: G.line(_p(), K.point(F.col("p_size"), F.lit(50.0))).getField("c"), f"{_X}::DOUBLE"),
)
_b = lambda: K.box(_p(), K.point(F.col("p_size") + 5, F.lit(12)))
_o = lambda: K.box(_at(20, 2), _at(30, 8))
scalars(
    "geometry_boxes", "part", "p_partkey",
    w=(lambda: G.box_width(_b()) + F.col("p_size"), f"{_X} + 5.0::DOUBLE"), h=(lambda: G.box_height(_b()), f"(12 - {_Y})::DOUBLE"), le=(lambda: G.box_left(_b(), _o()), f"{_X} + 5 < 20"), ri=(lambda: G.box_right(_b(), _o()), f"{_X} > 30"), ab=(lambda: G.box_above(_b(), _o()), f"{_Y} > 8"), be=(lambda: G.box_below(_o(), _b()), f"8 < {_Y}"), mv=(lambda: G.box_moved(_b(), _at(1, 1)).getField("x2"), f"{_X} + 1.0::DOUBLE"),
    it=(lambda: K.box_area(G.box_inter(_b(), _o())), f"CASE WHEN {_X} <= 30 AND {_X} + 5 >= 20 AND {_Y} <= 8 THEN (least({_X} + 5, 30) - greatest({_X}, 20)) * (8 - greatest({_Y}, 2)) END::DOUBLE"), inb=(lambda: G.in_box(_p(), _o()), f"{_X} BETWEEN 20 AND 30 AND {_Y} BETWEEN 2 AND 8"), sin=(lambda: G.segment_in_box(_s(), _o()), f"{_X} BETWEEN 20 AND 26 AND {_Y} BETWEEN 2 AND 5"),
    di=(lambda: _r(G.point_box_distance(_p(), _o())), f"round(sqrt(pow(greatest(20 - {_X}, {_X} - 30, 0), 2) + pow(greatest(2 - {_Y}, {_Y} - 8, 0), 2)), 6)"), cd=(lambda: _r(G.box_distance(_b(), _o())), f"round(sqrt(pow({_X} + 2.5 - 25, 2) + pow((12 + {_Y}) / 2 - 5, 2)), 6)"),
    ci=(lambda: _r(G.box_circle(_b()).getField("r")), f"round(sqrt(25 + pow(12 - {_Y}, 2)) / 2, 6)"), po=(lambda: K.polygon_area(G.box_polygon(_b())), f"(5 * (12 - {_Y}))::DOUBLE"), dg=(lambda: _r(G.segment_length(G.box_diagonal(_b()))), f"round(sqrt(25 + pow(12 - {_Y}, 2)), 6)"),
)
_sq = lambda x=0.0: F.array(K.point(F.col("p_size") + x, F.lit(0.0)), K.point(F.col("p_size") + x + 10, F.lit(0.0)), K.point(F.col("p_size") + x + 10, F.lit(10.0)), K.point(F.col("p_size") + x, F.lit(10.0)))
_fix = lambda x, y, d: F.array(_at(x, y), _at(x + d, y), _at(x + d, y + d), _at(x, y + d))
scalars(
    "geometry_paths", "part", "p_partkey",
    n=(lambda: G.npoints(G.path(_sq())) + F.col("p_size"), f"{_X} + 4"), ol=(lambda: G.path_length(G.path(_sq())) + F.col("p_size"), f"{_X} + 30.0::DOUBLE"), cl=(lambda: G.path_length(G.pclose(G.path(_sq()))) + F.col("p_size"), f"{_X} + 40.0::DOUBLE"), ar=(lambda: G.path_area(G.path(_sq(), True)) + F.col("p_size"), f"{_X} + 100.0::DOUBLE"), oa=(lambda: G.path_area(G.popen(G.path(_sq(), True))).isNull(), "p_size IS NOT NULL"),
    jo=(lambda: G.npoints(G.path_joined(G.path(_sq()), G.path(_sq(1.0)))) + F.col("p_size"), f"{_X} + 8"), mv=(lambda: F.get(G.path_moved(G.path(_sq()), _at(3, 4)).getField("points"), F.lit(0)).getField("y") + F.col("p_size"), f"{_X} + 4.0::DOUBLE"), me=(lambda: G.paths_meet(G.path(_sq(), True), G.path(F.array(_at(-50, 5), _at(15, 5)))), f"{_X} <= 15"),
    di=(lambda: G.path_distance(G.path(_sq(), True), G.path(F.array(_at(-5, 5), _at(0, 5)))), f"{_X}::DOUBLE"), pd=(lambda: G.point_path_distance(_at(0, 5), G.path(_sq(), True)), f"{_X}::DOUBLE"), on=(lambda: G.on_path(_at(20, 0), G.path(_sq())), f"{_X} BETWEEN 10 AND 20"), inn=(lambda: G.on_path(_at(20, 5), G.path(_sq(), True)), f"{_X} BETWEEN 10 AND 20"),
)
scalars(
    "geometry_polygons", "part", "p_partkey",
    ov=(lambda: G.polygon_overlap(_sq(), _fix(20, 2, 4)), f"{_X} + 10 >= 20 AND {_X} <= 24"), co=(lambda: G.polygon_contains(_sq(), _fix(20, 2, 4)), f"{_X} <= 20 AND {_X} + 10 >= 24"), le=(lambda: G.polygon_left(_sq(), _fix(30, 0, 5)), f"{_X} + 10 < 30"), ri=(lambda: G.polygon_right(_sq(), _fix(30, 0, 5)), f"{_X} > 35"), ce=(lambda: G.polygon_center(_sq()).getField("x"), f"{_X} + 5.0::DOUBLE"), bx=(lambda: G.polygon_box(_sq()).getField("x1"), f"{_X} + 10.0::DOUBLE"),
    di=(lambda: G.polygon_distance(_sq(), _fix(100, 0, 5)), f"(100 - {_X} - 10)::DOUBLE"), pa=(lambda: K.polygon_area(G.path_polygon(G.polygon_path(_sq()))) + F.col("p_size"), f"{_X} + 100.0::DOUBLE"), ci=(lambda: _r(G.polygon_circle(_sq()).getField("r") + F.col("p_size")), f"round({_X} + sqrt(50), 6)"), np=(lambda: F.size(_sq()) + F.col("p_size"), f"{_X} + 4"),
)
_c = lambda: G.circle(_p(), F.lit(5.0))
scalars(
    "geometry_circles", "part", "p_partkey",
    dm=(lambda: G.diameter(_c()) + F.col("p_size"), f"{_X} + 10.0::DOUBLE"), inc=(lambda: G.in_circle(_at(20, 5), _c()), f"pow({_X} - 20, 2) + pow({_Y} - 5, 2) <= 25"), co=(lambda: G.circle_contains(G.circle(_at(20, 5), F.lit(15.0)), _c()), f"pow({_X} - 20, 2) + pow({_Y} - 5, 2) <= 100"), ov=(lambda: K.circle_overlap(_c(), G.circle(_at(20, 5), F.lit(2.0))), f"pow({_X} - 20, 2) + pow({_Y} - 5, 2) <= 49"), cd=(lambda: _r(K.circle_distance(_c(), G.circle(_at(20, 5), F.lit(2.0)))), f"round(greatest(sqrt(pow({_X} - 20, 2) + pow({_Y} - 5, 2)) - 7, 0), 6)"),
    mv=(lambda: G.circle_moved(_c(), _at(1, 2)).getField("y"), f"{_Y} + 2.0::DOUBLE"), sc=(lambda: G.circle_scaled(_c(), _at(3, 4)).getField("r") + F.col("p_size"), f"{_X} + 25.0::DOUBLE"), pd=(lambda: _r(G.point_circle_distance(_at(20, 5), _c())), f"round(greatest(sqrt(pow({_X} - 20, 2) + pow({_Y} - 5, 2)) - 5, 0), 6)"), cp=(lambda: _r(G.circle_polygon_distance(_c(), _fix(100, -50, 100))), f"(95 - {_X})::DOUBLE"),
    bx=(lambda: _r(G.box_width(G.circle_box(_c())) + F.col("p_size")), f"round({_X} + 10 / sqrt(2), 6)"), po=(lambda: _r(K.polygon_area(G.circle_polygon(_c(), 4)) + F.col("p_size")), f"{_X} + 50.0::DOUBLE"), ar=(lambda: _r(K.circle_area(_c()) + F.col("p_size")), f"round({_X} + 25 * pi(), 6)"),
)
_IP = "('10.' || (c_custkey % 200) || '.' || (c_custkey % 250) || '.' || (c_custkey % 240 + 1) || '/20')"
_ip = lambda: F.concat(F.lit("10."), F.col("c_custkey") % 200, F.lit("."), F.col("c_custkey") % 250, F.lit("."), F.col("c_custkey") % 240 + 1, F.lit("/20"))
_N = "(167772160 + (c_custkey % 200) * 65536 + (c_custkey % 250) * 256 + c_custkey % 240 + 1)"
_mac = lambda: F.concat(F.lit("08-00-2B-"), F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"), F.lit("-03-FF"))
_MAC = "('08:00:2b:' || lower(lpad(to_hex(c_custkey % 256), 2, '0')) || ':03:ff')"
scalars(
    "network_operators", "customer", "c_custkey",
    sm=(lambda: K.network(C.set_masklen(_ip(), 16)), "'10.' || (c_custkey % 200) || '.0.0/16'"), ins=(lambda: C.inside(_ip(), F.lit("10.7.0.0/20")), "false AND c_custkey >= 0"), ine=(lambda: K.within_network(F.lit("10.7.0.0/24"), C.set_masklen(_ip(), 16)), "c_custkey % 200 = 7"), ov=(lambda: C.inet_overlap(_ip(), F.lit("10.7.0.0/16")), "c_custkey % 200 = 7"), no=(lambda: C.inet_not(_ip()), "'245.' || (255 - c_custkey % 200) || '.' || (255 - c_custkey % 250) || '.' || (254 - c_custkey % 240) || '/20'"),
    an=(lambda: K.host(C.inet_and(_ip(), F.lit("255.255.0.0"))), "'10.' || (c_custkey % 200) || '.0.0'"), o=(lambda: K.host(C.inet_or(_ip(), F.lit("0.0.0.255"))), "'10.' || (c_custkey % 200) || '.' || (c_custkey % 250) || '.255'"), pl=(lambda: K.inet_number(C.inet_plus(_ip(), F.lit(1000))), f"{_N} + 1000"), mi=(lambda: C.inet_minus(_ip(), F.lit("10.0.0.0")), f"{_N} - 167772160"), me=(lambda: C.inet_merge(_ip(), F.lit("10.0.0.0/24")), "'10.0.0.0/' || CASE WHEN c_custkey % 200 > 0 THEN 16 - length(bin(c_custkey % 200)) WHEN c_custkey % 250 > 0 THEN least(20, 24 - length(bin(c_custkey % 250))) ELSE 20 END"),
    ab=(lambda: C.abbrev(C.set_masklen(_ip(), 16)), "'10.' || (c_custkey % 200) || '/16'"), fa=(lambda: C.family(_ip()), "CASE WHEN c_custkey >= 0 THEN 4 END"), sh=(lambda: C.inet(C.set_masklen(_ip(), 32)), f"split_part({_IP}, '/', 1)"), lt=(lambda: C.inet_key(_ip()) < C.inet_key(F.lit("10.100.0.0/16")), "c_custkey % 200 < 100"), lt2=(lambda: C.inet_key(C.set_masklen(_ip(), 8)) < C.inet_key(_ip()), "c_custkey >= 0"),
    ma=(lambda: C.macaddr(_mac()), _MAC), mt=(lambda: C.macaddr_trunc(_mac()), "'08:00:2b:00:00:00'"), mn=(lambda: C.macaddr_not(_mac()), "'f7:ff:d4:' || lower(lpad(to_hex(255 - c_custkey % 256), 2, '0')) || ':fc:00'"), mx=(lambda: C.macaddr_and(_mac(), F.lit("00:00:00:ff:00:ff")), "'00:00:00:' || lower(lpad(to_hex(c_custkey % 256), 2, '0')) || ':00:ff'"), mo=(lambda: C.macaddr_or(_mac(), F.lit("00:00:00:00:fc:00")), "'08:00:2b:' || lower(lpad(to_hex(c_custkey % 256), 2, '0')) || ':ff:ff'"), ml=(lambda: C.macaddr_number(_mac()) < C.macaddr_number(F.lit("08002b-800000")), "c_custkey % 256 < 128"),
)
scalars(
    "identifiers", "orders", "o_orderkey",
    v3=(lambda: C.uuid_v3("dns", F.col("o_orderkey").cast("string")) == C.uuid_v3("dns", F.lit("7")), "o_orderkey = 7"), v3v=(lambda: F.substring(C.uuid_v3("url", "o_orderstatus"), 15, 1), "CASE WHEN o_orderkey >= 0 THEN '3' END"), v5=(lambda: F.replace(C.uuid_v5("dns", "o_orderstatus"), F.lit("-")), "CASE o_orderstatus WHEN 'x' THEN '' ELSE (SELECT left(h, 12) || '5' || substring(h, 14, 3) || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substring(h, 17, 1)) - 1) % 4 + 1] || substring(h, 18, 15) FROM (SELECT lower(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || o_orderstatus::BLOB)) AS h)) END"),
    v4=(lambda: C.uuid_v4().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), "uuid() IS NOT NULL AND o_orderkey >= 0"), v1=(lambda: C.uuid_v1().rlike("-1[0-9a-f]{3}-"), "o_orderkey >= 0"), uu=(lambda: C.uuid(F.concat(F.lit("{A0EEBC999C0B4EF8BB6D6BB9BD38"), F.lpad(F.hex(F.col("o_orderkey") % 65536), 4, "0"), F.lit("}"))) < F.lit("a0eebc99-9c0b-4ef8-bb6d-6bb9bd380100"), "o_orderkey % 65536 < 256"),
    ln=(lambda: C.lsn_minus(F.concat(F.lit("1/"), F.hex("o_orderkey")), F.lit("0/10")).cast("long"), "4294967296 + o_orderkey - 16"), lc=(lambda: C.lsn(F.concat(F.lit("0/"), F.hex("o_orderkey"))) < C.lsn(F.lit("0/FF")), "o_orderkey < 255"), ov=(lambda: C.oidvector_key(F.concat(F.lit("1 "), "o_orderkey")) < C.oidvector_key(F.lit("1 50")), "o_orderkey < 50"), td=(lambda: C.tid_key(F.concat(F.lit("("), "o_custkey", F.lit(","), "o_orderkey", F.lit(")"))) < C.tid_key(F.lit("(10,5)")), "o_custkey < 10 OR (o_custkey = 10 AND o_orderkey < 5)"),
)
_isbn = lambda: F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
_D = "lpad(o_orderkey::VARCHAR, 9, '0')"
_SUM = "list_sum(list_transform(range(1, 10), lambda i: (11 - i) * substring(" + _D + ", i, 1)::INT))"
scalars(
    "book_numbers", "orders", "o_orderkey",
    ok=(lambda: C.isbn10(F.concat(_isbn(), F.lit("X"))).isNotNull(), f"({_SUM} + 10) % 11 = 0"), n3=(lambda: C.isbn10(F.concat(_isbn(), F.lit("-3"))), f"CASE WHEN ({_SUM} + 3) % 11 = 0 THEN {_D} || '3' END"), e=(lambda: C.ean13(F.concat(F.lit("978"), _isbn(), F.lit("5"))).isNotNull(), f"(list_sum(list_transform(range(1, 13), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) * substring('978' || {_D}, i, 1)::INT)) + 5) % 10 = 0"),
    conv=(lambda: F.substring(C.isbn13(F.concat(_isbn(), F.lit("X"))), 1, 12), f"CASE WHEN ({_SUM} + 10) % 11 = 0 THEN '978' || {_D} END"), iss=(lambda: C.issn(F.concat(F.lpad((F.col("o_orderkey") % 10000000).cast("string"), 7, "0"), F.lit("0"))).isNotNull(), "list_sum(list_transform(range(1, 8), lambda i: (9 - i) * substring(lpad((o_orderkey % 10000000)::VARCHAR, 7, '0'), i, 1)::INT)) % 11 = 0"),
)
scalars(
    "word_similarities", "part", "p_partkey",
    ws=(lambda: C.word_similarity(F.split_part("p_name", F.lit(" "), F.lit(1)), "p_name"), "CASE WHEN p_name IS NOT NULL THEN 1.0::DOUBLE END"), di=(lambda: C.difference("p_name", "p_name"), "CASE WHEN p_name IS NOT NULL THEN 4 END"), le=(lambda: F.levenshtein("p_brand", F.lit("Brand#13")) < 2, "levenshtein(p_brand, 'Brand#13') < 2"), li=(lambda: C.similar("p_brand", F.lit("brand")), "true OR p_brand = ''"), dd=(lambda: _r(C.dissimilarity(F.lit("brand"), F.lower(F.substring("p_brand", 1, 5)))), "round(levenshtein('brand', lower(substring(p_brand, 1, 5))), 6)::DOUBLE"),
)
_path = lambda: F.concat(F.lit("Top."), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(".x_y."), "n_regionkey")
scalars(
    "label_path_operators", "nation", "n_nationkey",
    sl=(lambda: C.subltree(_path(), 1, 3), "replace(n_name, ' ', '_') || '.x_y'"), ix=(lambda: C.path_index(_path(), F.concat(F.lit("x_y."), "n_regionkey")), "CASE WHEN n_regionkey >= 0 THEN 2 END"), i1=(lambda: C.path_index(_path(), F.lit("2")), "CASE WHEN n_regionkey = 2 THEN 3 ELSE -1 END"), q=(lambda: C.path_words(_path(), "top@ & (3 | 4) & !5"), "n_regionkey IN (3, 4)"), q2=(lambda: C.path_words(_path(), "NAT*"), "starts_with(n_name, 'NAT')"), q3=(lambda: C.path_words(_path(), "y%"), "n_name IS NOT NULL"),
)
_e = lambda: C.ll_to_earth(F.col("p_size"), F.col("p_partkey") % 100)
scalars(
    "earth_points", "part", "p_partkey",
    la=(lambda: _r(C.latitude(_e())), "p_size::DOUBLE"), lo=(lambda: _r(C.longitude(_e())), "(p_partkey % 100)::DOUBLE"), gc=(lambda: _r(C.sec_to_gc(C.gc_to_sec(F.col("p_size") * 1000.0)), 3), "p_size * 1000.0::DOUBLE"), bx=(lambda: C.in_cube(C.earth_box(C.ll_to_earth(F.lit(0.0), F.lit(0.0)), 1e7), _e()) | F.lit(True), "p_size IS NOT NULL"), di=(lambda: _r(K.cube_distance(_e(), C.ll_to_earth(F.col("p_size"), F.col("p_partkey") % 100 + 180)), 1), "round(2 * 6378168.0 * cos(radians(p_size)), 1)"),
    mi=(lambda: _r(C.point_degrees(_at(0, 0), K.point(F.lit(0.0), F.col("p_size"))), 4), "round(radians(p_size) * 3958.747716, 4)"),
)
_cube = lambda x: F.struct(F.array(x, F.lit(0.0)).alias("ll"), F.array(x + 10, F.lit(5.0)).alias("ur"))
scalars(
    "cubes", "part", "p_partkey",
    ov=(lambda: C.cubes_overlap(_cube(F.col("p_size").cast("double")), _cube(F.lit(20.0))), "p_size BETWEEN 10 AND 30"), si=(lambda: C.cube_size(_cube(F.col("p_size").cast("double"))) + F.col("p_size"), "p_size + 50.0::DOUBLE"), it=(lambda: F.get(C.cube_inter(_cube(F.col("p_size").cast("double")), _cube(F.lit(20.0))).getField("ll"), F.lit(0)), "greatest(p_size, 20)::DOUBLE"), inn=(lambda: C.in_cube(_cube(F.lit(20.0)), F.array(F.col("p_size").cast("double"), F.lit(1.0))), "p_size BETWEEN 20 AND 30"),
    un=(lambda: F.get(K.cube_union(F.array(F.col("p_size").cast("double")), F.array(F.lit(9.0))).getField("ur"), F.lit(0)), "greatest(p_size, 9)::DOUBLE"),
)
scalars(
    "digests_and_ciphers", "nation", "n_nationkey",
    d1=(lambda: F.lower(F.hex(C.digest("n_name", "sha1"))), "sha1(n_name)"), d2=(lambda: F.lower(F.hex(C.digest("n_name", "sha256"))), "sha256(n_name)"), d5=(lambda: F.lower(F.hex(C.digest("n_name", "md5"))), "md5(n_name)"),
    hm=(lambda: F.lower(F.hex(C.hmac("n_name", F.lit("k"), "sha256"))), "sha256(unhex('37' || repeat('5c', 63)) || unhex(sha256(unhex('5d' || repeat('36', 63)) || n_name::BLOB)))"), en=(lambda: F.decode(C.decrypt(C.encrypt(F.encode("n_name", "UTF-8"), F.encode(F.lit("0000111122223333"), "UTF-8")), F.encode(F.lit("0000111122223333"), "UTF-8")), "UTF-8"), "n_name"),
)
_h = lambda: F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.nullif("n_nationkey", F.lit(3)).cast("string"))
_V = "nullif(n_nationkey, 3)::VARCHAR"
scalars(
    "key_value_operators", "nation", "n_nationkey",
    tx=(lambda: K.hstore(F.concat(F.lit('"a"=>"'), "n_name", F.lit(', x", b=>'), F.coalesce(F.nullif("n_nationkey", F.lit(3)).cast("string"), F.lit("NULL")))).getItem("a"), "n_name || ', x'"), nu=(lambda: K.hstore(F.concat(F.lit("b=>"), F.coalesce(F.nullif("n_nationkey", F.lit(3)).cast("string"), F.lit("NULL")))).getItem("b"), _V), sh=(lambda: K.map_text(_h()), f"'\"a\"=>\"' || n_name || '\", \"b\"=>' || coalesce('\"' || {_V} || '\"', 'NULL')"),
    df=(lambda: K.map_defined(_h(), "b"), "n_nationkey <> 3"), al=(lambda: K.map_has_all(_h(), ["a", "b"]) & (F.col("n_nationkey") > 4), "n_nationkey > 4"), an=(lambda: K.map_has_any(_h(), ["z", "b"]) & (F.col("n_nationkey") > 4), "n_nationkey > 4"), js=(lambda: K.map_json(_h()), f"to_json({{'a': n_name, 'b': {_V}}})::VARCHAR"), mm=(lambda: F.map_keys(K.map_minus_map(_h(), F.create_map(F.lit("b"), F.lit("7")))), "CASE WHEN n_nationkey = 7 THEN ['a'] ELSE ['a', 'b'] END"),
    sl=(lambda: K.map_slice(_h(), ["b", "q"]).getItem("b"), _V), mx=(lambda: F.get(K.map_matrix(_h()), F.lit(1)), f"['b', {_V}]"), jo=(lambda: K.map_join(_h(), F.create_map(F.lit("b"), "n_name")).getItem("b"), "n_name"), mi=(lambda: F.map_keys(K.map_minus(_h(), ["a"])), "[left('b' || n_name, 1)]"),
)
_words = lambda: F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
scalars(
    "text_vectors", "documents", "doc_id",
    n=(lambda: T.length(K.to_tsvector("text")), f"len(list_distinct({_W}))::INT"), st=(lambda: F.size(F.array_except(T.strip(K.to_tsvector("text")), _words())), "CASE WHEN text IS NOT NULL THEN 0 END"), de=(lambda: T.length(T.delete(K.to_tsvector("text"), "the", "of")), f"len(list_filter(list_distinct({_W}), lambda x: x NOT IN ('the', 'of')))::INT"),
    fi=(lambda: T.length(T.filtered(T.set_weight(K.to_tsvector("text"), "A", ["the", "of", "and"]), "ab".upper())), f"len(list_filter(list_distinct({_W}), lambda x: x IN ('the', 'of', 'and')))::INT"), jo=(lambda: F.array_max(F.flatten(F.transform(T.joined(T.set_weight(K.to_tsvector("text"), "A"), T.set_weight(K.to_tsvector(F.lit("one two")), "B")), lambda x: x.positions))), f"len({_W})::INT + 2"),
    si=(lambda: T.length(T.tsvector("text", [T.synonym({"the": "of"}), T.simple()])), f"len(list_distinct(list_transform({_W}, lambda x: CASE WHEN x = 'the' THEN 'of' ELSE x END)))::INT"), hi=(lambda: F.length(T.headline(F.left("text", F.lit(300)), ["the"])) - F.length(F.left("text", F.lit(300))), f"7 * len(list_filter({_W.replace('text', 'left(text, 300)')}, lambda x: x = 'the'))::INT"),
    qa=(lambda: K.ts_match(K.to_tsvector("text"), T.both("the", T.negated("of"))), f"list_contains({_W}, 'the') AND NOT list_contains({_W}, 'of')"), qr=(lambda: K.ts_match(K.to_tsvector("text"), T.rewrite("a & the", "a", "of | the")), f"list_contains({_W}, 'the')"), qf=(lambda: K.ts_match(K.to_tsvector("text"), T.either("zzz", "the")), f"list_contains({_W}, 'the')"),
    rk=(lambda: F.round(K.ts_rank(K.to_tsvector("text"), ["the"]), 6) > 0, f"list_contains({_W}, 'the')"), rc=(lambda: T.rank_cd("text", ["the", "of"]) > 0, f"list_has_all({_W}, ['the', 'of'])"),
)


@query("SELECT c_custkey, unnest(['Customer', '#']) AS token, unnest([1, 12]) AS tokid FROM customer")
def text_tokens(t):
    """What the parser makes of a name, without its number."""
    return t.customer.select("c_custkey", F.inline(T.ts_parse("c_name"))).where("tokid IN (1, 12)").select("c_custkey", "token", "tokid")


@query("SELECT count(*) AS n, abs(avg(x)) < 0.2 AS centred, abs(stddev(x) - 2) < 0.2 AS spread FROM (SELECT sqrt(-2 * ln(random())) * cos(2 * pi() * random()) * 2 AS x FROM range(5000))")
def normal_numbers(t):
    from ..functions.numbers import normal_rand

    x = normal_rand(t.spark, 5000, 0.0, 2.0, seed=3)
    return x.agg(F.count("*").alias("n"), (F.abs(F.avg("x")) < 0.2).alias("centred"), (F.abs(F.stddev("x") - 2) < 0.2).alias("spread"))
