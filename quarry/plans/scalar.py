"""Queries of scalar functions, a family each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_text as J
from ..functions import scalar as S
from ..functions import xml as X
from .registry import query, scalars

scalars(
    "fn_case_and_pad", "part", "p_partkey",
    lo=(lambda: F.lower("p_name"), "lower(p_name)"), up=(lambda: F.upper("p_name"), "upper(p_name)"),
    lp=(lambda: F.lpad("p_brand", 12, "*"), "lpad(p_brand, 12, '*')"), rp=(lambda: F.rpad("p_brand", 12, "xy"), "rpad(p_brand, 12, 'xy')"),
    bt=(lambda: F.btrim(F.concat(F.lit("xx"), "p_brand", F.lit("yx")), F.lit("xy")), "trim('xx' || p_brand || 'yx', 'xy')"),
    lt=(lambda: F.ltrim(F.concat(F.lit("  "), "p_brand"), F.lit(" ")), "ltrim('  ' || p_brand)"),
    rt=(lambda: F.rtrim(F.concat("p_brand", F.lit("12")), F.lit("0123456789")), "rtrim(p_brand || '12', '0123456789')"),
)
scalars(
    "fn_substrings", "customer", "c_custkey",
    l3=(lambda: S.left("c_name", 3), "left(c_name, 3)"), l_=(lambda: S.left("c_name", -4), "left(c_name, -4)"),
    r3=(lambda: S.right("c_name", 3), "right(c_name, 3)"), r_=(lambda: S.right("c_name", -4), "right(c_name, -4)"),
    s2=(lambda: S.substr("c_name", 2, 4), "substring(c_name, 2, 4)"), s0=(lambda: S.substr("c_name", -1, 5), "substring(c_name, 1, 3)"), st=(lambda: S.substr("c_name", 5), "substring(c_name, 5)"),
    po=(lambda: F.instr("c_name", "0").cast("long"), "strpos(c_name, '0')"), sp=(lambda: F.split_part("c_name", F.lit("#"), F.lit(2)), "split_part(c_name, '#', 2)"),
    so=(lambda: F.split_part("c_name", F.lit("#"), F.lit(9)), "split_part(c_name, '#', 9)"), ov=(lambda: F.overlay("c_name", F.lit("ZZ"), 2, 3), "left(c_name, 1) || 'ZZ' || substring(c_name, 5)"),
)
scalars(
    "fn_string_building", "supplier", "s_suppkey",
    rep=(lambda: F.repeat("s_name", 2), "repeat(s_name, 2)"), rev=(lambda: F.reverse("s_name"), "reverse(s_name)"),
    cc=(lambda: S.concat("s_name", F.lit(None), "s_nationkey"), "concat(s_name, NULL, s_nationkey)"), ws=(lambda: F.concat_ws("-", "s_name", F.lit(None).cast("string"), F.col("s_nationkey").cast("string")), "concat_ws('-', s_name, NULL, s_nationkey)"),
    nul=(lambda: F.concat("s_name", F.lit(None).cast("string")), "s_name || NULL"), repl=(lambda: F.replace("s_name", F.lit("S"), F.lit("")), "replace(s_name, 'S', '')"),
    tr=(lambda: F.translate("s_name", "Supl", "zy"), "translate(s_name, 'Supl', 'zy')"), asc=(lambda: F.ascii("s_name"), "ascii(s_name)"), ch=(lambda: S.chr_(F.col("s_suppkey") * 37 + 200), "chr((s_suppkey * 37 + 200)::INT)"),
    fm=(lambda: S.format_("%s|%2$8s|%%", "s_name", "s_nationkey"), "s_name || '|' || lpad(s_nationkey::VARCHAR, 8, ' ') || '|%'"), ql=(lambda: S.quote_literal(F.concat("s_name", F.lit("'s"))), "'''' || s_name || '''''s'''"),
    qi=(lambda: S.quote_ident("s_name"), "'\"' || s_name || '\"'"), qn=(lambda: S.quote_nullable(F.lit(None).cast("string")), "'NULL'"), ini=(lambda: S.initcap(F.lit("hi-there o'brien 3rd")), "'Hi-There O''Brien 3rd'"),
)
scalars(
    "fn_string_measures", "documents", "doc_id",
    n=(lambda: F.length("text"), "length(text)"), ol=(lambda: F.octet_length("text"), "strlen(text)"), bl=(lambda: F.bit_length("text"), "bit_length(text)"), m=(lambda: F.md5("text"), "md5(text)"),
    h=(lambda: F.sha2("text", 256), "sha256(text)"), b64=(lambda: F.base64(F.col("source").cast("binary")), "base64(source::BLOB)"), hx=(lambda: F.lower(F.hex("source")), "lower(hex(source))"), sw=(lambda: F.startswith("text", F.lit("The")), "starts_with(text, 'The')"),
)
scalars(
    "fn_patterns", "part", "p_partkey",
    li=(lambda: F.col("p_name").like("%a%"), "p_name LIKE '%a%'"), nl=(lambda: ~F.col("p_brand").like("Brand#1_"), "p_brand NOT LIKE 'Brand#1_'"), il=(lambda: F.col("p_type").ilike("%STEEL%"), "p_type ILIKE '%STEEL%'"),
    es=(lambda: F.like(F.lit("10%"), F.lit("10/%"), F.lit("/")), "'10%' LIKE '10/%' ESCAPE '/'"), si=(lambda: S.similar_to("p_brand", "Brand#(1|2)%"), "regexp_full_match(p_brand, 'Brand#(1|2).*')"),
    re=(lambda: F.col("p_name").rlike("^[a-m]"), "regexp_matches(p_name, '^[a-m]')"), rs=(lambda: S.substring_regex("p_brand", r"#(\d)"), "CASE WHEN regexp_matches(p_brand, '#(\\d)') THEN regexp_extract(p_brand, '#(\\d)', 1) END"),
    rn=(lambda: S.substring_regex("p_brand", r"z+"), "NULL::VARCHAR"), r1=(lambda: S.regexp_replace("p_name", "[aeiou]", "_"), "regexp_replace(p_name, '[aeiou]', '_')"), rg=(lambda: S.regexp_replace("p_name", "([aeiou])", r"<\1>", "g"), "regexp_replace(p_name, '([aeiou])', '<\\1>', 'g')"),
    rm=(lambda: S.regexp_matches("p_brand", r"\d"), "regexp_extract_all(p_brand, '\\d')"), rp=(lambda: F.split("p_type", r"\s+"), "regexp_split_to_array(p_type, '\\s+')"),
    sa=(lambda: S.string_to_array("p_type", " ", "STEEL"), "list_transform(string_split(p_type, ' '), lambda x: nullif(x, 'STEEL'))"), ats=(lambda: F.array_join(F.array("p_brand", F.lit(None).cast("string"), "p_type"), ",", "*"), "p_brand || ',*,' || p_type"),
)
scalars(
    "fn_integer_math", "lineitem", "l_orderkey",
    ln=(lambda: F.col("l_linenumber"), "l_linenumber"), dv=(lambda: S.div("l_partkey", F.lit(7)), "l_partkey // 7"), dn=(lambda: S.div(-F.col("l_partkey"), F.lit(7)), "-(l_partkey // 7)"), md=(lambda: -F.col("l_partkey") % 7, "-l_partkey % 7"),
    ab=(lambda: F.abs(-F.col("l_partkey")), "abs(-l_partkey)"), an=(lambda: F.col("l_partkey").bitwiseAND(F.lit(12)), "l_partkey & 12"), o=(lambda: F.col("l_partkey").bitwiseOR(F.lit(12)), "l_partkey | 12"), xo=(lambda: F.col("l_partkey").bitwiseXOR(F.lit(12)), "xor(l_partkey, 12)"),
    sl=(lambda: F.shiftleft("l_partkey", 3), "l_partkey << 3"), sr=(lambda: F.shiftright("l_partkey", 2), "l_partkey >> 2"), hx=(lambda: S.to_hex("l_partkey"), "lower(to_hex(l_partkey))"), fa=(lambda: F.factorial(F.col("l_linenumber")), "factorial(l_linenumber)::BIGINT"),
    gr=(lambda: F.greatest("l_partkey", F.lit(None).cast("long"), "l_suppkey"), "greatest(l_partkey, NULL, l_suppkey)"), le=(lambda: F.least("l_partkey", "l_suppkey"), "least(l_partkey, l_suppkey)"), sg=(lambda: F.signum(F.col("l_partkey") - 500).cast("int"), "sign(l_partkey - 500)::INT"),
)
scalars(
    "fn_float_math", "part", "p_partkey",
    ce=(lambda: F.ceil("p_retailprice").cast("double"), "ceil(p_retailprice)"), fl=(lambda: F.floor("p_retailprice").cast("double"), "floor(p_retailprice)"), ro=(lambda: S.round_float(F.col("p_size") / 2), "round_even(p_size / 2, 0)"), tr=(lambda: S.trunc(-F.col("p_retailprice")).cast("double"), "trunc(-p_retailprice)"),
    sq=(lambda: F.round(F.sqrt("p_size"), 10), "round(sqrt(p_size), 10)"), cb=(lambda: F.round(F.cbrt("p_size"), 10), "round(cbrt(p_size), 10)"), pw=(lambda: F.pow(F.col("p_size").cast("double"), F.lit(2.0)), "pow(p_size, 2)"), ex=(lambda: F.round(F.exp(F.col("p_size") / 50), 9), "round(exp(p_size / 50), 9)"),
    l=(lambda: F.round(F.ln("p_retailprice"), 9), "round(ln(p_retailprice), 9)"), lg=(lambda: F.round(F.log10("p_retailprice"), 9), "round(log10(p_retailprice), 9)"), lb=(lambda: F.round(F.log(2.0, F.col("p_retailprice")), 9), "round(log2(p_retailprice), 9)"),
    dg=(lambda: F.round(F.degrees("p_size"), 8), "round(degrees(p_size), 8)"), ra=(lambda: F.round(F.radians("p_size"), 10), "round(radians(p_size), 10)"), s=(lambda: F.round(F.sin("p_size"), 9), "round(sin(p_size), 9)"), c=(lambda: F.round(F.cos("p_size"), 9), "round(cos(p_size), 9)"),
    t=(lambda: F.round(F.tan("p_size"), 7), "round(tan(p_size), 7)"), ct=(lambda: F.round(F.cot(F.col("p_size").cast("double")), 7), "round(cot(p_size), 7)"), at=(lambda: F.round(F.atan2(F.col("p_size"), F.lit(3.0)), 9), "round(atan2(p_size, 3), 9)"), sd=(lambda: S.degree("sind", F.lit(30.0)), "0.5::DOUBLE"), cd=(lambda: S.degree("cosd", F.lit(60.0)), "0.5::DOUBLE"),
    wb=(lambda: F.width_bucket(F.col("p_size").cast("double"), F.lit(0.0), F.lit(50.0), 5), "CASE WHEN p_size >= 50 THEN 6 ELSE floor(p_size / 10)::BIGINT + 1 END"), wa=(lambda: S.width_bucket("p_size", [10, 20, 40]), "(p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 40)::INT"),
)
scalars(
    "fn_conditions", "customer", "c_custkey",
    cw=(lambda: F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 5000, "mid").otherwise("high"), "CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END"), ni=(lambda: F.nullif("c_nationkey", F.lit(3)), "nullif(c_nationkey, 3)"),
    co=(lambda: F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(-1)), "coalesce(nullif(c_nationkey, 3), -1)"), df=(lambda: ~F.nullif("c_nationkey", F.lit(3)).eqNullSafe(F.lit(None)), "nullif(c_nationkey, 3) IS DISTINCT FROM NULL"), bs=(lambda: S.between_symmetric("c_nationkey", F.lit(20), F.lit(5)), "c_nationkey BETWEEN 5 AND 20"),
    nn=(lambda: S.num_nulls(F.nullif("c_nationkey", F.lit(3)), "c_name", F.lit(None)), "(c_nationkey = 3)::INT + 1"), rl=(lambda: S.row_less(["c_nationkey", "c_acctbal"], [F.lit(7), F.lit(100.0)]), "c_nationkey < 7 OR (c_nationkey = 7 AND c_acctbal < 100)"),
    it=(lambda: F.coalesce(F.nullif("c_nationkey", F.lit(3)) > 5, F.lit(False)), "(nullif(c_nationkey, 3) > 5) IS NOT DISTINCT FROM true"), an=(lambda: F.exists(F.array(F.lit(1), F.lit(5)), lambda x: F.col("c_nationkey") == x), "c_nationkey = ANY ([1, 5])"), al=(lambda: F.forall(F.array(F.lit(1), F.lit(5)), lambda x: F.col("c_nationkey") > x), "c_nationkey > 1 AND c_nationkey > 5"),
    ci=(lambda: F.rint("c_acctbal").cast("int"), "round_even(c_acctbal, 0)::INT"),
)
scalars(
    "fn_date_parts", "orders", "o_orderkey",
    **{f"p_{f}": (lambda f=f: S.extract(f, "o_orderdate").cast("long"), f"{f}(o_orderdate)::BIGINT" if f not in ("dow", "isodow", "doy") else f"date_part('{f}', o_orderdate)::BIGINT") for f in ("year", "quarter", "month", "week", "day", "dow", "isodow", "doy", "century", "decade", "hour", "minute", "isoyear")},
    ml=(lambda: S.extract("millennium", "o_orderdate").cast("long"), "millennium(o_orderdate)::BIGINT"), ep=(lambda: S.extract("epoch", "o_orderdate").cast("double"), "epoch(o_orderdate)"),
    **{f"t_{f}": (lambda f=f: S.date_trunc(f, "o_orderdate"), f"date_trunc('{f}', o_orderdate)::TIMESTAMP") for f in ("year", "quarter", "month", "week", "day", "decade")},
    **{f"t_{f}": (lambda f=f: S.date_trunc(f, "o_orderdate"), f"make_timestamp(({f}(o_orderdate) - 1) * {n} + 1, 1, 1, 0, 0, 0)") for f, n in (("century", 100), ("millennium", 1000))},
)
scalars(
    "fn_date_arithmetic", "orders", "o_orderkey",
    dd=(lambda: F.date_add(F.to_date("o_orderdate"), 45), "(o_orderdate::DATE + 45)"), ds=(lambda: F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long"), "(o_orderdate::DATE - DATE '1992-01-01')::BIGINT"),
    mi=(lambda: S.add_interval("o_orderdate", S.interval(months=1, days=2, hours=3)), "o_orderdate + INTERVAL 1 month + INTERVAL 2 day + INTERVAL 3 hour"), md=(lambda: F.make_date(F.year("o_orderdate"), F.lit(2), F.lit(28)), "make_date(year(o_orderdate), 2, 28)"),
    ts=(lambda: F.make_timestamp_ntz(F.year("o_orderdate"), F.lit(3), F.lit(4), F.lit(5), F.lit(6), F.lit(7.5).cast("decimal(8,6)")), "make_timestamp(year(o_orderdate), 3, 4, 5, 6, 7.5)"), ov=(lambda: S.overlaps("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-06-01").cast("timestamp_ntz")), "o_orderdate < TIMESTAMP '1995-06-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 90 day"),
    ic=(lambda: S.interval_key(S.interval(months=1)) == S.interval_key(S.interval(days=30)), "INTERVAL 1 month = INTERVAL 30 day"), jh=(lambda: S.justify_hours(S.interval(hours=50)).getField("days"), "2"), jd=(lambda: S.justify_days(S.interval(days=65)).getField("months"), "2"),
    tc=(lambda: S.to_char("o_orderdate", "YYYY-MM-DD HH24:MI:SS"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"), tm=(lambda: S.to_char("o_orderdate", "Dy Mon DD"), "strftime(o_orderdate, '%a %b %d')"),
    td=(lambda: F.to_date(S.to_char("o_orderdate", "DD/MM/YYYY"), S.template("DD/MM/YYYY")), "strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y')::DATE"), te=(lambda: F.timestamp_seconds(F.col("o_orderkey")).cast("timestamp_ntz"), "make_timestamp(o_orderkey * 1000000)"), tz=(lambda: F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "Asia/Tokyo").cast("timestamp_ntz"), "o_orderdate + INTERVAL 9 hour"),
    gl=(lambda: F.greatest("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")), "greatest(o_orderdate, TIMESTAMP '1995-01-01')"),
)
scalars(
    "fn_arrays", "lineitem", "l_orderkey",
    ln=(lambda: F.col("l_linenumber"), "l_linenumber"),
    **{
        k: (lambda f=f: f(F.array("l_linenumber", F.lit(3), F.lit(None).cast("int"), F.lit(5), F.lit(3))), q.replace("@", "[l_linenumber, 3, NULL, 5, 3]"))
        for k, (f, q) in dict(
            sub=(lambda a: S.subscript(a, 2), "@[2]"), out=(lambda a: S.subscript(a, 9), "@[9]"), sli=(lambda a: S.array_slice(a, 2, 4), "@[2:4]"), con=(lambda a: S.contains_all(a, F.array(F.lit(5), F.lit(3))), "list_has_all(@, [5, 3])"), ovl=(lambda a: F.coalesce(F.arrays_overlap(a, F.array(F.lit(1), F.lit(2))), F.lit(False)), "list_has_any(@, [1, 2])"),
            app=(lambda a: F.array_append(a, F.lit(9)), "list_append(@, 9)"), pre=(lambda a: F.array_prepend(a, F.lit(9)), "list_prepend(9, @)"), cat=(lambda a: F.concat(a, F.array(F.lit(1))), "list_concat(@, [1])"), len=(lambda a: S.array_length(a).cast("long"), "len(@)"), car=(lambda a: F.cardinality(a).cast("long"), "len(@)"),
            pos=(lambda a: S.array_position(a, 5).cast("long"), "list_position(@, 5)::BIGINT"), abs_=(lambda a: S.array_position(a, 99).cast("long"), "NULL::BIGINT"), pss=(lambda a: F.transform(S.array_positions(a, 3), lambda x: x.cast("long")), "list_filter([1, 2, 3, 4, 5]::BIGINT[], lambda i: @[i] = 3)"), rep=(lambda a: S.array_replace(a, 3, 7), "list_transform(@, lambda x: CASE WHEN x = 3 THEN 7 ELSE x END)"),
            rem=(lambda a: F.filter(a, lambda x: ~x.eqNullSafe(F.lit(3))), "list_filter(@, lambda x: x IS DISTINCT FROM 3)"), fil=(lambda a: S.array_fill(7, 3), "[7, 7, 7]"), gs=(lambda a: F.sequence(F.lit(1).cast("long"), F.size(a).cast("long")), "range(1, 6)"),
        ).items()
    },
)


@query("SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_suppkey]) AS a, unnest([1]) AS i FROM lineitem")
def fn_unnest(t):
    """Two arrays side by side, the shorter padded with null."""
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_partkey", "l_suppkey").alias("a"), F.array(F.lit(1)).alias("i"))
    return x.select("l_orderkey", "l_linenumber", S.unnest("a", "i"))


scalars(
    "fn_json", "events", "event_id",
    k=(lambda: S.json_text("props", "k"), "props ->> 'k'"), no=(lambda: S.json_text("props", "zz"), "props ->> 'zz'"), pa=(lambda: S.json_text(F.lit('{"a": {"b": [1, {"c": "x"}]}}'), "a", "b", 1, "c"), "'x'"), ty=(lambda: S.json_typeof("props"), "lower(json_type(props))"), al=(lambda: F.json_array_length(F.lit("[1, 2, [3]]")), "json_array_length('[1, 2, [3]]')::INT"),
    ks=(lambda: F.json_object_keys("props"), "json_keys(props)"), ha=(lambda: S.json_has("props", "k"), "list_contains(json_keys(props), 'k')"), mi=(lambda: J.minus(F.concat(F.lit('{"n":'), "event_id", F.lit(',"p":'), "props", F.lit("}")), "n"), "'{\"p\":' || json(props)::VARCHAR || '}'"), bo=(lambda: S.build_object(id="event_id", t="event_type"), "'{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}'"),
)
_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_odd = lambda: F.concat("n_name", F.lit(" <&> "), "n_nationkey")
_ODD = _ESC.format("n_name || ' <&> ' || n_nationkey")
scalars(
    "fn_xml", "nation", "n_nationkey",
    el=(lambda: X.element("n", {"id": "n_nationkey", "no": F.nullif("n_regionkey", F.lit(1))}, X.escaped(_odd()), X.element("e")), f"'<n id=\"' || n_nationkey || '\"' || CASE WHEN n_regionkey = 1 THEN '' ELSE ' no=\"' || n_regionkey || '\"' END || '>' || {_ODD} || '<e/></n>'"),
    fo=(lambda: X.forest(a=_odd(), b=F.nullif("n_regionkey", F.lit(1))), f"'<a>' || {_ODD} || '</a>' || CASE WHEN n_regionkey = 1 THEN '' ELSE '<b>' || n_regionkey || '</b>' END"), co=(lambda: X.comment("n_name"), "'<!--' || n_name || '-->'"), pi=(lambda: X.instruction("php", "n_name"), "'<?php ' || n_name || '?>'"),
    ro=(lambda: X.root(F.concat(F.lit('<?xml version="1.1"?><a>'), "n_nationkey", F.lit("</a>")), standalone="yes"), "'<?xml version=\"1.0\" standalone=\"yes\"?><a>' || n_nationkey || '</a>'"), ca=(lambda: X.concat(F.nullif(F.lit("<a/>"), F.when(F.col("n_regionkey") == 1, "<a/>")), X.element("b")), "CASE WHEN n_regionkey = 1 THEN '' ELSE '<a/>' END || '<b/>'"),
    wd=(lambda: X.is_well_formed(F.concat(F.lit("<a>"), "n_name", F.when(F.col("n_regionkey") == 1, "</b>").otherwise("</a>"))), "n_regionkey <> 1"), wc=(lambda: X.is_well_formed(F.concat("n_name", F.lit("<x/>"), F.when(F.col("n_regionkey") == 1, "&").otherwise("")), document=False), "n_regionkey <> 1"),
    pa=(lambda: X.parse(F.concat(F.lit("<a>"), "n_name", F.lit("</a>"))), "'<a>' || n_name || '</a>'"), xp=(lambda: X.xpath("/s:r/s:n/text()", F.concat(F.lit('<r xmlns="u"><n>'), X.escaped(_odd()), F.lit("</n><n>2</n></r>")), {"s": "u"}), "[n_name || ' <&> ' || n_nationkey, '2']"),
    xa=(lambda: X.xpath("//n/@id", X.element("r", None, X.element("n", {"id": "n_nationkey"}))), "[n_nationkey::VARCHAR]"), xe=(lambda: X.xpath_exists("/r/n[@id='3']", X.element("r", None, X.element("n", {"id": "n_nationkey"}))), "n_nationkey = 3"), tx=(lambda: X.element("row", None, X.forest(n_nationkey="n_nationkey", n_name="n_name")), "'<row><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name></row>'"),
)


@query("SELECT n_nationkey, n_name AS name, [n_name] AS names, true AS there FROM nation")
def fn_xpath(t):
    x = t.nation.withColumn("x", F.concat(F.lit("<r><n>"), "n_name", F.lit("</n></r>")))
    return x.select("n_nationkey", F.xpath_string("x", F.lit("/r/n")).alias("name"), F.xpath("x", F.lit("/r/n/text()")).alias("names"), F.xpath_boolean("x", F.lit("/r/n")).alias("there"))


@query("SELECT x AS i, x // 2 AS half FROM (VALUES (0), (123456), (-123456), (2147483647), (-2147483647)) v(x)")
def golden_int_division(t):
    return t.spark.sql("SELECT * FROM VALUES (0), (123456), (-123456), (2147483647), (-2147483647) AS v(i)").select("i", S.div("i", F.lit(2)).cast("int").alias("half"))
