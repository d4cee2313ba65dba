"""Quality rules on DataFrame functions alone, with host verdicts from an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, rejoined, small, table, written

#: White space between words, as characters and as a regular expression's class.
SPACE, SPACE_CLASS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]"
SYMBOLS, WINDOW = "#*$%&|<>", 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Soft rules: mean code points a word, symbols in a hundred word characters, repeated lines in a hundred lines.
SHORTEST_MEAN, LONGEST_MEAN, MOST_SYMBOLS, MOST_DUP_LINES = 2, 15, 10, 30
#: A host whose shrunk failure rate is above this is bad. PRIOR is the prior's weight where hosts' rates don't vary.
BAD_HOST, PRIOR = 0.5, 10.0


def measured(docs: DataFrame, text: str, keep: dict[str, str]) -> DataFrame:
    """keep's columns (new name: column), then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text is one without words. Five-word windows are compared by a 64-bit hash of the words' hashes. Only texts that
    repeat a window pay for a sort; the arrays of a row never leave it.
    """
    t = F.coalesce(F.col("__t"), F.lit(""))
    df = docs.select(*(F.col(c).alias(n) for n, c in keep.items()), F.col(text).cast("string").alias("__t")).withColumn("__t", t)
    df = df.withColumn("__b", F.btrim("__t", F.lit(SPACE)))
    df = df.withColumn("__w", F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", f"{SPACE_CLASS}+")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(SPACE_CLASS.replace("[", "[^")))
    left = lambda chars: F.length(F.translate("__t", chars, ""))
    df = df.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        left(SPACE).cast("long").alias("word_chars"),
        (F.length("__t") - left(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    counted = [*keep, "n_words", "word_chars", "n_symbols"]
    df = df.select(
        *counted,
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(slice(__h, 1, size(__h) - {WINDOW - 1}), (x, i) -> xxhash64(x, {', '.join(f'get(__h, i + {k})' for k in range(1, WINDOW))})) END").alias("__g"),
    )
    counted += ["n_lines", "n_dup_lines"]
    df = df.select(*counted, F.expr("CASE WHEN size(__g) > size(array_distinct(__g)) THEN array_sort(transform(__g, (x, i) -> named_struct('x', x, 'i', i))) END").alias("__s"))
    again = "filter(__s, (a, k) -> get(__s, k - 1).x <=> a.x OR get(__s, k + 1).x <=> a.x)"
    df = df.select(*counted, F.expr(f"array_sort(transform({again}, a -> a.i))").alias("__at"))
    covered = f"aggregate(transform(__at, (p, k) -> least({WINDOW}, coalesce(get(__at, k + 1) - p, {WINDOW}))), 0L, (x, y) -> x + y)"
    return df.select(*counted, F.expr(f"coalesce({covered}, 0L)").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def soft_failed() -> Column:
    mean_off = (F.col("word_chars") < SHORTEST_MEAN * F.col("n_words")) | (F.col("word_chars") > LONGEST_MEAN * F.col("n_words"))
    return mean_off | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, failed, rate) from (host, fails): rate is the mean of the beta posterior with a prior fitted to all hosts.

    The prior's mean and weight come from the mean and variance of the hosts' own rates (method of moments); one row
    of sums reaches the driver.
    """
    hosts = judged.groupBy("__host").agg(F.count("*").alias("n"), F.sum(F.col("fails").cast("long")).alias("failed"))
    own = F.col("failed") / F.col("n")
    mean, var = hosts.agg(F.avg(own), F.var_pop(own)).first()
    mean = 0.0 if mean is None else mean
    weight = mean * (1 - mean) / var - 1 if var else PRIOR
    weight = max(weight, 0.0)
    return hosts.withColumn("rate", (F.col("failed") + mean * weight) / (F.col("n") + weight)) if weight else hosts.withColumn("rate", own)


def judge(docs: DataFrame, text: str, host: str, keep: dict[str, str]) -> DataFrame:
    """measured()'s columns, base_failed, host_rate and kept.

    A document that fails the base rules goes. One that fails only soft rules goes if its host is bad, where hosts are
    judged by the share of documents that fail any rule, shrunk to the corpus's. The null host is a host of its own.
    Repeated rows count each for itself; an empty table gives no rows; extra columns aren't read. The measures are
    written once; the join back leaves the rows of few or heavy hosts where they are.
    """
    m = written(measured(docs, text, keep | {"__host": host}), "quality")
    m = m.withColumn("base_failed", base_failed()).withColumn("__soft", soft_failed())
    m = m.withColumn("__host", F.struct(F.col("__host").cast("string")))
    rates = host_rates(m.select("__host", (F.col("base_failed") | F.col("__soft")).alias("fails")))
    rates = written(rates.select("__host", F.col("rate").alias("host_rate"), F.col("n").alias("copies")), "hosts")
    joined = rejoined(m, rates, ["__host"]).drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("__soft") & (F.col("host_rate") > BAD_HOST)))


def passed(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """docs that judge() keeps. What it rejects is found again by doc_id and a hash of the text; rows equal in both are judged alike."""
    a, b = (fresh(docs.columns, x) for x in ("__a", "__b"))
    marked = docs.withColumns({a: F.col(doc_id), b: F.xxhash64(F.col(text).cast("string"))})
    ka, kb = (fresh(marked.columns, x) for x in ("__ka", "__kb"))
    verdicts = judge(marked, text, host, {ka: a, kb: b})
    gone = small(written(verdicts.where(~F.col("kept")).select(ka, kb).distinct(), "rejected"))
    return marked.join(gone, F.col(a).eqNullSafe(F.col(ka)) & F.col(b).eqNullSafe(F.col(kb)), "left_anti").select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document, with source as host; see judge for nulls, empty texts and repeated rows."""
    out = judge(table(spark, sf_dir, "documents"), "text", "source", {"doc_id": "doc_id"})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS soft FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS f FROM v GROUP BY source),
p AS (SELECT avg(f / n) AS a, var_pop(f / n) AS s FROM h),
q AS (SELECT a, greatest(CASE WHEN s > 0 THEN a * (1 - a) / s - 1 ELSE 10 END, 0) AS k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (soft AND (f + a * k) / (n + k) > 0.5) AS kept
FROM v JOIN h ON v.source IS NOT DISTINCT FROM h.source, q
"""
