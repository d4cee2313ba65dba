"""Reading the tables, intermediate tables in the shared folder, samplers, and the COPY text format."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; Spark removes it when the application ends."""
    path = f"{shared_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder, so that its lineage ends there."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bernoulli(df: DataFrame, percent: float, *keys: str, seed: int = 0) -> DataFrame:
    """Each row by itself with that chance: the same rows whenever it is repeated.

    A hash of keys decides, or, of a table read from Parquet files without any, of the row's place in its file, so repeated
    rows are taken or left each by itself.
    """
    place = keys or ("_metadata.file_name", "_metadata.row_index")
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *place), F.lit(1 << 30)) < int(percent / 100 * (1 << 30)))


def system(df: DataFrame, percent: float, seed: int = 0, rest: bool = False) -> DataFrame:
    """Whole files with that chance; with rest, the files that are left."""
    taken = F.pmod(F.xxhash64(F.lit(seed), "_metadata.file_path"), F.lit(1 << 30)) < int(percent / 100 * (1 << 30))
    return df.where(~taken if rest else taken)


def system_time(df: DataFrame, milliseconds: float) -> DataFrame:
    """Rows that tasks can read until so long after the query began; a task that starts later reads its first batch alone."""
    import time

    until = time.time() + milliseconds / 1000

    def read(batches):
        for batch in batches:
            yield batch
            if time.time() > until:
                return

    return df.mapInArrow(read, df.schema)


def at_places(df: DataFrame, places: list[int], file: str | None = None) -> DataFrame:
    """Rows by their places from 0 in a table's files, or in one of them."""
    here = F.col("_metadata.row_index").isin(places)
    return df.where(here if file is None else here & (F.col("_metadata.file_name") == file))


def system_rows(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """Exactly n rows (all, if there are fewer): those with the smallest hashes of their keys."""
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *keys)).orderBy("__h", *keys).limit(n).drop("__h")


#: Fixed values of the text format: what a backslash and a letter stand for.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def copy_line(schema: T.StructType, delimiter: str = "\t", null: str = "\\N") -> Column:
    """A row as a line of the text format, from columns of that schema."""

    def field(name: str) -> Column:
        x = F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for letter, c in ESCAPES.items():
            x = F.replace(x, F.lit(c), F.lit("\\" + letter))
        if delimiter not in ESCAPES.values():
            x = F.replace(x, F.lit(delimiter), F.lit("\\" + delimiter))
        return F.coalesce(x, F.lit(null))

    return F.concat_ws(delimiter, *(field(f.name) for f in schema))


#: One escape of the text format: three octal digits at most, x and two hexadecimal ones, or a character.
_ESCAPE = r"\\([0-7]{1,3}|x[0-9A-Fa-f]{1,2}|(?s:.))"


def unescaped(x: Column) -> Column:
    r"""A field of the text format without its escapes: \n and the like, \ooo, \xhh, and any other character for itself."""
    parts = F.regexp_extract_all(x, F.lit(rf"(?s)({_ESCAPE}|[^\\]+|\\)"), 1)

    def plain(p: Column) -> Column:
        body = F.substr(p, F.lit(2))
        code = F.when(body.rlike("^[0-7]+$"), F.conv(body, 8, 10)).when(body.rlike("^x[0-9A-Fa-f]+$"), F.conv(F.substr(body, F.lit(2)), 16, 10)).cast("int")
        out = F.when(code.isNotNull(), F.chr(code)).otherwise(body)
        for letter, c in ESCAPES.items():
            out = F.when(body == letter, F.lit(c)).otherwise(out)
        return F.when(F.startswith(p, F.lit("\\")) & (F.length(p) > 1), out).otherwise(p)

    return F.when(F.contains(x, F.lit("\\")), F.array_join(F.transform(parts, plain), "")).otherwise(x)


def copy_parse(lines: DataFrame, schema: T.StructType, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    r"""Rows from lines (column value) of the text format; a line of \. ends a file and is left out."""
    quoted = "\\Q" + delimiter + "\\E"
    parts = F.split("value", quoted)
    # A delimiter after an odd run of backslashes belongs to the field: such pieces are put together again.
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.length(F.regexp_extract(F.element_at(acc, -1), r"(\\*)$", 1)) % 2 == 1),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.lit(delimiter), x))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    df = lines.where(r"value <> '\\.'").select(joined.alias("f"))

    def field(i: int, f: T.StructField) -> Column:
        raw = F.get(F.col("f"), F.lit(i))
        return F.when(raw != null, unescaped(raw)).cast(f.dataType).alias(f.name)

    return df.select(*(field(i, f) for i, f in enumerate(schema)))


def copy_to(df: DataFrame, path: str, format: str = "text", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None, force_quote: bool = False) -> None:
    """COPY ... TO: files of the text or the CSV format in a folder."""
    if format == "text":
        df.select(copy_line(df.schema, delimiter or "\t", "\\N" if null is None else null).alias("value")).write.text(path)
    elif format == "csv":
        df.write.csv(path, sep=delimiter or ",", nullValue=null or "", emptyValue='""', header=header, quote=quote, escape=escape or quote, quoteAll=force_quote)
    else:
        raise ValueError(f"COPY format {format!r} not recognized")


def copy_from(spark: SparkSession, path: str, schema: T.StructType, format: str = "text", delimiter: str | None = None, null: str | None = None, header: bool = False, quote: str = '"', escape: str | None = None, force_null: tuple[str, ...] = (), force_not_null: tuple[str, ...] = ()) -> DataFrame:
    """COPY ... FROM: rows of files of the text or the CSV format. force_null's empty fields are null even where they are quoted."""
    if format == "text":
        return copy_parse(spark.read.text(path), schema, delimiter or "\t", "\\N" if null is None else null)
    if format != "csv":
        raise ValueError(f"COPY format {format!r} not recognized")
    # A quoted empty field is told from a null by a text that no file has.
    empty = "\x00empty\x00"
    df = spark.read.schema(schema).csv(path, sep=delimiter or ",", nullValue=null or "", emptyValue=empty, header=header, quote=quote, escape=escape or quote, multiLine=True)

    def field(f: T.StructField) -> Column:
        x = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            x = F.when(x == empty, F.lit("")).otherwise(x)
            x = F.when(x != (null or ""), x) if f.name in force_null else x
            x = F.coalesce(x, F.lit(null or "")) if f.name in force_not_null else x
        return x.alias(f.name)

    return df.select(*map(field, schema))


def csv(spark: SparkSession, path: str, schema: T.StructType, force_not_null: tuple[str, ...] = (), **options: str) -> DataFrame:
    """A CSV file by Spark's reader; in force_not_null's columns the null string is empty text."""
    df = spark.read.schema(schema).csv(path, **options)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in force_not_null}) if force_not_null else df


def inherited(parent: list[str], *children: DataFrame) -> DataFrame:
    """A scan of a parent table: its columns of all children, null where a child lacks one."""
    out = children[0]
    for c in children[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.select(*parent)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A remote query; filters, aggregates and limits are pushed down where the source allows it."""
    return spark.read.format("jdbc").options(url=url, query=query, pushDownAggregate="true", pushDownLimit="true", **options).load()
