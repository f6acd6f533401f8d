"""Sources and sinks of records: JSON arrays and lines, key=value configurations, dumps, compile databases, event logs, text trees."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import configs as rows_of_configs


def ragged(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = False, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the JSON records below a path whose files may differ: one object or array per line, or one array over many lines. rejects: file, text, why.

    How a file is read is decided for each by its first line that isn't blank: if that opens an array which it doesn't close, the file is read whole, else by lines, so that a file
    of any size is dealt out. What is no object, no JSON, or has a value of another type than the stated schema's, is a reject; blank lines are skipped. ``lenient``: a path that
    isn't there gives no rows instead of an error. The paths of files that are read whole go through the driver, as all paths of a table do in Spark.
    """
    kinds = "file string, text string, why string"
    reader = spark.read.option("recursiveFileLookup", recursive)
    try:
        lines = reader.text(path)
    except AnalysisException as e:
        if lenient and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema), spark.createDataFrame([], kinds)
        raise
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.trim("value").alias("value")).where("value <> ''")
    first = lines.where("at = 0").withColumn("id", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "id").alias("head"))
    whole = first.where(F.col("head").startswith("[") & ~F.col("head").endswith("]")).select("file")
    paths = [re.sub(r"([\[\]{}*?\\\\])", r"\\\1", unquote(r["file"])) for r in whole.collect()]
    values = lines.select("file", "value")
    if paths:
        again = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"))
        values = values.join(whole, "file", "left_anti").unionByName(again)
    inside = F.from_json("value", T.ArrayType(T.StringType()))
    items = F.when(F.col("value").startswith("["), F.coalesce(inside, F.array("value"))).otherwise(F.array("value"))
    items = values.select("file", F.explode(items).alias("text"))
    typed = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    parsed = items.withColumn("r", F.when(F.col("text").startswith("{"), F.from_json("text", typed, {"columnNameOfCorruptRecord": "__bad"})))
    good = F.col("r").isNotNull() & F.col("r.__bad").isNull()
    why = F.when(F.col("text").startswith("{") | F.col("text").startswith("["), "not JSON of this schema").otherwise("not an object")
    return parsed.where(good).select("r.*").drop("__bad"), parsed.where(~good).select("file", "text", why.alias("why"))


def records(spark: SparkSession, path: str, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """The rows of ragged(), without the rejects."""
    return ragged(spark, path, schema, lenient)[0]


def write_records(rows: DataFrame, path: str) -> None:
    """One JSON object per line, its keys sorted."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.text(path)


def whole_number(text: Column) -> Column:
    """Decimal, 0x and octal numbers with a sign; null for all else."""
    digits, sign = F.regexp_replace(text, "^[+-]", ""), F.when(text.startswith("-"), -1).otherwise(1)
    based = lambda pattern, skip, base: F.when(digits.rlike(pattern), F.conv(F.substring(digits, skip + 1, 40), base, 10).try_cast("bigint"))
    return sign * F.coalesce(based("^0[xX][0-9a-fA-F]+$", 2, 16), based("^0[0-7]+$", 1, 8), F.when(digits.rlike("^(?:0|[1-9][0-9]*)$"), digits.try_cast("bigint")))


def configs(spark: SparkSession, path: str, fields: Sequence[str], normalise: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of key=value files with # comments: a row per file; rejects: file, line, why.

    The last value of a key counts. ``normalise``: fields that a file lacks have their defaults, and all are put into their normal form.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    clean = text.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("raw <> ''")
    parts = F.split("raw", "=", -1)
    pairs = clean.select("file", (F.col("line") + 1).alias("line"), F.trim(parts[0]).alias("key"), whole_number(F.trim(F.get(parts, F.lit(1)))).alias("value"), (F.size(parts) == 2).alias("good"))
    known = F.col("key").isin(*fields)
    fine = known & F.col("value").isNotNull() & F.col("good")
    rows = pairs.where(fine).groupBy("file").pivot("key", list(fields)).agg(F.max_by("value", "line"))
    if normalise:
        base = rows_of_configs.default()
        rows = rows.select("file", *[F.expr(rows_of_configs.normal(f, f"coalesce({f}, {base[f]})")).cast("bigint").alias(f) if f in base else F.col(f) for f in fields])
    bad = pairs.where(~fine).select("file", "line", F.when(~F.col("good"), "no single =").when(~known, "unknown key").otherwise("not a number").alias("why"))
    return rows, bad


# Fields of a dump that must be there; the others are 0 where they are missing. Constants are signed.
NEEDED = ("arith_opcode", "rhs_mode", "extra_opcode", "predicate", "shape", "feature_bits", "const_a", "const_b")
OPTIONAL = ("memory_shape", "pointer_mode", "store_mode", "load_use_mode", "loop_shape", "loop_trip_mode", "induction_mode", "loop_use_mode", "vector_shape", "global_shape")


def dumps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of symbolic-test dumps, "object N: name|size|data|hex|int: value" by line: a row of fields per file; rejects: file, missing.

    A number counts before bytes in hex, these before bytes as quoted text with escapes. Bytes are little-endian; of quoted ones, more than ``size`` are cut at the front, fewer
    have zeros put before them; hex counts as it is. Constants of ``size`` bytes whose sign bit is set are negative.
    """
    said = F.regexp_extract_all("value", F.lit(r"object\s+\d+:\s*(?:name|size|data|hex|int)\s*:\s*[^\n]*"), F.lit(0))
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode_outer(said).alias("line"))
    part = lambda k: F.regexp_extract("line", r"object\s+(\d+):\s*(name|size|data|hex|int)\s*:\s*(.*?)\s*$", k)
    facts = lines.select("file", part(1).alias("object"), part(2).alias("kind"), part(3).alias("value"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value")))
    objects = facts.groupBy("file", "object").agg(pick("name").alias("name"), pick("size").alias("size"), pick("hex").alias("hex"), pick("data").alias("data"), pick("int").alias("number"))
    objects = objects.withColumn("name", F.regexp_extract("name", "'([^']+)'", 1))
    signed = F.col("name").isin("const_a", "const_b")
    size = F.coalesce(F.col("size").try_cast("int"), F.when(signed, 4).otherwise(1))
    pairs = F.regexp_extract_all(F.regexp_replace("hex", "^0x", ""), F.lit("[0-9a-fA-F]{2}"), F.lit(0))
    quoted = F.regexp_extract_all(F.regexp_replace("data", r"""^b?(['"])(.*)\1$""", "$2"), F.lit(r"\\x[0-9a-fA-F]{2}|\\.|[^\\]"), F.lit(0))
    plain = {r"\n": "0a", r"\r": "0d", r"\t": "09"}

    def byte(x: Column) -> Column:
        out = F.when(F.startswith(x, F.lit(r"\x")), F.substring(x, 3, 2))
        for said, code in plain.items():
            out = out.when(x == said, code)
        return out.otherwise(F.hex(F.right(x, F.lit(1))))

    quoted = F.slice(F.concat(F.array_repeat(F.lit("00"), size), F.transform(quoted, byte)), -size, size)
    pairs = F.coalesce(pairs, quoted)
    from_hex = F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).try_cast("bigint")
    number = F.coalesce(F.col("number").try_cast("bigint"), from_hex)
    whole = F.expr("shiftleft(1L, 8 * __size)")
    objects = objects.withColumn("__size", size)
    value = F.when(signed & (number * 2 >= whole), number - whole).otherwise(number)
    rows = objects.select("file", "name", value.alias("value")).groupBy("file").pivot("name", [*NEEDED, *OPTIONAL]).agg(F.max("value"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in NEEDED]))
    rows = rows.withColumn("missing", missing)
    good = rows.where(F.size("missing") == 0).select("file", *NEEDED, *[F.coalesce(c, F.lit(0)).alias(c) for c in OPTIONAL])
    return good, rows.where(F.size("missing") > 0).select("file", "missing")


def compile_database(spark: SparkSession, path: str) -> DataFrame:
    """file, directory of the entries of a JSON array of compile commands; entries without a file are dropped."""
    return spark.read.schema("file string, directory string, command string").json(path, multiLine=True).where("file is not null").select("file", "directory").distinct()


def append_events(rows: DataFrame, path: str) -> None:
    """One line for each row, its one column as text, appended to a log; nulls are skipped."""
    name = rows.columns[0]
    rows.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("value")).write.mode("append").text(path)


def text_tree(spark: SparkSession, path: str, pattern: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """path, text of files below a folder whose names match, and whose paths have one of ``include`` and none of ``exclude``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    has = lambda words: F.exists(F.lit(list(words)).cast("array<string>"), lambda w: F.contains(F.col("path"), w))
    files = files.where(has(include)) if include else files
    return files.where(~has(exclude)) if exclude else files
