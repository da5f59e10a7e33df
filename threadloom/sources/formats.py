"""Files of other formats: JSON lines, JSON arrays, one-key objects, checked CSV, digests, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; a malformed line fails the read. Only line feeds end a line, so U+2028 may be text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Compact objects with keys in column order; an existing target is an error unless told otherwise."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path, lineSep="\n")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that are one array each; a file is read by one task."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_keyed_lines(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Lines of one-key objects as ``key, value``; a line with several keys gives several rows."""
    parsed = spark.read.text(path, lineSep="\n").select(F.from_json("value", f"map<string, {value}>", {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))


def read_csv_checked(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> DataFrame:
    """CSV with a header; missing required columns are an error before anything is read."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).schema(schema).csv(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file; each file is digested where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_digests(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (name, sha256) that no file has, and files that were not expected."""
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    gone = expected.select("name", "sha256").join(named, ["name", "sha256"], "left_anti").withColumn("problem", F.lit("missing or changed"))
    extra = named.join(expected.select("name"), "name", "left_anti").withColumn("problem", F.lit("unexpected"))
    return gone.unionByName(extra)


def selected(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for; a key that occurs twice among them is an error when the result is read."""
    kept = rows.join(ids.select(key).distinct(), key, "left_semi")
    twice = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n__"))
    return kept.join(twice, key).where(F.when(F.col("n__") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("n__")
