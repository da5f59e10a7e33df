"""Versioned tables: a version is visible once its manifest is written, and readers see whole versions only.

A version holds one Parquet folder per table. Tables can be replaced as a whole by each version (``read``) or grow by it
(``read_all``: the union of all versions), so that an append writes its own rows only. Manifests are small JSON files
with the version's tables, its name and its notes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import shuffles_dropped


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """Manifests of the committed versions, oldest first: ``version, tables, name`` and the notes."""
    numbers = versions(spark, path)
    if not numbers:
        return []
    rows = spark.read.text([f"{path}/manifest/{n}" for n in numbers], wholetext=False).collect()  # one line a version
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["version"])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    names = [s.getPath().getName() for s in system.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS")))


def write_part(spark: SparkSession, path: str, version: int, table: str, df: DataFrame, folder: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Writes one table of a version that isn't visible yet (``append``: more of it), and reads it back; ``folder`` is its folder column."""
    writer = df.write.mode(mode).option("compression", "zstd")
    at = f"{path}/data/{table}/version={version}"
    with shuffles_dropped(spark):
        (writer.partitionBy(folder) if folder else writer).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def publish(spark: SparkSession, path: str, version: int, tables: list[str], name: str = "", **notes) -> None:
    """Writes the manifest of a version, which makes all of its tables visible at once."""
    line = json.dumps({"version": version, "tables": sorted(tables), "name": name} | notes)
    spark.range(1, numPartitions=1).select(F.lit(line).alias("value")).write.mode("overwrite").text(f"{path}/manifest/{version}")


def next_version(spark: SparkSession, path: str) -> int:
    return (versions(spark, path) or [0])[-1] + 1


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], name: str = "", partition_by: dict[str, str] | None = None, **notes) -> int:
    """Writes all tables of the next version, then its manifest; a failure before that leaves the last version.

    ``name`` tells what the version is (a migration or batch that may be run once only), ``partition_by`` the folder column of
    a table; further arguments are kept as notes.
    """
    version = next_version(spark, path)
    for table, df in tables.items():
        write_part(spark, path, version, table, df, (partition_by or {}).get(table))
    publish(spark, path, version, list(tables), name, **notes)
    return version


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table of one version, the last by default."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or ''} at {path}")
    return spark.read.parquet(f"{path}/data/{name}/version={version or known[-1]}")


def read_all(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of a growing table in all committed versions; empty where there are none."""
    held = [m["version"] for m in manifests(spark, path) if name in m["tables"]]
    if not held:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data/{name}").parquet(*[f"{path}/data/{name}/version={v}" for v in held])
    return rows.drop("version")
