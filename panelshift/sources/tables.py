"""Contracted access to the Parquet tables: a query names the columns it needs and fails early if one is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(folder: str, name: str) -> str:
    return f"{folder}/{name}.parquet"


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raise when a column is missing; further columns are allowed."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(folder, name))
    return require_columns(df, columns).select(*columns) if columns else df


def read_rows(spark: SparkSession, path: str, schema=None, null: str = "") -> DataFrame:
    """Parquet, JSON lines, CSV or TSV by suffix, compressed or not; text formats want an explicit schema. Fields of separated texts that read `null` are NULL."""
    kind = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(path)
    if kind in ("json", "jsonl"):
        return reader.option("mode", "FAILFAST").json(path)
    if kind in ("csv", "tsv", "txt"):
        separator = {"csv": ",", "tsv": "\t", "txt": " "}[kind]
        return reader.option("header", True).option("sep", separator).option("nullValue", null).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    raise ValueError(f"unknown format: {path}")


def release_union(spark: SparkSession, parts: dict[str, str], renames: dict[str, dict[str, str]]) -> DataFrame:
    """One table from one Parquet folder per release; `renames` maps, per release, a stored column name to the common one."""
    frames = [
        spark.read.parquet(path).withColumnsRenamed(renames.get(release, {})).withColumn("release_id", F.lit(release)).withColumn("source_file", F.col("_metadata.file_path"))
        for release, path in sorted(parts.items())
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def violations(df: DataFrame, condition) -> int:
    """Rows for which `condition` is not true."""
    return df.filter(~F.coalesce(condition, F.lit(False))).count()


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which each condition is not true, all rules in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(condition, F.lit(False))).alias(name) for name, condition in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])))
