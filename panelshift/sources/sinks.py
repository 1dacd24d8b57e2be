"""Writers: ordered exports and schema-checked appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, path: str, order: list[str], partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Range-partition by `order` and sort inside each file, so that files in name order are globally sorted."""
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists", separator: str = ",", compression: str = "none", null: str = "") -> None:
    """CSV with header; doubles keep all their digits. NULL is written as `null`; while that is the empty text, empty texts are read back as NULL."""
    doubles = {c: F.when(F.col(c).isNotNull(), F.format_string("%.17g", F.col(c))) for c, kind in df.dtypes if kind == "double"}
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(doubles)
    ordered.write.mode(mode).option("header", True).option("sep", separator).option("compression", compression).option("nullValue", null).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_lines(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """One JSON object a line, compressed; NULL fields are written as null."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("compression", "gzip").option("ignoreNullFields", False).json(path)


def append_checked(df: DataFrame, path: str) -> None:
    """Append to an existing table only when names and types agree with it."""
    there = df.sparkSession.read.parquet(path)
    if sorted(there.dtypes) != sorted(df.dtypes):
        raise ValueError("the table at the target has another schema")
    df.select(*there.columns).write.mode("append").parquet(path)
