"""Changes between full snapshots: validity intervals of (key, state) and the events at their ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, snapshot: str, keys: list[str], loaded_at: str, values: list[str]) -> DataFrame:
    """One row per snapshot and key, the one loaded last; of rows loaded at the same time the greatest values, NULL below all.

    Rows with a NULL snapshot or key are left out. A NULL load time counts as the earliest.
    """
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [snapshot, *keys]])
    last = F.max(F.struct(F.col(loaded_at).alias("_at"), *[F.col(v).alias(v) for v in values])).alias("_last")
    return df.filter(there).groupBy(snapshot, *keys).agg(last).select(snapshot, *keys, *[F.col(f"_last.{v}") for v in values])


def same_value(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """NULL equals NULL and NaN equals NaN, neither equals anything else; numbers may differ by the tolerance."""
    near = F.coalesce(~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= tolerance), F.lit(False)) if tolerance else F.lit(False)
    return a.eqNullSafe(b) | near


def snapshot_numbers(snapshots: DataFrame, snapshot: str) -> DataFrame:
    """Every snapshot of the table once (one row each, so the unpartitioned window is small), numbered in order from 1."""
    return snapshots.select(snapshot).filter(F.col(snapshot).isNotNull()).distinct().withColumn("_no", F.row_number().over(Window.orderBy(snapshot)))


def validity_intervals(rows: DataFrame, snapshots: DataFrame, snapshot: str, keys: list[str], exact: list[str], near: dict[str, float]) -> DataFrame:
    """Gaps and islands: one row per key and run of consecutive snapshots in which its state stays the same.

    `rows` has one row per snapshot and key in which the key is there; `snapshots` names every snapshot, once or more,
    also those without any row left. Two neighbours are alike when their row hashes
    agree, or else every `exact` column agrees and every `near` column does within its tolerance. Columns: keys, first and
    last (snapshot), first_no and last_no (their numbers in order from 1), of_no (number of snapshots).
    """
    with_no = rows.join(F.broadcast(snapshot_numbers(snapshots, snapshot)), snapshot)
    line = Window.partitionBy(*keys).orderBy("_no")
    state = [*exact, *near]
    hashed = with_no.withColumn("_hash", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in state]))
    old = hashed.withColumns({f"_old_{c}": F.lag(c).over(line) for c in ["_no", "_hash", *state]})
    alike = reduce(lambda a, b: a & b, [same_value(F.col(c), F.col(f"_old_{c}")) for c in exact] + [same_value(F.col(c), F.col(f"_old_{c}"), t) for c, t in near.items()])
    goes_on = F.coalesce(F.col("_old__no") == F.col("_no") - 1, F.lit(False)) & ((F.col("_hash") == F.col("_old__hash")) | alike)
    islands = old.withColumn("_island", F.sum((~goes_on).cast("int")).over(line))
    return islands.groupBy(*keys, "_island").agg(
        F.min(snapshot).alias("first"), F.max(snapshot).alias("last"), F.min("_no").alias("first_no"), F.max("_no").alias("last_no")
    ).drop("_island")


def change_events(intervals: DataFrame, snapshots: DataFrame, snapshot: str, keys: list[str]) -> DataFrame:
    """ADDED, REMOVED and CHANGED per key and pair of consecutive snapshots, from where intervals start, end and adjoin.

    Nothing is added in the first snapshot or removed after the last one.
    """
    pairs = snapshot_numbers(snapshots, snapshot).withColumns({"_before": F.lag(snapshot).over(Window.orderBy(snapshot)), "_after": F.lead(snapshot).over(Window.orderBy(snapshot))})
    line = Window.partitionBy(*keys).orderBy("first")
    ends = intervals.withColumns({"_old_last": F.lag("last").over(line), "_new_first": F.lead("first").over(line)})
    at_start = F.broadcast(pairs.select(F.col(snapshot).alias("first"), F.col("_before").alias("_b")))
    at_end = F.broadcast(pairs.select(F.col(snapshot).alias("last"), F.col("_after").alias("_a")))
    placed = ends.join(at_start, "first", "left").join(at_end, "last", "left")
    start = F.when(F.col("_b").isNotNull(), F.struct(F.col("_b").alias("old"), F.col("first").alias("new"), F.when(F.col("_old_last").eqNullSafe(F.col("_b")), "CHANGED").otherwise("ADDED").alias("kind")))
    gone = F.col("_a").isNotNull() & ~F.col("_new_first").eqNullSafe(F.col("_a"))
    end = F.when(gone, F.struct(F.col("last").alias("old"), F.col("_a").alias("new"), F.lit("REMOVED").alias("kind")))
    return placed.select(*keys, F.explode(F.array_compact(F.array(start, end))).alias("_e")).select(
        F.col("_e.old").alias("old_release"), F.col("_e.new").alias("new_release"), *keys, F.col("_e.kind").alias("change_kind")
    )
