"""Running sums and row numbers in an order, without gathering all rows of a key in one task.

The order is cut into ranges; ranges are summed first, their prefix sums are small, and each range is finished on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a hash order is cut into.
RANGES = 4096
#: Ranges per power of two that numbers are cut into, and the number that keeps the least of them above 0.
PER_OCTAVE, LEAST_OCTAVE = 1024, 1_200_000


def value_range(v: Column) -> Column:
    """A whole number that grows with a finite value; values of one range differ by less than a thousandth, whatever their size."""
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + F.lit(LEAST_OCTAVE)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise((F.signum(v) * size).cast("long"))


def null_safe(left: list[str], right: list[str]) -> Column:
    """Equality of two lists of columns in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def joined_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """`left` joined with the further columns of `right` on keys of which NULL is one like any other."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(other, null_safe(keys, [f"_right_{k}" for k in keys]), how).drop(*[f"_right_{k}" for k in keys])


def running_sum(df: DataFrame, keys: list[str], part: str, order: list[str], size: str, out: str) -> DataFrame:
    """`out`: the sum of `size` over the rows of the key up to each row, in the order of `part`, then `order`. NULL keys are keys."""
    sums = df.groupBy(*keys, part).agg(F.sum(size).alias("_s"))
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_o_{k}") for k in [*keys, part]], F.coalesce(F.sum("_s").over(along), F.lit(0)).alias("_offset"))
    same = null_safe([*keys, part], [f"_o_{k}" for k in [*keys, part]])
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, same).withColumn(out, F.col("_offset") + F.sum(size).over(inside)).drop("_offset", *[f"_o_{k}" for k in [*keys, part]])


def hash_numbered(df: DataFrame, keys: list[str], digest: Column, item: str, out: str) -> DataFrame:
    """`out`: the row's number from 1 within its key, in the order of the hexadecimal `digest`, then `item`."""
    placed = df.withColumns({"_digest": digest, "_one": F.lit(1).cast("long")}).withColumn("_part", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    return running_sum(placed, keys, "_part", ["_digest", item], "_one", out).drop("_digest", "_one", "_part")


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per key with a value in any of the columns: keys, and per entry of `wanted` (column, level) that quantile.

    Quantiles interpolate linearly between the two values next to their place; NULL, NaN and infinities are no values, a key
    without values in a column has NULL there. Equal values are merged to one with a count first, counts per range of values
    say which ranges hold the wanted places, and only values of these ranges are ordered, each range on its own. No task holds
    the values of a key, several columns cost one pass, and NULL keys are keys.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    pairs = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    finite = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < F.lit(float("inf")))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.inline(pairs)).filter(finite).withColumn("_v", F.col("_v") + F.lit(0.0))
    cells = rows.groupBy(*names, "_c", value_range(F.col("_v")).alias("_range"), "_v").agg(F.count("*").alias("_n"))
    sums = cells.groupBy(*names, "_c", "_range").agg(F.sum("_n").alias("_m"))
    whole = Window.partitionBy(*names, "_c")
    places = F.array(*[F.struct(F.lit(out).alias("_out"), F.lit(columns.index(c)).alias("_of"), F.lit(float(q)).alias("_q")) for out, (c, q) in wanted.items()])
    placed = sums.withColumns({"_before": F.sum("_m").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"), "_all": F.sum("_m").over(whole)})
    each = placed.select("*", F.inline(F.filter(places, lambda x: x["_of"] == F.col("_c")))).withColumn("_place", F.col("_q") * (F.col("_all") - 1))
    low, high = F.floor("_place"), F.ceil("_place")

    def within(start: Column, size: Column, place: Column) -> Column:
        return (start <= place) & (place < start + size)

    before = F.col("_before")
    held = each.withColumns({"_low": low, "_high": high}).filter(within(before, F.col("_m"), F.col("_low")) | within(before, F.col("_m"), F.col("_high")))
    by = [*names, "_c", "_range"]
    near = joined_on(cells, held.select(*by, "_out", "_before", "_low", "_high", "_place"), by, "inner")
    start = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_out").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ends = near.withColumn("_start", start).groupBy(*names, "_out").agg(
        F.max(F.when(within(F.col("_start"), F.col("_n"), F.col("_low")), F.col("_v"))).alias("_a"), F.max(F.when(within(F.col("_start"), F.col("_n"), F.col("_high")), F.col("_v"))).alias("_b"),
        F.max(F.col("_place") - F.col("_low")).alias("_part"),
    )
    value = F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))
    return ends.groupBy(*names).agg(*[F.max(F.when(F.col("_out") == out, value)).alias(out) for out in wanted]).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *wanted)


def with_quantiles(sums: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """`sums`, one row per key, with the `exact_quantiles` of the rows `df` that it sums."""
    return joined_on(sums, exact_quantiles(df, keys, wanted), keys)
