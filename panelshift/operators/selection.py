"""Exact per-key ranks by histogram refinement, whatever the number of rows a key has.

Equal (key, value) rows are merged to one row with a count first, so heavy ties cost nothing. Each round counts values
into bins and keeps, for each key and wanted rank, only the bin that holds the rank; the next round splits that bin.
A bin is settled when its smallest and largest value are equal. No task ever sees all values of a key: the rows that
travel between rounds are bins, joined on key, bin and salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelshift.functions.scalars import is_finite
from panelshift.session import cut_lineage

#: First round: bins per power of two. Later rounds: bins between the ends of a bin.
PER_OCTAVE, SPLIT = 64, 1024
#: Distinct (key, value) rows of a bin that meet it under one salt.
PER_SALT = 1_000_000


def _first_bin(v):
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + F.lit(80_000)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise((F.signum(v) * size).cast("long"))


def per_key_ranks(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float] | None = None, cuts: dict[str, float] | None = None) -> DataFrame:
    """One row per key: `keys`, n_rows, n_values, one DOUBLE per quantile, one BIGINT per cut.

    n_rows counts all rows of the key, n_values those with a finite value (NULL, NaN and infinities are no values).
    A quantile q is the value of rank ceil(q * n_values) in ascending order (at least 1), NULL for a key without values.
    A cut is the number of values at or above it. NULL is a key like any other; an empty table gives no rows.
    Ties and repeated rows count as often as they occur; other columns are ignored.
    """
    quantiles, cuts = quantiles or {}, cuts or {}
    names = [f"_k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    data = cut_lineage(
        df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.when(is_finite(v), v + F.lit(0.0)).alias("_v"))
        .groupBy(*names, "_v").agg(F.count("*").alias("_n"))
        .withColumn("_bin", _first_bin(F.col("_v")))
    )
    histogram = (
        data.groupBy(*names, "_bin").agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    found = F.col("_bin").isNotNull()
    totals = histogram.groupBy(*names).agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(found, F.col("_n"))), F.lit(0)).alias("n_values"),
        *[F.coalesce(F.sum(F.when(found & (F.col("_lo") >= c), F.col("_n"))), F.lit(0)).alias(f"_base_{n}") for n, c in cuts.items()],
    )

    settled: list[DataFrame] = []
    wanted = [F.struct(F.lit(n).alias("_t"), F.lit(float(q)).alias("_q"), F.lit(None).cast("double").alias("_cut")) for n, q in quantiles.items()]
    wanted += [F.struct(F.lit(n).alias("_t"), F.lit(None).cast("double").alias("_q"), F.lit(float(c)).alias("_cut")) for n, c in cuts.items()]
    if wanted:
        along = Window.partitionBy(*names).orderBy("_bin")
        whole = Window.partitionBy(*names)
        bins = (
            histogram.filter(found)
            .withColumn("_before", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_all", F.sum("_n").over(whole))
            .withColumn("_w", F.explode(F.array(*wanted)))
            .select(*names, "_bin", "_n", "_d", "_lo", "_hi", "_before", "_w._t", "_w._cut", F.greatest(F.lit(1), F.ceil(F.col("_w._q") * F.col("_all"))).cast("long").alias("_rank"))
        )
        active = cut_lineage(_holding(bins).select(*names, "_t", "_cut", "_bin", "_n", "_d", "_lo", "_hi", (F.col("_rank") - F.col("_before")).alias("_rank")))
        rows = data
        on = [*names, "_bin"]
        while True:
            done = F.when(F.col("_cut").isNull(), F.col("_lo") == F.col("_hi")).otherwise(F.lit(False))
            settled.append(active.filter(done).select(*names, "_t", F.col("_lo").alias("_result")))
            active = active.filter(~done)
            if active.isEmpty():
                break
            rows, active, cut_part = _refine(rows, active, names, on)
            settled.append(cut_part)
            on = [*names, "_t", "_bin"]

    if not wanted:
        return totals.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n_rows", "n_values")
    results = reduce(DataFrame.unionByName, settled).groupBy(*names).agg(*[F.sum(F.when(F.col("_t") == n, F.col("_result"))).alias(f"_r_{n}") for n in [*quantiles, *cuts]])
    renamed = results.withColumnsRenamed({n: f"{n}r" for n in names})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names])
    return totals.join(renamed, same, "left").select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)], "n_rows", "n_values",
        *[F.col(f"_r_{n}").alias(n) for n in quantiles],
        *[(F.col(f"_base_{n}") + F.coalesce(F.col(f"_r_{n}"), F.lit(0))).cast("long").alias(n) for n in cuts],
    )


def _holding(bins: DataFrame) -> DataFrame:
    """Of each key and target the one bin that holds the wanted rank, or that the cut runs through."""
    rank = (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))
    through = (F.col("_lo") < F.col("_cut")) & (F.col("_cut") <= F.col("_hi"))
    return bins.filter(F.when(F.col("_cut").isNull(), rank).otherwise(through))


def _refine(rows: DataFrame, active: DataFrame, names: list[str], on: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split each active bin: the rows in it, the smaller active bins, and what the cuts gain from bins wholly above them.

    Salts follow the fullest active bin, a number that the bins' counts give, so no salt of any bin holds more than PER_SALT rows on average.
    """
    salts = F.lit(1 + (active.agg(F.max("_d")).first()[0] or 0) // PER_SALT)
    spread = active.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(*[F.col(n).alias(f"{n}r") for n in names], F.col("_t").alias("_tr"), F.col("_bin").alias("_binr"), "_salt", "_cut", "_lo", "_hi", "_rank")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in on])
    joined = rows.withColumn("_salted", F.pmod(F.xxhash64("_v"), salts).cast("int")).join(spread, same & (F.col("_salted") == F.col("_salt")))
    place = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (SPLIT - 1))
    inside = joined.select(*names, F.col("_tr").alias("_t"), "_v", "_n", place.alias("_bin"), "_cut", "_rank")
    kept = cut_lineage(inside)
    histogram = kept.groupBy(*names, "_t", "_bin").agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_cut").alias("_cut"), F.first("_rank").alias("_rank"))
    along = Window.partitionBy(*names, "_t").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    above = bins.filter(F.col("_cut").isNotNull() & (F.col("_lo") >= F.col("_cut"))).groupBy(*names, "_t").agg(F.sum("_n").cast("double").alias("_result"))
    smaller = cut_lineage(_holding(bins).select(*names, "_t", "_cut", "_bin", "_n", "_d", "_lo", "_hi", (F.col("_rank") - F.col("_before")).alias("_rank")))
    return kept.select(*names, "_t", "_v", "_n", "_bin"), smaller, above


def linked_partners(links: DataFrame, scope: str, left: str, right: str, score: str) -> DataFrame:
    """Undirected links as (scope, node, partner, best score), one row per node and other node of a scope.

    Links with a NULL end or scope and self links are left out; of repeated and opposite rows the best score holds.
    """
    pairs = (
        links.filter(F.col(left) != F.col(right))
        .select(F.col(scope).alias("scope"), F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), F.col(score).alias("score"))
        .filter(F.col("scope").isNotNull())
        .groupBy("scope", "a", "b").agg(F.max("score").alias("score"))
    )
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("partner")), F.struct(F.col("b").alias("node"), F.col("a").alias("partner")))
    return pairs.select("scope", "score", F.inline(both))


def key_shares(df: DataFrame, scope: str, key: str, value: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Each key's rows, its share of the scope's rows (rows with a NULL key are in the total) and value quantiles.

    Without quantiles there is no rank to resolve: a key's rows are the total of its histogram, which partial sums give at once.
    """
    ranks = per_key_ranks(df, [scope, key], value, quantiles) if quantiles else df.groupBy(scope, key).agg(F.count("*").alias("n_rows"))
    total = ranks.groupBy(F.col(scope).alias("_scope")).agg(F.sum("n_rows").alias("_total"))
    return ranks.join(total, F.col(scope).eqNullSafe(F.col("_scope"))).withColumn("share", F.col("n_rows") / F.col("_total")).drop("_scope", "_total")
