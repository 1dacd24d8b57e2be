"""Bootstrap intervals over units (donors, panels) from a plan table of draws.

A plan has one row per draw and unit with the number of times the unit is drawn. Plans come from a hash of (draw, position), which
any engine reproduces. Values meet the plan by unit, each draw is one grouped sum. Percentiles are over draws, of which there are as
many as the plan's parameter says, however many units there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio
from panelshift.operators.ordering import hash_numbered


def hashed_plan(units: DataFrame, unit: str, by: list[str], draws: int) -> DataFrame:
    """(by, draw, unit, times): in every draw each of the group's n units picks the unit numbered md5(draw|number) mod n, generated in parallel.

    Units are numbered from 0 in the order of the md5 of their name, then of the name. Repeated units count once, NULL units and groups are left out.
    """
    named = units.select(*by, unit).dropna().distinct()
    numbered = hash_numbered(named, by, F.md5(F.col(unit).cast("string")), unit, "_no").join(named.groupBy(*by).agg(F.count("*").alias("_n")), by).withColumn("_no", F.col("_no") - 1)
    spread = numbered.repartition(numbered.sparkSession.sparkContext.defaultParallelism)  # few units make many draws
    picks = spread.select(*by, "_no", "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("_no").cast("string"))), 1, 8), 16, 10).cast("long")
    chosen = picks.withColumn("_pick", hashed % F.col("_n")).groupBy(*by, "draw", F.col("_pick").alias("_no")).agg(F.count("*").alias("times"))
    return chosen.join(numbered.select(*by, unit, "_no"), [*by, "_no"]).drop("_no")


def draw_means(values: DataFrame, plan: DataFrame, by: list[str], unit: str, columns: list[str]) -> DataFrame:
    """Per group and draw the mean of each column; NULL when a drawn unit has none."""
    joined = plan.join(values.select(*by, unit, *columns), [*by, unit])
    return joined.groupBy(*by, "draw").agg(*[F.when(F.count(F.when(F.col(c).isNull(), 1)) == 0, ratio(F.sum(F.col(c) * F.col("times")), F.sum("times"))).alias(c) for c in columns])


def draw_ratios(values: DataFrame, plan: DataFrame, by: list[str], unit: str, numerator: str, denominator: str, out: str) -> DataFrame:
    """Per group and draw the ratio of two drawn sums (not the mean of ratios); NULL where the denominator is 0."""
    joined = plan.join(values.select(*by, unit, numerator, denominator), [*by, unit])
    return joined.groupBy(*by, "draw").agg(ratio(F.sum(F.col(numerator) * F.col("times")), F.sum(F.col(denominator) * F.col("times"))).alias(out))


def percentile_intervals(values: DataFrame, draws: DataFrame, by: list[str], columns: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Per group and column: the estimate over all units and the linear percentile interval over draws; NULL if any draw is."""
    stacked = F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns]))
    point = values.select(*by, stacked).groupBy(*by, "measure").agg(F.when(F.count("x") == F.count("*"), F.avg("x")).alias("estimate"))
    ends = draws.select(*by, stacked).groupBy(*by, "measure").agg(F.when(F.count("x") == F.count("*"), F.percentile("x", F.array(F.lit(low), F.lit(high)))).alias("_e"), F.count("*").alias("draws"))
    return point.join(ends, [*by, "measure"], "left").select(*by, "measure", "estimate", F.col("_e")[0].alias("lower"), F.col("_e")[1].alias("upper"), "draws")


def simultaneous_band(values: DataFrame, draws: DataFrame, by: list[str], columns: list[str], level: float = 0.95) -> DataFrame:
    """Joint band of several means: estimate -/+ q * SE, where q is the level's quantile over draws of the largest studentised deviation.

    SE is that of the original units. Constant columns have SE 0, take no part in q and get an interval of one point.
    """
    stacked = F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns]))
    point = values.select(*by, stacked).groupBy(*by, "measure").agg(F.avg("x").alias("estimate"), F.coalesce(F.stddev_samp("x") / F.sqrt(F.count("x")), F.lit(0.0)).alias("se"))
    deviation = draws.select(*by, "draw", stacked).join(point, [*by, "measure"]).withColumn("_t", F.when(F.col("se") > 0, F.abs(F.col("x") - F.col("estimate")) / F.col("se")))
    largest = deviation.groupBy(*by, "draw").agg(F.max("_t").alias("_t")).groupBy(*by).agg(F.percentile("_t", level).alias("critical"))
    return point.join(largest, by, "left").withColumns({"lower": F.col("estimate") - F.coalesce("critical", F.lit(0.0)) * F.col("se"), "upper": F.col("estimate") + F.coalesce("critical", F.lit(0.0)) * F.col("se")})


def ratio_intervals(values: DataFrame, plan: DataFrame, by: list[str], unit: str, numerator: str, denominator: str) -> DataFrame:
    """Per group: the ratio of sums, its standard error from the units' influence, the percentile interval over draws, and how many draws have no ratio.

    A unit's influence is (numerator - ratio * denominator) over the mean denominator. Undefined draws are counted and take no part in the interval.
    """
    whole = values.groupBy(*by).agg(ratio(F.sum(numerator), F.sum(denominator)).alias("estimate"), F.count("*").alias("_n"), F.sum(denominator).alias("_d"))
    spread = values.join(whole, by).groupBy(*by).agg(F.sum(F.pow(F.col(numerator) - F.col("estimate") * F.col(denominator), 2)).alias("_s"))
    draws = draw_ratios(values, plan, by, unit, numerator, denominator, "_x")
    ends = draws.groupBy(*by).agg(F.percentile("_x", F.array(F.lit(0.025), F.lit(0.975))).alias("_e"), F.count("*").alias("draws"), F.count_if(F.col("_x").isNull()).alias("undefined_draws"))
    se = ratio(F.sqrt(F.col("_s") * ratio(F.col("_n"), F.col("_n") - 1)), F.col("_d"))
    return whole.join(spread, by).join(ends, by, "left").select(*by, "estimate", se.alias("se"), F.col("_e")[0].alias("lower"), F.col("_e")[1].alias("upper"), "draws", "undefined_draws")


def selection_optimism(values: DataFrame, draws: DataFrame, by: list[str], options: list[str]) -> DataFrame:
    """Per group: the option with the greatest mean (the first of equal ones), that mean, its optimism and the mean corrected by it.

    In every draw the best option is chosen anew; the optimism is the mean, over draws, of what the chosen one has there more than over all units.
    """
    point = values.groupBy(*by).agg(*[F.avg(o).alias(f"_p_{o}") for o in options])
    greatest = F.greatest(*[F.col(f"_p_{o}") for o in options])
    named = F.coalesce(*[F.when(F.col(f"_p_{o}") == greatest, F.lit(o)) for o in options])
    best = F.greatest(*[F.round(o, 12) for o in options])
    gain = F.coalesce(*[F.when(F.round(o, 12) == best, F.col(o) - F.col(f"_p_{o}")) for o in options])
    optimism = draws.join(point, by).groupBy(*by).agg(F.avg(gain).alias("optimism"))
    return point.join(optimism, by).select(*by, named.alias("chosen"), greatest.alias("apparent"), "optimism", (greatest - F.col("optimism")).alias("corrected"))
