"""Fractional allocation of a budget over ranked items, and accounting with labels that are partly unknown.

Given scores and a budget k, items above the k-th score weigh 1, items tied there share the slots that are left, others weigh 0. A
weight is kept as a pair of whole numbers (slots, ties), so it is exact; sums use DECIMAL or one division at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio, when_chain
from panelshift.operators.ordering import running_sum
from panelshift.operators.panel import with_ladder


def allocate(items: DataFrame, panel: list[str], score: str, budget: int) -> DataFrame:
    """Items with a weight above 0: num and den (whole numbers), weight (DOUBLE). NULL scores get nothing; a panel with at most `budget` items gives each 1."""
    ranked = with_ladder(items, panel, score)
    slots = F.least(F.greatest(F.lit(budget) - F.col("above"), F.lit(0)), F.col("ties"))
    weighted = ranked.withColumn("num", F.when(slots == F.col("ties"), 1).otherwise(slots).cast("long")).withColumn("den", F.when(F.col("num") == slots, F.when(slots == F.col("ties"), F.lit(1)).otherwise(F.col("ties"))).otherwise(1).cast("long"))
    return weighted.filter("num > 0").withColumn("weight", F.col("num") / F.col("den")).drop("ties", "above", "members", "step")


def cutoff_gap(items: DataFrame, panel: list[str], score: str, budget: int) -> DataFrame:
    """Per panel: the score at the budget's end, the next lower one, and the gap between them (NULL where there is none)."""
    ranked = with_ladder(items, panel, score).select(*panel, score, "above", "ties").distinct()
    at = F.max(F.when(F.col("above") < budget, F.struct((-F.col(score)).alias("s"))))["s"]
    below = F.max(F.when(F.col("above") >= budget, F.col(score)))
    return ranked.groupBy(*panel).agg((-at).alias("cutoff_score"), below.alias("next_score")).withColumn("gap", F.col("cutoff_score") - F.col("next_score"))


def compare_allocations(old: DataFrame, new: DataFrame, panel: list[str], item: str) -> DataFrame:
    """Per panel of either side: both masses, shared, lost and gained mass, half the L1 distance, weighted Jaccard (NULL without mass)."""
    sides = old.select(*panel, item, F.col("weight").alias("o"), F.lit(0.0).alias("n")).unionByName(new.select(*panel, item, F.lit(0.0).alias("o"), F.col("weight").alias("n")))
    each = sides.groupBy(*panel, item).agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    o, n = F.col("o"), F.col("n")
    return each.groupBy(*panel).agg(
        F.sum(o).alias("old_mass"), F.sum(n).alias("new_mass"), F.sum(F.least(o, n)).alias("shared_mass"), F.sum(F.greatest(o - n, F.lit(0.0))).alias("lost_mass"),
        F.sum(F.greatest(n - o, F.lit(0.0))).alias("gained_mass"), (F.sum(F.abs(o - n)) / 2).alias("half_l1"), ratio(F.sum(F.least(o, n)), F.sum(F.greatest(o, n))).alias("weighted_jaccard"),
    )


def stable_weights(allocations: DataFrame, panel: list[str], item: str, source: str, scope: str) -> DataFrame:
    """Per panel and item the least weight over all sources that the panel's `scope` has; items that a source lacks drop out."""
    least = allocations.groupBy(*panel, item).agg(F.min("weight").alias("weight"), F.countDistinct(source).alias("_n"))
    sources = allocations.groupBy(scope).agg(F.countDistinct(source).alias("_all"))
    return least.join(sources, scope).filter(F.col("_n") == F.col("_all")).select(*panel, item, "weight")


def mean_weights(allocations: DataFrame, panel: list[str], item: str, source: str) -> DataFrame:
    """Per panel and item the mean weight over the panel's sources, absent items counting 0."""
    n = allocations.groupBy(*panel).agg(F.countDistinct(source).alias("_n"))
    return allocations.groupBy(*panel, item).agg(F.sum("weight").alias("_s")).join(n, panel).select(*panel, item, (F.col("_s") / F.col("_n")).alias("weight"))


def combine(*terms: tuple[float, DataFrame], keys: list[str]) -> DataFrame:
    """The linear combination of weight vectors; zero entries are dropped."""
    out = None
    for scale, vector in terms:
        scaled = vector.select(*keys, (F.col("weight") * scale).alias("weight"))
        out = scaled if out is None else out.unionByName(scaled)
    return out.groupBy(*keys).agg(F.sum("weight").alias("weight")).filter("weight <> 0")


def label_bounds(coefficients: DataFrame, by: list[str], coefficient: str = "weight", label: str = "label") -> DataFrame:
    """The sum of coefficient times label where labels may be unknown (NULL): known part, lower and upper bound, and its direction.

    Labels are 0 or 1. `returned` is the sum of all coefficients, `unknown_mass` of the absolute ones without label.
    """
    c, known = F.col(coefficient), F.col(label).isNotNull()
    zero = F.lit(0.0)
    sums = coefficients.groupBy(*by).agg(
        F.sum(c).alias("returned"), F.sum(F.when(known, c * F.col(label)).otherwise(zero)).alias("known"), F.sum(F.when(~known, F.least(c, zero)).otherwise(zero)).alias("_low"),
        F.sum(F.when(~known, F.greatest(c, zero)).otherwise(zero)).alias("_high"), F.sum(F.when(~known, F.abs(c)).otherwise(zero)).alias("unknown_mass"),
    )
    ends = {"lower": F.round(F.col("known") + F.col("_low"), 12), "upper": F.round(F.col("known") + F.col("_high"), 12)}  # else rounding errors would count as a sign
    bounded = sums.withColumns(ends).drop("_low", "_high")
    return bounded.withColumn("direction", direction(F.col("lower"), F.col("upper")))


def direction(lower: Column, upper: Column) -> Column:
    """Sign that an interval proves: zero when both ends are 0, else negative or positive when 0 lies outside, else unresolved."""
    return when_chain((lower.isNull() | upper.isNull(), "unavailable"), ((lower == 0) & (upper == 0), "zero"), (upper < 0, "negative"), (lower > 0, "positive"), otherwise="unresolved")


def arm_mass(coefficients: DataFrame, by: list[str], budget: int) -> DataFrame:
    """A budget's parts: positive, zero and null-labelled mass, mass without any label row, and slots left vacant."""
    w, label = F.col("weight"), F.col("label")
    part = [F.sum(F.when(condition, w).otherwise(0.0)).alias(name) for name, condition in (("positive", label == 1), ("negative", label == 0), ("null_label", label.isNull() & F.col("labelled")), ("no_label", ~F.col("labelled")))]
    return coefficients.groupBy(*by).agg(F.sum(w).alias("returned"), *part).withColumn("vacant", budget - F.col("returned"))


def donor_reduction(models: DataFrame, donor: str, model: str, by: list[str], values: list[str]) -> DataFrame:
    """Models average within their donor, then donors equally. A donor or group with any NULL value is NULL, no complete-case mean."""

    def mean(column: str) -> Column:
        return F.when(F.count(column) == F.count("*"), F.avg(column)).alias(column)

    donors = models.groupBy(*by, donor).agg(*[mean(v) for v in values], F.count(model).alias("models"))
    return donors.groupBy(*by).agg(F.count("*").alias("donors"), F.sum("models").alias("models"), *[mean(v) for v in values])


def leave_one_out(rows: DataFrame, by: list[str], unit: str, value: str) -> DataFrame:
    """Each unit's contribution to the group's mean and the mean without it (NULL for a lone unit); one pass, no self join."""
    sums = rows.groupBy(*by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    without = ratio(F.col("_s") - F.col(value), F.col("_n") - 1)
    return rows.join(sums, by).select(*by, unit, value, without.alias("mean_without"), (ratio(F.col("_s"), F.col("_n")) - without).alias("influence"))


def concentration_shares(rows: DataFrame, by: list[str], unit: str, value: str, tops: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The share of the absolute total that the 1, 5 and 10 largest units hold (ties by unit). Only the largest units are ever ordered."""
    units = rows.groupBy(*by, unit).agg(F.abs(F.sum(value)).alias("_v"))
    totals = units.groupBy(*by).agg(F.count("*").alias("units"), F.sum("_v").alias("total"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_v").desc(), unit))
    largest = units.withColumn("_p", place).filter(F.col("_p") <= max(tops))  # Spark keeps the first rows of each task before the shuffle
    sums = largest.groupBy(*by).agg(*[F.sum(F.when(F.col("_p") <= k, F.col("_v"))).alias(f"_top_{k}") for k in tops])
    return totals.join(sums, by).select(*by, "units", "total", *[ratio(F.col(f"_top_{k}"), F.col("total")).alias(f"top_{k}_share") for k in tops])


def matched_prefix(allocations: DataFrame, panel: list[str], item: str, score: str, target: str) -> DataFrame:
    """Allocations cut off where their running weight, best scores first, reaches the panel's target mass; the last item is cut to fit.

    Tied items follow the md5 of their name, in ranges of it, so that a panel of ties only is not ordered in one task.
    """
    named = allocations.withColumn("_digest", F.md5(F.col(item).cast("string")))
    placed = named.withColumn("_part", F.struct((-F.col(score)).alias("s"), F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int").alias("b")))
    run = running_sum(placed, panel, "_part", ["_digest", item], "weight", "_run").drop("_part", "_digest")
    kept = F.greatest(F.lit(0.0), F.col("weight") - F.greatest(F.lit(0.0), F.col("_run") - F.col(target)))
    return run.withColumn("kept_weight", kept).filter("kept_weight > 1e-12").drop("_run")


def regret(choices: DataFrame, by: list[str], option: str, value: str, chosen: str) -> DataFrame:
    """Per group the best value, the chosen option's value and their difference; the best option with the least id."""
    best = choices.groupBy(*by).agg(F.max(value).alias("best_value"), F.max(F.when(F.col(chosen), F.col(value))).alias("chosen_value"))
    named = choices.join(best, by).filter(F.col(value) == F.col("best_value")).groupBy(*by).agg(F.min(option).alias("best_option"))
    return best.join(named, by).withColumn("loss", F.col("best_value") - F.col("chosen_value"))


def nondominated(points: DataFrame, by: list[str], benefit: str, cost: str) -> DataFrame:
    """Points to which no other of the group is at least as good in both and better in one: greater benefit, smaller cost.

    One pass over costs in order: a point stays when its benefit exceeds that of all cheaper points and is the greatest at its cost.
    """
    best = points.groupBy(*by, cost).agg(F.max(benefit).alias("_b"))
    cheaper = F.max("_b").over(Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_c", cheaper).filter(F.col("_c").isNull() | (F.col("_b") > F.col("_c")))
    return points.join(front.drop("_c"), [*by, cost]).filter(F.col(benefit) == F.col("_b")).drop("_b")
