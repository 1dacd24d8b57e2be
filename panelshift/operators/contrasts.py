"""Contrasts between states of an allocation: signs, intervals, factorial contrasts, overlaps of actions and distributions of values."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio, when_chain
from panelshift.operators.ordering import joined_on, running_sum, value_range, with_quantiles


def signed_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Positive, negative, absolute and signed sums, mean, extrema, median and counts by sign; NULL values are left out."""
    known = rows.filter(F.col(value).isNotNull())
    v, zero = F.col(value), F.lit(0.0)
    sums = known.groupBy(*by).agg(
        F.sum(F.greatest(v, zero)).alias("positive_sum"), F.sum(F.greatest(-v, zero)).alias("negative_sum"), F.sum(F.abs(v)).alias("absolute_sum"), F.sum(v).alias("signed_sum"), F.avg(v).alias("mean"), F.min(v).alias("minimum"),
        F.max(v).alias("maximum"), F.count_if(v < 0).alias("n_negative"), F.count_if(v == 0).alias("n_zero"), F.count_if(v > 0).alias("n_positive"),
    )
    return with_quantiles(sums, known, by, {"median": (value, 0.5)})


def sign_name(value: Column) -> Column:
    return when_chain((value.isNull(), "unavailable"), (value < 0, "negative"), (value == 0, "zero"), otherwise="positive")


def sign_table(rows: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """Rows by the signs of two values, on the full grid of three by three signs per group; rows without a value on either side are left out."""
    known = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    counts = known.groupBy(*by, sign_name(F.col(first)).alias("first_sign"), sign_name(F.col(second)).alias("second_sign")).agg(F.count("*").alias("rows"))
    signs = F.array(*[F.lit(s) for s in ("negative", "zero", "positive")])
    full = known.select(*by).distinct().withColumn("first_sign", F.explode(signs)).withColumn("second_sign", F.explode(signs))
    return joined_on(full, counts, [*by, "first_sign", "second_sign"]).fillna(0, ["rows"])


def value_distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Every distinct value with its rows, their fraction, and the fraction of rows up to it; values are ordered in ranges, NULL ones left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("rows"))
    summed = running_sum(counts.withColumn("_range", value_range(F.col(value).cast("double"))), by, "_range", [value], "rows", "_up_to").drop("_range")
    totals = counts.groupBy(*by).agg(F.sum("rows").alias("_all"))
    return joined_on(summed, totals, by, "inner").select(*by, value, "rows", ratio(F.col("rows"), F.col("_all")).alias("fraction"), ratio(F.col("_up_to"), F.col("_all")).alias("cumulative"))


def factorial_contrasts(factors: tuple[str, str, str]) -> dict[str, dict[tuple[int, int, int], int]]:
    """The 22 contrasts of eight states (three factors at 0 or 1) by name: simple effects, two-way interactions, the three-way one, and joint changes.

    A contrast maps states to the multipliers +1 and -1. Joint changes move the first two factors with the third held, and all three.
    """
    out: dict[str, dict[tuple[int, int, int], int]] = {}
    for moved in (*combinations(range(3), 1), *combinations(range(3), 2), (0, 1, 2)):
        held = [i for i in range(3) if i not in moved]
        for levels in product((0, 1), repeat=len(held)):
            at = dict(zip(held, levels))
            name = "".join(factors[i] for i in moved) + "".join(f"_{factors[i]}{v}" for i, v in at.items())
            states = [s for s in product((0, 1), repeat=3) if all(s[i] == v for i, v in at.items())]
            out[name] = {s: (-1) ** (len(moved) - sum(s[i] for i in moved)) for s in states}
    for level in (0, 1):
        out[f"JOINT_{factors[2]}{level}"] = {(1, 1, level): 1, (0, 0, level): -1}
    return out | {"JOINT": {(1, 1, 1): 1, (0, 0, 0): -1}}


def apply_contrasts(states: DataFrame, by: list[str], state: list[str], value: str, factors: tuple[str, str, str]) -> DataFrame:
    """(by, contrast, value): each contrast of the states' values, NULL where one of its states is missing or has no value. `state` names three columns of 0 and 1."""
    terms = [(name, s, m, len(multipliers)) for name, multipliers in factorial_contrasts(factors).items() for s, m in multipliers.items()]
    rows = F.array(*[F.struct(F.lit(n).alias("contrast"), *[F.lit(x).alias(f"_s{i}") for i, x in enumerate(s)], F.lit(m).alias("_m"), F.lit(k).alias("_k")) for n, s, m, k in terms])
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(state)]
    each = states.select(*by, *state, F.col(value).alias("_v"), F.inline(rows)).filter(same[0] & same[1] & same[2])
    whole = F.count("_v") == F.max("_k")
    return each.groupBy(*by, "contrast").agg(F.when(whole, F.sum(F.col("_m") * F.col("_v"))).alias("value"))


def scaled_bounds(parts: DataFrame, by: list[str], scale: str, lower: str, upper: str) -> DataFrame:
    """Bounds of a sum of disjoint parts times their scales: each part adds the lesser of its scaled ends to the lower bound, the greater to the upper; NULL if an end is."""
    a, b = F.col(scale) * F.col(lower), F.col(scale) * F.col(upper)
    whole = F.count(a + b) == F.count("*")
    return parts.groupBy(*by).agg(F.when(whole, F.sum(F.least(a, b))).alias("lower"), F.when(whole, F.sum(F.greatest(a, b))).alias("upper"))


def compared_directions(first: Column, second: Column) -> Column:
    """Whether two proven directions agree. The names of the classes."""
    strict = ("positive", "negative")
    both = first.isin(*strict) & second.isin(*strict)
    return when_chain(
        (both & (first == second), "SAME_ROBUST_DIRECTION"), (both, "ROBUST_OPPOSITE_DIRECTION"), ((first == "zero") & (second == "zero"), "BOTH_IDENTIFIED_ZERO"),
        ((first == "zero") | (second == "zero"), "ONE_IDENTIFIED_ZERO"), otherwise="UNRESOLVED",
    )


def response_class(change: Column, size: float = 1.0) -> Column:
    """Signed response: at most -size, at least size, or between."""
    return when_chain((change.isNull(), None), (change <= -size, "NEGATIVE"), (change >= size, "POSITIVE"), otherwise="BETWEEN")


def action_overlap(changes: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """How far two methods add or remove the same items: observed overlap, the most that their masses allow, and what a uniform placement over the menu gives.

    `changes` has a row per item of the menu with the change of weight under either method; NULL counts as none.
    """
    a, b = F.coalesce(F.col(first), F.lit(0.0)), F.coalesce(F.col(second), F.lit(0.0))
    zero = F.lit(0.0)
    sides = F.array(*[F.struct(F.lit(n).alias("action"), F.greatest(s * a, zero).alias("_a"), F.greatest(s * b, zero).alias("_b")) for n, s in (("ADDED", 1), ("REMOVED", -1))])
    sums = changes.select(*by, F.inline(sides)).groupBy(*by, "action").agg(F.count("*").alias("menu"), F.sum("_a").alias("first_mass"), F.sum("_b").alias("second_mass"), F.sum(F.least("_a", "_b")).alias("overlap"))
    return sums.withColumns({"capacity": F.least("first_mass", "second_mass"), "uniform_product": ratio(F.col("first_mass") * F.col("second_mass"), F.col("menu"))})


def minimal_flips(weights: DataFrame, by: list[str], weight: str, label: str) -> DataFrame:
    """Per group: the known labelled mass and the least number of unknown labels that could turn its sign (NULL where all of them can't).

    Unknown items of equal weight are merged to counts, the largest weights are flipped first. Labels count 1 or -1 by their value; a known mass of 0 needs no flip.
    """
    signed = F.when(F.col(label) == 1, F.abs(weight)).when(F.col(label) == 0, -F.abs(weight)).otherwise(0.0)
    known = weights.groupBy(*by).agg(F.round(F.sum(signed), 9).alias("known_mass"))
    cells = weights.filter(F.col(label).isNull()).groupBy(*by, F.abs(weight).alias("_w")).agg(F.count("*").alias("_n"))
    steps = cells.withColumns({"_mass": F.col("_w") * F.col("_n"), "_range": -value_range(F.col("_w")), "_down": -F.col("_w")})
    summed = running_sum(running_sum(steps, by, "_range", ["_down"], "_mass", "_m"), by, "_range", ["_down"], "_n", "_k")
    need = F.abs(F.col("known_mass")) - (F.col("_m") - F.col("_mass"))
    reached = joined_on(summed, known, by, "inner").filter(F.col("_m") >= F.abs("known_mass") - 1e-9)
    flips = F.col("_k") - F.col("_n") + F.ceil(F.greatest(need - 1e-9, F.lit(0.0)) / F.col("_w"))
    least = reached.groupBy(*by).agg(F.min(flips).alias("_flips"))
    return joined_on(known, least, by).select(*by, "known_mass", F.when(F.col("known_mass") == 0, 0).otherwise(F.col("_flips")).cast("long").alias("flips"))
