"""How scores of a support's pairs changed: tiers, summaries on padded grids, concentration, trajectories, area weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio, when_chain
from panelshift.operators.ordering import joined_on, running_sum, value_range, with_quantiles

# Score tiers (open below, closed above), cut points, tolerance and the scale factor of the calibration.
TIERS = ((0.0, 0.05, "score_gt_0_le_0_05"), (0.05, 0.2, "score_gt_0_05_le_0_20"), (0.2, 0.5, "score_gt_0_20_le_0_50"), (0.5, 0.75, "score_gt_0_50_le_0_75"), (0.75, 1.0, "score_gt_0_75_le_1_00"))
CUTS = (0.01, 0.05, 0.1)
TOLERANCE = 1e-12
SCALE = 1.0012041817620156
LARGE = 0.05
STATUSES = ("unchanged", "changed", "missing")
CONTEXTS = ("canonical_identifier_stable", "raw_identifier_mapping_affected")
TRAJECTORIES = ("stable-stable", "increase-increase", "decrease-decrease", "increase-decrease", "decrease-increase", "one-stable-one-changing")
GROUP = ["release_pair", "support_name"]


def score_tier(score: Column) -> Column:
    return when_chain(*[((score > low) & (score <= high), label) for low, high, label in TIERS], otherwise="unclassified")


def grid(spark, **values) -> DataFrame:
    """All combinations of short lists of fixed values, built from literals on one row."""
    out = spark.range(1).select(*[F.lit(0).alias("_")])
    for name, items in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x) for x in items])))
    return out.drop("_")


def pair_revisions(members: DataFrame, calibrated_pair: str | None = None) -> DataFrame:
    """Each pair's signed and absolute change, evidence status, mapping context, tiers, and the change after rescaling the old score where that applies."""
    o, n = F.col("old_score"), F.col("new_score")
    eo, en = F.col("old_evidence_count"), F.col("new_evidence_count")
    applies = F.col("release_pair") == F.lit(calibrated_pair) if calibrated_pair else F.lit(False)
    return members.withColumns({
        "signed_change": n - o, "absolute_change": F.abs(n - o), "exact_unchanged": o == n, "near_unchanged": F.abs(n - o) <= TOLERANCE,
        "evidence_status": when_chain((eo.isNull() | en.isNull(), "missing"), (eo == en, "unchanged"), otherwise="changed"),
        "mapping_context": F.when(F.col("mapping_affected"), CONTEXTS[1]).otherwise(CONTEXTS[0]),
        "old_tier": score_tier(o), "new_tier": score_tier(n), "adjusted_change": F.when(applies, F.abs(n - o * SCALE)),
    })


def _cut_fractions(change: Column, prefix: str) -> list[Column]:
    return [(F.count_if(change >= c) / F.count("*")).alias(f"{prefix}_ge_{str(c).replace('.', '_')}") for c in CUTS]


def score_summary(revisions: DataFrame) -> DataFrame:
    """Summary of changes overall, per mapping context and per evidence status, with rows of count 0 for combinations that don't occur.

    One pass with grouping sets; quantiles interpolate linearly, and those of empty combinations are NULL.
    """
    scopes = F.array(
        F.struct(F.lit("OVERALL").alias("summary_scope"), F.lit("all").alias("summary_group")),
        F.struct(F.lit("MAPPING_CONTEXT").alias("summary_scope"), F.col("mapping_context").alias("summary_group")),
        F.struct(F.lit("EVIDENCE_COUNT_STATUS").alias("summary_scope"), F.col("evidence_status").alias("summary_group")),
    )
    change, signed = F.col("absolute_change"), F.col("signed_change")
    levels = {"median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    wanted_quantiles = {"signed_median": ("signed_change", 0.5), "old_score_median": ("old_score", 0.5), "new_score_median": ("new_score", 0.5)} | {f"absolute_{n}": ("absolute_change", q) for n, q in levels.items()}
    scoped, by = revisions.select("*", F.inline(scopes)), [*GROUP, "summary_scope", "summary_group"]
    found = scoped.groupBy(*by).agg(
        F.count("*").alias("record_count"), F.countDistinct("canonical_disease_id").alias("disease_count"), F.countDistinct("canonical_target_id").alias("target_count"),
        ratio(F.count_if("exact_unchanged"), F.count("*")).alias("exact_unchanged_fraction"), ratio(F.count_if("near_unchanged"), F.count("*")).alias("near_unchanged_fraction"),
        F.max(change).alias("maximum_change"), *_cut_fractions(change, "change"),
        F.count_if(signed > 0).alias("positive_count"), F.count_if(signed < 0).alias("negative_count"), F.count_if(signed == 0).alias("zero_count"),
    )
    named = with_quantiles(found, scoped, by, wanted_quantiles)
    groups = revisions.select(*GROUP).distinct()
    wanted = F.array(
        F.struct(F.lit("OVERALL").alias("summary_scope"), F.lit("all").alias("summary_group")),
        *[F.struct(F.lit("MAPPING_CONTEXT").alias("summary_scope"), F.lit(c).alias("summary_group")) for c in CONTEXTS],
        *[F.struct(F.lit("EVIDENCE_COUNT_STATUS").alias("summary_scope"), F.lit(s).alias("summary_group")) for s in STATUSES],
    )
    padded = groups.select(*GROUP, F.inline(wanted)).join(named, [*GROUP, "summary_scope", "summary_group"], "left")
    return padded.fillna(0, ["record_count", "disease_count", "target_count", "positive_count", "negative_count", "zero_count"])


def scale_diagnostic(revisions: DataFrame) -> DataFrame:
    """Raw and rescaled absolute changes side by side, for pairs to which the rescaling applies."""
    both = revisions.filter("adjusted_change is not null")
    sums = both.groupBy(*GROUP).agg(F.count("*").alias("record_count"), *_cut_fractions(F.col("absolute_change"), "raw"), *_cut_fractions(F.col("adjusted_change"), "adjusted"))
    levels = {"median": 0.5, "q90": 0.9, "q99": 0.99}
    return with_quantiles(sums, both, GROUP, {f"{side}_{n}": (c, q) for side, c in (("raw", "absolute_change"), ("adjusted", "adjusted_change")) for n, q in levels.items()})


def tier_summary(revisions: DataFrame, records: DataFrame) -> DataFrame:
    """Persistent pairs per old tier, with entrants, exits and remapped pairs whose applicable score lies in the tier."""
    change, signed = F.col("absolute_change"), F.col("signed_change")
    stay = revisions.groupBy(*GROUP, "old_tier").agg(
        F.count("*").alias("pair_count"), F.countDistinct("canonical_disease_id").alias("disease_count"), F.countDistinct("canonical_target_id").alias("target_count"),
        F.count_if(signed > 0).alias("positive_count"), F.count_if(signed < 0).alias("negative_count"),
    )
    stay = with_quantiles(stay, revisions, [*GROUP, "old_tier"], {"median_change": ("absolute_change", 0.5), "q90_change": ("absolute_change", 0.9)})
    moved = records.groupBy("release_pair", score_tier(F.col("applicable_score")).alias("old_tier")).agg(*[F.count_if(F.col("context_class") == c).alias(f"{n}_count") for c, n in (("ENTRANT", "entrant"), ("EXIT", "exit"), ("MAPPING_AFFECTED", "remapped"))])
    return stay.join(moved, ["release_pair", "old_tier"], "left").fillna(0, ["entrant_count", "exit_count", "remapped_count"])


def with_areas(rows: DataFrame, areas: str = "areas") -> DataFrame:
    """Rows once per area of their `;`-joined list, with weight 1/n as DECIMAL(38,18); rows without an area are left out."""
    listed = F.array_distinct(F.filter(F.split(F.col(areas), ";"), lambda x: x != ""))
    weight = (F.lit(1).cast("decimal(38,18)") / F.size("_l").cast("decimal(10,0)")).cast("decimal(38,18)")
    return rows.withColumn("_l", listed).filter(F.size("_l") > 0).withColumns({"area_weight": weight, "area_id": F.explode("_l")}).drop("_l")


def dominant(rows: DataFrame, by: list[str], unit: str, weight: Column, out: str) -> DataFrame:
    """The unit with the greatest weight per group (of equal ones the least id): `out`_id and `out`_weight."""
    sums = rows.groupBy(*by, unit).agg(weight.alias("_w"))
    first = sums.groupBy(*by).agg(F.min(F.struct((-F.col("_w")).alias("w"), F.col(unit).alias("u"))).alias("_f"))
    return first.select(*by, F.col("_f.u").alias(f"{out}_id"), (-F.col("_f.w")).alias(f"{out}_weight"))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, weight: str, levels: dict[str, float]) -> DataFrame:
    """The least value at which the cumulative weight reaches each level of the total (inverted distribution function).

    Weights are summed per distinct value first; distinct values are ordered range by range. Rows with a NULL value or a weight that is not
    above 0 are left out.
    """
    steps = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    summed = running_sum(steps.withColumn("_range", value_range(F.col(value))), by, "_range", [value], "_w", "_c")
    total = steps.groupBy(*by).agg(F.sum("_w").alias("_t"))
    return joined_on(summed, total, by, "inner").groupBy(*by).agg(*[F.min(F.when(F.col("_c").cast("double") + 1e-15 >= F.col("_t").cast("double") * q, F.col(value))).alias(n) for n, q in levels.items()])


def area_summary(revisions: DataFrame, minimum_diseases: int = 20) -> DataFrame:
    """Per area: fractional counts, weighted quantiles of the change, large changes and their dominant disease and target."""
    rows = with_areas(revisions)
    by = [*GROUP, "area_id"]
    large = rows.filter(F.col("absolute_change") >= LARGE)
    base = rows.groupBy(*by).agg(
        F.count("*").alias("assignment_count"), F.sum("area_weight").alias("fractional_pair_count"), F.countDistinct("canonical_disease_id").alias("disease_count"),
        F.sum(F.when(F.col("absolute_change") >= LARGE, F.col("area_weight")).otherwise(F.lit(0).cast("decimal(38,18)"))).alias("large_weight"),
    )
    quantiles = weighted_quantile(rows, by, "absolute_change", "area_weight", {"weighted_median_change": 0.5, "weighted_q90_change": 0.9})
    d = dominant(large, by, "canonical_disease_id", F.sum("area_weight"), "dominant_disease")
    t = dominant(large, by, "canonical_target_id", F.sum("area_weight"), "dominant_target")
    joined = base.join(quantiles, by, "left").join(d, by, "left").join(t, by, "left")
    return joined.select(
        *by, "assignment_count", F.col("fractional_pair_count").cast("double").alias("fractional_pair_count"), "disease_count", "weighted_median_change", "weighted_q90_change",
        ratio(F.col("large_weight"), F.col("fractional_pair_count")).alias("large_change_fraction"), "dominant_disease_id", ratio(F.col("dominant_disease_weight"), F.col("large_weight")).alias("maximum_disease_share"),
        "dominant_target_id", ratio(F.col("dominant_target_weight"), F.col("large_weight")).alias("maximum_target_share"),
        F.when(F.col("disease_count") >= minimum_diseases, "comparison_eligible").otherwise("descriptive_only").alias("reporting_status"),
    )


def tier_area_distribution(revisions: DataFrame) -> DataFrame:
    """Fractional pairs per old tier and area, and the area's fraction of the tier."""
    rows = with_areas(revisions)
    cells = rows.groupBy(*GROUP, "old_tier", "area_id").agg(F.count("*").alias("assignment_count"), F.sum("area_weight").alias("_w"), F.countDistinct("canonical_disease_id").alias("disease_count"))
    totals = cells.groupBy(*GROUP, "old_tier").agg(F.sum("_w").alias("_t"))
    return cells.join(totals, [*GROUP, "old_tier"]).withColumns({"fractional_pair_count": F.col("_w").cast("double"), "within_tier_fraction": ratio(F.col("_w"), F.col("_t"))}).drop("_w", "_t")


def concentration(revisions: DataFrame) -> DataFrame:
    """Shares of the dominant disease and target in the large changes, and the 90th percentile without them."""
    change = F.col("absolute_change")
    base = revisions.groupBy(*GROUP).agg(F.count("*").alias("pair_count"), F.count_if(change >= LARGE).alias("large_count"))
    large = revisions.filter(change >= LARGE)
    out, rows, without = base, revisions, {"full_q90": ("absolute_change", 0.9)}
    for unit, name in (("canonical_disease_id", "disease"), ("canonical_target_id", "target")):
        top = dominant(large, GROUP, unit, F.count("*"), f"dominant_{name}")
        out = out.join(top, GROUP, "left").withColumn(f"maximum_{name}_share", ratio(F.col(f"dominant_{name}_weight"), F.col("large_count")))
        other = F.col(unit) != F.col(f"dominant_{name}_id")
        rows = rows.join(F.broadcast(top.select(*GROUP, f"dominant_{name}_id")), GROUP, "left").withColumn(f"_{name}", F.when(other, change))  # a row per release pair and support
        without |= {f"without_{name}_q90": (f"_{name}", 0.9)}
    left = rows.groupBy(*GROUP).agg(*[F.nullif(F.count(f"_{n}"), F.lit(0)).alias(f"without_{n}_count") for n in ("disease", "target")])
    whole = with_quantiles(out.join(left, GROUP), rows, GROUP, without)
    return whole.withColumns({f"without_{n}_difference": F.col(f"without_{n}_q90") - F.col("full_q90") for n in ("disease", "target")})


def trajectories(members: DataFrame, releases: list[str]) -> DataFrame:
    """Pairs eligible in three consecutive releases: the direction of both changes and the tier they start from, for every such span in one grouping.

    `members` has a pair once per release pair; fewer than three releases give no rows.
    """
    spans = [(f"{a}_to_{b}_to_{c}", f"{x}_to_{y}", side) for a, b, c in zip(releases, releases[1:], releases[2:]) for x, y, side in ((a, b, 1), (b, c, 2))]
    known = F.array(*[F.struct(F.lit(s).alias("release_span"), F.lit(p).alias("_pair"), F.lit(i).alias("_side")) for s, p, i in spans or [("", "", 0)]])
    ids = ["release_span", "canonical_disease_id", "canonical_target_id"]
    sides = members.select("*", F.inline(F.filter(known, lambda x: x["_pair"] == F.col("release_pair"))))
    first, second = F.col("_side") == 1, F.col("_side") == 2
    both = sides.groupBy(*ids).agg(
        F.max(F.when(first, F.col("old_score"))).alias("old_score"), F.max(F.when(first, F.col("new_score"))).alias("middle_score"),
        F.max(F.when(second, F.col("new_score"))).alias("new_score"), F.bool_or(first).alias("_f"), F.bool_or(second).alias("_s"),
    )
    return _labelled(both.filter("_f and _s").drop("_f", "_s"))


def _labelled(both: DataFrame) -> DataFrame:
    def state(change: Column) -> Column:
        return when_chain((F.abs(change) <= TOLERANCE, "stable"), (change > 0, "increase"), otherwise="decrease")

    rows = both.withColumns({"first_change": F.col("middle_score") - F.col("old_score"), "second_change": F.col("new_score") - F.col("middle_score")})
    s1, s2 = state(F.col("first_change")), state(F.col("second_change"))
    label = when_chain(((s1 == "stable") & (s2 == "stable"), "stable-stable"), ((s1 == "stable") | (s2 == "stable"), "one-stable-one-changing"), otherwise=F.concat_ws("-", s1, s2))
    return rows.withColumns({"trajectory": label, "starting_tier": score_tier(F.col("old_score"))})


def trajectory_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs per trajectory and starting tier (and all tiers), on the full grid, with fractions of the tier and of all; each within `by`."""
    cells = rows.select("*", F.abs("first_change").alias("_first"), F.abs("second_change").alias("_second"), F.explode(F.array(F.col("starting_tier"), F.lit("all_score_tiers"))).alias("tier_group"))
    counts = cells.groupBy(*by, "trajectory", "tier_group").agg(
        F.count("*").alias("pair_count"), F.countDistinct("canonical_disease_id").alias("disease_count"),
    )
    medians = {"first_change_median": ("_first", 0.5), "second_change_median": ("_second", 0.5)}
    counts = with_quantiles(counts, cells, [*by, "trajectory", "tier_group"], medians)
    full = grid(rows.sparkSession, trajectory=TRAJECTORIES, tier_group=(*[t[2] for t in TIERS], "all_score_tiers"))
    if by:
        full = full.crossJoin(F.broadcast(counts.select(*by).distinct()))
    padded = full.join(counts, [*by, "trajectory", "tier_group"], "left").fillna(0, ["pair_count", "disease_count"])
    in_tier, everything = Window.partitionBy(*by, "tier_group"), Window.partitionBy(*by)
    whole = F.sum(F.when(F.col("tier_group") == "all_score_tiers", F.col("pair_count"))).over(everything)  # the grid has 36 rows
    return padded.withColumns({"within_tier_fraction": F.coalesce(ratio(F.col("pair_count"), F.sum("pair_count").over(in_tier)), F.lit(0.0)), "overall_fraction": F.coalesce(ratio(F.col("pair_count"), whole), F.lit(0.0))})


def entrant_exit_summary(records: DataFrame) -> DataFrame:
    """Entrants, exits and other records overall and per area (weighted): counts and applicable scores, NULL ones left out of the median."""
    whole = records.select("*", F.lit("overall").alias("summary_scope"), F.lit("").alias("area_id"), F.lit(1).cast("decimal(38,18)").alias("area_weight"))
    rows = whole.unionByName(with_areas(records).withColumn("summary_scope", F.lit("area")))
    by = ["summary_scope", "release_pair", "context_class", "area_id"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("record_count"), F.sum("area_weight").cast("double").alias("fractional_count"), F.countDistinct("canonical_disease_id").alias("disease_count"))
    return with_quantiles(sums, rows, by, {"score_median": ("applicable_score", 0.5)})


def persistence_class(primary: Column, stable_eligible: Column, stable: Column, domain_eligible: Column, domain: Column) -> Column:
    """How far a change of leaders is borne out on stable members and in an evidence domain; a flag that is NULL or of an ineligible layer counts as no change.

    Fixed values: the names of the classes.
    """
    no = F.lit(False)
    p, s, d = F.coalesce(primary, no), F.coalesce(stable_eligible & stable, no), F.coalesce(domain_eligible & domain, no)
    with_primary = F.when(s, F.when(d, "MIXED").otherwise("PERSISTS_STABLE_ENTITY")).when(d, "PERSISTS_EVIDENCE_DOMAIN").when(~F.coalesce(domain_eligible, no), "INSUFFICIENT_DOMAIN_SUPPORT")
    with_primary = with_primary.when(F.coalesce(stable_eligible, no), "DISAPPEARS_AFTER_MAPPING_CONTROL").otherwise("OVERALL_ONLY")
    return F.when(p, with_primary).otherwise(F.when(d & ~s, "DOMAIN_ONLY").otherwise("MIXED"))
