"""Queries that compare layers, supports and states of the panels, and bootstrap them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelshift.functions.scalars import affirmative, clean_disease, clean_target, ratio
from panelshift.operators import allocation, contrasts, native, panel, resampling
from panelshift.operators.contrasts import factorial_contrasts
from panelshift.operators.ordering import with_quantiles
from panelshift.operators.support import MIN_DISTINCT, ROSTERS
from panelshift.plans.panel_queries import _BY, _CHANGE, _ID, _PM, _RANKED, _W, BUDGET, P, TARGET, _allocated, _labelled, _r, members
from panelshift.plans.release_queries import _rounded
from panelshift.session import cut_lineage
from panelshift.sources.tables import load

LISTED = 1000
PRIMARY, OTHER = "three_release_primary", "pair_specific_sensitivity"


def _eligible(rows: DataFrame, by: list[str], least: int = 30) -> DataFrame:
    """Panels with enough members and two distinct scores in either release."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("panel_members"), F.least(F.countDistinct("old_score"), F.countDistinct("new_score")).alias("distinct"))
    return sums.filter((F.col("panel_members") >= least) & (F.col("distinct") >= MIN_DISTINCT))


def _leader_flags(rows: DataFrame, by: list[str]) -> DataFrame:
    best = rows.groupBy(*by).agg(F.max("old_score").alias("_o"), F.max("new_score").alias("_n"))
    return rows.join(best, by).withColumns({"old_leader": F.col("old_score") == F.col("_o"), "new_leader": F.col("new_score") == F.col("_n")}).drop("_o", "_n")


def leader_lists(spark: SparkSession, d: str) -> DataFrame:
    """Old and new leaders of every panel as lists in the order of their ids; lists of more than a thousand are NULL and stand in changed_leaders row by row."""
    flags = _leader_flags(members(spark, d), P)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_leader").alias("_in")) for s in ("old", "new")])
    leaders = cut_lineage(flags.select(*P, TARGET, F.inline(sides)).filter("_in"))
    sizes = leaders.groupBy(*P, "side").agg(F.count("*").alias("leaders"))
    short = leaders.join(sizes.filter(F.col("leaders") <= LISTED).drop("leaders"), [*P, "side"]).groupBy(*P, "side").agg(F.array_join(F.array_sort(F.collect_list(TARGET)), ";").alias("leader_ids"))
    return sizes.join(short, [*P, "side"], "left")


def changed_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Every old or new leader of the panels whose leaders changed."""
    leaders = cut_lineage(_leader_flags(members(spark, d), P).filter("old_leader or new_leader").select(*P, TARGET, "old_leader", "new_leader"))
    changed = leaders.filter("old_leader <> new_leader").select(*P).distinct()
    return leaders.join(changed, P)


def fixed_layers(spark: SparkSession, d: str) -> DataFrame:
    """Leaders of eligible panels among all and among stable members: sizes, change, disjoint sets, and how many changed leaders the primary layer shares."""
    by = ["layer", *P]
    rows = cut_lineage(members(spark, d).select(*P, TARGET, "old_score", "new_score", "stable_entity_member"))
    layered = rows.select("*", F.explode(F.array_compact(F.array(F.lit("PRIMARY"), F.when(F.col("stable_entity_member"), "STABLE")))).alias("layer"))
    flags = _leader_flags(layered.join(_eligible(layered, by), by), by)
    moved = F.col("old_leader") != F.col("new_leader")
    primary = _leader_flags(rows, P).filter(moved).select(*P, TARGET, F.lit(True).alias("_primary"))
    joined = flags.filter("old_leader or new_leader").join(primary, [*P, TARGET], "left")
    return joined.groupBy(*by, "panel_members").agg(
        F.count_if("old_leader").alias("old_leaders"), F.count_if("new_leader").alias("new_leaders"), F.count_if(F.col("old_leader") & F.col("new_leader")).alias("shared_leaders"), (F.count_if(moved) > 0).alias("changed"),
        (F.count_if(F.col("old_leader") & F.col("new_leader")) == 0).alias("disjoint"), F.count_if(moved & F.coalesce("_primary", F.lit(False))).alias("moved_as_in_primary"),
    )


def layer_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Per layer, support and release pair: panels, changed and disjoint leader sets with their fractions, and corroborated changes."""
    rows = fixed_layers(spark, d)
    corroborated = F.col("changed") & (F.col("moved_as_in_primary") > 0)
    sums = rows.groupBy("layer", *P[:2]).agg(F.count("*").alias("panels"), F.count_if("changed").alias("changed_panels"), F.count_if("disjoint").alias("disjoint_panels"), F.count_if(corroborated).alias("corroborated_panels"))
    return _rounded(sums.withColumns({"changed_fraction": ratio(F.col("changed_panels"), F.col("panels")), "disjoint_fraction": ratio(F.col("disjoint_panels"), F.col("panels")), "corroborated_fraction": ratio(F.col("corroborated_panels"), F.col("changed_panels"))}))


STAGES = ("PRIMARY_FIXED", "STABLE_DISEASE_ONLY", "STABLE_TARGET_ONLY", "STABLE_DISEASE_AND_TARGET")


def _ablated(spark: SparkSession, d: str) -> DataFrame:
    rows = members(spark, d).filter(F.col("support_name") == PRIMARY).select(*P[1:], TARGET, "old_score", "new_score")
    walks = {"disease": ("disease_crosswalk", clean_disease("canonical_disease_id")), "target": ("target_crosswalk", clean_target("canonical_target_id"))}
    flags = rows
    for kind, (table, key) in walks.items():
        entries = load(spark, d, table, [f"canonical_{kind}_id", "stable_entity_eligible"]).filter(affirmative(F.col("stable_entity_eligible")))
        stable = entries.select(key.alias(f"canonical_{kind}_id")).filter(F.col(f"canonical_{kind}_id") != "").distinct().withColumn(f"_{kind}", F.lit(True))
        flags = flags.join(stable, f"canonical_{kind}_id", "left").withColumn(f"_{kind}", F.coalesce(f"_{kind}", F.lit(False)))
    ds, ts = F.col("_disease"), F.col("_target")
    stages = F.array_compact(F.array(*[F.when(holds, F.lit(s)) for s, holds in zip(STAGES, (F.lit(True), ds, ts, ds & ts))]))
    return cut_lineage(flags.select(*P[1:], TARGET, "old_score", "new_score", F.explode(stages).alias("restriction_stage")))


def ablation_panels(spark: SparkSession, d: str) -> DataFrame:
    """Eligible panels of the primary support under four restrictions to stable entities: change of the leaders, and of the ten first by score and id."""
    by = ["restriction_stage", *P[1:]]
    rows = _ablated(spark, d)
    sizes = _eligible(rows, by)
    flags = _leader_flags(rows.join(sizes, by), by)
    lead = flags.groupBy(*by, "panel_members").agg((F.count_if(F.col("old_leader") != F.col("new_leader")) > 0).alias("leaders_changed"))
    firsts = []
    for side in ("old", "new"):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(f"{side}_score").desc(), TARGET))
        firsts.append(rows.withColumn("_p", place).filter("_p <= 10").select(*by, TARGET, F.lit(side).alias("_side")))  # Spark keeps ten a panel in each task before the shuffle
    both = firsts[0].unionByName(firsts[1]).groupBy(*by, TARGET).agg(F.count("*").alias("_n"))
    overlap = both.groupBy(*by).agg(F.count_if(F.col("_n") == 2).alias("_shared"), F.count("*").alias("_union"))
    return _rounded(lead.join(overlap, by).select(*by, "panel_members", "leaders_changed", (F.col("_shared") != F.col("_union")).alias("top_10_changed"), ratio(F.col("_shared"), F.col("_union")).alias("top_10_jaccard")))


def ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per restriction and release pair: panels left of the unrestricted ones, changed ones, and medians of size and overlap."""
    rows = cut_lineage(ablation_panels(spark, d))
    by = ["restriction_stage", "release_pair"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("panels"), F.sum("panel_members").alias("pairs"), F.count_if("leaders_changed").alias("leaders_changed"), F.count_if("top_10_changed").alias("top_10_changed"))
    base = sums.filter(F.col("restriction_stage") == STAGES[0]).select("release_pair", F.col("panels").alias("_base"))
    whole = with_quantiles(sums.join(base, "release_pair", "left"), rows, by, {"median_members": ("panel_members", 0.5), "median_top_10_jaccard": ("top_10_jaccard", 0.5)})
    return _rounded(whole.withColumns({"removed_panels": F.col("_base") - F.col("panels"), "leaders_changed_fraction": ratio(F.col("leaders_changed"), F.col("panels"))}).drop("_base"))


def matched_support(spark: SparkSession, d: str) -> DataFrame:
    """Leaders under the scores of two supports on the members that both have: per score source and release pair, eligible panels and those with changed leaders."""
    rows = cut_lineage(members(spark, d).filter(F.col("support_name").isin(PRIMARY, OTHER)).select(*P, TARGET, "old_score", "new_score"))
    ids = [*P[1:], TARGET]
    shared = rows.groupBy(*ids).agg(F.countDistinct("support_name").alias("_n")).filter("_n = 2").select(*ids)
    both = cut_lineage(rows.join(shared, ids))
    usable = _eligible(both, P).groupBy(*P[1:]).agg(F.count("*").alias("_n")).filter("_n = 2").select(*P[1:])
    flags = _leader_flags(both.join(usable, P[1:]), P).groupBy(*P).agg((F.count_if(F.col("old_leader") != F.col("new_leader")) > 0).alias("changed"), F.count("*").alias("n"))
    sums = flags.groupBy(*P[:2]).agg(F.count("*").alias("panels"), F.sum("n").alias("pairs"), F.count_if("changed").alias("changed_panels"))
    return _rounded(sums.withColumn("changed_fraction", ratio(F.col("changed_panels"), F.col("panels"))))


def endpoint_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints of fixed panels as rows: numerator, denominator and value per support, release pair, least panel size and endpoint."""
    rows = panel.both_ladders(members(spark, d), P)
    lead = (F.col("old_above") == 0) != (F.col("new_above") == 0)
    top = [F.coalesce(panel.in_top(10, f"{s}_"), F.lit(False)) for s in ("old", "new")]
    panels = rows.groupBy(*P).agg(F.count("*").alias("n"), F.least(F.max("old_step"), F.max("new_step")).alias("distinct"), (F.count_if(lead) > 0).alias("a"), (F.count_if((F.col("old_above") == 0) & (F.col("new_above") == 0)) == 0).alias("b"), (F.count_if(top[0] != top[1]) > 0).alias("c"))
    sized = panels.filter(F.col("distinct") >= MIN_DISTINCT).select("*", F.explode(F.filter(F.array(*[F.lit(k) for k in ROSTERS]), lambda k: k <= F.col("n"))).alias("minimum_panel_size"))
    ends = F.array(*[F.struct(F.lit(n).alias("endpoint"), h.cast("int").alias("_h")) for n, h in (("eligible_panel_count", F.lit(True)), ("leading_set_changed", F.col("a")), ("leading_sets_disjoint", F.col("b")), ("top_10_changed", F.col("c")))])
    sums = sized.select(*P[:2], "minimum_panel_size", F.inline(ends)).groupBy(*P[:2], "minimum_panel_size", "endpoint").agg(F.sum("_h").alias("numerator"), F.count("*").alias("denominator"))
    return _rounded(sums.withColumn("value", F.when(F.col("endpoint") == "eligible_panel_count", F.col("numerator").cast("double")).otherwise(ratio(F.col("numerator"), F.col("denominator")))))


def ordered_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first 5, 10 and 20 targets by score and id are the same in the same order, or at least the same, in both releases."""
    rows = members(spark, d)
    sides = []
    for side in ("old", "new"):
        place = F.row_number().over(Window.partitionBy(*P).orderBy(F.col(f"{side}_score").desc(), TARGET))
        sides.append(rows.withColumn("_p", place).filter("_p <= 20").select(*P, TARGET, F.lit(side).alias("_side"), "_p"))
    both = sides[0].unionByName(sides[1]).groupBy(*P, TARGET).agg(*[F.max(F.when(F.col("_side") == s, F.col("_p"))).alias(s) for s in ("old", "new")])
    each = both.select(*P, "old", "new", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("k"))
    o, n = F.coalesce(F.col("old") <= F.col("k"), F.lit(False)), F.coalesce(F.col("new") <= F.col("k"), F.lit(False))
    inside = each.filter(o | n)
    return inside.groupBy(*P, "k").agg(F.bool_and(o & n & (F.col("old") == F.col("new"))).alias("same_order"), F.bool_and(o & n).alias("same_roster"))


def score_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Every score change to three places with its rows, fraction and cumulative fraction, per support and release pair."""
    rows = members(spark, d).withColumn("change", F.round(F.col("new_score") - F.col("old_score"), 3) + F.lit(0.0))
    return _rounded(contrasts.value_distribution(rows, P[:2], "change"))


def _weight_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change of weight of every member that either allocation gives any."""
    rows = members(spark, d)
    both = allocation.combine((1.0, _allocated(rows, "new_score")), (-1.0, _allocated(rows, "old_score")), keys=[*P, TARGET])
    return both.withColumn("weight", F.round("weight", 12))


def signed_mass(spark: SparkSession, d: str) -> DataFrame:
    """Sums, mean, order statistics and signs of the panels' mean score changes, per support and release pair."""
    means = members(spark, d).groupBy(*P).agg(F.round(F.avg(F.col("new_score") - F.col("old_score")), 9).alias("change"))
    return _rounded(contrasts.signed_statistics(means, P[:2], "change"))


def change_signs(spark: SparkSession, d: str) -> DataFrame:
    """Panels by the signs of their mean score change and of their mean change of evidence."""
    means = members(spark, d).groupBy(*P).agg(F.round(F.avg(F.col("new_score") - F.col("old_score")), 9).alias("score"), F.avg((F.col("new_evidence_count") - F.col("old_evidence_count")).cast("double")).alias("evidence"))
    return contrasts.sign_table(means, P[:2], "score", "evidence")


FACTORS = ("S", "R", "H")


def state_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """The 22 contrasts of stable mass over support (0 primary, 1 sensitivity), release (0 old, 1 new) and budget (0: 10, 1: 20) per release pair and disease."""
    rows = members(spark, d).filter(F.col("support_name").isin(PRIMARY, OTHER))
    states = None
    for r, score in enumerate(("old_score", "new_score")):
        for h, budget in enumerate((BUDGET, 2 * BUDGET)):
            part = allocation.allocate(rows, P, score, budget).groupBy(*P).agg(F.sum(F.col("weight") * F.coalesce(F.col("stable_entity_member"), F.lit(False)).cast("int")).alias("mass")).withColumns({"r": F.lit(r), "h": F.lit(h)})
            states = part if states is None else states.unionByName(part)
    coded = states.withColumn("s", (F.col("support_name") == OTHER).cast("int"))
    return _rounded(contrasts.apply_contrasts(cut_lineage(coded), P[1:], ["s", "r", "h"], "mass", FACTORS))


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(allocation.label_bounds(_labelled(spark, d), P))


def span_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of a disease's labelled mass in the last release pair minus the mean of the others, from the bounds of the release pairs."""
    rows = _bounds(spark, d)
    last = rows.groupBy("support_name", "canonical_disease_id").agg(F.max("release_pair").alias("_last"), (F.count("*") - 1).alias("_others"))
    scaled = rows.join(last, ["support_name", "canonical_disease_id"]).filter("_others > 0").withColumn("scale", F.when(F.col("release_pair") == F.col("_last"), 1.0).otherwise(-1.0 / F.col("_others")))
    return _rounded(contrasts.scaled_bounds(scaled, ["support_name", "canonical_disease_id"], "scale", "lower", "upper"))


def direction_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether the two supports prove the same direction of the change of labelled mass, per release pair and disease that both have."""
    rows = members(spark, d)
    label = F.when(F.col("old_evidence_count").eqNullSafe(F.col("new_evidence_count")), F.col("stable_entity_member").cast("int"))
    vector = _weight_changes(spark, d).join(rows.select(*P, TARGET, label.alias("label")), [*P, TARGET], "left")
    bounds = cut_lineage(allocation.label_bounds(vector, P).select(*P, "direction"))
    sides = [bounds.filter(F.col("support_name") == s).select(*P[1:], F.col("direction").alias(n)) for s, n in ((PRIMARY, "first"), (OTHER, "second"))]
    return sides[0].join(sides[1], P[1:]).withColumn("classification", contrasts.compared_directions(F.col("first"), F.col("second")))


def response_classes(spark: SparkSession, d: str) -> DataFrame:
    """Panels by the signed response of their stable mass: at least one slot lost, gained, or less than that."""
    rows = members(spark, d)
    flag = F.coalesce(F.col("stable_entity_member"), F.lit(False)).cast("int")
    change = _weight_changes(spark, d).join(rows.select(*P, TARGET, flag.alias("_f")), [*P, TARGET]).groupBy(*P).agg(F.round(F.sum(F.col("weight") * F.col("_f")), 9).alias("change"))
    return change.withColumn("response", contrasts.response_class(F.col("change"))).groupBy(*P[:2], "response").agg(F.count("*").alias("panels"))


def action_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the two supports add and remove the same targets, per release pair and disease that both have."""
    changes = cut_lineage(_weight_changes(spark, d))
    sides = [changes.filter(F.col("support_name") == s).select(*P[1:], TARGET, F.col("weight").alias(n)) for s, n in ((PRIMARY, "first"), (OTHER, "second"))]
    return _rounded(contrasts.action_overlap(sides[0].join(sides[1], [*P[1:], TARGET], "full"), P[1:], "first", "second"))


def flips(spark: SparkSession, d: str) -> DataFrame:
    """How many unknown labels could turn the sign of a panel's labelled mass."""
    return contrasts.minimal_flips(_labelled(spark, d), P, "weight", "label")


def offered_totals(spark: SparkSession, d: str) -> DataFrame:
    """Labelled mass per offered slot of panels whose returned mass is fully labelled, and its mean over a disease's release pairs if all are."""
    known = F.count("label") == F.count("*")
    per = _labelled(spark, d).groupBy(*P).agg(F.when(known, F.sum(F.col("weight") * F.col("label")) / BUDGET).alias("per_slot"))
    complete = F.count("per_slot") == F.count("*")
    return _rounded(per.groupBy("support_name", "canonical_disease_id").agg(F.count("*").alias("panels"), F.count("per_slot").alias("assessed_panels"), F.when(complete, F.avg("per_slot")).alias("mean_per_slot")))


def continuous_effect(spark: SparkSession, d: str) -> DataFrame:
    """Minus the weighted mean of the score change over the members that the old allocation gives weight, by mass whose change is known."""
    rows = _allocated(members(spark, d), "old_score").withColumn("change", F.col("new_score") - F.col("old_score"))
    return _rounded(rows.groupBy(*P).agg(F.sum("weight").alias("assessed_mass"), (-ratio(F.sum(F.col("weight") * F.col("change")), F.sum("weight"))).alias("effect")))


def degree_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A budget allocated by degree alone over all anchors of an archive and stratum, those without a degree counting 0."""
    anchors = load(spark, d, "baseline_anchor_registry", ["archive_id", "anchor_id", "baseline_degree_150", "baseline_degree_stratum"]).filter("archive_id is not null and baseline_degree_stratum is not null")
    items = anchors.groupBy("archive_id", "baseline_degree_stratum", "anchor_id").agg(F.coalesce(F.max("baseline_degree_150"), F.lit(0)).cast("double").alias("degree"))
    return allocation.allocate(items, ["archive_id", "baseline_degree_stratum"], "degree", BUDGET).select("archive_id", "baseline_degree_stratum", "anchor_id", "num", "den")


DRAWS = 500


def _panel_values(spark: SparkSession, d: str) -> DataFrame:
    change = F.abs(F.col("new_score") - F.col("old_score"))
    own = members(spark, d).filter(F.col("support_name") == PRIMARY).groupBy(*P[1:]).agg(F.avg(change).alias("mean_change"), F.avg((change > 0).cast("double")).alias("changed_share"), F.count_if(change > 0).alias("changed"), F.count("*").alias("pairs"))
    return cut_lineage(_rounded(own))


def change_band(spark: SparkSession, d: str) -> DataFrame:
    """Joint 95 % band of the panels' mean change and changed share per release pair, from studentised deviations over the draws."""
    rows = _panel_values(spark, d)
    plan = resampling.hashed_plan(rows, "canonical_disease_id", ["release_pair"], DRAWS)
    draws = resampling.draw_means(rows, plan, ["release_pair"], "canonical_disease_id", ["mean_change", "changed_share"])
    band = resampling.simultaneous_band(rows, cut_lineage(draws), ["release_pair"], ["mean_change", "changed_share"])
    return band.withColumns({c: F.round(c, 8) for c in ("estimate", "se", "critical", "lower", "upper")})


def cluster_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the changed share over all release pairs with whole diseases drawn: the release pairs of a disease stay together."""
    clusters = _panel_values(spark, d).groupBy("canonical_disease_id").agg(F.sum("changed").alias("changed"), F.sum("pairs").alias("pairs")).withColumn("scope", F.lit("all"))
    clusters = cut_lineage(clusters)
    plan = resampling.hashed_plan(clusters, "canonical_disease_id", ["scope"], DRAWS)
    return _rounded(resampling.ratio_intervals(clusters, plan, ["scope"], "canonical_disease_id", "changed", "pairs"))


def selection_optimism(spark: SparkSession, d: str) -> DataFrame:
    """How much the better of two measures of the old release gains from being chosen: chosen anew in each draw, its mean there minus that over all panels."""
    values = _capture_values(spark, d)
    names = ["by_score", "by_evidence"]
    draws = resampling.draw_means(values, resampling.hashed_plan(values, "canonical_disease_id", ["release_pair"], DRAWS), ["release_pair"], "canonical_disease_id", names)
    return _rounded(resampling.selection_optimism(values, cut_lineage(draws), ["release_pair"], names))


def category_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Returned, positive, zero and unknown mass of either allocation by the targets' biotype and over all, and their changes, per support and release pair."""
    biotypes = load(spark, d, "target_crosswalk", ["canonical_target_id", "source_biotype"]).select(clean_target("canonical_target_id").alias(TARGET), "source_biotype").filter(F.col(TARGET) != "")
    kinds = biotypes.groupBy(TARGET).agg(F.min("source_biotype").alias("biotype"))
    rows = members(spark, d)
    label = F.when(F.col("old_evidence_count").eqNullSafe(F.col("new_evidence_count")), F.col("stable_entity_member").cast("int"))
    parts = None
    for side in ("old", "new"):
        part = _allocated(rows, f"{side}_score").select(*P[:2], TARGET, "weight", label.alias("label"), F.lit(side).alias("side"))
        parts = part if parts is None else parts.unionByName(part)
    placed = parts.join(kinds, TARGET, "left").withColumn("category", F.explode(F.array(F.coalesce("biotype", F.lit("NONE")), F.lit("ALL"))))
    masses = {"returned": F.lit(True), "positive": F.col("label") == 1, "zero": F.col("label") == 0, "unknown": F.col("label").isNull()}
    sums = placed.groupBy(*P[:2], "category").agg(*[F.sum(F.when((F.col("side") == s) & m, F.col("weight")).otherwise(0.0)).alias(f"{s}_{n}") for s in ("old", "new") for n, m in masses.items()])
    return _rounded(sums.withColumns({f"{n}_change": F.col(f"new_{n}") - F.col(f"old_{n}") for n in masses}))


def paired_updates(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose weight changes in two consecutive release pairs of a disease, in the same or in opposite direction, and the mass that moves back and on."""
    changes = _weight_changes(spark, d).select(*P, TARGET, "weight")
    ends = changes.withColumns({"_from": F.split_part("release_pair", F.lit("_to_"), F.lit(1)), "_to": F.split_part("release_pair", F.lit("_to_"), F.lit(2))})
    stored = cut_lineage(ends)
    first = stored.select("support_name", "canonical_disease_id", TARGET, F.col("release_pair").alias("first_pair"), F.col("_to").alias("_at"), F.col("weight").alias("_a"))
    second = stored.select("support_name", "canonical_disease_id", TARGET, F.col("release_pair").alias("second_pair"), F.col("_from").alias("_at"), F.col("weight").alias("_b"))
    both = first.join(second, ["support_name", "canonical_disease_id", TARGET, "_at"])
    opposed, moved = F.signum("_a") != F.signum("_b"), F.least(F.abs("_a"), F.abs("_b"))
    sums = both.groupBy("support_name", "first_pair", "second_pair").agg(F.count_if(opposed).alias("opposing"), F.count_if(~opposed).alias("shared"), F.sum(F.when(opposed, moved).otherwise(0.0)).alias("opposing_mass"), F.sum(F.when(~opposed, moved).otherwise(0.0)).alias("shared_mass"))
    return _rounded(sums)


def selection_table(spark: SparkSession, d: str) -> DataFrame:
    """Targets that both supports have, by whether the new allocation of either gives them weight, per release pair."""
    rows = members(spark, d).filter(F.col("support_name").isin(PRIMARY, OTHER))
    chosen = _allocated(rows, "new_score").select(*P, TARGET, F.lit(True).alias("_in"))
    flags = rows.select(*P, TARGET).join(chosen, [*P, TARGET], "left").groupBy(*P[1:], TARGET).agg(*[F.max(F.when(F.col("support_name") == s, F.coalesce("_in", F.lit(False)))).alias(n) for s, n in ((PRIMARY, "in_primary"), (OTHER, "in_other"))])
    return flags.dropna().groupBy("release_pair", "in_primary", "in_other").agg(F.count("*").alias("targets"))


def affine_features(spark: SparkSession, d: str) -> DataFrame:
    """Per panel: slope and intercept of the new score on the old one, the share of variance they leave, NULL without variance of the old score."""
    rows = members(spark, d)
    sums = rows.groupBy(*P).agg(F.regr_slope("new_score", "old_score").alias("slope"), F.regr_intercept("new_score", "old_score").alias("intercept"), F.regr_r2("new_score", "old_score").alias("_r2"), F.var_pop("new_score").alias("_vy"), F.var_pop("old_score").alias("_vx"))
    real = F.col("_vx") > 1e-12  # else a constant old score could keep a rounding error for variance
    return sums.select(*P, *[F.when(real, F.round(c, 6)).alias(c) for c in ("slope", "intercept")], F.when(real & (F.col("_vy") > 1e-12), F.round(1 - F.col("_r2"), 6)).alias("unexplained"))


def hit_contrasts(spark: SparkSession, d: str) -> DataFrame:
    """Change of stable mass from the old to the new allocation: mean, mean of its size, and the share of panels where it reaches one slot."""
    rows = members(spark, d)
    flag = F.coalesce(F.col("stable_entity_member"), F.lit(False)).cast("int")
    moved = _weight_changes(spark, d).join(rows.select(*P, TARGET, flag.alias("_f")), [*P, TARGET]).groupBy(*P).agg(F.round(F.sum(F.col("weight") * F.col("_f")), 9).alias("_c"))
    panels = rows.select(*P).distinct().join(moved, P, "left").fillna(0.0, ["_c"])
    size = F.abs("_c")
    return _rounded(panels.groupBy(*P[:2]).agg(F.count("*").alias("panels"), F.avg("_c").alias("mean_change"), F.avg(size).alias("mean_size"), F.avg((size >= 1).cast("double")).alias("one_hit_fraction")))


def ordered_output_summary(spark: SparkSession, d: str) -> DataFrame:
    """Panels with the same order, and with the same roster, of their first targets, per support, release pair and length."""
    sums = ordered_outputs(spark, d).groupBy(*P[:2], "k").agg(F.count("*").alias("panels"), F.count_if("same_order").alias("same_order"), F.count_if("same_roster").alias("same_roster"))
    return _rounded(sums.withColumns({"order_fraction": F.col("same_order") / F.col("panels"), "roster_fraction": F.col("same_roster") / F.col("panels")}))


def _capture_values(spark: SparkSession, d: str) -> DataFrame:
    """Per primary panel: the share of the new top targets that the old score, and that the old evidence, puts on top."""
    rows = members(spark, d).filter(F.col("support_name") == PRIMARY).withColumn("evidence", F.coalesce("old_evidence_count", F.lit(0)).cast("double"))
    hits = F.col("new_above") < BUDGET
    ranked = panel.with_ladder(panel.both_ladders(rows, P), P, "evidence", "e_")
    shares = [(F.count_if(hits & (F.col(f"{s}above") < BUDGET)) / F.count_if(hits)).alias(n) for s, n in (("old_", "by_score"), ("e_", "by_evidence"))]
    return cut_lineage(_rounded(ranked.groupBy(*P[1:]).agg(*shares)))


def left_out_choice(spark: SparkSession, d: str) -> DataFrame:
    """For every release pair, the measure that captures more in all the others, and what it captures here against the best one here."""
    values = _capture_values(spark, d).groupBy("release_pair").agg(F.sum("by_score").alias("a"), F.sum("by_evidence").alias("b"), F.count("*").alias("n")).withColumn("_all", F.lit(1))
    totals = values.groupBy("_all").agg(*[F.sum(c).alias(f"_{c}") for c in "abn"])
    others = {c: F.round((F.col(f"_{c}") - F.col(c)) / F.nullif(F.col("_n") - F.col("n"), F.lit(0)), 9) for c in "ab"}
    first = F.coalesce(others["a"] >= others["b"], F.lit(True))
    here = F.when(first, F.col("a")).otherwise(F.col("b")) / F.col("n")
    return _rounded(values.join(totals, "_all").select("release_pair", F.when(first, "by_score").otherwise("by_evidence").alias("chosen"), here.alias("captured"), (F.greatest("a", "b") / F.col("n") - here).alias("loss")))


def capture_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the mean capture of either measure and of their paired difference, panels drawn together."""
    values = cut_lineage(_capture_values(spark, d).withColumn("difference", F.round(F.col("by_score") - F.col("by_evidence"), 9)))
    names = ["by_score", "by_evidence", "difference"]
    plan = resampling.hashed_plan(values, "canonical_disease_id", ["release_pair"], DRAWS)
    draws = cut_lineage(resampling.draw_means(values, plan, ["release_pair"], "canonical_disease_id", names))
    return _rounded(resampling.percentile_intervals(values, draws, ["release_pair"], names))


def movement_features(spark: SparkSession, d: str) -> DataFrame:
    """Half the L1 distance of a panel's allocations, split into members called stable and others, with their shares of it."""
    rows = members(spark, d)
    flag = F.coalesce(F.col("stable_entity_member"), F.lit(False))
    moved = _weight_changes(spark, d).join(rows.select(*P, TARGET, flag.alias("_f")), [*P, TARGET])
    half = F.abs("weight") / 2
    sums = moved.groupBy(*P).agg(F.sum(half).alias("half_l1"), F.sum(F.when(F.col("_f"), half).otherwise(0.0)).alias("stable_movement"), F.sum(F.when(~F.col("_f"), half).otherwise(0.0)).alias("other_movement"))
    return _rounded(sums.withColumn("stable_share", ratio(F.col("stable_movement"), F.col("half_l1"))))


QUERIES = {
    f.__name__: f
    for f in (
        leader_lists, changed_leaders, fixed_layers, layer_comparison, ablation_panels, ablation_summary, matched_support, endpoint_matrix, ordered_outputs, score_distribution, signed_mass, change_signs, state_contrasts, span_bounds,
        direction_agreement, response_classes, action_overlap, flips, offered_totals, continuous_effect, degree_baseline, change_band, cluster_intervals, selection_optimism, category_ledger,
        paired_updates, selection_table, affine_features, hit_contrasts, ordered_output_summary, left_out_choice, capture_intervals, movement_features,
    )
}

# The same in SQL.

_LEAD = f"{_RANKED}, lead_ AS (SELECT *, ro = 1 ol, rn = 1 nl FROM ranked)"
_LAYERS = f"""{_PM}, lay AS (SELECT 'PRIMARY' layer, * FROM pm UNION ALL SELECT 'STABLE', * FROM pm WHERE stable),
ok AS (SELECT layer, {_BY}, count(*) k FROM lay GROUP BY 1, 2, 3, 4 HAVING count(*) >= 30 AND count(DISTINCT o) >= 2 AND count(DISTINCT n) >= 2),
lf AS (SELECT *, o = max(o) OVER p ol, n = max(n) OVER p nl FROM lay WINDOW p AS (PARTITION BY layer, {_BY})), prim AS (SELECT {_BY}, t FROM lf WHERE layer = 'PRIMARY' AND ol <> nl),
fx AS (SELECT layer, {_BY}, k, count(*) FILTER (ol) a, count(*) FILTER (nl) b, count(*) FILTER (ol AND nl) s, bool_or(ol <> nl) changed, count(*) FILTER (ol AND nl) = 0 disjoint_, count(*) FILTER (ol <> nl AND (support_name, release_pair, d, t) IN (FROM prim)) m FROM lf JOIN ok USING (layer, {_BY}) WHERE ol OR nl GROUP BY ALL)"""
_STABLE = r"""sd AS (SELECT DISTINCT replace(upper(trim(canonical_disease_id)), ':', '_') d FROM disease_crosswalk WHERE lower(trim(stable_entity_eligible)) IN ('true', '1')),
stt AS (SELECT DISTINCT regexp_replace(upper(trim(canonical_target_id)), '\.[0-9]+$', '') t FROM target_crosswalk WHERE lower(trim(stable_entity_eligible)) IN ('true', '1'))"""
_ABLATION = f"""{_PM}, {_STABLE}, pr AS (SELECT *, d IN (SELECT d FROM sd WHERE d <> '') ds, t IN (SELECT t FROM stt WHERE t <> '') ts FROM pm WHERE support_name = '{PRIMARY}'),
st AS (SELECT 'PRIMARY_FIXED' stage, * FROM pr UNION ALL SELECT 'STABLE_DISEASE_ONLY', * FROM pr WHERE ds UNION ALL SELECT 'STABLE_TARGET_ONLY', * FROM pr WHERE ts UNION ALL SELECT 'STABLE_DISEASE_AND_TARGET', * FROM pr WHERE ds AND ts),
ok AS (SELECT stage, release_pair, d, count(*) k FROM st GROUP BY 1, 2, 3 HAVING count(*) >= 30 AND count(DISTINCT o) >= 2 AND count(DISTINCT n) >= 2),
pos AS (SELECT st.*, k, row_number() OVER (p ORDER BY o DESC, t) po, row_number() OVER (p ORDER BY n DESC, t) pn, max(o) OVER p bo, max(n) OVER p bn FROM st JOIN ok USING (stage, release_pair, d) WINDOW p AS (PARTITION BY stage, release_pair, d)),
ab AS (SELECT stage AS restriction_stage, release_pair, d AS canonical_disease_id, any_value(k) AS panel_members, bool_or((o = bo) <> (n = bn)) AS leaders_changed, bool_or((po <= 10) <> (pn <= 10)) AS top_10_changed,
  round(count(*) FILTER (po <= 10 AND pn <= 10) / count(*) FILTER (po <= 10 OR pn <= 10), 9) AS top_10_jaccard FROM pos GROUP BY 1, 2, 3)"""
_VALUES = f"""{_PM}, pv AS (SELECT release_pair, d, round(avg(abs(n - o)), 9) mean_change, round(avg((n <> o)::INT::DOUBLE), 9) changed_share, count(*) FILTER (n <> o) c, count(*) k FROM pm WHERE support_name = '{PRIMARY}' GROUP BY 1, 2)"""


def _picks(rows: str, scope: str) -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY md5(d), d) - 1 no, count(*) OVER (PARTITION BY {scope}) nn FROM {rows}),
picks AS (SELECT {scope}, draw, ('0x' || substr(md5(draw || '|' || no), 1, 8))::BIGINT % nn pick FROM numbered, (SELECT unnest(range({DRAWS})) draw)), drawn AS (SELECT draw, m.* FROM picks p JOIN numbered m ON m.{scope} = p.{scope} AND m.no = pick)"""


_STATES = ", ".join(f"sum(CASE WHEN stable THEN least(greatest({b} - ({r} - 1), 0), {c}) / {c}::DOUBLE ELSE 0 END) m{i}{h}" for i, (r, c) in enumerate((("ro", "co"), ("rn", "cn"))) for h, b in enumerate((BUDGET, 2 * BUDGET)))
_TERMS = ", ".join(f"('{n}', {s[0]}, {s[1]}, {s[2]}, {m}, {len(x)})" for n, x in factorial_contrasts(FACTORS).items() for s, m in x.items())
_DIRECTIONS = f"""{_W}, v AS (SELECT *, round(wn - wo, 12) x FROM w WHERE wn <> wo), b AS (SELECT {_BY}, coalesce(sum(x * lab), 0) known, coalesce(sum(least(x, 0)) FILTER (lab IS NULL), 0) lo, coalesce(sum(greatest(x, 0)) FILTER (lab IS NULL), 0) hi FROM v GROUP BY {_BY}),
dir AS (SELECT {_BY}, CASE WHEN round(known + lo, 12) = 0 AND round(known + hi, 12) = 0 THEN 'zero' WHEN round(known + hi, 12) < 0 THEN 'negative' WHEN round(known + lo, 12) > 0 THEN 'positive' ELSE 'unresolved' END x FROM b)"""
_PAIRED = f"support_name = '{PRIMARY}'", f"support_name = '{OTHER}'"

ORACLE = {
    "leader_lists": f"""WITH {_LEAD}, s AS (SELECT {_BY}, t, 'old' side FROM lead_ WHERE ol UNION ALL SELECT {_BY}, t, 'new' FROM lead_ WHERE nl)
SELECT {_ID}, side, count(*) AS leaders, CASE WHEN count(*) <= {LISTED} THEN string_agg(t, ';' ORDER BY t) END AS leader_ids FROM s GROUP BY {_BY}, side""",
    "changed_leaders": f"WITH {_LEAD}, c AS (SELECT *, bool_or(ol <> nl) OVER (PARTITION BY {_BY}) ch FROM lead_) SELECT {_ID}, t AS canonical_target_id, ol AS old_leader, nl AS new_leader FROM c WHERE ch AND (ol OR nl)",
    "fixed_layers": f"WITH {_LAYERS} SELECT layer, {_ID}, k AS panel_members, a AS old_leaders, b AS new_leaders, s AS shared_leaders, changed, disjoint_ AS disjoint, m AS moved_as_in_primary FROM fx",
    "layer_comparison": f"""WITH {_LAYERS}, q AS (SELECT layer, support_name, release_pair, count(*) p, count(*) FILTER (changed) c, count(*) FILTER (disjoint_) x, count(*) FILTER (changed AND m > 0) r FROM fx GROUP BY 1, 2, 3)
SELECT layer, support_name, release_pair, p AS panels, c AS changed_panels, x AS disjoint_panels, r AS corroborated_panels, round(c / p, 9) AS changed_fraction, round(x / p, 9) AS disjoint_fraction, round(r / nullif(c, 0), 9) AS corroborated_fraction FROM q""",
    "ablation_panels": f"WITH {_ABLATION} SELECT * FROM ab",
    "ablation_summary": f"""WITH {_ABLATION}, s AS (SELECT restriction_stage, release_pair, count(*) panels, sum(panel_members)::BIGINT pairs, count(*) FILTER (leaders_changed) lc, count(*) FILTER (top_10_changed) tc, quantile_cont(panel_members::DOUBLE, 0.5) mm, quantile_cont(top_10_jaccard, 0.5) mj FROM ab GROUP BY 1, 2)
SELECT s.restriction_stage, s.release_pair, s.panels, s.pairs, s.lc AS leaders_changed, s.tc AS top_10_changed, s.mm AS median_members, round(s.mj, 9) AS median_top_10_jaccard, b.panels - s.panels AS removed_panels, round(s.lc / s.panels, 9) AS leaders_changed_fraction
FROM s LEFT JOIN (SELECT * FROM s WHERE restriction_stage = 'PRIMARY_FIXED') b ON b.release_pair = s.release_pair""",
    "matched_support": f"""WITH {_PM}, sh AS (SELECT * FROM pm WHERE support_name IN ('{PRIMARY}', '{OTHER}') QUALIFY count(*) OVER (PARTITION BY release_pair, d, t) = 2),
ok AS (SELECT release_pair, d FROM (SELECT {_BY} FROM sh GROUP BY 1, 2, 3 HAVING count(*) >= 30 AND count(DISTINCT o) >= 2 AND count(DISTINCT n) >= 2) GROUP BY 1, 2 HAVING count(*) = 2),
f AS (SELECT {_BY}, count(*) k, bool_or((o = bo) <> (n = bn)) c FROM (SELECT *, max(o) OVER p bo, max(n) OVER p bn FROM sh JOIN ok USING (release_pair, d) WINDOW p AS (PARTITION BY {_BY})) GROUP BY 1, 2, 3)
SELECT support_name, release_pair, count(*) AS panels, sum(k)::BIGINT AS pairs, count(*) FILTER (c) AS changed_panels, round(count(*) FILTER (c) / count(*), 9) AS changed_fraction FROM f GROUP BY 1, 2""",
    "endpoint_matrix": f"""WITH {_RANKED}, f AS (SELECT {_BY}, count(*) k, bool_or((ro = 1) <> (rn = 1)) a, NOT bool_or(ro = 1 AND rn = 1) b, bool_or(m >= 10 AND (ro <= 10) <> (rn <= 10)) c FROM ranked GROUP BY 1, 2, 3 HAVING count(DISTINCT o) >= 2 AND count(DISTINCT n) >= 2),
e AS (SELECT support_name, release_pair, z minimum_panel_size, unnest(['eligible_panel_count', 'leading_set_changed', 'leading_sets_disjoint', 'top_10_changed']) endpoint, unnest([true, a, b, c]) h FROM f, (SELECT unnest([20, 30, 50]) z) WHERE k >= z)
SELECT support_name, release_pair, minimum_panel_size, endpoint, count(*) FILTER (h) AS numerator, count(*) AS denominator, CASE WHEN endpoint = 'eligible_panel_count' THEN count(*)::DOUBLE ELSE round(count(*) FILTER (h) / count(*), 9) END AS value FROM e GROUP BY 1, 2, 3, 4""",
    "ordered_outputs": f"""WITH {_PM}, pos AS (SELECT {_BY}, row_number() OVER (PARTITION BY {_BY} ORDER BY o DESC, t) po, row_number() OVER (PARTITION BY {_BY} ORDER BY n DESC, t) pn FROM pm)
SELECT {_ID}, k, bool_and(po = pn) AS same_order, bool_and(po <= k AND pn <= k) AS same_roster FROM pos, (SELECT unnest([5, 10, 20]) k) WHERE po <= k OR pn <= k GROUP BY {_BY}, k""",
    "score_distribution": f"""WITH {_PM}, c AS (SELECT support_name, release_pair, round(n - o, 3) + 0.0 change, count(*) AS rows FROM pm GROUP BY 1, 2, 3)
SELECT support_name, release_pair, change, rows, round(rows / sum(rows) OVER (PARTITION BY support_name, release_pair), 9) AS fraction, round(sum(rows) OVER (PARTITION BY support_name, release_pair ORDER BY change) / sum(rows) OVER (PARTITION BY support_name, release_pair), 9) AS cumulative FROM c""",
    "signed_mass": f"""WITH {_PM}, v AS (SELECT {_BY}, round(avg(n - o), 9) x FROM pm GROUP BY 1, 2, 3) SELECT support_name, release_pair, {_r('sum(greatest(x, 0))')} AS positive_sum, {_r('sum(greatest(-x, 0))')} AS negative_sum, {_r('sum(abs(x))')} AS absolute_sum, {_r('sum(x)')} AS signed_sum, {_r('avg(x)')} AS mean,
{_r('min(x)')} AS minimum, {_r('max(x)')} AS maximum, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x = 0) AS n_zero, count(*) FILTER (x > 0) AS n_positive, {_r('quantile_cont(x, 0.5)')} AS median FROM v GROUP BY 1, 2""",
    "change_signs": f"""WITH {_PM}, v AS (SELECT {_BY}, round(avg(n - o), 9) x, avg((ne - oe)::DOUBLE) y FROM pm GROUP BY 1, 2, 3), k AS (SELECT support_name, release_pair, sign(x) a, sign(y) b FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT * FROM (SELECT DISTINCT support_name, release_pair FROM k), (VALUES ('negative', -1), ('zero', 0), ('positive', 1)) p(first_sign, a), (VALUES ('negative', -1), ('zero', 0), ('positive', 1)) q(second_sign, b))
SELECT g.support_name, g.release_pair, first_sign, second_sign, count(k.a) AS rows FROM g LEFT JOIN k ON k.support_name = g.support_name AND k.release_pair = g.release_pair AND k.a = g.a AND k.b = g.b GROUP BY 1, 2, 3, 4""",
    "state_contrasts": f"""WITH {_RANKED}, st AS (SELECT {_BY}, {_STATES} FROM ranked WHERE support_name IN ('{PRIMARY}', '{OTHER}') GROUP BY 1, 2, 3),
x AS (SELECT release_pair, d, (support_name = '{OTHER}')::INT s, unnest([0, 0, 1, 1]) r, unnest([0, 1, 0, 1]) h, unnest([m00, m01, m10, m11]) v FROM st), c AS (SELECT * FROM (VALUES {_TERMS}) z(contrast, s, r, h, m, k))
SELECT release_pair, d AS canonical_disease_id, contrast, CASE WHEN count(v) = max(k) THEN {_r('sum(m * v)')} END AS value FROM x JOIN c USING (s, r, h) GROUP BY 1, 2, 3""",
    "span_bounds": f"""WITH {_W}, b AS (SELECT {_BY}, round(coalesce(sum(wn * lab), 0), 12) lo, round(coalesce(sum(wn * lab), 0) + coalesce(sum(wn) FILTER (lab IS NULL), 0), 12) hi FROM w WHERE wn > 0 GROUP BY 1, 2, 3),
k AS (SELECT *, max(release_pair) OVER p l, count(*) OVER p - 1 q FROM b WINDOW p AS (PARTITION BY support_name, d)), s AS (SELECT *, CASE WHEN release_pair = l THEN 1.0::DOUBLE ELSE -1.0 / q END z FROM k WHERE q > 0)
SELECT support_name, d AS canonical_disease_id, {_r('sum(least(z * lo, z * hi))')} AS lower, {_r('sum(greatest(z * lo, z * hi))')} AS upper FROM s GROUP BY 1, 2""",
    "direction_agreement": f"""WITH {_DIRECTIONS} SELECT a.release_pair, a.d AS canonical_disease_id, a.x AS first, b.x AS second, CASE WHEN a.x IN ('positive', 'negative') AND b.x IN ('positive', 'negative') THEN CASE WHEN a.x = b.x THEN 'SAME_ROBUST_DIRECTION' ELSE 'ROBUST_OPPOSITE_DIRECTION' END
WHEN a.x = 'zero' AND b.x = 'zero' THEN 'BOTH_IDENTIFIED_ZERO' WHEN a.x = 'zero' OR b.x = 'zero' THEN 'ONE_IDENTIFIED_ZERO' ELSE 'UNRESOLVED' END AS classification FROM (SELECT * FROM dir WHERE {_PAIRED[0]}) a JOIN (SELECT * FROM dir WHERE {_PAIRED[1]}) b USING (release_pair, d)""",
    "response_classes": f"""WITH {_W}, c AS (SELECT {_BY}, round(sum((wn - wo) * coalesce(stable, false)::INT), 9) x FROM w WHERE round(wn - wo, 12) <> 0 GROUP BY 1, 2, 3)
SELECT support_name, release_pair, CASE WHEN x <= -1 THEN 'NEGATIVE' WHEN x >= 1 THEN 'POSITIVE' ELSE 'BETWEEN' END AS response, count(*) AS panels FROM c GROUP BY 1, 2, 3""",
    "action_overlap": f"""WITH {_W}, v AS (SELECT *, round(wn - wo, 12) x FROM w WHERE round(wn - wo, 12) <> 0), j AS (SELECT release_pair, d, t, coalesce(a.x, 0) a, coalesce(b.x, 0) b FROM (SELECT * FROM v WHERE {_PAIRED[0]}) a FULL JOIN (SELECT * FROM v WHERE {_PAIRED[1]}) b USING (release_pair, d, t)),
s AS (SELECT release_pair, d, unnest(['ADDED', 'REMOVED']) action, greatest(unnest([a, -a]), 0) a, greatest(unnest([b, -b]), 0) b FROM j), g AS (SELECT release_pair, d, action, count(*) menu, sum(a) fa, sum(b) fb, sum(least(a, b)) ov FROM s GROUP BY 1, 2, 3)
SELECT release_pair, d AS canonical_disease_id, action, menu, {_r('fa')} AS first_mass, {_r('fb')} AS second_mass, {_r('ov')} AS overlap, {_r('least(fa, fb)')} AS capacity, {_r('fa * fb / menu')} AS uniform_product FROM g""",
    "flips": f"""WITH {_W}, a AS (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY wn DESC, t) k, sum(wn) OVER (PARTITION BY {_BY} ORDER BY wn DESC, t) c FROM w WHERE wn > 0 AND lab IS NULL),
kn AS (SELECT {_BY}, round(sum(CASE WHEN lab = 1 THEN wn WHEN lab = 0 THEN -wn ELSE 0 END), 9) x FROM w WHERE wn > 0 GROUP BY 1, 2, 3)
SELECT kn.support_name, kn.release_pair, kn.d AS canonical_disease_id, any_value(x) AS known_mass, CASE WHEN any_value(x) = 0 THEN 0 ELSE min(k) FILTER (c >= abs(x) - 1e-9) END AS flips FROM kn LEFT JOIN a USING (support_name, release_pair, d) GROUP BY 1, 2, 3""",
    "offered_totals": f"""WITH {_W}, p AS (SELECT {_BY}, CASE WHEN count(lab) = count(*) THEN sum(wn * lab) / {BUDGET} END x FROM w WHERE wn > 0 GROUP BY 1, 2, 3)
SELECT support_name, d AS canonical_disease_id, count(*) AS panels, count(x) AS assessed_panels, CASE WHEN count(x) = count(*) THEN {_r('avg(x)')} END AS mean_per_slot FROM p GROUP BY 1, 2""",
    "continuous_effect": f"WITH {_W} SELECT {_ID}, {_r('sum(wo)')} AS assessed_mass, {_r('-sum(wo * (n - o)) / sum(wo)')} AS effect FROM w WHERE wo > 0 GROUP BY {_BY}",
    "degree_baseline": f"""WITH g AS (SELECT archive_id, baseline_degree_stratum, anchor_id, coalesce(max(baseline_degree_150), 0) g FROM baseline_anchor_registry WHERE archive_id IS NOT NULL AND baseline_degree_stratum IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY archive_id, baseline_degree_stratum ORDER BY g DESC) r, count(*) OVER (PARTITION BY archive_id, baseline_degree_stratum, g) c FROM g), s AS (SELECT *, least(greatest({BUDGET} - (r - 1), 0), c) z FROM r)
SELECT archive_id, baseline_degree_stratum, anchor_id, CASE WHEN z = c THEN 1 ELSE z END::BIGINT AS num, CASE WHEN z = c THEN 1 ELSE c END::BIGINT AS den FROM s WHERE z > 0""",
    "change_band": f"""WITH {_VALUES}, {_picks('pv', 'release_pair')}, dm AS (SELECT release_pair, draw, avg(mean_change) a, avg(changed_share) b FROM drawn GROUP BY 1, 2),
pt AS (SELECT release_pair, avg(mean_change) ea, coalesce(stddev_samp(mean_change) / sqrt(count(*)), 0) sa, avg(changed_share) eb, coalesce(stddev_samp(changed_share) / sqrt(count(*)), 0) sb FROM pv GROUP BY 1),
cr AS (SELECT release_pair, quantile_cont(greatest(CASE WHEN sa > 0 THEN abs(a - ea) / sa END, CASE WHEN sb > 0 THEN abs(b - eb) / sb END), 0.95) q FROM dm JOIN pt USING (release_pair) GROUP BY 1),
un AS (SELECT release_pair, unnest(['mean_change', 'changed_share']) measure, unnest([ea, eb]) e, unnest([sa, sb]) s FROM pt)
SELECT release_pair, measure, round(e, 8) AS estimate, round(s, 8) AS se, round(q, 8) AS critical, round(e - coalesce(q, 0) * s, 8) AS lower, round(e + coalesce(q, 0) * s, 8) AS upper FROM un LEFT JOIN cr USING (release_pair)""",
    "cluster_intervals": f"""WITH {_VALUES}, cl AS (SELECT 'all' scope, d, sum(c)::BIGINT c, sum(k)::BIGINT k FROM pv GROUP BY 2), {_picks('cl', 'scope')}, dr AS (SELECT draw, sum(c) / nullif(sum(k), 0) x FROM drawn GROUP BY 1),
e AS (SELECT sum(c) / sum(k) e, count(*) nn, sum(k) tk FROM cl), se AS (SELECT sqrt(sum((c - e * k) ** 2) * any_value(nn) / (any_value(nn) - 1)) / any_value(tk) s FROM cl, e)
SELECT 'all' AS scope, {_r('any_value(e)')} AS estimate, {_r('any_value(s)')} AS se, {_r('quantile_cont(x, 0.025)')} AS lower, {_r('quantile_cont(x, 0.975)')} AS upper, count(*) AS draws, count(*) FILTER (x IS NULL) AS undefined_draws FROM dr, e, se""",
    "selection_optimism": f"""WITH {_RANKED}, er AS (SELECT *, rank() OVER (PARTITION BY {_BY} ORDER BY coalesce(oe, 0) DESC) re FROM ranked WHERE support_name = '{PRIMARY}'),
pv AS (SELECT release_pair, d, round(count(*) FILTER (rn <= {BUDGET} AND ro <= {BUDGET}) / count(*) FILTER (rn <= {BUDGET}), 9) a, round(count(*) FILTER (rn <= {BUDGET} AND re <= {BUDGET}) / count(*) FILTER (rn <= {BUDGET}), 9) b FROM er GROUP BY 1, 2), {_picks('pv', 'release_pair')},
dm AS (SELECT release_pair, draw, avg(a) a, avg(b) b FROM drawn GROUP BY 1, 2), pt AS (SELECT release_pair, avg(a) pa, avg(b) pb FROM pv GROUP BY 1)
SELECT release_pair, CASE WHEN any_value(pa) >= any_value(pb) THEN 'by_score' ELSE 'by_evidence' END AS chosen, {_r('greatest(any_value(pa), any_value(pb))')} AS apparent, {_r('avg(CASE WHEN round(a, 12) >= round(b, 12) THEN a - pa ELSE b - pb END)')} AS optimism, {_r('greatest(any_value(pa), any_value(pb)) - avg(CASE WHEN round(a, 12) >= round(b, 12) THEN a - pa ELSE b - pb END)')} AS corrected FROM dm JOIN pt USING (release_pair) GROUP BY 1""",
    "category_ledger": f"""WITH {_W}, kinds AS (SELECT regexp_replace(upper(trim(canonical_target_id)), '\\.[0-9]+$', '') t, min(source_biotype) b FROM target_crosswalk GROUP BY 1),
x AS (SELECT support_name, release_pair, wo, wn, lab, unnest([coalesce(b, 'NONE'), 'ALL']) category FROM w LEFT JOIN (SELECT * FROM kinds WHERE t <> '') USING (t) WHERE wo > 0 OR wn > 0),
y AS (SELECT support_name, release_pair, category, {', '.join(f"coalesce(sum({w}) FILTER ({m}), 0) {s}_{n}" for s, w in (("old", "wo"), ("new", "wn")) for n, m in (("returned", "true"), ("positive", "lab = 1"), ("zero", "lab = 0"), ("unknown", "lab IS NULL")))} FROM x GROUP BY 1, 2, 3)
SELECT support_name, release_pair, category, {', '.join(f"{_r(f'{s}_{n}')} AS {s}_{n}" for s in ("old", "new") for n in ("returned", "positive", "zero", "unknown"))}, {', '.join(f"{_r(f'new_{n} - old_{n}')} AS {n}_change" for n in ("returned", "positive", "zero", "unknown"))} FROM y""",
    "paired_updates": f"""WITH {_W}, v AS (SELECT *, round(wn - wo, 12) x FROM w WHERE round(wn - wo, 12) <> 0), j AS (SELECT a.support_name, a.release_pair p, b.release_pair q, a.x a, b.x b FROM v a JOIN v b ON a.support_name = b.support_name AND a.d = b.d AND a.t = b.t AND split_part(a.release_pair, '_to_', 2) = split_part(b.release_pair, '_to_', 1))
SELECT support_name, p AS first_pair, q AS second_pair, count(*) FILTER (sign(a) <> sign(b)) AS opposing, count(*) FILTER (sign(a) = sign(b)) AS shared, {_r('coalesce(sum(least(abs(a), abs(b))) FILTER (sign(a) <> sign(b)), 0)')} AS opposing_mass, {_r('coalesce(sum(least(abs(a), abs(b))) FILTER (sign(a) = sign(b)), 0)')} AS shared_mass FROM j GROUP BY 1, 2, 3""",
    "selection_table": f"""WITH {_W}, b AS (SELECT release_pair, d, t, bool_or(wn > 0) FILTER ({_PAIRED[0]}) p, bool_or(wn > 0) FILTER ({_PAIRED[1]}) o FROM w GROUP BY 1, 2, 3) SELECT release_pair, p AS in_primary, o AS in_other, count(*) AS targets FROM b WHERE p IS NOT NULL AND o IS NOT NULL GROUP BY 1, 2, 3""",
    "affine_features": f"""WITH {_PM}, f AS (SELECT {_BY}, var_pop(o) > 1e-12 x, var_pop(n) > 1e-12 y, regr_slope(n, o) s, regr_intercept(n, o) i, regr_r2(n, o) r FROM pm GROUP BY 1, 2, 3)
SELECT {_ID}, CASE WHEN x THEN round(s, 6) END AS slope, CASE WHEN x THEN round(i, 6) END AS intercept, CASE WHEN x AND y THEN round(1 - r, 6) END AS unexplained FROM f""",
    "hit_contrasts": f"""WITH {_W}, c AS (SELECT {_BY}, round(sum(CASE WHEN round(wn - wo, 12) <> 0 THEN (wn - wo) * coalesce(stable, false)::INT ELSE 0 END), 9) x FROM w GROUP BY 1, 2, 3)
SELECT support_name, release_pair, count(*) AS panels, {_r('avg(x)')} AS mean_change, {_r('avg(abs(x))')} AS mean_size, {_r('avg((abs(x) >= 1)::INT::DOUBLE)')} AS one_hit_fraction FROM c GROUP BY 1, 2""",
    "movement_features": f"""WITH {_W}, c AS (SELECT {_BY}, sum(abs(x)) / 2 h, coalesce(sum(abs(x)) FILTER (coalesce(stable, false)), 0) / 2 s FROM (SELECT *, round(wn - wo, 12) x FROM w) WHERE x <> 0 GROUP BY 1, 2, 3)
SELECT {_ID}, {_r('h')} AS half_l1, {_r('s')} AS stable_movement, {_r('h - s')} AS other_movement, {_r('s / h')} AS stable_share FROM c""",
}
ORACLE["ordered_output_summary"] = f"""WITH o AS ({ORACLE['ordered_outputs']}) SELECT support_name, release_pair, k, count(*) AS panels, count(*) FILTER (same_order) AS same_order, count(*) FILTER (same_roster) AS same_roster, round(count(*) FILTER (same_order) / count(*), 9) AS order_fraction,
round(count(*) FILTER (same_roster) / count(*), 9) AS roster_fraction FROM o GROUP BY 1, 2, 3"""
_CAPTURE = f"""{_RANKED}, er AS (SELECT *, rank() OVER (PARTITION BY {_BY} ORDER BY coalesce(oe, 0) DESC) re FROM ranked WHERE support_name = '{PRIMARY}'),
cv AS (SELECT release_pair, d, round(count(*) FILTER (rn <= {BUDGET} AND ro <= {BUDGET}) / count(*) FILTER (rn <= {BUDGET}), 9) a, round(count(*) FILTER (rn <= {BUDGET} AND re <= {BUDGET}) / count(*) FILTER (rn <= {BUDGET}), 9) b FROM er GROUP BY 1, 2)"""
ORACLE["left_out_choice"] = f"""WITH {_CAPTURE}, g AS (SELECT release_pair, sum(a) a, sum(b) b, count(*) n FROM cv GROUP BY 1), k AS (SELECT *, coalesce(round((sum(a) OVER () - a) / nullif(sum(n) OVER () - n, 0), 9) >= round((sum(b) OVER () - b) / nullif(sum(n) OVER () - n, 0), 9), true) f FROM g)
SELECT release_pair, CASE WHEN f THEN 'by_score' ELSE 'by_evidence' END AS chosen, {_r('CASE WHEN f THEN a ELSE b END / n')} AS captured, {_r('greatest(a, b) / n - CASE WHEN f THEN a ELSE b END / n')} AS loss FROM k"""
ORACLE["capture_intervals"] = f"""WITH {_CAPTURE}, pv AS (SELECT *, round(a - b, 9) c FROM cv), {_picks('pv', 'release_pair')}, dm AS (SELECT release_pair, draw, avg(a) a, avg(b) b, avg(c) c FROM drawn GROUP BY 1, 2),
u AS (SELECT release_pair, unnest(['by_score', 'by_evidence', 'difference']) measure, unnest([a, b, c]) x FROM dm), pt AS (SELECT release_pair, unnest(['by_score', 'by_evidence', 'difference']) measure, unnest([avg(a), avg(b), avg(c)]) e FROM pv GROUP BY 1)
SELECT release_pair, measure, {_r('any_value(e)')} AS estimate, {_r('quantile_cont(x, 0.025)')} AS lower, {_r('quantile_cont(x, 0.975)')} AS upper, count(*) AS draws FROM u JOIN pt USING (release_pair, measure) GROUP BY 1, 2"""
