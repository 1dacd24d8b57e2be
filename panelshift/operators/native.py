"""Native panels: each release's own members of a panel, how the sets of two releases differ, and what must agree between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio, when_chain
from panelshift.operators.ordering import joined_on
from panelshift.operators.panel import average_rank, in_top, ladder, set_overlap, turnover_reasons, with_ladder

#: Top sets that are compared; 0 stands for the leaders.
CUTOFFS = (0, 5, 10, 20)


def rank_context(members: DataFrame, panel: list[str], score: str, top: int = 10) -> DataFrame:
    """Native members with first_tied_rank, tied_targets, average_rank and whether they are in the tie-inclusive top; NULL scores are left out."""
    ranked = with_ladder(members, panel, score)
    return ranked.select(*members.columns, (F.col("above") + 1).alias("first_tied_rank"), F.col("ties").alias("tied_targets"), average_rank().alias("average_rank"), (F.col("above") < top).alias("top_member"))


def context_class(mapping_affected: Column, old_present: Column, new_present: Column) -> Column:
    """Why a target came, went or moved. The names of the classes."""
    return when_chain((mapping_affected, "MAPPING_AFFECTED"), (~old_present & new_present, "ENTRANT"), (old_present & ~new_present, "EXIT"), (old_present & new_present, "PERSISTENT_PAIR_RERANKING"), otherwise="UNRESOLVED")


def paired_members(transitions: DataFrame) -> DataFrame:
    """Members of either release of panels that have members in both, from state transitions: flags of presence and their scores."""
    by = ["release_pair", "canonical_disease_id"]
    rows = transitions.filter("old_eligible or new_eligible")
    both = rows.groupBy(*by).agg(F.bool_or("old_eligible").alias("_o"), F.bool_or("new_eligible").alias("_n")).filter("_o and _n").select(*by)
    return rows.join(both, by).select(
        *by, "canonical_target_id", F.col("old_eligible").alias("old_present"), F.col("new_eligible").alias("new_present"), "mapping_affected", "stable_entity",
        F.when(F.col("old_eligible"), F.col("old_score")).alias("old_score"), F.when(F.col("new_eligible"), F.col("new_score")).alias("new_score"), "old_evidence_count", "new_evidence_count",
    )


def placed_members(members: DataFrame, panel: list[str]) -> DataFrame:
    """Paired members with the place of each side's score on that side's ladder; a member that is absent has none there."""
    sides = F.array(*[F.struct(F.lit(s).alias("_side"), F.col(f"{s}_score").alias("_score")) for s in ("old", "new")])
    steps = ladder(members.select(*panel, F.inline(sides)), ["_side", *panel], "_score")
    sizes = steps.groupBy(*panel).agg(*[F.max(F.when(F.col("_side") == s, F.col("members"))).alias(f"{s}_members") for s in ("old", "new")])
    out = joined_on(members, sizes, panel)
    for s in ("old", "new"):
        out = joined_on(out, steps.filter(F.col("_side") == s).select(*panel, F.col("_score").alias(f"{s}_score"), F.col("above").alias(f"{s}_above"), F.col("ties").alias(f"{s}_ties")), [*panel, f"{s}_score"])
    return out


def set_flags(placed: DataFrame, panel: list[str], cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Members once per cutoff with old_in and new_in; NULL where a side has fewer members than the cutoff, false for absent members."""

    def inside(side: str, cutoff: int) -> Column:
        flag = F.col(f"{side}_above") == 0 if cutoff == 0 else in_top(cutoff, f"{side}_")
        available = F.coalesce(F.col(f"{side}_members"), F.lit(0)) >= max(cutoff, 1)
        return F.when(available, F.coalesce(flag, F.lit(False)))

    flags = F.array(*[F.struct(F.lit(k).alias("cutoff"), inside("old", k).alias("old_in"), inside("new", k).alias("new_in")) for k in cutoffs])
    return placed.select(*panel, "canonical_target_id", "old_present", "new_present", "mapping_affected", F.inline(flags))


def panel_metrics(placed: DataFrame, panel: list[str]) -> DataFrame:
    """Per panel and cutoff: set sizes, shared, jaccard, changed and the reason of the change."""
    flagged, by = set_flags(placed, panel), [*panel, "cutoff"]
    overlap = set_overlap(flagged, by, F.col("old_in"), F.col("new_in"))
    return joined_on(overlap, turnover_reasons(flagged, by).drop("moved"), by)


def integrity_counters(members: DataFrame, registry: DataFrame, metrics: DataFrame, release: str, panel: str, member: str) -> DataFrame:
    """(counter, violations): what must not occur between native members, their registry and the metrics of release pairs; every counter has a row."""
    own = members.groupBy(release, panel, member).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("evidence_count") < 1, F.lit(True))).alias("bad"), F.count_if("stable_member").alias("stable"))
    panels = own.groupBy(release, panel).agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"), F.sum("stable").alias("_stable"), F.count_if(F.col("n") > 1).alias("_twice"))
    both = panels.join(registry.select(release, panel, "target_count", "stable_target_count", "top_10_estimable"), [release, panel], "full")
    missing, extra = F.col("target_count").isNull(), F.col("_n").isNull()
    counts = both.agg(
        F.count_if(missing).alias("member_without_registry"), F.count_if(extra).alias("registry_without_members"), F.coalesce(F.sum("_twice"), F.lit(0)).alias("duplicate_member_key"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid_evidence_count"),
        F.count_if(F.col("_n") != F.col("target_count")).alias("roster_count_mismatch"), F.count_if(F.col("_stable") != F.col("stable_target_count")).alias("stable_registry_mismatch"),
        F.count_if((F.col("_n") >= 10) != F.col("top_10_estimable")).alias("eligibility_mismatch"),
    )
    changed = F.coalesce(F.col("changed"), F.lit(False))
    reasons = metrics.agg(F.count_if(changed & (F.col("reason") == "UNRESOLVED")).alias("unresolved_changed_reason"), F.count_if(changed == (F.col("reason") == "UNCHANGED")).alias("reason_partition_mismatch"))

    def stacked(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("violations")) for c in df.columns])))

    return stacked(counts).unionByName(stacked(reasons))


def stable_areas(entries: DataFrame, releases: int, release: str, disease: str, area: str, weight: str) -> DataFrame:
    """(disease, area, weight) of assignments that every one of the `releases` has with one weight, to within 1e-12."""
    w = F.col(weight).cast("double")
    sums = entries.groupBy(disease, area).agg(F.countDistinct(release).alias("_r"), F.min(w).alias("_lo"), F.max(w).alias("_hi"))
    return sums.filter((F.col("_r") == releases) & (F.col("_hi") - F.col("_lo") <= 1e-12)).select(disease, area, F.col("_hi").alias(weight))


def weighted_fraction(flag: Column, weight: Column) -> Column:
    """Weight of the rows with a true flag over the weight of those where it is known, as an aggregate; NULL without weight."""
    return ratio(F.sum(F.when(flag, weight)), F.sum(F.when(flag.isNotNull(), weight)))


def heterogeneity(areas: DataFrame, by: list[str], fraction: str, panels: str, changes: str, spread: float = 0.1, populated: int = 20, least_areas: int = 5, least_changes: int = 3, changing_areas: int = 2) -> DataFrame:
    """Whether the change differs between areas: the range of `fraction` over populated areas, with enough such areas and enough of them with changes."""
    well = F.col(panels) >= populated
    sums = areas.groupBy(*by).agg(
        F.count_if(well).alias("populated_areas"), F.count_if(well & (F.col(changes) >= least_changes)).alias("changing_areas"), F.min(F.when(well, F.col(fraction))).alias("lowest"), F.max(F.when(well, F.col(fraction))).alias("highest")
    )
    range_ = F.col("highest") - F.col("lowest")
    met = (range_ >= spread) & (F.col("populated_areas") >= least_areas) & (F.col("changing_areas") >= changing_areas)
    return sums.withColumns({"range": range_, "heterogeneous": F.coalesce(met, F.lit(False))})


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that raises when it is executed if a key occurs twice on one of its sides; rows with a NULL key match nothing.

    The check is part of the plan: both sides are grouped by key before they meet, which is the shuffle that the join needs anyway.
    """

    def once(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        repeated = F.raise_error(F.lit(f"a key of the {side} side occurs twice")).cast("boolean")
        grouped = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min(F.struct(*rest)).alias("_rest"))
        known = [F.col(k).isNotNull() for k in keys]
        whole = known[0]
        for k in known[1:]:
            whole = whole & k
        return grouped.filter(F.when((F.col("_rows") > 1) & whole, repeated).otherwise(F.lit(True))).select(*keys, *[F.col("_rest")[c].alias(c) for c in rest])

    return once(left, "left").join(once(right, "right"), keys, how)
