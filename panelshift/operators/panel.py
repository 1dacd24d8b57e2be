"""Tie-aware ranks and sets within panels.

Ranks depend on a member only through its score, so they are computed on a ladder: one row per panel and distinct score with
the number of members at and above it. The ladder is pre-aggregated on the map side and ordered range by range; members
meet it again by a join on (panel, score). No panel's members or scores are sorted or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio, when_chain
from panelshift.operators.ordering import joined_on, value_range, with_quantiles

# The tolerances of leader sets, and the edges and labels of margin bins (closed on the right).
EPSILONS = (0.0, 1e-12, 1e-8, 1e-6, 1e-4, 1e-3)
MARGIN_EDGES = (0.0, 1e-12, 1e-8, 1e-6, 1e-4, 1e-3, 1e-2, 5e-2, 1.0)
MARGIN_LABELS = ("0", "(0, 1e-12]", "(1e-12, 1e-8]", "(1e-8, 1e-6]", "(1e-6, 1e-4]", "(1e-4, 1e-3]", "(1e-3, 1e-2]", "(1e-2, 5e-2]", "(5e-2, 1]")


def ladder(members: DataFrame, panel: list[str], score: str) -> DataFrame:
    """Per panel and distinct score: ties, above (members with a greater score), members (of the panel), step (1 = best). NULL scores are left out.

    Scores are ordered within ranges of values, and the ranges of a panel by their sums, so that a panel of any size spreads over many tasks.
    NULL is a panel's name like any other.
    """
    steps = members.filter(F.col(score).isNotNull()).groupBy(*panel, value_range(F.col(score)).alias("_range"), score).agg(F.count("*").alias("ties"))
    whole = Window.partitionBy(*panel)
    better = whole.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy(*panel, "_range").agg(F.sum("ties").alias("_m"), F.count("*").alias("_s"))
    offsets = sums.select(*panel, "_range", F.coalesce(F.sum("_m").over(better), F.lit(0)).alias("_above"), F.coalesce(F.sum("_s").over(better), F.lit(0)).alias("_step"), F.sum("_m").over(whole).alias("members"))
    down = Window.partitionBy(*panel, "_range").orderBy(F.col(score).desc())
    return joined_on(steps, offsets, [*panel, "_range"], "inner").select(
        *panel, score, "ties", (F.col("_above") + F.sum("ties").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")).alias("above"), "members",
        (F.col("_step") + F.row_number().over(down)).alias("step"),
    )


def with_ladder(members: DataFrame, panel: list[str], score: str, prefix: str = "") -> DataFrame:
    """Members with their ladder columns, named `prefix`ties, `prefix`above, `prefix`members and `prefix`step; NULL scores are left out."""
    steps = ladder(members, panel, score).withColumnsRenamed({c: f"{prefix}{c}" for c in ("ties", "above", "members", "step")})
    return joined_on(members.filter(F.col(score).isNotNull()), steps, [*panel, score], "inner")


def average_rank(prefix: str = "") -> Column:
    """Descending rank in which tied members share the mean of their places."""
    return F.col(f"{prefix}above") + (F.col(f"{prefix}ties") + 1) / 2.0


def in_top(k: int, prefix: str = "") -> Column:
    """Whether a member is in the tie-inclusive top k: fewer than k are above it. NULL when the panel has fewer than k members."""
    return F.when(F.col(f"{prefix}members") >= k, F.col(f"{prefix}above") < k)


def both_ladders(members: DataFrame, panel: list[str], old: str = "old_score", new: str = "new_score") -> DataFrame:
    """Members that have both scores with the ladder columns of either, `old_` and `new_`; both ladders are built in one pass."""
    known = members.filter(F.col(old).isNotNull() & F.col(new).isNotNull())
    sides = F.array(F.struct(F.lit("old_").alias("_side"), F.col(old).cast("double").alias("_score")), F.struct(F.lit("new_").alias("_side"), F.col(new).cast("double").alias("_score")))
    steps = ladder(known.select(*panel, F.inline(sides)), ["_side", *panel], "_score")
    out = known
    for side, score in (("old_", old), ("new_", new)):
        own = steps.filter(F.col("_side") == side).select(*panel, F.col("_score").alias(score), *[F.col(c).alias(f"{side}{c}") for c in ("ties", "above", "members", "step")])
        out = joined_on(out, own, [*panel, score], "inner")
    return out


def rank_displacements(members: DataFrame, panel: list[str]) -> DataFrame:
    """Members with old_rank, new_rank and displacement: the absolute difference over (members - 1), NULL for a lone member."""
    ranked = both_ladders(members, panel).withColumns({"old_rank": average_rank("old_"), "new_rank": average_rank("new_")})
    return ranked.withColumn("displacement", ratio(F.abs(F.col("new_rank") - F.col("old_rank")), F.col("old_members") - 1))


def set_overlap(flagged: DataFrame, by: list[str], old: Column, new: Column) -> DataFrame:
    """Sizes, shared members, Jaccard and change of two sets given as flags; all NULL where a set is not available."""
    sums = flagged.groupBy(*by).agg(F.sum(old.cast("long")).alias("old_size"), F.sum(new.cast("long")).alias("new_size"), F.sum((old & new).cast("long")).alias("shared"))
    available = F.col("old_size").isNotNull() & F.col("new_size").isNotNull()
    union = F.col("old_size") + F.col("new_size") - F.col("shared")
    return sums.withColumns({"jaccard": F.when(available, ratio(F.col("shared"), union)), "changed": F.when(available, F.col("shared") != union)})


def top_set_comparison(members: DataFrame, panel: list[str], cutoffs: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per panel and cutoff (0: the leaders): old and new set sizes, shared, jaccard, changed."""
    ranked = both_ladders(members, panel)
    flags = [F.struct(F.lit(0).alias("cutoff"), (F.col("old_above") == 0).alias("old_in"), (F.col("new_above") == 0).alias("new_in"))]
    flags += [F.struct(F.lit(k).alias("cutoff"), in_top(k, "old_").alias("old_in"), in_top(k, "new_").alias("new_in")) for k in cutoffs]
    return set_overlap(ranked.select(*panel, F.inline(F.array(*flags))), [*panel, "cutoff"], F.col("old_in"), F.col("new_in"))


def epsilon_leaders(members: DataFrame, panel: list[str], member: str, epsilons: tuple[float, ...] = EPSILONS) -> DataFrame:
    """Per panel and epsilon: members within epsilon of the best score in either release, the change of that set and its class.

    A member's distance from the best score is all that counts, so each member is placed once, among the epsilons that reach it.
    """
    best = members.groupBy(*panel).agg(F.max("old_score").alias("_o"), F.max("new_score").alias("_n"))
    reach = F.array(*[F.struct(F.lit(e).alias("epsilon"), (F.col("old_score") >= F.col("_o") - e).alias("_in_old"), (F.col("new_score") >= F.col("_n") - e).alias("_in_new")) for e in epsilons])
    leaders = members.select(*panel, "old_score", "new_score").join(best, panel).select(*panel, F.inline(F.filter(reach, lambda x: x["_in_old"] | x["_in_new"])))
    return leader_classes(set_overlap(leaders, [*panel, "epsilon"], F.col("_in_old"), F.col("_in_new")).withColumnsRenamed({"old_size": "old_leaders", "new_size": "new_leaders", "shared": "shared_leaders"}))


def leader_classes(sets: DataFrame) -> DataFrame:
    """The class of a change between leader sets, from their sizes and common members. The names of the classes."""
    o, n, s = F.col("old_leaders"), F.col("new_leaders"), F.col("shared_leaders")
    kept_old, kept_new = s == o, s == n
    overlap = F.when(kept_old & kept_new, "IDENTICAL").when(kept_old, "TIE_EXPANSION").when(kept_new, "TIE_CONTRACTION").otherwise("OVERLAPPING_LEADER_SET")
    return sets.withColumn("taxonomy", F.when(s > 0, overlap).otherwise(F.when(F.greatest(o, n) == 1, "UNIQUE_LEADER_REPLACEMENT").otherwise("DISJOINT_REPLACEMENT")))


def leader_margins(members: DataFrame, panel: list[str], score: str) -> DataFrame:
    """Per panel: leaders and margin, the best score minus the next lower one (0 when the lead is shared, NULL for a lone score), and its bin."""
    steps = ladder(members, panel, score)
    first, second = F.max(F.when(F.col("step") == 1, F.col(score))), F.max(F.when(F.col("step") == 2, F.col(score)))
    top = steps.groupBy(*panel).agg(F.max(F.when(F.col("step") == 1, F.col("ties"))).alias("leaders"), first.alias("best"), second.alias("_second"))
    margin = F.when(F.col("leaders") > 1, 0.0).otherwise(F.col("best") - F.col("_second"))
    return top.withColumn("margin", margin).withColumn("margin_bin", margin_bin(F.col("margin"))).drop("_second")


def margin_bin(margin: Column) -> Column:
    """Bins closed on the right, NULL for a NULL margin; scores from 0 to 1 have no margin above the last bin, others are "above 1"."""
    return when_chain((margin.isNull(), None), *[(margin <= e, name) for e, name in zip(MARGIN_EDGES, MARGIN_LABELS)], otherwise="above 1")


def turnover_reasons(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Why a set changed, from members with old_in, new_in, old_present, new_present and mapping_affected.

    UNCHANGED, the one reason of all members that came or went (MAPPING_AFFECTED, PERSISTENT_PAIR_RERANKING, ENTRANT, EXIT, UNRESOLVED),
    MIXED for several, and UNRESOLVED when a set is not available.
    """
    o, n = F.col("old_present"), F.col("new_present")
    reason = when_chain((F.col("mapping_affected"), "MAPPING_AFFECTED"), (o & n, "PERSISTENT_PAIR_RERANKING"), (~o & n, "ENTRANT"), (o & ~n, "EXIT"), otherwise="UNRESOLVED")
    moved = F.col("old_in") != F.col("new_in")
    found = flagged.withColumn("_r", F.when(moved, reason)).groupBy(*by).agg(
        F.min("_r").alias("_a"), F.max("_r").alias("_b"), F.count_if(moved).alias("moved"), F.bool_or(F.col("old_in").isNull() | F.col("new_in").isNull()).alias("_none")
    )
    return found.withColumn("reason", when_chain((F.col("_none"), "UNRESOLVED"), (F.col("moved") == 0, "UNCHANGED"), (F.col("_a") == F.col("_b"), F.col("_a")), otherwise="MIXED")).drop("_a", "_b", "_none")


def score_changes(members: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, 90th percentile and largest absolute score change, and how many changed."""
    rows, change = members.withColumn("_change", F.abs(F.col("new_score") - F.col("old_score"))), F.col("_change")
    sums = rows.groupBy(*by).agg(F.count("*").alias("members"), F.avg(change).alias("mean_change"), F.max(change).alias("max_change"), F.count_if(change > 0).alias("changed_members"))
    return with_quantiles(sums, rows, by, {"median_change": ("_change", 0.5), "q90_change": ("_change", 0.9)})


def consensus_ranks(rankings: DataFrame, entity: list[str], member: str, source: str, score: str) -> DataFrame:
    """Mean normalised rank loss of each member over all sources; a member that a source lacks loses 1 there.

    A source's loss is (2 * above + ties) / (2 * members).
    """
    losses = with_ladder(rankings, [*entity, source], score).withColumn("_loss", (2 * F.col("above") + F.col("ties")) / (2.0 * F.col("members")))
    sources = rankings.filter(F.col(score).isNotNull()).groupBy(*entity).agg(F.countDistinct(source).alias("_all"))
    sums = losses.groupBy(*entity, member).agg(F.sum("_loss").alias("_sum"), F.count("*").alias("sources"))
    return sums.join(sources, entity).select(*entity, member, "sources", ((F.col("_sum") + F.col("_all") - F.col("sources")) / F.col("_all")).alias("loss"))
