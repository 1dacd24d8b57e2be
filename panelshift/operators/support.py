"""Supports of a comparison: classified associations, transitions between releases, fixed and native members, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelshift.functions.scalars import is_finite, ratio, when_chain

# Roster sizes, distinct scores a panel needs, top sets, and the names of the two fixed supports.
ROSTERS = (20, 30, 50)
MIN_DISTINCT = 2
TOPS = (5, 10, 20)
PAIR_SUPPORT, LASTING_SUPPORT = "PAIR_SPECIFIC_PERSISTENT", "THREE_RELEASE_PERSISTENT"


def canonical_associations(rows: DataFrame, diseases: DataFrame, targets: DataFrame, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Associations with canonical ids, state, eligibility and the first reason for exclusion.

    `rows`: release_id, disease_id, target_id, score, evidence_count, one per release and pair; `diseases` and `targets` are
    crosswalks. States: PRESENT_NULL, SCHEMA_INCOMPARABLE (not finite or out of bounds), PRESENT_ZERO, PRESENT_POSITIVE. Unmapped
    rows stay, with NULL canonical ids. A score that is NaN or infinite goes on as NULL; state and reason tell it from a missing one.
    """
    d = diseases.select("release_id", F.col("source_id").alias("disease_id"), F.col("canonical_id").alias("canonical_disease_id"), F.col("mapping_status").alias("disease_status"), F.col("stable").alias("_ds"), F.col("detail").alias("areas"))
    t = targets.select("release_id", F.col("source_id").alias("target_id"), F.col("canonical_id").alias("canonical_target_id"), F.col("mapping_status").alias("target_status"), F.col("stable").alias("_ts"))
    mapped = rows.join(d, ["release_id", "disease_id"], "left").join(t, ["release_id", "target_id"], "left")
    score, usable = F.col("score"), ("EXACT_ID", "MAPPED")
    outside = ~is_finite(score) | (score < bounds[0]) | (score > bounds[1])
    state = when_chain((score.isNull(), "PRESENT_NULL"), (outside, "SCHEMA_INCOMPARABLE"), (score == 0, "PRESENT_ZERO"), otherwise="PRESENT_POSITIVE")
    disease_ok, target_ok = F.coalesce(F.col("disease_status").isin(*usable), F.lit(False)), F.coalesce(F.col("target_status").isin(*usable), F.lit(False))
    evidence = F.coalesce(F.col("evidence_count") >= 1, F.lit(False))
    staged = mapped.withColumns({"association_state": state, "mapping_eligible": disease_ok & target_ok, "stable_entity": F.coalesce(F.col("_ds") & F.col("_ts"), F.lit(False))})
    reason = when_chain(
        (~disease_ok, F.coalesce("disease_status", F.lit("DISEASE_MAPPING_INELIGIBLE"))),
        (~target_ok, F.coalesce("target_status", F.lit("TARGET_IDENTIFIER_NOT_EXACT"))),
        (F.col("association_state") == "PRESENT_NULL", "PRESENT_NULL"),
        ((F.col("association_state") == "SCHEMA_INCOMPARABLE") & ~is_finite(score), "SCORE_NONFINITE"),
        (F.col("association_state") == "SCHEMA_INCOMPARABLE", "SCORE_OUT_OF_BOUNDS"),
        (F.col("association_state") == "PRESENT_ZERO", "PRESENT_ZERO"),
        (~evidence, "MISSING_OR_NONPOSITIVE_EVIDENCE_COUNT"),
        otherwise="",
    )
    judged = staged.withColumns({"exclusion_reason": reason}).withColumns({"eligible": F.col("exclusion_reason") == "", "score": F.when(is_finite(score), score)})
    return judged.drop("_ds", "_ts", "disease_status", "target_status")


def release_list(df: DataFrame, release: str = "release_id") -> list[str]:
    """The releases in order; a short list by nature."""
    return sorted(r[0] for r in df.select(release).filter(F.col(release).isNotNull()).distinct().collect())


def state_transitions(canonical: DataFrame, releases: list[str]) -> DataFrame:
    """Every canonical pair that is in either of two consecutive releases, with both states and the transition class.

    All release pairs come from one grouping by pair, not from a join per release pair.
    """
    fields = F.struct("association_state", "eligible", "score", "evidence_count", "disease_id", "target_id", "stable_entity", "areas")
    wide = canonical.filter("mapping_eligible").groupBy("canonical_disease_id", "canonical_target_id").agg(*[F.max(F.when(F.col("release_id") == r, fields)).alias(f"_r{i}") for i, r in enumerate(releases)])
    steps = F.array(*[F.struct(F.lit(a).alias("old_release"), F.lit(b).alias("new_release"), F.col(f"_r{i}").alias("o"), F.col(f"_r{i + 1}").alias("n")) for i, (a, b) in enumerate(zip(releases, releases[1:]))])
    each = wide.select("canonical_disease_id", "canonical_target_id", F.inline(steps)).filter("o is not null or n is not null")
    o, n = F.col("o"), F.col("n")
    flat = each.select(
        F.concat_ws("_to_", "old_release", "new_release").alias("release_pair"), "old_release", "new_release", "canonical_disease_id", "canonical_target_id",
        F.coalesce(o["association_state"], F.lit("ABSENT_PAIR")).alias("old_state"), F.coalesce(n["association_state"], F.lit("ABSENT_PAIR")).alias("new_state"),
        F.coalesce(o["eligible"], F.lit(False)).alias("old_eligible"), F.coalesce(n["eligible"], F.lit(False)).alias("new_eligible"),
        o["score"].alias("old_score"), n["score"].alias("new_score"), o["evidence_count"].alias("old_evidence_count"), n["evidence_count"].alias("new_evidence_count"),
        F.coalesce((o["disease_id"] != n["disease_id"]) | (o["target_id"] != n["target_id"]), F.lit(False)).alias("mapping_affected"),
        F.coalesce(o["stable_entity"] & n["stable_entity"], F.lit(False)).alias("stable_entity"), F.coalesce(o["areas"], n["areas"]).alias("areas"),
    )
    both = F.col("old_eligible") & F.col("new_eligible")
    incomparable = (F.col("old_state") == "SCHEMA_INCOMPARABLE") | (F.col("new_state") == "SCHEMA_INCOMPARABLE")
    return flat.withColumn(
        "transition_class",
        when_chain(
            (incomparable, "SCHEMA_INCOMPARABLE"), (both & F.col("mapping_affected"), "PERSISTENT_MAPPING_AFFECTED"), (both, "PERSISTENT_POSITIVE"),
            ((F.col("old_state") == "ABSENT_PAIR") & F.col("new_eligible"), "ENTRANT"), (F.col("old_eligible") & (F.col("new_state") == "ABSENT_PAIR"), "EXIT"),
            (F.col("mapping_affected"), "MAPPING_AFFECTED"), otherwise="NON_PRIMARY_STATE_TRANSITION",
        ),
    )


def entrant_exit_records(transitions: DataFrame) -> DataFrame:
    """Transitions other than plain persistence, with a record category and a context class."""
    kind = F.col("transition_class")
    category = when_chain((kind == "ENTRANT", "ENTRANT"), (kind == "EXIT", "EXIT"), (kind.isin("PERSISTENT_MAPPING_AFFECTED", "MAPPING_AFFECTED"), "MAPPING_AFFECTED"), otherwise="NON_PRIMARY_STATE")

    def either(state: str):
        return (F.col("old_state") == state) | (F.col("new_state") == state)

    context = when_chain(
        (F.col("mapping_affected") | kind.contains("MAPPING"), "MAPPING_AFFECTED"), (either("PRESENT_ZERO"), "PRESENT_ZERO"), (either("PRESENT_NULL"), "PRESENT_NULL"),
        (either("SCHEMA_INCOMPARABLE"), "SCHEMA_INCOMPARABLE"), ((F.col("old_state") == "ABSENT_PAIR") & (F.col("new_state") == "PRESENT_POSITIVE"), "ENTRANT"),
        ((F.col("old_state") == "PRESENT_POSITIVE") & (F.col("new_state") == "ABSENT_PAIR"), "EXIT"), otherwise="OTHER",
    )
    applicable = F.when(context == "ENTRANT", F.col("new_score")).when(context == "EXIT", F.col("old_score")).otherwise(F.coalesce("new_score", "old_score"))
    return transitions.filter(kind != "PERSISTENT_POSITIVE").withColumns({"record_category": category, "context_class": context, "applicable_score": applicable})


def fixed_members(transitions: DataFrame, releases: list[str]) -> DataFrame:
    """Members of fixed supports: PAIR_SUPPORT (eligible in both releases) and LASTING_SUPPORT (eligible in every release, named after the usual three)."""
    pair = Window.partitionBy("canonical_disease_id", "canonical_target_id")
    columns = ["release_pair", "old_release", "new_release", "canonical_disease_id", "canonical_target_id", "old_score", "new_score", "old_evidence_count", "new_evidence_count"]
    both = transitions.filter("old_eligible and new_eligible").withColumns({"_n": F.count("*").over(pair), "_stable": F.min("stable_entity").over(pair)})  # one row per release pair
    supports = F.array(
        F.struct(F.lit(PAIR_SUPPORT).alias("support_name"), F.col("stable_entity").alias("stable_member")),
        F.when(F.col("_n") == len(releases) - 1, F.struct(F.lit(LASTING_SUPPORT).alias("support_name"), F.col("_stable").alias("stable_member"))),
    )
    each = both.select(*columns, "mapping_affected", "areas", F.inline(F.array_compact(supports)))
    return each.select("support_name", *columns, "stable_member", "mapping_affected", "areas")


def fixed_registry(members: DataFrame, primary: int = 30) -> DataFrame:
    """One row per support, release pair and panel: sizes, distinct scores, eligibility by roster and the reason against it."""
    stable = F.col("stable_member")
    panels = members.groupBy("support_name", "release_pair", "canonical_disease_id").agg(
        F.count("*").alias("target_count"), F.countDistinct("old_score").alias("old_distinct_scores"), F.countDistinct("new_score").alias("new_distinct_scores"),
        F.count_if(stable).alias("stable_target_count"), F.countDistinct(F.when(stable, F.col("old_score"))).alias("stable_old_distinct_scores"),
        F.countDistinct(F.when(stable, F.col("new_score"))).alias("stable_new_distinct_scores"), F.min("areas").alias("areas"),
    )
    spread = (F.col("old_distinct_scores") >= MIN_DISTINCT) & (F.col("new_distinct_scores") >= MIN_DISTINCT)
    stable_spread = (F.col("stable_old_distinct_scores") >= MIN_DISTINCT) & (F.col("stable_new_distinct_scores") >= MIN_DISTINCT)
    reason = when_chain(
        (F.col("target_count") < primary, "FEWER_THAN_MINIMUM_FIXED_TARGETS"), (F.col("old_distinct_scores") < MIN_DISTINCT, "DEGENERATE_OLD_SCORE_DISTRIBUTION"),
        (F.col("new_distinct_scores") < MIN_DISTINCT, "DEGENERATE_NEW_SCORE_DISTRIBUTION"), otherwise="",
    )
    return panels.withColumns(
        {f"eligible_{k}": (F.col("target_count") >= k) & spread for k in ROSTERS} | {"stable_eligible": (F.col("stable_target_count") >= primary) & stable_spread, "exclusion_reason": reason}
    )


def native_members(canonical: DataFrame) -> DataFrame:
    return canonical.filter("eligible").select("release_id", "canonical_disease_id", "canonical_target_id", "score", "evidence_count", F.col("stable_entity").alias("stable_member"), "areas")


def native_registry(members: DataFrame) -> DataFrame:
    """One row per release and panel: sizes, distinct scores, and which top sets can be estimated."""
    panels = members.groupBy("release_id", "canonical_disease_id").agg(
        F.count("*").alias("target_count"), F.countDistinct("score").alias("distinct_scores"), F.count_if("stable_member").alias("stable_target_count"), F.min("areas").alias("areas")
    )
    return panels.withColumns({f"top_{k}_estimable": F.col("target_count") >= k for k in TOPS})


def exclusion_registry(canonical: DataFrame, registry: DataFrame, diseases: DataFrame, targets: DataFrame) -> DataFrame:
    """Every excluded unit with its reason: unmapped entities, excluded associations and ineligible panels."""
    usable = ("EXACT_ID", "MAPPED")

    def entities(df: DataFrame, scope: str) -> DataFrame:
        return df.filter(~F.col("mapping_status").isin(*usable)).select(F.lit(scope).alias("exclusion_scope"), "release_id", F.lit("").alias("release_pair"), F.col("source_id").alias("unit_id"), F.col("mapping_status").alias("reason"))

    rows = canonical.filter("not eligible").select(F.lit("ASSOCIATION").alias("exclusion_scope"), "release_id", F.lit("").alias("release_pair"), F.concat_ws("|", "disease_id", "target_id").alias("unit_id"), F.col("exclusion_reason").alias("reason"))
    panels = registry.filter((F.col("support_name") == PAIR_SUPPORT) & (F.col("exclusion_reason") != "")).select(F.lit("FIXED_PANEL").alias("exclusion_scope"), F.lit("").alias("release_id"), "release_pair", F.col("canonical_disease_id").alias("unit_id"), F.col("exclusion_reason").alias("reason"))
    return entities(diseases, "DISEASE_MAPPING").unionByName(entities(targets, "TARGET_MAPPING")).unionByName(rows).unionByName(panels)


def support_flow(canonical: DataFrame, transitions: DataFrame, registry: DataFrame) -> DataFrame:
    """The funnel: units left at each stage, of how many, and the score mass they carry."""
    score = F.when(is_finite(F.col("score")), F.col("score").cast("decimal(38,18)"))
    base = canonical.groupBy("release_id").agg(
        F.count("*").alias("n0"), F.count_if("mapping_eligible").alias("n1"), F.count_if("eligible").alias("n2"), F.sum(score).alias("m0"),
        F.sum(F.when(F.col("mapping_eligible"), score)).alias("m1"), F.sum(F.when(F.col("eligible"), score)).alias("m2"),
    )
    stages = ("RAW_ASSOCIATIONS", "CANONICAL_MAPPINGS", "ELIGIBLE")
    one = base.select(F.lit("ASSOCIATION").alias("unit"), F.col("release_id").alias("scope"), F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"n{i}").alias("units"), F.col("n0").alias("of_units"), F.col(f"m{i}").cast("double").alias("score_mass")) for i, s in enumerate(stages)])))
    none = F.lit(None).cast("double").alias("score_mass")
    pairs = transitions.groupBy("release_pair").agg(F.count("*").alias("of_units"))
    two = transitions.groupBy("release_pair", "transition_class").agg(F.count("*").alias("units")).join(pairs, "release_pair").select(F.lit("PAIR").alias("unit"), F.col("release_pair").alias("scope"), F.col("transition_class").alias("stage"), "units", "of_units", none)
    panels = registry.groupBy("support_name", "release_pair").agg(F.count("*").alias("of_units"), *[F.count_if(f"eligible_{k}").alias(f"n{k}") for k in ROSTERS])
    three = panels.select(F.lit("PANEL").alias("unit"), F.concat_ws(":", "support_name", "release_pair").alias("scope"), F.inline(F.array(*[F.struct(F.lit(f"ELIGIBLE_{k}").alias("stage"), F.col(f"n{k}").alias("units")) for k in ROSTERS])), "of_units", none)
    whole = one.unionByName(two).unionByName(three)
    return whole.withColumn("fraction", ratio(F.col("units"), F.col("of_units")))
