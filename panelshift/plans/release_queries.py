"""Queries of the release comparison over association_support and the crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshift.functions.scalars import affirmative, clean_disease, clean_target
from panelshift.operators import identity, resampling, revision, snapshots, support
from panelshift.operators.panel import epsilon_leaders, turnover_reasons
from panelshift.session import cut_lineage
from panelshift.sources.tables import load

PAIR = ["canonical_disease_id", "canonical_target_id"]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places, so that the order of summation makes no difference."""
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"})


def disease_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "disease_crosswalk", ["release_id", "source_disease_id", "canonical_disease_id", "stable_entity_eligible", "canonical_therapeutic_area_ids"])
    return identity.crosswalk(rows, "release_id", clean_disease("source_disease_id"), clean_disease("canonical_disease_id"), affirmative(F.col("stable_entity_eligible")), "canonical_therapeutic_area_ids")


def target_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "target_crosswalk", ["release_id", "source_target_id", "canonical_target_id", "stable_entity_eligible"])
    return identity.crosswalk(rows, "release_id", clean_target("source_target_id"), clean_target("canonical_target_id"), affirmative(F.col("stable_entity_eligible")))


def latest_associations(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "association_support", ["release_id", "disease_id", "target_id", "score", "evidence_count", "record_present", "loaded_at"])
    clean = rows.withColumns({"disease_id": clean_disease("disease_id"), "target_id": clean_target("target_id")})
    return snapshots.latest_rows(clean, "release_id", ["disease_id", "target_id"], "loaded_at", ["record_present", "score", "evidence_count"]).filter("record_present").drop("record_present")


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return support.canonical_associations(latest_associations(spark, d), disease_entries(spark, d), target_entries(spark, d))


def releases(spark: SparkSession, d: str) -> list[str]:
    return support.release_list(load(spark, d, "association_support", ["release_id"]))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return support.state_transitions(canonical(spark, d), releases(spark, d))


def _kept(df: DataFrame) -> DataFrame:
    """An intermediate result that a query reads more than once, stored as a table."""
    return cut_lineage(df)


def members(spark: SparkSession, d: str) -> DataFrame:
    names = releases(spark, d)
    return support.fixed_members(support.state_transitions(canonical(spark, d), names), names)


def revisions(spark: SparkSession, d: str) -> DataFrame:
    names = releases(spark, d)
    return revision.pair_revisions(support.fixed_members(support.state_transitions(canonical(spark, d), names), names), f"{names[0]}_to_{names[1]}")


def crosswalk_statuses(spark: SparkSession, d: str) -> DataFrame:
    kinds = [x.select(F.lit(n).alias("entity"), "release_id", "mapping_status", "stable") for n, x in (("disease", disease_entries(spark, d)), ("target", target_entries(spark, d)))]
    return kinds[0].unionByName(kinds[1]).groupBy("entity", "release_id", "mapping_status").agg(F.count("*").alias("entities"), F.count_if("stable").alias("stable_entities"))


def canonical_associations(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d).select("release_id", "disease_id", "target_id", *PAIR, "score", "evidence_count", "association_state", "mapping_eligible", "stable_entity", "exclusion_reason", "eligible")


def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    return transitions(spark, d).drop("areas", "old_release", "new_release")


def membership_partition(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that persist, enter or exit, per panel and pair of consecutive releases."""
    rows = _kept(canonical(spark, d).filter("eligible"))
    found = identity.membership_partitions(rows, "release_id", releases(spark, d), PAIR)
    return found.groupBy("release_pair", "canonical_disease_id", "membership").agg(F.count("*").alias("pairs"))


def fixed_members(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).drop("old_release", "new_release", "areas")


def fixed_registry(spark: SparkSession, d: str) -> DataFrame:
    return support.fixed_registry(members(spark, d))


def native_registry(spark: SparkSession, d: str) -> DataFrame:
    return support.native_registry(support.native_members(canonical(spark, d)))


def exclusion_registry(spark: SparkSession, d: str) -> DataFrame:
    names, diseases, targets = releases(spark, d), disease_entries(spark, d), target_entries(spark, d)
    rows = _kept(support.canonical_associations(latest_associations(spark, d), diseases, targets))
    fixed = support.fixed_members(_kept(support.state_transitions(rows, names)), names)
    return support.exclusion_registry(rows, support.fixed_registry(fixed), diseases, targets)


def support_flow(spark: SparkSession, d: str) -> DataFrame:
    rows = _kept(canonical(spark, d))
    steps = _kept(support.state_transitions(rows, releases(spark, d)))
    return _rounded(support.support_flow(rows, steps, support.fixed_registry(support.fixed_members(steps, releases(spark, d)))))


def entrant_exit_records(spark: SparkSession, d: str) -> DataFrame:
    return support.entrant_exit_records(transitions(spark, d)).select("release_pair", *PAIR, "record_category", "context_class", "applicable_score")


def pair_revisions(spark: SparkSession, d: str) -> DataFrame:
    columns = ["release_pair", "support_name", *PAIR, "signed_change", "absolute_change", "exact_unchanged", "near_unchanged", "evidence_status", "mapping_context", "old_tier", "new_tier", "adjusted_change"]
    return _rounded(revisions(spark, d).select(*columns))


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(revision.score_summary(_kept(revisions(spark, d))))


def scale_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(revision.scale_diagnostic(_kept(revisions(spark, d))))


def score_tier_summary(spark: SparkSession, d: str) -> DataFrame:
    names = releases(spark, d)
    steps = _kept(support.state_transitions(canonical(spark, d), names))
    return _rounded(revision.tier_summary(revision.pair_revisions(support.fixed_members(steps, names)), support.entrant_exit_records(steps)))


def tier_area_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(revision.tier_area_distribution(revisions(spark, d)))


def area_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(revision.area_summary(_kept(revisions(spark, d))))


def concentration(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(revision.concentration(_kept(revisions(spark, d))))


def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    """Directions of both changes of pairs that every three consecutive releases have, per span of releases."""
    names = releases(spark, d)
    fixed = support.fixed_members(support.state_transitions(canonical(spark, d), names), names).filter(F.col("support_name") == support.PAIR_SUPPORT)
    return _rounded(revision.trajectory_summary(_kept(revision.trajectories(fixed, names)), ("release_span",)))


def entrant_exit_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(revision.entrant_exit_summary(_kept(support.entrant_exit_records(transitions(spark, d)))))


def native_turnover(spark: SparkSession, d: str) -> DataFrame:
    """Why the leaders of each native panel changed from release to release."""
    rows = _kept(transitions(spark, d).filter("old_eligible or new_eligible"))
    best = rows.groupBy("release_pair", "canonical_disease_id").agg(F.max(F.when(F.col("old_eligible"), F.col("old_score"))).alias("_o"), F.max(F.when(F.col("new_eligible"), F.col("new_score"))).alias("_n"))
    flags = rows.join(best, ["release_pair", "canonical_disease_id"]).select(
        "release_pair", "canonical_disease_id", F.col("old_eligible").alias("old_present"), F.col("new_eligible").alias("new_present"), "mapping_affected",
        F.when(F.col("_o").isNotNull(), F.coalesce(F.col("old_eligible") & (F.col("old_score") == F.col("_o")), F.lit(False))).alias("old_in"),
        F.when(F.col("_n").isNotNull(), F.coalesce(F.col("new_eligible") & (F.col("new_score") == F.col("_n")), F.lit(False))).alias("new_in"),
    )
    return turnover_reasons(flags, ["release_pair", "canonical_disease_id"])


REASONS = ("UNCHANGED", "MAPPING_AFFECTED", "PERSISTENT_PAIR_RERANKING", "ENTRANT", "EXIT", "MIXED", "UNRESOLVED")


def turnover_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """Panels per release pair and reason, also reasons that don't occur, with their share of the pair's panels."""
    found = _kept(native_turnover(spark, d))
    counts = found.groupBy("release_pair", "reason").agg(F.count("*").alias("panels"))
    totals = found.groupBy("release_pair").agg(F.count("*").alias("_all"))
    full = totals.withColumn("reason", F.explode(F.array(*[F.lit(r) for r in REASONS])))
    padded = full.join(counts, ["release_pair", "reason"], "left").fillna(0, ["panels"])
    return _rounded(padded.select("release_pair", "reason", "panels", (F.col("panels") / F.col("_all")).alias("fraction")))


def persistence_classes(spark: SparkSession, d: str, evidence: int = 5) -> DataFrame:
    """Whether a change of leaders holds on stable members and in an evidence domain, each where at least 30 targets with two distinct scores make a panel.

    The given tables name no evidence domains; members with at least `evidence` pieces of evidence in both releases stand for one.
    """
    by = ["release_pair", "canonical_disease_id"]
    rows = _kept(members(spark, d).filter(F.col("support_name") == support.PAIR_SUPPORT))
    layers = {"primary": F.lit(True), "stable": F.col("stable_member"), "domain": F.coalesce((F.col("old_evidence_count") >= evidence) & (F.col("new_evidence_count") >= evidence), F.lit(False))}
    layered = rows.select("*", F.explode(F.array_compact(F.array(*[F.when(holds, n) for n, holds in layers.items()]))).alias("layer"))
    changes = epsilon_leaders(layered, ["layer", *by], "canonical_target_id", (0.0,)).select("layer", *by, "changed")
    sizes = layered.groupBy("layer", *by).agg(F.count("*").alias("n"), F.least(F.countDistinct("old_score"), F.countDistinct("new_score")).alias("distinct"))
    both = changes.join(sizes, ["layer", *by]).withColumn("eligible", (F.col("n") >= 30) & (F.col("distinct") >= support.MIN_DISTINCT))
    wide = both.groupBy(*by).agg(*[F.max(F.when(F.col("layer") == n, F.col(c))).alias(f"{n}_{c}") for n in layers for c in ("changed", "eligible")])
    flags = wide.withColumns({f"{n}_eligible": F.coalesce(f"{n}_eligible", F.lit(False)) for n in ("stable", "domain")}).drop("primary_eligible")
    return flags.withColumn("persistence_class", revision.persistence_class(*[F.col(c) for c in ("primary_changed", "stable_eligible", "stable_changed", "domain_eligible", "domain_changed")]))


def change_intervals(spark: SparkSession, d: str, n: int = 2000) -> DataFrame:
    """Bootstrap intervals of a release pair's mean absolute change and share of changed scores, panels drawn with replacement."""
    per_panel = _kept(revisions(spark, d).filter("support_name = 'PAIR_SPECIFIC_PERSISTENT'").groupBy("release_pair", "canonical_disease_id").agg(F.avg("absolute_change").alias("mean_change"), F.avg((~F.col("exact_unchanged")).cast("double")).alias("changed_share")))
    plan = resampling.hashed_plan(per_panel, "canonical_disease_id", ["release_pair"], n)
    draws = resampling.draw_means(per_panel, plan, ["release_pair"], "canonical_disease_id", ["mean_change", "changed_share"])
    return _rounded(resampling.percentile_intervals(per_panel, draws, ["release_pair"], ["mean_change", "changed_share"]))


def changed_pair_ratio(spark: SparkSession, d: str, n: int = 2000) -> DataFrame:
    """Changed pairs over all pairs of a release pair, with a bootstrap interval of the ratio of sums over panels."""
    panels = _kept(revisions(spark, d).filter("support_name = 'PAIR_SPECIFIC_PERSISTENT'").groupBy("release_pair", "canonical_disease_id").agg(F.count_if(~F.col("exact_unchanged")).alias("changed"), F.count("*").alias("pairs")))
    draws = resampling.draw_ratios(panels, resampling.hashed_plan(panels, "canonical_disease_id", ["release_pair"], n), ["release_pair"], "canonical_disease_id", "changed", "pairs", "changed_ratio")
    whole = panels.groupBy("release_pair").agg((F.sum("changed") / F.sum("pairs")).alias("estimate"))
    ends = draws.groupBy("release_pair").agg(F.percentile("changed_ratio", F.array(F.lit(0.025), F.lit(0.975))).alias("_e"))
    return _rounded(whole.join(ends, "release_pair").select("release_pair", "estimate", F.col("_e")[0].alias("lower"), F.col("_e")[1].alias("upper")))


QUERIES = {
    f.__name__: f
    for f in (
        crosswalk_statuses, canonical_associations, state_transitions, membership_partition, fixed_members, fixed_registry, native_registry, exclusion_registry, support_flow,
        entrant_exit_records, pair_revisions, score_summary, scale_diagnostic, score_tier_summary, tier_area_distribution, area_summary, concentration, trajectory_summary,
        entrant_exit_summary, native_turnover, turnover_decomposition, persistence_classes, change_intervals, changed_pair_ratio,
    )
}

# The same in SQL.

_D, _T = "replace(upper(trim({})), ':', '_')", r"regexp_replace(upper(trim({})), '\.[0-9]+$', '')"


def _entries(name: str, table: str, source: str, canon: str, detail: str) -> str:
    return f"""{name}0 AS (SELECT release_id, {source} source_id, min(nullif({canon}, '')) canonical_id, max(nullif({canon}, '')) other, bool_and(coalesce(lower(trim(stable_entity_eligible)) IN ('true', '1'), false)) stable, min({detail}) detail
  FROM {table} WHERE release_id IS NOT NULL AND {source} IS NOT NULL GROUP BY 1, 2),
{name} AS (SELECT *, CASE WHEN canonical_id IS NULL THEN 'UNMAPPED' WHEN canonical_id <> other THEN 'AMBIGUOUS_ONE_TO_MANY' WHEN count(*) OVER (PARTITION BY release_id, canonical_id) > 1 THEN 'AMBIGUOUS_MANY_TO_ONE'
  WHEN canonical_id = source_id THEN 'EXACT_ID' ELSE 'MAPPED' END mapping_status FROM {name}0)"""


_WALKS = (
    _entries("xd", "disease_crosswalk", _D.format("source_disease_id"), _D.format("canonical_disease_id"), "canonical_therapeutic_area_ids")
    + ",\n"
    + _entries("xt", "target_crosswalk", _T.format("source_target_id"), _T.format("canonical_target_id"), "NULL::VARCHAR")
)
_CANON = f"""{_WALKS},
ranked AS (SELECT release_id, {_D.format('disease_id')} disease_id, {_T.format('target_id')} target_id, score, evidence_count, record_present,
  row_number() OVER (PARTITION BY release_id, {_D.format('disease_id')}, {_T.format('target_id')} ORDER BY loaded_at DESC NULLS LAST) rn FROM association_support),
mapped AS (SELECT r.release_id, disease_id, target_id, CASE WHEN isfinite(r.score) THEN r.score END score, NOT isfinite(r.score) odd, evidence_count, xd.canonical_id canonical_disease_id, xt.canonical_id canonical_target_id, xd.detail areas,
  coalesce(xd.mapping_status IN ('EXACT_ID', 'MAPPED'), false) dok, coalesce(xt.mapping_status IN ('EXACT_ID', 'MAPPED'), false) tok, xd.mapping_status dms, xt.mapping_status tms, coalesce(xd.stable AND xt.stable, false) stable_entity,
  CASE WHEN r.score IS NULL THEN 'PRESENT_NULL' WHEN NOT isfinite(r.score) OR r.score < 0 OR r.score > 1 THEN 'SCHEMA_INCOMPARABLE' WHEN r.score = 0 THEN 'PRESENT_ZERO' ELSE 'PRESENT_POSITIVE' END association_state
  FROM ranked r LEFT JOIN xd ON xd.release_id = r.release_id AND xd.source_id = disease_id LEFT JOIN xt ON xt.release_id = r.release_id AND xt.source_id = target_id
  WHERE rn = 1 AND record_present AND r.release_id IS NOT NULL AND disease_id IS NOT NULL AND target_id IS NOT NULL),
reasoned AS (SELECT *, dok AND tok mapping_eligible, CASE WHEN NOT dok THEN coalesce(dms, 'DISEASE_MAPPING_INELIGIBLE') WHEN NOT tok THEN coalesce(tms, 'TARGET_IDENTIFIER_NOT_EXACT') WHEN association_state = 'PRESENT_NULL' THEN 'PRESENT_NULL'
  WHEN association_state = 'SCHEMA_INCOMPARABLE' AND odd THEN 'SCORE_NONFINITE' WHEN association_state = 'SCHEMA_INCOMPARABLE' THEN 'SCORE_OUT_OF_BOUNDS' WHEN association_state = 'PRESENT_ZERO' THEN 'PRESENT_ZERO'
  WHEN evidence_count IS NULL OR evidence_count < 1 THEN 'MISSING_OR_NONPOSITIVE_EVIDENCE_COUNT' ELSE '' END exclusion_reason FROM mapped),
canon AS (SELECT *, exclusion_reason = '' eligible FROM reasoned)"""
_TRANS = f"""{_CANON},
rel AS (SELECT release_id r, lead(release_id) OVER (ORDER BY release_id) nxt, row_number() OVER (ORDER BY release_id) no FROM (SELECT DISTINCT release_id FROM association_support WHERE release_id IS NOT NULL)),
usable AS (SELECT * FROM canon WHERE mapping_eligible),
sides AS (SELECT r || '_to_' || nxt release_pair, canonical_disease_id d, canonical_target_id t, coalesce(max(association_state) FILTER (release_id = r), 'ABSENT_PAIR') old_state, coalesce(max(association_state) FILTER (release_id = nxt), 'ABSENT_PAIR') new_state,
  coalesce(bool_or(eligible) FILTER (release_id = r), false) old_eligible, coalesce(bool_or(eligible) FILTER (release_id = nxt), false) new_eligible, max(score) FILTER (release_id = r) old_score, max(score) FILTER (release_id = nxt) new_score,
  max(evidence_count) FILTER (release_id = r) old_evidence_count, max(evidence_count) FILTER (release_id = nxt) new_evidence_count,
  coalesce(max(disease_id) FILTER (release_id = r) <> max(disease_id) FILTER (release_id = nxt) OR max(target_id) FILTER (release_id = r) <> max(target_id) FILTER (release_id = nxt), false) mapping_affected,
  coalesce(bool_or(stable_entity) FILTER (release_id = r) AND bool_or(stable_entity) FILTER (release_id = nxt), false) stable_entity, coalesce(max(areas) FILTER (release_id = r), max(areas) FILTER (release_id = nxt)) areas
  FROM rel JOIN usable ON release_id IN (r, nxt) WHERE nxt IS NOT NULL GROUP BY 1, 2, 3),
trans AS (SELECT *, CASE WHEN old_state = 'SCHEMA_INCOMPARABLE' OR new_state = 'SCHEMA_INCOMPARABLE' THEN 'SCHEMA_INCOMPARABLE' WHEN old_eligible AND new_eligible AND mapping_affected THEN 'PERSISTENT_MAPPING_AFFECTED'
  WHEN old_eligible AND new_eligible THEN 'PERSISTENT_POSITIVE' WHEN old_state = 'ABSENT_PAIR' AND new_eligible THEN 'ENTRANT' WHEN old_eligible AND new_state = 'ABSENT_PAIR' THEN 'EXIT' WHEN mapping_affected THEN 'MAPPING_AFFECTED'
  ELSE 'NON_PRIMARY_STATE_TRANSITION' END transition_class FROM sides)"""
_RECORDS = """records AS (SELECT *, CASE WHEN context_class = 'ENTRANT' THEN new_score WHEN context_class = 'EXIT' THEN old_score ELSE coalesce(new_score, old_score) END applicable_score FROM (
  SELECT *, CASE WHEN transition_class IN ('ENTRANT', 'EXIT') THEN transition_class WHEN transition_class IN ('PERSISTENT_MAPPING_AFFECTED', 'MAPPING_AFFECTED') THEN 'MAPPING_AFFECTED' ELSE 'NON_PRIMARY_STATE' END record_category,
  CASE WHEN mapping_affected OR transition_class LIKE '%MAPPING%' THEN 'MAPPING_AFFECTED' WHEN 'PRESENT_ZERO' IN (old_state, new_state) THEN 'PRESENT_ZERO' WHEN 'PRESENT_NULL' IN (old_state, new_state) THEN 'PRESENT_NULL'
  WHEN 'SCHEMA_INCOMPARABLE' IN (old_state, new_state) THEN 'SCHEMA_INCOMPARABLE' WHEN old_state = 'ABSENT_PAIR' AND new_state = 'PRESENT_POSITIVE' THEN 'ENTRANT' WHEN old_state = 'PRESENT_POSITIVE' AND new_state = 'ABSENT_PAIR' THEN 'EXIT'
  ELSE 'OTHER' END context_class FROM trans WHERE transition_class <> 'PERSISTENT_POSITIVE'))"""
_FIXED = f"""{_TRANS},
both_in AS (SELECT release_pair, d, t, old_score, new_score, old_evidence_count, new_evidence_count, stable_entity stable_member, mapping_affected, areas FROM trans WHERE old_eligible AND new_eligible),
lasting AS (SELECT d, t, bool_and(stable_member) s FROM both_in GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) - 1 FROM rel)),
fixed AS (SELECT 'PAIR_SPECIFIC_PERSISTENT' support_name, * FROM both_in UNION ALL SELECT 'THREE_RELEASE_PERSISTENT', b.* REPLACE (s AS stable_member) FROM both_in b JOIN lasting USING (d, t)),
registry AS (SELECT support_name, release_pair, d canonical_disease_id, count(*) target_count, count(DISTINCT old_score) old_distinct_scores, count(DISTINCT new_score) new_distinct_scores, count(*) FILTER (stable_member) stable_target_count,
  count(DISTINCT old_score) FILTER (stable_member) stable_old_distinct_scores, count(DISTINCT new_score) FILTER (stable_member) stable_new_distinct_scores, min(areas) areas FROM fixed GROUP BY 1, 2, 3),
judged AS (SELECT *, target_count >= 20 AND old_distinct_scores >= 2 AND new_distinct_scores >= 2 eligible_20, target_count >= 30 AND old_distinct_scores >= 2 AND new_distinct_scores >= 2 eligible_30,
  target_count >= 50 AND old_distinct_scores >= 2 AND new_distinct_scores >= 2 eligible_50, stable_target_count >= 30 AND stable_old_distinct_scores >= 2 AND stable_new_distinct_scores >= 2 stable_eligible,
  CASE WHEN target_count < 30 THEN 'FEWER_THAN_MINIMUM_FIXED_TARGETS' WHEN old_distinct_scores < 2 THEN 'DEGENERATE_OLD_SCORE_DISTRIBUTION' WHEN new_distinct_scores < 2 THEN 'DEGENERATE_NEW_SCORE_DISTRIBUTION' ELSE '' END exclusion_reason FROM registry)"""


def _tier(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {low} AND {x} <= {high} THEN '{label}'" for low, high, label in revision.TIERS) + " ELSE 'unclassified' END"


_REV = f"""{_FIXED},
rev AS (SELECT *, new_score - old_score signed_change, abs(new_score - old_score) absolute_change, old_score = new_score exact_unchanged, abs(new_score - old_score) <= 1e-12 near_unchanged,
  CASE WHEN old_evidence_count IS NULL OR new_evidence_count IS NULL THEN 'missing' WHEN old_evidence_count = new_evidence_count THEN 'unchanged' ELSE 'changed' END evidence_status,
  CASE WHEN mapping_affected THEN 'raw_identifier_mapping_affected' ELSE 'canonical_identifier_stable' END mapping_context, {_tier('old_score')} old_tier, {_tier('new_score')} new_tier,
  CASE WHEN release_pair = (SELECT r || '_to_' || nxt FROM rel WHERE no = 1) THEN abs(new_score - old_score * {revision.SCALE}) END adjusted_change FROM fixed),
areal AS (SELECT *, (1::DECIMAL(38,18) / len(l)::DECIMAL(10,0))::DOUBLE w, unnest(l) area_id FROM (SELECT *, list_distinct(list_filter(string_split(areas, ';'), lambda x: x <> '')) l FROM rev) WHERE len(l) > 0)"""
_CUT = ", ".join(f"count(*) FILTER ({{0}} >= {c}) / count(*) AS {{1}}_ge_{str(c).replace('.', '_')}" for c in revision.CUTS)


def _r(x: str) -> str:
    return f"round({x}, 9)"


def _without(unit: str, name: str) -> str:
    return f"""c_{name} AS (SELECT release_pair, support_name, {unit} u, count(*) n, row_number() OVER (PARTITION BY release_pair, support_name ORDER BY count(*) DESC, {unit}) rn FROM rev WHERE absolute_change >= 0.05 GROUP BY 1, 2, 3),
w_{name} AS (SELECT release_pair, support_name, any_value(u) u, any_value(n) n, count(*) FILTER ({unit} <> u) c, quantile_cont(absolute_change, 0.9) FILTER ({unit} <> u) q FROM rev JOIN (SELECT * FROM c_{name} WHERE rn = 1) USING (release_pair, support_name) GROUP BY 1, 2)"""


_LEADERS = "max(s.{0}) OVER (PARTITION BY release_pair, d)"

ORACLE = {
    "crosswalk_statuses": f"""WITH {_WALKS} SELECT 'disease' AS entity, release_id, mapping_status, count(*) AS entities, count(*) FILTER (stable) AS stable_entities FROM xd GROUP BY 2, 3
UNION ALL SELECT 'target', release_id, mapping_status, count(*), count(*) FILTER (stable) FROM xt GROUP BY 2, 3""",
    "canonical_associations": f"WITH {_CANON} SELECT release_id, disease_id, target_id, canonical_disease_id, canonical_target_id, score, evidence_count, association_state, mapping_eligible, stable_entity, exclusion_reason, eligible FROM canon",
    "state_transitions": f"""WITH {_TRANS} SELECT release_pair, d AS canonical_disease_id, t AS canonical_target_id, old_state, new_state, old_eligible, new_eligible, old_score, new_score, old_evidence_count, new_evidence_count, mapping_affected,
stable_entity, transition_class FROM trans""",
    "membership_partition": f"""WITH {_TRANS}, e AS (SELECT r || '_to_' || nxt release_pair, canonical_disease_id d, canonical_target_id t, bool_or(release_id = r) o, bool_or(release_id = nxt) n FROM rel JOIN canon ON release_id IN (r, nxt) WHERE nxt IS NOT NULL AND eligible GROUP BY 1, 2, 3)
SELECT release_pair, d AS canonical_disease_id, CASE WHEN o AND n THEN 'PERSISTENT' WHEN n THEN 'ENTERING' ELSE 'EXITING' END AS membership, count(*) AS pairs FROM e GROUP BY 1, 2, 3""",
    "fixed_members": f"WITH {_FIXED} SELECT * EXCLUDE (d, t, areas), d AS canonical_disease_id, t AS canonical_target_id FROM fixed",
    "fixed_registry": f"WITH {_FIXED} SELECT * FROM judged",
    "native_registry": f"""WITH {_CANON} SELECT release_id, canonical_disease_id, count(*) AS target_count, count(DISTINCT score) AS distinct_scores, count(*) FILTER (stable_entity) AS stable_target_count, min(areas) AS areas,
count(*) >= 5 AS top_5_estimable, count(*) >= 10 AS top_10_estimable, count(*) >= 20 AS top_20_estimable FROM canon WHERE eligible GROUP BY 1, 2""",
    "exclusion_registry": f"""WITH {_FIXED} SELECT 'DISEASE_MAPPING' AS exclusion_scope, release_id, '' AS release_pair, source_id AS unit_id, mapping_status AS reason FROM xd WHERE mapping_status NOT IN ('EXACT_ID', 'MAPPED')
UNION ALL SELECT 'TARGET_MAPPING', release_id, '', source_id, mapping_status FROM xt WHERE mapping_status NOT IN ('EXACT_ID', 'MAPPED')
UNION ALL SELECT 'ASSOCIATION', release_id, '', disease_id || '|' || target_id, exclusion_reason FROM canon WHERE NOT eligible
UNION ALL SELECT 'FIXED_PANEL', '', release_pair, canonical_disease_id, exclusion_reason FROM judged WHERE support_name = 'PAIR_SPECIFIC_PERSISTENT' AND exclusion_reason <> ''""",
    "support_flow": f"""WITH {_FIXED}, base AS (SELECT release_id, count(*) n0, count(*) FILTER (mapping_eligible) n1, count(*) FILTER (eligible) n2, sum(CASE WHEN isfinite(score) THEN score::DECIMAL(38,18) END) m0,
sum(CASE WHEN isfinite(score) THEN score::DECIMAL(38,18) END) FILTER (mapping_eligible) m1, sum(CASE WHEN eligible THEN score::DECIMAL(38,18) END) m2 FROM canon GROUP BY 1),
flow AS (SELECT 'ASSOCIATION' AS unit, release_id AS scope, unnest(['RAW_ASSOCIATIONS', 'CANONICAL_MAPPINGS', 'ELIGIBLE']) AS stage, unnest([n0, n1, n2]) AS units, n0 AS of_units, unnest([m0, m1, m2])::DOUBLE AS score_mass FROM base
UNION ALL SELECT 'PAIR', release_pair, transition_class, count(*), sum(count(*)) OVER (PARTITION BY release_pair), NULL FROM trans GROUP BY 2, 3
UNION ALL SELECT 'PANEL', support_name || ':' || release_pair, unnest(['ELIGIBLE_20', 'ELIGIBLE_30', 'ELIGIBLE_50']), unnest([count(*) FILTER (eligible_20), count(*) FILTER (eligible_30), count(*) FILTER (eligible_50)]), count(*), NULL FROM judged GROUP BY support_name, release_pair)
SELECT unit, scope, stage, units, of_units::BIGINT AS of_units, {_r('score_mass')} AS score_mass, {_r('units / of_units::DOUBLE')} AS fraction FROM flow""",
    "entrant_exit_records": f"WITH {_TRANS}, {_RECORDS} SELECT release_pair, d AS canonical_disease_id, t AS canonical_target_id, record_category, context_class, applicable_score FROM records",
    "pair_revisions": f"""WITH {_REV} SELECT release_pair, support_name, d AS canonical_disease_id, t AS canonical_target_id, {_r('signed_change')} AS signed_change, {_r('absolute_change')} AS absolute_change, exact_unchanged, near_unchanged, evidence_status,
mapping_context, old_tier, new_tier, {_r('adjusted_change')} AS adjusted_change FROM rev""",
    "score_summary": f"""WITH {_REV}, cells AS (SELECT *, unnest(['OVERALL', 'MAPPING_CONTEXT', 'EVIDENCE_COUNT_STATUS']) summary_scope, unnest(['all', mapping_context, evidence_status]) summary_group FROM rev),
wanted AS (SELECT * FROM (SELECT DISTINCT release_pair, support_name FROM rev), (VALUES ('OVERALL', 'all'), ('MAPPING_CONTEXT', 'canonical_identifier_stable'), ('MAPPING_CONTEXT', 'raw_identifier_mapping_affected'),
('EVIDENCE_COUNT_STATUS', 'unchanged'), ('EVIDENCE_COUNT_STATUS', 'changed'), ('EVIDENCE_COUNT_STATUS', 'missing')) v(summary_scope, summary_group)),
sums AS (SELECT release_pair, support_name, summary_scope, summary_group, count(*) record_count, count(DISTINCT d) disease_count, count(DISTINCT t) target_count, count(*) FILTER (exact_unchanged) / count(*) exact_unchanged_fraction,
count(*) FILTER (near_unchanged) / count(*) near_unchanged_fraction, quantile_cont(signed_change, 0.5) signed_median, quantile_cont(absolute_change, [0.5, 0.75, 0.9, 0.95, 0.99]) q, max(absolute_change) maximum_change, {_CUT.format('absolute_change', 'change')},
quantile_cont(old_score, 0.5) old_score_median, quantile_cont(new_score, 0.5) new_score_median, count(*) FILTER (signed_change > 0) positive_count, count(*) FILTER (signed_change < 0) negative_count, count(*) FILTER (signed_change = 0) zero_count FROM cells GROUP BY 1, 2, 3, 4)
SELECT release_pair, support_name, summary_scope, summary_group, coalesce(record_count, 0) AS record_count, coalesce(disease_count, 0) AS disease_count, coalesce(target_count, 0) AS target_count, {_r('exact_unchanged_fraction')} AS exact_unchanged_fraction,
{_r('near_unchanged_fraction')} AS near_unchanged_fraction, {_r('signed_median')} AS signed_median, {_r('q[1]')} AS absolute_median, {_r('q[2]')} AS absolute_q75, {_r('q[3]')} AS absolute_q90, {_r('q[4]')} AS absolute_q95, {_r('q[5]')} AS absolute_q99,
{_r('maximum_change')} AS maximum_change, {_r('change_ge_0_01')} AS change_ge_0_01, {_r('change_ge_0_05')} AS change_ge_0_05, {_r('change_ge_0_1')} AS change_ge_0_1, {_r('old_score_median')} AS old_score_median, {_r('new_score_median')} AS new_score_median,
coalesce(positive_count, 0) AS positive_count, coalesce(negative_count, 0) AS negative_count, coalesce(zero_count, 0) AS zero_count FROM wanted LEFT JOIN sums USING (release_pair, support_name, summary_scope, summary_group)""",
    "scale_diagnostic": f"""WITH {_REV}, sums AS (SELECT release_pair, support_name, count(*) record_count, quantile_cont(absolute_change, [0.5, 0.9, 0.99]) r, quantile_cont(adjusted_change, [0.5, 0.9, 0.99]) a, {_CUT.format('absolute_change', 'raw')}, {_CUT.format('adjusted_change', 'adjusted')}
FROM rev WHERE adjusted_change IS NOT NULL GROUP BY 1, 2) SELECT release_pair, support_name, record_count, {_r('r[1]')} AS raw_median, {_r('r[2]')} AS raw_q90, {_r('r[3]')} AS raw_q99, {_r('a[1]')} AS adjusted_median, {_r('a[2]')} AS adjusted_q90, {_r('a[3]')} AS adjusted_q99,
{_r('raw_ge_0_01')} AS raw_ge_0_01, {_r('raw_ge_0_05')} AS raw_ge_0_05, {_r('raw_ge_0_1')} AS raw_ge_0_1, {_r('adjusted_ge_0_01')} AS adjusted_ge_0_01, {_r('adjusted_ge_0_05')} AS adjusted_ge_0_05, {_r('adjusted_ge_0_1')} AS adjusted_ge_0_1 FROM sums""",
    "score_tier_summary": f"""WITH {_REV}, {_RECORDS}, moved AS (SELECT release_pair, {_tier('applicable_score')} old_tier, count(*) FILTER (context_class = 'ENTRANT') e, count(*) FILTER (context_class = 'EXIT') x, count(*) FILTER (context_class = 'MAPPING_AFFECTED') m FROM records GROUP BY 1, 2),
stay AS (SELECT release_pair, support_name, old_tier, count(*) pair_count, count(DISTINCT d) disease_count, count(DISTINCT t) target_count, {_r('quantile_cont(absolute_change, 0.5)')} median_change, {_r('quantile_cont(absolute_change, 0.9)')} q90_change,
count(*) FILTER (signed_change > 0) positive_count, count(*) FILTER (signed_change < 0) negative_count FROM rev GROUP BY 1, 2, 3)
SELECT stay.*, coalesce(e, 0) AS entrant_count, coalesce(x, 0) AS exit_count, coalesce(m, 0) AS remapped_count FROM stay LEFT JOIN moved USING (release_pair, old_tier)""",
    "tier_area_distribution": f"""WITH {_REV} SELECT release_pair, support_name, old_tier, area_id, count(*) AS assignment_count, count(DISTINCT d) AS disease_count, {_r('sum(w)')} AS fractional_pair_count,
{_r('sum(w) / sum(sum(w)) OVER (PARTITION BY release_pair, support_name, old_tier)')} AS within_tier_fraction FROM areal GROUP BY 1, 2, 3, 4""",
    "area_summary": f"""WITH {_REV}, run AS (SELECT *, sum(w::DECIMAL(38,12)) OVER (PARTITION BY release_pair, support_name, area_id ORDER BY absolute_change RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE c, sum(w::DECIMAL(38,12)) OVER (PARTITION BY release_pair, support_name, area_id)::DOUBLE total FROM areal),
base AS (SELECT release_pair, support_name, area_id, count(*) assignment_count, sum(w) f, count(DISTINCT d) disease_count, min(absolute_change) FILTER (c + 1e-9 >= total * 0.5) wm, min(absolute_change) FILTER (c + 1e-9 >= total * 0.9) wq, coalesce(sum(w) FILTER (absolute_change >= 0.05), 0) lw FROM run GROUP BY 1, 2, 3),
dd AS (SELECT release_pair, support_name, area_id, d u, sum(w) x, row_number() OVER (PARTITION BY release_pair, support_name, area_id ORDER BY round(sum(w), 9) DESC, d) rn FROM areal WHERE absolute_change >= 0.05 GROUP BY 1, 2, 3, 4),
tt AS (SELECT release_pair, support_name, area_id, t u, sum(w) x, row_number() OVER (PARTITION BY release_pair, support_name, area_id ORDER BY round(sum(w), 9) DESC, t) rn FROM areal WHERE absolute_change >= 0.05 GROUP BY 1, 2, 3, 4)
SELECT b.release_pair, b.support_name, b.area_id, assignment_count, {_r('f')} AS fractional_pair_count, disease_count, {_r('wm')} AS weighted_median_change, {_r('wq')} AS weighted_q90_change, {_r('lw / f')} AS large_change_fraction, dd.u AS dominant_disease_id,
{_r('dd.x / nullif(lw, 0)')} AS maximum_disease_share, tt.u AS dominant_target_id, {_r('tt.x / nullif(lw, 0)')} AS maximum_target_share, CASE WHEN disease_count >= 20 THEN 'comparison_eligible' ELSE 'descriptive_only' END AS reporting_status
FROM base b LEFT JOIN dd ON dd.rn = 1 AND dd.release_pair = b.release_pair AND dd.support_name = b.support_name AND dd.area_id = b.area_id LEFT JOIN tt ON tt.rn = 1 AND tt.release_pair = b.release_pair AND tt.support_name = b.support_name AND tt.area_id = b.area_id""",
    "concentration": f"""WITH {_REV}, base AS (SELECT release_pair, support_name, count(*) pair_count, quantile_cont(absolute_change, 0.9) full_q90, count(*) FILTER (absolute_change >= 0.05) large_count FROM rev GROUP BY 1, 2), {_without('d', 'disease')}, {_without('t', 'target')}
SELECT b.release_pair, b.support_name, pair_count, {_r('full_q90')} AS full_q90, large_count, wd.u AS dominant_disease_id, wd.n AS dominant_disease_weight, nullif(wd.c, 0) AS without_disease_count, {_r('wd.q')} AS without_disease_q90, {_r('wd.n / large_count')} AS maximum_disease_share,
{_r('wd.q - full_q90')} AS without_disease_difference, wt.u AS dominant_target_id, wt.n AS dominant_target_weight, nullif(wt.c, 0) AS without_target_count, {_r('wt.q')} AS without_target_q90, {_r('wt.n / large_count')} AS maximum_target_share, {_r('wt.q - full_q90')} AS without_target_difference
FROM base b LEFT JOIN w_disease wd USING (release_pair, support_name) LEFT JOIN w_target wt USING (release_pair, support_name)""",
    "trajectory_summary": f"""WITH {_FIXED}, spans AS (SELECT r || '_to_' || nxt p1, nxt || '_to_' || lead(nxt) OVER (ORDER BY r) p2, r || '_to_' || nxt || '_to_' || lead(nxt) OVER (ORDER BY r) release_span FROM rel),
moves AS (SELECT release_span, a.d, a.t, a.old_score, a.new_score - a.old_score f, b.new_score - a.new_score s FROM spans JOIN fixed a ON a.release_pair = p1 JOIN fixed b ON b.release_pair = p2 AND a.d = b.d AND a.t = b.t
  WHERE a.support_name = 'PAIR_SPECIFIC_PERSISTENT' AND b.support_name = 'PAIR_SPECIFIC_PERSISTENT'),
states AS (SELECT *, CASE WHEN abs(f) <= 1e-12 THEN 'stable' WHEN f > 0 THEN 'increase' ELSE 'decrease' END s1, CASE WHEN abs(s) <= 1e-12 THEN 'stable' WHEN s > 0 THEN 'increase' ELSE 'decrease' END s2 FROM moves),
cells AS (SELECT *, CASE WHEN s1 = 'stable' AND s2 = 'stable' THEN 'stable-stable' WHEN 'stable' IN (s1, s2) THEN 'one-stable-one-changing' ELSE s1 || '-' || s2 END trajectory, unnest([{_tier('old_score')}, 'all_score_tiers']) tier_group FROM states),
counts AS (SELECT release_span, trajectory, tier_group, count(*) n, count(DISTINCT d) dc, quantile_cont(abs(f), 0.5) fm, quantile_cont(abs(s), 0.5) sm FROM cells GROUP BY 1, 2, 3),
full_grid AS (SELECT * FROM (SELECT DISTINCT release_span FROM counts), (SELECT unnest([{', '.join(f"'{t}'" for t in revision.TRAJECTORIES)}]) trajectory), (SELECT unnest([{', '.join(f"'{t[2]}'" for t in revision.TIERS)}, 'all_score_tiers']) tier_group))
SELECT release_span, trajectory, tier_group, coalesce(n, 0) AS pair_count, coalesce(dc, 0) AS disease_count, {_r('fm')} AS first_change_median, {_r('sm')} AS second_change_median, {_r('coalesce(coalesce(n, 0) / nullif(sum(n) OVER (PARTITION BY release_span, tier_group), 0), 0.0)::DOUBLE')} AS within_tier_fraction,
{_r("coalesce(coalesce(n, 0) / nullif(sum(n) FILTER (tier_group = 'all_score_tiers') OVER (PARTITION BY release_span), 0), 0.0)::DOUBLE")} AS overall_fraction FROM full_grid LEFT JOIN counts USING (release_span, trajectory, tier_group)""",
    "entrant_exit_summary": f"""WITH {_TRANS}, {_RECORDS}, ra AS (SELECT *, 1.0::DOUBLE / len(l) w, unnest(l) area_id FROM (SELECT *, list_distinct(list_filter(string_split(areas, ';'), lambda x: x <> '')) l FROM records) WHERE len(l) > 0)
SELECT 'overall' AS summary_scope, release_pair, context_class, '' AS area_id, count(*) AS record_count, count(*)::DOUBLE AS fractional_count, count(DISTINCT d) AS disease_count, {_r('quantile_cont(applicable_score, 0.5)')} AS score_median FROM records GROUP BY 2, 3
UNION ALL SELECT 'area', release_pair, context_class, area_id, count(*), {_r('sum(w)')}, count(DISTINCT d), {_r('quantile_cont(applicable_score, 0.5)')} FROM ra GROUP BY 2, 3, 4""",
    "native_turnover": f"""WITH {_TRANS}, s AS (SELECT * FROM trans WHERE old_eligible OR new_eligible), best AS (SELECT release_pair, d, max(old_score) FILTER (old_eligible) bo, max(new_score) FILTER (new_eligible) bn FROM s GROUP BY 1, 2),
flags AS (SELECT release_pair, d, old_eligible o, new_eligible n, mapping_affected m, CASE WHEN bo IS NOT NULL THEN coalesce(old_eligible AND old_score = bo, false) END oi, CASE WHEN bn IS NOT NULL THEN coalesce(new_eligible AND new_score = bn, false) END ni FROM s JOIN best USING (release_pair, d)),
found AS (SELECT release_pair, d, bool_or(oi IS NULL OR ni IS NULL) missing, count(*) FILTER (oi <> ni) moved, list_sort(list_distinct(list(CASE WHEN m THEN 'MAPPING_AFFECTED' WHEN o AND n THEN 'PERSISTENT_PAIR_RERANKING' WHEN n THEN 'ENTRANT' ELSE 'EXIT' END) FILTER (oi <> ni))) r FROM flags GROUP BY 1, 2)
SELECT release_pair, d AS canonical_disease_id, moved, CASE WHEN missing THEN 'UNRESOLVED' WHEN moved = 0 THEN 'UNCHANGED' WHEN len(r) = 1 THEN r[1] ELSE 'MIXED' END AS reason FROM found""",
    "persistence_classes": f"""WITH {_FIXED}, base AS (SELECT * FROM fixed WHERE support_name = 'PAIR_SPECIFIC_PERSISTENT'), lay AS (SELECT 1 l, * FROM base UNION ALL SELECT 2, * FROM base WHERE stable_member UNION ALL SELECT 3, * FROM base WHERE old_evidence_count >= 5 AND new_evidence_count >= 5),
best AS (SELECT *, max(old_score) OVER (PARTITION BY l, release_pair, d) bo, max(new_score) OVER (PARTITION BY l, release_pair, d) bn FROM lay),
ch AS (SELECT l, release_pair, d, bool_or((old_score = bo) <> (new_score = bn)) c, count(*) >= 30 AND count(DISTINCT old_score) >= 2 AND count(DISTINCT new_score) >= 2 e FROM best GROUP BY 1, 2, 3),
j AS (SELECT release_pair, d, a.c p, b.c s, coalesce(b.e, false) se, x.c m, coalesce(x.e, false) me FROM (SELECT * FROM ch WHERE l = 1) a LEFT JOIN (SELECT * FROM ch WHERE l = 2) b USING (release_pair, d) LEFT JOIN (SELECT * FROM ch WHERE l = 3) x USING (release_pair, d)),
k AS (SELECT *, se AND coalesce(s, false) sx, me AND coalesce(m, false) mx FROM j)
SELECT release_pair, d AS canonical_disease_id, p AS primary_changed, s AS stable_changed, se AS stable_eligible, m AS domain_changed, me AS domain_eligible, CASE WHEN p AND sx AND mx THEN 'MIXED' WHEN p AND sx THEN 'PERSISTS_STABLE_ENTITY' WHEN p AND mx THEN 'PERSISTS_EVIDENCE_DOMAIN'
WHEN p AND NOT me THEN 'INSUFFICIENT_DOMAIN_SUPPORT' WHEN p AND se THEN 'DISAPPEARS_AFTER_MAPPING_CONTROL' WHEN p THEN 'OVERALL_ONLY' WHEN mx AND NOT sx THEN 'DOMAIN_ONLY' ELSE 'MIXED' END AS persistence_class FROM k""",
    "change_intervals": f"""WITH {_REV}, panels AS (SELECT release_pair, d, avg(absolute_change) mean_change, avg((NOT exact_unchanged)::INT::DOUBLE) changed_share FROM rev WHERE support_name = 'PAIR_SPECIFIC_PERSISTENT' GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY release_pair ORDER BY md5(d), d) - 1 no, count(*) OVER (PARTITION BY release_pair) n FROM panels),
picks AS (SELECT release_pair, draw, ('0x' || substr(md5(draw || '|' || no), 1, 8))::BIGINT % n pick FROM numbered, (SELECT unnest(range(2000)) draw)),
draws AS (SELECT p.release_pair, draw, avg(mean_change) mc, avg(changed_share) cs FROM picks p JOIN numbered m ON m.release_pair = p.release_pair AND m.no = pick GROUP BY 1, 2),
ends AS (SELECT release_pair, 'mean_change' measure, quantile_cont(mc, 0.025) lo, quantile_cont(mc, 0.975) hi, count(*) n FROM draws GROUP BY 1 UNION ALL SELECT release_pair, 'changed_share', quantile_cont(cs, 0.025), quantile_cont(cs, 0.975), count(*) FROM draws GROUP BY 1),
point AS (SELECT release_pair, 'mean_change' measure, avg(mean_change) e FROM panels GROUP BY 1 UNION ALL SELECT release_pair, 'changed_share', avg(changed_share) FROM panels GROUP BY 1)
SELECT release_pair, measure, {_r('e')} AS estimate, {_r('lo')} AS lower, {_r('hi')} AS upper, n AS draws FROM point JOIN ends USING (release_pair, measure)""",
}

ORACLE["turnover_decomposition"] = f"""WITH found AS ({ORACLE['native_turnover']}), reasons AS (SELECT unnest([{', '.join(f"'{r}'" for r in REASONS)}]) AS reason), totals AS (SELECT release_pair, count(*) a FROM found GROUP BY 1)
SELECT t.release_pair, r.reason, count(f.reason) AS panels, round(count(f.reason) / any_value(a), 9) AS fraction FROM totals t CROSS JOIN reasons r LEFT JOIN found f ON f.release_pair = t.release_pair AND f.reason = r.reason GROUP BY 1, 2"""
ORACLE["changed_pair_ratio"] = f"""WITH {_REV}, panels AS (SELECT release_pair, d, count(*) FILTER (NOT exact_unchanged) c, count(*) k FROM rev WHERE support_name = 'PAIR_SPECIFIC_PERSISTENT' GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY release_pair ORDER BY md5(d), d) - 1 no, count(*) OVER (PARTITION BY release_pair) n FROM panels),
picks AS (SELECT release_pair, draw, ('0x' || substr(md5(draw || '|' || no), 1, 8))::BIGINT % n pick FROM numbered, (SELECT unnest(range(2000)) draw)),
draws AS (SELECT p.release_pair, draw, sum(c) / sum(k) x FROM picks p JOIN numbered m ON m.release_pair = p.release_pair AND m.no = pick GROUP BY 1, 2),
whole AS (SELECT release_pair, sum(c) / sum(k) e FROM panels GROUP BY 1)
SELECT w.release_pair, round(any_value(e), 9) AS estimate, round(quantile_cont(x, 0.025), 9) AS lower, round(quantile_cont(x, 0.975), 9) AS upper FROM whole w JOIN draws USING (release_pair) GROUP BY 1"""
