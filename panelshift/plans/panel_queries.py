"""Queries of panels, allocations, scenarios and predictions over fixed_ranking_panel_members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshift.functions.scalars import clean_disease, clean_target, is_finite
from panelshift.operators import allocation, evaluation, panel, rank_correlation, revision, scenario, selection, snapshots
from panelshift.operators.ordering import exact_quantiles, with_quantiles
from panelshift.plans.release_queries import _rounded
from panelshift.session import cut_lineage
from panelshift.sources.tables import load

P = ["support_name", "release_pair", "canonical_disease_id"]
TARGET = "canonical_target_id"
BUDGET = 10
# Thresholds of the signal assessment.
SIGNALS = {"leader_change": 0.05, "top_10_jaccard_below": 0.9, "low_overlap": 0.1, "q90_displacement_from": 0.1, "high_displacement": 0.1}


def members(spark: SparkSession, d: str) -> DataFrame:
    """One row per panel and target with both scores above 0 and at most 1: the one loaded last, of equal ones the greatest.

    The grouping's exchange serves all uses within a query.
    """
    rows = load(spark, d, "fixed_ranking_panel_members", [*P, TARGET, "old_score", "new_score", "old_evidence_count", "new_evidence_count", "stable_entity_member", "canonical_therapeutic_area_ids", "loaded_at"])
    clean = rows.withColumns({"canonical_disease_id": clean_disease("canonical_disease_id"), TARGET: clean_target(TARGET)})
    valid = [is_finite(F.col(c)) & (F.col(c) > 0) & (F.col(c) <= 1) for c in ("old_score", "new_score")]
    values = ["new_score", "old_score", "new_evidence_count", "old_evidence_count", "stable_entity_member", "canonical_therapeutic_area_ids"]
    last = snapshots.latest_rows(clean.filter(valid[0] & valid[1]), "support_name", ["release_pair", "canonical_disease_id", TARGET], "loaded_at", values)
    return last.withColumnRenamed("canonical_therapeutic_area_ids", "areas")


def rank_displacements(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.rank_displacements(members(spark, d), P).select(*P, TARGET, "old_rank", "new_rank", "displacement"))


def _displacement_summary(rows: DataFrame) -> DataFrame:
    moved = cut_lineage(panel.rank_displacements(rows, P).select(*P, "displacement", "areas"))
    sums = moved.groupBy(*P).agg(F.count("*").alias("members"), F.max("displacement").alias("max_displacement"), F.min("areas").alias("areas"))
    return with_quantiles(sums, moved, P, {"median_displacement": ("displacement", 0.5), "q90_displacement": ("displacement", 0.9)})


def displacement_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_displacement_summary(members(spark, d)).drop("areas"))


def top_set_comparison(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.top_set_comparison(members(spark, d), P))


def top_set_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of either top ten with what became of them."""
    flags = panel.both_ladders(members(spark, d), P).select(*P, TARGET, panel.in_top(10, "old_").alias("old_member"), panel.in_top(10, "new_").alias("new_member"))
    state = F.when(F.col("old_member") & F.col("new_member"), "RETAINED").when(F.col("new_member"), "GAINED").otherwise("LOST")
    return flags.filter("old_member or new_member").withColumn("membership_state", state)


def epsilon_leaders(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.epsilon_leaders(members(spark, d), P, TARGET, (0.0, 1e-6, 1e-3, 0.01)))


def leader_margins(spark: SparkSession, d: str) -> DataFrame:
    rows = members(spark, d)
    both = [panel.leader_margins(rows.withColumn("margin_of", F.lit(s)), [*P, "margin_of"], s).withColumnRenamed("best", "best_score") for s in ("old_score", "new_score")]
    return _rounded(both[0].unionByName(both[1]))


def score_changes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(panel.score_changes(members(spark, d), P))


def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's coefficient, Kendall's tau-b and rank-biased overlap of every panel."""
    ranked = _ranked(members(spark, d))
    rho, tau = rank_correlation.spearman(ranked, P), rank_correlation.kendall_tau_b(ranked, P).drop("members")
    return _rounded(rho.join(tau, P).join(rank_correlation.rank_biased_overlap(ranked, P, 0.9), P))


def overlap_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Rank-biased overlap of every panel in two variants for three persistences, with its bounds."""
    bounds = rank_correlation.overlap_bounds(_ranked(members(spark, d)), P)
    return bounds.withColumns({c: F.round(c, 8) for c in ("least", "most", "extrapolated", "residual")})


def _ranked(rows: DataFrame) -> DataFrame:
    """Places of all members on both ladders, stored for the measures that share them."""
    return cut_lineage(panel.both_ladders(rows, P).select(*P, *[f"{side}_{c}" for side in ("old", "new") for c in ("ties", "above", "members", "step")]))


def signal_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Per support and release pair: the share of panels with changed leaders, low overlap and high displacement, against thresholds."""
    rows = members(spark, d)
    by = P[:2]
    tops = panel.top_set_comparison(rows, P, (10,))
    moved = exact_quantiles(panel.rank_displacements(rows, P), P, {"q90": ("displacement", 0.9)})
    one = tops.groupBy(*by).agg(
        F.avg(F.when(F.col("cutoff") == 0, F.col("changed").cast("double"))).alias("leader_change"),
        F.avg(F.when(F.col("cutoff") == 10, (F.col("jaccard") < SIGNALS["top_10_jaccard_below"]).cast("double"))).alias("low_overlap"),
    )
    two = moved.groupBy(*by).agg(F.avg((F.col("q90") >= SIGNALS["q90_displacement_from"]).cast("double")).alias("high_displacement"))
    criteria = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("fraction"), F.lit(SIGNALS[c]).alias("threshold")) for c in ("leader_change", "low_overlap", "high_displacement")])
    return _rounded(one.join(two, by).select(*by, F.inline(criteria)).withColumn("met", F.coalesce(F.col("fraction") >= F.col("threshold"), F.lit(False))))


def area_displacement(spark: SparkSession, d: str) -> DataFrame:
    """Area-weighted quantiles of the panels' median displacement."""
    rows = revision.with_areas(_displacement_summary(members(spark, d)))
    by = [*P[:2], "area_id"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("panels"), F.sum("area_weight").cast("double").alias("weight"))
    return _rounded(sums.join(revision.weighted_quantile(rows, by, "median_displacement", "area_weight", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), by, "left"))


def consensus_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank loss of every target of a disease over the release pairs."""
    return _rounded(panel.consensus_ranks(members(spark, d), ["support_name", "canonical_disease_id"], TARGET, "release_pair", "new_score"))


def _allocated(rows: DataFrame, score: str) -> DataFrame:
    return allocation.allocate(rows, P, score, BUDGET)


def fractional_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _allocated(members(spark, d), "new_score").select(*P, TARGET, "num", "den")


def allocation_gap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(allocation.cutoff_gap(members(spark, d), P, "new_score", BUDGET))


def allocation_change(spark: SparkSession, d: str) -> DataFrame:
    rows = members(spark, d)
    return _rounded(allocation.compare_allocations(_allocated(rows, "old_score"), _allocated(rows, "new_score"), P, TARGET))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """The new allocation with labels: stable members 1, others 0; unknown where the number of pieces of evidence changed."""
    label = F.when(F.col("old_evidence_count").eqNullSafe(F.col("new_evidence_count")), F.col("stable_entity_member").cast("int"))
    return _allocated(members(spark, d), "new_score").withColumns({"label": label, "labelled": F.col("stable_entity_member").isNotNull()})


def label_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(allocation.label_bounds(_labelled(spark, d), P))


def contrast_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the labelled mass of the new minus the old allocation; shared items cancel before labels are met."""
    rows = members(spark, d)
    old, new = _allocated(rows, "old_score"), _allocated(rows, "new_score")
    vector = allocation.combine((1.0, new), (-1.0, old), keys=[*P, TARGET])
    label = F.when(F.col("old_evidence_count").eqNullSafe(F.col("new_evidence_count")), F.col("stable_entity_member").cast("int"))
    labels = rows.select(*P, TARGET, label.alias("label"))
    return _rounded(allocation.label_bounds(vector.join(labels, [*P, TARGET], "left").withColumn("weight", F.round("weight", 12)), P))


def arm_mass(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(allocation.arm_mass(_labelled(spark, d), P, BUDGET))


def stable_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Weight that a target keeps under every release pair."""
    new = _allocated(members(spark, d), "new_score")
    return _rounded(allocation.stable_weights(new, ["support_name", "canonical_disease_id"], TARGET, "release_pair", "support_name"))


def mean_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(allocation.mean_weights(_allocated(members(spark, d), "new_score"), ["support_name", "canonical_disease_id"], TARGET, "release_pair"))


def donor_means(spark: SparkSession, d: str) -> DataFrame:
    """Half the L1 distance of the allocations, averaged over the panels of an area list, then over area lists."""
    rows = members(spark, d)
    change = allocation.compare_allocations(_allocated(rows, "old_score"), _allocated(rows, "new_score"), P, TARGET)
    areas = rows.groupBy(*P).agg(F.coalesce(F.min("areas"), F.lit("")).alias("donor"))
    return _rounded(allocation.donor_reduction(change.join(areas, P), "donor", "canonical_disease_id", P[:2], ["half_l1", "weighted_jaccard"]))


def panel_influence(spark: SparkSession, d: str) -> DataFrame:
    """What each panel contributes to a release pair's mean absolute score change."""
    return _rounded(allocation.leave_one_out(panel.score_changes(members(spark, d), P), P[:2], "canonical_disease_id", "mean_change"))


def change_concentration(spark: SparkSession, d: str) -> DataFrame:
    """The share of all absolute score change that the 1, 5 and 10 most changed targets hold."""
    rows = members(spark, d).withColumn("change", F.abs(F.round((F.col("new_score") - F.col("old_score")) * 1e9)).cast("long"))
    return _rounded(allocation.concentration_shares(rows, P[:2], TARGET, "change"))


def matched_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(allocation.matched_prefix(_allocated(members(spark, d), "new_score").withColumn("target_mass", F.lit(4.5)), P, TARGET, "new_score", "target_mass").select(*P, TARGET, "kept_weight"))


def leader_regret(spark: SparkSession, d: str) -> DataFrame:
    """What keeping the old leaders costs in new score."""
    rows = panel.with_ladder(members(spark, d), P, "old_score").withColumn("chosen", F.col("above") == 0)
    return _rounded(allocation.regret(rows, P, TARGET, "new_score", "chosen"))


def nondominated_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets to which no other of the panel has at least the score with at most the evidence."""
    rows = members(spark, d).filter("new_evidence_count is not null")
    return allocation.nondominated(rows, P, "new_score", "new_evidence_count").select(*P, TARGET, "new_score", "new_evidence_count")


def margin_warnings(spark: SparkSession, d: str) -> DataFrame:
    """How well a small old margin warns of a change of leaders."""
    rows = members(spark, d)
    margins = panel.leader_margins(rows, P, "old_score").select(*P, "margin")
    changes = panel.epsilon_leaders(rows, P, TARGET, (0.0,)).select(*P, "changed")
    return evaluation.confusion(margins.join(changes, P), P[:2], F.coalesce(F.col("margin") <= 0.01, F.lit(False)), F.col("changed"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    return panel.with_ladder(members(spark, d), P, "new_score").withColumn("target", F.col("above") < 10)


def prediction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well old scores predict the new top ten."""
    return _rounded(evaluation.binary_metrics(_predictions(spark, d), P[:2], "target", "old_score"))


def prediction_calibration(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.calibration(_predictions(spark, d), P[:2], "target", "old_score"))


def disease_folds(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.group_folds(members(spark, d), "canonical_disease_id", 5).select("canonical_disease_id", F.col("fold").cast("int").alias("fold"))


def chosen_predictor(spark: SparkSession, d: str) -> DataFrame:
    """Which of old score and evidence share captures more of the new top ten."""
    rows = _predictions(spark, d).withColumn("evidence", F.col("old_evidence_count") / (F.col("old_evidence_count") + 10.0))
    trials = [evaluation.binary_metrics(rows, P[:2], "target", c).withColumn("specification", F.lit(c)) for c in ("old_score", "evidence")]
    both = trials[0].unionByName(trials[1]).withColumns({"capture": F.round("capture", 9), "brier": F.round("brier", 9)})
    return evaluation.choose_specification(both, P[:2], "specification")


def change_census(spark: SparkSession, d: str) -> DataFrame:
    """Per panel: members by the sign of their score change, and its quartiles by inverse distribution function, exact for panels of any size."""
    rows = members(spark, d).withColumn("change", F.round(F.col("new_score") - F.col("old_score"), 9))
    ranks = selection.per_key_ranks(rows, P, "change", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, {"_from_zero": 0.0, "positive": 5e-10})
    return ranks.select(*P, F.col("n_values").alias("members"), (F.col("n_values") - F.col("_from_zero")).alias("negative"), (F.col("_from_zero") - F.col("positive")).alias("zero"), "positive", "q25", "q50", "q75")


def held_out_prediction(spark: SparkSession, d: str) -> DataFrame:
    """A logistic model of the new top ten, fitted on the first release pair and scored on the later ones."""
    rows = panel.both_ladders(members(spark, d), P).withColumns({"target": F.col("new_above") < 10, "place": F.log1p("old_above"), "evidence": F.log1p(F.coalesce("old_evidence_count", F.lit(0)).cast("double"))})
    features = ["old_score", "place", "evidence"]
    first = rows.agg(F.min("release_pair")).first()[0]
    if first is None:
        return evaluation.binary_metrics(rows, P[:2], "target", "old_score")
    model = evaluation.fit_logistic(rows.filter(F.col("release_pair") == first), features, "target", 0.01)
    later = evaluation.predict_logistic(model, rows.filter(F.col("release_pair") != first), features, "predicted")
    return evaluation.binary_metrics(later, P[:2], "target", "predicted")


def scenario_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a comparison finds in every panel under controlled edits."""
    return scenario.scenario_outcomes(scenario.edited_panels(members(spark, d), P, TARGET, "old_score"), P)


QUERIES = {
    f.__name__: f
    for f in (
        rank_displacements, displacement_summary, top_set_comparison, top_set_members, epsilon_leaders, leader_margins, score_changes, rank_agreement, overlap_bounds, signal_assessment, area_displacement, consensus_ranks,
        fractional_allocation, allocation_gap, allocation_change, label_bounds, contrast_bounds, arm_mass, stable_allocation, mean_allocation, donor_means, panel_influence, change_concentration, matched_prefix,
        leader_regret, nondominated_targets, margin_warnings, prediction_metrics, prediction_calibration, disease_folds, chosen_predictor, held_out_prediction, change_census, scenario_outcomes,
    )
}

# The same in SQL.

_PM = r"""pm AS (SELECT * FROM (SELECT support_name, release_pair, replace(upper(trim(canonical_disease_id)), ':', '_') d, regexp_replace(upper(trim(canonical_target_id)), '\.[0-9]+$', '') t, old_score o, new_score n,
  old_evidence_count oe, new_evidence_count ne, stable_entity_member stable, canonical_therapeutic_area_ids areas, loaded_at FROM fixed_ranking_panel_members
  WHERE isfinite(old_score) AND isfinite(new_score) AND old_score > 0 AND old_score <= 1 AND new_score > 0 AND new_score <= 1 AND support_name IS NOT NULL AND release_pair IS NOT NULL)
  WHERE d IS NOT NULL AND t IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY support_name, release_pair, d, t ORDER BY loaded_at DESC NULLS LAST, n DESC, o DESC, ne DESC NULLS LAST, oe DESC NULLS LAST, stable DESC NULLS LAST, areas DESC NULLS LAST) = 1)"""
_BY = "support_name, release_pair, d"
_ID = "support_name, release_pair, d AS canonical_disease_id"
_RANKED = f"""{_PM}, ranked AS (SELECT *, count(*) OVER p m, rank() OVER (PARTITION BY {_BY} ORDER BY o DESC) ro, rank() OVER (PARTITION BY {_BY} ORDER BY n DESC) rn, count(*) OVER (PARTITION BY {_BY}, o) co, count(*) OVER (PARTITION BY {_BY}, n) cn
  FROM pm WINDOW p AS (PARTITION BY {_BY}))"""
_MOVED = f"{_RANKED}, moved AS (SELECT *, ro + (co - 1) / 2.0 orank, rn + (cn - 1) / 2.0 nrank, abs((rn + (cn - 1) / 2.0) - (ro + (co - 1) / 2.0)) / nullif(m - 1, 0) disp FROM ranked)"


def _r(x: str) -> str:
    return f"round(({x})::DOUBLE, 9)"


def _weight(r: str, c: str) -> str:
    return f"least(greatest({BUDGET} - ({r} - 1), 0), {c}) / {c}::DOUBLE"


_W = f"{_RANKED}, w AS (SELECT *, {_weight('ro', 'co')} wo, {_weight('rn', 'cn')} wn, CASE WHEN oe IS NOT DISTINCT FROM ne THEN stable::INT END lab FROM ranked)"
_DIRECTION = "CASE WHEN lower IS NULL OR upper IS NULL THEN 'unavailable' WHEN lower = 0 AND upper = 0 THEN 'zero' WHEN upper < 0 THEN 'negative' WHEN lower > 0 THEN 'positive' ELSE 'unresolved' END"
_CHANGE = f"""{_W}, change AS (SELECT {_BY}, sum(wo) old_mass, sum(wn) new_mass, sum(least(wo, wn)) shared_mass, sum(greatest(wo - wn, 0)) lost_mass, sum(greatest(wn - wo, 0)) gained_mass, sum(abs(wo - wn)) / 2 half_l1, sum(least(wo, wn)) / sum(greatest(wo, wn)) weighted_jaccard, min(areas) areas
  FROM w GROUP BY {_BY})"""
_TOPS = f"""{_RANKED}, sets AS (SELECT {_BY}, k, m, o_in, n_in FROM (SELECT *, unnest([0, 5, 10, 20]) k FROM ranked), LATERAL (SELECT CASE WHEN k = 0 THEN ro = 1 WHEN m >= k THEN ro <= k END o_in, CASE WHEN k = 0 THEN rn = 1 WHEN m >= k THEN rn <= k END n_in)),
  tops AS (SELECT {_BY}, k, sum(o_in::BIGINT) old_size, sum(n_in::BIGINT) new_size, sum((o_in AND n_in)::BIGINT) shared FROM sets GROUP BY ALL)"""


def _margins(c: str) -> str:
    return f"""SELECT {_ID}, '{'old' if c == 'o' else 'new'}_score' AS margin_of, leaders, round(best, 9) AS best_score, {_r('margin')} AS margin, CASE WHEN margin IS NULL THEN NULL WHEN margin <= 0 THEN '0' WHEN margin <= 1e-12 THEN '(0, 1e-12]' WHEN margin <= 1e-8 THEN '(1e-12, 1e-8]' WHEN margin <= 1e-6 THEN '(1e-8, 1e-6]'
WHEN margin <= 1e-4 THEN '(1e-6, 1e-4]' WHEN margin <= 1e-3 THEN '(1e-4, 1e-3]' WHEN margin <= 1e-2 THEN '(1e-3, 1e-2]' WHEN margin <= 5e-2 THEN '(1e-2, 5e-2]' WHEN margin <= 1 THEN '(5e-2, 1]' ELSE 'above 1' END AS margin_bin FROM
(SELECT *, CASE WHEN leaders > 1 THEN 0.0 ELSE best - second END margin FROM (SELECT {_BY}, count(*) FILTER ({c} = b) leaders, max({c}) best, max({c}) FILTER ({c} < b) AS second FROM (SELECT *, max({c}) OVER (PARTITION BY {_BY}) b FROM pm) GROUP BY {_BY}))"""


_EPS = f"""near AS (SELECT {_BY}, e, o >= bo - e ol, n >= bn - e nl FROM (SELECT *, max(o) OVER (PARTITION BY {_BY}) bo, max(n) OVER (PARTITION BY {_BY}) bn, unnest([0.0::DOUBLE, 1e-6, 1e-3, 0.01]) e FROM pm)),
  eps AS (SELECT {_BY}, e, count(*) FILTER (ol) a, count(*) FILTER (nl) b, count(*) FILTER (ol AND nl) s FROM near GROUP BY ALL)"""
_PRED = f"{_RANKED}, pred AS (SELECT *, (rn <= 10)::INT y, rank() OVER g pr, count(*) OVER (PARTITION BY support_name, release_pair, o) pc, count(*) OVER (PARTITION BY support_name, release_pair) pn, sum((rn <= 10)::INT) OVER (PARTITION BY support_name, release_pair ORDER BY o DESC) hits FROM ranked WINDOW g AS (PARTITION BY support_name, release_pair ORDER BY o DESC))"

ORACLE = {
    "rank_displacements": f"WITH {_MOVED} SELECT {_ID}, t AS canonical_target_id, orank::DOUBLE AS old_rank, nrank::DOUBLE AS new_rank, {_r('disp')} AS displacement FROM moved",
    "displacement_summary": f"WITH {_MOVED} SELECT {_ID}, count(*) AS members, {_r('quantile_cont(disp::DOUBLE, 0.5)')} AS median_displacement, {_r('quantile_cont(disp::DOUBLE, 0.9)')} AS q90_displacement, {_r('max(disp)')} AS max_displacement FROM moved GROUP BY {_BY}",
    "top_set_comparison": f"WITH {_TOPS} SELECT {_ID}, k AS cutoff, old_size, new_size, shared, {_r('shared / (old_size + new_size - shared)')} AS jaccard, shared <> old_size + new_size - shared AS changed FROM tops",
    "top_set_members": f"WITH {_RANKED} SELECT {_ID}, t AS canonical_target_id, ro <= 10 AS old_member, rn <= 10 AS new_member, CASE WHEN ro <= 10 AND rn <= 10 THEN 'RETAINED' WHEN rn <= 10 THEN 'GAINED' ELSE 'LOST' END AS membership_state FROM ranked WHERE m >= 10 AND (ro <= 10 OR rn <= 10)",
    "epsilon_leaders": f"""WITH {_PM}, {_EPS} SELECT {_ID}, e AS epsilon, a AS old_leaders, b AS new_leaders, s AS shared_leaders, a <> b OR s <> a AS changed, {_r('s / (a + b - s)')} AS jaccard,
CASE WHEN a = b AND s = a THEN 'IDENTICAL' WHEN s = a AND b > a THEN 'TIE_EXPANSION' WHEN s = b AND a > b THEN 'TIE_CONTRACTION' WHEN a = 1 AND b = 1 AND s = 0 THEN 'UNIQUE_LEADER_REPLACEMENT' WHEN s = 0 THEN 'DISJOINT_REPLACEMENT' ELSE 'OVERLAPPING_LEADER_SET' END AS taxonomy FROM eps""",
    "leader_margins": f"WITH {_PM} {_margins('o')} UNION ALL {_margins('n')}",
    "score_changes": f"WITH {_PM} SELECT {_ID}, count(*) AS members, {_r('avg(abs(n - o))')} AS mean_change, {_r('quantile_cont(abs(n - o), 0.5)')} AS median_change, {_r('quantile_cont(abs(n - o), 0.9)')} AS q90_change, {_r('max(abs(n - o))')} AS max_change, count(*) FILTER (n <> o) AS changed_members FROM pm GROUP BY {_BY}",
    "rank_agreement": f"""WITH {_MOVED}, rho AS (SELECT {_BY}, count(*) m, corr(orank::DOUBLE, nrank::DOUBLE) rho, stddev_pop(orank::DOUBLE) so, stddev_pop(nrank::DOUBLE) sn FROM moved GROUP BY {_BY}),
tau AS (SELECT a.support_name, a.release_pair, a.d, sum(sign(a.o - b.o) * sign(a.n - b.n)) / 2 e, (count(*) FILTER (a.o <> b.o)) / 2.0 ux, (count(*) FILTER (a.n <> b.n)) / 2.0 uy FROM pm a JOIN pm b ON a.support_name = b.support_name AND a.release_pair = b.release_pair AND a.d = b.d AND a.t <> b.t GROUP BY ALL),
depths AS (SELECT {_BY}, unnest([ro, rn, greatest(ro, rn)]) k, unnest([1, 1, 0]) one, unnest([0, 0, 1]) both_ FROM ranked), reached AS (SELECT {_BY}, k, sum(one) one, sum(both_) both_ FROM depths GROUP BY ALL),
runs AS (SELECT {_BY}, 2.0 * sum(both_) OVER l / sum(one) OVER l a, pow(0.9, k - 1) - coalesce(pow(0.9, lead(k) OVER (PARTITION BY {_BY} ORDER BY k) - 1), 0) w FROM reached WINDOW l AS (PARTITION BY {_BY} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rbo AS (SELECT {_BY}, sum(a * w) rbo FROM runs GROUP BY {_BY})
SELECT rho.support_name, rho.release_pair, rho.d AS canonical_disease_id, m AS members, CASE WHEN so > 0 AND sn > 0 THEN {_r('rho')} END AS spearman, CASE WHEN ux > 0 AND uy > 0 THEN {_r('e / sqrt(ux * uy)')} END AS tau_b, {_r('rbo')} AS rbo FROM rho LEFT JOIN tau USING ({_BY}) JOIN rbo USING ({_BY})""",
    "signal_assessment": f"""WITH {_MOVED}, lead_ AS (SELECT {_BY}, bool_or((ro = 1) <> (rn = 1)) c, count(*) FILTER (ro <= 10 AND rn <= 10) / count(*) FILTER (ro <= 10 OR rn <= 10) j, max(m) m, quantile_cont(disp::DOUBLE, 0.9) q FROM moved GROUP BY {_BY}),
f AS (SELECT support_name, release_pair, avg(c::INT::DOUBLE) a, avg((j < 0.9)::INT::DOUBLE) FILTER (m >= 10) b, avg((q >= 0.1)::INT::DOUBLE) c FROM lead_ GROUP BY 1, 2), u AS (SELECT support_name, release_pair, unnest(['leader_change', 'low_overlap', 'high_displacement']) AS criterion, unnest([a, b, c]) x, unnest([0.05, 0.1, 0.1])::DOUBLE AS threshold FROM f)
SELECT support_name, release_pair, criterion, {_r('x')} AS fraction, threshold, coalesce(x >= threshold, false) AS met FROM u""",
    "area_displacement": f"""WITH {_MOVED}, med AS (SELECT {_BY}, quantile_cont(disp::DOUBLE, 0.5) x, min(areas) areas FROM moved GROUP BY {_BY}), ar AS (SELECT *, 1.0::DOUBLE / len(l) w, unnest(l) area_id FROM (SELECT *, list_distinct(list_filter(string_split(areas, ';'), lambda x: x <> '')) l FROM med) WHERE len(l) > 0),
run AS (SELECT *, sum(w) OVER (PARTITION BY support_name, release_pair, area_id ORDER BY x) c, sum(w) OVER (PARTITION BY support_name, release_pair, area_id) tot FROM ar WHERE x IS NOT NULL),
s AS (SELECT support_name, release_pair, area_id, count(*) panels, sum(w) weight FROM ar GROUP BY ALL), q AS (SELECT support_name, release_pair, area_id, min(x) FILTER (c + 1e-9 >= tot * 0.25) q25, min(x) FILTER (c + 1e-9 >= tot * 0.5) q50, min(x) FILTER (c + 1e-9 >= tot * 0.75) q75 FROM run GROUP BY ALL)
SELECT support_name, release_pair, area_id, panels, {_r('weight')} AS weight, {_r('q25')} AS q25, {_r('q50')} AS q50, {_r('q75')} AS q75 FROM s LEFT JOIN q USING (support_name, release_pair, area_id)""",
    "consensus_ranks": f"""WITH {_RANKED}, loss AS (SELECT support_name, d, t, sum((2 * (rn - 1) + cn) / (2.0 * m)) s, count(*) k FROM ranked GROUP BY 1, 2, 3), src AS (SELECT support_name, d, count(DISTINCT release_pair) a FROM ranked GROUP BY 1, 2)
SELECT support_name, d AS canonical_disease_id, t AS canonical_target_id, k AS sources, {_r('(s + a - k) / a')} AS loss FROM loss JOIN src USING (support_name, d)""",
    "fractional_allocation": f"WITH {_RANKED}, s AS (SELECT *, least(greatest({BUDGET} - (rn - 1), 0), cn) slots FROM ranked) SELECT {_ID}, t AS canonical_target_id, CASE WHEN slots = cn THEN 1 ELSE slots END::BIGINT AS num, CASE WHEN slots = cn THEN 1 ELSE cn END::BIGINT AS den FROM s WHERE slots > 0",
    "allocation_gap": f"WITH {_RANKED} SELECT {_ID}, {_r(f'min(n) FILTER (rn <= {BUDGET})')} AS cutoff_score, {_r(f'max(n) FILTER (rn > {BUDGET})')} AS next_score, {_r(f'min(n) FILTER (rn <= {BUDGET}) - max(n) FILTER (rn > {BUDGET})')} AS gap FROM ranked GROUP BY {_BY}",
    "allocation_change": f"WITH {_CHANGE} SELECT {_ID}, {', '.join(f'{_r(c)} AS {c}' for c in ('old_mass', 'new_mass', 'shared_mass', 'lost_mass', 'gained_mass', 'half_l1', 'weighted_jaccard'))} FROM change",
    "label_bounds": f"""WITH {_W}, b AS (SELECT {_BY}, sum(wn) returned, coalesce(sum(wn * lab), 0) known, coalesce(sum(wn) FILTER (lab IS NULL), 0) u FROM w WHERE wn > 0 GROUP BY {_BY}), c AS (SELECT *, round(known, 12) AS lower, round(known + u, 12) AS upper FROM b)
SELECT {_ID}, {_r('returned')} AS returned, {_r('known')} AS known, {_r('u')} AS unknown_mass, {_r('lower')} AS lower, {_r('upper')} AS upper, {_DIRECTION} AS direction FROM c""",
    "contrast_bounds": f"""WITH {_W}, v AS (SELECT *, round(wn - wo, 12) x FROM w WHERE wn <> wo), b AS (SELECT {_BY}, sum(x) returned, coalesce(sum(x * lab), 0) known, coalesce(sum(least(x, 0)) FILTER (lab IS NULL), 0) lo, coalesce(sum(greatest(x, 0)) FILTER (lab IS NULL), 0) hi, coalesce(sum(abs(x)) FILTER (lab IS NULL), 0) u FROM v GROUP BY {_BY}),
c AS (SELECT *, round(known + lo, 12) AS lower, round(known + hi, 12) AS upper FROM b) SELECT {_ID}, {_r('returned')} AS returned, {_r('known')} AS known, {_r('u')} AS unknown_mass, {_r('lower')} AS lower, {_r('upper')} AS upper, {_DIRECTION} AS direction FROM c""",
    "arm_mass": f"""WITH {_W} SELECT {_ID}, {_r('sum(wn)')} AS returned, {_r('coalesce(sum(wn) FILTER (lab = 1), 0)')} AS positive, {_r('coalesce(sum(wn) FILTER (lab = 0), 0)')} AS negative, {_r('coalesce(sum(wn) FILTER (lab IS NULL AND stable IS NOT NULL), 0)')} AS null_label,
{_r('coalesce(sum(wn) FILTER (stable IS NULL), 0)')} AS no_label, {_r(f'{BUDGET} - sum(wn)')} AS vacant FROM w GROUP BY {_BY}""",
    "stable_allocation": f"WITH {_W} SELECT support_name, d AS canonical_disease_id, t AS canonical_target_id, {_r('min(wn)')} AS weight FROM w WHERE wn > 0 GROUP BY 1, 2, 3 HAVING count(DISTINCT release_pair) = (SELECT count(DISTINCT release_pair) FROM w v WHERE v.support_name = w.support_name)",
    "mean_allocation": f"WITH {_W}, k AS (SELECT support_name, d, count(DISTINCT release_pair) k FROM w WHERE wn > 0 GROUP BY 1, 2) SELECT support_name, d AS canonical_disease_id, t AS canonical_target_id, {_r('sum(wn) / max(k)')} AS weight FROM w JOIN k USING (support_name, d) WHERE wn > 0 GROUP BY 1, 2, 3",
    "donor_means": f"""WITH {_CHANGE}, donors AS (SELECT support_name, release_pair, coalesce(areas, '') donor, avg(half_l1) h, avg(weighted_jaccard) j, count(*) k FROM change GROUP BY 1, 2, 3)
SELECT support_name, release_pair, count(*) AS donors, sum(k)::BIGINT AS models, {_r('avg(h)')} AS half_l1, {_r('avg(j)')} AS weighted_jaccard FROM donors GROUP BY 1, 2""",
    "panel_influence": f"""WITH {_PM}, x AS (SELECT {_BY}, avg(abs(n - o)) v FROM pm GROUP BY {_BY}), y AS (SELECT *, sum(v) OVER p s, count(*) OVER p k FROM x WINDOW p AS (PARTITION BY support_name, release_pair))
SELECT {_ID}, {_r('v')} AS mean_change, {_r('(s - v) / nullif(k - 1, 0)')} AS mean_without, {_r('s / k - (s - v) / nullif(k - 1, 0)')} AS influence FROM y""",
    "change_concentration": f"""WITH {_PM}, u AS (SELECT support_name, release_pair, t, sum(abs(round((n - o) * 1e9))::BIGINT)::BIGINT v FROM pm GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY support_name, release_pair ORDER BY v DESC, t) p FROM u)
SELECT support_name, release_pair, count(*) AS units, sum(v)::BIGINT AS total, {_r('sum(v) FILTER (p <= 1) / nullif(sum(v), 0)')} AS top_1_share, {_r('sum(v) FILTER (p <= 5) / nullif(sum(v), 0)')} AS top_5_share, {_r('sum(v) FILTER (p <= 10) / nullif(sum(v), 0)')} AS top_10_share FROM k GROUP BY 1, 2""",
    "matched_prefix": f"""WITH {_W}, run AS (SELECT *, sum(wn) OVER (PARTITION BY {_BY} ORDER BY n DESC, md5(t), t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) c FROM w WHERE wn > 0), k AS (SELECT *, greatest(0, wn - greatest(0, c - 4.5)) kw FROM run)
SELECT {_ID}, t AS canonical_target_id, {_r('kw')} AS kept_weight FROM k WHERE kw > 1e-12""",
    "leader_regret": f"""WITH {_RANKED}, b AS (SELECT *, max(n) OVER (PARTITION BY {_BY}) bn FROM ranked) SELECT {_ID}, {_r('max(n)')} AS best_value, {_r('max(n) FILTER (ro = 1)')} AS chosen_value, min(t) FILTER (n = bn) AS best_option, {_r('max(n) - max(n) FILTER (ro = 1)')} AS loss FROM b GROUP BY {_BY}""",
    "nondominated_targets": f"""WITH {_PM} SELECT a.support_name, a.release_pair, a.d AS canonical_disease_id, a.t AS canonical_target_id, a.n AS new_score, a.ne AS new_evidence_count FROM pm a WHERE ne IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM pm b WHERE b.support_name = a.support_name AND b.release_pair = a.release_pair AND b.d = a.d AND b.n >= a.n AND b.ne <= a.ne AND (b.n > a.n OR b.ne < a.ne))""",
    "margin_warnings": f"""WITH {_PM}, b AS (SELECT *, max(o) OVER (PARTITION BY {_BY}) bo, max(n) OVER (PARTITION BY {_BY}) bn FROM pm), x AS (SELECT {_BY}, CASE WHEN count(*) FILTER (o = bo) > 1 THEN 0.0 ELSE max(bo) - max(o) FILTER (o < bo) END margin, bool_or((o = bo) <> (n = bn)) changed FROM b GROUP BY {_BY}), y AS (SELECT *, coalesce(margin <= 0.01, false) w FROM x)
SELECT support_name, release_pair, count(*) FILTER (w AND changed) AS true_warnings, count(*) FILTER (w AND NOT changed) AS false_warnings, count(*) FILTER (NOT w AND changed) AS missed, count(*) FILTER (NOT w AND NOT changed) AS quiet FROM y GROUP BY 1, 2""",
    "prediction_metrics": f"""WITH {_PRED} SELECT support_name, release_pair, count(*) AS rows, sum(y)::BIGINT AS positives, {_r('avg((o - y) ** 2)')} AS brier, {_r('sum(y * hits / (pr + pc - 1)::DOUBLE) / sum(y)')} AS average_precision,
{_r('sum(y * least(greatest(ceil(pn * 0.25) - (pr - 1), 0), pc) / pc) / sum(y)')} AS capture FROM pred GROUP BY 1, 2""",
    "prediction_calibration": f"WITH {_PRED} SELECT support_name, release_pair, least(floor(o * 10), 9)::INT AS bin, count(*) AS rows, {_r('avg(o)')} AS mean_probability, {_r('avg(y)')} AS observed_rate FROM pred GROUP BY 1, 2, 3",
    "disease_folds": f"WITH {_PM} SELECT d AS canonical_disease_id, ((row_number() OVER (ORDER BY md5(d), d) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT d FROM pm)",
    "chosen_predictor": f"""WITH {_RANKED}, both_ AS (SELECT support_name, release_pair, 'old_score' s, (rn <= 10)::INT y, o x FROM ranked UNION ALL SELECT support_name, release_pair, 'evidence', (rn <= 10)::INT, oe / (oe + 10.0) FROM ranked WHERE oe IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY support_name, release_pair, s ORDER BY x DESC) pr, count(*) OVER (PARTITION BY support_name, release_pair, s, x) pc, count(*) OVER (PARTITION BY support_name, release_pair, s) pn FROM both_),
m AS (SELECT support_name, release_pair, s, {_r('avg((x - y) ** 2)')} b, {_r('sum(y * least(greatest(ceil(pn * 0.25) - (pr - 1), 0), pc) / pc) / sum(y)')} c FROM k GROUP BY 1, 2, 3)
SELECT support_name, release_pair, s AS chosen FROM m WHERE c IS NOT NULL AND b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY support_name, release_pair ORDER BY c DESC, b, s) = 1""",
    "scenario_outcomes": f"""WITH {_PM}, num AS (SELECT {_BY}, t, o s, row_number() OVER (PARTITION BY {_BY} ORDER BY md5('0' || '|' || support_name || '|' || release_pair || '|' || d || '|' || t), t) no, count(*) OVER p k, max(o) OVER p best, quantile_cont(o, 0.5) OVER p med FROM pm WINDOW p AS (PARTITION BY {_BY})),
first_ AS (SELECT {_BY}, min(t) FILTER (s = best) lead_, min(t) FILTER (s < best) other FROM num GROUP BY 1, 2, 3), other_ AS (SELECT f.*, x.s os FROM first_ f LEFT JOIN num x ON x.support_name = f.support_name AND x.release_pair = f.release_pair AND x.d = f.d AND x.t = f.other),
runs AS (SELECT unnest(['unchanged', 'monotone_score_rescaling', 'persistent_leader_replacement']) scenario, NULL::DOUBLE AS level UNION ALL SELECT c, l FROM (SELECT unnest(['persistent_score_perturbation', 'roster_entry', 'roster_exit', 'exact_reversible_identifier_rename']) c), (SELECT unnest([0.01::DOUBLE, 0.05, 0.2]) l)),
cases AS (SELECT num.*, lead_, other, os, scenario, level, greatest(1, ceil(level * k)) amount, coalesce(no <= greatest(1, ceil(level * k)), false) hit FROM num JOIN other_ USING ({_BY}), runs),
ed AS (SELECT {_BY}, scenario, level, s o, CASE WHEN scenario = 'monotone_score_rescaling' THEN s * 0.5 WHEN scenario = 'persistent_leader_replacement' THEN CASE WHEN other IS NULL THEN CASE WHEN t = lead_ THEN s ELSE s * 0.5 END WHEN t = lead_ THEN os WHEN t = other THEN best ELSE s END
  WHEN scenario = 'persistent_score_perturbation' AND hit THEN least(1.0, s * (1 + CASE WHEN no % 2 = 1 THEN level ELSE -level END)) WHEN scenario IN ('roster_exit', 'exact_reversible_identifier_rename') AND hit THEN NULL ELSE s END n FROM cases
  UNION ALL SELECT {_BY}, scenario, level, NULL, CASE WHEN scenario <> 'roster_entry' THEN s WHEN no <= ceil(amount / 2) THEN best ELSE med END FROM cases WHERE scenario IN ('roster_entry', 'exact_reversible_identifier_rename') AND hit),
b AS (SELECT *, max(o) OVER p bo, max(n) OVER p bn FROM ed WINDOW p AS (PARTITION BY {_BY}, scenario, level))
SELECT {_ID}, scenario, level, count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) AS persistent, count(*) FILTER (o IS NULL) AS entering, count(*) FILTER (n IS NULL) AS exiting, count(*) FILTER (o <> n) AS changed,
bool_or(coalesce(o = bo, false) <> coalesce(n = bn, false)) AS leaders_changed FROM b GROUP BY {_BY}, scenario, level""",
}

ORACLE["change_census"] = f"""WITH {_PM}, c AS (SELECT {_BY}, round(n - o, 9) + 0.0 x FROM pm) SELECT {_ID}, count(*) AS members, count(*) FILTER (x < 0) AS negative, count(*) FILTER (x = 0) AS zero, count(*) FILTER (x > 0) AS positive,
quantile_disc(x, 0.25) AS q25, quantile_disc(x, 0.5) AS q50, quantile_disc(x, 0.75) AS q75 FROM c GROUP BY {_BY}"""

_DEPTHS = f"""{_RANKED}, depths AS (SELECT DISTINCT {_BY}, m, unnest(range(1, m + 1)) AS depth FROM ranked),
reach AS (SELECT x.support_name, x.release_pair, x.d, x.m, depth, sum(CASE WHEN depth >= ro AND depth >= rn THEN 1 ELSE 0 END) w0, sum(CASE WHEN depth >= ro THEN 1 ELSE 0 END) w1, sum(CASE WHEN depth >= rn THEN 1 ELSE 0 END) w2,
  sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (depth - ro + 1) / co::DOUBLE)) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (depth - rn + 1) / cn::DOUBLE))) b0, sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (depth - ro + 1) / co::DOUBLE)) ** 2) b1,
  sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (depth - rn + 1) / cn::DOUBLE)) ** 2) b2 FROM depths x JOIN ranked r ON r.support_name = x.support_name AND r.release_pair = x.release_pair AND r.d = x.d GROUP BY ALL),
agree AS (SELECT {_BY}, m, depth, v AS variant, CASE WHEN v = 'w' THEN 2.0::DOUBLE * w0 / (w1 + w2) ELSE b0 / sqrt(b1 * b2) END a FROM reach, (SELECT unnest(['w', 'b']) v)),
seen AS (SELECT {_BY}, m, variant, p AS persistence, sum(a * p ** depth) s FROM agree, (SELECT unnest([0.9::DOUBLE, 0.8, 0.95]) p) GROUP BY ALL),
tails AS (SELECT m, p, sum(p ** k / k) t FROM (SELECT m, p, unnest(range(m + 1, m + 900)) k FROM (SELECT DISTINCT m, persistence p FROM seen)) GROUP BY ALL),
bounds AS (SELECT seen.*, (1 - persistence) / persistence * (s + seen.m * t) lo, (1 - persistence) / persistence * (s + persistence ** (seen.m + 1) / (1 - persistence)) hi FROM seen JOIN tails ON tails.m = seen.m AND p = persistence)"""
ORACLE["overlap_bounds"] = f"WITH {_DEPTHS} SELECT {_ID}, variant, persistence, round(lo, 8) AS least, round(hi, 8) AS most, round(hi, 8) AS extrapolated, round(hi - lo, 8) AS residual FROM bounds"
