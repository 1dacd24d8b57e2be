"""Queries of native panels, areas and whole comparisons over association_support and the crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshift.functions.scalars import clean_target
from panelshift.operators import native, revision, support
from panelshift.operators.ordering import with_quantiles
from panelshift.operators.panel import both_ladders
from panelshift.plans import release_queries as base
from panelshift.plans.release_queries import _FIXED, _TRANS, _kept, _rounded
from panelshift.sources.tables import load

BY = ["release_pair", "canonical_disease_id"]


def _placed(spark: SparkSession, d: str, stable: bool = False) -> DataFrame:
    rows = native.paired_members(base.transitions(spark, d).filter("stable_entity") if stable else base.transitions(spark, d))
    return _kept(native.placed_members(_kept(rows), BY))


def native_rank_context(spark: SparkSession, d: str) -> DataFrame:
    """Rank, ties and top-ten membership of every native member."""
    rows = _kept(support.native_members(base.canonical(spark, d)).select("release_id", *base.PAIR, "score"))
    return native.rank_context(rows, ["release_id", "canonical_disease_id"], "score")


def native_panel_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Leaders and top sets of panels that both releases of a pair have: sizes, overlap, change and its reason."""
    return _rounded(native.panel_metrics(_placed(spark, d), BY))


def stable_native_panels(spark: SparkSession, d: str) -> DataFrame:
    """`native_panel_metrics` among pairs whose entities are stable."""
    return _rounded(native.panel_metrics(_placed(spark, d, stable=True), BY))


def native_leader_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every target that became or ceased to be a leader of a native panel, with the class of its context."""
    moved = native.set_flags(_placed(spark, d), BY, (0,)).filter("old_in <> new_in")
    return moved.select(*BY, "canonical_target_id", "old_in", "new_in", native.context_class(F.col("mapping_affected"), F.col("old_present"), F.col("new_present")).alias("context_class"))


def native_top_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Panels by the Jaccard overlap of their top tens, rounded to two places, with their share of those that have one."""
    found = native.panel_metrics(_placed(spark, d), BY).filter("cutoff = 10 and jaccard is not null").select("release_pair", F.round("jaccard", 2).alias("overlap"))
    counts = _kept(found.groupBy("release_pair", "overlap").agg(F.count("*").alias("panels")))
    totals = counts.groupBy("release_pair").agg(F.sum("panels").alias("_all"))
    return counts.join(totals, "release_pair").select("release_pair", "overlap", "panels", F.round(F.col("panels") / F.col("_all"), 9).alias("fraction"))


def native_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Counters of what must not occur in native members, registry and metrics."""
    rows = _kept(base.canonical(spark, d))
    members = support.native_members(rows)
    metrics = native.panel_metrics(_kept(native.placed_members(native.paired_members(support.state_transitions(rows, support.release_list(rows))), BY)), BY)
    return native.integrity_counters(members, support.native_registry(members), metrics, "release_id", "canonical_disease_id", "canonical_target_id")


def disease_registry(spark: SparkSession, d: str) -> DataFrame:
    """Fixed panels of the pair support beside the native panels of both releases; a panel occurs once on each side or the query fails."""
    rows = _kept(base.canonical(spark, d))
    steps = _kept(support.state_transitions(rows, support.release_list(rows)))
    own = steps.groupBy(*BY).agg(F.count_if("old_eligible").alias("old_native_targets"), F.count_if("new_eligible").alias("new_native_targets"))
    fixed = support.fixed_registry(support.fixed_members(steps, support.release_list(rows))).filter(F.col("support_name") == support.PAIR_SUPPORT).select(*BY, F.col("target_count").alias("fixed_targets"), "eligible_30", "stable_eligible", "exclusion_reason")
    joined = native.joined_one_to_one(own, fixed, BY, "left")
    status = F.when(F.col("eligible_30"), "FIXED_ELIGIBLE").when(F.col("fixed_targets").isNotNull(), "FIXED_INELIGIBLE").when((F.col("old_native_targets") > 0) & (F.col("new_native_targets") > 0), "NATIVE_ONLY").otherwise("ONE_RELEASE")
    return joined.withColumn("registry_status", status)


def _areas(spark: SparkSession, d: str) -> DataFrame:
    """Usable disease entries of each release once per area, with weight 1/n."""
    entries = base.disease_entries(spark, d).filter(F.col("mapping_status").isin("EXACT_ID", "MAPPED")).select("release_id", F.col("canonical_id").alias("canonical_disease_id"), F.col("detail").alias("areas"))
    return revision.with_areas(entries).select("release_id", "canonical_disease_id", "area_id", "area_weight")


def stable_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area assignments that all releases share with equal weight."""
    rows = _kept(_areas(spark, d))
    return _rounded(native.stable_areas(rows, len(support.release_list(rows)), "release_id", "canonical_disease_id", "area_id", "area_weight"))


def mapped_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas of a disease that the release before has too, over all of its areas in both, per release pair."""
    rows = _kept(_areas(spark, d).select("release_id", "canonical_disease_id", "area_id"))
    names = support.release_list(rows)
    pairs = F.array(*[F.struct(F.lit(f"{a}_to_{b}").alias("release_pair"), F.lit(r).alias("_r"), F.lit(i).alias("_side")) for a, b in zip(names, names[1:]) for i, r in enumerate((a, b))])
    sides = rows.select("*", F.inline(F.filter(pairs, lambda x: x["_r"] == F.col("release_id"))))
    each = sides.groupBy(*BY, "area_id").agg(F.bool_or(F.col("_side") == 0).alias("o"), F.bool_or(F.col("_side") == 1).alias("n"))
    sums = each.groupBy(*BY).agg(F.count_if("o").alias("old_areas"), F.count_if("n").alias("new_areas"), F.count_if(F.col("o") & F.col("n")).alias("kept_areas"))
    return sums.withColumn("mapping_status", F.when((F.col("kept_areas") == F.col("old_areas")) & (F.col("kept_areas") == F.col("new_areas")), "IDENTICAL").when(F.col("kept_areas") > 0, "PARTIAL").otherwise("UNMAPPED"))


def _area_changes(spark: SparkSession, d: str) -> DataFrame:
    metrics = native.panel_metrics(_placed(spark, d), BY).filter("cutoff in (0, 10)")
    panels = metrics.groupBy(*BY).agg(F.max(F.when(F.col("cutoff") == 0, F.col("changed"))).alias("leaders_changed"), F.max(F.when(F.col("cutoff") == 10, F.col("jaccard"))).alias("top_10_jaccard"))
    rows = _kept(_areas(spark, d))
    kept = native.stable_areas(rows, len(support.release_list(rows)), "release_id", "canonical_disease_id", "area_id", "area_weight")
    return panels.join(kept, "canonical_disease_id")


def _area_sums(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("top_10_jaccard") < 0.9
    return _area_changes(spark, d).groupBy("release_pair", "area_id").agg(
        F.count("*").alias("panels"), F.count_if("leaders_changed").alias("changed_panels"), native.weighted_fraction(F.col("leaders_changed"), F.col("area_weight")).alias("changed_fraction"),
        F.count("top_10_jaccard").alias("top_10_panels"), native.weighted_fraction(low, F.col("area_weight")).alias("low_overlap_fraction"),
    )


def area_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per release pair and stable area: native panels, changed leaders, their weighted fraction, and that of low top-ten overlap."""
    return _rounded(_area_sums(spark, d))


def area_heterogeneity(spark: SparkSession, d: str) -> DataFrame:
    """Per release pair: whether the change of leaders differs between well populated areas."""
    return _rounded(native.heterogeneity(_area_sums(spark, d), ["release_pair"], "changed_fraction", "panels", "changed_panels"))


def prior_symbol_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Targets without a canonical id and the canonical ids that carry their symbol, letter case ignored, in any release."""
    rows = load(spark, d, "target_crosswalk", ["release_id", "source_target_id", "source_approved_symbol", "canonical_target_id"])
    clean = rows.select("release_id", clean_target("source_target_id").alias("source_target_id"), F.upper("source_approved_symbol").alias("symbol"), F.nullif(clean_target("canonical_target_id"), F.lit("")).alias("c")).filter("symbol is not null")
    lost = clean.filter("c is null and release_id is not null and source_target_id is not null").select("release_id", "source_target_id", "symbol").distinct()
    known = clean.filter("c is not null").select("symbol", F.col("c").alias("candidate_id")).distinct()
    found = lost.join(known, "symbol").filter("candidate_id <> source_target_id")
    sizes = found.groupBy("release_id", "source_target_id", "symbol").agg(F.count("*").alias("candidates"))
    return found.join(sizes, ["release_id", "source_target_id", "symbol"])


def comparison_report(spark: SparkSession, d: str, minimum: int = 30) -> DataFrame:
    """One row per release pair and panel: support, changes of native and fixed leaders and top tens, and score changes on the fixed support.

    Fixed measures are NULL for panels under `minimum` persistent members, native ones where a release has too few members.
    """
    rows = _kept(native.paired_members(base.transitions(spark, d)))
    own = native.panel_metrics(_kept(native.placed_members(rows, BY)), BY).filter("cutoff in (0, 10)")
    at = {0: "leaders", 10: "top_10"}
    wide = own.groupBy(*BY).agg(*[F.max(F.when(F.col("cutoff") == k, F.col(c))).alias(f"native_{n}_{c}") for k, n in at.items() for c in ("changed", "jaccard")])
    sizes = rows.groupBy(*BY).agg(F.count_if("old_present").alias("baseline"), F.count_if("new_present").alias("followup"), F.count_if(F.col("old_present") & F.col("new_present")).alias("fixed"))
    both = rows.filter("old_present and new_present").withColumn("_change", F.abs(F.col("new_score") - F.col("old_score")))
    ranked = both_ladders(both, BY)
    lead = ranked.groupBy(*BY).agg((F.count_if((F.col("old_above") == 0) != (F.col("new_above") == 0)) > 0).alias("fixed_leaders_changed"), F.avg("_change").alias("mean_change"))
    scored = with_quantiles(lead, both, BY, {"median_change": ("_change", 0.5)})
    enough = F.col("fixed") >= minimum
    joined = sizes.join(wide, BY).join(scored, BY, "left").withColumns({c: F.when(enough, F.col(c)) for c in ("fixed_leaders_changed", "mean_change", "median_change")})
    return _rounded(joined.withColumns({"entering": F.col("followup") - F.col("fixed"), "exiting": F.col("baseline") - F.col("fixed")}))


# The strategies and which of the tasks each reports.
STRATEGIES = {"native_only": (False, True, True), "fixed_only": (True, False, True), "fixed_and_native": (True, True, True), "support_explicit": (True, True, True), "head_weighted_overlap": (False, False, False)}
TASKS = ("fixed_leading_set_change", "native_leading_set_change", "persistent_versus_roster_membership_description")


def strategy_answers(spark: SparkSession, d: str) -> DataFrame:
    """How many panels each reporting strategy answers, abstains from or doesn't report, per release pair and task."""
    report = comparison_report(spark, d).select("release_pair", F.col("fixed_leaders_changed").isNotNull().alias("_a0"), F.col("native_leaders_changed").isNotNull().alias("_a1"), F.lit(True).alias("_a2"))
    cases = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(t).alias("task"), F.when(F.lit(reports[i]), F.when(F.col(f"_a{i}"), "ANSWERED").otherwise("ABSTAINED")).otherwise("NOT_REPORTED").alias("state")) for s, reports in STRATEGIES.items() for i, t in enumerate(TASKS)])
    return report.select("release_pair", F.inline(cases)).groupBy("release_pair", "strategy", "task", "state").agg(F.count("*").alias("panels"))


QUERIES = {
    f.__name__: f
    for f in (native_rank_context, native_panel_metrics, stable_native_panels, native_leader_changes, native_top_distribution, native_integrity, disease_registry, stable_areas, mapped_areas, area_changes, area_heterogeneity, prior_symbol_candidates, comparison_report, strategy_answers)
}

# The same in SQL.


def _paired(where: str = "true") -> str:
    return f"""u AS (SELECT release_pair, d, t, old_eligible o, new_eligible n, mapping_affected m, CASE WHEN old_eligible THEN old_score END os, CASE WHEN new_eligible THEN new_score END ns FROM trans WHERE (old_eligible OR new_eligible) AND {where}),
pr AS (SELECT *, count(*) FILTER (o) OVER (PARTITION BY release_pair, d) om, count(*) FILTER (n) OVER (PARTITION BY release_pair, d) nm FROM u QUALIFY om > 0 AND nm > 0),
pl AS (SELECT *, CASE WHEN o THEN rank() OVER (PARTITION BY release_pair, d ORDER BY os DESC NULLS LAST) END ro, CASE WHEN n THEN rank() OVER (PARTITION BY release_pair, d ORDER BY ns DESC NULLS LAST) END rn FROM pr),
fl AS (SELECT *, CASE WHEN om >= greatest(k, 1) THEN coalesce(ro <= greatest(k, 1), false) END oi, CASE WHEN nm >= greatest(k, 1) THEN coalesce(rn <= greatest(k, 1), false) END ni FROM pl, (SELECT unnest([0, 5, 10, 20]) k)),
mt AS (SELECT release_pair, d, k, sum(oi::BIGINT)::BIGINT os, sum(ni::BIGINT)::BIGINT ns, sum((oi AND ni)::BIGINT)::BIGINT sh, bool_or(oi IS NULL OR ni IS NULL) missing, count(*) FILTER (oi <> ni) moved,
  list_sort(list_distinct(list(CASE WHEN m THEN 'MAPPING_AFFECTED' WHEN o AND n THEN 'PERSISTENT_PAIR_RERANKING' WHEN n THEN 'ENTRANT' ELSE 'EXIT' END) FILTER (oi <> ni))) r FROM fl GROUP BY 1, 2, 3),
metrics AS (SELECT *, CASE WHEN missing THEN NULL ELSE sh / (os + ns - sh) END jac, CASE WHEN missing THEN NULL ELSE sh <> os + ns - sh END ch, CASE WHEN missing THEN 'UNRESOLVED' WHEN moved = 0 THEN 'UNCHANGED' WHEN len(r) = 1 THEN r[1] ELSE 'MIXED' END reason FROM mt)"""


_METRICS = "SELECT release_pair, d AS canonical_disease_id, k AS cutoff, os AS old_size, ns AS new_size, sh AS shared, round(jac, 9) AS jaccard, ch AS changed, reason FROM metrics"
_AREAS = """ar AS (SELECT release_id, d, 1.0::DOUBLE / len(l) w, unnest(l) a FROM (SELECT release_id, canonical_id d, list_distinct(list_filter(string_split(detail, ';'), lambda x: x <> '')) l FROM xd WHERE mapping_status IN ('EXACT_ID', 'MAPPED')) WHERE len(l) > 0),
st AS (SELECT d, a, max(w) w FROM ar GROUP BY 1, 2 HAVING count(DISTINCT release_id) = (SELECT count(DISTINCT release_id) FROM ar) AND max(w) - min(w) <= 1e-12)"""
_CHANGES = f"""{_TRANS}, {_paired()}, {_AREAS}, pn AS (SELECT release_pair, d, bool_or(ch) FILTER (k = 0) lc, max(jac) FILTER (k = 10) j FROM metrics GROUP BY 1, 2),
ac AS (SELECT release_pair, a area_id, count(*) panels, count(*) FILTER (lc) changed_panels, sum(w) FILTER (lc) / sum(w) FILTER (lc IS NOT NULL) cf0, count(j) top_10_panels, sum(w) FILTER (j < 0.9) / sum(w) FILTER (j IS NOT NULL) lf, sum(w) FILTER (lc IS NOT NULL) wt FROM pn JOIN st USING (d) GROUP BY 1, 2),
acs AS (SELECT release_pair, area_id, panels, changed_panels, CASE WHEN changed_panels = 0 THEN NULL ELSE cf0 END changed_fraction, top_10_panels, lf low_overlap_fraction FROM ac)"""
_REPORT = f"""{_TRANS}, {_paired()}, sz AS (SELECT release_pair, d, count(*) FILTER (o) b, count(*) FILTER (n) f, count(*) FILTER (o AND n) x FROM pr GROUP BY 1, 2),
nm2 AS (SELECT release_pair, d, bool_or(ch) FILTER (k = 0) lc, max(jac) FILTER (k = 0) lj, bool_or(ch) FILTER (k = 10) tc, max(jac) FILTER (k = 10) tj FROM metrics GROUP BY 1, 2),
fx AS (SELECT release_pair, d, bool_or((os = bo) <> (ns = bn)) fc, avg(abs(ns - os)) mc, quantile_cont(abs(ns - os), 0.5) md FROM (SELECT *, max(os) OVER (PARTITION BY release_pair, d) bo, max(ns) OVER (PARTITION BY release_pair, d) bn FROM pr WHERE o AND n) GROUP BY 1, 2),
report AS (SELECT sz.release_pair, sz.d AS canonical_disease_id, b AS baseline, f AS followup, x AS fixed, lc AS native_leaders_changed, round(lj, 9) AS native_leaders_jaccard, tc AS native_top_10_changed, round(tj, 9) AS native_top_10_jaccard, CASE WHEN x >= 30 THEN fc END AS fixed_leaders_changed,
CASE WHEN x >= 30 THEN round(mc, 9) END AS mean_change, CASE WHEN x >= 30 THEN round(md, 9) END AS median_change, f - x AS entering, b - x AS exiting FROM sz JOIN nm2 USING (release_pair, d) LEFT JOIN fx USING (release_pair, d))"""
_SYMBOLS = r"""cl AS (SELECT release_id, regexp_replace(upper(trim(source_target_id)), '\.[0-9]+$', '') s, upper(source_approved_symbol) sym, nullif(regexp_replace(upper(trim(canonical_target_id)), '\.[0-9]+$', ''), '') c FROM target_crosswalk WHERE source_approved_symbol IS NOT NULL),
found AS (SELECT DISTINCT a.release_id, a.s, a.sym, b.c FROM cl a JOIN cl b ON a.sym = b.sym WHERE a.c IS NULL AND a.release_id IS NOT NULL AND a.s IS NOT NULL AND b.c IS NOT NULL AND b.c <> a.s)"""
_COUNTERS = ("member_without_registry", "registry_without_members", "duplicate_member_key", "invalid_evidence_count", "roster_count_mismatch", "stable_registry_mismatch", "eligibility_mismatch", "unresolved_changed_reason", "reason_partition_mismatch")

ORACLE = {
    "native_rank_context": f"""WITH {_TRANS} SELECT release_id, canonical_disease_id, canonical_target_id, score, rank() OVER p AS first_tied_rank, count(*) OVER (PARTITION BY release_id, canonical_disease_id, score) AS tied_targets,
(rank() OVER p + (count(*) OVER (PARTITION BY release_id, canonical_disease_id, score) - 1) / 2.0)::DOUBLE AS average_rank, rank() OVER p <= 10 AS top_member FROM canon WHERE eligible WINDOW p AS (PARTITION BY release_id, canonical_disease_id ORDER BY score DESC)""",
    "native_panel_metrics": f"WITH {_TRANS}, {_paired()} {_METRICS}",
    "stable_native_panels": f"WITH {_TRANS}, {_paired('stable_entity')} {_METRICS}",
    "native_leader_changes": f"""WITH {_TRANS}, {_paired()} SELECT release_pair, d AS canonical_disease_id, t AS canonical_target_id, oi AS old_in, ni AS new_in, CASE WHEN m THEN 'MAPPING_AFFECTED' WHEN n AND NOT o THEN 'ENTRANT' WHEN o AND NOT n THEN 'EXIT' ELSE 'PERSISTENT_PAIR_RERANKING' END AS context_class
FROM fl WHERE k = 0 AND oi <> ni""",
    "native_top_distribution": f"WITH {_TRANS}, {_paired()} SELECT release_pair, round(jac, 2) AS overlap, count(*) AS panels, round(count(*) / sum(count(*)) OVER (PARTITION BY release_pair), 9) AS fraction FROM metrics WHERE k = 10 AND jac IS NOT NULL GROUP BY 1, 2",
    "native_integrity": f"""WITH {_TRANS}, {_paired()}, mem AS (SELECT release_id, canonical_disease_id d, canonical_target_id t, count(*) n, count(*) FILTER (coalesce(evidence_count < 1, true)) bad FROM canon WHERE eligible GROUP BY 1, 2, 3)
SELECT unnest([{', '.join(f"'{c}'" for c in _COUNTERS)}]) AS counter, unnest([0, 0, (SELECT count(*) FILTER (n > 1) FROM mem), (SELECT coalesce(sum(bad), 0)::BIGINT FROM mem), 0, 0, 0,
(SELECT count(*) FILTER (coalesce(ch, false) AND reason = 'UNRESOLVED') FROM metrics), (SELECT count(*) FILTER (coalesce(ch, false) = (reason = 'UNCHANGED')) FROM metrics)]) AS violations""",
    "disease_registry": f"""WITH {_FIXED}, own AS (SELECT release_pair, d, count(*) FILTER (old_eligible) o, count(*) FILTER (new_eligible) n FROM trans GROUP BY 1, 2)
SELECT own.release_pair, d AS canonical_disease_id, o AS old_native_targets, n AS new_native_targets, target_count AS fixed_targets, eligible_30, stable_eligible, exclusion_reason,
CASE WHEN eligible_30 THEN 'FIXED_ELIGIBLE' WHEN target_count IS NOT NULL THEN 'FIXED_INELIGIBLE' WHEN o > 0 AND n > 0 THEN 'NATIVE_ONLY' ELSE 'ONE_RELEASE' END AS registry_status
FROM own LEFT JOIN (SELECT * FROM judged WHERE support_name = 'PAIR_SPECIFIC_PERSISTENT') j ON j.release_pair = own.release_pair AND j.canonical_disease_id = own.d""",
    "stable_areas": f"WITH {_TRANS}, {_AREAS} SELECT d AS canonical_disease_id, a AS area_id, round(w, 9) AS area_weight FROM st",
    "mapped_areas": f"""WITH {_TRANS}, {_AREAS}, rp AS (SELECT release_id r, lead(release_id) OVER (ORDER BY release_id) x FROM (SELECT DISTINCT release_id FROM ar)), e AS (SELECT r || '_to_' || x release_pair, d, a, bool_or(release_id = r) o, bool_or(release_id = x) n FROM rp JOIN ar ON release_id IN (r, x) WHERE x IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT release_pair, d, count(*) FILTER (o) oa, count(*) FILTER (n) na, count(*) FILTER (o AND n) k FROM e GROUP BY 1, 2)
SELECT release_pair, d AS canonical_disease_id, oa AS old_areas, na AS new_areas, k AS kept_areas, CASE WHEN k = oa AND k = na THEN 'IDENTICAL' WHEN k > 0 THEN 'PARTIAL' ELSE 'UNMAPPED' END AS mapping_status FROM s""",
    "area_changes": f"WITH {_CHANGES} SELECT release_pair, area_id, panels, changed_panels, round(changed_fraction, 9) AS changed_fraction, top_10_panels, round(low_overlap_fraction, 9) AS low_overlap_fraction FROM acs",
    "area_heterogeneity": f"""WITH {_CHANGES}, h AS (SELECT release_pair, count(*) FILTER (panels >= 20) p, count(*) FILTER (panels >= 20 AND changed_panels >= 3) c, min(changed_fraction) FILTER (panels >= 20) lo, max(changed_fraction) FILTER (panels >= 20) hi FROM acs GROUP BY 1)
SELECT release_pair, p AS populated_areas, c AS changing_areas, round(lo, 9) AS lowest, round(hi, 9) AS highest, round(hi - lo, 9) AS "range", coalesce(hi - lo >= 0.1 AND p >= 5 AND c >= 2, false) AS heterogeneous FROM h""",
    "prior_symbol_candidates": f"WITH {_SYMBOLS} SELECT release_id, s AS source_target_id, sym AS symbol, c AS candidate_id, count(*) OVER (PARTITION BY release_id, s, sym) AS candidates FROM found",
    "comparison_report": f"WITH {_REPORT} SELECT * FROM report",
    "strategy_answers": f"""WITH {_REPORT}, a AS (SELECT release_pair, unnest(['fixed_leading_set_change', 'native_leading_set_change', 'persistent_versus_roster_membership_description']) task, unnest([1, 2, 3]) i, unnest([fixed_leaders_changed IS NOT NULL, native_leaders_changed IS NOT NULL, true]) known FROM report),
s AS (SELECT * FROM (VALUES ('native_only', [false, true, true]), ('fixed_only', [true, false, true]), ('fixed_and_native', [true, true, true]), ('support_explicit', [true, true, true]), ('head_weighted_overlap', [false, false, false])) v(strategy, shows))
SELECT release_pair, strategy, task, CASE WHEN NOT shows[i] THEN 'NOT_REPORTED' WHEN known THEN 'ANSWERED' ELSE 'ABSTAINED' END AS state, count(*) AS panels FROM a, s GROUP BY 1, 2, 3, 4""",
}
