"""Queries of the protein link graph and of identity alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelshift.functions.scalars import affirmative, clean_target
from panelshift.operators import graph, identity
from panelshift.plans.data_checks import sound_links
from panelshift.plans.release_queries import _rounded, releases
from panelshift.session import cut_lineage
from panelshift.sources.tables import load

ARCHIVES = ("arc000", "arc001")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical_edges(sound_links(spark, d), ["archive_id"], "protein1", "protein2", "combined_score")


def _versions(spark: SparkSession, d: str, threshold: float = 0.0) -> list[DataFrame]:
    return [edges(spark, d).filter((F.col("archive_id") == a) & (F.col("score") >= threshold)).drop("archive_id") for a in ARCHIVES]


def _edits(spark: SparkSession, d: str) -> DataFrame:
    registry = load(spark, d, "baseline_anchor_registry", ["archive_id", "anchor_id", "cohort_20"]).filter((F.col("archive_id") == ARCHIVES[0]) & F.col("cohort_20"))
    both = graph.edge_transitions(*_versions(spark, d))
    return graph.edit_classes(both, registry.select(F.col("anchor_id").alias("node")), _modules(spark, d), 400)


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of the first archive with their stratum of degrees, which stands for a module: the given tables have no other grouping of proteins."""
    rows = load(spark, d, "baseline_anchor_registry", ["archive_id", "anchor_id", "baseline_degree_stratum"]).filter((F.col("archive_id") == ARCHIVES[0]) & F.col("anchor_id").isNotNull())
    return rows.groupBy(F.col("anchor_id").alias("node")).agg(F.min("baseline_degree_stratum").alias("module"))


def canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def degree_registry(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_registry(edges(spark, d), ["archive_id"])


def edge_transitions(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_transitions(*_versions(spark, d))


def threshold_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.threshold_decomposition(graph.edge_transitions(*_versions(spark, d))))


def edit_classes(spark: SparkSession, d: str) -> DataFrame:
    return _edits(spark, d)


def edit_burden(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.edit_burden(_edits(spark, d), _degrees(spark, d)))


def edited_graph(spark: SparkSession, d: str) -> DataFrame:
    """The first archive's edges with only the edits that touch an anchor."""
    return graph.apply_edits(_versions(spark, d, 400)[0], _edits(spark, d).filter(F.col("edit_class").startswith("P")))


def neighbour_change(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(graph.neighbour_change(*_versions(spark, d, 400)))


def _strata(edges_: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges with the stratum of either end, 'none' for proteins without one."""
    for e in ("a", "b"):
        edges_ = edges_.join(modules.select(F.col("node").alias(f"node_{e}"), F.col("module").alias(f"stratum_{e}")), f"node_{e}", "left")
    return edges_.withColumns({f"stratum_{e}": F.coalesce(f"stratum_{e}", F.lit("none")) for e in ("a", "b")})


def _controls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Removed edges and the edges drawn to match them."""
    edits, modules = _edits(spark, d).filter("edit = 'REMOVED'"), _modules(spark, d)
    kept = graph.apply_edits(_versions(spark, d, 400)[0], edits).withColumn("edge", F.concat_ws("~", "node_a", "node_b"))
    strata = ["stratum_a", "stratum_b"]
    removed = _strata(edits.select("node_a", "node_b"), modules)
    return removed, graph.matched_controls(_strata(kept, modules), removed.select(*strata), strata, "edge").select("node_a", "node_b")


def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    """Unedited edges drawn to match the removed ones by the strata of their ends."""
    return _controls(spark, d)[1]


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_registry(edges(spark, d).filter(F.col("archive_id") == ARCHIVES[0]), []).select("node", F.col("degree_400").alias("degree"))


def control_balance(spark: SparkSession, d: str) -> DataFrame:
    """Whether removed edges and their controls have alike degrees at their ends, and alike scores."""
    scores, degrees = _versions(spark, d, 400)[0].select("node_a", "node_b", "score"), cut_lineage(_degrees(spark, d))

    def measured(rows: DataFrame) -> DataFrame:
        out = rows.select("node_a", "node_b").join(scores, ["node_a", "node_b"])
        for e in ("a", "b"):
            out = out.join(degrees.select(F.col("node").alias(f"node_{e}"), F.log1p("degree").alias(f"log_degree_{e}")), f"node_{e}")
        return out

    removed, controls = _controls(spark, d)
    return _rounded(graph.balance(measured(removed), measured(controls), ["score", "log_degree_a", "log_degree_b"]))


def edit_features(spark: SparkSession, d: str) -> DataFrame:
    """Counts, degrees and cost of the edits by class."""
    return _rounded(graph.edit_features(_edits(spark, d), graph.edge_transitions(*_versions(spark, d)), _degrees(spark, d)))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    registry = load(spark, d, "baseline_anchor_registry", ["archive_id", "anchor_id", "baseline_degree_150"])
    return registry.filter("baseline_degree_150 > 0").select("archive_id", F.col("anchor_id").alias("node"), F.col("baseline_degree_150").cast("double").alias("evidence"))


def _strong_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).filter("score >= 700").select("archive_id", "node_a", "node_b")


def _propagated(spark: SparkSession, d: str, **steps) -> DataFrame:
    return graph.propagate(_strong_edges(spark, d), _evidence(spark, d), by=("archive_id",), **steps)


def propagation(spark: SparkSession, d: str) -> DataFrame:
    """Three damped steps from the registry's degrees over every archive's edges."""
    return _propagated(spark, d, iterations=3).withColumn("score", F.round("score", 9))


def propagation_converged(spark: SparkSession, d: str) -> DataFrame:
    """The fixed point of the propagation, to an L2 change under 1e-12 in every archive."""
    return _propagated(spark, d, iterations=10_000, every=10, tolerance=1e-12).withColumn("score", F.round("score", 9))


def propagation_certificate(spark: SparkSession, d: str) -> DataFrame:
    """How far three steps are from the fixed point, per archive."""
    return _rounded(graph.propagation_certificate(_strong_edges(spark, d), _evidence(spark, d), _propagated(spark, d, iterations=3), by=("archive_id",)))


def propagation_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Whether the ten proteins that lead after three steps are certain, per archive."""
    scores = cut_lineage(_propagated(spark, d, iterations=3))
    bounds = graph.propagation_certificate(_strong_edges(spark, d), _evidence(spark, d), scores, by=("archive_id",))
    return _rounded(graph.cutoff_certificate(scores, bounds, ["archive_id"], 10))


def identity_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Source targets of each release aligned with those of the next; crosswalk rows of one canonical id propose links."""
    rows = load(spark, d, "target_crosswalk", ["release_id", "source_target_id", "canonical_target_id", "stable_entity_eligible"])
    clean = rows.select("release_id", clean_target("source_target_id").alias("id"), F.nullif(clean_target("canonical_target_id"), F.lit("")).alias("c"), affirmative(F.col("stable_entity_eligible")).alias("s"))
    sides = cut_lineage(identity.with_release_pairs(clean, "release_id", releases(spark, d)))
    first, second = sides.filter("_side = 1"), sides.filter("_side = 2")
    kind = F.when(F.col("s"), "REPLACEMENT").otherwise("CROSS_REFERENCE")
    proposals = first.select("release_pair", F.col("id").alias("old_id"), "c").join(second.select("release_pair", F.col("id").alias("new_id"), "c", kind.alias("kind")), ["release_pair", "c"])
    return identity.align_identities(first, second, proposals.select("release_pair", "old_id", "new_id", "kind"), ("release_pair",))


def reference_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every form under which a disease id of the crosswalk may be cited, with the number of ids that share it."""
    rows = load(spark, d, "disease_crosswalk", ["source_disease_id"]).filter("source_disease_id is not null").distinct()
    return rows.select("source_disease_id", F.explode(identity.reference_forms(F.col("source_disease_id"))).alias("form")).groupBy("form").agg(F.count("*").alias("ids"))


def unique_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "target_crosswalk", ["source_approved_symbol", "canonical_target_id"])
    return identity.unique_inverse(rows.withColumn("canonical_target_id", F.nullif(clean_target("canonical_target_id"), F.lit(""))), "canonical_target_id", "source_approved_symbol")


QUERIES = {
    f.__name__: f
    for f in (canonical_edges, degree_registry, edge_transitions, threshold_decomposition, edit_classes, edit_burden, edited_graph, neighbour_change, matched_controls, control_balance, edit_features, propagation, propagation_converged, propagation_certificate, propagation_cutoff, identity_alignment, reference_forms, unique_inverse)
}

# The same in SQL.

_E = r"""edges AS (SELECT archive_id, least(protein1, protein2) a, greatest(protein1, protein2) b, max(combined_score) s, count(*) n, min(combined_score) = max(combined_score) same FROM protein_links
  WHERE regexp_full_match(protein1, '9606\.ENSP[0-9]{11}') AND regexp_full_match(protein2, '9606\.ENSP[0-9]{11}') AND combined_score BETWEEN 0 AND 1000 AND combined_score = floor(combined_score) AND protein1 <> protein2 GROUP BY 1, 2, 3),
ends AS (SELECT archive_id, a node, b other, s FROM edges UNION ALL SELECT archive_id, b, a, s FROM edges),
moves AS (SELECT a, b, max(s) FILTER (archive_id = 'arc000') o, max(s) FILTER (archive_id = 'arc001') n FROM edges GROUP BY 1, 2)"""
_EDITS = f"""{_E}, anchors AS (SELECT DISTINCT anchor_id FROM baseline_anchor_registry WHERE archive_id = 'arc000' AND cohort_20),
mods AS (SELECT anchor_id node, min(baseline_degree_stratum) m FROM baseline_anchor_registry WHERE archive_id = 'arc000' AND anchor_id IS NOT NULL GROUP BY 1),
edits AS (SELECT a, b, o, n, CASE WHEN coalesce(n >= 400, false) THEN 'ADDED' ELSE 'REMOVED' END edit, CASE WHEN a IN (FROM anchors) OR b IN (FROM anchors) THEN 'P' ELSE 'D' END || CASE WHEN ma.m = mb.m THEN 'W' ELSE 'B' END k
  FROM moves LEFT JOIN mods ma ON ma.node = a LEFT JOIN mods mb ON mb.node = b WHERE coalesce(o >= 400, false) <> coalesce(n >= 400, false))"""
_STEP = "r{1} AS (SELECT f.archive_id, f.node, f.deg, f.dd, f.q, dd * coalesce(x, 0) + (1 - dd) * q sc FROM fixed f LEFT JOIN (SELECT w.archive_id, w.other node, sum(sc / greatest(deg, 1)) x FROM ways w JOIN r{0} ON r{0}.node = w.node AND r{0}.archive_id = w.archive_id GROUP BY 1, 2) i ON i.node = f.node AND i.archive_id = f.archive_id)"
_SPREAD = f"""{_E}, ways AS (SELECT archive_id, node, other FROM ends WHERE s >= 700), deg0 AS (SELECT archive_id, node, count(*) deg FROM ways GROUP BY 1, 2), ev AS (SELECT archive_id, anchor_id node, sum(baseline_degree_150)::DOUBLE e FROM baseline_anchor_registry WHERE baseline_degree_150 > 0 GROUP BY 1, 2),
fixed AS (SELECT archive_id, node, coalesce(deg, 0) deg, coalesce(deg, 0) / (coalesce(deg, 0) + 3.0) dd, coalesce(e / (SELECT sum(e) FROM ev v WHERE v.archive_id = z.archive_id), 0) q FROM (SELECT archive_id, node, deg, e FROM deg0 FULL JOIN ev USING (archive_id, node)) z), r0 AS (SELECT archive_id, node, deg, dd, q, q sc FROM fixed), {_STEP.format(0, 1)}, {_STEP.format(1, 2)}, {_STEP.format(2, 3)}"""
_CERTIFIED = f"""{_SPREAD}, {_STEP.format(3, 4)}, res AS (SELECT r3.archive_id, sum(abs(r4.sc - r3.sc)) x FROM r3 JOIN r4 USING (archive_id, node) GROUP BY 1),
op AS (SELECT archive_id, max(v) v FROM (SELECT w.archive_id, w.node, avg(f.dd) v FROM ways w JOIN fixed f ON f.archive_id = w.archive_id AND f.node = w.other GROUP BY 1, 2) GROUP BY 1), cert AS (SELECT archive_id, x, coalesce(v, 0) v, x / (1 - coalesce(v, 0)) bound FROM res LEFT JOIN op USING (archive_id))"""
_DRAWN = f"""{_EDITS}, gone AS (SELECT a, b FROM edits WHERE edit = 'REMOVED'), kept AS (SELECT a, b FROM edges WHERE archive_id = 'arc000' AND s >= 400 EXCEPT SELECT a, b FROM gone),
need AS (SELECT coalesce(x.m, 'none') x, coalesce(y.m, 'none') y, count(*) k FROM gone LEFT JOIN mods x ON x.node = a LEFT JOIN mods y ON y.node = b GROUP BY 1, 2), ks AS (SELECT a, b, coalesce(x.m, 'none') x, coalesce(y.m, 'none') y FROM kept LEFT JOIN mods x ON x.node = a LEFT JOIN mods y ON y.node = b),
num AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY md5('0|' || a || '~' || b), a || '~' || b) no FROM ks), drawn AS (SELECT a, b FROM num JOIN need USING (x, y) WHERE no <= k)"""
_DEG = "deg AS (SELECT node, count(*) FILTER (s >= 400) g FROM ends WHERE archive_id = 'arc000' GROUP BY 1)"
_CLEAN = r"regexp_replace(upper(trim({})), '\.[0-9]+$', '')"

ORACLE = {
    "canonical_edges": f"WITH {_E} SELECT archive_id, a AS node_a, b AS node_b, s AS score, n AS rows, same AS agrees FROM edges",
    "degree_registry": f"""WITH {_E} SELECT archive_id, node, g150 AS degree_150, g400 AS degree_400, g700 AS degree_700, g150 >= 20 AS cohort_20, g150 >= 30 AS cohort_30, g150 >= 50 AS cohort_50,
CASE WHEN g150 < 20 THEN 'below_20' WHEN g150 < 50 THEN '20_to_49' WHEN g150 < 100 THEN '50_to_99' WHEN g150 < 500 THEN '100_to_499' ELSE '500_and_more' END AS stratum
FROM (SELECT archive_id, node, count(*) FILTER (s >= 150) g150, count(*) FILTER (s >= 400) g400, count(*) FILTER (s >= 700) g700 FROM ends GROUP BY 1, 2)""",
    "edge_transitions": f"WITH {_E} SELECT a AS node_a, b AS node_b, o AS old_score, n AS new_score FROM moves",
    "threshold_decomposition": f"""WITH {_E}, t AS (SELECT *, unnest([150, 400, 700]) threshold FROM moves), f AS (SELECT *, coalesce(o >= threshold, false) x, coalesce(n >= threshold, false) y FROM t)
SELECT threshold, count(*) FILTER (x) AS old_edges, count(*) FILTER (y) AS new_edges, count(*) FILTER (x AND y) AS common_edges, count(*) FILTER (x AND NOT y AND n IS NOT NULL) AS fell_below, count(*) FILTER (x AND n IS NULL) AS removed,
count(*) FILTER (y AND NOT x AND o IS NOT NULL) AS rose_above, count(*) FILTER (y AND o IS NULL) AS added, quantile_cont(abs(n - o), 0.5) FILTER (x AND y) AS median_common_change FROM f GROUP BY 1""",
    "edit_classes": f"WITH {_EDITS} SELECT a AS node_a, b AS node_b, edit, k AS edit_class FROM edits",
    "edit_burden": f"""WITH {_EDITS}, inc AS (SELECT node, count(*) e FROM (SELECT a node FROM edits UNION ALL SELECT b FROM edits) GROUP BY 1), deg AS (SELECT node, count(*) FILTER (s >= 400) g FROM ends WHERE archive_id = 'arc000' GROUP BY 1)
SELECT node, e AS edits, round(e / greatest(coalesce(g, 0), 1), 9) AS burden FROM inc LEFT JOIN deg USING (node)""",
    "edited_graph": f"""WITH {_EDITS}, base AS (SELECT a, b FROM edges WHERE archive_id = 'arc000' AND s >= 400) SELECT a AS node_a, b AS node_b FROM (SELECT * FROM base EXCEPT SELECT a, b FROM edits WHERE k LIKE 'P%' AND edit = 'REMOVED')
UNION SELECT a, b FROM edits WHERE k LIKE 'P%' AND edit = 'ADDED'""",
    "neighbour_change": f"""WITH {_E}, near AS (SELECT node, other, bool_or(archive_id = 'arc000') o, bool_or(archive_id = 'arc001') n FROM ends WHERE s >= 400 GROUP BY 1, 2)
SELECT node, count(*) FILTER (o) AS old_neighbours, count(*) FILTER (n) AS new_neighbours, count(*) FILTER (o AND n) AS common_neighbours, round(count(*) FILTER (o AND n) / count(*), 9) AS jaccard FROM near GROUP BY 1""",
    "matched_controls": f"WITH {_DRAWN} SELECT a AS node_a, b AS node_b FROM drawn",
    "control_balance": f"""WITH {_DRAWN}, {_DEG}, both_ AS (SELECT 1 t, a, b FROM gone UNION ALL SELECT 0, a, b FROM drawn), me AS (SELECT t, s, ln(1 + x.g) la, ln(1 + y.g) lb FROM both_ JOIN edges e ON e.archive_id = 'arc000' AND e.s >= 400 AND e.a = both_.a AND e.b = both_.b JOIN deg x ON x.node = both_.a JOIN deg y ON y.node = both_.b),
un AS (SELECT t, unnest(['score', 'log_degree_a', 'log_degree_b']) measure, unnest([s, la, lb]) v FROM me), st AS (SELECT measure, avg(v) FILTER (t = 1) m1, avg(v) FILTER (t = 0) m0, sqrt((var_samp(v) FILTER (t = 1) + var_samp(v) FILTER (t = 0)) / 2) sd FROM un GROUP BY 1),
sm AS (SELECT *, CASE WHEN sd > 0 THEN (m1 - m0) / sd WHEN m1 = m0 THEN 0 END x FROM st) SELECT measure, round(m1, 9) AS mean_treated, round(m0, 9) AS mean_controls, round(x, 9) AS difference, coalesce(abs(x) <= 0.1, false) AS balanced FROM sm""",
    "edit_features": f"""WITH {_EDITS}, {_DEG} SELECT k AS edit_class, count(*) FILTER (edit = 'ADDED') AS added_edges, count(*) FILTER (edit = 'REMOVED') AS removed_edges, avg((k LIKE '%B')::INT::DOUBLE) AS between_module_fraction,
round(avg((ln(1 + coalesce(x.g, 0)) + ln(1 + coalesce(y.g, 0))) / 2), 9) AS mean_end_log_degree, round(avg(CASE WHEN edit = 'ADDED' THEN 1000 - least(n, 800) ELSE least(o, 800) - 1000 END), 9) AS mean_cost_change, round(ln(1 + count(*)), 9) AS log_edit_count
FROM edits LEFT JOIN deg x ON x.node = a LEFT JOIN deg y ON y.node = b GROUP BY 1""",
    "propagation": f"WITH {_SPREAD} SELECT archive_id, node, round(sc, 9) AS score FROM r3",
    "propagation_certificate": f"WITH {_CERTIFIED} SELECT archive_id, round(x, 9) AS residual_l1, round(v, 9) AS operator_l1, round(bound, 9) AS error_bound FROM cert",
    "propagation_cutoff": f"""WITH {_CERTIFIED}, k AS (SELECT archive_id, sc, row_number() OVER (PARTITION BY archive_id ORDER BY sc DESC) no, count(*) OVER (PARTITION BY archive_id) q, count(*) OVER (PARTITION BY archive_id, sc) ties FROM r3),
g AS (SELECT archive_id, max(q) q, max(sc) FILTER (no = 10) - max(sc) FILTER (no = 11) gap, max(ties) FILTER (no = 10) t FROM k GROUP BY 1)
SELECT archive_id, q AS query_size, CASE WHEN q > 10 THEN round(gap, 9) END AS cutoff_gap, CASE WHEN q > 10 THEN t ELSE 0 END AS cutoff_tied, q <= 10 OR gap > 2 * bound AS certified FROM g JOIN cert USING (archive_id)""",
    "identity_alignment": f"""WITH rel AS (SELECT release_id r, lead(release_id) OVER (ORDER BY release_id) x FROM (SELECT DISTINCT release_id FROM association_support WHERE release_id IS NOT NULL)),
x AS (SELECT release_id r, {_CLEAN.format('source_target_id')} id, nullif({_CLEAN.format('canonical_target_id')}, '') c, coalesce(lower(trim(stable_entity_eligible)) IN ('true', '1'), false) s FROM target_crosswalk),
olds AS (SELECT DISTINCT rel.r || '_to_' || rel.x p, id FROM rel JOIN x ON x.r = rel.r WHERE rel.x IS NOT NULL AND id IS NOT NULL), news AS (SELECT DISTINCT rel.r || '_to_' || rel.x p, id FROM rel JOIN x ON x.r = rel.x WHERE id IS NOT NULL), exact AS (SELECT * FROM olds INTERSECT SELECT * FROM news),
prop AS (SELECT DISTINCT rel.r || '_to_' || rel.x p, a.id o, b.id n, CASE WHEN b.s THEN 2 ELSE 1 END k FROM rel JOIN x a ON a.r = rel.r JOIN x b ON b.r = rel.x AND a.c = b.c), open_ AS (SELECT * FROM prop WHERE (p, o) NOT IN (FROM exact) AND (p, n) NOT IN (FROM exact)),
links AS (SELECT DISTINCT p, o, n FROM open_ q WHERE k = (SELECT max(k) FROM open_ z WHERE z.o = q.o AND z.p = q.p)), deg AS (SELECT *, count(*) OVER (PARTITION BY p, o) od, count(*) OVER (PARTITION BY p, n) nd FROM links),
st AS (SELECT p, o, max(n) n, max(greatest(od, nd)) g FROM deg GROUP BY 1, 2)
SELECT olds.p AS release_pair, id AS old_id, CASE WHEN (olds.p, id) IN (FROM exact) THEN id WHEN g = 1 THEN n END AS new_id, CASE WHEN (olds.p, id) IN (FROM exact) THEN 'EXACT' WHEN g = 1 THEN 'MAPPED' WHEN g > 1 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS alignment FROM olds LEFT JOIN st ON o = id AND st.p = olds.p""",
    "reference_forms": r"""WITH ids AS (SELECT DISTINCT source_disease_id, trim(source_disease_id) i FROM disease_crosswalk WHERE source_disease_id IS NOT NULL),
forms AS (SELECT source_disease_id, unnest(list_distinct(list_filter([i, CASE WHEN contains(i, ':') THEN CASE WHEN upper(split_part(i, ':', 1)) = 'ORPHA' THEN 'Orphanet' ELSE split_part(i, ':', 1) END || '_' || regexp_extract(i, '^[^:]*:(.*)$', 1) END,
CASE WHEN contains(i, '/') THEN regexp_extract(i, '[^/]*$') END], lambda x: x IS NOT NULL AND x <> ''))) AS form FROM ids) SELECT form, count(*) AS ids FROM forms GROUP BY 1""",
    "unique_inverse": f"""SELECT source_approved_symbol, min(c) AS canonical_target_id FROM (SELECT DISTINCT source_approved_symbol, nullif({_CLEAN.format('canonical_target_id')}, '') c FROM target_crosswalk WHERE source_approved_symbol IS NOT NULL) GROUP BY 1 HAVING count(*) = 1""",
}
