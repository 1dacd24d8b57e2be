"""Undirected weighted graphs: canonical edges, degrees, edits between two versions, propagation."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelshift.functions.scalars import ratio, when_chain
from panelshift.operators.ordering import hash_numbered, with_quantiles
from panelshift.operators.panel import ladder
from panelshift.session import cut_lineage

THRESHOLDS = (150, 400, 700)
STRATA = ((20, "below_20"), (50, "20_to_49"), (100, "50_to_99"), (500, "100_to_499"))


def canonical_edges(links: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """One row per group and unordered pair: node_a < node_b, score (the greatest), rows, agrees (all rows say the same).

    Self links and rows with a NULL end or score are left out.
    """
    ends = links.filter((F.col(left) != F.col(right)) & F.col(score).isNotNull()).select(*by, F.least(left, right).alias("node_a"), F.greatest(left, right).alias("node_b"), F.col(score).alias("score"))
    return ends.groupBy(*by, "node_a", "node_b").agg(F.max("score").alias("score"), F.count("*").alias("rows"), (F.min("score") == F.max("score")).alias("agrees"))


def both_directions(edges: DataFrame, by: list[str], *keep: str) -> DataFrame:
    ways = F.array(F.struct(F.col("node_a").alias("node"), F.col("node_b").alias("neighbour")), F.struct(F.col("node_b").alias("node"), F.col("node_a").alias("neighbour")))
    return edges.select(*by, *keep, F.inline(ways))


def degree_registry(edges: DataFrame, by: list[str], cohorts: tuple[int, ...] = (20, 30, 50)) -> DataFrame:
    """Degrees at three thresholds, cohort flags and a stratum for every node; hubs are counted by partial sums."""
    sums = both_directions(edges, by, "score").groupBy(*by, "node").agg(*[F.count_if(F.col("score") >= t).alias(f"degree_{t}") for t in THRESHOLDS])
    degree = F.col(f"degree_{THRESHOLDS[0]}")
    stratum = when_chain(*[(degree < limit, name) for limit, name in STRATA], otherwise="500_and_more")
    return sums.withColumns({f"cohort_{c}": degree >= c for c in cohorts} | {"stratum": stratum})


def edge_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every edge of two versions with both scores (NULL where absent)."""
    ids = ["node_a", "node_b"]
    sides = old.select(*ids, F.col("score").alias("o"), F.lit(None).cast("double").alias("n")).unionByName(new.select(*ids, F.lit(None).cast("double").alias("o"), F.col("score").alias("n")))
    return sides.groupBy(*ids).agg(F.max("o").alias("old_score"), F.max("n").alias("new_score"))


def threshold_decomposition(transitions: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold: eligible edges before and after, common ones, and what became of the others: below the threshold or absent."""
    o, n = F.col("old_score"), F.col("new_score")
    each = transitions.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    before, after = F.coalesce(o >= F.col("threshold"), F.lit(False)), F.coalesce(n >= F.col("threshold"), F.lit(False))
    sums = each.groupBy("threshold").agg(
        F.count_if(before).alias("old_edges"), F.count_if(after).alias("new_edges"), F.count_if(before & after).alias("common_edges"),
        F.count_if(before & ~after & n.isNotNull()).alias("fell_below"), F.count_if(before & n.isNull()).alias("removed"),
        F.count_if(after & ~before & o.isNotNull()).alias("rose_above"), F.count_if(after & o.isNull()).alias("added"),
    )
    return with_quantiles(sums, each.select("threshold", F.when(before & after, F.abs(n - o)).alias("change")), ["threshold"], {"median_common_change": ("change", 0.5)})


def edit_classes(transitions: DataFrame, anchors: DataFrame, modules: DataFrame, threshold: float) -> DataFrame:
    """Edited edges with direction (ADDED, REMOVED) and a class: P or D (touches an anchor or not), then W or B (within one module or between two).

    `anchors` has `node`, `modules` has node and module; a node without a module is in none, so its edges are between.
    """
    before, after = F.coalesce(F.col("old_score") >= threshold, F.lit(False)), F.coalesce(F.col("new_score") >= threshold, F.lit(False))
    edits = transitions.filter(before != after).select("node_a", "node_b", F.when(after, "ADDED").otherwise("REMOVED").alias("edit"))
    named = anchors.select("node").distinct().withColumn("_p", F.lit(True))
    one = modules.groupBy("node").agg(F.min("module").alias("module"))
    for end in ("a", "b"):
        edits = edits.join(named.select(F.col("node").alias(f"node_{end}"), F.col("_p").alias(f"_p{end}")), f"node_{end}", "left").join(one.select(F.col("node").alias(f"node_{end}"), F.col("module").alias(f"_m{end}")), f"node_{end}", "left")
    first = F.when(F.coalesce("_pa", "_pb").isNotNull(), "P").otherwise("D")
    second = F.when(F.coalesce(F.col("_ma") == F.col("_mb"), F.lit(False)), "W").otherwise("B")
    return edits.select("node_a", "node_b", "edit", F.concat(first, second).alias("edit_class"))


def apply_edits(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges without the removed ones and with the added ones (node_a, node_b)."""
    ids = ["node_a", "node_b"]
    removed, added = (edits.filter(F.col("edit") == e).select(*ids) for e in ("REMOVED", "ADDED"))
    return edges.select(*ids).join(removed, ids, "left_anti").unionByName(added).distinct()


def edit_burden(edits: DataFrame, degrees: DataFrame) -> DataFrame:
    """Per node: incident edits over its degree (at least 1)."""
    incident = both_directions(edits, []).groupBy("node").agg(F.count("*").alias("edits"))
    return incident.join(degrees.select("node", "degree"), "node", "left").select("node", "edits", (F.col("edits") / F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1))).alias("burden"))


def matched_controls(candidates: DataFrame, wanted: DataFrame, strata: list[str], item: str, seed: int = 0) -> DataFrame:
    """As many candidates of each stratum as `wanted` has rows there, by the order of a seeded hash; fewer where there are not enough."""
    need = wanted.groupBy(*strata).agg(F.count("*").alias("_need"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string")))
    return hash_numbered(candidates.join(need, strata), strata, digest, item, "_no").filter("_no <= _need").drop("_no", "_need")


def _recurrence(edges: DataFrame, evidence: DataFrame, by: list[str], smoothing: float) -> tuple[DataFrame, DataFrame]:
    """Nodes with degree, damping d and evidence share q, and the directed ways, both stored."""
    ways = both_directions(edges, by)
    degree = ways.groupBy(*by, "node").agg(F.count("*").alias("degree"))
    given = evidence.groupBy(*by, "node").agg(F.sum("evidence").alias("evidence"))
    total = given.groupBy(*by).agg(F.sum("evidence").alias("_total"))
    both = degree.join(given, [*by, "node"], "full")
    nodes = (both.join(F.broadcast(total), by, "left") if by else both.crossJoin(F.broadcast(total))).select(  # a row per graph
        *by, "node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce(ratio(F.col("evidence"), F.col("_total")), F.lit(0.0)).alias("q")
    )
    return cut_lineage(nodes.withColumn("d", F.col("degree") / (F.col("degree") + smoothing))), cut_lineage(ways)


def _step(state: DataFrame, ways: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, _in): what each node gets from its neighbours."""
    given = state.select(*by, "node", (F.col("score") / F.greatest("degree", F.lit(1))).alias("_x"))
    return ways.join(given, [*by, "node"]).groupBy(*by, F.col("neighbour").alias("node")).agg(F.sum("_x").alias("_in"))


def propagate(edges: DataFrame, evidence: DataFrame, smoothing: float = 3.0, iterations: int = 10, every: int = 5, tolerance: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Damped propagation r <- d * (P r) + (1 - d) * q on unweighted graphs, one for each value of `by`, started at q.

    P passes a node's value in equal parts to its neighbours; d is degree / (degree + smoothing); q is evidence over its sum (isolated and
    unknown nodes have evidence 0). One join and one sum per iteration; the lineage is cut every few iterations. With a
    tolerance, it ends at the first cut where the last step's L2 change is under it in every graph; `iterations` steps without that are an
    error. Columns: by, node, score.
    """
    ids = [*by, "node"]
    fixed, ways = _recurrence(edges, evidence, list(by), smoothing)
    state = fixed.withColumn("score", F.col("q"))
    for i in range(1, iterations + 1):
        new = F.col("d") * F.coalesce("_in", F.lit(0.0)) + (1 - F.col("d")) * F.col("q")
        # only a step whose change is measured needs the score before it
        old = state.select(*ids, "degree", "d", "q", F.col("score").alias("before")) if tolerance is not None and i % every == 0 else fixed.withColumn("before", F.lit(None).cast("double"))
        state = old.join(_step(state, ways, list(by)), ids, "left").select(*ids, "degree", "d", "q", new.alias("score"), "before")
        if i % every == 0 and (i < iterations or tolerance is not None):
            state = cut_lineage(state)
            if tolerance is not None:
                changes = state.groupBy(*by).agg(F.sum((F.col("score") - F.col("before")) ** 2).alias("_c"))
                if sqrt(changes.agg(F.max("_c")).first()[0] or 0.0) < tolerance:
                    return state.select(*ids, "score")
    if tolerance is not None:
        raise ArithmeticError(f"no convergence to {tolerance} in {iterations} steps")
    return state.select(*ids, "score")


def propagation_certificate(edges: DataFrame, evidence: DataFrame, scores: DataFrame, smoothing: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """How far scores can be from the fixed point of `propagate`, per graph: residual_l1, operator_l1 (the largest share that a node passes on after damping), error_bound.

    One step of the recurrence gives the residual; the L1 distance to the fixed point is at most residual_l1 / (1 - operator_l1). Rounding is not counted.
    """
    ids = [*by, "node"]
    fixed, ways = _recurrence(edges, evidence, list(by), smoothing)
    state = fixed.join(scores.select(*ids, "score"), ids, "left").fillna(0.0, ["score"])
    new = F.col("d") * F.coalesce("_in", F.lit(0.0)) + (1 - F.col("d")) * F.col("q")
    residual = state.join(_step(state, ways, list(by)), ids, "left").groupBy(*by).agg(F.sum(F.abs(new - F.col("score"))).alias("residual_l1"))
    received = ways.join(fixed.select(*by, F.col("node").alias("neighbour"), F.col("d").alias("_d")), [*by, "neighbour"]).groupBy(*ids).agg(F.avg("_d").alias("_share"))
    operator = received.groupBy(*by).agg(F.max("_share").alias("operator_l1"))
    both = residual.join(operator, list(by), "left") if by else residual.crossJoin(operator)  # a row per graph
    whole = both.fillna(0.0, ["operator_l1"])
    return whole.withColumn("error_bound", F.col("residual_l1") / (1 - F.col("operator_l1")))


def cutoff_certificate(scores: DataFrame, bounds: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Whether the first `budget` nodes by score are certain: the gap to the next score exceeds twice the error bound, or there is no next one.

    Columns: by, query_size, cutoff_gap (NULL without a next one), cutoff_tied, certified.
    """
    steps = ladder(scores, by, "score")
    at = F.max(F.when(F.col("above") < budget, F.struct((-F.col("score")).alias("s"), F.col("ties").alias("t"), (F.col("above") + F.col("ties")).alias("reach"))))
    sums = steps.groupBy(*by).agg(F.max("members").alias("query_size"), at.alias("_at"), F.max(F.when(F.col("above") >= budget, F.col("score"))).alias("_next"))
    complete = F.col("query_size") <= budget
    gap = F.when(~complete, F.when(F.col("_at.reach") > budget, 0.0).otherwise(-F.col("_at.s") - F.col("_next")))
    return sums.join(bounds.select(*by, "error_bound"), by).select(
        *by, "query_size", gap.alias("cutoff_gap"), F.when(complete, 0).otherwise(F.col("_at.t")).cast("long").alias("cutoff_tied"), (complete | (gap > 2 * F.col("error_bound"))).alias("certified")
    )


def edit_features(edits: DataFrame, transitions: DataFrame, degrees: DataFrame, cap: float = 800.0) -> DataFrame:
    """Per edit class: added and removed edges, share between modules, mean log degree of the ends, mean change of cost (1000 less the capped score), log of the count."""
    ends = edits.join(transitions, ["node_a", "node_b"])
    for e in ("a", "b"):
        ends = ends.join(degrees.select(F.col("node").alias(f"node_{e}"), F.col("degree").alias(f"_g{e}")), f"node_{e}", "left")
    cost = F.when(F.col("edit") == "ADDED", 1000 - F.least("new_score", F.lit(cap))).otherwise(F.least("old_score", F.lit(cap)) - 1000)
    log_degree = (F.log1p(F.coalesce("_ga", F.lit(0))) + F.log1p(F.coalesce("_gb", F.lit(0)))) / 2
    return ends.groupBy("edit_class").agg(
        F.count_if(F.col("edit") == "ADDED").alias("added_edges"), F.count_if(F.col("edit") == "REMOVED").alias("removed_edges"), F.avg(F.col("edit_class").endswith("B").cast("double")).alias("between_module_fraction"),
        F.avg(log_degree).alias("mean_end_log_degree"), F.avg(cost).alias("mean_cost_change"), F.log1p(F.count("*").cast("double")).alias("log_edit_count"),
    )


def balance(treated: DataFrame, controls: DataFrame, measures: list[str], limit: float = 0.1) -> DataFrame:
    """Per measure: both means, the standardised mean difference (over the root of the mean variance) and whether it is within the limit; equal constants differ by 0."""
    sides = treated.select(F.lit(1).alias("_t"), *measures).unionByName(controls.select(F.lit(0).alias("_t"), *measures))
    each = sides.select("_t", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])))
    sums = each.groupBy("measure").agg(*[f(F.when(F.col("_t") == t, F.col("x"))).alias(f"{n}_{s}") for t, s in ((1, "treated"), (0, "controls")) for f, n in ((F.avg, "mean"), (F.var_samp, "variance"))])
    scale = F.sqrt((F.col("variance_treated") + F.col("variance_controls")) / 2)
    difference = F.col("mean_treated") - F.col("mean_controls")
    smd = F.when(scale > 0, difference / scale).otherwise(F.when(difference == 0, 0.0))
    return sums.select("measure", "mean_treated", "mean_controls", smd.alias("difference"), F.coalesce(F.abs(smd) <= limit, F.lit(False)).alias("balanced"))


def neighbour_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per node: neighbours before and after, common ones, and the Jaccard index of the two neighbourhoods."""
    ids = ["node", "neighbour"]
    sides = both_directions(old, []).select(*ids, F.lit(1).alias("s")).unionByName(both_directions(new, []).select(*ids, F.lit(2).alias("s")))
    each = sides.groupBy(*ids).agg(F.bool_or(F.col("s") == 1).alias("o"), F.bool_or(F.col("s") == 2).alias("n"))
    sums = each.groupBy("node").agg(F.count_if("o").alias("old_neighbours"), F.count_if("n").alias("new_neighbours"), F.count_if(F.col("o") & F.col("n")).alias("common_neighbours"))
    return sums.withColumn("jaccard", ratio(F.col("common_neighbours"), F.col("old_neighbours") + F.col("new_neighbours") - F.col("common_neighbours")))
