"""Agreement of two rankings of the same members: Pearson, Spearman, Kendall's tau-b and rank-biased overlap.

Pearson and Spearman need sums only. Tau-b counts pairs of (old, new) cells, equal score pairs with their number, digit by digit of their
places on the two ladders: groups that agree in the higher digits hold a bounded number of cells, so no panel is ever compared within one
task, and ties count for nothing before they are compared.
Rank-biased overlap needs, for each depth, what both rankings have reached. All take members with both ladders
(`panel.both_ladders`), which are worth storing when several are wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshift.operators.ordering import joined_on
from panelshift.operators.panel import average_rank

#: Base of the digits in which steps are compared; a group has at most FAN x FAN cells.
FAN = 1024


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient as an aggregate; NULL for fewer than two rows or without variance."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    covariance = n * F.sum(x * y) - sx * sy
    scale = (n * F.sum(x * x) - sx * sx) * (n * F.sum(y * y) - sy * sy)
    return F.when(scale > 0, covariance / F.sqrt(F.greatest(scale, F.lit(0.0))))


def spearman(ranked: DataFrame, panel: list[str]) -> DataFrame:
    """Spearman's coefficient per panel, from members with both ladders; twice the ranks are whole numbers, so all sums are exact."""
    places = ranked.select(*panel, (2 * average_rank("old_")).cast("decimal(20,0)").alias("x"), (2 * average_rank("new_")).cast("decimal(20,0)").alias("y"))
    n = F.count("*").cast("double")
    sx, sy, sxy, sxx, syy = (F.sum(c).cast("double") for c in (F.col("x"), F.col("y"), F.col("x") * F.col("y"), F.col("x") * F.col("x"), F.col("y") * F.col("y")))
    scale = (n * sxx - sx * sx) * (n * syy - sy * sy)
    return places.groupBy(*panel).agg(F.count("*").alias("members"), F.when(scale > 0, (n * sxy - sx * sy) / F.sqrt(F.greatest(scale, F.lit(0.0)))).alias("spearman"))


def _excess(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Concordant minus discordant pairs among weighted points, from the cumulative sums of their table of counts; equal coordinates count for nothing."""
    rows, at_x = np.unique(x, return_inverse=True)
    columns, at_y = np.unique(y, return_inverse=True)
    if len(rows) < 2 or len(columns) < 2:
        return 0
    table = np.zeros((len(rows), len(columns)), np.int64)
    np.add.at(table, (at_x, at_y), w)
    below = np.zeros((len(rows), len(columns) + 1), np.int64)  # points of lesser rows by columns up to each
    below[1:, 1:] = table.cumsum(0)[:-1].cumsum(1)
    return int((table * (below[:, :-1] + below[:, 1:] - below[:, -1:])).sum())


def kendall_tau_b(ranked: DataFrame, panel: list[str], fan: int = FAN) -> DataFrame:
    """Tau-b per panel, from members with both ladders, corrected for ties on either side; NULL for fewer than two members or when one side is constant.

    Members are merged to cells (old step, new step, number). Two cells differ in both steps, or the pair counts for nothing. The steps,
    written to the base `fan`, agree from some digit on; the first digits from the top that differ, one for each score, give the pair's sign. So for
    every pair of digit places, cells are merged by what is left of the steps from there on, and pairs are counted within groups that agree
    above: at most fan x fan cells each, whatever the panel.
    """
    tied = [F.sum(F.col(f"{side}_ties") - 1) / 2 for side in ("old", "new")]
    counts = ranked.groupBy(*panel).agg(F.count("*").alias("members"), *[t.alias(n) for t, n in zip(tied, ("_tx", "_ty"))], F.max("old_step").alias("_sx"), F.max("new_step").alias("_sy"))
    cells = ranked.groupBy(*panel, F.col("old_step").alias("x"), F.col("new_step").alias("y")).agg(F.count("*").alias("w"))
    places = F.ceil(F.log(F.greatest("_sx", "_sy") + 1) / F.log(F.lit(float(fan)))).cast("int")
    several = counts.filter((F.col("_sx") > 1) & (F.col("_sy") > 1)).select(*panel, F.greatest(F.lit(1), places).alias("_places"))
    digits = F.sequence(F.lit(0), F.col("_places") - 1)
    power = F.pow(F.lit(float(fan)), F.col("_i")).cast("long"), F.pow(F.lit(float(fan)), F.col("_j")).cast("long")
    rest = [F.floor(F.col(c) / p) for c, p in zip("xy", power)]
    levels = joined_on(cells, several, panel, "inner").withColumn("_i", F.explode(digits)).withColumn("_j", F.explode(digits))
    merged = levels.groupBy(*panel, "_i", "_j", rest[0].alias("x"), rest[1].alias("y")).agg(F.sum("w").alias("w"))
    grouped = merged.withColumns({"_x": F.floor(F.col("x") / fan), "_y": F.floor(F.col("y") / fan)})
    excess = _per_group(grouped, panel, [*panel, "_i", "_j", "_x", "_y"]).groupBy(*panel).agg(F.sum("excess").alias("excess"))
    pairs = F.col("members") * (F.col("members") - 1) / 2
    scale = (pairs - F.col("_tx")) * (pairs - F.col("_ty"))
    return joined_on(counts, excess, panel).select(*panel, "members", F.when(scale > 0, F.coalesce("excess", F.lit(0)) / F.sqrt(scale)).alias("tau_b"))


def _per_group(points: DataFrame, panel: list[str], keys: list[str]) -> DataFrame:
    """(panel, excess) of every group of `keys` with at least two points; groups arrive whole and in turn, many to a task."""
    group = F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))])
    ordered = points.withColumn("_group", group).repartition("_group").sortWithinPartitions("_group").select(*panel, "x", "y", "w", "_group")
    schema = ordered.select(*panel).schema.add("excess", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            ids = table.column("_group").to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1))
            yield from finished(table, starts, np.append(starts[1:], len(ids))[:-1])
            held = table.slice(int(starts[-1])).combine_chunks().to_batches()[0]  # the last group may go on
        if held is not None:
            table = pa.Table.from_batches([held])
            yield from finished(table, np.zeros(1, int), np.array([table.num_rows]))

    def finished(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = starts[: len(ends)]
        several = ends - starts > 1
        starts, ends = starts[several], ends[several]
        if len(starts):
            x, y, w = (table.column(c).to_numpy() for c in ("x", "y", "w"))
            total = pa.array([_excess(x[a:b], y[a:b], w[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())
            rows = table.select(panel).take(pa.array(starts)).append_column("excess", total)
            yield from rows.cast(rows.schema).combine_chunks().to_batches()

    return ordered.mapInArrow(count, schema)


def rank_biased_overlap(ranked: DataFrame, panel: list[str], persistence: float = 0.9) -> DataFrame:
    """Rank-biased overlap per panel of two rankings of the same members; tied members all stand at the first of their places.

    This is the extrapolated value of variant w of `overlap_bounds`.
    """
    bounds = overlap_bounds(ranked, panel, (persistence,), ("w",))
    return bounds.select(*panel, F.col("extrapolated").alias("rbo"))


def overlap_bounds(ranked: DataFrame, panel: list[str], persistence: tuple[float, ...] = (0.9, 0.8, 0.95), variants: tuple[str, ...] = ("w", "b")) -> DataFrame:
    """Rank-biased overlap with its bounds: panel, variant, persistence, least, most, extrapolated, residual (most minus least).

    Variant w counts a tied member as reached at the first of its places, and compares twice the common members with the sum of both sides;
    variant b lets it come in evenly over its places, and divides the common product by the root of the sums of squares. Beyond the members,
    the least value takes none of what is unseen to agree, the most takes all. Depths at which persistence^depth is under 1e-18 weigh
    nothing and are left out, so only the head of a panel counts: members that stand at the same places on both sides are merged first, which leaves
    a number of rows bounded by the depth.
    """
    deepest = max(math.ceil(math.log(1e-18) / math.log(p)) for p in persistence)
    o, n = F.col("old_above"), F.col("new_above")
    size = F.least(F.col("_m"), F.lit(deepest))

    def reached(above: Column, ties: Column) -> Column:
        """What a member counts at `depth` in variant b."""
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("depth") - above) / ties))

    common = ranked.filter(F.greatest(o, n) < deepest).groupBy(*panel, "old_above", "old_ties", "new_above", "new_ties").agg(F.count("*").cast("double").alias("_k"), F.first("old_members").alias("_m"))
    sides = F.array(F.struct(F.lit(1).alias("_side"), o.alias("_a"), F.col("old_ties").alias("_t")), F.struct(F.lit(2).alias("_side"), n.alias("_a"), F.col("new_ties").alias("_t")))
    alone = ranked.select(*panel, F.col("old_members").alias("_m"), F.inline(sides)).filter(F.col("_a") < deepest).groupBy(*panel, "_side", "_a", "_t").agg(F.count("*").cast("double").alias("_k"), F.first("_m").alias("_m"))
    at_common = common.withColumn("depth", F.explode(F.sequence((F.greatest(o, n) + 1).cast("int"), size.cast("int")))).select(
        *panel, "depth", "_m", F.lit(0).alias("_side"), F.col("_k").alias("_w"), (F.col("_k") * reached(o, F.col("old_ties")) * reached(n, F.col("new_ties"))).alias("_b")
    )
    share = reached(F.col("_a"), F.col("_t"))
    at_alone = alone.withColumn("depth", F.explode(F.sequence((F.col("_a") + 1).cast("int"), size.cast("int")))).select(*panel, "depth", "_m", "_side", F.col("_k").alias("_w"), (F.col("_k") * share * share).alias("_b"))
    sums = [F.coalesce(F.sum(F.when(F.col("_side") == i, F.col(c))), F.lit(0.0)).alias(f"{c}{i}") for c in ("_w", "_b") for i in range(3)]
    depths = at_common.unionByName(at_alone).groupBy(*panel, "depth", "_m").agg(*sums)
    agreement = {"w": 2 * F.col("_w0") / (F.col("_w1") + F.col("_w2")), "b": F.col("_b0") / F.sqrt(F.col("_b1") * F.col("_b2"))}
    cases = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(p).alias("persistence"), agreement[v].alias("_agree")) for v in variants for p in persistence])
    p = F.col("persistence")
    seen = depths.select(*panel, "depth", "_m", F.inline(cases)).groupBy(*panel, "_m", "variant", "persistence").agg(F.sum(F.col("_agree") * F.pow(p, "depth")).alias("_seen"))
    factor = (1 - p) / p
    unseen = F.aggregate(F.sequence(F.col("_m") + 1, F.col("_m") + deepest), F.lit(0.0), lambda total, depth: total + F.pow(F.col("persistence"), depth) / depth)
    least, most = factor * (F.col("_seen") + F.col("_m") * unseen), factor * (F.col("_seen") + F.pow(p, F.col("_m") + 1) / (1 - p))
    return seen.select(*panel, "variant", "persistence", least.alias("least"), most.alias("most"), most.alias("extrapolated"), (most - least).alias("residual"))
