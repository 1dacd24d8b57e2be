"""Brute-force checks of panel, allocation, resampling, graph and identity operators on small tables."""

import hashlib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelshift.operators import allocation, evaluation, graph, identity, ordering, panel, rank_correlation, resampling, revision, support
from panelshift.plans import graph_queries, release_queries
from panelshift.sources import sinks, tables


def test_fractional_allocation(spark):
    items = spark.createDataFrame([("p", i, s) for i, s in enumerate([5.0, 5.0, 3.0, 3.0, 3.0, 1.0, None])], "p string, i int, s double")
    third = Fraction(1, 3)
    for k, expected in ((1, [Fraction(1, 2)] * 2), (3, [1, 1, third, third, third]), (4, [1, 1, 2 * third, 2 * third, 2 * third]), (10, [1] * 6)):
        got = {r["i"]: Fraction(r["num"], r["den"]) for r in allocation.allocate(items, ["p"], "s", k).collect()}
        assert [got.get(i, 0) for i in range(len(expected))] == expected and sum(got.values()) == min(k, 6)


def ranked(values):
    return [1 + sum(w > v for w in values) + (values.count(v) - 1) / 2 for v in values]


def pearson(x, y):
    x, y = np.array(x) - np.mean(x), np.array(y) - np.mean(y)
    scale = math.sqrt((x @ x) * (y @ y))
    return None if scale == 0 else float(x @ y) / scale


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_rank_agreement(spark, block):
    random.seed(block)
    panels = {p: [(random.randint(0, 6) / 8, random.randint(0, 6) / 8) for _ in range(n)] for p, n in (("a", 40), ("b", 3), ("c", 1), ("d", 25))}
    panels["same"] = [(0.5, i / 4) for i in range(4)]
    df = spark.createDataFrame([(p, i, o, n) for p, rows in panels.items() for i, (o, n) in enumerate(rows)], "p string, i int, old_score double, new_score double")
    ranked_rows = panel.both_ladders(df, ["p"]).cache()
    tau = {r["p"]: r["tau_b"] for r in rank_correlation.kendall_tau_b(ranked_rows, ["p"], block).collect()}
    rho = {r["p"]: r["spearman"] for r in rank_correlation.spearman(ranked_rows, ["p"]).collect()}
    rbo = {r["p"]: r["rbo"] for r in rank_correlation.rank_biased_overlap(ranked_rows, ["p"]).collect()}
    for p, rows in panels.items():
        x, y = zip(*rows)
        pairs = list(itertools.combinations(range(len(rows)), 2))
        sign = lambda v, i, j: (v[i] > v[j]) - (v[i] < v[j])
        scale = math.sqrt(sum(x[i] != x[j] for i, j in pairs) * sum(y[i] != y[j] for i, j in pairs))
        assert tau[p] == (pytest.approx(sum(sign(x, i, j) * sign(y, i, j) for i, j in pairs) / scale) if scale else None)
        expected = pearson(ranked(x), ranked(y)) if len(rows) > 1 else None
        assert rho[p] == (pytest.approx(expected) if expected is not None else None)
        first = [[1 + sum(w > v for w in s) for v in s] for s in (x, y)]
        overlap = 0.0
        for depth in range(1, 400):
            a, b = ({i for i, f in enumerate(s) if f <= depth} for s in first)
            overlap += 0.1 * 0.9 ** (depth - 1) * 2 * len(a & b) / (len(a) + len(b))
        assert rbo[p] == pytest.approx(overlap, abs=1e-9)


def test_tau_of_a_large_panel(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("hot").alias("p"), (F.col("id") / n).alias("old_score"), F.lit(0.5).alias("new_score"))
    assert rank_correlation.kendall_tau_b(panel.both_ladders(df, ["p"]), ["p"]).first()["tau_b"] is None
    turned = df.withColumn("new_score", F.when(F.col("old_score") < 0.5, F.col("old_score") + 0.5).otherwise(F.col("old_score") - 0.5))  # halves swapped
    assert rank_correlation.kendall_tau_b(panel.both_ladders(turned, ["p"]), ["p"]).first()["tau_b"] == pytest.approx(1 - 2 * (n / 2) ** 2 / (n * (n - 1) / 2))


def test_exact_quantiles(spark):
    random.seed(9)
    data = [(g, random.choice([None, float("nan"), -0.0, 1.0, 1e-12, -3.5, random.gauss(0, 1e3), random.random()]), random.random()) for g in ("a", "b", None) for _ in range(200)] + [("none", None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(5).withColumns({"_c": F.lit("clash"), "_n": F.lit(0)})
    wanted = {"low": ("v", 0.0), "mid": ("v", 0.5), "q": ("v", 0.37), "w_high": ("w", 0.99)}
    got = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], wanted).collect()}
    for g in ("a", "b", None, "none"):
        for out, (column, level) in wanted.items():
            values = [r[1 if column == "v" else 2] for r in data if r[0] == g]
            values = [v for v in values if v is not None and v == v]
            assert got[g][out] == (pytest.approx(float(np.quantile(values, level)), rel=1e-12) if values else None)
    assert ordering.exact_quantiles(df.limit(0), ["g"], wanted).count() == 0


def test_ladder_equals_counting(spark):
    random.seed(5)
    data = [(p, random.choice([None, 0.0, 0.5, random.random(), random.random() * 1e-9, -random.random()])) for p in ("a", "b", None) for _ in range(80)]
    got = {(r["p"], r["s"]): (r["ties"], r["above"], r["members"], r["step"]) for r in panel.ladder(spark.createDataFrame(data, "p string, s double"), ["p"], "s").collect()}
    for p in ("a", "b", None):
        own = [s for q, s in data if q == p and s is not None]
        assert {s: got[p, s] for s in set(own)} == {s: (own.count(s), sum(x > s for x in own), len(own), 1 + len({x for x in own if x > s})) for s in set(own)}


def test_top_sets_are_null_when_too_small(spark):
    df = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(4)], "p string, i int, old_score double, new_score double")
    got = {r["cutoff"]: r for r in panel.top_set_comparison(df, ["p"], (2, 5)).collect()}
    assert (got[0]["old_size"], got[0]["new_size"], got[0]["jaccard"]) == (4, 1, 0.25)
    assert (got[2]["old_size"], got[2]["new_size"], got[2]["changed"]) == (4, 2, True)
    assert got[5]["old_size"] is None and got[5]["jaccard"] is None and got[5]["changed"] is None


def test_bounds_hold_for_every_labelling(spark):
    random.seed(1)
    data = [(g, random.choice([-1.0, 0.5, 1.5]), random.choice([0, 1, None])) for g in "ab" for _ in range(7)]
    got = {r["g"]: r for r in allocation.label_bounds(spark.createDataFrame(data, "g string, weight double, label int"), ["g"]).collect()}
    for g in "ab":
        mine = [(w, x) for k, w, x in data if k == g]
        sums = [sum(w * c for (w, _), c in zip(mine, labels)) for labels in itertools.product((0, 1), repeat=len(mine)) if all(x is None or x == c for (_, x), c in zip(mine, labels))]
        assert (got[g]["lower"], got[g]["upper"]) == (pytest.approx(min(sums)), pytest.approx(max(sums)))


def test_donor_means_are_null_with_a_gap(spark):
    df = spark.createDataFrame([("x", "d1", 1, 1.0), ("x", "d1", 2, 3.0), ("x", "d2", 3, 5.0), ("y", "d1", 1, None), ("y", "d2", 2, 1.0)], "g string, donor string, model int, v double")
    got = {r["g"]: (r["donors"], r["v"]) for r in allocation.donor_reduction(df, "donor", "model", ["g"], ["v"]).collect()}
    assert got == {"x": (2, 3.5), "y": (2, None)}


def test_nondominated(spark):
    random.seed(2)
    points = [("g", i, float(random.randint(0, 5)), float(random.randint(0, 5))) for i in range(40)]
    got = {r["i"] for r in allocation.nondominated(spark.createDataFrame(points, "g string, i int, b double, c double"), ["g"], "b", "c").collect()}
    assert got == {i for _, i, b, c in points if not any(b2 >= b and c2 <= c and (b2 > b or c2 < c) for _, _, b2, c2 in points)}


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("g", 3.0, 1.0), ("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", None, 9.0), ("g", 9.0, 0.0)], "g string, v double, w double")
    assert tuple(revision.weighted_quantile(df, ["g"], "v", "w", {"a": 0.25, "b": 0.5, "c": 0.76}).first()) == ("g", 1.0, 2.0, 3.0)


def test_plans(spark):
    units = spark.createDataFrame([("g", i, float(i)) for i in range(6)], "g string, u int, v double")
    hashed = resampling.hashed_plan(units, "u", ["g"], 50)
    assert {r["n"] for r in hashed.groupBy("draw").agg(F.sum("times").alias("n")).collect()} == {6}
    draws = resampling.draw_means(units, hashed, ["g"], "u", ["v"])
    band = resampling.simultaneous_band(units, draws, ["g"], ["v"]).first()
    ends = resampling.percentile_intervals(units, draws, ["g"], ["v"]).first()
    assert ends["lower"] <= ends["estimate"] == band["estimate"] <= ends["upper"] and band["lower"] < 2.5 < band["upper"]


def test_propagation_reaches_its_fixed_point(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "node_a string, node_b string")
    evidence = spark.createDataFrame([("a", 3.0), ("d", 1.0), ("lone", 4.0)], "node string, evidence double")
    got = {r["node"]: r["score"] for r in graph.propagate(edges, evidence, iterations=60, every=20).collect()}
    names = ["a", "b", "c", "d", "lone"]
    links = np.zeros((5, 5))
    for x, y in [(0, 1), (1, 2), (2, 3), (0, 2)]:
        links[x, y] = links[y, x] = 1
    degree = links.sum(0)
    p, d, q = links / np.maximum(degree, 1), degree / (degree + 3), np.array([3, 0, 0, 1, 4]) / 8
    fixed = np.linalg.solve(np.eye(5) - np.diag(d) @ p, (1 - d) * q)
    assert [got[n] for n in names] == pytest.approx(list(fixed))


def test_propagation_stops_when_converged(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "node_a string, node_b string")
    evidence = spark.createDataFrame([("a", 3.0), ("lone", 1.0)], "node string, evidence double")
    got = {r["node"]: r["score"] for r in graph.propagate(edges, evidence, iterations=10_000, tolerance=1e-12).collect()}
    p, d, q = (np.ones((3, 3)) - np.eye(3)) / 2, 2 / 5, np.array([3, 0, 0]) / 4
    fixed = np.linalg.solve(np.eye(3) - d * p, (1 - d) * q)
    assert [got[n] for n in ("a", "b", "c", "lone")] == pytest.approx([*fixed, 0.25], abs=1e-12)
    with pytest.raises(ArithmeticError):
        graph.propagate(edges, evidence, iterations=5, tolerance=1e-12)


def test_intervals_take_2000_draws(spark):
    found = release_queries.change_intervals(spark, "/root/testdata/sf0.001")
    assert {r["draws"] for r in found.select("draws").collect()} == {2000}


def test_every_release_pair_and_span_is_there(spark):
    folder = "/root/testdata/sf0.001"
    names = release_queries.releases(spark, folder)
    pairs = [f"{a}_to_{b}" for a, b in zip(names, names[1:])]

    parts = release_queries.membership_partition(spark, folder)
    assert sorted(r[0] for r in parts.select("release_pair").distinct().collect()) == pairs
    links = graph_queries.identity_alignment(spark, folder)
    assert sorted(r[0] for r in links.select("release_pair").distinct().collect()) == pairs
    walks = release_queries.trajectory_summary(spark, folder)
    assert sorted(r[0] for r in walks.select("release_span").distinct().collect()) == ["_to_".join(x) for x in zip(names, names[1:], names[2:])]


def test_alignment(spark):
    old, new = (spark.createDataFrame([(x,) for x in names], "id string") for names in (["same", "r", "x1", "x2", "split", "none", None], ["same", "r2", "c", "s1", "s2", "extra"]))
    proposals = [("r", "r2", "REPLACEMENT"), ("r", "extra", "CROSS_REFERENCE"), ("x1", "c", "REPLACEMENT"), ("x2", "c", "REPLACEMENT"), ("split", "s1", "REPLACEMENT"), ("split", "s2", "REPLACEMENT"), ("same", "extra", "REPLACEMENT"), ("r", "r2", "REPLACEMENT")]
    got = {(r["old_id"], r["new_id"], r["alignment"]) for r in identity.align_identities(old, new, spark.createDataFrame(proposals, "old_id string, new_id string, kind string")).collect()}
    assert got == {("same", "same", "EXACT"), ("r", "r2", "MAPPED"), ("x1", None, "AMBIGUOUS"), ("x2", None, "AMBIGUOUS"), ("split", None, "AMBIGUOUS"), ("none", None, "UNMATCHED")}


def test_states_and_reasons(spark):
    walk = spark.createDataFrame([("1", "D", "D", "EXACT_ID", True, "A;B"), ("1", "E", None, "UNMAPPED", False, None)], "release_id string, source_id string, canonical_id string, mapping_status string, stable boolean, detail string")
    targets = spark.createDataFrame([("1", "T", "T", "EXACT_ID", True, None)], walk.schema)
    rows = spark.createDataFrame([("1", d, t, s, e) for d, t, s, e in (("D", "T", 0.5, 1), ("D", "T", None, 1), ("D", "T", float("nan"), 1), ("D", "T", 2.0, 1), ("D", "T", 0.0, 1), ("D", "T", 0.5, None), ("E", "T", 0.5, 1), ("D", "U", 0.5, 1))], "release_id string, disease_id string, target_id string, score double, evidence_count long")
    reasons = [r["exclusion_reason"] for r in support.canonical_associations(rows, walk, targets).collect()]
    assert sorted(reasons) == sorted(["", "PRESENT_NULL", "SCORE_NONFINITE", "SCORE_OUT_OF_BOUNDS", "PRESENT_ZERO", "MISSING_OR_NONPOSITIVE_EVIDENCE_COUNT", "UNMAPPED", "TARGET_IDENTIFIER_NOT_EXACT"])


def test_prediction_metrics_with_ties(spark):
    rows = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.9), ("g", 1, 0.4), ("g", 0, 0.1), ("g", None, 0.5)], "g string, y int, p double")
    got = evaluation.binary_metrics(rows, ["g"], "y", "p").first()
    assert (got["rows"], got["positives"], got["capture"]) == (4, 2, 0.25)
    assert got["average_precision"] == pytest.approx((0.5 * 1 + 2 / 3 * 1) / 2) and got["brier"] == pytest.approx((0.01 + 0.81 + 0.36 + 0.01) / 4)


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 0.1), (1, "a", None), (3, None, 1e-17)], "i int, s string, x double")
    sinks.write_ordered(df, str(tmp_path / "p"), ["i"])
    assert [r["i"] for r in spark.read.parquet(str(tmp_path / "p")).orderBy("i").collect()] == [1, 2, 3]
    sinks.append_checked(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    with pytest.raises(ValueError):
        sinks.append_checked(df.drop("x"), str(tmp_path / "p"))
    sinks.write_csv(df, str(tmp_path / "c"), ["i"])
    back = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "c"))
    assert sorted(r["x"] or -1 for r in back.collect()) == [-1, 1e-17, 0.1]
    (tmp_path / "t.tsv").write_text("i\ts\tx\n7\tq\t0.5\n")
    assert tuple(tables.read_rows(spark, str(tmp_path / "t.tsv"), df.schema).first()) == (7, "q", 0.5)
    (tmp_path / "t.jsonl").write_text('{"i": 8, "s": "z", "x": 1.5}\n')
    assert tables.read_rows(spark, str(tmp_path / "t.jsonl"), df.schema).first()["i"] == 8
    df.withColumnRenamed("x", "score").write.parquet(str(tmp_path / "r1"))
    both = tables.release_union(spark, {"1": str(tmp_path / "p"), "2": str(tmp_path / "r1")}, {"1": {"x": "score"}})
    assert both.groupBy("release_id").count().count() == 2 and "score" in both.columns
    with pytest.raises(ValueError):
        tables.require_columns(df, ["i", "nope"])
    assert tables.violations(df, F.col("i") > 1) == 1


def test_running_sums_and_numbers(spark):
    df = spark.createDataFrame([(k, i // 5, i, i % 3) for k in ("x", "y", None) for i in range(40)], "k string, part int, o int, n long")
    got = {(r["k"], r["o"]): r["s"] for r in ordering.running_sum(df, ["k"], "part", ["o"], "n", "s").collect()}
    assert got == {(k, i): sum(j % 3 for j in range(i + 1)) for k in ("x", "y", None) for i in range(40)}
    numbered = ordering.hash_numbered(df, ["k"], F.md5(F.col("o").cast("string")), "o", "no").orderBy("k", "no").collect()
    assert [r["no"] for r in numbered] == list(range(1, 41)) * 3
    order = [r["o"] for r in numbered[:40]]
    assert order == sorted(order, key=lambda o: hashlib.md5(str(o).encode()).hexdigest())
    assert ordering.hash_numbered(df.limit(0), [], F.md5(F.lit("")), "o", "no").count() == 0


def test_held_out_prediction_beats_chance(spark):
    random.seed(8)
    data = [(i % 2, x, float(random.random()), int(x + random.gauss(0, 0.15) > 0.7)) for i in range(600) for x in [random.random()]]
    df = spark.createDataFrame([*data, (0, None, 1.0, 1), (1, None, 1.0, 0)], "half int, x double, noise double, y int")
    model = evaluation.fit_logistic(df.filter("half = 0"), ["x", "noise"], "y", 0.01)
    held_out = evaluation.predict_logistic(model, df.filter("half = 1"), ["x", "noise"], "p")
    got = evaluation.binary_metrics(held_out, ["half"], "y", "p").first()
    assert got["rows"] == 300 and got["average_precision"] > 0.8 and got["brier"] < 0.15


def test_ratio_draws(spark):
    units = spark.createDataFrame([("g", 1, 1, 2), ("g", 2, 0, 8)], "g string, u int, a int, b int")
    plan = spark.createDataFrame([("g", 0, 1, 2), ("g", 1, 1, 1), ("g", 1, 2, 1)], "g string, draw int, u int, times long")
    assert {r["draw"]: r["x"] for r in resampling.draw_ratios(units, plan, ["g"], "u", "a", "b", "x").collect()} == {0: 0.5, 1: 0.1}
