"""Brute-force checks of contrasts, one-to-one joins, certificates and overlap bounds on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelshift.operators import contrasts, graph, native, panel, rank_correlation, resampling


def test_factorial_contrasts_are_balanced():
    found = contrasts.factorial_contrasts(("P", "D", "H"))
    assert len(found) == 22 and all(sum(x.values()) == 0 for x in found.values())
    assert found["P_D0_H1"] == {(0, 0, 1): -1, (1, 0, 1): 1} and found["JOINT_H1"] == {(1, 1, 1): 1, (0, 0, 1): -1}
    assert found["PDH"][(1, 1, 1)] == 1 and found["PDH"][(0, 1, 1)] == -1


def test_contrasts_of_states_with_a_gap(spark):
    random.seed(3)
    values = {s: random.random() for s in itertools.product((0, 1), repeat=3)}
    rows = [("full", *s, v) for s, v in values.items()] + [("gap", *s, v) for s, v in values.items() if s != (1, 1, 1)]
    df = spark.createDataFrame(rows, "g string, p int, d int, h int, v double")
    got = {(r["g"], r["contrast"]): r["value"] for r in contrasts.apply_contrasts(df, ["g"], ["p", "d", "h"], "v", ("P", "D", "H")).collect()}
    for name, terms in contrasts.factorial_contrasts(("P", "D", "H")).items():
        assert got["full", name] == pytest.approx(sum(m * values[s] for s, m in terms.items()))
        assert (got["gap", name] is None) == ((1, 1, 1) in terms)


def test_minimal_flips_equal_brute_force(spark):
    random.seed(8)
    data = [(g, random.choice([1.0, 0.5, 0.25]), random.choice([0, 1, None])) for g in range(12) for _ in range(8)] + [(99, 1.0, 1)]
    got = {r["g"]: r["flips"] for r in contrasts.minimal_flips(spark.createDataFrame(data, "g int, w double, label int"), ["g"], "w", "label").collect()}
    for g in {r[0] for r in data}:
        known = sum(w if x else -w for k, w, x in data if k == g and x is not None)
        unknown = sorted((w for k, w, x in data if k == g and x is None), reverse=True)
        need = next((n for n in range(len(unknown) + 1) if sum(unknown[:n]) >= abs(known) - 1e-9), None)
        assert got[g] == (0 if known == 0 else need)


def test_signs_and_bounds(spark):
    df = spark.createDataFrame([("a", 1.0, -2.0), ("a", 0.0, 3.0), ("a", None, 1.0), ("b", -1.0, 0.0)], "g string, x double, y double")
    cells = {(r["g"], r["first_sign"], r["second_sign"]): r["rows"] for r in contrasts.sign_table(df, ["g"], "x", "y").collect()}
    assert len(cells) == 18 and sum(cells.values()) == 3 and cells["a", "zero", "positive"] == 1
    stats = {r["g"]: r for r in contrasts.signed_statistics(df, ["g"], "x").collect()}
    assert (stats["a"]["positive_sum"], stats["a"]["median"], stats["b"]["n_negative"]) == (1.0, 0.5, 1)
    parts = spark.createDataFrame([("a", 1.0, 0.0, 2.0), ("a", -1.0, 1.0, 3.0), ("b", 1.0, None, 1.0)], "g string, s double, lower double, upper double")
    got = {r["g"]: (r["lower"], r["upper"]) for r in contrasts.scaled_bounds(parts, ["g"], "s", "lower", "upper").collect()}
    assert got == {"a": (-3.0, 1.0), "b": (None, None)}


def test_value_distribution(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", 1.0), ("a", None), (None, 5.0)], "g string, v double")
    got = {(r["g"], r["v"]): (r["rows"], round(r["cumulative"], 9)) for r in contrasts.value_distribution(df, ["g"], "v").collect()}
    assert got == {("a", 1.0): (2, round(2 / 3, 9)), ("a", 2.0): (1, 1.0), (None, 5.0): (1, 1.0)}
    assert contrasts.value_distribution(df.limit(0), ["g"], "v").count() == 0


def test_one_to_one_joins_raise_on_a_repeated_key(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "k string, x int")
    right = spark.createDataFrame([("a", "p"), ("c", "q")], "k string, y string")
    assert sorted((r["k"], r["x"], r["y"]) for r in native.joined_one_to_one(left, right, ["k"]).collect()) == [("a", 1, "p")]
    with pytest.raises(Exception, match="occurs twice"):
        native.joined_one_to_one(left, right.unionByName(right), ["k"]).collect()


def test_certificate_bounds_the_error(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "node_a string, node_b string")
    evidence = spark.createDataFrame([("a", 3.0), ("d", 1.0), ("lone", 4.0)], "node string, evidence double")
    exact = {r["node"]: r["score"] for r in graph.propagate(edges, evidence, iterations=60, every=10).collect()}
    for steps in (1, 4):
        rough = graph.propagate(edges, evidence, iterations=steps)
        bound = graph.propagation_certificate(edges, evidence, rough).first()
        distance = sum(abs(r["score"] - exact[r["node"]]) for r in rough.collect())
        assert 0 < distance <= bound["error_bound"] < 10 * distance + 1


def test_overlap_bounds_equal_brute_force(spark):
    random.seed(2)
    panels = {"a": [(random.randint(0, 5), random.randint(0, 5)) for _ in range(12)], "tied": [(1, 1)] * 5, "one": [(2, 3)]}
    df = spark.createDataFrame([(p, float(o), float(n)) for p, rows in panels.items() for o, n in rows], "p string, old_score double, new_score double")
    got = {(r["p"], r["variant"]): r for r in rank_correlation.overlap_bounds(panel.both_ladders(df, ["p"]), ["p"], (0.8,)).collect()}
    for p, rows in panels.items():
        m, places = len(rows), []
        for side in zip(*rows):
            tops = [1 + sum(y > x for y in side) for x in side]
            places.append([(t, side.count(x)) for t, x in zip(tops, side)])
        for variant in "wb":
            total = 0.0
            for depth in range(1, m + 1):
                a, b = (np.array([float(depth >= t) if variant == "w" else min(1.0, max(0.0, (depth - t + 1) / k)) for t, k in side]) for side in places)
                total += 0.8**depth * (2 * (a * b).sum() / (a.sum() + b.sum()) if variant == "w" else (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
            least = 0.25 * (total + m * sum(0.8**d / d for d in range(m + 1, 400)))
            most = 0.25 * (total + sum(0.8**d for d in range(m + 1, 400)))
            assert (got[p, variant]["least"], got[p, variant]["most"]) == (pytest.approx(least), pytest.approx(most))


def test_selection_optimism_of_equal_options(spark):
    values = spark.createDataFrame([("g", u, 0.5, 0.5) for u in range(6)], "g string, u int, a double, b double")
    draws = resampling.draw_means(values, resampling.hashed_plan(values, "u", ["g"], 20), ["g"], "u", ["a", "b"])
    row = resampling.selection_optimism(values, draws, ["g"], ["a", "b"]).first()
    assert (row["chosen"], row["apparent"], round(row["optimism"], 12)) == ("a", 0.5, 0.0)
    ratios = resampling.ratio_intervals(values.withColumn("zero", F.lit(0)), resampling.hashed_plan(values, "u", ["g"], 20), ["g"], "u", "a", "zero").first()
    assert ratios["estimate"] is None and ratios["undefined_draws"] == 20
