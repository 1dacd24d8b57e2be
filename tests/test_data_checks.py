"""Nulls, ties, repeated rows, empty tables and clashing names in the operators of p1, p2, p3, p4 and p6."""

import math
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelshift.operators import drift, orphans, profile, selection, snapshots


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect()) if names else sorted(tuple(r) for r in df.collect())


# per_key_ranks


def test_ranks_equal_brute_force(spark):
    random.seed(5)
    values = [0.0, -0.0, 1e-300, -1e300, 1e300, 7.25, 7.250000001, None, float("nan"), float("inf")]
    data = [(random.choice(["a", "b", None]), random.choice([*values, random.gauss(0, 1), random.randint(-3, 3) * 1.0])) for _ in range(4000)]
    data += [("hot", random.random() * 1e-3 + 5) for _ in range(3000)] + [("none", None)]
    df = spark.createDataFrame(data, "k string, v double").withColumns({"_v": F.lit("clash"), "n_rows": F.lit(1), "_bin": F.lit(2)})
    got = {r["k"]: r for r in selection.per_key_ranks(df, ["k"], "v", {"q0": 0.0, "q25": 0.25, "q5": 0.5, "q1": 1.0}, {"c0": 0.0, "c7": 7.25, "c5": 5.0005}).collect()}
    groups = defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        real = sorted(v for v in vs if v is not None and math.isfinite(v))
        assert (got[k]["n_rows"], got[k]["n_values"]) == (len(vs), len(real))
        for name, q in (("q0", 0.0), ("q25", 0.25), ("q5", 0.5), ("q1", 1.0)):
            assert got[k][name] == (real[max(1, math.ceil(q * len(real))) - 1] if real else None)
        for name, c in (("c0", 0.0), ("c7", 7.25), ("c5", 5.0005)):
            assert got[k][name] == sum(v >= c for v in real)


def test_ranks_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert selection.per_key_ranks(empty, ["k"], "v", {"q": 0.5}, {"c": 1.0}).count() == 0
    assert selection.key_shares(empty.withColumn("s", F.lit("x")), "s", "k", "v").count() == 0


def test_partners_once_and_shares_with_null_keys(spark):
    links = spark.createDataFrame([("x", "a", "b", 1.0), ("x", "b", "a", 3.0), ("x", "a", "a", 9.0), ("x", None, "a", 1.0), (None, "a", "b", 1.0), ("x", "a", "c", None)], "s string, l string, r string, v double")
    assert [tuple(r) for r in selection.linked_partners(links, "s", "l", "r", "v").orderBy("node", "partner").select("scope", "node", "partner", "score").collect()] == [("x", "a", "b", 3.0), ("x", "a", "c", None), ("x", "b", "a", 3.0), ("x", "c", "a", None)]
    keyed = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", None), ("q", "b")], "s string, k string").withColumn("v", F.lit(None).cast("double"))
    shares = {(r["s"], r["k"]): r["share"] for r in selection.key_shares(keyed, "s", "k", "v").collect()}
    assert shares == pytest.approx({("r", "a"): 2 / 3, ("r", None): 1 / 3, ("q", "b"): 1.0})


# profile

CHECKS = profile.Checks(("g", "load"), "id", {"name": "[a-z]+"}, {"x": (0.0, 10.0)})


def profiled(spark, tmp_path, frames, **options):
    for i, frame in enumerate(frames):
        frame.astype({"g": "string", "load": "Int64", "id": "int64", "name": "string", "x": "float64"}).to_parquet(tmp_path / f"part-{i}.parquet", **options)
    return profile.chunk_facts(profile.footers(spark, str(tmp_path), CHECKS), CHECKS)


def test_profile_of_mixed_and_single_groups(spark, tmp_path):
    pure = pd.DataFrame({"g": "a", "load": 1, "id": range(4), "name": ["ab", "ab", "c", "d"], "x": [1.0, 2.0, 3.0, 4.0]})
    dirty = pd.DataFrame({"g": ["a", "a", None, "b", "b"], "load": [2, 2, 1, 1, 1], "id": range(10, 15), "name": ["A1", None, "ok", "ok", ""], "x": [None, 11.0, -1.0, 2.5, float("nan")]})
    dirty["x"] = dirty["x"].astype(object).where(~dirty["x"].isna() | (dirty["id"] == 14), None)
    facts = profiled(spark, tmp_path, [pure, dirty]).persist()
    found = {(r["group_values"][0], r["column_name"], r["finding"], r["row_id"]) for r in facts.filter("kind = 'row'").collect()}
    assert {("a", "name", "PATTERN", 10), ("a", "name", "NULL_VALUE", 11), ("a", "x", "NULL_VALUE", 10), ("a", "x", "OUT_OF_RANGE", 11), (None, "x", "OUT_OF_RANGE", 12), ("b", "x", "NOT_INTEGER", 13), ("b", "name", "PATTERN", 14)} <= found
    table = {(*r["group_values"], r["column_name"]): r for r in profile.column_profile(facts).collect()}
    one = table["a", "1", "x"]
    assert (one["n_rows"], one["null_rows"], one["distinct_values"], one["sound_rows"], one["sound_mean"], one["lowest"], one["highest"]) == (4, 0, 4, 4, 2.5, 1.0, 4.0)
    assert table["a", "1", "name"]["distinct_values"] == 3
    assert table["a", "2", "x"]["null_rows"] == 1 and table["a", "2", "x"]["sound_mean"] is None


def test_profile_without_statistics_or_dictionaries(spark, tmp_path):
    frame = pd.DataFrame({"g": "a", "load": 1, "id": range(5), "name": ["ab", "B", None, "c", "c"], "x": [1.0, 20.0, 3.0, 3.0, None]})
    facts = profiled(spark, tmp_path, [frame], write_statistics=False, use_dictionary=False)
    assert rows(facts.filter("kind = 'row'"), "column_name", "finding", "row_id") == [("name", "NULL_VALUE", 2), ("name", "PATTERN", 1), ("x", "NULL_VALUE", 4), ("x", "OUT_OF_RANGE", 1)]
    table = {r["column_name"]: r for r in profile.column_profile(facts).collect()}
    assert (table["x"]["distinct_values"], table["x"]["lowest"], table["x"]["highest"], table["name"]["distinct_values"]) == (3, 1.0, 20.0, 3)


def test_profile_of_empty_file_and_long_text(spark, tmp_path):
    empty = pd.DataFrame({"g": [], "load": [], "id": [], "name": [], "x": []})
    long = pd.DataFrame({"g": "a", "load": 1, "id": [1], "name": ["z" * 300_000], "x": [0.0]})
    facts = profiled(spark, tmp_path, [empty, long])
    assert facts.filter("kind = 'row'").count() == 0
    assert profile.column_profile(facts).count() == 2


def test_load_shifts(spark):
    data = [("a", 1, "x", 100, 0, 10, 100, 50.0), ("a", 2, "x", 100, 4, 21, 90, 111.0), ("a", 3, "x", 100, 4, 10, 90, None), ("b", 1, "x", 0, 0, 0, 0, None), ("b", 2, "x", 10, 0, 0, 0, None)]
    table = spark.createDataFrame(data, "scope string, load int, column_name string, n_rows long, null_rows long, distinct_values long, sound_rows long, sound_mean double")
    assert rows(profile.load_shifts(table, "scope", "load")) == [("a", 2, "x", "DISTINCT_SHIFT"), ("a", 2, "x", "MEAN_SHIFT"), ("a", 2, "x", "NULL_SHIFT"), ("a", 3, "x", "DISTINCT_SHIFT")]


# orphans


def test_orphan_kinds(spark):
    refs = spark.createDataFrame([("t", "f", "d", r, k) for r, k in (("2", "here"), ("2", "late"), ("2", "early"), ("2", "gap"), ("2", "never"), ("2", "never"), ("2", None), (None, "here"), ("2", ""))], "ref_table string, ref_field string, key_kind string, release_id string, ref_key string").withColumn("releases", F.lit("clash"))
    parents = spark.createDataFrame([("d", "2", "here"), ("d", "3", "late"), ("d", "1", "early"), ("d", "1", "gap"), ("d", "3", "gap"), ("d", "2", ""), ("d", "2", None), ("other", "2", "never"), ("d", None, "never")], "key_kind string, release_id string, key string")
    found = orphans.orphan_references(refs, parents)
    assert rows(found, "ref_key", "orphan_kind") == [("", "NEVER"), ("early", "EARLIER"), ("gap", "GAP"), ("late", "LATER"), ("never", "NEVER")]
    assert orphans.orphan_references(refs, parents.limit(0)).filter("orphan_kind <> 'NEVER'").count() == 0
    assert orphans.orphan_references(refs.limit(0), parents).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(orphans, "MAX_BITS", 2**10)
    parents = spark.range(5000).select(F.lit("d").alias("key_kind"), F.lit("1").alias("release_id"), F.concat(F.lit("k"), "id").alias("key"))
    refs = spark.range(0, 10000, 3).select(F.lit("t").alias("ref_table"), F.lit("f").alias("ref_field"), F.lit("d").alias("key_kind"), F.lit("1").alias("release_id"), F.concat(F.lit("k"), "id").alias("ref_key"))
    assert orphans.orphan_references(refs, parents).count() == sum(1 for i in range(0, 10000, 3) if i >= 5000)


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    bloom = orphans.BloomFilter(keys, ["k"])
    assert keys.filter(~bloom.maybe(["k"])).count() == 0
    assert spark.range(10**6, 10**6 + 20000).select(F.col("id").cast("string").alias("k")).filter(bloom.maybe(["k"])).count() < 1000


# snapshots


def changes(spark, data, all_releases=("1", "2", "3", "4")):
    df = spark.createDataFrame(data, "r string, k string, v double, e long")
    known = spark.createDataFrame([(x,) for x in all_releases], "r string")
    return rows(snapshots.change_events(snapshots.validity_intervals(df, known, "r", ["k"], ["e"], {"v": 1e-9}), known, "r", ["k"]), "old_release", "new_release", "k", "change_kind")


def test_intervals_and_events(spark):
    nan = float("nan")
    data = [("1", "stay", 1.0, 1), ("2", "stay", 1.0 + 5e-10, 1), ("3", "stay", 1.0, 1), ("4", "stay", 1.0, 1), ("2", "new", 1.0, 1), ("3", "new", 2.0, 1), ("4", "new", 2.0, None), ("1", "gap", 1.0, 1), ("3", "gap", 1.0, 1)]
    data += [(r, "nan", nan, None) for r in "1234"] + [("1", "null", None, 1), ("2", "null", nan, 1), ("3", "null", 0.0, 1), ("4", "null", -0.0, 1)]
    assert changes(spark, data) == sorted([
        ("1", "2", "new", "ADDED"), ("2", "3", "new", "CHANGED"), ("3", "4", "new", "CHANGED"), ("1", "2", "gap", "REMOVED"), ("2", "3", "gap", "ADDED"), ("3", "4", "gap", "REMOVED"),
        ("1", "2", "null", "CHANGED"), ("2", "3", "null", "CHANGED"),
    ])


def test_release_in_which_nothing_is_there(spark):
    assert changes(spark, [("1", "a", 1.0, 1), ("3", "a", 1.0, 1)], ("1", "2", "3")) == [("1", "2", "a", "REMOVED"), ("2", "3", "a", "ADDED")]
    assert changes(spark, []) == []


def test_latest_rows(spark):
    data = [("1", "a", 5, 1.0), ("1", "a", 5, None), ("1", "a", 3, 9.0), ("1", None, 5, 1.0), (None, "a", 5, 1.0), ("1", "b", None, 2.0), ("1", "b", None, 2.0)]
    df = spark.createDataFrame(data, "r string, k string, at int, v double").withColumn("_last", F.lit(0))
    assert rows(snapshots.latest_rows(df, "r", ["k"], "at", ["v"])) == [("1", "a", 1.0), ("1", "b", 2.0)]


# drift


def drifted(spark, files, roles=()):
    records = spark.createDataFrame([(i, "f", s, p) for i, (s, p) in enumerate(files)], "id long, feed string, seq int, payload string")
    declared = spark.createDataFrame(list(roles), "feed string, seq int, role string, name string")
    profiles = drift.with_roles(drift.field_profiles(drift.payload_fields(records, "payload", ["id", "feed", "seq"]), "feed", "seq"), declared, "feed", "seq")
    matches = drift.match_fields(profiles, "feed", "seq")
    return rows(drift.schema_changes(profiles, matches.filter("declared"), "feed", "seq"), "seq", "field_name", "change_kind"), matches


def test_field_changes(spark):
    files = [(1, '{"aB": 1, "s": 0.5, "gone": "x", "t": 1}'), (1, '{"aB": null}'), (1, "no json"), (1, None), (1, "[1]"), (2, '{"a_b": "1", "score": 0.5, "t": null}'), (3, '{"a_b": 2, "score": {"value": 1}, "new": [1], "t": true}')]
    found, _ = drifted(spark, files, [("f", 1, "r", "s"), ("f", 2, "r", "score"), ("f", 3, "r", "score")])
    assert found == sorted([
        (2, "a_b", "RENAMED"), (2, "a_b", "RETYPED"), (2, "score", "RENAMED"), (2, "gone", "REMOVED"), (3, "a_b", "RETYPED"), (3, "score", "RETYPED"), (3, "new", "ADDED"), (3, "t", "RETYPED"),
    ])


def test_undeclared_rename_is_suspected(spark):
    values = ['"north"', '"south"', '"east"', '"west"']
    found, matches = drifted(spark, [(1, f'{{"region": {v}, "k": 1}}') for v in values] + [(2, f'{{"area_name": {v}, "k": 1}}') for v in values])
    assert found == [(2, "area_name", "ADDED"), (2, "region", "REMOVED")]
    assert rows(matches.filter("not declared"), "old_name", "new_name") == [("region", "area_name")]


def test_rename_without_common_values_is_suspected(spark):
    old = [(1, f'{{"qc_margin": {i}.5, "curator_note": "a{i}", "score_x": {i}, "k": 1, "other": {i}}}') for i in range(20)]
    new = [(2, f'{{"qc_margins": {i}.25, "noteCurator": "b{i}", "score_x": {i}, "k": 1, "zzz": {i}.125, "margin": "m{i}"}}') for i in range(20)]
    found, matches = drifted(spark, old + new)
    assert (2, "qc_margins", "ADDED") in found and (2, "qc_margin", "REMOVED") in found
    assert rows(matches.filter("not declared"), "old_name", "new_name") == [("curator_note", "noteCurator"), ("qc_margin", "qc_margins")]
    assert rows(matches.filter("declared"), "old_name", "new_name") == [("k", "k"), ("score_x", "score_x")]


def test_recall_of_planted_renames(spark):
    """Renames by a new ending, a further word, moved words or a shortened word with other values, and by an unrelated name with the same values."""
    random.seed(13)
    heads, tails = ["assay", "sample", "donor", "signal", "batch", "tissue", "cohort", "variant"], ["level", "margin", "region", "quality", "source", "depth", "status", "offset"]
    data, planted = [], set()
    for feed in range(20):
        names = random.sample([f"{a}_{b}" for a in heads for b in tails], 5)
        turned = {
            names[0]: names[0] + "s", names[1]: names[1] + "_raw", names[2]: names[2].split("_")[1] + names[2].split("_")[0].title(), names[3]: names[3].split("_")[0] + "_" + names[3].split("_")[1][:4],
            names[4]: f"zz{feed}q",
        }
        planted |= {(f"f{feed}", a, b) for a, b in turned.items()}
        shared = [f'"v{feed}_{i}"' for i in range(12)]
        for i in range(12):
            old = [f'"{n}": {random.random()}' for n in names[:4]] + [f'"{names[4]}": {shared[i]}', f'"lost{feed}": [1]', '"kept": 1']
            new = [f'"{turned[n]}": {random.random()}' for n in names[:4]] + [f'"{turned[names[4]]}": {shared[i]}', f'"fresh{feed}": true', '"kept": 2']
            data += [(f"f{feed}", 1, f"{{{', '.join(old)}}}"), (f"f{feed}", 2, f"{{{', '.join(new)}}}")]
    records = spark.createDataFrame(data, "feed string, seq int, payload string")
    profiles = drift.field_profiles(drift.payload_fields(records, "payload", ["feed", "seq"]), "feed", "seq").withColumn("role", F.lit(None).cast("string"))
    found = {(r["feed"], r["old_name"], r["new_name"]) for r in drift.match_fields(profiles, "feed", "seq").filter("not declared").collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)


def test_no_field_is_lost_in_the_unified_table(spark):
    values = ['"north"', '"south"', '"east"', '"west"']
    files = [(1, f'{{"region": {v}, "aB": 1, "s": "high"}}') for v in values] + [(2, f'{{"area_name": {v}, "a_b": null, "t": {{"other": 2}}}}') for v in values]
    files += [(3, '{"region": "x", "new": [1]}'), (4, '{"area_name": "x", "new": true, "news": 1}'), (4, "no json"), (4, None), (4, "{}")]
    records = spark.createDataFrame([(i, "f", s, p) for i, (s, p) in enumerate(files)], "id long, feed string, seq int, payload string")
    roles = spark.createDataFrame([("f", 1, "r", "s"), ("f", 2, "r", "t")], "feed string, seq int, role string, name string")
    fields = drift.payload_fields(records, "payload", ["id", "feed", "seq"])
    profiles = drift.with_roles(drift.field_profiles(fields, "feed", "seq"), roles, "feed", "seq")
    identities = drift.field_identities(profiles, drift.match_fields(profiles, "feed", "seq"), "feed", "seq")
    got = rows(drift.unified_fields(records, fields, roles, identities, "id", "feed", "seq", "payload"), "id", "field_kind", "field", "name", "type", "value")
    plain = [v.strip('"') for v in values]
    expected = [x for i, v in enumerate(plain) for x in [(i, "field", "region", "region", "text", v), (i, "field", "ab", "aB", "number", "1"), (i, "role", "r", "s", "text", "high")]]
    expected += [x for i, v in enumerate(plain, 4) for x in [(i, "field", "region", "area_name", "text", v), (i, "field", "ab", "a_b", None, None), (i, "role", "r", "t", "object", '{"other":2}')]]
    expected += [(8, "field", "region", "region", "text", "x"), (8, "field", "new", "new", "list", "[1]"), (9, "field", "region", "area_name", "text", "x"), (9, "field", "new", "new", "boolean", "true"), (9, "field", "news", "news", "number", "1")]
    expected += [(10, "payload", None, None, None, "no json"), (11, "payload", None, None, None, None), (12, "payload", None, None, None, "{}")]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_fields_of_one_file_are_never_joined(spark):
    profiles = spark.createDataFrame([("f", s, n, None) for s, n in [(1, "x"), (2, "y"), (3, "x"), (3, "y"), (1, "u"), (2, "v")]], "feed string, seq int, name string, role string")
    matches = spark.createDataFrame([("f", 2, "x", "y", 3.0, False), ("f", 2, "u", "v", 1.0, False)], "feed string, seq int, old_name string, new_name string, weight double, declared boolean")
    assert rows(drift.field_identities(profiles, matches, "feed", "seq"), "name", "field") == [("u", "u"), ("v", "u"), ("x", "x"), ("y", "y")]


def test_no_fields(spark):
    assert drifted(spark, [(1, "{}"), (2, None)])[0] == []


def test_roles_are_filled_from_the_file_before(spark):
    files = spark.createDataFrame([("f", 1, "a"), ("f", 3, "c"), ("f", 2, None), ("g", 1, None)], "feed string, seq int, field string")
    assert rows(drift.declared_roles(files, "feed", "seq", {"r": "field"})) == [("f", 1, "r", "a"), ("f", 2, "r", "a"), ("f", 3, "r", "c")]
