"""Entities across releases: crosswalks, alignment by proposals, memberships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crosswalk(rows: DataFrame, release: str, source: Column, canonical: Column, stable: Column, detail: str | None = None) -> DataFrame:
    """One row per release and source id: canonical_id, mapping_status, stable, detail.

    Repeated rows are merged: `stable` only if all say so, the least `detail`. Statuses: UNMAPPED (no canonical id),
    AMBIGUOUS_ONE_TO_MANY (the source has several), AMBIGUOUS_MANY_TO_ONE (the canonical id has several sources in the release),
    EXACT_ID (equal ids), MAPPED. Rows with a NULL release or source are left out; an id of '' is none.
    """
    extra = F.col(detail) if detail else F.lit(None).cast("string")
    base = rows.select(F.col(release).alias("release_id"), source.alias("source_id"), F.nullif(canonical, F.lit("")).alias("_c"), stable.alias("_s"), extra.alias("detail"))
    one = base.filter("release_id is not null and source_id is not null").groupBy("release_id", "source_id").agg(
        F.min("_c").alias("canonical_id"), F.max("_c").alias("_other"), F.bool_and("_s").alias("stable"), F.min("detail").alias("detail")
    )
    shared = one.filter("canonical_id is not null").groupBy("release_id", "canonical_id").agg(F.count("*").alias("_sources"))
    status = (
        F.when(F.col("canonical_id").isNull(), "UNMAPPED").when(F.col("canonical_id") != F.col("_other"), "AMBIGUOUS_ONE_TO_MANY")
        .when(F.col("_sources") > 1, "AMBIGUOUS_MANY_TO_ONE").when(F.col("canonical_id") == F.col("source_id"), "EXACT_ID").otherwise("MAPPED")
    )
    return one.join(shared, ["release_id", "canonical_id"], "left").select("release_id", "source_id", "canonical_id", status.alias("mapping_status"), "stable", "detail")


def reference_forms(value: Column) -> Column:
    """The forms under which an identifier may be cited: as it is, PREFIX_suffix (ORPHA reads Orphanet), and what follows the last '/'."""
    raw = F.trim(value)
    prefix, suffix = F.substring_index(raw, ":", 1), F.regexp_extract(raw, "^[^:]*:(.*)$", 1)
    joined = F.when(raw.contains(":"), F.concat(F.when(F.upper(prefix) == "ORPHA", F.lit("Orphanet")).otherwise(prefix), F.lit("_"), suffix))
    tail = F.when(raw.contains("/"), F.substring_index(raw, "/", -1))
    return F.array_distinct(F.filter(F.array(raw, joined, tail), lambda x: x.isNotNull() & (x != "")))


def align_identities(old: DataFrame, new: DataFrame, proposals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per old id (and `by`, columns of all three tables, within which ids are aligned): old_id, new_id, alignment.

    `old` and `new` have `id`, `proposals` (old_id, new_id, kind) with kind REPLACEMENT or CROSS_REFERENCE. Equal ids are
    EXACT and reserved on both sides. Of the proposals of other ids, a source's replacements go before its cross references; a
    source with several targets or a target with several sources is AMBIGUOUS, and so is every id that shares one with it. The rest are
    MAPPED, or UNMATCHED. Repeated rows and NULL ids change nothing.
    """
    olds, news = (x.select(*by, "id").filter("id is not null").distinct() for x in (old, new))
    exact = olds.join(news, [*by, "id"])
    open_old, open_new = olds.join(exact, [*by, "id"], "left_anti"), news.join(exact, [*by, "id"], "left_anti")
    usable = (
        proposals.filter(F.col("kind").isin("REPLACEMENT", "CROSS_REFERENCE")).select(*by, "old_id", "new_id", "kind").distinct()
        .join(open_old.withColumnRenamed("id", "old_id"), [*by, "old_id"], "left_semi").join(open_new.withColumnRenamed("id", "new_id"), [*by, "new_id"], "left_semi")
    )
    preferred = usable.groupBy(*by, "old_id").agg(F.max("kind").alias("kind"))  # REPLACEMENT sorts after CROSS_REFERENCE
    links = usable.join(preferred, [*by, "old_id", "kind"]).select(*by, "old_id", "new_id").distinct()
    out_degree, in_degree = links.groupBy(*by, "old_id").agg(F.count("*").alias("_out")), links.groupBy(*by, "new_id").agg(F.count("*").alias("_in"))
    judged = links.join(out_degree, [*by, "old_id"]).join(in_degree, [*by, "new_id"])
    bad_old = judged.filter("_out > 1 or _in > 1").select(*by, "old_id").distinct()
    mapped = judged.filter("_out = 1 and _in = 1").select(*by, "old_id", "new_id", F.lit("MAPPED").alias("alignment"))
    ambiguous = bad_old.join(mapped, [*by, "old_id"], "left_anti").select(*by, "old_id", F.lit(None).cast("string").alias("new_id"), F.lit("AMBIGUOUS").alias("alignment"))
    done = exact.select(*by, F.col("id").alias("old_id"), F.col("id").alias("new_id"), F.lit("EXACT").alias("alignment")).unionByName(mapped).unionByName(ambiguous)
    rest = olds.withColumnRenamed("id", "old_id").join(done, [*by, "old_id"], "left_anti").select(*by, "old_id", F.lit(None).cast("string").alias("new_id"), F.lit("UNMATCHED").alias("alignment"))
    return done.unionByName(rest)


def unique_inverse(mapping: DataFrame, source: str, target: str) -> DataFrame:
    """target -> source for targets of exactly one source."""
    return mapping.filter(F.col(target).isNotNull()).select(source, target).distinct().groupBy(target).agg(F.min(source).alias(source), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def membership_partition(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side once, with `membership`: PERSISTENT, ENTERING or EXITING. Rows with a NULL key are left out."""
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    sides = old.select(*keys, F.lit(1).alias("_side")).unionByName(new.select(*keys, F.lit(2).alias("_side"))).filter(there)
    seen = sides.groupBy(*keys).agg(F.bool_or(F.col("_side") == 1).alias("_o"), F.bool_or(F.col("_side") == 2).alias("_n"))
    return seen.select(*keys, F.when(F.col("_o") & F.col("_n"), "PERSISTENT").when(F.col("_n"), "ENTERING").otherwise("EXITING").alias("membership"))


def with_release_pairs(rows: DataFrame, release: str, names: list[str]) -> DataFrame:
    """Each row once as the old (_side 1) and once as the new side (_side 2) of the pairs of consecutive releases it is in, with release_pair."""
    pairs = [(f"{a}_to_{b}", x, side) for a, b in zip(names, names[1:]) for x, side in ((a, 1), (b, 2))]
    if not pairs:
        return rows.limit(0).withColumns({"release_pair": F.lit(""), "_side": F.lit(0)})
    sides = F.array(*[F.struct(F.lit(p).alias("release_pair"), F.lit(x).alias("_release"), F.lit(side).alias("_side")) for p, x, side in pairs])
    return rows.select("*", F.inline(F.filter(sides, lambda s: s["_release"] == F.col(release)))).drop("_release")


def membership_partitions(rows: DataFrame, release: str, names: list[str], keys: list[str]) -> DataFrame:
    """`membership_partition` of every pair of consecutive releases in one grouping, with release_pair."""
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    seen = with_release_pairs(rows.filter(there), release, names).groupBy("release_pair", *keys).agg(F.bool_or(F.col("_side") == 1).alias("_o"), F.bool_or(F.col("_side") == 2).alias("_n"))
    return seen.select("release_pair", *keys, F.when(F.col("_o") & F.col("_n"), "PERSISTENT").when(F.col("_n"), "ENTERING").otherwise("EXITING").alias("membership"))
