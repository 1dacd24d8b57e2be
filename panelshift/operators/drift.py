"""Fields that change name, type or presence between the files of a feed.

Every file's top-level fields are profiled (names, JSON types, a sketch of the values). Between neighbouring files,
candidate pairs come from equi-joins on declared role and on normalised name, and for fields that these leave over on
sketch slots and on letter pairs of the names, never from all pairs. They
are scored by role, name, types and values; a maximum-weight bipartite matching then decides. Unambiguous pairs are
settled by counting, only the others reach a grouped function, one small weight matrix per file.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelshift.session import cut_lineage

SLOTS = 8
#: Weights of a pair: same declared role, same normalised name, similarity of names, types, values. A declared pair outweighs any two others.
#: With equal types, names that are five eighths alike reach a weight of 1 without a common value.
ROLE, NAME, ALIKE, TYPES, VALUES = 10.0, 5.0, 0.8, 0.5, 1.0


def normalised_name(c: Column) -> Column:
    """Field names agree when they do so without letter case and '_'."""
    return F.lower(F.replace(c, F.lit("_"), F.lit("")))


def letter_pairs(c: Column) -> Column:
    """The distinct pairs of neighbouring characters of a normalised name, its two ends included.

    Names of which fewer than half of the longer one's characters are edited have one in common (an edit spoils two pairs).
    """
    name = F.concat(F.lit("^"), normalised_name(c), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substr(name, i, F.lit(2))))


def payload_fields(records: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row per record and top-level field: `keep`, name, type (number, text, boolean, list, object; NULL for null), value as text.

    A payload that is NULL, malformed or no object has no fields.
    """
    parsed = records.select(*keep, F.try_parse_json(payload).alias("_json")).filter(F.schema_of_variant("_json").startswith("OBJECT"))
    exploded = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("_json").outer()))
    kind = F.schema_of_variant("value")
    type_ = (
        F.when(kind == "VOID", None).when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )
    return exploded.select(*keep, F.col("key").alias("name"), type_.alias("type"), F.when(kind != "VOID", F.col("value").cast("string")).alias("value"))


def field_profiles(fields: DataFrame, feed: str, seq: str) -> DataFrame:
    """One row per file and field: types (sorted set of the non-null values), n_values, sketch (least hashes of the values, by slot)."""
    by_value = fields.groupBy(feed, seq, "name", "type").agg(
        F.count("type").alias("_n"),
        *[F.min(F.when(F.col("value").isNotNull(), F.xxhash64(F.lit(i), "value"))).alias(f"_s{i}") for i in range(SLOTS)],
    )
    sketch = F.array(*[F.min(f"_s{i}") for i in range(SLOTS)])
    return by_value.groupBy(feed, seq, "name").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("_n").alias("n_values"), sketch.alias("sketch"))


def declared_roles(files: DataFrame, feed: str, seq: str, roles: dict[str, str]) -> DataFrame:
    """(feed, seq, role, name): which field plays a role in a file; NULL is filled from the file before it."""
    line = Window.partitionBy(feed).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    filled = files.groupBy(feed, seq).agg(*[F.max(c).alias(c) for c in roles.values()]).withColumns({c: F.last(c, ignorenulls=True).over(line) for c in roles.values()})
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("name")) for r, c in roles.items()])
    return filled.select(feed, seq, F.inline(pairs)).filter("name is not null")


def with_roles(profiles: DataFrame, roles: DataFrame, feed: str, seq: str) -> DataFrame:
    """Profiles with the role of each field, NULL for none (of several roles the first by name)."""
    one = roles.groupBy(feed, seq, "name").agg(F.min("role").alias("role"))
    return profiles.join(one, [feed, seq, "name"], "left")


def match_fields(profiles: DataFrame, feed: str, seq: str, least: float = 1.0) -> DataFrame:
    """Maximum-weight matching of the fields of each file with those of the file before it (seq - 1).

    Columns: feed, seq, old_name, new_name, weight, declared (same role, or same normalised name and no role on either
    side). Fields with different roles, or of which one has a role, never match. Pairs under `least` are left out.
    Names are alike by edits or by their letter pairs (which finds moved words), whichever is more.
    Declared pairs are settled first, so only fields that they leave over are compared by values and letters.
    """
    new = profiles.select(feed, seq, *[F.col(c).alias(f"new_{c}") for c in ("name", "types", "sketch", "role")])
    old = profiles.select(feed, (F.col(seq) + 1).alias(seq), *[F.col(c).alias(f"old_{c}") for c in ("name", "types", "sketch", "role")])
    same_role = F.col("new_role").eqNullSafe(F.col("old_role"))

    ids = [feed, seq, "new_name", "old_name"]

    def own(df: DataFrame, side: str) -> DataFrame:
        name, role = F.col(f"{side}_name"), F.col(f"{side}_role")
        return df.withColumn("_block", F.when(role.isNotNull(), F.concat(F.lit("r:"), role)).otherwise(F.concat(F.lit("n:"), normalised_name(name))))

    def open_blocks(df: DataFrame, side: str) -> DataFrame:
        """Blocks of the fields without a role that no declared pair has."""
        slots = F.transform(F.col(f"{side}_sketch"), lambda x, i: F.concat(F.lit("s"), i.cast("string"), F.lit(":"), x.cast("string")))
        pairs = F.transform(letter_pairs(F.col(f"{side}_name")), lambda x: F.concat(F.lit("l:"), x))
        left_over = df.filter(F.col(f"{side}_role").isNull()).join(sure.select(feed, seq, f"{side}_name").distinct(), [feed, seq, f"{side}_name"], "left_anti")
        return left_over.withColumn("_block", F.explode(F.array_distinct(F.concat(F.array_compact(slots), pairs))))

    sure = own(new, "new").join(own(old, "old"), [feed, seq, "_block"]).filter(same_role).drop("_block").dropDuplicates(ids)
    blocked = sure.unionByName(open_blocks(new, "new").join(open_blocks(old, "old"), [feed, seq, "_block"]).drop("_block").dropDuplicates(ids))
    same_name = F.col("new_role").isNull() & (normalised_name(F.col("new_name")) == normalised_name(F.col("old_name")))
    declared = F.col("new_role").isNotNull() | same_name
    a, b = normalised_name(F.col("new_name")), normalised_name(F.col("old_name"))
    by_edits = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    p, q = letter_pairs(F.col("new_name")), letter_pairs(F.col("old_name"))
    alike = F.greatest(by_edits, 2 * F.size(F.array_intersect(p, q)) / (F.size(p) + F.size(q)))
    types = F.coalesce(F.try_divide(F.size(F.array_intersect("new_types", "old_types")), F.size(F.array_union("new_types", "old_types"))), F.lit(0.0))
    values = F.size(F.filter(F.zip_with("new_sketch", "old_sketch", lambda x, y: x == y), lambda z: z)) / SLOTS
    weight = F.when(F.col("new_role").isNotNull(), ROLE).when(same_name, NAME).otherwise(0.0) + ALIKE * alike + TYPES * types + VALUES * values
    scored = blocked.select(feed, seq, "old_name", "new_name", F.round(weight, 9).alias("weight"), F.coalesce(declared, F.lit(False)).alias("declared")).filter(F.col("weight") >= least)

    columns = scored.columns
    of_new, of_old = Window.partitionBy(feed, seq, "new_name"), Window.partitionBy(feed, seq, "old_name")
    taken = F.max("declared").over(of_new) | F.max("declared").over(of_old)
    left = cut_lineage(scored).withColumn("_taken", taken).filter(F.col("declared") | ~F.col("_taken")).select(*columns)
    counted = left.withColumn("_alone", (F.count("*").over(of_new) == 1) & (F.count("*").over(of_old) == 1))
    contested = counted.filter(~F.col("_alone")).select(*columns).groupBy(feed, seq).applyInPandas(_assign, scored.schema)
    return counted.filter("_alone").select(*columns).unionByName(contested)


def _assign(pairs: pd.DataFrame) -> pd.DataFrame:
    """Maximum-weight matching of one file's contested pairs; absent pairs weigh nothing and are dropped."""
    rows, cols = sorted(pairs["new_name"].unique()), sorted(pairs["old_name"].unique())
    n = max(len(rows), len(cols))
    gain = np.zeros((n, n))
    at_row, at_col = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
    i, j = pairs["new_name"].map(at_row).to_numpy(), pairs["old_name"].map(at_col).to_numpy()
    gain[i, j] = pairs["weight"]
    chosen = _best_columns(-gain)
    return pairs[chosen[i] == j]


def _best_columns(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest full assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    price, row_of = np.zeros(n), np.full(n, -1)
    for start in range(n):
        owner, column_before, reach = start, np.full(n, -1), np.full(n, np.inf)
        seen, last, spent = np.zeros(n, bool), -1, 0.0
        base = 0.0
        while True:
            step = cost[owner] - price - (0.0 if last < 0 else cost[owner, last] - price[last]) + base
            better = ~seen & (step < reach)
            reach[better], column_before[better] = step[better], last
            last = int(np.where(seen, np.inf, reach).argmin())
            base = spent = reach[last]
            seen[last] = True
            if row_of[last] < 0:
                break
            owner = row_of[last]
        price[seen] += reach[seen] - spent
        while last >= 0:
            before = column_before[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def schema_changes(profiles: DataFrame, matches: DataFrame, feed: str, seq: str) -> DataFrame:
    """ADDED, REMOVED, RENAMED and RETYPED fields of each file against the file before it (seq - 1).

    `matches` links fields of neighbouring files for ADDED, REMOVED and RENAMED. RETYPED looks further back, to the nearest earlier
    file in which the field has any value, with files between that may lack it; there a field is known by its role, or without one
    by its normalised name, and its set of types is compared. REMOVED carries the old name.
    """
    identity = F.when(F.col("role").isNotNull(), F.concat(F.lit("r:"), F.col("role"))).otherwise(F.concat(F.lit("n:"), normalised_name(F.col("name"))))
    files = profiles.select(feed, seq).distinct()
    last = profiles.groupBy(feed).agg(F.max(seq).alias("_last"), F.min(seq).alias("_first"))
    links = matches.select(feed, seq, "old_name", "new_name")
    added = profiles.join(links.select(feed, seq, F.col("new_name").alias("name")), [feed, seq, "name"], "left_anti").join(last, feed).filter(F.col(seq) > F.col("_first")).select(feed, seq, "name", F.lit("ADDED").alias("change_kind"))
    gone = profiles.join(links.select(feed, (F.col(seq) - 1).alias(seq), F.col("old_name").alias("name")), [feed, seq, "name"], "left_anti").join(last, feed).filter(F.col(seq) < F.col("_last"))
    removed = gone.select(feed, (F.col(seq) + 1).alias(seq), "name", F.lit("REMOVED").alias("change_kind"))
    renamed = links.filter(F.col("old_name") != F.col("new_name")).select(feed, seq, F.col("new_name").alias("name"), F.lit("RENAMED").alias("change_kind"))
    line = Window.partitionBy(feed, "_id").orderBy(seq)
    typed = profiles.filter(F.size("types") > 0).withColumn("_id", identity).withColumn("_old", F.lag("types").over(line))
    retyped = typed.filter(F.col("_old").isNotNull() & (F.col("_old") != F.col("types"))).select(feed, seq, "name", F.lit("RETYPED").alias("change_kind"))
    return added.unionByName(removed).unionByName(renamed).unionByName(retyped).withColumnRenamed("name", "field_name").select(feed, seq, "field_name", "change_kind").distinct()


def unified_roles(fields: DataFrame, roles: DataFrame, record: str, feed: str, seq: str, names: list[str]) -> DataFrame:
    """One row per record with a DOUBLE per role; values that are no number, or an object with one `value`, are read as NULL or that value."""
    inner = F.coalesce(F.expr("try_cast(value as double)"), F.expr("try_cast(get_json_object(value, '$.value') as double)"))
    joined = fields.join(roles, [feed, seq, "name"], "left").withColumn("_x", inner)
    return joined.groupBy(record, feed, seq).agg(*[F.max(F.when(F.col("role") == r, F.col("_x"))).alias(r) for r in names])


def field_identities(profiles: DataFrame, matches: DataFrame, feed: str, seq: str) -> DataFrame:
    """(feed, name, field): the identity, in all files of a feed, of every field name that plays no role.

    Names that agree when normalised are one field. Undeclared matches join such names to one field, heaviest first, unless
    the two are found in one file of the feed. The field is named after its normalised name of the earliest file. One
    feed's distinct names and links reach a grouped function, however many files there are.
    """
    norm = normalised_name
    plain = profiles.filter("role is null")
    names = plain.select(feed, norm(F.col("name")).alias("_a"), F.lit(None).cast("string").alias("_b"), F.lit(0.0).alias("_w"), seq).groupBy(feed, "_a", "_b", "_w").agg(F.array_sort(F.collect_set(seq)).alias("_files"))
    links = matches.filter("not declared").select(feed, norm(F.col("old_name")).alias("_a"), norm(F.col("new_name")).alias("_b"), "weight").groupBy(feed, "_a", "_b").agg(F.max("weight").alias("_w"))
    both = names.unionByName(links, allowMissingColumns=True)
    kind = profiles.schema[feed].dataType.simpleString()
    found = both.groupBy(feed).applyInPandas(lambda rows: _joined_names(rows, feed), f"`{feed}` {kind}, _norm string, field string")
    return plain.select(feed, "name").distinct().withColumn("_norm", norm(F.col("name"))).join(found, [feed, "_norm"]).select(feed, "name", "field")


def _joined_names(rows: pd.DataFrame, feed: str) -> pd.DataFrame:
    """The field of each normalised name of one feed; rows without _b are names with their files, the others links."""
    own = rows[rows["_b"].isna()]
    files = {a: set(f) for a, f in zip(own["_a"], own["_files"])}
    members = {a: [a] for a in files}
    first = {a: (min(f), a) for a, f in files.items()}
    head = {a: a for a in files}
    for a, b, _ in sorted(rows[rows["_b"].notna()][["_a", "_b", "_w"]].itertuples(index=False), key=lambda x: (-x[2], x[0], x[1])):
        a, b = head[a], head[b]
        if a == b or files[a] & files[b]:
            continue
        files[a] |= files.pop(b)
        for x in members[b]:
            head[x] = a
        members[a] += members.pop(b)
        first[a] = min(first[a], first.pop(b))
    names = sorted(head)
    return pd.DataFrame({feed: [rows[feed].iloc[0]] * len(names), "_norm": names, "field": [first[head[x]][1] for x in names]})


def unified_fields(records: DataFrame, fields: DataFrame, roles: DataFrame, identities: DataFrame, record: str, feed: str, seq: str, payload: str) -> DataFrame:
    """Every field of every record under its identity: record, feed, seq, field_kind (role, field, payload), field, name, type, value.

    A field that plays a role goes by the role (by each, if it plays several), any other by its identity in the feed; name, type
    and value (as text) are as in the file, so nulls have a row too. A record without fields has one row of kind payload
    with the payload as value; repeated records count like others.
    """
    keys = [record, feed, seq]
    placed = fields.join(roles, [feed, seq, "name"], "left").join(identities, [feed, "name"], "left")
    known = placed.select(*keys, F.when(F.col("role").isNotNull(), "role").otherwise("field").alias("field_kind"), F.coalesce("role", "field").alias("field"), "name", "type", "value")
    shape = F.schema_of_variant(F.try_parse_json(payload))
    bare = records.filter(~F.coalesce(shape.startswith("OBJECT") & (shape != "OBJECT<>"), F.lit(False)))
    nothing = F.lit(None).cast("string")
    return known.unionByName(bare.select(*keys, F.lit("payload").alias("field_kind"), nothing.alias("field"), nothing.alias("name"), nothing.alias("type"), F.col(payload).alias("value")))
