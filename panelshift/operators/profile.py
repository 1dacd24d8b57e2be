"""Column profile of Parquet tables: footers first, dictionaries next, rows only where these don't settle it.

1. A listing of the files gives (path, length) without reading content; tasks read the footers, one row per row group.
   Where a row group's statistics show a single value of each grouping column, its rows all belong to that group.
2. Per row group and column, exact NULL counts and extrema are taken from the footer when they are present and the row
   group has one group. A chunk of NULLs only is known from them and isn't read; sums, fractions and NaN are in no statistics, so other
   chunks are read as dictionaries: patterns, ranges and fractions are tested on the entries, which are the distinct values too.
3. Row identifiers (and, in mixed row groups, the grouping columns) are read only when an entry, a NULL or an extremum
   shows that an offending row is there.

Everything that leaves a task is an aggregate, a distinct value or an offending row; Spark merges them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelshift.session import cut_lineage

CHUNKS = "path string, row_group int, n_rows long, one_group boolean, group_values array<string>, null_counts array<long>, lows array<double>, highs array<double>"
#: Row groups that a task reads, once there are more than two for every core.
CHUNKS_A_TASK = 8
FACTS = "group_values array<string>, kind string, column_name string, finding string, row_id long, text_value string, n long, nulls long, sound long, total double, lo double, hi double"


@dataclass(frozen=True)
class Checks:
    """What is tested: `patterns` (column -> regular expression for the whole value), `ranges` (column -> least, most)."""

    groups: tuple[str, ...]
    row_id: str
    patterns: dict[str, str]
    ranges: dict[str, tuple[float, float]]

    @property
    def columns(self) -> list[str]:
        return [*self.patterns, *self.ranges]


def _open(path: str, **options):
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    if path.startswith("file:") or "://" not in path:
        return pq.ParquetFile(re.sub(r"^file:/*", "/", unquote(path)), **options)
    system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(inner), **options)


def footers(spark: SparkSession, path: str, checks: Checks) -> DataFrame:
    """One row per row group: its rows, its group if it has but one, and NULL counts and extrema per checked column (NULL where not known)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name in batch["path"]:
                meta = _open(name).metadata
                at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    stats = {c: group.column(at[c]).statistics for c in [*checks.groups, *checks.columns]}
                    single = all(s is not None and s.has_min_max and s.has_null_count and s.null_count == 0 and s.min == s.max for s in (stats[c] for c in checks.groups))
                    nulls = [s.null_count if (s := stats[c]) is not None and s.has_null_count else None for c in checks.columns]
                    ends = [(float(s.min), float(s.max)) if c in checks.ranges and (s := stats[c]) is not None and s.has_min_max else (None, None) for c in checks.columns]
                    out.append((name, g, group.num_rows, single, [str(stats[c].min) for c in checks.groups] if single else None, nulls, [a for a, _ in ends], [b for _, b in ends]))
            yield pd.DataFrame(out, columns=["path", "row_group", "n_rows", "one_group", "group_values", "null_counts", "lows", "highs"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    return files.mapInPandas(read, CHUNKS)


def chunk_facts(chunks: DataFrame, checks: Checks) -> DataFrame:
    """Facts of each row group: 'stat' per group and column, 'value' per distinct value, 'row' per offending row and finding.

    NULL groups are groups too. NaN counts as out of range. A row may have several findings.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in batch.itertuples(index=False):
                yield _facts_of(chunk, checks)

    known = cut_lineage(chunks.filter("n_rows > 0"))
    parts = max(1, min(known.count(), max(2 * known.sparkSession.sparkContext.defaultParallelism, known.count() // CHUNKS_A_TASK)))
    return known.repartition(parts, F.xxhash64("path", "row_group")).mapInPandas(read, FACTS)


def _facts_of(chunk, checks: Checks) -> pd.DataFrame:
    import numpy as np

    file = _open(chunk.path, read_dictionary=list(checks.patterns))
    out: list[pd.DataFrame] = []
    group_of, labels = np.zeros(chunk.n_rows, int), [list(chunk.group_values)] if chunk.one_group else []
    if not chunk.one_group:
        read = file.read_row_group(chunk.row_group, columns=list(checks.groups))
        keys = pd.MultiIndex.from_arrays([read.column(c).cast("string").to_numpy(zero_copy_only=False) for c in checks.groups])
        group_of, unique = pd.factorize(keys, use_na_sentinel=False)
        labels = [[None if pd.isna(x) else x for x in u] for u in unique]
    sizes = np.bincount(group_of, minlength=len(labels))
    ids = None

    def rows(mask, column: str, finding: str) -> None:
        nonlocal ids
        if mask.any():
            if ids is None:
                ids = file.read_row_group(chunk.row_group, columns=[checks.row_id]).column(0).to_numpy()
            out.append(pd.DataFrame({"group_values": [labels[g] for g in group_of[mask]], "kind": "row", "column_name": column, "finding": finding, "row_id": ids[mask]}))

    for i, column in enumerate(checks.columns):
        known_nulls, n = chunk.null_counts[i], chunk.n_rows
        low, high = chunk.lows[i], chunk.highs[i]
        if known_nulls == n:  # the footer tells all; extrema don't tell whether a NaN is there
            null, entries, codes = np.ones(n, bool), np.array([], dtype=object if column in checks.patterns else float), np.zeros(n, np.int64)
        else:
            data = file.read_row_group(chunk.row_group, columns=[column]).column(0).combine_chunks()
            data = data.chunk(0) if hasattr(data, "chunk") else data
            null = np.zeros(n, bool) if known_nulls == 0 else np.asarray(data.is_null())
            coded = data if column in checks.patterns else data.cast("float64").dictionary_encode()
            entries = np.array(coded.dictionary.to_pylist(), dtype=object if column in checks.patterns else float)
            codes = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        there = ~null
        rows(null, column, "NULL_VALUE")
        stat = {"kind": "stat", "column_name": column, "n": sizes, "nulls": np.bincount(group_of[null], minlength=len(labels))}

        def marked(bad_entry) -> np.ndarray:
            return bad_entry[codes] & there if len(bad_entry) and bad_entry.any() else np.zeros(n, bool)

        if column in checks.patterns:
            whole = re.compile(checks.patterns[column])
            rows(marked(np.array([whole.fullmatch(x) is None for x in entries], bool)), column, "PATTERN")
        else:
            least, most = checks.ranges[column]
            outside_entry, broken_entry = ~((entries >= least) & (entries <= most)), np.isfinite(entries) & (entries != np.floor(entries))
            rows(marked(outside_entry), column, "OUT_OF_RANGE")
            rows(marked(broken_entry), column, "NOT_INTEGER")
            ok = there & ~marked(outside_entry | broken_entry)
            x = entries[codes] if len(entries) else np.zeros(n)
            stat |= {"sound": np.bincount(group_of[ok], minlength=len(labels)), "total": np.bincount(group_of[ok], weights=x[ok], minlength=len(labels))}
            if chunk.one_group and low is not None:
                stat |= {"lo": np.array([low]), "hi": np.array([high])}
            else:
                stat |= {k: pd.Series(x[there]).groupby(group_of[there]).agg(f).reindex(range(len(labels))).to_numpy() for k, f in (("lo", "min"), ("hi", "max"))}
        used = np.unique(group_of[there] * max(len(entries), 1) + codes[there])
        values, at = entries[used % max(len(entries), 1)], used // max(len(entries), 1)
        if column in checks.ranges:
            values = np.array([repr(float(v)) for v in values], dtype=object)
        out.append(pd.DataFrame({"group_values": labels} | stat))
        out.append(pd.DataFrame({"group_values": [labels[g] for g in at], "kind": "value", "column_name": column, "text_value": values}))
    names = [x.split()[0] for x in FACTS.split(", ")]
    whole = pd.concat([x for x in out if len(x)] or [pd.DataFrame(columns=names)], ignore_index=True).reindex(columns=names)
    kinds = {"row_id": "Int64", "n": "Int64", "nulls": "Int64", "sound": "Int64", "total": "float64", "lo": "float64", "hi": "float64"}
    return whole.astype({c: kinds.get(c, object) for c in names})


def column_profile(facts: DataFrame) -> DataFrame:
    """Per group and column: rows, nulls, distinct values, sound values, mean of the sound values, extrema."""
    distinct = facts.filter("kind = 'value'").groupBy("group_values", "column_name", "text_value").agg(F.lit(1).alias("one")).groupBy("group_values", "column_name").agg(F.count("*").alias("distinct_values"))
    stats = facts.filter("kind = 'stat'").groupBy("group_values", "column_name").agg(
        F.sum("n").alias("n_rows"), F.sum("nulls").alias("null_rows"), F.sum("sound").alias("sound_rows"), F.sum("total").alias("sound_total"), F.min("lo").alias("lowest"), F.max("hi").alias("highest")
    )
    return stats.join(distinct, ["group_values", "column_name"], "left").select(
        "group_values", "column_name", "n_rows", "null_rows", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        "sound_rows", F.try_divide(F.col("sound_total"), F.col("sound_rows")).alias("sound_mean"), "lowest", "highest",
    )


def load_shifts(profile: DataFrame, scope: str, load: str, null_share: float = 0.03, distinct_ratio: float = 2.0, mean_change: float = 60.0) -> DataFrame:
    """Findings of a load against the load before it: NULL_SHIFT, DISTINCT_SHIFT, MEAN_SHIFT. The first load has none."""
    before = Window.partitionBy(scope, "column_name").orderBy(load)
    columns = {"null_share": F.try_divide(F.col("null_rows").cast("double"), F.col("n_rows")), "distinct_values": F.col("distinct_values"), "sound_mean": F.col("sound_mean")}
    both = profile.withColumns(columns).withColumns({f"old_{c}": F.lag(c).over(before) for c in columns})
    cases = [
        ("NULL_SHIFT", F.abs(F.col("null_share") - F.col("old_null_share")) > null_share),
        ("DISTINCT_SHIFT", (F.col("distinct_values") > distinct_ratio * F.col("old_distinct_values")) | (F.col("distinct_values") * distinct_ratio < F.col("old_distinct_values"))),
        ("MEAN_SHIFT", F.abs(F.col("sound_mean") - F.col("old_sound_mean")) > mean_change),
    ]
    found = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in cases]))
    return both.select(scope, load, "column_name", F.explode(found).alias("finding"))
