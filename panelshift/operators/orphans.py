"""References without an entry in their parent table, by a broadcast Bloom filter and an exact join of the rest.

The filter's size is fixed by the number of parent keys up to MAX_BITS (32 MB), whatever the tables' size; a fuller filter
only sends more references to the exact join, never a wrong answer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelshift.operators.bits import bit_words
from panelshift.session import cut_lineage

MAX_BITS, PROBES = 2**28, 4


class BloomFilter:
    """A bit array over 64-bit hashes of keys; `maybe(columns)` is false only for keys that are certainly not in it."""

    def __init__(self, keys: DataFrame, columns: list[str], bits_per_key: int = 12):
        n = max(1, keys.count())
        self.bits = min(MAX_BITS, 2 ** max(16, math.ceil(math.log2(n * bits_per_key))))
        words = bit_words(keys.select(F.explode(self._positions(columns)).alias("_p")), "_p", self.bits)
        self._words = keys.sparkSession.sparkContext.broadcast(words)

    def _positions(self, columns: list[str]) -> Column:
        first, second = F.xxhash64(F.lit("a"), *columns), F.xxhash64(F.lit("b"), *columns)
        mask = F.lit(self.bits - 1).cast("long")
        return F.array(*[F.shiftright(first, i).bitwiseXOR(F.shiftright(second, 2 * i + 1)).bitwiseAND(mask) for i in range(PROBES)])

    def maybe(self, columns: list[str]) -> Column:
        words = self._words

        @F.pandas_udf("boolean")
        def test(positions: pd.Series) -> pd.Series:
            if not len(positions):
                return pd.Series([], dtype=bool)
            p = np.stack(positions.to_numpy()).astype(np.int64)
            return pd.Series(((words.value[p >> 6] >> (p & 63)) & 1).all(axis=1))

        return test(self._positions(columns))


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct references (ref_table, ref_field, key_kind, release_id, ref_key) that have no parent (key_kind, release_id, key) of their release.

    `orphan_kind` tells where the key has a parent: NEVER, LATER, EARLIER or GAP (both). References with a NULL key or
    release are left out; so are parents without a key (NULL or ''). Repeated rows on either side change nothing. A reference whose key
    the filter of all releases does not hold is NEVER at once; the others are joined exactly.
    """
    refs = references.filter(F.col("ref_key").isNotNull() & F.col("release_id").isNotNull()).select("ref_table", "ref_field", "key_kind", "release_id", "ref_key").distinct()
    known = cut_lineage(parents.filter((F.col("key") != "") & F.col("release_id").isNotNull()).groupBy("key_kind", "key").agg(F.collect_set("release_id").alias("releases")))
    bloom = BloomFilter(known, ["key_kind", "key"])
    tested = cut_lineage(cut_lineage(refs).withColumn("_maybe", bloom.maybe(["key_kind", "ref_key"])))  # stored before and after, so that each distinct key is tested once
    never = tested.filter(~F.col("_maybe")).select("ref_table", "ref_field", "release_id", "ref_key", F.lit("NEVER").alias("orphan_kind"))
    rest = tested.filter("_maybe").join(known.withColumnRenamed("key", "ref_key"), ["key_kind", "ref_key"], "left")
    earlier, later = F.array_min("releases") < F.col("release_id"), F.array_max("releases") > F.col("release_id")
    kind = F.when(F.col("releases").isNull(), "NEVER").when(F.array_contains("releases", F.col("release_id")), None).when(earlier & later, "GAP").when(earlier, "EARLIER").otherwise("LATER")
    verified = rest.withColumn("orphan_kind", kind).filter("orphan_kind is not null").select("ref_table", "ref_field", "release_id", "ref_key", "orphan_kind")
    return never.unionByName(verified)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan keys per table, field, release and kind."""
    return orphans.groupBy("ref_table", "ref_field", "release_id", "orphan_kind").agg(F.count("*").alias("orphan_keys"))
