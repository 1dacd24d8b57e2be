"""The best N items of every group by one global sort, however large a group is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def top_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """The first `n` rows of each group by `score` descending, then `item` ascending: groups, item, score, `position` from 1.

    Rows are range-partitioned and sorted by group, score and item, so a large group spreads over neighbouring
    partitions. Each partition numbers its rows within their group, passes on those numbered up to `n` (no later one can
    be among the first `n`), and counts the rows of its last group, the only one that may go on in the next partition. The
    counts are prefix-summed over the partitions, which gives exact positions.

    NULL and NaN scores are left out; NULL groups are groups, NULL items come first. Rows that agree in group, score and
    item are all counted. An empty table gives no rows; other columns are dropped.
    """
    kept = df.select(*[F.col(g).alias(g) for g in groups], F.col(item).alias(item), F.col(score).cast("double").alias(score)).filter(F.col(score).isNotNull() & ~F.isnan(score))
    order = [*[F.col(g).asc() for g in groups], F.col(score).desc(), F.col(item).asc()]
    same = F.xxhash64(*[x for g in groups for x in (F.col(g).isNull(), F.col(g))])
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_group", same)
    fields = [T.StructField(f.name, f.dataType, True) for f in ordered.schema.fields]
    schema = T.StructType([*fields, T.StructField("_place", T.LongType()), T.StructField("_count", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, seen, last = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_group").to_numpy()
            change = np.concatenate(([group[0] != last], group[1:] != group[:-1]))
            index = np.arange(len(group))
            place = index - np.maximum.accumulate(np.where(change, index, 0)) + 1
            if not change[0]:
                place[: change.argmax() if change.any() else len(group)] += seen
            last, seen, end = group[-1], int(place[-1]), batch.slice(batch.num_rows - 1)
            first = np.flatnonzero(place <= n)
            taken = batch.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(place[first]), pa.nulls(len(first), pa.int64())], schema.fieldNames())
        if end is not None:
            yield pa.RecordBatch.from_arrays([*end.columns, pa.nulls(1, pa.int64()), pa.array([seen], pa.int64())], schema.fieldNames())

    local = ordered.mapInArrow(number, schema)
    parts_before = Window.partitionBy(*groups).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_count").over(parts_before), F.lit(0))
    return local.withColumn("position", before + F.col("_place")).filter(F.col("position") <= n).drop("_part", "_group", "_place", "_count")
