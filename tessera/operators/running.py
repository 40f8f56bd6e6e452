"""Running totals of groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import checkpoint, shuffle_partitions


def running_before(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, order, before``: the sum of the whole numbers ``value`` of the rows of a key that come before by ``order``.

    ``key`` and ``order`` together are distinct; null keys are left out. Rows are partitioned by ranges of both, so a key of any size spreads over
    tasks; each partition adds up its own part of a key, and the parts' totals, at most one a partition for each key,
    give what is to be added."""
    named = rows.where(F.col(key).isNotNull()).select(key, order, F.col(value).cast("long").alias("_v"))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k, v = b.column(0), b.column(2).to_numpy()
            new = np.concatenate(([k[0].as_py() != last], pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).to_numpy(zero_copy_only=False))).astype(bool)
            sums = np.cumsum(v) - v
            first = np.nonzero(new)[0]
            base = np.concatenate(([-total], sums[first]))
            before = sums - base[np.cumsum(new)]
            last, total = k[-1].as_py(), int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(before), pa.array(np.full(len(v), part, np.int32))], [key, order, "_v", "_local", "_part"])

    spread = named.repartitionByRange(shuffle_partitions(rows.sparkSession), key, order).sortWithinPartitions(key, order)
    placed = checkpoint(spread.mapInArrow(local, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, _v long, _local long, _part int"))
    totals = placed.groupBy(key, "_part").agg(F.sum("_v").alias("_n"))
    shifts = totals.select(key, "_part", (F.sum("_n").over(W.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_shift"))
    return placed.join(shifts, [key, "_part"]).select(key, order, (F.col("_local") + F.col("_shift")).alias("before"))
