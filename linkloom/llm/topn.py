"""The N highest rows of every group, also where one group holds a large share of all rows.

Exact counts part the groups: light ones go through an ordinary window, heavy ones are sorted by
ranges of group and order, salted so that equal rows spread too. Many tasks share a heavy group, each
range gives at most N rows of it, and a last window takes the first N of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Groups with more than this share of all rows are heavy; there are fewer than 1 / SHARE of them.
SHARE = 1 / 256
#: Ranges that the heavy groups are sorted into: as many as shuffles have partitions, or one for so many rows if these are more.
RANGE = 1_000_000


def _ranked(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__top_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__top_rank") <= n).drop("__top_rank")


def _first_rows(keys: list[str], n: int):
    """The first n rows of each group of a partition that is sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                col = table.column(k).combine_chunks()
                a, b = col[1:], col[:-1]
                new[1:] |= ~(pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False)))
            ends = lambda i: tuple(table.column(k)[i].as_py() for k in keys)  # noqa: B023, E731
            new[0] = ends(0) != last
            at = np.flatnonzero(new)
            start = np.zeros(batch.num_rows, np.int64)
            start[at] = at
            place = np.arange(batch.num_rows) - np.maximum.accumulate(start)
            if not new[0]:
                # The group of the batch before goes on.
                place[: at[0] if len(at) else batch.num_rows] += met
            last, met = ends(-1), int(place[-1]) + 1
            yield batch.filter(pa.array(place < n))

    return run


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, share: float = SHARE) -> DataFrame:
    """At most `n` rows of each group, first in `order`, with all their columns.

    `order` should be total; rows equal in it are equal in rank, and any of them may be given. Null
    keys form one group, nulls order as Spark orders them. Repeated rows each count. An empty table
    gives no rows. Columns may have any name
    but for those that begin with __top.
    """
    rows = df.count()
    # Fewer than 1 / share rows.
    hot = df.groupBy(*keys).agg(F.count("*").alias("__top_rows")).filter((F.col("__top_rows") > rows * share) & (F.col("__top_rows") > n)).collect()
    if not hot:
        return _ranked(df, keys, order, n)
    spark = df.sparkSession
    named = F.broadcast(spark.createDataFrame(hot, df.select(*keys, F.lit(0).cast("long").alias("__top_rows")).schema).select([F.col(k).alias(f"__top_h_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(named[f"__top_h_{k}"])
    cold = _ranked(df.join(named, same, "left_anti"), keys, order, n)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["__top_rows"] for r in hot) // RANGE))
    # The salt parts rows that are equal in order; within a range the order alone counts.
    salted = df.join(named, same, "left_semi").withColumn("__top_salt", F.pmod(F.monotonically_increasing_id(), F.lit(ranges)))
    ranged = salted.repartitionByRange(ranges, *keys, *order, "__top_salt").sortWithinPartitions(*keys, *order).drop("__top_salt")
    few = ranged.mapInArrow(_first_rows(keys, n), df.schema)
    return cold.unionByName(_ranked(few, keys, order, n))
