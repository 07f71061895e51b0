"""A few keys that hold most rows: find them by a mergeable sketch, treat them apart, union the results.

Heavy keys are found with weighted Misra-Gries summaries (one per partition, bounded number of
counters, summed afterwards). Rows of heavy keys meet the other side of a join by broadcast and are
aggregated in salted parts; all other keys take the ordinary shuffle. The sketch decides only the
route of a row, never a result: results are exact for any set of keys it returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is heavy if it has at least this share of all weight; so at most twice 1 / SHARE keys are.
SHARE = 1 / 256
#: Rows of a join's other side that may be broadcast for the heavy keys; beyond it the rows are salted.
BROADCAST_ROWS = 200_000
SALTS = 32


def _misra_gries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total, schema = None, 0, None
        for batch in batches:
            schema = pa.schema([pa.field(f.name, f.type) for f in batch.schema])
            total += int(pa.compute.sum(batch.column("_w")).as_py() or 0)
            now = pa.Table.from_batches([batch]).cast(schema)
            if kept is not None:
                now = pa.concat_tables([kept, now])
            keys = [n for n in schema.names if n != "_w"]
            kept = now.group_by(keys).aggregate([("_w", "sum")]).rename_columns([*keys, "_w"]).select(schema.names)
            if kept.num_rows > counters:
                w = kept.column("_w").to_numpy()
                floor = int(np.partition(w, -counters - 1)[-counters - 1])
                left = w - floor
                keep = left > 0
                kept = kept.set_column(schema.get_field_index("_w"), schema.field("_w"), pa.array(left, pa.int64())).filter(pa.array(keep))
        if kept is not None and kept.num_rows:
            out = kept.cast(schema).append_column("_t", pa.array([total] + [0] * (kept.num_rows - 1), pa.int64()))
            yield from out.combine_chunks().to_batches()

    return run


def heavy_keys(df: DataFrame, keys: list[str], weight: Column | None = None, share: float = SHARE) -> DataFrame:
    """The distinct keys that may hold at least `share` of all weight (1 a row unless given).

    Every key with that share is returned; at most 2 / share keys are. Null keys count as keys;
    null or negative weights count as 0. An empty table gives no rows.
    """
    counters = int(np.ceil(2 / share))
    w = F.greatest(F.coalesce((F.lit(1) if weight is None else weight).cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(*keys, w.alias("_w")).filter("_w > 0")
    schema = T.StructType([*rows.schema.fields, T.StructField("_t", T.LongType())])
    parts = rows.mapInArrow(_misra_gries(counters), schema)
    # Kept, as the total comes with the summaries: at most 2 / share rows a partition, so the rows are read once for both.
    summed = parts.groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_t").alias("_t")).persist()
    total = summed.agg(F.sum("_t").alias("_all"))
    return summed.crossJoin(F.broadcast(total)).filter(F.col("_w") >= F.col("_all") * F.lit(share / 2)).select(*keys)


def known(heavy: DataFrame) -> DataFrame:
    """The heavy keys as a local table: bounded by 2 / share rows, read once, broadcast often."""
    rows = heavy.collect()
    return heavy.sparkSession.createDataFrame(rows, heavy.schema)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_h_{k}"])
    return cond


def split(df: DataFrame, keys: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of heavy keys and the others; null keys match null keys."""
    h = F.broadcast(heavy.select([F.col(k).alias(f"_h_{k}") for k in keys]))
    return df.join(h, _same(df, h, keys), "left_semi"), df.join(h, _same(df, h, keys), "left_anti")


def skew_aggregate(df: DataFrame, keys: list[str], partial: list[Column], final: list[Column], heavy: DataFrame, salts: int = SALTS) -> DataFrame:
    """Aggregate per key without a few long tasks.

    `partial` are aggregates with names, `final` combine the partial ones by those names. Rows of
    heavy keys are aggregated by key and salt first, then by key; other rows at once by key. Null
    keys form one group; an empty table gives no rows; extra columns are ignored. Own columns begin
    with __heavy.
    """
    hot, cold = split(df, keys, heavy)
    # The salt is the row's place, not its content, so equal rows spread too; sums don't depend on it.
    salted = hot.withColumn("__heavy_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    hot_done = salted.groupBy(*keys, "__heavy_salt").agg(*partial).groupBy(*keys).agg(*final)
    cold_done = cold.groupBy(*keys).agg(*partial).groupBy(*keys).agg(*final)
    return hot_done.unionByName(cold_done)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on equal keys where `left` holds a few very frequent keys.

    The right rows of heavy keys are broadcast if there are at most BROADCAST_ROWS of them, else
    repeated once a salt against salted left rows. `how` is inner or left. Null keys match nothing;
    right columns other than the keys must not clash with left ones. Rows on both sides repeat as
    in an ordinary join.
    """
    hot, cold = split(left, keys, heavy)
    right_hot, right_cold = split(right, keys, heavy)
    few = right_hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        hot_done = hot.join(F.broadcast(right_hot), keys, how)
    else:
        salted = hot.withColumn("__heavy_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        spread = right_hot.withColumn("__heavy_salt", F.explode(F.array([F.lit(i) for i in range(salts)])))
        hot_done = salted.join(spread, [*keys, "__heavy_salt"], how).drop("__heavy_salt")
    return hot_done.unionByName(cold.join(right_cold, keys, how))
