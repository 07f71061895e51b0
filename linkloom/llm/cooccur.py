"""Items that appear together in a basket, and how far that exceeds chance.

Pairs of item numbers are packed into 64-bit codes, sorted in runs and merged, and run lengths are
the counts. Items that cannot reach the wanted count or lift are dropped first, which loses no
case. Baskets that are too large to list their pairs are met by an exact detour: see `pair_counts`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import heavy

#: Baskets with more items (after pruning) than this take the detour.
DIRECT = 1000
#: Item numbers are counted within so many hash buckets, so that no task numbers all of them.
BUCKETS = 1024
#: Codes held by a task before it sorts them into a run.
RUN = 1 << 21

CODES = "code long, cnt long"


def numbered(items: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Distinct rows `items` with a dense number _id < 2^32, the same in every run."""
    hashed = items.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # One row a bucket: at most `buckets` rows in the window over all.
    before = hashed.groupBy("_b").count().withColumn("_off", F.sum("count").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("_b", F.coalesce("_off", F.lit(0)).alias("_off"))
    place = F.row_number().over(W.partitionBy("_b").orderBy(*keys))
    return hashed.withColumn("_place", place).join(F.broadcast(before), "_b").withColumn("_id", F.col("_off") + F.col("_place") - 1).drop("_b", "_place", "_off")


def _run_lengths(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        codes = np.sort(codes)
        at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        return codes[at], np.diff(np.r_[at, len(codes)])
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts[:0]


def _batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts.astype(np.int64), pa.int64())], ["code", "cnt"])


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed codes of the pairs in each basket, sorted and run-length counted by runs."""
    held, n = [], 0
    for batch in batches:
        for items in batch.column(0):
            ids = np.sort(items.values.to_numpy())
            if len(ids) < 2:
                continue
            a, b = np.triu_indices(len(ids), 1)
            held.append((ids[a] << 32) | ids[b])
            n += len(a)
            if n >= RUN:
                yield _batch(*_run_lengths(np.concatenate(held), None))
                held, n = [], 0
    if held:
        yield _batch(*_run_lengths(np.concatenate(held), None))


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum run lengths over a sorted stream; the last code of a batch waits for the next."""
    code, cnt = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            code, cnt = _run_lengths(np.r_[code, batch.column(0).to_numpy()], np.r_[cnt, batch.column(1).to_numpy()])
            if len(code) > 1:
                yield _batch(code[:-1], cnt[:-1])
            code, cnt = code[-1:], cnt[-1:]
    if len(code):
        yield _batch(code, cnt)


def counted(codes: DataFrame) -> DataFrame:
    """(code, cnt) with each code once: Spark's external sort spills and merges the runs."""
    return codes.repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs, CODES)


def pair_counts(df: DataFrame, scope: str, basket: str, item: str, min_count: int = 6, min_lift: float = 5.0, direct: int = DIRECT) -> DataFrame:
    """(scope, item_lo, item_hi, n_lo, n_hi, n_both, n_baskets, lift, odds_ratio) of pairs of items.

    A pair is given if both stand in at least `min_count` baskets of the scope and n_both * n_baskets
    >= min_lift * n_lo * n_hi. item_lo is the bytewise smaller name. odds_ratio has 0.5 added to each
    cell of the table. Rows with a null scope, basket or item are left out, repeated rows count once,
    other columns are ignored; an empty table gives no rows.

    n_both <= min(n_lo, n_hi), so items in fewer than min_count or more than n_baskets / min_lift
    baskets are in no case. Baskets with more than `direct` remaining items aren't listed pair by
    pair. A pair met in an ordinary basket gets its count in large ones from the two items' lists of
    large baskets. A pair met only in large ones shares at least min_count of them, so it is found in
    what remains of both lists without their min_count - 1 largest baskets (prefix filter).
    """
    # Read for baskets, for items and for their pairs.
    rows = df.select(F.col(scope).cast("string").alias("_s"), F.col(basket).cast("string").alias("_k"), F.col(item).cast("string").alias("_i")).dropna().distinct().persist()
    total = rows.select("_s", "_k").distinct().groupBy("_s").agg(F.count("*").alias("_baskets"))
    support = rows.groupBy("_s", "_i").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count).persist()
    # An item may stand in most baskets of its scope: the rows of such items meet their numbers by broadcast.
    often = support.filter(F.col("_n") > rows.count() * heavy.SHARE).select("_s", "_i")
    items = support.join(total, "_s").filter(F.col("_n") * F.lit(float(min_lift)) <= F.col("_baskets"))
    items = numbered(items, ["_s", "_i"]).persist()
    kept = heavy.skew_join(rows, items.select("_s", "_i", "_id"), ["_s", "_i"], heavy.known(often))
    # A basket without a limit could be large: its size is counted before its items are listed.
    sizes = kept.groupBy("_s", "_k").agg(F.count("*").alias("_size")).filter("_size > 1")
    large = sizes.filter(F.col("_size") > direct)
    small = kept.join(sizes.filter(F.col("_size") <= direct).select("_s", "_k"), ["_s", "_k"])
    codes = small.groupBy("_s", "_k").agg(F.collect_list("_id").alias("_ids")).select("_ids").mapInArrow(_list_pairs, CODES)
    pairs = counted(codes).select("code", "cnt")
    if large.limit(1).count():
        pairs = _with_large(pairs, kept, large, min_count)
    pairs = pairs.filter(F.col("cnt") >= min_count).select(F.shiftrightunsigned("code", 32).alias("_a"), F.expr("code & 4294967295").alias("_b"), "cnt")
    left = items.select(F.col("_id").alias("_a"), F.col("_s").alias("scope"), F.col("_i").alias("_ia"), F.col("_n").alias("_na"), "_baskets")
    right = items.select(F.col("_id").alias("_b"), F.col("_i").alias("_ib"), F.col("_n").alias("_nb"))
    done = pairs.join(left, "_a").join(right, "_b").filter(F.col("cnt") * F.col("_baskets") >= F.lit(float(min_lift)) * F.col("_na") * F.col("_nb"))
    swap = F.col("_ia") > F.col("_ib")
    both, na, nb, n = (F.col(c).cast("double") for c in ("cnt", "_na", "_nb", "_baskets"))
    odds = ((both + 0.5) * (n - na - nb + both + 0.5)) / ((na - both + 0.5) * (nb - both + 0.5))
    return done.select(
        "scope", F.when(swap, F.col("_ib")).otherwise(F.col("_ia")).alias("item_lo"), F.when(swap, F.col("_ia")).otherwise(F.col("_ib")).alias("item_hi"),
        F.when(swap, F.col("_nb")).otherwise(F.col("_na")).alias("n_lo"), F.when(swap, F.col("_na")).otherwise(F.col("_nb")).alias("n_hi"),
        F.col("cnt").alias("n_both"), F.col("_baskets").alias("n_baskets"), (both * n / (na * nb)).alias("lift"), odds.alias("odds_ratio"),
    )


def _with_large(pairs: DataFrame, kept: DataFrame, large: DataFrame, min_count: int, blocks: int = 16) -> DataFrame:
    """Counts over ordinary and large baskets together."""
    # Numbers of the large baskets follow their size, smallest first, as the prefix filter needs.
    order = numbered(large.select("_s", "_k"), ["_s", "_k"]).withColumnRenamed("_id", "_bid").join(large, ["_s", "_k"])
    order = order.select("_s", "_k", (F.col("_size").cast("long") * F.lit(1 << 32) + F.col("_bid")).alias("_ord"))
    rows = kept.join(order, ["_s", "_k"]).select("_id", "_ord")
    lists = rows.groupBy("_id").agg(F.sort_array(F.collect_list("_ord")).alias("_large")).persist()
    prefix = lists.filter(F.size("_large") >= min_count).select("_id", F.explode(F.slice("_large", F.lit(1), F.size("_large") - (min_count - 1))).alias("_ord"))
    block = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    # Each basket's pairs are spread over blocks x blocks joins, so none of them meets in one task.
    cells = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = prefix.select(F.col("_id").alias("_x"), "_ord", block.alias("_p"), cells.alias("_q"))
    b = prefix.select(F.col("_id").alias("_y"), "_ord", block.alias("_q"), cells.alias("_p"))
    met = a.join(b, ["_ord", "_p", "_q"]).filter("_x < _y").select(F.expr("shiftleft(_x, 32) | _y").alias("code"), F.lit(0).cast("long").alias("cnt")).distinct()
    every = counted(pairs.unionByName(met)).withColumn("_x", F.shiftrightunsigned("code", 32)).withColumn("_y", F.expr("code & 4294967295"))
    every = every.join(lists.select(F.col("_id").alias("_x"), F.col("_large").alias("_lx")), "_x", "left").join(lists.select(F.col("_id").alias("_y"), F.col("_large").alias("_ly")), "_y", "left")
    more = F.coalesce(F.size(F.array_intersect("_lx", "_ly")), F.lit(0))
    return every.select("code", (F.col("cnt") + F.greatest(more, F.lit(0))).alias("cnt"))
