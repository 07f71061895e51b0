"""Running sums, ranks and exact order statistics without one task for all rows.

Rows are cut into blocks of the order; block totals are few and make the offsets, the running sum
within a block is an ordinary window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

BLOCK = 1 << 16
#: Blocks for orders by value.
PARTS = 1024


def prefix_sum(df: DataFrame, group: list[str], pos: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Sum of `value` over the rows of the group before each row, by whole-number positions.

    Positions should be dense, as a block holds `block` of them. Null values count 0. Rows of equal
    position get any order, so positions should be unique in a group. Own columns begin with __sum.
    """
    rows = df.withColumn("__sum_v", F.coalesce(value, F.lit(0))).withColumn("__sum_blk", F.floor(F.col(pos) / block))
    totals = rows.groupBy(*group, "__sum_blk").agg(F.sum("__sum_v").alias("__sum_t"))
    before = totals.withColumn("__sum_off", F.coalesce(F.sum("__sum_t").over(W.partitionBy(*group).orderBy("__sum_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__sum_t")
    inside = F.coalesce(F.sum("__sum_v").over(W.partitionBy(*group, "__sum_blk").orderBy(pos).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__sum_in", inside).join(before, [*group, "__sum_blk"]).withColumn(name, F.col("__sum_off") + F.col("__sum_in")).drop("__sum_v", "__sum_blk", "__sum_off", "__sum_in")


def value_blocks(df: DataFrame, value: str, parts: int = PARTS) -> DataFrame:
    """_blk: number of the range of values that a row falls into, from approximate quantiles; at most `parts`."""
    cuts = df.stat.approxQuantile(value, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn("_blk", F.lit(0))
    edges = F.array(*[F.lit(c).cast("double") for c in cuts])
    # width_bucket by a sorted array of edges: how many lie at or below the value.
    return df.withColumn("_blk", F.size(F.filter(edges, lambda e: e <= F.col(value))) if len(cuts) < 8 else _search(edges, F.col(value).cast("double"), len(cuts)))


def _search(edges: Column, x: Column, n: int) -> Column:
    """Binary search: the number of edges <= x. The steps are folded over, as nested CASEs would double with each step."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    met = lambda lo, step: (lo + step <= n) & (F.get(edges, F.least(lo + step, F.lit(n)) - 1) <= x)
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(met(lo, step), lo + step).otherwise(lo))


def row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place (from 1) in a total order, sorted by ranges; no task sees all rows.

    Own columns begin with __num. The ranges are written once, so that all that follows sees the same.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__num_part", F.spark_partition_id()))
    # One row a range.
    before = ranged.groupBy("__num_part").agg(F.count("*").alias("__num_c")).withColumn("__num_off", F.coalesce(F.sum("__num_c").over(W.orderBy("__num_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__num_c")
    place = F.row_number().over(W.partitionBy("__num_part").orderBy(*order))
    return ranged.withColumn("__num_in", place).join(F.broadcast(before), "__num_part").withColumn(name, F.col("__num_off") + F.col("__num_in")).drop("__num_part", "__num_in", "__num_off")


def rank_value(df: DataFrame, value: str, ranks: list[int], n: int) -> dict[int, float]:
    """Exact values at 0-based ranks of the non-null values, n in number.

    An approximate quantile is a candidate; the values below and equal to it are counted, which tells
    whether it is the one or on which side of it to go on, among some thousandth of the values.
    """
    out: dict[int, float] = {}
    x = F.col(value)
    for r in ranks:
        rows, left, at = df.filter(x.isNotNull()), n, r
        while True:
            v = rows.stat.approxQuantile(value, [(at + 0.5) / left], 1e-3)[0]
            below, equal = rows.agg(F.count_if(x < v), F.count_if(x == v)).first()
            if below <= at < below + equal:
                break
            if at < below:
                rows, left = rows.filter(x < v), below
            else:
                rows, left, at = rows.filter(x > v), left - below - equal, at - below - equal
        out[r] = float(v)
    return out


def median(df: DataFrame, value: str) -> float | None:
    """Exact median; the mean of the middle two for an even number. None for no values."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    n = rows.count()
    if not n:
        return None
    mid = rank_value(rows, "_x", sorted({(n - 1) // 2, n // 2}), n)
    return sum(mid.values()) / len(mid)


def group_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the exact median of each group, the mean of the middle two for an even number.

    Null values don't count and groups without others are left out. Rows are numbered by ranges of
    key and value, so a group of any size is dealt to many tasks. Keys must not be null.
    """
    rows = row_numbers(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__num_v")), [*[F.col(k) for k in keys], F.col("__num_v")], "__num_at")
    per = rows.groupBy(*keys).agg(F.min("__num_at").alias("__num_lo"), F.max("__num_at").alias("__num_hi"))
    twice = F.col("__num_lo") + F.col("__num_hi")
    mid = (F.col("__num_at") == F.floor(twice / 2)) | (F.col("__num_at") == F.ceil(twice / 2))
    return rows.join(per, keys).filter(mid).groupBy(*keys).agg(F.avg("__num_v").alias("median"))


def element_at_share(df: DataFrame, value: str, num: int = 1, den: int = 10) -> float | None:
    """The sorted value at place n * num div den: an element, not an interpolation."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    n = rows.count()
    return rank_value(rows, "_x", [min(n - 1, n * num // den)], n)[min(n - 1, n * num // den)] if n else None


def mad_bounds(df: DataFrame, value: str, threshold: float, scale: float) -> tuple[float, float] | None:
    """median -+ threshold / scale * MAD."""
    m = median(df, value)
    if m is None:
        return None
    dev = df.filter(F.col(value).isNotNull()).select(F.abs(F.col(value).cast("double") - F.lit(m)).alias("_d"))
    mad = median(dev, "_d")
    return m - threshold / scale * mad, m + threshold / scale * mad


def l50(df: DataFrame, value: str) -> DataFrame:
    """(l50, n50, total): the length at which the descending running sum first exceeds total div 2, and its rank.

    Equal lengths are interchangeable, so lengths are counted first. Null lengths are left out.
    """
    by_len = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("len")).agg(F.count("*").alias("n"))
    blocks = value_blocks(by_len, "len").withColumn("_s", F.col("len") * F.col("n"))
    totals = blocks.groupBy("_blk").agg(F.sum("_s").alias("_ts"), F.sum("n").alias("_tn"))
    w = W.orderBy(F.desc("_blk")).rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    offs = totals.select("_blk", F.coalesce(F.sum("_ts").over(w), F.lit(0)).alias("_os"), F.coalesce(F.sum("_tn").over(w), F.lit(0)).alias("_on"), F.sum("_ts").over(all_).alias("total"))
    inner = W.partitionBy("_blk").orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, 0)
    run = blocks.join(offs, "_blk").withColumn("_cs", F.col("_os") + F.sum("_s").over(inner)).withColumn("_cn", F.col("_on") + F.sum("n").over(inner))
    half = F.expr("total div 2")
    over = run.filter(F.col("_cs") > half)
    # Within equal lengths the rank at which half is passed.
    need = F.expr("(total div 2 - (_cs - _s)) div len + 1")
    return over.agg(F.max_by(F.struct(F.col("len").alias("l50"), (F.col("_cn") - F.col("n") + need).alias("n50"), "total"), "len").alias("r")).select("r.l50", "r.n50", "r.total").filter("l50 is not null")
