"""Confidence of orientations on a known chromosome, heatmaps of contacts, and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from .ordered import prefix_sum

#: Width of the cells by which points meet ranges.
CELL = 1 << 16


def points_in_ranges(points: DataFrame, ranges: DataFrame, key: str, pos: str, start: str = "start", end: str = "end", cell: int = CELL) -> DataFrame:
    """Points with the range they lie in (end included); of several the one that starts first, then ends first.

    Ranges are cut into cells and points look into their own, so it is an equal join. The ranges of
    a key should be few cells long; points outside all ranges have no row.
    """
    cells = ranges.withColumn("_c", F.explode(F.sequence(E.int_div(F.col(start), F.lit(cell)), E.int_div(F.col(end), F.lit(cell)))))
    own = points.withColumn("_c", E.int_div(F.col(pos), F.lit(cell))).withColumn("_id", F.monotonically_increasing_id())
    met = own.join(cells, [key, "_c"]).filter((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end)))
    cols = [c for c in points.columns]
    extra = [c for c in ranges.columns if c != key]
    best = met.groupBy("_id", *cols).agg(F.min_by(F.struct(*extra), F.struct(start, end)).alias("_r"))
    return best.select(*cols, *[F.col(f"_r.{c}").alias(c) for c in extra])


def oriented_link_lengths(links: DataFrame, ranges: DataFrame) -> DataFrame:
    """seqid, name, start, end, fwd, rev of links that leave the range of their first end.

    `links` has seqid, a, b. Links under the least distance are left out; those with both ends in
    one range tell nothing about its orientation.
    """
    met = points_in_ranges(links.filter(F.abs(F.col("a") - F.col("b")) >= C.MIN_LINK_DIST), ranges, "seqid", "a")
    out = met.filter(~E.in_range(F.col("b"), F.col("start"), F.col("end")))
    return out.select("seqid", "name", "start", "end", E.forward_link(F.col("a"), F.col("b")).alias("fwd"), E.reverse_link(F.col("start"), F.col("end"), F.col("a"), F.col("b")).alias("rev"))


def posteriors(lengths: DataFrame, b: float) -> DataFrame:
    """seqid, name, start, end, n_links, log_fwd, log_rev, postprob, sure (of the orientation as it is)."""
    rows = lengths.groupBy("seqid", "name", "start", "end").agg(
        F.count("*").alias("n_links"), F.sum(E.log_probability(F.col("fwd"), E.double(b))).alias("log_fwd"), F.sum(E.log_probability(F.col("rev"), E.double(b))).alias("log_rev")
    )
    done = rows.withColumn("postprob", E.posterior(F.col("log_fwd"), F.col("log_rev")))
    return done.withColumn("sure", F.col("postprob") > E.double(C.PROB_CUTOFF))


def heatmap(links: DataFrame, tour: DataFrame, resolution: int = C.HEATMAP_RESOLUTION) -> DataFrame:
    """grp, bin_a, bin_b, cnt: links between contigs of a tour by bins of the path, both directions.

    `links` has a, b, apos, bpos. A link within one bin counts twice there, as it does elsewhere.
    """
    at = prefix_sum(tour, ["grp"], "pos", F.col("size"), "cum").select("grp", "contig", "size", "cum", "sign")
    one = at.select("grp", *[F.col(c).alias(f"{c}_a") for c in ("size", "cum", "sign")], F.col("contig").alias("a"))
    two = at.select(F.col("grp").alias("_g"), *[F.col(c).alias(f"{c}_b") for c in ("size", "cum", "sign")], F.col("contig").alias("b"))
    rows = links.filter("a <> b").join(one, "a").join(two, "b").filter("grp = _g")
    where = lambda s, p: E.path_bin(E.path_position(F.col(f"cum_{s}"), F.col(f"size_{s}"), F.col(p), F.col(f"sign_{s}")), resolution)
    cells = rows.groupBy("grp", where("a", "apos").alias("bin_a"), where("b", "bpos").alias("bin_b")).agg(F.count("*").alias("cnt"))
    turned = cells.select("grp", F.col("bin_b").alias("bin_a"), F.col("bin_a").alias("bin_b"), "cnt")
    return cells.unionByName(turned).groupBy("grp", "bin_a", "bin_b").agg(F.sum("cnt").alias("cnt"))


def coverage(ranges: DataFrame, key: str, start: str, end: str, tile: int = 1 << 20) -> DataFrame:
    """key, at, depth: how many half-open ranges cover the stretch from `at` to the next row's."""
    events = ranges.select(key, F.inline(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))))
    steps = events.groupBy(key, "at").agg(F.sum("d").cast("long").alias("d"))
    run = prefix_sum(steps, [key], "at", F.col("d"), "_before", block=tile)
    return run.select(key, "at", (F.col("_before") + F.col("d")).alias("depth"))


def confusion(rows: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """threshold, tp, fp, tn, fn, tpr, fpr, acc of `score >= threshold` against the boolean `truth`; one pass."""
    s, t = F.col(score), F.col(truth)
    cells = [F.struct(F.lit(float(x)).alias("threshold"), F.count_if(t & (s >= x)).alias("tp"), F.count_if(~t & (s >= x)).alias("fp"), F.count_if(~t & (s < x)).alias("tn"), F.count_if(t & (s < x)).alias("fn")) for x in thresholds]
    one = rows.filter(s.isNotNull() & t.isNotNull()).agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    out = one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cells))])))
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    return out.withColumn("tpr", d("tp", F.col("tp") + F.col("fn"))).withColumn("fpr", d("fp", F.col("fp") + F.col("tn"))).withColumn("acc", F.try_divide((F.col("tp") + F.col("tn")).cast("double"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).cast("double")))
