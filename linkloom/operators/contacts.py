"""Links between contigs: from alignments to oriented distances, pair counts and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from ..session import cut
from .ordered import mad_bounds


def good_alignments(reads: DataFrame) -> DataFrame:
    """Mapped, primary, unique alignments: quality above 0 and none of the bad flags. Null quality or flag is bad."""
    return reads.filter((F.col("mapq") != 0) & (F.col("flag").bitwiseAND(F.lit(C.BAD_FLAGS)) == 0))


def length_mismatches(header: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, length, other, problem: contigs of an alignment header that the sequences lack (unknown) or have at another length."""
    h, c = header.select("contig", "length").distinct(), contigs.select("contig", F.col("length").alias("other")).distinct()
    rows = h.join(c, "contig", "left").withColumn("problem", F.when(F.col("other").isNull(), "unknown").when(F.col("other") != F.col("length"), "length"))
    return rows.filter("problem is not null").select("contig", "length", "other", "problem")


def place_links(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """a, b, apos, bpos, alen, blen of reads whose two ends lie on known contigs, the lower idx first.

    `reads` has ref, pos, mate_ref and mate_pos, `contigs` idx, contig and length. Ends on unknown
    contigs drop the row. Both mates of a pair count, as they are both alignments.
    """
    one = contigs.select(F.col("contig").alias("ref"), F.col("idx").alias("_ai"), F.col("length").alias("_al"))
    two = contigs.select(F.col("contig").alias("mate_ref"), F.col("idx").alias("_bi"), F.col("length").alias("_bl"))
    rows = reads.join(one, "ref").join(two, "mate_ref")
    swap = F.col("_ai") > F.col("_bi")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return rows.select(
        pick("_ai", "_bi").alias("ai"), pick("_bi", "_ai").alias("bi"), pick("ref", "mate_ref").alias("a"), pick("mate_ref", "ref").alias("b"),
        pick("pos", "mate_pos").alias("apos"), pick("mate_pos", "pos").alias("bpos"), pick("_al", "_bl").alias("alen"), pick("_bl", "_al").alias("blen"),
    )


def intra_links(links: DataFrame, least: int = C.MIN_LINK_DIST) -> DataFrame:
    """contig, dist of links within a contig that are at least so long."""
    return links.filter("ai = bi").select(F.col("a").alias("contig"), F.abs(F.col("apos") - F.col("bpos")).alias("dist")).filter(F.col("dist") >= least)


def oriented_links(links: DataFrame) -> DataFrame:
    """ai, bi, a, b, ao, bo, dist: the four distances of each link between contigs."""
    return links.filter("ai <> bi").select("ai", "bi", "a", "b", F.inline(E.oriented_distances(F.col("apos"), F.col("bpos"), F.col("alen"), F.col("blen"))))


def pair_counts(links: DataFrame, min_links: int = C.MIN_LINKS) -> DataFrame:
    """Links of each pair of contigs that has enough of them."""
    return links.filter("ai <> bi").groupBy("ai", "bi", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_links)


def clm(links: DataFrame, min_links: int = C.MIN_LINKS) -> DataFrame:
    """One row per pair and orientation with its distances in ascending order."""
    rows = oriented_links(links).groupBy("a", "b", "ao", "bo").agg(F.sort_array(F.collect_list("dist")).alias("links"))
    return rows.filter(F.size("links") >= min_links).withColumn("n", F.size("links").cast("long"))


def link_summary(links: DataFrame) -> DataFrame:
    """n_intra, n_contigs, n_inter, n_pairs, max_inter in one row."""
    intra, inter = F.col("ai") == F.col("bi"), F.col("ai") != F.col("bi")
    per = links.groupBy("ai", "bi").agg(F.count_if(intra & (F.abs(F.col("apos") - F.col("bpos")) >= C.MIN_LINK_DIST)).alias("_i"), F.count_if(inter).alias("_x"))
    return per.agg(F.coalesce(F.sum("_i"), F.lit(0)).alias("n_intra"), F.count_if(F.col("_i") > 0).alias("n_contigs"), F.coalesce(F.sum("_x"), F.lit(0)).alias("n_inter"), F.count_if(F.col("_x") > 0).alias("n_pairs"), F.coalesce(F.max("_x"), F.lit(0)).alias("max_inter"))


def best_orientation(clm: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """The orientation with the smallest sum of ln distance for each pair, with strandedness and mean distance.

    `clm` has ao, bo and links. Ties go to the first in `tie`. Rows without links or with unknown
    orientation aren't candidates.
    """
    rows = clm.filter("size(links) > 0 and ao in ('+', '-') and bo in ('+', '-')").withColumn("_s", E.sum_log(F.col("links")))
    order = F.struct(F.round("_s", 9).alias("s"), *tie)
    total = F.aggregate("links", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("ao", "bo", F.size("links").cast("long").alias("n"), F.col("_s").alias("sum_log"), (total / F.size("links")).alias("mean_dist")), order).alias("_b"))
    return best.select(*keys, "_b.*").withColumn("strandedness", E.strandedness(F.col("ao"), F.col("bo")))


def golden_histogram(clm: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, cnt: distances on the golden-ratio scale; counted before rows are shuffled."""
    return clm.select(*keys, F.explode("links").alias("d")).filter("d is not null").groupBy(*keys, E.golden_bucket(F.col("d")).alias("bucket")).agg(F.count("*").alias("cnt"))


def histogram_array(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The twelve buckets as an array."""
    wide = hist.groupBy(*keys).pivot("bucket", list(range(C.LB, C.UB + 1))).sum("cnt")
    return wide.select(*keys, F.array(*[F.coalesce(F.col(str(k)), F.lit(0)).cast("long") for k in range(C.LB, C.UB + 1)]).alias("hist"))


def both_directions(rows: DataFrame, a: str = "a", b: str = "b", ao: str | None = "ao", bo: str | None = "bo") -> DataFrame:
    """Each contact also as seen from its other end: ends swapped, orientations swapped and flipped."""
    turned = rows.withColumns({a: F.col(b), b: F.col(a)} | ({ao: E.flip(F.col(bo)), bo: E.flip(F.col(ao))} if ao else {}))
    return rows.unionByName(turned)


def contact_matrix(pairs: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """a, b, n of both directions, summed; sparse."""
    rows = pairs.filter(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(n).alias("n"))
    return both_directions(rows, ao=None, bo=None)


def link_density(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """contig, links, log10 of links for every bp of its length, at most DENSITY_CAP of it."""
    ends = pairs.select(F.col("a").alias("contig"), "n").unionByName(pairs.select(F.col("b").alias("contig"), "n"))
    total = ends.groupBy("contig").agg(F.sum("n").alias("links"))
    return total.join(lengths.select("contig", "length").filter("length > 0"), "contig").filter("links > 0").withColumn("log_density", F.log10(F.col("links") / F.least("length", F.lit(C.DENSITY_CAP))))


def active_contigs(density: DataFrame, low: float, shortest: int = C.MIN_SIZE) -> DataFrame:
    """Contigs that are long enough and not of low density unless they are very long."""
    return density.filter((F.col("length") >= shortest) & ((F.col("log_density") >= low) | (F.col("length") >= 10 * shortest)))


def active_by_density(pairs: DataFrame, lengths: DataFrame, shortest: int = C.MIN_SIZE, max_rounds: int = 100) -> DataFrame:
    """link_density of the contigs that stay when those of low density go, unless very long, until none does.

    With a contig its links go, so densities and their bounds are taken anew; contigs without a link
    left go too. Rounds that don't end are an error.
    """
    rows = cut(pairs.select("a", "b", "n"))
    for _ in range(max_rounds):
        density = cut(link_density(rows, lengths))
        bounds = mad_bounds(density, "log_density", C.OUTLIER_THRESHOLD, C.MAD_SCALE)
        if bounds is None:
            return density
        low = cut(density.filter((F.col("log_density") < bounds[0]) & (F.col("length") < 10 * shortest)).select("contig"))
        if not low.limit(1).count():
            return density
        rows = cut(rows.join(low.toDF("a"), "a", "left_anti").join(low.toDF("b"), "b", "left_anti").select("a", "b", "n"))
    raise RuntimeError(f"contigs still go after {max_rounds} rounds")
