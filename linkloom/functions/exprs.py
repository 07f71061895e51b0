"""Scalar functions of the contact model as pure Column expressions; nothing here runs Python per row.

Null in gives null out unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def double(x: float) -> Column:
    """A DOUBLE literal; decimal literals would divide as DECIMAL."""
    return F.lit(float(x)).cast("double")


def site_pattern(sites: str) -> str:
    """Regular expression of restriction sites: commas part alternatives, N stands for any base."""
    return "|".join(s.strip().replace("N", "[ACGT]") for s in sites.split(",") if s.strip())


def count_sites(seq: Column, sites: str = C.DEFAULT_RE) -> Column:
    """Occurrences of the sites that don't overlap, case-sensitive; an empty pattern counts 0."""
    pattern = site_pattern(sites)
    return F.regexp_count(seq, F.lit(pattern)).cast("long") if pattern else F.when(seq.isNotNull(), F.lit(0).cast("long"))


def positive_ln(x: Column) -> Column:
    """ln with values below 1 taken as 1, so that zero distances add nothing."""
    return F.ln(F.greatest(x, F.lit(1)).cast("double"))


def golden_bucket(x: Column) -> Column:
    """Bucket LB..UB of a distance on the scale of golden-ratio powers; distances below 1 fall into LB."""
    return F.least(F.greatest(F.round(positive_ln(x) / double(C.PHI)), F.lit(C.LB)), F.lit(C.UB)).cast("int")


def sum_log(links: Column) -> Column:
    """Sum of ln of the elements; null elements count 0."""
    return F.aggregate(links, double(0), lambda a, x: a + F.coalesce(positive_ln(x), double(0)))


def link_bin(d: Column) -> Column:
    """Sixteenths of an octave above 2^11: -1 below it. The octave comes from the bit length, so edges are exact."""
    octave = F.length(F.bin(int_div(d, F.lit(C.MIN_LINK_DIST)))) - 1
    # Squaring brings out one bit of the part at a time; folded, so that no step repeats the one before.
    first = F.struct((d.cast("double") / F.pow(double(2), octave + 11)).alias("x"), F.lit(0).alias("part"))

    def step(at: Column, bit: Column) -> Column:
        square = at["x"] * at["x"]
        up = square > 2
        return F.struct(F.when(up, square / 2).otherwise(square).alias("x"), (at["part"] + F.when(up, bit).otherwise(0)).alias("part"))

    part = F.aggregate(F.array(*[F.lit(b) for b in (8, 4, 2, 1)]), first, step, lambda at: at["part"])
    return F.when(d < C.MIN_LINK_DIST, -1).otherwise(16 * octave + part).cast("int")


def power_law(x: Column, a: float | Column, b: float | Column) -> Column:
    return a * F.pow(x.cast("double"), b)


def log_probability(x: Column, b: float | Column) -> Column:
    """b * ln x, with x below 1 taken as 1."""
    return b * positive_ln(x)


def oriented_distances(apos: Column, bpos: Column, alen: Column, blen: Column) -> Column:
    """The four distances between two links ends as array<struct<ao, bo, dist>>; contig a comes first."""
    one = lambda ao, bo, d: F.struct(F.lit(ao).alias("ao"), F.lit(bo).alias("bo"), d.cast("long").alias("dist"))
    return F.array(one("+", "+", alen - apos + bpos), one("+", "-", alen - apos + blen - bpos), one("-", "+", apos + bpos), one("-", "-", apos + blen - bpos))


def flip(orientation: Column) -> Column:
    return F.when(orientation == "-", "+").when(orientation.isNotNull(), "-")


def strandedness(ao: Column, bo: Column) -> Column:
    return F.when(ao == bo, 1).when(ao != bo, -1)


def reverse_complement(seq: Column) -> Column:
    """Case is kept; letters other than A, C, G and T stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def gap_sequence(size: int | Column = C.GAP_SIZE) -> Column:
    return F.repeat(F.lit("N"), size)


def wrapped(seq: Column, width: int = C.LINE_WIDTH) -> Column:
    """Lines of `width` letters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def path_position(start: Column, length: Column, pos: Column, sign: Column) -> Column:
    """Position on a path of one on a contig that begins at start; mirrored for negative sign."""
    return start + F.when(sign < 0, length - pos).otherwise(pos)


def path_bin(pos: Column, resolution: int = C.HEATMAP_RESOLUTION) -> Column:
    return F.floor(pos / resolution).cast("long")


def posterior(log_a: Column, log_b: Column) -> Column:
    """Probability of a against b from log likelihoods; differences over 100 give 0 or 1."""
    d = log_a - log_b
    return F.when(d > 100, double(1)).when(d < -100, double(0)).otherwise(1 / (1 + F.exp(-d)))


def forward_link(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def reverse_link(start: Column, end: Column, a: Column, b: Column) -> Column:
    """Length of the link if the contig from start to end were turned round."""
    return F.abs(start + end - a - b)


def in_range(p: Column, start: Column, end: Column) -> Column:
    return (p >= start) & (p < end)


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates; null where b is 0."""
    return F.call_function("div", a.cast("long"), F.when(b != 0, b.cast("long")))


def edge_weight(n: Column, max_sites: Column, sites_a: Column, sites_b: Column) -> Column:
    """Links scaled to the densest contig, whole numbers."""
    return int_div(n * max_sites * max_sites, sites_a * sites_b)


def allele_label(a: Column, b: Column) -> Column:
    """cross-allelic(members of a's group|members of b's group)"""
    return F.concat(F.lit("cross-allelic("), F.array_join(a, ","), F.lit("|"), F.array_join(b, ","), F.lit(")"))


def second_largest(values: Column) -> Column:
    """The largest value below the maximum; the minimum if all are equal."""
    return F.coalesce(F.array_max(F.filter(values, lambda x: x < F.array_max(values))), F.array_min(values))


def percentage(a: Column, b: Column) -> Column:
    """`a of b (p %)`; null for b = 0."""
    return F.when(b != 0, F.format_string("%d of %d (%.1f %%)", a, b, 100.0 * a / b))


def pareto(x: Column, alpha: float, least: float) -> Column:
    return double(alpha * least**alpha) / F.pow(x.cast("double"), double(alpha + 1))


def bounded_pareto(x: Column, alpha: float, least: float, most: float) -> Column:
    return double(alpha * least**alpha / (1 - (least / most) ** alpha)) * F.pow(x.cast("double"), double(-alpha - 1))


def reciprocal(x: Column, least: float, most: float) -> Column:
    from math import log

    return double(1 / log(most / least)) / x.cast("double")


def exponential(x: Column, rate: float) -> Column:
    return double(rate) * F.exp(double(-rate) * x)


def uniform_pareto(x: Column, alpha: float, least: float, span: float) -> Column:
    """Density of the sum of a place even on 0..span and a Pareto length: where a link that starts anywhere on a contig ends. 0 below `least`."""
    z = x.cast("double")
    tail = lambda t: F.pow(double(least) / t, double(alpha))
    far = F.when(z > least + span, tail(z - double(span))).otherwise(double(1))
    return F.when(z < least, double(0)).otherwise((far - tail(z)) / double(span))


def pareto_alpha(x: Column, least: float) -> Column:
    """Maximum-likelihood exponent of a Pareto law, an aggregate."""
    return F.count(x) / (F.sum(F.ln(x.cast("double"))) - F.count(x) * F.ln(double(least)))
