"""The link-density model: geometric distance bins, densities, a power law, and expected links.

All that depends on the bins has 256 rows and goes into expressions as arrays; links and contigs are
never crossed with the bins, as sums over whole bins come from running totals over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import config as C
from ..functions import exprs as E
from .ordered import _search


def bins(spark: SparkSession) -> DataFrame:
    """bin, binstart, binsize: 256 rows."""
    s = C.bin_starts()
    return spark.createDataFrame([(i, s[i], s[i + 1] - s[i]) for i in range(C.N_BINS)], "bin int, binstart long, binsize long")


def bin_counts(distances: DataFrame, d: str) -> DataFrame:
    """bin, numlinks over all 256 bins; distances outside them are left out."""
    got = distances.select(E.link_bin(F.col(d)).alias("bin")).filter(f"bin >= 0 and bin < {C.N_BINS}").groupBy("bin").agg(F.count("*").alias("numlinks"))
    return bins(distances.sparkSession).join(F.broadcast(got), "bin", "left").select("bin", "binstart", "binsize", F.coalesce("numlinks", F.lit(0)).alias("numlinks"))


def edge_index(x: Column, edges: Sequence[int]) -> Column:
    """How many edges are <= x."""
    return _search(F.array(*[F.lit(int(e)).cast("long") for e in edges]), x.cast("long"), len(edges))


def bin_norms(lengths: DataFrame, length: str = "length") -> DataFrame:
    """bin, norm: sum over contigs of what of their length lies beyond the bin's start.

    Contigs are counted by the bin they end in; the 256 sums run from the far end.
    """
    s = C.bin_starts()[: C.N_BINS]
    at = edge_index(F.col(length), s) - 1
    got = lengths.filter(F.col(length).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("_c"), F.sum(length).alias("_l"))
    w = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    rows = bins(lengths.sparkSession).join(F.broadcast(got), "bin", "left").withColumn("_cs", F.sum(F.coalesce("_c", F.lit(0))).over(w)).withColumn("_ls", F.sum(F.coalesce("_l", F.lit(0))).over(w))
    return rows.select("bin", (F.col("_ls") - F.col("binstart") * F.col("_cs")).alias("norm"))


@dataclass(frozen=True)
class Model:
    """density of each bin, and the power law density = a * distance ** b."""

    a: float
    b: float
    density: tuple[float, ...]


def densities(counts: DataFrame, norms: DataFrame) -> DataFrame:
    """bin, binstart, binsize, numlinks, totalsize, linkdensity; null where a bin has no norm."""
    rows = counts.join(F.broadcast(norms), "bin")
    return rows.select("bin", "binstart", "binsize", "numlinks", F.col("norm").alias("totalsize"), F.try_divide(F.try_divide(F.col("numlinks").cast("double"), F.col("norm").cast("double")), F.col("binsize").cast("double")).alias("linkdensity"))


def fit_power_law(bins: DataFrame, top: int) -> DataFrame:
    """a, b of ln density = ln a + b ln start, by least squares over bins below top with links."""
    x, y = F.ln(F.col("binstart").cast("double")), F.ln("linkdensity")
    used = bins.filter(F.col("bin") < top).filter("numlinks > 0 and linkdensity > 0")
    return used.agg(F.exp(F.regr_intercept(y, x)).alias("a"), F.regr_slope(y, x).alias("b"))


def top_bin(bins: DataFrame, floor: int) -> DataFrame:
    """One row: the bin from which on the far bins hold fewer than `floor` links in total."""
    w = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    far = bins.withColumn("_far", F.coalesce(F.sum("numlinks").over(w), F.lit(0)))
    return far.agg(F.coalesce(F.max(F.when(F.col("_far") >= floor, F.col("bin"))), F.lit(0)).alias("top"))


def make_model(distances: DataFrame, d: str, lengths: DataFrame, tail_floor: int) -> tuple[Model, DataFrame]:
    """The model and its 256 bins. `tail_floor` is the number of links that the tail must hold to count.

    Raises ValueError if fewer than two bins have links: then there is no power law.
    """
    table = densities(bin_counts(distances, d), bin_norms(lengths)).persist()
    top = top_bin(table, tail_floor).first()[0]
    a, b = fit_power_law(table, top).first()
    if a is None or b is None:
        raise ValueError("fewer than two distance bins hold links")
    smooth = (F.col("bin") >= top) | F.coalesce(F.col("linkdensity") == 0, F.lit(True))
    done = table.withColumn("linkdensity", F.when(smooth, F.lit(a) * F.pow(F.col("binstart").cast("double"), F.lit(b))).otherwise(F.col("linkdensity")))
    return Model(a, b, tuple(r[0] for r in done.orderBy("bin").select("linkdensity").collect())), done


def model_of(distribution: DataFrame) -> Model:
    """The model of a given table of 256 bins."""
    rows = distribution.orderBy("bin").select("binstart", "linkdensity").limit(C.N_BINS).collect()
    x = np.log([r[0] for r in rows if r[1] and r[1] > 0])
    y = np.log([r[1] for r in rows if r[1] and r[1] > 0])
    b, a = np.polyfit(x, y, 1) if len(x) > 1 else (0.0, 0.0)
    return Model(float(np.exp(a)), float(b), tuple(float(r[1] or 0) for r in rows))


def _doubles(values) -> Column:
    return F.array(*[E.double(v) for v in values])


def expected_intra(length: Column, model: Model) -> Column:
    """Expected links within a contig of some length."""
    s = C.bin_starts()
    e, dens = s[1:], model.density
    whole = [0.0]
    linear = [0.0]
    for i in range(C.N_BINS):
        width = e[i] - s[i]
        whole.append(whole[-1] + width * dens[i])
        linear.append(linear[-1] + width * ((s[i] + e[i]) // 2) * dens[i])
    k = F.greatest(edge_index(length, s) - 1, F.lit(0))  # the bin in which the contig ends
    n = F.least(k, F.lit(C.N_BINS))
    L = length.cast("double")
    start = F.get(F.array(*[F.lit(v).cast("long") for v in s]), n)
    last = (L - start) * (L - E.int_div(start + length, F.lit(2))) * F.coalesce(F.get(_doubles(dens), n), E.double(0))
    full = L * F.get(_doubles(whole), n) - F.get(_doubles(linear), n)
    return F.when(length <= s[0], E.double(0)).otherwise(full + F.when(k < C.N_BINS, last).otherwise(E.double(0)))


def expected_inter(l1: Column, l2: Column, model: Model) -> Column:
    """Expected links between two adjacent contigs: a trapezoid over distance, summed over the bins.

    Bins between two corners of the trapezoid are whole and come from running totals; the bins that
    hold a corner are computed one by one.
    """
    s = C.bin_starts()
    e, dens = s[1:], model.density
    flat, tilt = [0.0], [0.0]  # running sums of width * density, and of width * midpoint * density
    for i in range(C.N_BINS):
        flat.append(flat[-1] + (e[i] - s[i]) * dens[i])
        tilt.append(tilt[-1] + (e[i] - s[i]) * ((s[i] + e[i]) // 2) * dens[i])
    a, b = F.least(l1, l2).cast("long"), F.greatest(l1, l2).cast("long")
    c = a + b
    starts, den = F.array(*[F.lit(v).cast("long") for v in s]), _doubles(dens)
    FL, TI = _doubles(flat), _doubles(tilt)

    def part(k: Column) -> Column:
        """One bin by the three pieces of the trapezoid."""
        lo, hi = F.get(starts, k), F.get(starts, k + 1)
        d = F.get(den, k)
        up_r = F.least(hi, a)
        up = F.when(lo < a, (up_r - lo) * E.int_div(lo + up_r, F.lit(2))).otherwise(F.lit(0).cast("long"))
        mid_l, mid_r = F.greatest(lo, a), F.least(hi, b)
        mid = F.when((hi >= a) & (lo < b), (mid_r - mid_l) * a).otherwise(F.lit(0).cast("long"))
        dn_l, dn_r = F.greatest(lo, b), F.least(hi, c)
        down = F.when((hi >= b) & (lo < c), (dn_r - dn_l) * (c - E.int_div(dn_l + dn_r, F.lit(2)))).otherwise(F.lit(0).cast("long"))
        return F.when((k >= 0) & (k < C.N_BINS), (up + mid + down).cast("double") * d).otherwise(E.double(0))

    at = lambda x: F.least(edge_index(x, s) - 1, F.lit(C.N_BINS))  # -1: before the first bin
    ka, kb, kc = at(a), at(b), at(c)
    between = lambda arr, x, y: F.when(y > x + 1, F.get(arr, y) - F.get(arr, F.greatest(x + 1, F.lit(0)))).otherwise(E.double(0))
    rise = F.when(ka > 0, F.get(TI, F.greatest(ka, F.lit(0)))).otherwise(E.double(0))
    plain = a.cast("double") * between(FL, ka, kb)
    fall = c.cast("double") * between(FL, kb, kc) - between(TI, kb, kc)
    corners = part(ka) + F.when(kb != ka, part(kb)).otherwise(E.double(0)) + F.when(kc != kb, part(kc)).otherwise(E.double(0))
    return rise + plain + fall + corners
