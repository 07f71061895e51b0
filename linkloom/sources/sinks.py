"""Writers of the text formats.

Rows are formatted in Spark and written as text; `one_file` gives a single ordered file, which
suits reports of bounded size, and is off by default.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E


def _write(rows: DataFrame, path: str, head: str | None = None, one_file: bool = False) -> None:
    text = rows.select(F.col(rows.columns[0]).alias("value"))
    if one_file:
        text = text.coalesce(1)
    if head is not None:
        # A heading stands in every part, so that each can be read by itself.
        def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

        text = text.mapInArrow(headed, "value string")
    text.write.mode("overwrite").text(path)


def tabbed(*cols: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).alias("value")


def c_general(x: Column, digits: int = 4) -> Column:
    """%.4g as C writes it: no trailing zeros, exponents outside 1e-4 .. 10^digits."""
    # The exponent is that of the rounded number, as 9999.6 has one more than its logarithm says.
    sci = F.format_string(f"%.{digits - 1}e", x)
    mantissa, exponent = F.split(sci, "e")[0], F.split(sci, "e")[1]
    power = exponent.cast("int")
    short = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    plain = F.coalesce(*[F.when(power == p, F.format_string(f"%.{max(0, digits - 1 - p)}f", x)) for p in range(-4, digits)], sci)
    return F.when(x == 0, "0").when((power < -4) | (power >= digits), F.concat(short(mantissa), F.lit("e"), exponent)).otherwise(short(plain))


def write_sites(contigs: DataFrame, path: str, one_file: bool = False) -> dict[str, float]:
    """Restriction-site counts in order of idx; the totals are returned."""
    _write(contigs.orderBy("idx").select(tabbed(F.col("contig"), F.col("recounts"), F.col("length"))), path, C.HEAD_RE, one_file)
    n, sites, length = contigs.agg(F.count("*"), F.sum("recounts"), F.sum("length")).first()
    return {"contigs": n, "sites": sites or 0, "length": length or 0, "bp_per_site": (length or 0) / sites if sites else float("nan")}


def write_clm(clm: DataFrame, path: str) -> None:
    line = tabbed(F.concat("at_ctg", "ao", F.lit(" "), "bt_ctg", "bo"), F.size("links"), F.array_join(F.transform(F.sort_array("links"), lambda x: x.cast("string")), " "))
    _write(clm.select(line), path)


def write_distribution(bins: DataFrame, path: str) -> None:
    """At most 256 rows, in order."""
    cols = [F.col(c) for c in ("bin", "binstart", "binsize", "numlinks", "totalsize")]
    _write(bins.orderBy("bin").select(tabbed(*cols, c_general(F.col("linkdensity")))), path, C.HEAD_DISTRIBUTION, True)


def write_pairs(pairs: DataFrame, path: str, min_links: int = 0) -> None:
    """Pairs with their labels, by x and y, that have the least number of links."""
    cols = [F.col(c) for c in ("x", "y", "contig1", "contig2", "re1", "re2", "observedlinks")]
    rows = pairs.filter(F.col("observedlinks") >= min_links).orderBy("x", "y")
    _write(rows.select(tabbed(*cols, F.format_string("%.1f", "expectedlinksifadjacent"), F.col("label"))), path, C.HEAD_PAIRS)


def cluster_lines(clusters: DataFrame, lengths: DataFrame) -> DataFrame:
    """group (`kgj`, by length), ncontigs, contigs in bytewise order."""
    from ..operators.cluster import cluster_sizes

    sizes = cluster_sizes(clusters, lengths)
    names = clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("contig")).alias("_c"))
    return sizes.join(names, "cluster").select(F.concat("n_clusters", F.lit("g"), "rank").alias("group"), F.size("_c").cast("long").alias("ncontigs"), F.array_join("_c", " ").alias("contigs"), "rank")


def write_clusters(clusters: DataFrame, lengths: DataFrame, path: str) -> None:
    rows = cluster_lines(clusters, lengths).orderBy("rank")
    _write(rows.select(tabbed(F.col("group"), F.col("ncontigs"), F.col("contigs"))), path, C.HEAD_CLUSTERS)


def write_group_sites(clusters: DataFrame, contigs: DataFrame, path: str) -> None:
    """Site counts of each cluster in a folder of its own."""
    contigs.join(clusters, "contig").write.mode("overwrite").partitionBy("cluster").option("sep", "\t").option("header", True).csv(path)


def write_tour(tour: DataFrame, label: str, path: str) -> None:
    """`>label` and the contigs of each group with their orientation."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("contig", "orientation").alias("w")))), lambda x: x["w"])
    lines = tour.groupBy("scaffold").agg(F.array_join(words, " ").alias("w"))
    _write(lines.orderBy("scaffold").select(F.concat(F.lit(f">{label}:"), "scaffold", F.lit("\n"), "w").alias("value")), path)


def agp_line() -> Column:
    gap = F.col("type").isin("N", "U")
    tail = [("gap_length", "component"), ("gap_type", "component_beg"), ("linkage", "component_end"), ("evidence", "orientation")]
    return tabbed(*[F.col(c) for c in ("object", "object_beg", "object_end", "part", "type")], *[F.when(gap, F.col(a).cast("string")).otherwise(F.col(b).cast("string")) for a, b in tail])


def write_agp(agp: DataFrame, path: str) -> None:
    _write(agp.orderBy("object", "part").select(agp_line()), path)


def write_fasta(seqs: DataFrame, path: str) -> None:
    """name and seq; lines of 60 letters."""
    _write(seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), E.wrapped(F.col("seq"))).alias("value")), path)


def write_intra(links: DataFrame, path: str) -> None:
    """Distinct distances within each contig, ascending, with commas."""
    one = links.groupBy("contig").agg(F.array_sort(F.collect_set("dist")).alias("_d"))
    _write(one.select(tabbed(F.col("contig"), F.array_join(F.transform("_d", lambda x: x.cast("string")), ","))), path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Two nodes and a weight with blanks, under a comment."""
    _write(edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("a", "b", "weight")]).alias("value")), path, "% a b weight")


def write_posterior(rows: DataFrame, path: str) -> None:
    cols = [F.col(c) for c in ("seqid", "start", "end", "name")]
    _write(rows.orderBy("seqid", "start").select(tabbed(*cols, F.format_string("%.4f", "postprob"))), path, C.HEAD_POSTPROB)


def write_heatmap(cells: DataFrame, starts: DataFrame, path: str, n_bins: int, resolution: int = C.HEATMAP_RESOLUTION, most: int = 20_000) -> None:
    """genome.json and data.npy, an int32 matrix of bins. The matrix is the product, so its size is checked first."""
    if n_bins > most:
        raise ValueError(f"{n_bins} bins: take a coarser resolution, a matrix has at most {most}")
    matrix = np.zeros((n_bins, n_bins), np.int32)
    for a, b, c in cells.select("bin_a", "bin_b", "cnt").toLocalIterator():
        matrix[a, b] = c
    os.makedirs(path, exist_ok=True)
    np.save(os.path.join(path, "data.npy"), matrix)
    rows = starts.select("contig", "start", "size").limit(n_bins * 1000).collect()
    head = {"starts": {r[0]: r[1] for r in rows}, "sizes": {r[0]: r[2] for r in rows}, "total_bins": n_bins, "distbinstarts": {}, "distbinsizes": {}, "resolution": resolution}
    with open(os.path.join(path, "genome.json"), "w") as f:
        json.dump(head, f)
