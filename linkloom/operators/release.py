"""Scaffolds from tours: AGP lines, sequences and unplaced contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from .ordered import prefix_sum


def agp(tour: DataFrame, gap: int = C.GAP_SIZE) -> DataFrame:
    """AGP lines of a tour (grp, pos from 0, contig, size, orientation): components with gaps between them."""
    at = prefix_sum(tour, ["grp"], "pos", F.col("size") + gap, "_off")
    long, text = (lambda x: x.cast("long")), (lambda x: x.cast("string"))
    none_l, none_s = long(F.lit(None)), text(F.lit(None))
    parts = at.select(
        F.col("grp").alias("object"), long(F.col("_off") + 1).alias("object_beg"), long(F.col("_off") + F.col("size")).alias("object_end"), long(2 * F.col("pos") + 1).alias("part"), F.lit("W").alias("type"),
        none_l.alias("gap_length"), none_s.alias("gap_type"), none_s.alias("linkage"), none_s.alias("evidence"),
        F.col("contig").alias("component"), F.lit(1).cast("long").alias("component_beg"), long(F.col("size")).alias("component_end"), F.col("orientation"),
    )
    gaps = at.filter("pos > 0").select(
        F.col("grp").alias("object"), long(F.col("_off") - gap + 1).alias("object_beg"), long(F.col("_off")).alias("object_end"), long(2 * F.col("pos")).alias("part"), F.lit("U" if gap == 100 else "N").alias("type"),
        long(F.lit(gap)).alias("gap_length"), F.lit("scaffold").alias("gap_type"), F.lit("yes").alias("linkage"), F.lit("map").alias("evidence"),
        none_s.alias("component"), none_l.alias("component_beg"), none_l.alias("component_end"), none_s.alias("orientation"),
    )
    return parts.unionByName(gaps)


def unplaced(contigs: DataFrame, tour: DataFrame) -> DataFrame:
    """Contigs in no tour."""
    return contigs.join(tour.select("contig"), "contig", "left_anti")


def missing(lines: DataFrame, seqs: DataFrame) -> DataFrame:
    """Components without a sequence."""
    return lines.filter("component is not null").join(seqs.select(F.col("name").alias("component")), "component", "left_anti").select("object", "component")


def sequence_lines(lines: DataFrame, seqs: DataFrame, width: int = C.LINE_WIDTH) -> DataFrame:
    """object, line, seq: the scaffold sequences in lines of `width`, never a scaffold in one row.

    Components with - are reverse complemented, + and ? are copied, gaps are runs of N; components
    without a sequence are runs of N too, so that coordinates hold. Only lines that hold the end of
    a part are put together from several.
    """
    parts = lines.join(seqs.select(F.col("name").alias("component"), "seq"), "component", "left")
    beg, size = F.col("component_beg"), F.col("object_end") - F.col("object_beg") + 1
    piece = F.substring("seq", beg.cast("int"), size.cast("int"))
    text = F.when(F.col("seq").isNull(), E.gap_sequence(size.cast("int"))).when(F.col("orientation") == "-", E.reverse_complement(piece)).otherwise(piece)
    first, last = E.int_div(F.col("object_beg") - 1, F.lit(width)), E.int_div(F.col("object_end") - 1, F.lit(width))
    rows = parts.select("object", F.col("object_beg").alias("_b"), text.alias("_t"), F.explode(F.sequence(first, last)).alias("line"))
    start = F.greatest(F.col("line") * width + 1, F.col("_b"))
    cell = F.substring("_t", (start - F.col("_b") + 1).cast("int"), ((F.col("line") + 1) * width - start + 1).cast("int"))
    rows = rows.select("object", "line", start.alias("_s"), cell.alias("seq"))
    whole = rows.filter(F.length("seq") == width).select("object", "line", "seq")
    split = rows.filter(F.length("seq") < width).groupBy("object", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_s", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return whole.unionByName(split)
