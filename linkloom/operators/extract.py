"""From alignments to all that later steps need: links, oriented distances, the link model and pairs with expectations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import cut
from . import contacts, model


@dataclass
class Extract:
    clm: DataFrame
    distribution: DataFrame
    pairs: DataFrame
    model: model.Model


def extract(reads: DataFrame, contigs: DataFrame, min_links: int = C.MIN_LINKS) -> Extract:
    """Links are placed once and feed the oriented distances, the bins of the model and the pairs.

    `reads` has ref, pos, mate_ref, mate_pos (see good_alignments for mapq and flag), `contigs` idx,
    contig and length. The tail of the model ends where it holds fewer links than a hundredth of
    those in the first contig by idx that has any. Raises ValueError if too few bins have links.
    """
    links = cut(contacts.place_links(reads, contigs))
    intra = contacts.intra_links(links)
    first = links.filter("ai = bi").filter(F.abs(F.col("apos") - F.col("bpos")) >= C.MIN_LINK_DIST).groupBy("ai").agg(F.count("*").alias("n")).agg(F.min_by("n", "ai")).first()[0]
    law, bins = model.make_model(intra, "dist", contigs, (first or 0) // 100)
    size = contigs.groupBy("contig").agg(F.max("length").alias("length"))
    pairs = contacts.pair_counts(links, min_links).join(size.toDF("a", "l1"), "a").join(size.toDF("b", "l2"), "b")
    pairs = pairs.select("ai", "bi", "a", "b", F.col("n").alias("observed"), model.expected_inter(F.col("l1"), F.col("l2"), law).alias("expected"))
    return Extract(contacts.clm(links, min_links), bins, pairs, law)
