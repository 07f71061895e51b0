"""Graphs of contig ends: weighted edges, confidence, chains, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import config as C
from ..functions import exprs as E
from ..session import cut
from .components import connected_components


def end_nodes(links: DataFrame, lengths: DataFrame, flank: int) -> DataFrame:
    """a, b (nodes `contig:L` or `contig:R`), la, lb: links whose ends lie on the flanks of two contigs.

    A flank is `flank` long, at most half of the contig; links inside are left out.
    """
    size = lengths.select("contig", "length", F.least(E.int_div(F.col("length"), F.lit(2)), F.lit(flank)).alias("_f"))

    def side(pos: str, length: str, f: str):
        return F.when(F.col(pos) < F.col(f), "L").when(F.col(pos) >= F.col(length) - F.col(f), "R")

    one, two = size.toDF("a", "_la", "_fa"), size.toDF("b", "_lb", "_fb")
    rows = links.filter("a <> b").join(one, "a").join(two, "b").withColumn("_sa", side("apos", "_la", "_fa")).withColumn("_sb", side("bpos", "_lb", "_fb")).filter("_sa is not null and _sb is not null")
    return rows.select(F.concat_ws(":", "a", "_sa").alias("a"), F.concat_ws(":", "b", "_sb").alias("b"), F.col("_fa").alias("la"), F.col("_fb").alias("lb"))


def edges(nodes: DataFrame) -> DataFrame:
    """a < b, n, weight: links scaled by 10^12 over the product of the flank lengths, whole numbers."""
    turn = F.col("a") > F.col("b")
    rows = nodes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turn, F.col("lb")).otherwise(F.col("la")).alias("la"), F.when(turn, F.col("la")).otherwise(F.col("lb")).alias("lb"))
    counted = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("la").alias("la"), F.max("lb").alias("lb"))
    return counted.filter("la > 0 and lb > 0").select("a", "b", "n", E.int_div(F.col("n") * C.BIG_NORM, F.col("la") * F.col("lb")).alias("weight"))


def confidence(graph: DataFrame) -> DataFrame:
    """a, b, weight, confidence: the weight over the best rival at either end; edges that beat it are kept.

    The rival is the largest weight below the maximum among the two largest of each end.
    """
    both = graph.select("a", "weight").unionByName(graph.select(F.col("b").alias("a"), "weight")).distinct()
    top = both.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("weight")))).filter("_r <= 2").groupBy("a").agg(F.collect_list("weight").alias("_t"))
    rows = graph.join(top, "a").join(top.select(F.col("a").alias("b"), F.col("_t").alias("_u")), "b").withColumn("_v", E.second_largest(F.concat("_t", "_u")))
    # As DOUBLE: scaled weights would leave the range of whole numbers.
    return rows.select("a", "b", "weight", F.try_divide(F.col("weight").cast("double"), F.col("_v").cast("double")).alias("confidence")).filter("confidence > 1")


def best_partners(graph: DataFrame) -> DataFrame:
    """a, b, weight: edges that are the heaviest at both ends; ties go to the bytewise smaller partner."""
    both = graph.select("a", "b", "weight").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    best = both.groupBy("a").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("b"))).alias("m")).select("a", F.col("m.b").alias("b"), (-F.col("m.w")).alias("weight"))
    return best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).filter("a < b")


def _name(node: str):
    return F.expr(f"substring({node}, 1, length({node}) - 2)")


def chains(partners: DataFrame, contigs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """contig, chain, n_contigs: contigs joined end to end by partner edges; a chain has its least contig's name.

    Chains are the connected components of the partner edges, of any length; edges that are left after
    `max_rounds` contractions are an error. Cycles lose their lightest edge, so every chain has two
    ends.
    """
    return _chains(partners, contigs, max_rounds).select("contig", "chain", "n_contigs", _name("cut_a").alias("cut_x"), _name("cut_b").alias("cut_y"))


def _chains(partners: DataFrame, contigs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """contig, chain, n_contigs, and the nodes of the edge that a cycle loses."""
    links = cut(partners.select("a", "b", _name("a").alias("x"), _name("b").alias("y"), "weight"))
    found = connected_components(links, F.col("x"), F.col("y"), max_rounds).toDF("contig", "_l")
    label = cut(contigs.select("contig").distinct().join(found, "contig", "left").select("contig", F.coalesce("_l", "contig").alias("label")))
    per = label.groupBy("label").agg(F.count("*").alias("n"))
    inside = links.join(label.select(F.col("contig").alias("x"), "label"), "x")
    count = inside.groupBy("label").agg(F.count("*").alias("_e"), F.min_by(F.struct("a", "b"), F.struct("weight", "x", "y", "a", "b")).alias("_weak"))
    cycles = count.join(per, "label").filter("_e >= n").select("label", F.col("_weak.a").alias("cut_a"), F.col("_weak.b").alias("cut_b"))
    return label.join(per, "label").join(cycles, "label", "left").select("contig", F.col("label").alias("chain"), F.col("n").alias("n_contigs"), "cut_a", "cut_b")


def chain_order(partners: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, chain, n_contigs, pos, orientation: where each contig stands in its chain, and which way round.

    A chain begins at that of its two end contigs with the bytewise smaller name; a contig that is
    passed from L to R has +, a lone contig too. Places come from pointer jumping: each contig looks
    out of both its ends, and with every round twice as far, so a chain takes as many rounds as its
    length has binary digits.
    """
    whole = cut(_chains(partners, contigs))
    lost = whole.filter("cut_a is not null").select(F.col("cut_a").alias("a"), F.col("cut_b").alias("b")).distinct()
    kept = partners.select("a", "b").join(lost, ["a", "b"], "left_anti")
    other = lambda c: F.concat(_name(c), F.when(F.endswith(c, F.lit(":L")), F.lit(":R")).otherwise(F.lit(":L")))
    # Who leaves a contig by this end enters the next one, and leaves it by its other end.
    hop = kept.select(F.col("a").alias("state"), other("b").alias("to")).unionByName(kept.select(F.col("b").alias("state"), other("a").alias("to")))
    linked = whole.filter("n_contigs > 1").select(F.explode(F.array(F.concat("contig", F.lit(":L")), F.concat("contig", F.lit(":R")))).alias("state"))
    now = cut(linked.join(hop, "state", "left").select("state", F.coalesce("to", "state").alias("to"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("d")))
    for _ in range(64):
        far = now.select(F.col("state").alias("to"), F.col("to").alias("_t"), F.col("d").alias("_d"))
        step = cut(now.join(far, "to").select("state", F.col("_t").alias("to"), (F.col("d") + F.col("_d")).alias("d"), "_d"))
        now = step.drop("_d")
        if not step.filter("_d > 0").limit(1).count():
            break
    else:
        raise RuntimeError("chains haven't ended after 64 rounds")
    seen = now.select(_name("state").alias("contig"), F.right("state", F.lit(1)).alias("side"), _name("to").alias("end"), "d")
    left, right = (seen.filter(F.col("side") == k).select("contig", F.col("end").alias(f"_e{k}"), F.col("d").alias(f"_d{k}")) for k in "LR")
    ahead = F.coalesce(F.col("_eL") <= F.col("_eR"), F.lit(True))
    rows = whole.join(left, "contig", "left").join(right, "contig", "left")
    return rows.select("contig", "chain", "n_contigs", F.coalesce(F.when(ahead, F.col("_dL")).otherwise(F.col("_dR")), F.lit(0)).alias("pos"), F.when(ahead, "+").otherwise("-").alias("orientation"))


def modularity(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: q, the modularity of parts (node, part) over undirected edges a, b, weight."""
    p = parts.select("node", "part")
    rows = graph.join(p.toDF("a", "_pa"), "a").join(p.toDF("b", "_pb"), "b")
    ends = rows.select(F.col("_pa").alias("part"), "weight").unionByName(rows.select(F.col("_pb").alias("part"), "weight")).groupBy("part").agg(F.sum("weight").alias("deg"))
    inner = rows.filter("_pa = _pb").groupBy(F.col("_pa").alias("part")).agg(F.sum("weight").alias("inn"))
    total = rows.agg(F.sum("weight").alias("m"))
    joined = ends.join(inner, "part", "left").crossJoin(F.broadcast(total))
    m, d = F.col("m").cast("double"), F.col("deg") / (2.0 * F.col("m"))
    return joined.agg(F.sum(F.coalesce(F.col("inn"), F.lit(0)) / m - d * d).alias("q"))


def best_moves(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """node, part, gain: the neighbouring part that a node's move to raises modularity most, if it does; ties go to the lesser part."""
    p = cut(parts.select("node", "part"))
    both = graph.select("a", "b", F.col("weight").cast("double").alias("w")).unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").cast("double").alias("w")))
    near = cut(both.join(p.toDF("b", "_p"), "b").groupBy(F.col("a").alias("node"), F.col("_p").alias("part")).agg(F.sum("w").alias("k")))
    degree = near.groupBy("node").agg(F.sum("k").alias("deg"))
    own = degree.join(p, "node").join(near.withColumnRenamed("k", "k_own"), ["node", "part"], "left").select("node", F.col("part").alias("own"), "deg", F.coalesce("k_own", F.lit(0.0)).alias("k_own"))
    size = own.groupBy(F.col("own").alias("part")).agg(F.sum("deg").alias("d"))
    total = own.agg((F.sum("deg") / 2).alias("m"))
    rows = near.join(own, "node").filter("part <> own").join(size, "part").join(size.toDF("own", "d_own"), "own").crossJoin(F.broadcast(total))
    gain = (F.col("k") - F.col("k_own")) / F.col("m") - F.col("deg") * (F.col("d") - F.col("d_own") + F.col("deg")) / (2 * F.col("m") * F.col("m"))
    best = rows.withColumn("gain", gain).groupBy("node").agg(F.min(F.struct((-F.round("gain", 12)).alias("g"), "part")).alias("m"))
    return best.select("node", "m.part", (-F.col("m.g")).alias("gain")).filter("gain > 0")


def label_propagation(graph: DataFrame, rounds: int = 5) -> DataFrame:
    """node, label after rounds in which every node takes the label with most weight around it.

    All nodes move at once; of equal labels the bytewise smaller one wins, and a node's own label
    counts with weight 0.5, which keeps pairs from swapping labels forever.
    """
    both = cut(graph.select("a", "b", F.col("weight").cast("double").alias("w")).unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").cast("double").alias("w"))).groupBy("a", "b").agg(F.sum("w").alias("w")))
    label = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label.toDF("b", "label"), "b").select(F.col("a").alias("node"), "label", "w").unionByName(label.select("node", "label", E.double(0.5).alias("w")))
        sums = votes.groupBy("node", "label").agg(F.sum("w").alias("w"))
        label = cut(sums.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("m")).select("node", F.col("m.label").alias("label")))
    return label
