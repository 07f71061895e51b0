"""Contigs into chromosome groups by average linkage.

Average linkage is reducible: two clusters that are each other's best stay so until they merge. So
all such pairs merge at once in a round, and the merges sorted by score are those of the greedy
order. Contigs that no links connect never merge, so connected parts go apart: those of bounded size
within a task, larger ones by rounds of joins until a task holds what is left. The wanted number of groups is then reached by
cutting the sorted merges.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import config as C
from ..functions import exprs as E
from ..session import cut
from .components import connected_components
from .ordered import prefix_sum, row_numbers

#: Pairs of a connected part that one task holds.
HELD = 500_000
#: Share of the pairs that a round of joins has to do away with; else tasks go on.
LEAST_LOSS = 0.02
MERGES = "a string, b string, score double, size_a long, size_b long, round int"


def edge_weights(pairs: DataFrame, max_sites: int) -> DataFrame:
    """a, b, weight: links scaled by restriction sites; a < b, several rows of a pair summed."""
    rows = pairs.filter("a <> b and n > 0").withColumn("_w", E.edge_weight(F.col("n"), F.lit(max_sites), F.col("sites_a"), F.col("sites_b")))
    return rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("_w").cast("long").alias("weight")).filter("weight > 0")


def repeat_factors(edges: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig, links, factor: links of a contig over the mean number; null if there are no links at all."""
    ends = edges.select(F.col("a").alias("contig"), "weight").unionByName(edges.select(F.col("b").alias("contig"), "weight"))
    per = contigs.select("contig").join(ends.groupBy("contig").agg(F.sum("weight").alias("links")), "contig", "left").select("contig", F.coalesce("links", F.lit(0)).alias("links"))
    total = per.agg(F.sum("links").alias("_t"), F.count("*").alias("_n"))
    # Each link has two ends, so the sum of ends over contigs is the mean.
    return per.crossJoin(F.broadcast(total)).select("contig", "links", F.try_divide(F.col("links").cast("double"), F.col("_t").cast("double") / F.col("_n")).alias("factor"))


def normalised(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """Directed rows a, b, weight: each contig's weights divided by its factor and rounded up."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    f = factors.filter("factor > 0").select(F.col("contig").alias("a"), "factor")
    return both.join(f, "a").select("a", "b", F.ceil(F.col("weight") / F.col("factor")).cast("long").alias("weight"))


def skipped(contigs: DataFrame, factors: DataFrame, min_sites: int = C.MIN_RES, max_density: float = C.MAX_LINK_DENSITY) -> DataFrame:
    """contig, reason: few (restriction sites) or repeat. Null counts of sites count as few."""
    rows = contigs.select("contig", F.coalesce("recounts", F.lit(0)).alias("recounts")).join(factors.select("contig", "factor"), "contig", "left")
    reason = F.when(F.col("recounts") < min_sites, "few").when(F.col("factor") >= max_density, "repeat")
    return rows.select("contig", reason.alias("reason")).filter("reason is not null")


def merges(edges: DataFrame, max_rounds: int | None = None, held: int = HELD) -> DataFrame:
    """a, b, score, size_a, size_b, round: all merges of average linkage down to no positive score.

    Clusters are named by their least member. Ties of score go to the bytewise smaller pair of names.
    A merge has a later round than those it is made of. There are as many rounds as it takes, which a
    hub makes as many as it has neighbours; pairs that are left after `max_rounds`, if given, are an
    error.
    """
    rows = cut(edges.filter("a <> b and weight > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").cast("double").alias("w")))
    # One row a pair of clusters: sum of weights; sizes come along.
    one, n = F.lit(1).cast("long"), rows.count()
    rows = rows.select(F.lit("").alias("part"), "a", "b", "w", one.alias("sa"), one.alias("sb"))
    if n <= held:
        return cut(_merges_in_tasks(rows, n, max_rounds))
    part = connected_components(rows, F.col("a"), F.col("b")).toDF("a", "part")
    rows = cut(rows.drop("part").join(part, "a"))
    # Parts of more than `held` pairs are few.
    large = [r[0] for r in rows.groupBy("part").agg(F.count("*").alias("_n")).filter(F.col("_n") > held).select("part").collect()]
    is_large = F.col("part").isin(large) if large else F.lit(False)
    out = _merges_in_tasks(rows.filter(~is_large), n, max_rounds)
    return cut(out.unionByName(_merges_by_joins(rows.filter(is_large), max_rounds, held)) if large else out)


def _merges_in_tasks(rows: DataFrame, n: int, max_rounds: int | None, first: int = 0) -> DataFrame:
    """The merges of n pairs at most, whole parts dealt to as many tasks as they fill."""
    k = 1 + 8 * n // HELD
    dealt = rows.withColumn("_task", F.pmod(F.xxhash64("part"), F.lit(k))).repartition(k, "_task")
    return dealt.groupBy("_task").applyInPandas(_part_merges(max_rounds, first), MERGES)


def _part_merges(max_rounds: int | None, first: int = 0):
    """All merges within some parts: from cluster to best neighbour until two are each other's best, which merge.

    A heap of each cluster has its neighbours by weight over their size, as its own size is common to
    all. A neighbour that grows gets worse, so its entry is put right when it comes to the top. A
    merge takes as long as the side with fewer neighbours has neighbours, so a hub that takes one
    neighbour after the other doesn't go over all that are left each time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.r_[rows["a"].to_numpy(str), rows["b"].to_numpy(str)], return_inverse=True)
        n, sizes = len(names), np.ones(len(names), np.int64)
        sizes[at] = np.r_[rows["sa"], rows["sb"]]
        # A cluster keeps the number of the side with more neighbours; `least` is its name's, `turn` the round from which it is there.
        size, least, turn = sizes.tolist(), list(range(n)), [first] * n
        # Weight of each neighbour, and the key of its entry in the heap that counts.
        near: list[dict[int, tuple[float, float]] | None] = [{} for _ in range(n)]
        heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]

        def link(x: int, y: int, w: float) -> None:
            key = -w / size[y]
            near[x][y] = (w, key)
            heapq.heappush(heaps[x], (key, least[y], y))

        for i, j, w in zip(*at.reshape(2, -1).tolist(), rows["w"].tolist(), strict=True):
            link(i, j, w)
            link(j, i, w)

        def best(x: int) -> int:
            h, some = heaps[x], near[x]
            while h:
                key, _, y = h[0]
                if y not in some or some[y][1] != key:
                    heapq.heappop(h)
                    continue
                now = -some[y][0] / size[y]
                if now == key:
                    return y
                some[y] = (some[y][0], now)
                heapq.heapreplace(h, (now, least[y], y))
            return -1

        out: list[tuple] = []
        inside = [False] * n
        for start in range(n):
            chain = [start] if near[start] else []
            while chain:
                x = chain[-1]
                inside[x] = True
                y = best(x)
                if y < 0:
                    break
                # Scores only rise along the chain; what rounding makes a circle are ties.
                if not inside[y]:
                    chain.append(y)
                    continue
                y = chain[-2]
                del chain[-2:]
                inside[x] = inside[y] = False
                a, b = (x, y) if least[x] < least[y] else (y, x)
                w, r = near[x][y][0], max(turn[x], turn[y])
                if max_rounds is not None and r >= max_rounds:
                    raise RuntimeError(f"pairs remain after {max_rounds} rounds")
                out.append((names[least[a]], names[least[b]], w / (size[a] * size[b]), size[a], size[b], r))
                p, q = (x, y) if len(near[x]) >= len(near[y]) else (y, x)
                size[p], least[p], turn[p] = size[p] + size[q], least[a], r + 1
                gone, near[q], heaps[q] = near[q], None, []
                del near[p][q], gone[p]
                for z, (v, _) in gone.items():
                    del near[z][q]
                    v += near[p][z][0] if z in near[p] else 0
                    link(p, z, v)
                    link(z, p, v)
                if not chain:
                    chain.append(p)
        return pd.DataFrame(out, columns=["a", "b", "score", "size_a", "size_b", "round"])

    return run


def _merges_by_joins(now: DataFrame, max_rounds: int | None, held: int) -> DataFrame:
    """Rounds in which all pairs merge that are each other's best, until a task holds what is left of a part.

    Where a round leaves nearly all pairs, hubs take one neighbour after the other and would go on for
    as many rounds; then too a task takes what is left of a part, with memory in proportion to it.
    """
    out, r, before = now.sparkSession.createDataFrame([], MERGES), 0, None
    while True:
        n, most = now.groupBy("part").agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n")).first()
        if not n:
            return out
        if max_rounds is not None and r >= max_rounds:
            raise RuntimeError(f"pairs remain after {max_rounds} rounds")
        if before and (most <= held or n > before * (1 - LEAST_LOSS)):
            return out.unionByName(_merges_in_tasks(now, n, max_rounds, r))
        score = F.col("w") / (F.col("sa") * F.col("sb"))
        key = F.struct((-score).alias("s"), F.col("a").alias("p"), F.col("b").alias("q"))
        ends = now.select(F.col("a").alias("v"), key.alias("k")).unionByName(now.select(F.col("b").alias("v"), key.alias("k")))
        best = ends.groupBy("v").agg(F.min("k").alias("k"))
        # A pair that both ends hold best is given twice.
        pairs = best.groupBy("k").agg(F.count("*").alias("_c")).filter("_c = 2").select(F.col("k.p").alias("a"), F.col("k.q").alias("b"))
        step = cut(now.join(pairs, ["a", "b"]).select("a", "b", score.alias("score"), F.col("sa").alias("size_a"), F.col("sb").alias("size_b"), F.lit(r).alias("round")))
        out = out.unionByName(step)
        # Both members take the lesser name and the joint size.
        to = step.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("a").alias("to"), (F.col("size_a") + F.col("size_b")).alias("size")), F.struct(F.col("b").alias("v"), F.col("a").alias("to"), (F.col("size_a") + F.col("size_b")).alias("size")))))
        left = now.join(to.withColumnsRenamed({"v": "a", "to": "ta", "size": "za"}), "a", "left").join(to.withColumnsRenamed({"v": "b", "to": "tb", "size": "zb"}), "b", "left")
        named = left.select("part", F.coalesce("ta", "a").alias("x"), F.coalesce("za", "sa").alias("sx"), F.coalesce("tb", "b").alias("y"), F.coalesce("zb", "sb").alias("sy"), "w").filter("x <> y")
        turn = F.col("x") > F.col("y")
        pick = lambda p, q: F.when(turn, F.col(q)).otherwise(F.col(p))  # noqa: B023, E731
        now = cut(named.select("part", pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("sx", "sy").alias("sa"), pick("sy", "sx").alias("sb"), "w").groupBy("part", "a", "b").agg(F.sum("w").alias("w"), F.max("sa").alias("sa"), F.max("sb").alias("sb")))
        r, before = r + 1, n


def cut_merges(steps: DataFrame, n_contigs: int, k: int) -> DataFrame:
    """The merges that are made before there are `k` clusters of two or more, past half of the contigs."""
    # Scores fall with the greedy order, and names rise within a score; a merge never stands before those it is made of.
    few = row_numbers(steps, [F.desc("score"), F.asc("a"), F.asc("b")], "_n")
    gain = (F.col("size_a") == 1).cast("int") + (F.col("size_b") == 1).cast("int") - 1
    run = prefix_sum(few, [], "_n", gain, "_before").withColumn("_k", F.col("_before") + gain)
    stop = run.filter((F.col("_n") > n_contigs // 2) & (F.col("_k") == k)).agg(F.min("_n").alias("_stop"))
    return run.crossJoin(F.broadcast(stop)).filter("_stop is null or _n <= _stop").select("a", "b", "score", "size_a", "size_b", "round")


def members(steps: DataFrame) -> DataFrame:
    """contig, cluster (its least member) after some merges; contigs without a merge have no row."""
    # A cluster has its least member's name, so merges link those members: what they connect is a cluster.
    steps = cut(steps.select("a", "b"))
    if steps.count() > HELD:
        return connected_components(steps, F.col("a"), F.col("b")).toDF("contig", "cluster")
    return steps.groupBy(F.lit(0).alias("_task")).applyInPandas(_joined, "contig string, cluster string")


def _joined(steps: pd.DataFrame) -> pd.DataFrame:
    """What the merges connect, by the least name."""
    names, at = np.unique(np.r_[steps["a"].to_numpy(str), steps["b"].to_numpy(str)], return_inverse=True)
    to = list(range(len(names)))

    def root(x: int) -> int:
        while to[x] != x:
            to[x] = x = to[to[x]]
        return x

    for a, b in zip(*at.reshape(2, -1).tolist(), strict=True):
        a, b = root(a), root(b)
        to[max(a, b)] = min(a, b)
    return pd.DataFrame({"contig": names, "cluster": names[[root(x) for x in range(len(names))]]})


def cluster(edges: DataFrame, n_contigs: int, k: int) -> DataFrame:
    """contig, cluster: average linkage down to k clusters that aren't single, if it gets there."""
    return members(cut_merges(merges(edges), n_contigs, k))


def linkage(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """contig, cluster, avg_weight: average weight between a contig and the members of each cluster, itself apart."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("_s"))
    rows = edges.join(clusters.withColumnRenamed("contig", "b"), "b").groupBy(F.col("a").alias("contig"), "cluster").agg(F.sum("weight").alias("_w"))
    own = clusters.select("contig", "cluster", F.lit(1).alias("_own"))
    full = rows.join(size, "cluster").join(own, ["contig", "cluster"], "left").withColumn("_n", F.col("_s") - F.coalesce("_own", F.lit(0)))
    return full.filter("_n > 0").select("contig", "cluster", (F.col("_w") / F.col("_n")).alias("avg_weight"))


def recover(edges: DataFrame, clusters: DataFrame, skip: DataFrame, ratio: float = C.NON_INFORMATIVE_RATIO) -> DataFrame:
    """contig, cluster of skipped contigs whose best cluster is clear: at least `ratio`, and `ratio` times the second."""
    cand = linkage(edges, clusters).join(skip.select("contig"), "contig", "left_semi")
    ranked = cand.withColumn("_r", F.row_number().over(W.partitionBy("contig").orderBy(F.desc("avg_weight"), "cluster"))).filter("_r <= 2")
    top = ranked.groupBy("contig").agg(F.max_by("cluster", -F.col("_r")).alias("cluster"), F.max("avg_weight").alias("_1"), F.max(F.when(F.col("_r") == 2, F.col("avg_weight"))).alias("_2"))
    return top.filter((F.col("_1") >= ratio) & (F.col("_2").isNull() | (F.col("_2") == 0) | (F.col("_1") >= ratio * F.col("_2")))).select("contig", "cluster")


def cluster_sizes(clusters: DataFrame, lengths: DataFrame) -> DataFrame:
    """cluster, n_members, total_length, rank (1: the longest), n_clusters."""
    per = clusters.join(lengths.select("contig", "length"), "contig").groupBy("cluster").agg(F.count("*").alias("n_members"), F.sum("length").alias("total_length"))
    ranked = row_numbers(per, [F.desc("total_length"), F.asc("cluster")], "rank").withColumn("rank", F.col("rank").cast("int"))
    return ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("n_clusters"))))
