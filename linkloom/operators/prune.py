"""Labels of contig pairs that link alleles rather than neighbours."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as E
from ..session import cut
from .components import connected_components

#: In labels, groups with more members are given by number: a list of all members in every row would grow with the square.
MOST_NAMED = 64
#: Edges of two groups that are matched as they are; more are first split into connected components.
WHOLE = 1000
#: Widest matrix that is held in full; wider ones are matched from the list of their edges.
WIDEST = 256


def allelic(edges: DataFrame, groups: DataFrame, a: str = "contig1", b: str = "contig2") -> DataFrame:
    """`edges` with _allelic: whether both contigs are in one group.

    Each edge looks for its two contigs in the same group; groups are never expanded into pairs, so
    a very large group costs no more than its rows. Nulls are in no group.
    """
    g = groups.filter("ctg is not null and groupid is not null").select("ctg", "groupid").distinct()
    ends = edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    one = ends.join(g.select(F.col("ctg").alias("_a"), "groupid"), "_a")
    hit = one.join(g.select(F.col("ctg").alias("_b"), "groupid"), ["_b", "groupid"], "left_semi").select("_a", "_b").distinct().withColumn("_allelic", F.lit(True))
    return edges.join(hit, (edges[a] == hit._a) & (edges[b] == hit._b), "left").drop("_a", "_b").withColumn("_allelic", F.coalesce("_allelic", F.lit(False)))


def best_per_group(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """contig, groupid, best: the most links of a contig with any member of an allele group."""
    g = groups.filter("ctg is not null and groupid is not null").distinct()
    both = edges.select(F.col("a").alias("contig"), F.col("b").alias("ctg"), "n").unionByName(edges.select(F.col("b").alias("contig"), F.col("a").alias("ctg"), "n"))
    return both.groupBy("contig", "ctg").agg(F.max("n").alias("n")).join(g, "ctg").groupBy("contig", "groupid").agg(F.max("n").alias("best"))


def assign(weights: np.ndarray) -> np.ndarray:
    """Maximum-weight assignment of rows to columns of a square matrix: the column of each row.

    Shortest augmenting paths with potentials; ties go to the lower column.
    """
    n = len(weights)
    cost = weights.max(initial=0) - weights
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, int)  # row at each column, from 1; 0: none
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, before, seen = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            seen[j] = True
            slack = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], before[1:][better] = slack[better], j
            nxt = 1 + int(np.argmin(np.where(seen[1:], np.inf, least[1:])))
            step = least[nxt]
            u[row_of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = nxt
            if row_of[j] == 0:
                break
        while j:
            row_of[j], j = row_of[before[j]], before[j]
    out = np.empty(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def assign_sparse(rows: list[list[tuple[int, float]]], n_cols: int) -> list[int]:
    """Maximum-weight matching of rows, given as lists of (column, weight), to columns: the column of each row, or -1.

    Shortest augmenting paths with potentials, as in `assign`, over the given edges alone; a path may
    also end by leaving a row without a column.
    """
    u, v = [max((w for _, w in r), default=0) for r in rows], [0] * n_cols
    col_of, row_of = [-1] * len(rows), [-1] * n_cols
    for i in range(len(rows)):
        least, via, met, done, heap = {}, {}, {i: 0}, {}, []
        r, d, best, free, drop = i, 0, u[i], -1, i
        while True:
            if d + u[r] < best:
                best, drop = d + u[r], r
            for j, w in rows[r]:
                at = d + u[r] + v[j] - w
                if at < best and at < least.get(j, best):
                    least[j], via[j] = at, r
                    heapq.heappush(heap, (at, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            d, j = heapq.heappop(heap)
            if row_of[j] < 0:
                best, free = d, j
                break
            done[j] = d
            r = row_of[j]
            met[r] = d
        for r, d in met.items():
            u[r] -= best - d
        for j, d in done.items():
            v[j] += best - d
        j = free
        if free < 0:
            if drop == i:
                continue
            j, col_of[drop] = col_of[drop], -1
        while True:
            r = via[j]
            row_of[j], col_of[r], j = r, j, col_of[r]
            if r == i:
                break
    return col_of


def _match(rows: pd.DataFrame) -> pd.DataFrame:
    left, right = np.unique(rows["x"]), np.unique(rows["y"])
    i, j = np.searchsorted(left, rows["x"]), np.searchsorted(right, rows["y"])
    if max(len(left), len(right)) <= WIDEST:
        m = np.zeros((max(len(left), len(right)),) * 2)
        np.maximum.at(m, (i, j), rows["n"].to_numpy(float))
        to = assign(m)
    else:
        lists = [[] for _ in left]
        for k, c, w in zip(i.tolist(), j.tolist(), rows["n"].tolist(), strict=True):
            lists[k].append((c, w))
        to = np.array(assign_sparse(lists, len(right)))
    return rows[["gx", "gy", "x", "y", "ahead"]].assign(kept=to[i] == j)


def cross_allelic(edges: DataFrame, groups: DataFrame, whole: int = WHOLE) -> DataFrame:
    """a, b, n, label: edges between two allele groups that a maximum-weight matching of the groups leaves out.

    For every pair of groups that edges link, all edges between them are matched, whichever of their
    ends comes first by name; an edge gets the label of the first pair of groups (by number) where it
    isn't matched, else ok. Contigs in no group stay ok. Only members with edges enter; as weights
    are not negative this changes no sum. The edges of a pair of groups are matched in one task, or,
    if they are more than `whole`, those of each of their connected components.
    """
    g = groups.filter("ctg is not null and groupid is not null").select("ctg", "groupid").distinct()
    e = edges.select("a", "b", "n")
    both = e.join(g.select(F.col("ctg").alias("a"), F.col("groupid").alias("ga")), "a").join(g.select(F.col("ctg").alias("b"), F.col("groupid").alias("gb")), "b").filter("ga <> gb")
    ahead = F.col("ga") < F.col("gb")
    pick = lambda c, d: F.when(ahead, F.col(c)).otherwise(F.col(d))
    sides = cut(both.select(pick("ga", "gb").alias("gx"), pick("gb", "ga").alias("gy"), pick("a", "b").alias("x"), pick("b", "a").alias("y"), "n", ahead.alias("ahead")))
    # A lone edge of two groups is its own matching, so Python sees only the others.
    count = sides.groupBy("gx", "gy").agg(F.count("*").alias("_c")).filter("_c > 1")
    many = cut(sides.join(count, ["gx", "gy"]))
    schema = T.StructType([sides.schema[c] for c in ("gx", "gy", "x", "y", "ahead")] + [T.StructField("kept", T.BooleanType())])
    failed = many.filter(F.col("_c") <= whole).groupBy("gx", "gy").applyInPandas(_match, schema)
    node = lambda side: F.concat_ws("\x1f", "gx", "gy", F.lit(side), side)
    wide = many.filter(F.col("_c") > whole).withColumn("_x", node("x"))
    part = connected_components(wide, F.col("_x"), node("y")).toDF("_x", "_part")
    failed = failed.unionByName(wide.join(part, "_x").groupBy("_part").applyInPandas(_match, schema)).filter("not kept")
    failed = failed.select(F.when(F.col("ahead"), F.struct(F.col("x").alias("a"), F.col("y").alias("b"), F.col("gx").alias("ga"), F.col("gy").alias("gb"))).otherwise(F.struct(F.col("y").alias("a"), F.col("x").alias("b"), F.col("gy").alias("ga"), F.col("gx").alias("gb"))).alias("_e")).select("_e.*")
    failed = failed.groupBy("a", "b").agg(F.min(F.struct("ga", "gb")).alias("_f"))
    size = g.groupBy("groupid").agg(F.count("*").alias("_s"))
    small_names = g.join(size.filter(F.col("_s") <= MOST_NAMED), "groupid").groupBy("groupid").agg(F.sort_array(F.collect_list("ctg")).alias("_m"))
    named = failed.select("a", "b", F.col("_f.ga").alias("ga"), F.col("_f.gb").alias("gb"))
    named = named.join(small_names.select(F.col("groupid").alias("ga"), F.col("_m").alias("_ma")), "ga", "left").join(small_names.select(F.col("groupid").alias("gb"), F.col("_m").alias("_mb")), "gb", "left")
    by_number = lambda m, k: F.coalesce(F.col(m), F.array(F.concat(F.lit("group "), F.col(k).cast("string"))))
    label = named.select("a", "b", E.allele_label(by_number("_ma", "ga"), by_number("_mb", "gb")).alias("label"))
    return e.join(label, ["a", "b"], "left").select("a", "b", "n", F.coalesce("label", F.lit("ok")).alias("label"))


def prune(edges: DataFrame, groups: DataFrame, whole: int = WHOLE) -> DataFrame:
    """a, b, n, label: `allelic` for edges within a group; the others are matched by cross_allelic, which these don't enter."""
    rows = cut(allelic(edges.select("a", "b", "n"), groups, "a", "b"))
    within = rows.filter("_allelic").select("a", "b", "n", F.lit("allelic").alias("label"))
    return cross_allelic(rows.filter("not _allelic"), groups, whole).unionByName(within)
