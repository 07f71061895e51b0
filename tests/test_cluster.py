"""Clustering, numbering and groups against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import cluster, components, ordered


def greedy(edges, n_contigs, k):
    """Average linkage, one merge at a time: the clusters of two or more when it stops."""
    members = {c: {c} for e in edges for c in e}
    w = {frozenset(e): x for e, x in edges.items()}
    made, multi = 0, 0
    while w:
        score = lambda p: (-w[p] / len(members[min(p)]) / len(members[max(p)]), sorted(p))
        best = min(w, key=score)
        a, b = sorted(best)
        multi += (len(members[a]) == 1) + (len(members[b]) == 1) - 1
        members[a] |= members.pop(b)
        del w[best]
        for p in [p for p in w if b in p]:
            (c,) = p - {b}
            x = w.pop(p)
            w[frozenset((a, c))] = w.get(frozenset((a, c)), 0) + x
        made += 1
        if made > n_contigs // 2 and multi == k:
            break
    return {frozenset(m) for m in members.values() if len(m) > 1}


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(4)
    names = [f"c{i:02}" for i in range(36)]
    # Three blocks, and a part of its own without links to them; weights that make no two scores equal.
    out = {}
    for i, j in itertools.combinations(range(30), 2):
        if rng.random() < (0.8 if i // 10 == j // 10 else 0.15):
            out[names[i], names[j]] = rng.randrange(1, 10**6) * (10 if i // 10 == j // 10 else 1)
    for i in range(31, 35):
        out[names[i], names[i + 1]] = rng.randrange(1, 10**6)
    return out


@pytest.mark.parametrize("held", [0, cluster.HELD])
def test_clusters_are_those_of_one_merge_at_a_time(spark, weights, held):
    df = spark.createDataFrame([(b, a, w, "x") for (a, b), w in weights.items()], "a string, b string, weight long, score string")
    steps = cluster.merges(df, held=held)
    for k in (2, 4):
        got = {}
        for r in cluster.members(cluster.cut_merges(steps, 35, k)).collect():
            got.setdefault(r["cluster"], set()).add(r["contig"])
        assert {frozenset(v) for v in got.values()} == greedy(weights, 35, k)
        assert all(c == min(v) for c, v in got.items())


def test_no_edges_make_no_clusters(spark):
    df = spark.createDataFrame([("a", "a", 5), ("a", "b", 0), (None, "b", 3)], "a string, b string, weight long")
    assert cluster.cluster(df, 2, 1).count() == 0


@pytest.mark.parametrize("held", [0, cluster.HELD])
def test_merges_that_do_not_end_fail(spark, weights, held):
    df = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "a string, b string, weight long")
    with pytest.raises(Exception, match="pairs remain"):
        cluster.merges(df, max_rounds=2, held=held).collect()


def test_rows_are_numbered_in_order(spark):
    rows = [(i * 7919 % 101, i) for i in range(500)]
    got = ordered.row_numbers(spark.createDataFrame(rows, "v long, id long"), [F.desc("v"), F.asc("id")], "n").collect()
    assert [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["n"] for r in got) == list(range(1, 501))


def test_ranks_among_ties(spark):
    rng = np.random.default_rng(0)
    v = np.r_[rng.integers(0, 50, 3000), np.full(3000, 17), rng.integers(-9, 9, 50)].astype(float)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    ranks = [0, 1, 700, 3000, 5000, len(v) - 1]
    assert ordered.rank_value(df, "x", ranks, len(v)) == {r: float(np.sort(v)[r]) for r in ranks}


def test_a_star_is_one_group_without_a_long_task(spark, monkeypatch):
    """A hub with so many leaves that its rows, and later its group's, are looked up by broadcast."""
    monkeypatch.setattr(components, "LEAST", 1000)
    n = 20_000
    star = spark.range(n).select(F.lit("hub").alias("a"), F.concat(F.lit("leaf"), F.col("id")).alias("b"))
    chain = spark.range(50).select(F.concat(F.lit("z"), F.col("id")).alias("a"), F.concat(F.lit("z"), F.col("id") + 1).alias("b"))
    got = components.connected_components(star.unionByName(chain), F.col("a"), F.col("b"))
    assert sorted(map(tuple, got.groupBy("groupname").count().collect())) == [("hub", n + 1), ("z0", 51)]


@pytest.mark.parametrize("held", [0, 1500, cluster.HELD])
def test_a_hub_takes_as_many_rounds_as_it_has_neighbours(spark, held):
    """Leaves that merge with their hub one after the other, more than 1,000 of them; beside them a part of its own."""
    n = 1200
    star = [("hub", f"x{i:04}", 10**9 - i * i) for i in range(n)] + [("x0005", "x0007", 1)]
    part = [(f"z{i:03}", f"z{i + 1:03}", 1 + i * 7919 % 997) for i in range(500)]
    steps = cluster.merges(spark.createDataFrame(star + part, "a string, b string, weight long"), held=held)
    rows = {r["b"]: r for r in steps.filter("a = 'hub'").collect()}
    assert len(rows) == n and steps.count() == n + 500
    for i in range(n):
        r = rows[f"x{i:04}"]
        assert (r["size_a"], r["size_b"]) == (i + 1, 1)
        assert r["score"] == pytest.approx((10**9 - i * i + (i == 7)) / (i + 1), rel=1e-12)
    assert cluster.members(steps).groupBy("cluster").count().orderBy("cluster").collect() == [("hub", n + 1), ("z000", 501)]


def test_ties_go_by_name_in_tasks_and_joins_alike(spark):
    rng = random.Random(8)
    rows = [(f"c{i:02}", f"c{j:02}", rng.randrange(1, 4)) for i, j in itertools.combinations(range(40), 2) if rng.random() < 0.2]
    df = spark.createDataFrame(rows, "a string, b string, weight long")
    cols = ["a", "b", "score", "size_a", "size_b"]
    one, two = (sorted(map(tuple, cluster.merges(df, held=h).select(cols).collect())) for h in (0, cluster.HELD))
    assert one == two and len(one) == 39
