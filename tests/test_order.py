"""Orientation, matching and chains against dense or plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import graph, order, prune


@pytest.fixture(scope="module")
def hub():
    """Two connected parts; the first has a hub, whose row sum lies far above the leading eigenvalue."""
    rng = np.random.default_rng(3)
    n, edges = 60, {}
    for i in range(1, n):
        edges[i - 1, i] = int(rng.choice([-1, 1]) * rng.integers(1, 9))
        if i > 1:
            edges[0, i] = int(rng.choice([-1, 1]))
    for i in range(n + 1, n + 12):
        edges[i - 1, i] = int(rng.choice([-1, 1]) * rng.integers(1, 9))
    return n, n + 12, edges


@pytest.mark.parametrize("held", [0, order.HELD])
def test_leading_signs_equal_a_dense_eigenvector(spark, hub, held):
    n, full, edges = hub
    tour = spark.createDataFrame([("g", i, f"c{i}", 1, 1) for i in range(full + 2)], "grp string, pos long, contig string, size long, sign int")
    strands = spark.createDataFrame([(f"c{i}", f"c{j}", v) for (i, j), v in edges.items()], "a string, b string, v long")
    m = np.zeros((full, full))
    for (i, j), v in edges.items():
        m[i, j] = m[j, i] = v
    want = [1] * (full + 2)
    for lo, hi in ((0, n), (n, full)):
        x = np.linalg.eigh(m[lo:hi, lo:hi])[1][:, -1]
        for i in range(lo, hi):
            if abs(x[i - lo]) > 1e-9:
                want[i] = 1 if (x[i - lo] < 0) == (x[0] < 0) else -1
    got = {r["pos"]: r["sign"] for r in order.leading_signs(strands, tour, held=held).collect()}
    assert [got[i] for i in range(full + 2)] == want


@pytest.mark.parametrize("held", [0, order.HELD])
def test_leading_signs_that_have_not_settled_fail(spark, hub, held):
    _, full, edges = hub
    tour = spark.createDataFrame([("g", i, f"c{i}", 1, 1) for i in range(full)], "grp string, pos long, contig string, size long, sign int")
    strands = spark.createDataFrame([(f"c{i}", f"c{j}", v) for (i, j), v in edges.items()], "a string, b string, v long")
    with pytest.raises(Exception, match="settled"):
        order.leading_signs(strands, tour, held=held, max_rounds=2).collect()


def test_sparse_matching_is_maximal():
    rng = np.random.default_rng(0)
    for n, m, share in [(1, 1, 1.0), (3, 5, 0.5), (5, 3, 0.7), (6, 6, 0.4), (5, 5, 1.0)] * 8:
        w = rng.integers(1, 9, (n, m)) * (rng.random((n, m)) < share)
        to = prune.assign_sparse([[(j, int(w[i, j])) for j in range(m) if w[i, j]] for i in range(n)], m)
        full = np.zeros((max(n, m),) * 2)
        full[:n, :m] = w
        used = [j for j in to if j >= 0]
        assert len(used) == len(set(used)) and all(j < 0 or w[i, j] for i, j in enumerate(to))
        assert sum(w[i, j] for i, j in enumerate(to) if j >= 0) == full[range(len(full)), prune.assign(full)].sum()


@pytest.mark.parametrize("whole", [0, 1000])
def test_groups_of_any_size_are_matched_one_to_one(spark, whole):
    """Two groups of 100 members each, of which five are linked, some by names in the other order."""
    one, two = [f"c{2 * i:04}" for i in range(100)], [f"c{2 * i + 1:04}" for i in range(100)]
    groups = spark.createDataFrame([(c, 1) for c in one] + [(c, 2) for c in two], "ctg string, groupid long")
    edges = [(one[0], two[0], 9), (one[0], two[1], 8), (one[1], two[0], 8), (two[2], one[50], 5), (one[1], two[2], 1), (one[60], two[60], 7), (two[60], one[70], 7)]
    got = {(r["a"], r["b"]): r["label"] for r in prune.cross_allelic(spark.createDataFrame(edges, "a string, b string, n long"), groups, whole).collect()}
    kept = [x for x in edges if got[x[:2]] == "ok"]
    ends = list(itertools.chain.from_iterable(x[:2] for x in kept))
    assert len(got) == len(edges) and len(ends) == len(set(ends))
    assert sum(x[2] for x in kept) == 8 + 8 + 5 + 7
    assert got[one[0], two[0]] == "cross-allelic(group 1|group 2)"
    lost = [x for x in edges if got[x[:2]] != "ok" and x[0] == two[60]]
    assert all(got[x[:2]] == "cross-allelic(group 2|group 1)" for x in lost)


def test_long_chains_with_shuffled_names_stay_whole(spark):
    names = [f"t{i:05}" for i in range(3000)]
    random.Random(5).shuffle(names)
    ring = [f"r{i}" for i in range(40)]
    partners = [(f"{a}:R", f"{b}:L", 5) for a, b in itertools.pairwise(names)] + [(f"{a}:R", f"{b}:L", 3 + (a != "r7")) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    contigs = spark.createDataFrame([(c,) for c in [*names, *ring, "alone"]], "contig string")
    rows = graph.chains(spark.createDataFrame(partners, "a string, b string, weight long"), contigs).collect()
    got = {r["contig"]: (r["chain"], r["n_contigs"], r["cut_x"]) for r in rows}
    assert len(rows) == 3041 and {got[c] for c in names} == {("t00000", 3000, None)}
    assert {got[c] for c in ring} == {("r0", 40, "r7")} and got["alone"] == ("alone", 1, None)


def test_signs_are_flipped_until_nothing_gains(spark):
    rng = np.random.default_rng(2)
    n = 24
    tour = spark.createDataFrame([("g", i, f"c{i:02}", 1000, 1) for i in range(n)], "grp string, pos long, contig string, size long, sign int")
    hist = [(f"c{i:02}", f"c{j:02}", ao, bo, 18 + int(rng.integers(0, 3)), int(rng.integers(1, 50))) for i in range(n) for j in range(i + 1, min(n, i + 3)) for ao in "+-" for bo in "+-" if rng.random() < 0.7]
    hists = spark.createDataFrame(hist, "a string, b string, ao string, bo string, bucket int, cnt long")
    done = order.improve_signs(hists, tour)
    score = lambda t: order.orientation_score(hists, t).first()["score"]
    pairs = [r.asDict() for r in order._pair_scores(hists, tour).collect()]
    value = lambda s: sum(p["s"] for p in pairs if s[p["x"]] == p["ox"] and s[p["y"]] == p["oy"])
    signs = {r["contig"]: r["sign"] for r in done.collect()}
    best = value(signs)
    assert abs(best - score(done)) < 1e-6 and best > value(dict.fromkeys(signs, 1))
    assert all(value(signs | {c: -signs[c]}) <= best + 1e-6 for c in signs)
    assert value({c: -s for c, s in signs.items()}) <= best + 1e-6


def test_segments_change_place(spark):
    """A chain whose stretches of four lie in another order: no search within stretches joins them."""
    at = [i + 4 * b for b in (2, 0, 3, 1) for i in range(4)]
    tour = spark.createDataFrame([("g", p, f"c{c:02}", 1000) for p, c in enumerate(at)], "grp string, pos long, contig string, size long")
    contacts = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}", 100) for i in range(15)], "a string, b string, n long")
    got = [r["contig"] for r in order.improve_order(contacts, tour, segment=4, people=20, stale=40).orderBy("pos").collect()]
    assert got in (sorted(got), sorted(got)[::-1])


def test_moves_are_rearrangements_and_none_is_left_that_gains():
    rng = np.random.default_rng(1)
    k = 9
    size, n = rng.integers(10, 99, k).astype(float), 20
    a = rng.integers(0, k, n)
    b = (a + rng.integers(1, k, n)) % k
    links = np.c_[np.minimum(a, b), np.maximum(a, b), rng.integers(1, 9, n), size[np.minimum(a, b)] / 3, size[np.maximum(a, b)] / 5]
    best = order.descend(np.arange(k), size, links)
    value = lambda x: order.segment_scores(np.array([x]), size, links)[0]
    assert sorted(best % k) == list(range(k)) and value(best) <= value(np.arange(k))
    for i, j in itertools.combinations_with_replacement(range(k), 2):
        for kind in range(5):
            new = order.moved(best[None, :], np.array([kind]), np.array([i]), np.array([j]), k)[0]
            assert sorted(new % k) == list(range(k)) and value(new) >= value(best) - 1e-9 * abs(value(best))
    found = order.search(size, links, 3, 20, 50)
    assert sorted(found % k) == list(range(k)) and value(found) <= value(best)


def test_search_takes_the_stated_population_and_patience():
    import inspect

    from linkloom import config as C

    how = inspect.signature(order.improve_order).parameters
    assert (how["people"].default, how["stale"].default) == (C.NPOP, C.NGEN) == (100, 5000)


def test_paths_split_where_few_links_cross(spark):
    tour = spark.createDataFrame([("g", i, f"c{i}", 100, -1 if i == 2 else 1) for i in range(8)], "grp string, pos long, contig string, size long, sign int")
    links = [(f"c{i}", f"c{i + 1}", 90, 10) for i in range(7) for _ in range(1 if i == 3 else 6)]
    got = order.split_weak(spark.createDataFrame(links, "a string, b string, apos long, bpos long"), tour, (1, 2), reach=300, samples=800).collect()
    pieces = {r["contig"]: r["piece"] for r in got}
    place = lambda i, p: 100 * i + (100 - p if i == 2 else p)
    spans = [sorted((place(int(a[1:]), x), place(int(b[1:]), y))) for a, b, x, y in links]
    crossed = lambda p: sum(s < p for s, _ in spans) - sum(e < p for _, e in spans)
    weak = sorted(crossed(p) for p in range(800))[400]
    want, piece = {}, 0
    for i in range(8):
        piece += 300 <= 100 * i < 500 and crossed(100 * i) < weak
        want[f"c{i}"] = piece
    assert pieces == want and {r["contig"]: r["strength"] for r in got} == {f"c{i}": crossed(100 * i) for i in range(8)}


def test_places_along_chains_and_cycles(spark):
    rng = random.Random(3)
    names = [f"t{i:03}" for i in range(200)]
    rng.shuffle(names)
    turned = {c: rng.random() < 0.5 for c in names}
    out = lambda c: f"{c}:{'L' if turned[c] else 'R'}"
    into = lambda c: f"{c}:{'R' if turned[c] else 'L'}"
    partners = [(*sorted((out(a), into(b))), 5) for a, b in itertools.pairwise(names)] + [("r0:R", "r1:L", 4), ("r1:R", "r2:L", 2), ("r0:L", "r2:R", 3)]
    contigs = spark.createDataFrame([(c,) for c in [*names, "r0", "r1", "r2", "alone"]], "contig string")
    got = {r["contig"]: (r["pos"], r["orientation"]) for r in graph.chain_order(spark.createDataFrame(partners, "a string, b string, weight long"), contigs).collect()}
    order_ = names if names[0] < names[-1] else names[::-1]
    plus = lambda c: turned[c] != (order_ is names)
    assert {c: got[c] for c in names} == {c: (i, "+" if plus(c) else "-") for i, c in enumerate(order_)}
    # The ring opens between r1 and r2, its lightest join.
    assert [got[c] for c in ("r1", "r0", "r2", "alone")] == [(0, "-"), (1, "-"), (2, "-"), (0, "+")]


def test_edges_within_a_group_do_not_enter_the_matching(spark):
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), (None, 2), ("d", None)], "ctg string, groupid long")
    edges = spark.createDataFrame([("a", "b", 9), ("a", "c", 5), ("b", "c", 4), ("c", "d", 3)], "a string, b string, n long")
    got = {(r["a"], r["b"]): r["label"] for r in prune.prune(edges, groups).collect()}
    assert got == {("a", "b"): "allelic", ("a", "c"): "ok", ("b", "c"): "cross-allelic(a,b|c)", ("c", "d"): "ok"}


def test_all_orders_of_few_pieces_are_tried():
    size = np.array([5.0, 9.0, 2.0])
    links = np.array([[0, 1, 4, 5, 1], [0, 2, 9, 0, 1], [1, 2, 1, 3, 2]], float)
    best = order.best_of_all(size, links)
    every = [np.array(p) + 3 * np.array(t) for p in itertools.permutations(range(3)) for t in itertools.product((0, 1), repeat=3)]
    value = lambda x: order.segment_scores(np.array([x]), size, links)[0]
    assert abs(value(best) - min(map(value, every))) < 1e-12
    alone = np.array([[0, 1, 1, 2.5, 4.5]])
    assert order.best_of_all(size[:2], alone).tolist() == [0, 1]


def _dropped(tour, contacts, limit=10_000_000):
    """The gain of each contig by scoring the tour again without it."""

    def score(names):
        at, cum = {}, 0
        for c in names:
            at[c] = cum + tour[c] / 2
            cum += tour[c]
        return sum(n / abs(at[a] - at[b]) for a, b, n in contacts if a in at and b in at and abs(at[a] - at[b]) <= limit)

    names = list(tour)
    return {c: score(names) - score([x for x in names if x != c]) for c in names}


@pytest.mark.parametrize("block", [4, 256])
def test_gains_of_contigs_are_those_of_scoring_without_them(spark, block):
    rng = np.random.default_rng(5)
    size = {f"c{i:02}": int(rng.integers(1, 3_000_000)) for i in range(20)}
    some = [("c%02d" % i, "c%02d" % j, int(rng.integers(1, 50))) for i, j in itertools.combinations(range(19), 2) if rng.random() < 0.4]
    tour = spark.createDataFrame([("g", i, c, s) for i, (c, s) in enumerate(size.items())] + [("h", 0, "z", 5)], "grp string, pos long, contig string, size long")
    contacts = spark.createDataFrame([*some, ("c01", "z", 9), ("c01", "nowhere", 9)], "a string, b string, n long").withColumn("_held", F.lit(1))
    got = {r["contig"]: r["gain"] for r in order.leave_one_out(contacts, tour, block=block).collect()}
    want = _dropped(size, some) | {"z": 0.0}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_contigs_that_add_nothing_go_from_the_tour(spark):
    size = {f"c{i:02}": 1000 + i for i in range(12)}
    links = [(f"c{i:02}", f"c{j:02}", 50) for i, j in itertools.combinations(range(12), 2) if 5 not in (i, j)]
    tour = spark.createDataFrame([("g", i, c, s) for i, (c, s) in enumerate(size.items())], "grp string, pos long, contig string, size long")
    got = order.prune_tour(spark.createDataFrame(links, "a string, b string, n long"), tour).orderBy("pos").collect()
    assert [(r["pos"], r["contig"]) for r in got] == list(enumerate(c for c in size if c != "c05"))
    assert not order.prune_tour(spark.createDataFrame([], "a string, b string, n long"), tour.limit(0)).count()


def test_contigs_linked_from_far_away_are_chained():
    rng = np.random.default_rng(6)
    k = 3000
    at = rng.permutation(k)
    links = np.c_[at[:1999], at[1:2000], np.full(1999, 7)]
    got = order.chained(np.full(k, 1000), links).tolist()
    assert got[:2000] in (at[:2000].tolist(), at[:2000][::-1].tolist()) and got[2000:] == sorted(at[2000:])
    hub = np.array([[5, i, 1 + i] for i in range(40) if i != 5])
    assert sorted(order.chained(np.full(41, 9), hub)) == list(range(41))
    assert order.chained(np.full(3, 9), np.zeros((0, 3))).tolist() == [0, 1, 2]


def test_contigs_far_from_those_they_are_linked_to_come_together(spark):
    """A chain in mixed order, many segments long, beside a group without links: the order is found whole."""
    rng = random.Random(9)
    names = [f"c{i:03}" for i in range(120)]
    mixed = rng.sample(names, len(names))
    tour = spark.createDataFrame([("g", p, c, 1000) for p, c in enumerate(mixed)] + [("h", p, f"h{p}", 10) for p in range(3)], "grp string, pos long, contig string, size long")
    contacts = spark.createDataFrame([(a, b, 100) for a, b in itertools.pairwise(names)], "a string, b string, n long")
    rows = order.improve_order(contacts, tour, segment=16, people=10, stale=10).orderBy("grp", "pos").collect()
    got = [r["contig"] for r in rows if r["grp"] == "g"]
    assert got in (names, names[::-1])
    assert [(r["pos"], r["contig"]) for r in rows if r["grp"] == "h"] == [(p, f"h{p}") for p in range(3)]
