"""Operators for training data against brute force on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import components, cooccur, leaks, packing, percentile, subjects, topn


def test_pairs_of_baskets(spark):
    rng = random.Random(1)
    rows = [("l", f"b{b}", f"i{i}") for b in range(60) for i in rng.sample(range(12), 4)] + [("l", "all", f"i{i}") for i in range(12)]
    rows += rows[:30] + [(None, "b", "i"), ("l", "b1", None)]
    baskets = {}
    for s, b, i in rows:
        if s and i:
            baskets.setdefault((s, b), set()).add(i)
    both, one = {}, {}
    for (s, _), items in baskets.items():
        for i in items:
            one[i] = one.get(i, 0) + 1
        for p in itertools.combinations(sorted(items), 2):
            both[p] = both.get(p, 0) + 1
    want = {(*p, n) for p, n in both.items() if n >= 3 and n * len(baskets) >= 1.0 * one[p[0]] * one[p[1]]}
    df = spark.createDataFrame(rows, "s string, b string, i string").filter("s is not null and i is not null")
    for direct in (cooccur.DIRECT, 3):  # 3: large baskets take the other way
        got = cooccur.pair_counts(df, "s", "b", "i", 3, 1.0, direct=direct).select("item_lo", "item_hi", "n_both").collect()
        assert {tuple(r) for r in got} == want
    assert cooccur.pair_counts(df.limit(0), "s", "b", "i").count() == 0


def test_percentile_bounds_hold_and_parts_combine(spark):
    rng = np.random.default_rng(2)
    rows = [(g, d, [int(x) for x in rng.integers(1, 10**6, n)]) for g, n in (("hot", 3000), ("mid", 200), ("one", 1)) for d in range(3)]
    df = spark.createDataFrame([*rows, ("none", 0, [])], "g string, d int, v array<long>")
    days = percentile.summarise(df, ["g", "d"], "v", k=64, buffers=4)
    for summary in (percentile.summarise(df, ["g"], "v", k=64, buffers=4), percentile.combine(days.drop("d"), ["g"], k=64, buffers=4)):
        for r in percentile.quantiles(summary, ["g"], [10, 50, 90]).filter("n_values > 0").collect():
            every = sorted(x for g, _, v in rows if g == r["g"] for x in v)
            assert r["n_values"] == len(every)
            for p in (10, 50, 90):
                exact = every[-(-len(every) * p // 100) - 1]
                assert r[f"p{p}_least"] <= exact <= r[f"p{p}_most"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)] + [("hub", f"n{i}") for i in range(0, 300, 7)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(None, "x"), ("y", None), ("z", "z"), ("c0", "c1")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {(v, root(v)) for v in parent}
    df = spark.createDataFrame(edges, "a string, b string")
    got = components.connected_components(df, F.col("a"), F.col("b")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert components.connected_components(df.limit(0), F.col("a"), F.col("b")).count() == 0


def test_top_rows_of_heavy_and_light_groups(spark):
    rows = [("hot" if i % 3 else f"g{i % 20}", i % 17, i) for i in range(900)] + [(None, 5, 1000), (None, 6, 1001), ("gn", None, 1002)]
    df = spark.createDataFrame(rows, "g string, s long, id long")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {r for rs in by.values() for r in sorted(rs, key=lambda r: (-(r[1] if r[1] is not None else -1), r[2]))[:5]}
    for share in (1, topn.SHARE, 0.1):
        got = topn.top_n(df, ["g"], [F.desc("s"), F.asc("id")], 5, share).select("g", "s", "id").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    # Ties of all rows of a heavy group, and a heavy group of nulls.
    same = spark.createDataFrame([(None, 1, i) for i in range(500)] + [("x", 1, 1)], "g string, s long, id long")
    assert topn.top_n(same, ["g"], [F.desc("s")], 5).groupBy("g").count().orderBy("g").collect() == [(None, 5), ("x", 1)]
    assert topn.top_n(df.limit(0), ["g"], [F.desc("s")], 5).count() == 0


def test_the_largest_group_is_sorted_by_ranges(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id % 5000) as g", "id % 977 as s", "id")
    got = topn.top_n(rows, ["g"], [F.desc("s"), F.asc("id")], 5)
    assert "MapInArrow" in plan(got)
    want = rows.toPandas().sort_values(["g", "s", "id"], ascending=[True, False, True]).groupby("g").head(5)
    assert sorted(map(tuple, got.select("g", "id").collect())) == sorted(map(tuple, want[["g", "id"]].to_numpy().tolist()))


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing_is_valid(spark, capacity):
    rng = random.Random(4)
    rows = [(i, " ".join("word" for _ in range(rng.randrange(0, 90)))) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = packing.pack_containers(df, "k", "t", capacity=capacity, shard=100).toPandas()
    assert set(got["k"]) == set(range(302)) and not got.duplicated(["k", "piece"]).any()
    assert got.groupby("container")["n_tokens"].sum().max() <= capacity
    pieces, total = got.groupby("k")["piece"].count(), got.groupby("k")["n_tokens"].sum()
    assert ((total > capacity) == (pieces > 1)).all()
    assert got["n_tokens"].sum() / (got["container"].nunique() * capacity) > 0.85


def test_leaked_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(8)] + [(8, None), (9, ""), (10, "too short to count")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(120)]
        if i % 3 == 0:
            part = items[i % 8][1].split()
            n = 13 if i % 2 else 12
            w[50:50] = part[5 : 5 + n]
        docs.append((i, ",  ".join(w).title()))
    docs += [(60, None), (61, ""), (62, items[0][1] + " " + items[1][1])]
    split = lambda t: leaks.words(t)
    grams = lambda t: {tuple(split(t)[k : k + 13]) for k in range(len(split(t)) - 12)}
    want = {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert {tuple(r) for r in got.filter("passage").select("doc_id", "item_id").collect()} == want and want


def test_grams_are_hashes_of_their_characters():
    text = "".join(random.Random(1).choice("abcä😀") for _ in range(300))
    for q in (1, 2, 5, 7, 12):
        h = leaks._grams(text, q)
        by = {}
        for i, x in enumerate(h):
            by.setdefault(text[i : i + q], set()).add(x)
        assert len(h) == 301 - q and all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


def test_passages_with_edits_are_found(spark):
    """Two edits in every 13 words at most; one item of very short words doesn't keep others from being found so. Items come in several blocks."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(40)] + [(99, "a b c d e f g h i j k l m n o p")]
    docs, want = [], set()
    for i in range(200):
        w = [word() for _ in range(80)]
        if i % 2:
            part = list(" ".join(items[i % 40][1].split()[8:22]))
            for _ in range(2):
                at = rng.randrange(len(part))
                part[at] = rng.choice(["", "z", part[at] + "y"])
            w[40:40] = ["".join(part)]
            want.add((i, i % 40))
        docs.append((i, " ".join(w)))
    find = lambda **how: {tuple(r) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", **how).select("doc_id", "item_id").collect()}
    got = find()
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(want)
    assert find(block=1500) == got


def test_hits_in_parts_lose_no_region():
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(20))
    index = leaks.build_index([item, item + " more words here"], 12, 2, None, 13)
    held = leaks.held_texts([f"{item} other text {item}", "nothing", item], 12)
    whole = leaks._compare(index, held)
    leaks_hits, leaks.HITS = leaks.HITS, 7
    try:
        assert leaks._compare(index, held).keys() == whole.keys() == {(0, 0), (0, 1), (2, 0), (2, 1)}
    finally:
        leaks.HITS = leaks_hits


#: Enough terms that none stands in more documents than a term may.
GARDEN = ["soil", "mulch", *(f"g{a}{b}{c}" for a in "aeiou" for b in "lmn" for c in "aeiu")]
COURT = ["verdict", "appeal", *(f"c{a}{b}{c}" for a in "aeiou" for b in "rst" for c in "aeiu")]


def _prose(rng, terms, n):
    return " ".join(f"The {rng.choice(terms)} and {rng.choice(terms)} near {rng.choice(terms)}." for _ in range(n))


def test_subjects_of_documents(spark):
    rng = random.Random(6)
    docs = [(i, _prose(rng, GARDEN if i % 2 else COURT, 6), "extra") for i in range(120)]
    docs += [(200, None, None), (201, "", "x"), (202, "```\nint a = 1;\n``` https://a.example/verdict", "x"), (203, _prose(rng, GARDEN, 4) + " " + _prose(rng, COURT, 4), "x"), (1, docs[1][1], "again")]
    examples = spark.createDataFrame([(i, s, _prose(rng, w, 3)) for i, (s, w) in enumerate([("garden", GARDEN), ("law", COURT)] * 8)] + [(99, None, "soil"), (100, "law", None)], "subject_id int, subject string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    how = {"topics": 4, "models": 1}
    got = [(r["doc_id"], r["subject"]) for r in subjects.subjects_of(df, "doc_id", "text", examples, **how).collect()]
    want = [(i, "garden" if i % 2 else "law") for i in range(120)] + [(203, "garden"), (203, "law"), (1, "garden")]
    assert sorted(got) == sorted(want)
    assert subjects.subjects_of(df.limit(0), "doc_id", "text", examples, **how).count() == 0
    assert subjects.subjects_of(df, "doc_id", "text", examples.limit(0), **how).count() == 0


def test_texts_in_words(spark):
    texts = ["Soil and mulch. Verdict!\nsoil", None, "", "```\nint a = 1;\n``` See https://a.example/soil", "mulch " * 3000]
    rows = subjects.cut_texts(spark.createDataFrame(list(enumerate(texts)), "_k long, _t string")).orderBy("_k").collect()
    assert [(r["words"], r["place"], r["n_sentences"]) for r in rows[:4]] == [(["soil", "and", "mulch", "verdict", "soil"], [0, 0, 0, 1, 2], 3), ([], [], 0), ([], [], 0), (["see"], [0], 1)]
    assert rows[4]["words"] == ["mulch"] * 3000 and rows[4]["n_sentences"] == 1


def test_contexts_count_every_pair_in_the_window(spark):
    docs = [["a", "b", "x", "a", "c"], ["c", "a"], ["b"], []]
    df = spark.createDataFrame([(w, [0] * len(w)) for w in docs], "words array<string>, place array<int>")
    terms = ["a", "b", "c"]
    want = np.zeros((3, 3))
    for d in docs:
        seq = [terms.index(w) for w in d if w in terms]
        for i, j in itertools.permutations(range(len(seq)), 2):
            want[seq[i], seq[j]] += abs(i - j) <= 2
    got = [r[0].toArray() for r in subjects.contexts(df, terms, window=2).collect()]
    want = want / want.sum(1, keepdims=True) * subjects.CONTEXT
    assert sorted(x.round(6).tolist() for x in got) == sorted(want.round(6).tolist())


def test_subjects_come_from_the_topics(spark, monkeypatch):
    """Topics that are all equal tell no document from another."""
    rng = random.Random(6)
    docs = [(i, _prose(rng, GARDEN if i % 2 else COURT, 6)) for i in range(120)]
    examples = spark.createDataFrame([(s, _prose(rng, w, 6)) for s, w in [("garden", GARDEN), ("law", COURT)] * 8], "subject string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda: {(r["doc_id"], r["subject"]) for r in subjects.subjects_of(df, "doc_id", "text", examples, topics=4, models=1).collect()}
    want = {(i, "garden" if i % 2 else "law") for i in range(120)}
    assert found() == want

    class Flat(subjects.LDA):
        def fit(self, rows):
            matrix = super().fit(rows).topicsMatrix().toArray()
            return type("Model", (), {"topicsMatrix": lambda _: type("Matrix", (), {"toArray": lambda _: np.ones_like(matrix)})()})()

    monkeypatch.setattr(subjects, "LDA", Flat)
    assert len(found() & want) <= 60


def test_subjects_where_a_third_of_the_rows_are_copies(spark):
    """The terms of a copied text, and core terms of a subject that fills half of the corpus, aren't stop words."""
    rng = random.Random(7)
    docs = [(i, "The soil. " * (i % 2) + _prose(rng, GARDEN if i % 2 else COURT, 6)) for i in range(120)]
    copied = " ".join(f"The {a} and {b} near {c}." for a, b, c in zip(GARDEN[:12:3], GARDEN[1:12:3], GARDEN[2:12:3], strict=True))
    docs += [(i, copied) for i in range(120, 180)]
    examples = spark.createDataFrame([(s, _prose(rng, w, 6)) for s, w in [("garden", GARDEN), ("law", COURT)] * 8], "subject string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    how = {"topics": 4, "models": 1}
    once = subjects.cut_texts(df.toDF("_k", "_t")).dropDuplicates(["_h"])
    terms = set(subjects.fit(once, examples, **how).terms)
    assert set(GARDEN[:12]) <= terms and "the" not in terms
    got = [(r["doc_id"], r["subject"]) for r in subjects.subjects_of(df, "doc_id", "text", examples, **how).collect()]
    assert sorted(got) == [(i, "garden" if i % 2 or i >= 120 else "law") for i in range(180)]
