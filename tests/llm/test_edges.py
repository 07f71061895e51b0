"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from linkloom.llm import components, cooccur, leaks, packing, percentile, topn


@pytest.mark.parametrize("share", [1 / 256, 1.0])
def test_top_rows_with_nulls_ties_and_clashing_names(spark, share):
    rows = [(None, 1, i % 4, "n") for i in range(40)] + [("g", 1, 5, "t")] * 9 + [("h", None, 0, "x"), ("h", 2, None, None)]
    df = spark.createDataFrame(rows, "g string, _salt int, _rank int, _rows string").withColumns({"_h_g": F.lit(0), "rank": F.lit(1)})
    order = [F.desc("_rank"), F.asc("_salt"), F.asc("_rows")]
    got = topn.top_n(df, ["g"], order, 3, share=share)
    assert got.columns == df.columns
    seen = sorted((r["g"] or "", -1 if r["_rank"] is None else r["_rank"]) for r in got.collect())
    assert seen == sorted([("", 3)] * 3 + [("g", 5)] * 3 + [("h", 0), ("h", -1)])
    assert topn.top_n(df.limit(0), ["g"], order, 3, share=share).count() == 0


def test_pairs_with_nulls_repeats_and_clashing_names(spark):
    rows = [("s", f"b{b}", i) for b in range(8) for i in ("x", "y")] + [("s", f"c{b}", "z") for b in range(8)]
    rows = rows * 2 + [(None, "b0", "x"), ("s", None, "x"), ("s", "b0", None), ("s", "", ""), ("t", "b", "x")]
    df = spark.createDataFrame(rows, "scope string, _k string, cnt string").withColumns({c: F.lit(None).cast("int") for c in ("_s", "_i", "item_lo", "code", "_size")})
    got = cooccur.pair_counts(df, "scope", "_k", "cnt", 6, 1.0).collect()
    assert [(r["scope"], r["item_lo"], r["item_hi"], r["n_both"], r["n_baskets"]) for r in got] == [("s", "x", "y", 8, 17)]


def test_percentiles_with_null_keys_ties_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a", [5] * 70), (None, "a", [5] * 30), ("k", None, [1, 2, 3]), ("k", "e", [])], "weight string, _part string, vals array<long>").withColumn("err", F.lit("x"))
    named = df.withColumnsRenamed({"weight": "lib", "_part": "ctg"}).withColumns({"weight": F.lit(1), "_part": F.lit(2)})
    summary = percentile.summarise(named, ["lib", "ctg"], "vals", k=16, buffers=3)
    got = {(r["lib"], r["ctg"]): (r["n_values"], r["p50"]) for r in percentile.quantiles(summary, ["lib", "ctg"], [50]).filter("n_values > 0").collect()}
    assert got == {(None, "a"): (100, 5), ("k", None): (3, 2)}
    assert percentile.quantiles(percentile.summarise(named.limit(0), ["lib", "ctg"], "vals"), ["lib", "ctg"], [50]).filter("n_values > 0").count() == 0


def test_components_with_clashing_names_and_empty_names(spark):
    df = spark.createDataFrame([("", "x"), ("x", ""), (None, "q"), ("q", "q"), ("a", "b"), ("a", "b")], "b string, a string").withColumns({"rep": F.lit(1), "seqname": F.lit(2)})
    got = {tuple(r) for r in components.connected_components(df, F.col("b"), F.col("a")).collect()}
    assert got == {("", ""), ("x", ""), ("a", "a"), ("b", "a")}
    assert components.connected_components(df.limit(0), F.col("a"), F.col("b")).count() == 0


def test_containers_with_null_keys_long_texts_and_clashing_names(spark):
    rows = [(None, "one two"), (None, "one two"), (7, None), (8, ""), (9, "word " * 60_000)]
    df = spark.createDataFrame(rows, "k long, container string").withColumns({"piece": F.lit("p"), "_n": F.lit(1), "_shard": F.lit(2)})
    got = packing.pack_containers(df, "k", "container", capacity=512).toPandas()
    assert got["k"].isna().sum() == 2 and set(got["k"].dropna()) == {7, 8, 9}
    assert got.groupby("container")["n_tokens"].sum().max() <= 512
    long = got[got["k"] == 9].sort_values("piece")
    ends = (long["first_token"] + long["n_tokens"]).tolist()
    assert long["first_token"].tolist() == [0, *ends[:-1]] and ends[-1] >= 60_000
    assert packing.pack_containers(df.limit(0), "k", "container", capacity=512).count() == 0


def test_leaks_in_long_and_repeated_texts_with_clashing_names(spark):
    item = " ".join(f"held{i}out" for i in range(15))
    docs = [(1, "filler text " * 20_000 + item), (2, item), (2, item), (3, None), (4, ""), (None, item), (5, " ".join(f"held{i}out" for i in range(12)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "passage": F.lit(0), "words": F.lit(1)})
    items = spark.createDataFrame([(10, item), (11, None), (12, "")], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = leaks.find_leaks(df, "doc_id", "text", items, "item_id", "text").filter("passage").select("doc_id", "item_id").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, 10), (1, 10), (2, 10), (2, 10)]
    assert leaks.find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks.find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
