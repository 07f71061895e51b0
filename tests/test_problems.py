"""Bad lines, ranges and heavy keys on small hand-made tables."""

from pyspark.sql import functions as F

from linkloom.operators import heavy, intervals, ordered, rejects

GOOD = "q1\t100\t0\t50\t+\tt1\t200\t10\t60\t40\t50\t60"


def test_reasons_of_bad_lines(spark):
    f = GOOD.split("\t")
    put = lambda i, v: "\t".join([*f[:i], v, *f[i + 1 :]])
    lines = {
        GOOD: None, GOOD + "\r": None, GOOD + "\ttp:A:P\tcm:i:5\tcg:Z:a:b\tdv:f:.5": None, put(0, '"a\tb""c"'): None,
        put(0, 'a"b'): "quoting", "\t".join(f[:11]): "columns", put(1, "+100"): "number", put(1, "1" * 19): "number", put(4, "*"): "strand",
        put(2, "50"): "interval", put(3, "101"): "interval", put(11, "256"): "mapq", GOOD + "\ttp:A:PP": "tag", GOOD + "\tcm:i:1\tcm:i:2": "tag",
        GOOD + "\t": "tag", "": "columns",
    }
    # A clashing name, a repeated row and a null line.
    rows = [(i, x, "x") for i, x in enumerate([*lines, None, GOOD])]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, rec string")
    got = {r[0]: r[1] for r in rejects.parse_lines(df, F.col("raw_line"), ["line_id"]).select("line_id", "bad_reason").collect()}
    assert [got[i] for i in range(len(rows))] == [*lines.values(), "columns", None]


def test_no_lines(spark):
    df = spark.createDataFrame([], "line_id long, raw_line string")
    assert rejects.parse_lines(df, F.col("raw_line"), ["line_id"]).count() == 0


def brute_spans(rows):
    out, by = set(), {}
    for q, s, e in rows:
        if q is not None and s is not None and e is not None and s < e:
            by.setdefault(q, []).append((s, e))
    for q, spans in by.items():
        done = []
        for s, e in sorted(spans):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
            else:
                done.append([s, e])
        out |= {(q, "period", s, e) for s, e in done} | {(q, "gap", x[1], y[0]) for x, y in zip(done, done[1:])}
    return out


def test_periods_and_gaps(spark):
    rows = [(f"q{i % 3}", (i * 7919) % 5000, (i * 7919) % 5000 + i % 40) for i in range(400)]
    rows += [("q0", None, 5), (None, 1, 2), ("q1", 9, 3), ("q4", 1, 2), ("q4", 2, 3), ("q4", 2, 3), ("q5", -9, -3)]
    df = spark.createDataFrame(rows, "q string, s long, e long").withColumn("kind", F.lit("clash"))
    for tile in (64, 1 << 30):
        got = intervals.merge_intervals(df, F.col("q"), F.col("s"), F.col("e"), tile=tile).collect()
        assert len(got) == len(brute_spans(rows)) and {tuple(r) for r in got} == brute_spans(rows)
    assert intervals.merge_intervals(df.limit(0), F.col("q"), F.col("s"), F.col("e")).count() == 0


def test_heavy_keys_and_sums(spark):
    rows = [("hot", i) for i in range(900)] + [(None, 7)] * 300 + [(f"k{i}", None if i % 9 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long")
    hot = heavy.known(heavy.heavy_keys(df, ["k"]))
    assert "hot" in [r[0] for r in hot.collect()]
    got = heavy.skew_aggregate(df, ["k"], [F.count("*").alias("n"), F.sum("v").alias("v")], [F.sum("n").alias("n"), F.sum("v").alias("v")], hot)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.groupBy("k").agg(F.count("*"), F.sum("v")).collect()}
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4)], "k string, w long")
    joined = heavy.skew_join(df, side, ["k"], hot).select("k", "v", "w").collect()
    assert sorted(map(str, joined)) == sorted(map(str, df.join(side, "k").select("k", "v", "w").collect()))


def test_keys_with_salts_of_their_own(spark, monkeypatch):
    rows = [("hot", i, i % 5) for i in range(600)] + [(None, 1, 2)] * 200 + [(f"k{i}", i, None) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v long, _salt int")
    hot = heavy.known(heavy.heavy_keys(df, ["k"]))
    got = heavy.skew_aggregate(df, ["k"], [F.sum("_salt").alias("s")], [F.sum("s").alias("s")], hot)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.groupBy("k").agg(F.sum("_salt")).collect()}
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4)], "k string, w long")
    for few in (heavy.BROADCAST_ROWS, 0):  # 0: heavy rows are repeated for each salt
        monkeypatch.setattr(heavy, "BROADCAST_ROWS", few)
        joined = heavy.skew_join(df, side, ["k"], hot)
        assert joined.columns == ["k", "v", "_salt", "w"]
        assert sorted(map(str, joined.collect())) == sorted(map(str, df.join(side, "k").select(joined.columns).collect()))
    assert not heavy.skew_aggregate(df.limit(0), ["k"], [F.sum("v").alias("s")], [F.sum("s").alias("s")], hot).count()


def test_long_lines_repeat_and_names_clash(spark):
    long = GOOD + "\tzz:Z:" + "x" * 3_000_000
    df = spark.createDataFrame([(1, long), (1, long), (2, ""), (3, "a\t" * 500_000)], "bad_reason long, rec string").withColumn("line", F.lit(0))
    got = rejects.parse_lines(df.withColumnRenamed("bad_reason", "line_id"), F.col("rec"), ["line_id"]).select("line_id", "bad_reason").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, None), (1, None), (2, "columns"), (3, "number")]))


def test_medians_of_groups(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 1.0), ("a", 9.0), ("b", 5.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("median", F.lit("clash"))
    assert {tuple(r) for r in ordered.group_medians(df, ["g"], "v").collect()} == {("a", 2.0), ("b", 5.0)}
    assert not ordered.group_medians(df.limit(0), ["g"], "v").count()
