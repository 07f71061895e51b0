"""Scalar functions, ordered sums, clustering and matching against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom import config as C
from linkloom.compare import normal, sql_rows
from linkloom.functions import exprs as E
from linkloom.operators import model, ordered, prune

import __spark_entry__ as entry


def test_site_counts(spark):
    df = spark.createDataFrame([("GATCGATCxGATC",), ("GAATCGATC",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(E.count_sites(F.col("s")), E.count_sites(F.col("s"), "GANTC,GATC")).collect()]
    assert got == [(3, 3), (1, 2), (0, 0), (None, None)]


def test_distance_bins(spark):
    starts = C.bin_starts()
    values = sorted({v + k for v in starts[:256] for k in (0, 1)} | {0, 1, 2047, 1 << 26})
    df = spark.createDataFrame([(v,) for v in values], "d long")
    for v, bin_, edge in df.select("d", E.link_bin(F.col("d")), model.edge_index(F.col("d"), starts)).collect():
        assert bin_ == (-1 if v < 2048 else math.floor(16 * math.log2(v / 2048)))
        assert edge == sum(s <= v for s in starts)


def test_reverse_complement(spark):
    df = spark.createDataFrame([("ACGTNacgtn",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(E.reverse_complement(F.col("s"))).collect()] == ["nacgtNACGT", "", None]


def test_running_sums_over_blocks(spark):
    rows = [(g, i, (i * 37) % 11 if i % 5 else None) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, p long, v long").withColumn("_off", F.lit(1))
    got = ordered.prefix_sum(df, ["g"], "p", F.col("v"), "before", block=8).collect()
    for r in got:
        assert r["before"] == sum(v or 0 for g, i, v in rows if g == r["g"] and i < r["p"])


@pytest.mark.parametrize("n", [1, 2, 7, 10])
def test_exact_median(spark, n):
    v = [float((i * 7919) % 101) for i in range(n)]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "x double")
    assert ordered.median(df, "x") == float(np.median(v))
    assert ordered.median(df.filter("x is null"), "x") is None


def test_assignment_is_maximal():
    rng = np.random.default_rng(0)
    for n in range(1, 6):
        w = rng.integers(0, 20, (n, n)).astype(float)
        best = max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        to = prune.assign(w)
        assert sorted(to) == list(range(n)) and w[range(n), to].sum() == best


@pytest.mark.parametrize("name", ["q_link_summary", "q_link_bins", "q_l50", "q_agp", "q_edge_weights", "q_tour_score", "q_posterior", "q_coverage"])
def test_queries_equal_their_sql(spark, data, name):
    got, want = normal(entry.queries()[name](spark, data).toPandas()), normal(sql_rows(entry.oracle_sql()[name], data))
    assert got.equals(want)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
