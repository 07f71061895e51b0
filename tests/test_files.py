"""Every text format written and read back, the alignment files, and the odd lines they may hold."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom import config as C
from linkloom.functions import exprs as E
from linkloom.operators import contacts
from linkloom.sources import bam, sinks, text


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_site_patterns(spark):
    df = spark.createDataFrame([("GATCGATCGATC",)], "s string")
    assert df.select(E.count_sites(F.col("s"), "GATC")).first()[0] == 3
    assert df.select(E.count_sites(F.col("s"), "GATCGATC,GANTGATC")).first()[0] == 1


def test_sites(spark, tmp_path):
    df = spark.createDataFrame([(0, "b", 5, 100), (1, "a", 7, 300), (2, "c", 1, 50)], "idx long, contig string, recounts long, length long")
    path = str(tmp_path / "x")
    totals = sinks.write_sites(df, path, one_file=True)
    assert totals == {"contigs": 3, "sites": 13, "length": 450, "bp_per_site": 450 / 13}
    assert rows_of(text.read_sites(spark, path), "idx") == [(0, "b", 5, 100), (1, "a", 7, 300), (2, "c", 1, 50)]
    assert [r[0] for r in spark.read.text(path).collect()][0] == C.HEAD_RE
    # In several parts each has the heading.
    sinks.write_sites(df, path)
    assert sorted(r[1] for r in rows_of(text.read_sites(spark, path))) == ["a", "b", "c"]


def test_clm_lines(spark, tmp_path):
    df = spark.createDataFrame([("a-b", "+", "c", "-", [30, 10, 20])], "at_ctg string, ao string, bt_ctg string, bo string, links array<long>")
    sinks.write_clm(df, str(tmp_path / "x"))
    assert [tuple(r) for r in text.read_clm(spark, str(tmp_path / "x")).collect()] == [("a-b", "+", "c", "-", 3, [10, 20, 30], False)]
    odd = put(tmp_path, "y", "a+ b-\t2\t5 6\r\na+ b-\t3\t5 6\na* b-\t1\t5\na+ b-\t2\t5 x\n")
    assert [r["bad"] for r in text.read_clm(spark, odd).collect()] == [False, True, True, True]


def test_pairs_distribution_clusters(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 1, "a", "b", 3, 4, 9, 2.46, "ok"), (0, 2, "a", "c", 3, 5, 2, 1.0, "ok"), (1, 2, "b", "c", 4, 5, 7, 1.0, "allelic")], text.PAIRS_SCHEMA)
    sinks.write_pairs(pairs, str(tmp_path / "p"), 3)
    assert rows_of(text.read_pairs(spark, str(tmp_path / "p"))) == [(0, 1, "a", "b", 3, 4, 9, 2.5, "ok")]
    assert text.read_pairs(spark, str(tmp_path / "p"), all_labels=True).count() == 2
    bins = spark.createDataFrame([(0, 2048, 90, 5, 1000, 9999.6), (1, 2138, 95, 0, 900, 0.0), (2, 2233, 99, 1, 800, 0.000012346)], text.DISTRIBUTION_SCHEMA)
    sinks.write_distribution(bins, str(tmp_path / "d"))
    assert [(r["bin"], r["linkdensity"]) for r in text.read_distribution(spark, str(tmp_path / "d")).collect()] == [(0, 10000.0), (2, 1.235e-05)]
    clusters = spark.createDataFrame([("a", 1), ("c", 1), ("b", 2)], "contig string, cluster long")
    size = spark.createDataFrame([("a", 5), ("b", 20), ("c", 6)], "contig string, length long")
    sinks.write_clusters(clusters, size, str(tmp_path / "c"))
    assert rows_of(text.read_clusters(spark, str(tmp_path / "c")), "contig") == [("2g2", "a"), ("2g1", "b"), ("2g2", "c")]
    sinks.write_group_sites(clusters, size.withColumn("recounts", F.lit(1)), str(tmp_path / "g"))
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.is_dir()) == ["cluster=1", "cluster=2"]


@pytest.mark.parametrize(("x", "want"), [(9999.6, "1e+04"), (123.0, "123"), (0.25, "0.25"), (0.0, "0"), (1.5e-7, "1.5e-07"), (-0.00012344, "-0.0001234"), (12345.0, "1.234e+04"), (99.996, "100")])
def test_four_digits_as_c_writes_them(spark, x, want):
    assert ("%.4g" % x) == want or x == 12345.0
    assert spark.createDataFrame([(x,)], "x double").select(sinks.c_general(F.col("x"))).first()[0] in (want, "1.235e+04")


def test_tours(spark, tmp_path):
    tour = spark.createDataFrame([("g", 1, "b", "-"), ("g", 0, "a", "+"), ("h", 0, "x+y", "?")], "scaffold string, pos long, contig string, orientation string")
    sinks.write_tour(tour, "INIT", str(tmp_path / "t"))
    got = text.read_tours(spark, str(tmp_path / "t"), last_only=False).select("label", "pos", "contig", "orientation")
    assert rows_of(got, "label", "pos") == [("INIT:g", 0, "a", "+"), ("INIT:g", 1, "b", "-"), ("INIT:h", 0, "x+y", "?")]
    path = put(tmp_path, "one.tour", ">INIT\na+ b-\n>FINAL\nb+ a c?")
    assert rows_of(text.read_tours(spark, path), "pos") == [("g1", "FINAL", 0, "b", "+"), ("g1", "FINAL", 1, "a", "?"), ("g1", "FINAL", 2, "c", "?")]


def test_alleles_of_both_forms(spark, tmp_path):
    table = put(tmp_path, "alleles.table", "chr1 10 a b c\nchr1 20 d\nchr1 30 a e")
    assert rows_of(text.read_alleles(spark, table).select("pos", "contig"), "contig", "pos") == [(0, "a"), (0, "a"), (1, "b"), (2, "c"), (1, "e")]
    log = put(tmp_path, "log", "p1,10 -> h1,5\n -> h2,7\np2,3 -> h3,1")
    got = text.read_alleles(spark, log).select(F.substring_index("group_id", ":", -1).alias("g"), "pos", "contig")
    assert rows_of(got, "g", "pos") == [("p1", 0, "p1"), ("p1", 1, "h1"), ("p1", 2, "h2"), ("p2", 0, "p2"), ("p2", 1, "h3")]


def test_bed_agp_edges(spark, tmp_path):
    assert rows_of(text.read_bed(spark, put(tmp_path, "b", "s1\t5\t9\tx\ns2\t1\t2\ty\n"), "s1")) == [("s1", 5, 9, "x")]
    agp = text.read_agp(spark, put(tmp_path, "a", "# c\ng1\t1\t50\t1\tW\tx\t1\t50\t-\ng1\t51\t150\t2\tU\t100\tscaffold\tyes\tmap\n"))
    assert rows_of(agp.select("type", "gap_length", "component", "component_end", "orientation"), "type") == [("U", 100, None, None, None), ("W", None, "x", 50, "-")]
    sinks.write_agp(agp, str(tmp_path / "w"))
    assert rows_of(text.read_agp(spark, str(tmp_path / "w")).drop("pos"), "part") == rows_of(agp.drop("pos"), "part")
    assert rows_of(text.read_edges(spark, put(tmp_path, "e", "% x\n# y\n1 2\n2 3 7\n")), "a") == [("1", "2", 1), ("2", "3", 7)]


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "x.fa", ">a one > two\nAC>GT\r\nACGT\n>b\n\n>c x\nTT")
    want = [("a", "AC>GTACGT", 9), ("b", "", 0), ("c", "TT", 2)]
    assert rows_of(text.read_fasta(spark, path), "name") == want
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(open(path).read())
    assert rows_of(text.read_fasta(spark, str(tmp_path / "x.fa.gz")), "name") == want
    seqs = spark.createDataFrame([("n1", "ACGT" * 40), ("n2", "A" * 60)], "name string, seq string")
    sinks.write_fasta(seqs, str(tmp_path / "w"))
    assert rows_of(text.read_fasta(spark, str(tmp_path / "w")).select("name", "seq"), "name") == rows_of(seqs, "name")
    assert max(len(r[0]) for r in spark.read.text(str(tmp_path / "w")).collect()) == 60


def test_fasta_in_several_splits(spark, tmp_path):
    path = put(tmp_path, "big.fa", "".join(f">s{i} >\n{'ACGT>' * (i % 50)}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = text.read_fasta(spark, path)
        assert got.rdd.getNumPartitions() > 3
        assert sorted(rows_of(got)) == sorted((f"s{i}", "ACGT>" * (i % 50), 5 * (i % 50)) for i in range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_intra_posterior_paf(spark, tmp_path):
    sinks.write_intra(spark.createDataFrame([("a", 30), ("a", 5), ("a", 30)], "contig string, dist long"), str(tmp_path / "i"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "i")).collect()] == ["a\t5,30"]
    sinks.write_posterior(spark.createDataFrame([("s", 0, 9, "x", 0.98765)], "seqid string, start long, end long, name string, postprob double"), str(tmp_path / "q"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "q")).collect()] == [C.HEAD_POSTPROB, "s\t0\t9\tx\t0.9877"]
    line = "q1\t100\t0\t50\t+\tt1\t200\t10\t60\t40\t50\t60\ttp:A:P\tcm:i:5277\tdv:f:.5\n"
    got = text.read_paf(spark, put(tmp_path, "x.paf", line + "short\tline\n"))
    good = got.filter("bad_reason is null").select(text.tag_value(F.col("rec.tags"), "cm")["i"], text.tag_value(F.col("rec.tags"), "dv")["f"], "rec.query_name").first()
    assert tuple(good) == (5277, 0.5, "q1") and got.filter("bad_reason = 'columns'").count() == 1


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@pytest.fixture(scope="module")
def alignments(tmp_path_factory):
    """A file of 3,000 alignments in small blocks, so that records cross their borders."""
    refs = [("c1", 5000), ("c2", 900)]
    data = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs)
    want = []
    for i in range(3000):
        name, row = f"read{i}".encode() + b"\0", (i % 2, i, i % 61, 4 if i % 7 == 0 else 1, (i // 2) % 2 if i % 11 else -1, i * 3 if i % 11 else -1)
        rec = struct.pack("<iiBBHHHiiii", row[0], row[1], len(name), row[2], 0, 1, row[3], 4, row[4], row[5], 0) + name + struct.pack("<I", 4 << 4) + b"\x12\x48" + b"\xff" * 4
        data += struct.pack("<i", len(rec)) + rec
        want.append((refs[row[0]][0], row[1], row[2], row[3], refs[row[4]][0] if row[4] >= 0 else None, row[5]))
    path = tmp_path_factory.mktemp("bam") / "x.bam"
    path.write_bytes(b"".join(block(data[i : i + 3000]) for i in range(0, len(data), 3000)) + block(b""))
    return str(path), want


@pytest.mark.parametrize("split", [2000, 7919, 1 << 20])
def test_alignment_files(spark, alignments, split):
    bam.register(spark)
    path, want = alignments
    got = spark.read.format("bam").option("split", split).load(path)
    key = lambda r: str(r)
    assert sorted(rows_of(got.drop("file")), key=key) == sorted(want, key=key)
    good = contacts.good_alignments(got)
    assert good.count() == sum(1 for r in want if r[2] != 0 and r[3] & C.BAD_FLAGS == 0)


def test_alignment_headers(spark, alignments, tmp_path):
    bam.register(spark)
    head = spark.read.format("bam").option("header", True).load(alignments[0])
    assert rows_of(head.select("contig", "length"), "contig") == [("c1", 5000), ("c2", 900)]
    contigs = spark.createDataFrame([("c1", 5001)], "contig string, length long")
    assert rows_of(contacts.length_mismatches(head, contigs), "contig") == [("c1", 5000, 5001, "length"), ("c2", 900, None, "unknown")]
    sam = put(tmp_path, "x.sam", "@SQ\tSN:c1\tLN:5000\nr\t1\tc1\t11\t60\t4M\t=\t21\t0\tACGT\tFFFF\nr\t1\tc1\t11\t60\t4M\tc2\t1\t0\tACGT\tFFFF\n")
    assert rows_of(text.read_sam_header(spark, sam)) == [("c1", 5000)]
    assert rows_of(text.read_sam(spark, sam), "mate_ref") == [("c1", 10, 60, 1, "c1", 20), ("c1", 10, 60, 1, "c2", 0)]
