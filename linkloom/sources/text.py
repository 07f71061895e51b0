"""Readers of the text formats as DataFrames with fixed schemas; nothing is inferred.

Order within a file, where it carries meaning, becomes a column: Spark doesn't promise file order.
Files are read by many tasks; only formats whose lines depend on earlier lines use a window, and
that within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..operators import rejects

RE_SCHEMA = "contig STRING, recounts LONG, length LONG"
PAIRS_SCHEMA = "x LONG, y LONG, contig1 STRING, contig2 STRING, re1 LONG, re2 LONG, observedlinks LONG, expectedlinksifadjacent DOUBLE, label STRING"
DISTRIBUTION_SCHEMA = "bin INT, binstart LONG, binsize LONG, numlinks LONG, totalsize LONG, linkdensity DOUBLE"
BED_SCHEMA = "seqid STRING, start LONG, end LONG, name STRING"
CLUSTERS_SCHEMA = "group STRING, ncontigs LONG, contigs STRING"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and the place in it; a last line without a line end counts."""
    return spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("value"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table whose first line is a heading; a field that doesn't parse becomes null."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Restriction-site counts: idx in file order, contig, recounts, length. Lines that begin with # are left out."""
    words = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).filter("value <> '' and not startswith(value, '#')").withColumn("w", words)
    rows = rows.select("file", "pos", F.col("w")[0].alias("contig"), F.col("w")[1].try_cast("long").alias("recounts"), F.element_at("w", -1).try_cast("long").alias("length"))
    return rows.select((F.row_number().over(W.partitionBy("file").orderBy("pos")) - 1).cast("long").alias("idx"), "contig", "recounts", "length")


def read_clm(spark: SparkSession, path: str) -> DataFrame:
    """at_ctg, ao, bt_ctg, bo, n, links, bad: `at± bt±<tab>n<tab>d d ...`; bad tells lines that are malformed or whose n disagrees."""
    f = F.split("value", "\t")
    ends = F.split(f[0], " ")
    links = F.filter(F.transform(F.split(f[2], " "), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    cut = lambda e: (F.expr(f"substring({e}, 1, length({e}) - 1)"), F.expr(f"right({e}, 1)"))
    rows = _lines(spark, path).filter("value <> ''").select(ends[0].alias("_a"), ends[1].alias("_b"), f[1].try_cast("long").alias("n"), links.alias("links"))
    a, ao = cut("_a")
    b, bo = cut("_b")
    bad = F.coalesce((F.size("links") != F.col("n")) | ~ao.isin("+", "-", "?") | ~bo.isin("+", "-", "?"), F.lit(True))
    return rows.select(a.alias("at_ctg"), ao.alias("ao"), b.alias("bt_ctg"), bo.alias("bo"), "n", "links", bad.alias("bad"))


def read_pairs(spark: SparkSession, path: str, all_labels: bool = False) -> DataFrame:
    """Contig pairs; only those labelled ok unless all are wanted."""
    rows = read_table(spark, path, PAIRS_SCHEMA)
    return rows if all_labels else rows.filter("label = 'ok'")


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    """Distance bins with links."""
    return read_table(spark, path, DISTRIBUTION_SCHEMA).filter("numlinks <> 0")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """bad_reason and rec (typed columns and tags) of each alignment line."""
    return rejects.parse_lines(_lines(spark, path), F.col("value"), ["file", "pos"])


def tag_value(tags: Column, name: str) -> Column:
    """A tag as struct<i LONG, f FLOAT, s STRING>: i and f by its kind, s always; nulls if it is missing."""
    t = F.try_element_at(tags, F.lit(name))
    return F.struct(
        F.when(t["kind"] == "i", t["val"].try_cast("long")).alias("i"), F.when(t["kind"] == "f", t["val"].try_cast("float")).alias("f"), t["val"].alias("s")
    )


def read_bed(spark: SparkSession, path: str, seqid: str | None = None) -> DataFrame:
    """Ranges of one sequence, or of all."""
    rows = spark.read.csv(path, sep="\t", schema=BED_SCHEMA).filter("start is not null and end is not null")
    return rows.filter(F.col("seqid") == seqid) if seqid is not None else rows


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (first word of the heading), seq in one line, and length. Plain or gzip; gzip files aren't split.

    A record begins with `>` at the start of a line; `>` elsewhere is part of a heading or line.
    """
    # Only a file's first record still has its mark.
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", r"^\s*>?", "").alias("value")).filter("value <> ''")
    part = F.split("value", "\r?\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(part, F.lit(1)), F.lit("")), r"\s", "")
    return rows.select(F.split(part[0], r"\s+")[0].alias("name"), seq.alias("seq")).withColumn("length", F.length("seq").cast("long"))


def carry_forward(rows: DataFrame, value: Column, group: list[str], order: list[str], name: str) -> DataFrame:
    """The last value that isn't null, up to and with each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def read_alleles(spark: SparkSession, path: str) -> DataFrame:
    """group_id, pos, contig of an alleles table or an association log; a log has `->` in its first line."""
    lines = _lines(spark, path).filter("value <> ''")
    # The form is that of each file's own first line.
    head = lines.groupBy("file").agg(F.min_by("value", "pos").alias("_first"))
    lines = lines.join(F.broadcast(head), "file")
    log, flat = lines.filter("contains(_first, '->')"), lines.filter("not contains(_first, '->')")
    words = flat.withColumn("w", F.split(F.trim("value"), r"\s+")).filter(F.size("w") > 3)
    groups = words.select(F.concat_ws(":", "file", "pos").alias("group_id"), F.posexplode(F.slice("w", F.lit(3), F.size("w"))).alias("pos", "contig"))
    side = F.split("value", "->")
    name = lambda c: F.trim(F.split(c, ",")[0])
    log = carry_forward(log, F.when(name(side[0]) != "", name(side[0])), ["file"], ["pos"], "primary")
    links = log.select("file", "primary", F.col("pos").alias("at"), name(side[1]).alias("hap")).filter("hap <> '' and primary is not null")
    members = links.select(F.concat_ws(":", "file", "primary").alias("group_id"), F.col("hap").alias("contig"), "at").unionByName(
        links.groupBy(F.concat_ws(":", "file", "primary").alias("group_id"), F.col("primary").alias("contig")).agg(F.lit(-1).cast("long").alias("at"))
    )
    place = (F.row_number().over(W.partitionBy("group_id").orderBy("at")) - 1).cast("int")
    return groups.unionByName(members.select("group_id", place.alias("pos"), "contig"))


def tour_words(words: Column) -> Column:
    """array<struct<pos, contig, orientation>>; a missing orientation is ?"""
    kept = F.filter(F.split(F.trim(words), r"\s+"), lambda w: w != "")
    one = lambda w, i: F.struct(i.cast("long").alias("pos"), F.regexp_extract(w, r"^(.*?)([+?-]?)$", 1).alias("contig"), F.coalesce(F.nullif(F.regexp_extract(w, r"^(.*?)([+?-]?)$", 2), F.lit("")), F.lit("?")).alias("orientation"))
    return F.transform(kept, one)


def read_tours(spark: SparkSession, path: str, last_only: bool = True) -> DataFrame:
    """scaffold (g1, g2, ... by file name), label, pos, contig, orientation: each file's last tour, or all."""
    lines = _lines(spark, path).filter("value <> ''")
    lines = carry_forward(lines, F.when(F.startswith("value", F.lit(">")), F.expr("substring(value, 2)")), ["file"], ["pos"], "label").filter("not startswith(value, '>')")
    if last_only:
        lines = lines.groupBy("file").agg(F.max_by("value", "pos").alias("value"), F.max_by("label", "pos").alias("label"))
    names = lines.select("file").distinct()
    names = names.withColumn("scaffold", F.concat(F.lit("g"), F.row_number().over(W.orderBy("file"))))
    return lines.join(names, "file").select("scaffold", "label", F.inline(tour_words(F.col("value"))))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """group and contig of a cluster table."""
    return read_table(spark, path, CLUSTERS_SCHEMA).select("group", F.explode(F.split("contigs", " ")).alias("contig"))


def read_agp(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an AGP file; gap and component columns are null where they don't apply."""
    w = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).filter("value <> '' and not startswith(value, '#')").select("pos", w.alias("w")).filter("size(w) >= 9")
    gap = F.col("w")[4].isin("N", "U")
    at = lambda i, kind="string": F.col("w")[i].try_cast(kind)
    return rows.select(
        "pos", at(0).alias("object"), at(1, "long").alias("object_beg"), at(2, "long").alias("object_end"), at(3, "long").alias("part"), at(4).alias("type"),
        F.when(gap, at(5, "long")).alias("gap_length"), F.when(gap, at(6)).alias("gap_type"), F.when(gap, at(7)).alias("linkage"), F.when(gap, at(8)).alias("evidence"),
        F.when(~gap, at(5)).alias("component"), F.when(~gap, at(6, "long")).alias("component_beg"), F.when(~gap, at(7, "long")).alias("component_end"), F.when(~gap, at(8)).alias("orientation"),
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """a, b, weight of an edge list; lines that begin with % or # are left out, a missing weight is 1."""
    w = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).filter("trim(value) <> '' and not startswith(value, '%') and not startswith(value, '#')").select(w.alias("w")).filter("size(w) >= 2")
    return rows.select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b"), F.coalesce(F.get("w", F.lit(2)).try_cast("long"), F.lit(1)).cast("long").alias("weight"))


SAM_SCHEMA = "ref STRING, pos LONG, mapq INT, flag INT, mate_ref STRING, mate_pos LONG"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Paired alignments of SAM text: 0-based positions; a mate on = is on the same contig."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).filter("value <> '' and not startswith(value, '@')").select(f.alias("f")).filter("size(f) >= 11")
    at = lambda i: F.col("f")[i]
    return rows.select(
        at(2).alias("ref"), (at(3).try_cast("long") - 1).alias("pos"), at(4).try_cast("int").alias("mapq"), at(1).try_cast("int").alias("flag"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_ref"), (at(7).try_cast("long") - 1).alias("mate_pos"),
    )


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """contig and length from the @SQ lines."""
    rows = spark.read.text(path).filter("startswith(value, '@SQ')")
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:([^\t]+)", 1)
    return rows.select(tag("SN").alias("contig"), tag("LN").try_cast("long").alias("length"))
