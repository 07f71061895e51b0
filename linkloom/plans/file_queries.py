"""Queries that write a text format to the shared folder and read it back; the SQL has the rows that were written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import contacts, release
from ..session import checkpoint_dir
from ..sources import sinks, text
from . import contact_queries as Q
from . import contact_sql as S


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_file_sites(spark: SparkSession, d: str) -> DataFrame:
    """Restriction-site counts; idx is the place in the file."""
    sinks.write_sites(Q.lengths(spark, d).filter("recounts is not null"), path := _folder(spark, "sites"), one_file=True)
    return text.read_sites(spark, path)


def q_file_clm(spark: SparkSession, d: str) -> DataFrame:
    rows = contacts.clm(Q.links(spark, d)).withColumnsRenamed({"a": "at_ctg", "b": "bt_ctg"})
    sinks.write_clm(rows, path := _folder(spark, "clm"))
    return text.read_clm(spark, path).select("at_ctg", "ao", "bt_ctg", "bo", "n", F.array_join(F.transform("links", lambda x: x.cast("string")), " ").alias("dists"), "bad")


def q_file_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least three links that are labelled ok."""
    rows = Q.named_pairs(spark, d).filter("x is not null and y is not null and re1 is not null and re2 is not null and expectedlinksifadjacent is not null")
    sinks.write_pairs(rows, path := _folder(spark, "pairs"), 3)
    return text.read_pairs(spark, path).select("x", "y", "contig1", "contig2", "re1", "re2", "observedlinks", "label")


def q_file_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Bins with links; densities keep four digits."""
    sinks.write_distribution(Q._densities(spark, d).fillna(0.0, ["linkdensity"]), path := _folder(spark, "bins"))
    rows = text.read_distribution(spark, path)
    return rows.select("bin", "binstart", "binsize", "numlinks", "totalsize", F.round(F.log10("linkdensity"), 6).alias("log_density"))


def q_file_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Allele groups as clusters, named by how many there are and their rank by length."""
    own = Q.known(spark, d).groupBy("contig").agg(F.max("length").alias("length"))
    fixed = Q._fixed_clusters(spark, d).join(own, "contig").select("contig", "cluster")
    sinks.write_clusters(fixed, own, path := _folder(spark, "clusters"))
    return text.read_clusters(spark, path)


def q_file_tour(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.tour(spark, d).withColumnRenamed("grp", "scaffold")
    sinks.write_tour(rows, "FINAL", path := _folder(spark, "tour"))
    # Groups are written in order of their names, a part each or several to a part.
    return text.read_tours(spark, path, last_only=False).select("label", "pos", "contig", "orientation")


def q_file_agp(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_agp(release.agp(Q.tour(spark, d)), path := _folder(spark, "agp"))
    return text.read_agp(spark, path).select("object", "object_beg", "object_end", "part", "type", "gap_length", "component", "component_end", "orientation")


def q_file_fasta(spark: SparkSession, d: str) -> DataFrame:
    rows = Q.sequences(spark, d).filter("seq <> ''").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" source>other")).alias("name"), "seq")
    sinks.write_fasta(rows, path := _folder(spark, "fasta"))
    return text.read_fasta(spark, path).select("name", F.md5("seq").alias("digest"), "length")


def q_file_intra(spark: SparkSession, d: str) -> DataFrame:
    """Distinct distances within contigs, as text."""
    sinks.write_intra(contacts.intra_links(Q.links(spark, d)), path := _folder(spark, "intra"))
    rows = spark.read.csv(path, sep="\t", schema="contig string, dists string")
    return rows.select("contig", "dists")


def q_file_posterior(spark: SparkSession, d: str) -> DataFrame:
    rows = Q._posteriors(spark, d)
    sinks.write_posterior(rows, path := _folder(spark, "posterior"))
    return text.read_table(spark, path, "seqid string, start long, end long, name string, postprob double").select("seqid", "start", F.col("end").alias("fin"), "name", F.round("postprob", 4).alias("postprob"))


def q_file_edges(spark: SparkSession, d: str) -> DataFrame:
    """The contact graph as an edge list with a comment."""
    g = Q._graph(spark, d)
    sinks.write_edges(g, path := _folder(spark, "edges"))
    return text.read_edges(spark, path)


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLE = {
    "q_file_sites": f"with {S._LEN} select row_number() over (order by idx) - 1 as idx, contig, recounts, length from ln where recounts is not null",
    "q_file_clm": f"with {S._LINKS}{S._ORI} select a as at_ctg, ao, b as bt_ctg, bo, count(*) as n, string_agg(cast(dist as varchar), ' ' order by dist) as dists, false as bad from ol group by all having count(*) >= 3",
    "q_file_pairs": f"with {S._NAMED} select x, y, contig1, contig2, re1, re2, observedlinks, label from np where x is not null and y is not null and re1 is not null and re2 is not null and expectedlinksifadjacent is not null and observedlinks >= 3 and label = 'ok'",
    "q_file_distribution": f"with {S._DENS} select bin, binstart, binsize, numlinks, totalsize, round(log10(round(linkdensity * pow(10, 3 - floor(log10(linkdensity)))) * pow(10, floor(log10(linkdensity)) - 3)), 6) as log_density from de where numlinks <> 0",
    "q_file_clusters": f"with {S._LEN}{S._FIX}, t as (select cluster, cast(sum(length) as bigint) as total from cl join lm using (contig) group by 1), r as (select cluster, row_number() over (order by total desc, cluster) as k, count(*) over () as n from t) select n || 'g' || k as \"group\", contig from r join cl using (cluster) join lm using (contig)",
    "q_file_tour": f"with {S._LEN}{S._TOUR} select 'FINAL:' || grp as label, pos, contig, case when sign < 0 then '-' else '+' end as orientation from pl",
    "q_file_agp": S.ORACLE["q_agp"],
    "q_file_fasta": f"with {S._SEQ} select 'd' || doc_id as name, md5(seq) as digest, length(seq) as length from sq where seq <> ''",
    "q_file_intra": f"with {S._LINKS}, n as (select distinct a as contig, abs(apos - bpos) as dist from lk where ai = bi and abs(apos - bpos) >= 2048) select contig, string_agg(cast(dist as varchar), ',' order by dist) as dists from n group by 1",
    "q_file_posterior": S.ORACLE["q_posterior"].replace("select seqid, name, n_links, round(f, 6) as log_fwd, round(r, 6) as log_rev, round(case", "select g.seqid, bd.start, bd.fin, g.name, round(case").replace(", 6) as postprob from g", ", 4) as postprob from g join bd using (seqid, name)"),
    "q_file_edges": f"with {S._TOTAL} select a, b, n as weight from pt",
}
