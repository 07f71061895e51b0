"""Queries of the general problems: bad lines (4), ranges (6) and few heavy keys (7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heavy, intervals, rejects
from ..session import table

BLANK = " \t"


def trimmed(name: str) -> Column:
    return F.btrim(F.col(name), F.lit(BLANK))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = rejects.parse_lines(table(spark, d, "paf_raw"), F.col("raw_line"), ["line_id"])
    return lines.filter("bad_reason is not null").select("line_id", F.col("bad_reason").alias("reason"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines, typed; tags in the order of the line as text."""
    rec = rejects.parse_lines(table(spark, d, "paf_raw"), F.col("raw_line"), ["line_id"]).filter("bad_reason is null")
    return rec.select(
        "line_id", *[F.col(f"rec.{n}").alias(n) for n, _ in rejects.COLUMNS], F.size("rec.tags").cast("long").alias("n_tags"), F.col("rec.tags")["cm"]["val"].alias("cm")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals.merge_intervals(table(spark, d, "paf"), trimmed("query_name"), F.col("query_start"), F.col("query_end"))
    return spans.withColumnRenamed("_name", "query_name")


def clm_keys(spark: SparkSession, d: str) -> DataFrame:
    """One row a clm_id: libname, at_ctg, and its number, sum and least of usable distances."""
    usable = F.filter("links", lambda x: x > 0)
    # All that remains is equal among copies of a clm_id, so equal rows are dropped, on few bytes.
    return (
        table(spark, d, "clm").filter("at_ctg is not null").withColumn("_u", usable)
        .select("clm_id", "libname", "at_ctg", F.when(F.col("_u").isNull(), 0).otherwise(F.size("_u")).cast("long").alias("n_usable"),
                F.coalesce(F.aggregate("_u", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("sum_usable"), F.array_max("_u").alias("max_usable"))
        .distinct()
    )


KEYS = ["libname", "at_ctg"]


def _partial() -> list[Column]:
    return [F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in ("n_usable", "sum_usable")], F.max("max_usable").alias("max_usable")]


def _final() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("n_rows", "n_usable", "sum_usable")], F.max("max_usable").alias("max_usable")]


def _heavy_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Heavy keys of the raw rows, copies included: they only choose the route of rows."""
    raw = table(spark, d, "clm").filter("at_ctg is not null")
    return heavy.known(heavy.heavy_keys(raw, KEYS, F.size("links")))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per library and at_ctg: rows, usable distances, their sum and the longest one."""
    # Kept: heavy and other keys are read apart.
    return heavy.skew_aggregate(clm_keys(spark, d).persist(), KEYS, _partial(), _final(), _heavy_contigs(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    # One row a key, read twice.
    totals = p7_totals(spark, d).select(*KEYS, "n_usable").persist()
    libs = totals.groupBy("libname").agg(F.sum("n_usable").alias("_all"))
    return totals.join(libs, "libname").filter("n_usable > 0 and n_usable * 40 >= _all").select(*KEYS)


def p7_density(spark: SparkSession, d: str) -> DataFrame:
    """Usable distances of each contig for every kb of its length, over all libraries, by a join that few contigs dominate."""
    hot = heavy.known(heavy.heavy_keys(table(spark, d, "clm").filter("at_ctg is not null"), ["at_ctg"], F.size("links")))
    lengths = (
        table(spark, d, "contigs").select("contig", "length").unionByName(table(spark, d, "shared_contigs").select("contig", "length"))
        .filter("contig is not null and length > 0").groupBy(F.col("contig").alias("at_ctg")).agg(F.max("length").alias("ctg_length"))
    )
    joined = heavy.skew_join(clm_keys(spark, d).persist(), lengths, ["at_ctg"], hot)
    done = heavy.skew_aggregate(joined, ["at_ctg"], [*_partial(), F.max("ctg_length").alias("ctg_length")], [*_final(), F.max("ctg_length").alias("ctg_length")], hot)
    return done.select("at_ctg", "n_rows", "n_usable", "ctg_length", F.round(F.col("n_usable") * 1000.0 / F.col("ctg_length"), 6).alias("per_kb"))


QUERIES = {f.__name__: f for f in (p4_found, p4_loaded, p6_found, p7_found, p7_totals, p7_density)}

_FIELD = r'"[^"]*(?:""[^"]*)*"|[^"\t]*'
_P4 = rf"""
with l as (select line_id, coalesce(case when raw_line like '%' || chr(13) then left(raw_line, length(raw_line) - 1) else raw_line end, '') as line from paf_raw),
q as (select *, regexp_full_match(chr(9) || line, '(?s)(?:\t(?:{_FIELD}))*') as quoted_ok,
  list_transform(regexp_extract_all(chr(9) || line, '\t({_FIELD})', 1), lambda f: case when f like '"%' then replace(f[2:-2], '""', '"') else f end) as f from l),
n as (select *, len(f) as k, list_transform([2,3,4,7,8,9,10,11,12], lambda i: regexp_full_match(f[i], '[0-9]{{1,18}}')) as digits, f[13:] as tags from q),
v as (select *, coalesce(list_bool_and(digits), false) as numbers_ok from n),
t as (select *, [try_cast(f[i] as bigint) for i in [1,2,3,4,5,6,7,8,9,10,11,12]] as x from v),
r as (select *, case when not quoted_ok then 'quoting' when k < 12 then 'columns' when not numbers_ok then 'number'
  when f[5] not in ('+', '-') then 'strand'
  when not (x[3] < x[4] and x[4] <= x[2] and x[8] < x[9] and x[9] <= x[7]) then 'interval'
  when x[12] > 255 then 'mapq'
  when len(list_filter(tags, lambda g: not regexp_full_match(g, '(?s)[A-Za-z][A-Za-z0-9]:(?:A:[ -~]|i:[+-]?[0-9]{{1,18}}|f:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|Z:.*)'))) > 0
    or len(list_distinct(list_transform(tags, lambda g: g[1:2]))) < len(tags) then 'tag' end as reason from t)
"""
_USABLE = """
with u as (select clm_id, any_value(libname) as libname, any_value(at_ctg) as at_ctg, any_value(list_filter(links, lambda x: x > 0)) as u from clm where at_ctg is not null group by clm_id),
k as (select libname, at_ctg, count(*) as n_rows, cast(sum(coalesce(len(u), 0)) as bigint) as n_usable, cast(sum(coalesce(list_sum(u), 0)) as bigint) as sum_usable, max(list_max(u)) as max_usable from u group by all)
"""
ORACLE = {
    "p4_found": _P4 + "select line_id, reason from r where reason is not null",
    "p4_loaded": _P4
    + "select line_id, f[1] as query_name, x[2] as query_length, x[3] as query_start, x[4] as query_end, f[5] as strand, f[6] as target_name, x[7] as target_length, x[8] as target_start, x[9] as target_end, x[10] as num_matches, x[11] as alignment_length, cast(x[12] as smallint) as mapping_quality, cast(len(tags) as bigint) as n_tags, list_filter(tags, lambda g: g[1:2] = 'cm')[1][6:] as cm from r where reason is null",
    "p6_found": """
with r as (select trim(query_name, ' ' || chr(9)) as query_name, query_start as s, query_end as e from paf where query_name is not null and query_start < query_end),
m as (select *, max(e) over (partition by query_name order by s, e rows between unbounded preceding and 1 preceding) as reach from r),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by query_name order by s, e rows unbounded preceding) as run from m),
p as (select query_name, run, min(s) as span_from, max(e) as span_to from g group by all),
x as (select *, lag(span_to) over (partition by query_name order by span_from) as prev from p)
select query_name, 'period' as kind, span_from, span_to from x
union all select query_name, 'gap', prev, span_from from x where prev is not null""",
    "p7_totals": _USABLE + "select * from k",
    "p7_found": _USABLE + ", l as (select libname, sum(n_usable) as total from k group by 1) select libname, at_ctg from k join l using (libname) where n_usable > 0 and n_usable * 40 >= total",
    "p7_density": _USABLE
    + ", c as (select contig as at_ctg, max(length) as ctg_length from (select contig, length from contigs union all select contig, length from shared_contigs) where contig is not null and length > 0 group by 1) select at_ctg, cast(sum(n_rows) as bigint) as n_rows, cast(sum(n_usable) as bigint) as n_usable, ctg_length, round(cast(sum(n_usable) as bigint) * cast(1000.0 as double) / ctg_length, 6) as per_kb from k join c using (at_ctg) group by at_ctg, ctg_length",
}
