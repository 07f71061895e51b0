"""Queries of the problems for training data: 1, 2, 3, 5, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heavy
from ..session import spread, table
from . import components, cooccur, leaks, packing, percentile, subjects, topn


def current_pairs(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The latest row of every pair_id."""
    rows = table(spark, d, "pairs").groupBy("pair_id").agg(F.max(F.struct("loaded_at", *cols)).alias("_r"))
    return rows.select("pair_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    rows = current_pairs(spark, d, "libname", "contig1", "contig2", "observedlinks", "expectedlinksifadjacent")
    return rows.filter("contig1 is not null and contig2 is not null and observedlinks > expectedlinksifadjacent")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of contig2 with their counts, lift and odds ratio."""
    pairs = cooccur.pair_counts(_baskets(spark, d), "libname", "contig1", "contig2", 6, 5.0)
    named = pairs.withColumnsRenamed({"scope": "libname", "item_lo": "contig_lo", "item_hi": "contig_hi"})
    return named.withColumn("lift", F.round("lift", 6)).withColumn("odds_ratio", F.round("odds_ratio", 4))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_counts(_baskets(spark, d), "libname", "contig1", "contig2", 6, 5.0).select(F.col("scope").alias("libname"), F.col("item_lo").alias("contig_lo"), F.col("item_hi").alias("contig_hi"))


KEYS = ["libname", "at_ctg"]


def _usable(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "clm").filter("at_ctg is not null").select("clm_id", *KEYS, *more, F.filter("links", lambda x: x > 0).alias("vals")).filter("size(vals) > 0")


def usable_distances(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """One row a clm_id with its usable distances; copies are equal in all that is kept."""
    return _usable(spark, d, *more).distinct()


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with their bounds, and the distance bin of each."""
    found = percentile.quantiles(percentile.summarise(usable_distances(spark, d), KEYS, "vals"), KEYS, [10, 50, 90])
    starts = [r[0] for r in table(spark, d, "distribution").select("binstart").orderBy("binstart").limit(257).collect()]
    bins = F.array(*[F.lit(s) for s in starts])
    for p in (10, 50, 90):
        found = found.withColumn(f"bin{p}", F.size(F.filter(bins, lambda s: s <= F.col(f"p{p}"))) - 1)  # noqa: B023
    return found


def p2_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The same from summaries of single run_days that are put together."""
    days = percentile.summarise(usable_distances(spark, d, "run_day"), [*KEYS, "run_day"], "vals")
    # Days are the parts that the tree puts together.
    parts = days.withColumn("_part", F.coalesce(F.datediff("run_day", F.lit("1970-01-01").cast("date")), F.lit(0)))
    first = parts.agg(F.min("_part")).first()[0] or 0
    return percentile.quantiles(percentile.combine(parts.withColumn("_part", F.col("_part") - first).drop("run_day"), KEYS), KEYS, [10, 50, 90])


#: Percentile and the bin at whose start a case begins.
CASES = {10: 96, 50: 128, 90: 192}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = percentile.quantiles(percentile.summarise(usable_distances(spark, d), KEYS, "vals"), KEYS, list(CASES)).filter("n_values >= 50").persist()
    start = {r[0]: r[1] for r in table(spark, d, "distribution").filter(F.col("bin").isin(list(CASES.values()))).select("bin", "binstart").limit(256).collect()}
    one = lambda p: F.struct(F.lit(p).alias("pct"), F.col(f"p{p}").alias("at"), F.col(f"p{p}_least").alias("least"), F.col(f"p{p}_most").alias("most"), F.lit(start.get(CASES[p])).cast("long").alias("start"))
    cases = found.select(*KEYS, "n_values", F.explode(F.array(*[one(p) for p in CASES])).alias("c")).select(*KEYS, "n_values", "c.*")
    sure = cases.filter("least >= start").select(*KEYS, "pct")
    # Where the start lies within the bounds, the values under it are counted.
    doubt = cases.filter("least < start and most >= start")
    asked = doubt.select(F.col("libname").alias("_l"), F.col("at_ctg").alias("_c"), "pct", "start", "n_values")
    if not doubt.limit(1).count():
        return sure
    # Few cases meet the rows before copies are dropped, so only their rows are shuffled again; a frequent contig isn't one task's.
    few = asked.limit(heavy.BROADCAST_ROWS + 1).count() <= heavy.BROADCAST_ROWS
    raw = _usable(spark, d)
    if few:
        asked = F.broadcast(asked)
        only = F.broadcast(asked.select("_l", "_c").distinct())
        raw = raw.join(only, raw.libname.eqNullSafe(only._l) & (raw.at_ctg == only._c), "left_semi")
    rows = raw.distinct()
    met = rows.join(asked, rows.libname.eqNullSafe(asked._l) & (rows.at_ctg == asked._c))
    under = met.groupBy(*KEYS, "pct", "n_values").agg(F.sum(F.size(F.filter("vals", lambda x: x < F.col("start")))).alias("_under"))
    return sure.unionByName(under.filter("_under * 100 < pct * n_values").select(*KEYS, "pct"))


def trimmed(name: str) -> Column:
    return F.btrim(F.col(name), F.lit(" \t"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(table(spark, d, "paf"), trimmed("query_name"), trimmed("target_name"))


def _order() -> list[Column]:
    return [F.desc("observedlinks"), F.asc("contig2"), F.asc("pair_id")]


def _top_pairs(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    rows = current_pairs(spark, d, "contig1", "contig2", "observedlinks").filter("contig1 is not null and contig2 is not null and observedlinks is not null")
    # Counted, and read for both kinds of groups.
    rows = rows.persist()
    # A group's first rows are among the first rows of its contigs, so these meet the groups.
    first = topn.top_n(rows, ["contig1"], _order(), n)
    groups = table(spark, d, "ctg_groups").dropna().distinct()
    met = first.join(groups, first.contig1 == groups.ctg).select("groupid", "contig1", "contig2", "observedlinks", "pair_id").persist()
    return topn.top_n(met, ["groupid"], _order(), n)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _top_pairs(spark, d).select("groupid", "pair_id")


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return _top_pairs(spark, d)


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_containers(spread(table(spark, d, "documents")), "doc_id", "text")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items with a shared region, edits allowed."""
    return leaks.find_leaks(spread(table(spark, d, "documents")), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).filter("passage").select("doc_id", "item_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of documents with the share of their sentences."""
    return subjects.subjects_of(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "subject_examples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shares(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents, sentences and characters of the corpus by subject; null stands for documents without one."""
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    met = docs.join(p10_shares(spark, d), "doc_id", "left")
    return met.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 3).alias("weighted"), F.sum("n").alias("characters"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_percentiles, p2_by_day, p3_found, p5_found, p5_rows, p8_packing, p9_found, p9_leaks, p10_found, p10_shares, p10_composition)}

_CUR = "with c as (select * from (select *, row_number() over (partition by pair_id order by loaded_at desc) as rn from pairs) where rn = 1)"
_P1 = (
    _CUR
    + """, b as (select distinct libname, contig1, contig2 from c where contig1 is not null and contig2 is not null and observedlinks > expectedlinksifadjacent),
n as (select libname, contig2, count(*) as n from b group by all), t as (select libname, count(distinct contig1) as n_baskets from b group by 1),
p as (select x.libname, x.contig2 as contig_lo, y.contig2 as contig_hi, count(*) as n_both from b x join b y on x.libname = y.libname and x.contig1 = y.contig1 and x.contig2 < y.contig2 group by all having count(*) >= 6),
r as (select p.*, l.n as n_lo, h.n as n_hi, n_baskets from p join n l on l.libname = p.libname and l.contig2 = contig_lo join n h on h.libname = p.libname and h.contig2 = contig_hi join t on t.libname = p.libname where n_both * n_baskets >= 5 * l.n * h.n)
"""
)
_USABLE = "with u as (select clm_id, any_value(libname) as libname, any_value(at_ctg) as at_ctg, any_value(list_filter(links, lambda x: x > 0)) as u from clm where at_ctg is not null group by clm_id), v as (select libname, at_ctg, unnest(u) as v from u)"
_GRAMS = """
with d as (select doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) as w from documents where text is not null),
i as (select item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: lower(w)) as w from eval_items where text is not null),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from d where len(w) >= 13),
ig as (select item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) as g from i where len(w) >= 13)
"""
ORACLE = {
    "p9_found": _GRAMS + "select distinct doc_id, item_id from dg join ig using (g)",
    "p1_found": _P1 + "select libname, contig_lo, contig_hi from r",
    "p1_pairs": _P1
    + "select libname, contig_lo, contig_hi, n_lo, n_hi, n_both, n_baskets, round(cast(n_both as double) * n_baskets / (cast(n_lo as double) * n_hi), 6) as lift, round(((cast(n_both as double) + cast(0.5 as double)) * (n_baskets - n_lo - n_hi + n_both + cast(0.5 as double))) / ((n_lo - n_both + cast(0.5 as double)) * (n_hi - n_both + cast(0.5 as double))), 4) as odds_ratio from r",
    "p2_found": _USABLE
    + """, r as (select *, row_number() over (partition by libname, at_ctg order by v) as rn, count(*) over (partition by libname, at_ctg) as n from v),
p as (select unnest([10, 50, 90]) as pct, unnest([96, 128, 192]) as bin)
select libname, at_ctg, cast(pct as integer) as pct from r join p on rn = (n * pct + 99) // 100 join distribution using (bin) where n >= 50 and v >= binstart""",
    "p3_found": """
with recursive e as (select distinct trim(query_name, ' ' || chr(9)) as a, trim(target_name, ' ' || chr(9)) as b from paf where query_name is not null and target_name is not null),
s as (select a, b from e where a <> b union select b, a from e where a <> b),
w as (select distinct a as seqname, a as groupname from s union select w.seqname, s.b from w join s on s.a = w.groupname)
select seqname, min(groupname) as groupname from w group by 1""",
    "p5_found": _CUR
    + """, g as (select distinct ctg, groupid from ctg_groups where ctg is not null and groupid is not null),
r as (select groupid, pair_id, row_number() over (partition by groupid order by observedlinks desc, contig2, pair_id) as k from c join g on ctg = contig1 where contig2 is not null and observedlinks is not null)
select groupid, pair_id from r where k <= 5""",
    "p5_rows": _CUR
    + """, g as (select distinct ctg, groupid from ctg_groups where ctg is not null and groupid is not null),
r as (select groupid, contig1, contig2, observedlinks, pair_id, row_number() over (partition by groupid order by observedlinks desc, contig2, pair_id) as k from c join g on ctg = contig1 where contig2 is not null and observedlinks is not null)
select groupid, contig1, contig2, observedlinks, pair_id from r where k <= 5""",
}
