"""The SQL of the contact queries."""

from __future__ import annotations

from .. import config as C

_MID = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(C.bin_starts()[:-1], C.bin_starts()[1:], strict=True)))
_RADII = "[" + ", ".join(map(str, C.golden_radii())) + "]"
_CUR = "cur as (select * exclude (rn) from (select *, row_number() over (partition by pair_id order by loaded_at desc) as rn from pairs) where rn = 1)"
_NAMED = _CUR + ", np as (select * from cur where contig1 is not null and contig2 is not null and contig1 <> contig2 and observedlinks > 0)"
_TOTAL = _NAMED + ", pt as (select least(contig1, contig2) as a, greatest(contig1, contig2) as b, cast(sum(observedlinks) as bigint) as n from np group by all)"
_CLM = "k as (select distinct clm_id, libname, at_ctg as a, ao, bt_ctg as b, bo, list_filter(links, lambda x: x > 0) as links from clm where at_ctg is not null and bt_ctg is not null and ao in ('+', '-') and bo in ('+', '-') and len(list_filter(links, lambda x: x > 0)) > 0)"
_LEN = "ln as (select idx, contig, recounts, length from contigs where contig is not null and length > 0), kn as (select * from ln union all select idx, contig, recounts, length from shared_contigs where contig is not null and length > 0), lm as (select contig, max(length) as length from kn group by 1)"
_LINKS = (
    _LEN
    + """, rd as (select distinct paf_id, trim(query_name, ' ' || chr(9)) as r, query_start as p, trim(target_name, ' ' || chr(9)) as m, target_start as q from paf where mapping_quality <> 0 and query_start is not null and target_start is not null and query_name is not null and target_name is not null),
lk as (select case when x.idx > y.idx then y.idx else x.idx end as ai, case when x.idx > y.idx then x.idx else y.idx end as bi, case when x.idx > y.idx then m else r end as a, case when x.idx > y.idx then r else m end as b,
  case when x.idx > y.idx then q else p end as apos, case when x.idx > y.idx then p else q end as bpos, case when x.idx > y.idx then y.length else x.length end as alen, case when x.idx > y.idx then x.length else y.length end as blen
  from rd join kn x on x.contig = r join kn y on y.contig = m)"""
)
_ORI = """, ol as (select ai, bi, a, b, '+' as ao, '+' as bo, alen - apos + bpos as dist from lk where ai <> bi union all select ai, bi, a, b, '+', '-', alen - apos + blen - bpos from lk where ai <> bi
union all select ai, bi, a, b, '-', '+', apos + bpos from lk where ai <> bi union all select ai, bi, a, b, '-', '-', apos + blen - bpos from lk where ai <> bi)"""
_TOUR = """, tr as (select right(contig, 1) as grp, row_number() over (partition by right(contig, 1) order by idx) - 1 as pos, contig, length as size from ln),
pl as (select *, case when pos % 3 = 2 then -1 else 1 end as sign, cast(coalesce(sum(size) over (partition by grp order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as cum from tr)"""
_SEQ = "sq as (select doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC') as seq from documents where text is not null)"
_BIN = f"bn as (select bin, cast(s as bigint) as s, cast(e as bigint) as e from (values {_MID}) v(bin, s, e))"
_OCT = "cast(floor(16 * log2(cast(d as double) / 2048)) as integer)"
_DENS = (
    _CLM
    + ", "
    + _LEN
    + ", "
    + _BIN
    + f""", dd as (select unnest(links) as d from k), bc as (select {_OCT} as bin, count(*) as c from dd where d >= 2048 group by 1),
nm as (select bin, cast(coalesce(sum(length - s), 0) as bigint) as norm from bn left join ln on length >= s group by bin),
de as (select bn.bin, s as binstart, e - s as binsize, coalesce(c, 0) as numlinks, norm as totalsize, case when norm <> 0 then cast(coalesce(c, 0) as double) / norm / (e - s) end as linkdensity from bn left join bc using (bin) join nm using (bin)),
fr as (select *, coalesce(sum(numlinks) over (order by bin desc rows between unbounded preceding and 1 preceding), 0) as far from de),
tp as (select coalesce(max(case when far >= 100 then bin end), 0) as top from fr)"""
)
_SMOOTH = """, pw as (select exp(regr_intercept(ln(linkdensity), ln(cast(binstart as double)))) as pa, regr_slope(ln(linkdensity), ln(cast(binstart as double))) as pb from de, tp where bin < top and numlinks > 0 and linkdensity > 0),
sm as (select bin, binstart as s, binstart + binsize as e, numlinks, case when bin >= top or coalesce(linkdensity, 0) = 0 then pa * pow(cast(binstart as double), pb) else linkdensity end as linkdensity from de, tp, pw)"""
_EDGES = (
    _TOTAL
    + ", "
    + _LEN
    + """, rc as (select contig, max(recounts) as r from kn where recounts > 0 group by 1), mx as (select max(r) as m from rc),
ed as (select a, b, n * m * m // (x.r * y.r) as weight from pt join rc x on x.contig = a join rc y on y.contig = b, mx where n * m * m // (x.r * y.r) > 0),
ee as (select a as contig, b as other, weight from ed union all select b, a, weight from ed),
fa as (select contig, cast(coalesce(sum(weight), 0) as bigint) as links from (select distinct contig from kn) left join ee using (contig) group by 1),
ff as (select contig, links, cast(links as double) / (sum(links) over () / cast(count(*) over () as double)) as factor from fa)"""
)
_FIX = ", cl as (select ctg as contig, min(groupid) as cluster from ctg_groups where ctg is not null and groupid is not null group by 1)"
_LINKAGE = _EDGES + _FIX + ", sz as (select cluster, count(*) as s from cl group by 1), lg as (select ee.contig, c.cluster, sum(weight) as w from ee join cl c on c.contig = other group by all), av as (select lg.contig, lg.cluster, cast(w as double) / (s - case when o.contig is null then 0 else 1 end) as avg_weight from lg join sz using (cluster) left join cl o on o.contig = lg.contig and o.cluster = lg.cluster where s - case when o.contig is null then 0 else 1 end > 0)"
_DIST = _TOTAL + ", " + _LEN + _TOUR + ", ds as (select x.grp, n, abs((y.cum + y.size / cast(2 as double)) - (x.cum + x.size / cast(2 as double))) as dist from pt join pl x on x.contig = a join pl y on y.contig = b and y.grp = x.grp where dist <= 10000000 and dist > 0)"
_DENSITY = _TOTAL + ", " + _LEN + ", en as (select a as contig, n from pt union all select b, n from pt), dn as (select contig, cast(sum(n) as bigint) as links, any_value(length) as length, log10(cast(sum(n) as double) / least(any_value(length), 500000)) as log_density from en join lm using (contig) group by 1)"
_MAD = _DENSITY + ", md as (select median(log_density) as m from dn), mb as (select m, cast(3.5 as double) / cast(0.67449 as double) * (select median(abs(log_density - m)) from dn, md) as w from md)"
_CHROM = _LINKS + _TOUR + ", cl2 as (select x.grp as seqid, x.cum + apos as a, y.cum + bpos as b from lk join pl x on x.contig = a join pl y on y.contig = b and y.grp = x.grp), bd as (select grp as seqid, cum as start, cum + size - 1 as fin, contig as name from pl)"
_FLANK = _LINKS + """, fl as (select contig, length, least(length // 2, 50000) as f from kn),
nd as (select a || ':' || case when apos < x.f then 'L' else 'R' end as a, b || ':' || case when bpos < y.f then 'L' else 'R' end as b, x.f as la, y.f as lb from lk join fl x on x.contig = a join fl y on y.contig = b where a <> b and (apos < x.f or apos >= x.length - x.f) and (bpos < y.f or bpos >= y.length - y.f)),
ge as (select least(a, b) as a, greatest(a, b) as b, count(*) as n, count(*) * 1000000000000 // (max(la) * max(lb)) as weight from nd where la > 0 and lb > 0 group by all)"""
_INTRA = """coalesce(sum(case when s < length then cast((least(e, length) - s) as double) * (length - (s + least(e, length)) // 2) * linkdensity end), 0)"""
_HALF = "cast(0.5 as double)"
_PAIR_SUM = """coalesce(sum(cast(
 case when s < l1 then (least(e, l1) - s) * ((s + least(e, l1)) // 2) else 0 end
 + case when e >= l1 and s < l2 then (least(e, l2) - greatest(s, l1)) * l1 else 0 end
 + case when e >= l2 then (least(e, l1 + l2) - greatest(s, l2)) * (l1 + l2 - (greatest(s, l2) + least(e, l1 + l2)) // 2) else 0 end as double) * linkdensity), 0)"""
#: Rounds of density pruning that the SQL makes; once no contig goes, more change nothing.
_ROUNDS = 8
_PRUNED = _TOTAL + ", " + _LEN + ", r0 as (select a, b, n from pt)" + "".join(
    f", d{k} as materialized (select contig, cast(sum(n) as bigint) as links, any_value(length) as length, log10(cast(sum(n) as double) / least(any_value(length), 500000)) as log_density from (select a as contig, n from r{k} union all select b, n from r{k}) join lm using (contig) group by 1), m{k} as (select median(log_density) as m from d{k}), b{k} as (select m - cast(3.5 as double) / cast(0.67449 as double) * (select median(abs(log_density - m)) from d{k}, m{k}) as low from m{k}), o{k} as (select contig from d{k}, b{k} where log_density < low and length < 100000), r{k + 1} as materialized (select a, b, n from r{k} where a not in (select contig from o{k}) and b not in (select contig from o{k}))"
    for k in range(_ROUNDS)
)

ORACLE = {
    "q_site_counts": f"with {_SEQ} select doc_id, cast(len(regexp_extract_all(seq, 'GATC')) + 1 as bigint) as n_gatc, cast(len(regexp_extract_all(seq, 'GA[ACGT]TC|GATC|CATG')) + 1 as bigint) as n_multi, length(seq) as seq_length from sq",
    "q_site_totals": f"with {_LEN} select count(*) as n_contigs, cast(sum(recounts) as bigint) as n_sites, cast(sum(length) as bigint) as total_length, round(cast(sum(length) as double) / cast(sum(recounts) as double), 6) as bp_per_site from ln where recounts is not null",
    "q_reverse_complement": f"with {_SEQ}, rv as (select doc_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) as x from sq) select doc_id, md5(x) as rc, md5(rtrim(regexp_replace(x, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) as lines from rv",
    "q_links": f"with {_LINKS}{_ORI} select ai, bi, ao, bo, count(*) as n, cast(sum(dist) as bigint) as sum_dist, min(dist) as min_dist from ol group by all",
    "q_pair_counts": f"with {_LINKS} select a, b, count(*) as n from lk where ai <> bi group by all having count(*) >= 3",
    "q_link_summary": f"with {_LINKS}, p as (select ai, bi, count(*) filter (ai = bi and abs(apos - bpos) >= 2048) as i, count(*) filter (ai <> bi) as x from lk group by all) select cast(coalesce(sum(i), 0) as bigint) as n_intra, count(*) filter (i > 0) as n_contigs, cast(coalesce(sum(x), 0) as bigint) as n_inter, count(*) filter (x > 0) as n_pairs, coalesce(max(x), 0) as max_inter from p",
    "q_clm_lines": f"with {_LINKS}{_ORI} select a, b, ao, bo, count(*) as n, string_agg(cast(dist as varchar), ' ' order by dist) as dists from ol group by all having count(*) >= 3",
    "q_golden_hist": f"with {_CLM}, h as (select libname, a, b, ao, bo, unnest(links) as d from k) select libname, a, b, ao, bo, cast(least(greatest(round(ln(cast(d as double)) / cast({C.PHI!r} as double)), 18), 29) as integer) as bucket, count(*) as cnt from h group by all",
    "q_best_orientation": f"with {_CLM}, s as (select *, list_sum(list_transform(links, lambda x: ln(cast(x as double)))) as sl from k), r as (select *, row_number() over (partition by libname, a, b order by round(sl, 9), clm_id) as rn from s) select libname, a, b, ao, bo, len(links) as n, round(sl, 6) as sum_log, round(cast(list_sum(links) as double) / len(links), 4) as mean_dist, case when ao = bo then 1 else -1 end as strandedness from r where rn = 1",
    "q_strand_matrix": f"with {_CLM}, s as (select *, list_sum(list_transform(links, lambda x: ln(cast(x as double)))) as sl from k), r as (select *, row_number() over (partition by libname, a, b order by round(sl, 9), clm_id) as rn from s), o as (select a, b, len(links) * case when ao = bo then 1 else -1 end as v from r where rn = 1 and a <> b) select a, b, cast(sum(v) as bigint) as v from (select a, b, v from o union all select b, a, v from o) group by all",
    "q_contact_matrix": f"with {_TOTAL} select a, b, n from pt union all select b, a, n from pt",
    "q_link_bins": f"with {_DENS} select bin, binstart, binsize, numlinks from de",
    "q_bin_norms": f"with {_DENS} select bin, norm from nm",
    "q_distribution": f"with {_DENS} select bin, binstart, binsize, numlinks, totalsize, round(linkdensity * cast(1e12 as double), 6) as density from de",
    "q_top_bin": f"with {_DENS} select top from tp",
    "q_power_law": f"with {_DENS} select round(regr_intercept(ln(linkdensity), ln(cast(binstart as double))), 6) as ln_a, round(regr_slope(ln(linkdensity), ln(cast(binstart as double))), 6) as b from de, tp where bin < top and numlinks > 0 and linkdensity > 0",
    "q_expected_intra": f"with {_LEN}, {_BIN} select contig, round({_INTRA}, 6) as expected from ln left join (select bn.*, linkdensity from bn join distribution using (bin)) on s < length group by idx, contig",
    "q_expected_inter": f"""with {_TOTAL}, {_LEN}, {_BIN}, bs as (select bn.*, linkdensity from bn join distribution using (bin)),
l as (select a, b, n, least(x.length, y.length) as l1, greatest(x.length, y.length) as l2 from pt join lm x on x.contig = a join lm y on y.contig = b)
select a, b, n, round(coalesce(sum(cast(
 case when s < l1 then (least(e, l1) - s) * ((s + least(e, l1)) // 2) else 0 end
 + case when e >= l1 and s < l2 then (least(e, l2) - greatest(s, l1)) * l1 else 0 end
 + case when e >= l2 then (least(e, l1 + l2) - greatest(s, l2)) * (l1 + l2 - (greatest(s, l2) + least(e, l1 + l2)) // 2) else 0 end as double) * linkdensity), 0), 6) as expected
from l left join bs on s < l1 + l2 group by a, b, n""",
    "q_link_density": f"with {_DENSITY} select contig, links, round(log_density, 6) as log_density from dn",
    "q_mad_outliers": f"with {_MAD} select contig, round(log_density, 6) as log_density from dn, mb where log_density < m - w or log_density > m + w",
    "q_active_contigs": f"with {_MAD} select contig, length from dn, mb where length >= 10000 and (log_density >= m - w or length >= 100000)",
    "q_l50": f"with {_LEN}, r as (select length, row_number() over (order by length desc, idx) as rn, sum(length) over (order by length desc, idx rows unbounded preceding) as c, sum(length) over () as total from ln) select length as l50, rn as n50, cast(total as bigint) as total from r where c > total // 2 order by rn limit 1",
    "q_decile": f"with {_LEN}, r as (select length, row_number() over (order by length, idx) - 1 as k, count(*) over () as n from ln), v as (select length as cutoff from r where k = n // 10) select cutoff, (select count(*) from ln where length = cutoff) as n_equal from v",
    "q_edge_weights": f"with {_EDGES} select a, b, weight from ed",
    "q_repeat_factor": f"with {_EDGES} select contig, links, round(factor, 6) as factor from ff",
    "q_skipped": f"with {_EDGES}, own as (select contig, coalesce(max(recounts), 0) as r0 from kn group by 1) select contig, case when r0 < 10 then 'few' else 'repeat' end as reason from own left join ff using (contig) where r0 < 10 or factor >= 2",
    "q_skip_summary": f"with {_EDGES}, own as (select contig, coalesce(max(recounts), 0) as r0 from kn group by 1) select case when r0 < 10 then 'few' else 'repeat' end as reason, count(*) as n from own left join ff using (contig) where r0 < 10 or factor >= 2 group by 1",
    "q_normalised": f"with {_EDGES} select ee.contig as a, other as b, cast(ceil(weight / factor) as bigint) as weight from ee join ff on ff.contig = ee.contig where factor > 0",
    "q_cluster_sizes": f"with {_LEN}{_FIX}, t as (select cluster, count(*) as n_members, cast(sum(length) as bigint) as total_length from cl join lm using (contig) group by 1) select *, cast(row_number() over (order by total_length desc, cluster) as integer) as rank from t",
    "q_linkage": f"with {_LINKAGE} select contig, cluster, round(avg_weight, 6) as avg_weight from av",
    "q_recovered": f"with {_LINKAGE}, sk as (select distinct contig from kn where contig not in (select contig from cl)), rk as (select *, row_number() over (partition by contig order by avg_weight desc, cluster) as r from av where contig in (select contig from sk)), t as (select contig, max(cluster) filter (r = 1) as cluster, max(avg_weight) filter (r = 1) as one, max(avg_weight) filter (r = 2) as two from rk group by 1) select contig, cluster from t where one >= 1.5 and (two is null or two = 0 or one >= 1.5 * two)",
    "q_allelic_label": f"with {_NAMED}, g as (select distinct ctg, groupid from ctg_groups where ctg is not null and groupid is not null) select pair_id, case when exists (select 1 from g x join g y using (groupid) where x.ctg = contig1 and y.ctg = contig2) then 'allelic' else 'ok' end as label from np",
    "q_best_per_group": f"with {_TOTAL}, g as (select distinct ctg, groupid from ctg_groups where ctg is not null and groupid is not null), e2 as (select a as contig, b as ctg, n from pt union all select b, a, n from pt) select contig, groupid, max(n) as best from e2 join g using (ctg) group by all",
    "q_leave_one_out": f"""with {_TOTAL}, {_LEN}{_TOUR}, al as (select x.grp, least(x.pos, y.pos) as p, greatest(x.pos, y.pos) as q, n, abs((y.cum + y.size / cast(2 as double)) - (x.cum + x.size / cast(2 as double))) as dist from pt join pl x on x.contig = a join pl y on y.contig = b and y.grp = x.grp where x.pos <> y.pos),
ch as (select grp, unnest([p, q]) as pos, n / dist as d from al where dist <= 10000000
union all select grp, z.pos, case when dist <= 10000000 then n / dist else 0 end - case when dist - size <= 10000000 then n / (dist - size) else 0 end from al join pl z using (grp) where z.pos > p and z.pos < q),
su as (select grp, pos, sum(d) as gain from ch group by all)
select grp, contig, case when gain > 1e-9 then round(log10(gain), 4) else cast(-9 as double) end as log_gain from pl left join su using (grp, pos)""",
    "q_laws": """with t as (select bin, binstart, cast(binstart as double) as z, cast(2048 as double) as lo, cast(0.15 as double) as al, cast(100000 as double) as sp from distribution where binstart is not null),
v as (select bin, binstart, al * pow(lo, al) / pow(z, al + 1) as pareto, al * pow(lo, al) / pow(z, al + 1) / (1 - pow(lo / cast(1e8 as double), al)) as bounded, 1 / (ln(cast(1e8 as double) / lo) * z) as reciprocal, cast(1e-6 as double) * exp(-cast(1e-6 as double) * z) as exponential, case when z < lo then 0 when z <= lo + sp then (1 - pow(lo / z, al)) / sp else (pow(lo / (z - sp), al) - pow(lo / z, al)) / sp end as ends from t)
select bin, binstart, """ + ", ".join(f"case when {k} > 1e-300 then round(log10({k}), 6) end as {k}" for k in ("pareto", "bounded", "reciprocal", "exponential", "ends")) + " from v",
    "q_tour_score": f"with {_DIST} select grp, round(-sum(n / dist), 6) as score from ds group by 1",
    "q_tour_score_log": f"with {_DIST} select grp, round(sum(n * (ln(dist) - ln(cast(10000000 as double)))), 3) as score from ds group by 1",
    "q_orientation_score": f"""with {_CLM}, {_LEN}{_TOUR}, h0 as (select a, b, ao, bo, unnest(links) as d from k where a <> b),
h1 as (select a, b, ao, bo, d from h0 union all select b, a, case when bo = '-' then '+' else '-' end, case when ao = '-' then '+' else '-' end, d from h0),
pv as (select *, lag(cum) over (partition by grp order by pos) as prev, case when sign < 0 then '-' else '+' end as o from pl),
m as (select x.grp, {_RADII}[cast(least(greatest(round(ln(cast(d as double)) / cast({C.PHI!r} as double)), 18), 29) as integer) - 17] as rad, y.prev - x.cum as gap from h1 join pv x on x.contig = a and x.o = ao join pv y on y.contig = b and y.o = bo and y.grp = x.grp where x.pos < y.pos and y.prev - x.cum <= 10000000)
select grp, round(-sum(ln(cast(rad + gap as double))), 3) as score from m group by 1""",
    "q_agp": f"with {_LEN}{_TOUR}, o as (select *, cum + 100 * pos as off from pl) select grp as object, cast(off + 1 as bigint) as object_beg, cast(off + size as bigint) as object_end, 2 * pos + 1 as part, 'W' as type, cast(null as bigint) as gap_length, contig as component, size as component_end, case when sign < 0 then '-' else '+' end as orientation from o union all select grp, cast(off - 99 as bigint), cast(off as bigint), 2 * pos, 'U', 100, null, null, null from o where pos > 0",
    "q_unplaced": f"with {_NAMED}, {_LEN} select distinct contig from (select contig1 as contig from np union all select contig2 from np) where contig not in (select contig from ln)",
    "q_scaffold_lines": f"""with {_SEQ}, s as (select source as object, doc_id, seq, row_number() over (partition by source order by doc_id) - 1 as pos from sq join documents using (doc_id) where source is not null and seq <> ''),
p as (select object, pos, case when pos % 3 = 2 then reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) else seq end as t from s),
w as (select object, string_agg(t, repeat('N', 100) order by pos) as x from p group by 1),
l as (select object, unnest(range(0, (length(x) + 59) // 60)) as line, x from w), q as (select object, line, substring(x, line * 60 + 1, 60) as seq from l)
select object, count(*) as n_lines, cast(sum(length(seq)) as bigint) as n_letters, cast(sum(length(regexp_replace(seq, '[^N]', '', 'g'))) as bigint) as n_gap, cast(sum((line + 1) * length(regexp_replace(seq, '[^A]', '', 'g'))) as bigint) as sum_a from q group by 1""",
    "q_heatmap": f"with {_LINKS}{_TOUR}, c as (select x.grp, (x.cum + case when x.sign < 0 then x.size - apos else apos end) as pa, (y.cum + case when y.sign < 0 then y.size - bpos else bpos end) as pb from lk join pl x on x.contig = a join pl y on y.contig = b and y.grp = x.grp where a <> b), z as (select grp, cast(floor(pa / 1000000) as bigint) as bin_a, cast(floor(pb / 1000000) as bigint) as bin_b from c) select grp, bin_a, bin_b, count(*) as cnt from (select * from z union all select grp, bin_b, bin_a from z) group by all",
    "q_range_join": f"with {_CHROM} select cl2.seqid, name, count(*) as n, min(a) as first_a from cl2 join bd on bd.seqid = cl2.seqid and a >= start and a <= fin group by all",
    "q_posterior": f"""with {_CHROM}, m as (select bd.seqid, name, greatest(abs(a - b), 1) as fwd, greatest(abs(start + fin - a - b), 1) as rev from cl2 join bd on bd.seqid = cl2.seqid and a >= start and a <= fin where abs(a - b) >= 2048 and not (b >= start and b < fin)),
g as (select seqid, name, count(*) as n_links, sum(cast(-0.8 as double) * ln(cast(fwd as double))) as f, sum(cast(-0.8 as double) * ln(cast(rev as double))) as r from m group by all)
select seqid, name, n_links, round(f, 6) as log_fwd, round(r, 6) as log_rev, round(case when f - r > 100 then 1 when f - r < -100 then 0 else 1 / (1 + exp(-(f - r))) end, 6) as postprob from g""",
    "q_coverage": "with r as (select trim(query_name, ' ' || chr(9)) as query_name, query_start as s, query_end as e from paf where query_name is not null and query_start < query_end), v as (select query_name, s as pos, 1 as d from r union all select query_name, e, -1 from r), g as (select query_name, pos, sum(d) as d from v group by all) select query_name, pos, cast(sum(d) over (partition by query_name order by pos rows unbounded preceding) as bigint) as depth from g",
    "q_graph_edges": f"with {_FLANK} select a, b, n, cast(weight as bigint) as weight from ge",
    "q_confidence": f"""with {_FLANK}, bo as (select distinct a, weight from (select a, weight from ge union all select b, weight from ge)), tt as (select a, list(weight order by weight desc)[1:2] as t from bo group by 1),
x as (select ge.a, ge.b, weight, p.t || q.t as u from ge join tt p on p.a = ge.a join tt q on q.a = ge.b), y as (select a, b, weight, coalesce(list_max(list_filter(u, lambda v: v < list_max(u))), list_min(u)) as v from x)
select a, b, cast(weight as bigint) as weight, round(cast(weight as double) / cast(v as double), 6) as confidence from y where v <> 0 and cast(weight as double) / cast(v as double) > 1""",
    "q_best_partners": f"with {_FLANK}, bo as (select a, b, weight from ge union all select b, a, weight from ge), r as (select *, row_number() over (partition by a order by weight desc, b) as rn from bo) select x.a, x.b, cast(x.weight as bigint) as weight from r x join r y on y.a = x.b and y.b = x.a where x.rn = 1 and y.rn = 1 and x.a < x.b",
    "q_modularity": f"with {_TOTAL}, g as (select right(a, 1) as pa, right(b, 1) as pb, n from pt), m as (select sum(n) as m from g), dg as (select p, sum(n) as deg from (select pa as p, n from g union all select pb, n from g) group by 1), i as (select pa as p, sum(n) as inn from g where pa = pb group by 1) select round(sum(coalesce(cast(inn as double), 0) / cast(m as double) - pow(cast(deg as double) / (2 * cast(m as double)), 2)), 6) as q from dg left join i using (p), m",
    "q_model": f"with {_DENS}{_SMOOTH} select bin, numlinks, round(log10(linkdensity), 6) as log_density from sm",
    "q_extracted": f"""with {_LINKS}, {_BIN}, dd as (select ai, abs(apos - bpos) as d from lk where ai = bi and abs(apos - bpos) >= 2048), fl as (select coalesce(min_by(c, ai), 0) // 100 as floor from (select ai, count(*) as c from dd group by 1)),
bc as (select {_OCT} as bin, count(*) as c from dd group by 1), nm as (select bin, cast(coalesce(sum(length - s), 0) as bigint) as norm from bn left join kn on length >= s group by bin),
de as (select bn.bin, s as binstart, e - s as binsize, coalesce(c, 0) as numlinks, norm as totalsize, case when norm <> 0 then cast(coalesce(c, 0) as double) / norm / (e - s) end as linkdensity from bn left join bc using (bin) join nm using (bin)),
fr as (select *, coalesce(sum(numlinks) over (order by bin desc rows between unbounded preceding and 1 preceding), 0) as far from de), tp as (select coalesce(max(case when far >= floor then bin end), 0) as top from fr, fl){_SMOOTH},
p as (select ai, bi, a, b, count(*) as observed from lk where ai <> bi group by all having count(*) >= 3), l as (select p.*, least(x.length, y.length) as l1, greatest(x.length, y.length) as l2 from p join lm x on x.contig = a join lm y on y.contig = b)
select ai, bi, a, b, observed, round({_PAIR_SUM}, 6) as expected from l left join sm on s < l1 + l2 group by all""",
    "q_pruned_density": f"with {_PRUNED} select contig, links, round(log_density, 6) as log_density from d{_ROUNDS - 1}",
    "q_active_summary": f"with {_MAD} select count(*) as n_contigs, cast(coalesce(sum(length), 0) as bigint) as total_length from dn, mb where length >= 10000 and (log_density >= m - w or length >= 100000)",
    "q_label_counts": f"with {_TOTAL}, g as (select distinct ctg, groupid from ctg_groups where ctg is not null and groupid is not null), al as (select distinct x.ctg as a, y.ctg as b from g x join g y using (groupid)) select case when al.a is null then 'between' else 'within' end as kind, count(*) as n_pairs, cast(sum(n) as bigint) as n_links from pt left join al on al.a = pt.a and al.b = pt.b group by 1",
    "q_true_distance": f"with {_CLM}, {_LEN}{_TOUR}, s as (select *, list_sum(list_transform(links, lambda x: ln(cast(x as double)))) as sl from k), r as (select *, row_number() over (partition by libname, a, b order by round(sl, 9), clm_id) as rn from s) select libname, r.a, r.b, len(links) as n, round(cast(list_sum(links) as double) / len(links), 4) as inferred, cast(case when x.grp <> y.grp then 100000000 when x.cum <= y.cum then y.cum + y.size - x.cum else x.cum + x.size - y.cum end as bigint) as true_dist from r join pl x on x.contig = r.a join pl y on y.contig = r.b where rn = 1 and r.a <> r.b and len(links) >= 2",
    "q_split_paths": f"""with {_LINKS}{_TOUR}, c as (select x.grp, x.cum + case when x.sign < 0 then x.size - apos else apos end as p, y.cum + case when y.sign < 0 then y.size - bpos else bpos end as q from lk join pl x on x.contig = a join pl y on y.contig = b and y.grp = x.grp where a <> b),
iv as (select grp, least(p, q) as s, greatest(p, q) as e from c where abs(p - q) < 1000000), tl as (select grp, cast(sum(size) as bigint) as total from pl group by 1),
pt as (select grp, unnest(range(0, total, greatest(total // 1000, 1))) as spot from tl), n as (select pt.grp, spot, count(iv.s) filter (s < spot) - count(iv.e) filter (e < spot) as c from pt left join iv on iv.grp = pt.grp group by all),
w as (select grp, list_sort(list(c))[count(*) // 2 + 1] as weak from n group by 1),
j as (select pl.grp, pos, contig, cum, count(iv.s) filter (s < cum) - count(iv.e) filter (e < cum) as strength from pl left join iv on iv.grp = pl.grp group by all)
select grp, pos, contig, strength, cast(sum(case when cum >= 1000000 and cum < total - 1000000 and strength < weak then 1 else 0 end) over (partition by grp order by pos) as bigint) as piece from j join w using (grp) join tl using (grp)""",
    "q_path_extremes": f"with {_LEN}{_TOUR}, t as (select grp, cast(sum(size) as bigint) as length from tr group by 1) select (select grp from t order by length desc, grp limit 1) as longest, max(length) as most, (select grp from t order by length, grp limit 1) as shortest, min(length) as least from t",
    "q_chain_order": f"""with recursive {_FLANK}, bo as (select a, b, weight from ge union all select b, a, weight from ge), r as (select *, row_number() over (partition by a order by weight desc, b) as rn from bo), b0 as (select x.a, x.b, x.weight, left(x.a, length(x.a) - 2) as p, left(x.b, length(x.b) - 2) as q from r x join r y on y.a = x.b and y.b = x.a where x.rn = 1 and y.rn = 1),
cc as (select distinct p as c, p as l from b0 union select cc.c, q from cc join b0 on b0.p = cc.l), lb as (select c, min(l) as l from cc group by 1), sz as (select l, count(*) as nodes from lb group by 1),
cy as (select l, min_by({{'a': a, 'b': b}}, {{'w': weight, 'p': p, 'q': q, 'a': a, 'b': b}}) as cut, count(*) as links from b0 join lb on lb.c = p where a < b group by 1), ct as (select cut from cy join sz using (l) where links >= nodes),
bp as (select a, b from b0 where {{'a': least(a, b), 'b': greatest(a, b)}} not in (select cut from ct)),
hp as (select a as state, left(b, length(b) - 1) || case when right(b, 1) = 'L' then 'R' else 'L' end as nxt from bp), cn as (select distinct contig from kn),
st as (select contig as head, contig || ':R' as state from cn where contig || ':L' not in (select a from bp) union all select contig, contig || ':L' from cn where contig || ':R' not in (select a from bp)),
wk as (select head, state as origin, state, 0 as pos from st union all select head, origin, hp.nxt, pos + 1 from wk join hp using (state)),
z as (select *, left(state, length(state) - 2) as contig, right(state, 1) as side, max(pos) over (partition by origin) + 1 as n_contigs from wk),
o as (select *, row_number() over (partition by contig order by head, case when side = 'R' then 0 else 1 end) as k from z)
select contig, cast(n_contigs as bigint) as n_contigs, cast(pos as bigint) as pos, case when side = 'R' then '+' else '-' end as orientation from o where k = 1""",
    "q_best_moves": f"""with {_TOTAL}, bo as (select a, b, cast(n as double) as w from pt union all select b, a, n from pt), nr as (select a as node, right(b, 1) as part, sum(w) as k from bo group by all), dg as (select node, right(node, 1) as own, sum(k) as deg from nr group by 1), sz as (select own as part, sum(deg) as d from dg group by 1), tm as (select sum(deg) / 2 as m from dg),
g as (select nr.node, nr.part, (nr.k - coalesce(o.k, 0)) / m - deg * (t.d - f.d + deg) / (2 * m * m) as gain from nr join dg on dg.node = nr.node and nr.part <> own left join nr o on o.node = nr.node and o.part = own join sz t on t.part = nr.part join sz f on f.part = own, tm),
r as (select *, row_number() over (partition by node order by round(gain, 12) desc, part) as k from g) select node, part, round(gain, 9) as gain from r where k = 1 and round(gain, 12) > 0""",
    "q_label_propagation": f"""with {_TOTAL}, bo as (select a, b, cast(n as double) as w from pt union all select b, a, n from pt), l0 as (select distinct a as node, a as label from bo),
"""
    + ",\n".join(
        f"v{i} as (select node, label, sum(w) as w from (select a as node, label, w from bo join l{i - 1} on node = b union all select node, label, {_HALF} from l{i - 1}) group by all), l{i} as (select node, label from (select *, row_number() over (partition by node order by w desc, label) as rn from v{i}) where rn = 1)"
        for i in (1, 2, 3)
    )
    + " select node, label from l3",
    "q_carry_forward": "with r as (select src_file, line_no, min(raw_line) as raw_line from paf_raw where src_file is not null and line_no is not null group by all) select src_file, line_no, last_value(case when starts_with(raw_line, 'shr_') then split_part(raw_line, chr(9), 1) end ignore nulls) over (partition by src_file order by line_no rows unbounded preceding) as last_shared from r",
    "q_confusion": f"with {_CUR}, r as (select cast(observedlinks as double) / expectedlinksifadjacent as s, label = 'ok' as t from cur where label is not null and label <> '' and observedlinks is not null and expectedlinksifadjacent > 0), h as (select unnest([0.5, 1.0, 1.5, 2.0, 3.0, 5.0]::double[]) as threshold), c as (select threshold, count(*) filter (t and s >= threshold) as tp, count(*) filter (not t and s >= threshold) as fp, count(*) filter (not t and s < threshold) as tn, count(*) filter (t and s < threshold) as fn from h, r group by 1) select *, round(tp / cast(tp + fn as double), 6) as tpr, round(fp / cast(fp + tn as double), 6) as fpr, round((tp + tn) / cast(tp + fp + tn + fn as double), 6) as acc from c",
    "q_pareto_alpha": f"with {_CLM}, h as (select libname, unnest(links) as d from k) select libname, round(count(*) / (sum(ln(cast(d as double))) - count(*) * ln(cast(2048 as double))), 6) as alpha from h where d >= 2048 group by 1",
    "q_tags": "select paf_id, max(case when tags['cm'].kind = 'i' then try_cast(tags['cm'].val as bigint) end) as cm, max(case when tags['dv'].kind = 'f' then round(cast(try_cast(tags['dv'].val as float) as double), 6) end) as dv, max(tags['tp'].val) as tp from paf where tags is not null group by 1",
}
ORACLE["q_sign_gain"] = ORACLE["q_orientation_score"].replace("as score from m", "as score_before, true as not_worse from m")
