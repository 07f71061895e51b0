"""Queries of the contact model on the domain tables, each with its SQL.

Alignments of `paf` serve as links between contigs (query_start on the query, target_start on the
target), `contigs` in order of idx as tours (the group is the last letter of the name, the
haplotype), and the letters of `documents.text` as sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as E
from ..operators import assess, cluster, contacts, extract, graph, model, order, ordered, prune, release
from ..session import spread, table
from ..sources.text import carry_forward, tag_value

# Tables, cleaned


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """The current row of each pair_id."""
    cols = ["libname", "x", "y", "contig1", "contig2", "re1", "re2", "observedlinks", "expectedlinksifadjacent", "label"]
    rows = table(spark, d, "pairs").groupBy("pair_id").agg(F.max(F.struct("loaded_at", *cols)).alias("_r"))
    return rows.select("pair_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def named_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Current pairs of two known contigs with links."""
    return pairs(spark, d).filter("contig1 is not null and contig2 is not null and contig1 <> contig2 and observedlinks > 0")


def pair_totals(spark: SparkSession, d: str) -> DataFrame:
    """a < b, n: links of two contigs over all libraries."""
    return named_pairs(spark, d).groupBy(F.least("contig1", "contig2").alias("a"), F.greatest("contig1", "contig2").alias("b")).agg(F.sum("observedlinks").alias("n"))


def clm(spark: SparkSession, d: str) -> DataFrame:
    """Each clm_id once, with known contigs and orientations and its usable distances."""
    rows = table(spark, d, "clm").filter("at_ctg is not null and bt_ctg is not null and ao in ('+', '-') and bo in ('+', '-')")
    return rows.select("clm_id", "libname", F.col("at_ctg").alias("a"), "ao", F.col("bt_ctg").alias("b"), "bo", F.filter("links", lambda x: x > 0).alias("links")).filter("size(links) > 0").distinct()


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contigs").filter("contig is not null and length > 0").select("idx", "contig", "recounts", "length")


def known(spark: SparkSession, d: str) -> DataFrame:
    """All contigs with a length: those of the assembly, which make tours, and those shared by all libraries, which only have links."""
    return lengths(spark, d).unionByName(table(spark, d, "shared_contigs").filter("contig is not null and length > 0").select("idx", "contig", "recounts", "length"))


def reads(spark: SparkSession, d: str) -> DataFrame:
    trim = lambda c: F.btrim(F.col(c), F.lit(" \t"))
    rows = table(spark, d, "paf").filter("mapping_quality <> 0 and query_start is not null and target_start is not null")
    return rows.select("paf_id", trim("query_name").alias("ref"), F.col("query_start").alias("pos"), trim("target_name").alias("mate_ref"), F.col("target_start").alias("mate_pos")).dropna().distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    return contacts.place_links(reads(spark, d), known(spark, d))


def tour(spark: SparkSession, d: str) -> DataFrame:
    """grp, pos, contig, size, sign, orientation; every third contig lies the other way round."""
    rows = lengths(spark, d).select(F.substring("contig", -1, 1).alias("grp"), "idx", "contig", F.col("length").alias("size"))
    # Dense positions by idx: a running count in blocks.
    at = ordered.prefix_sum(rows, ["grp"], "idx", F.lit(1), "pos")
    sign = F.when(F.col("pos") % 3 == 2, -1).otherwise(1)
    return at.select("grp", F.col("pos").cast("long").alias("pos"), "contig", "size", sign.alias("sign"), F.when(sign < 0, "-").otherwise("+").alias("orientation"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    seq = F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), letters + letters.lower(), ("ACGT" * 7)[:26] * 2)
    return rows.select("doc_id", seq.alias("seq"))


def r6(x: Column) -> Column:
    return F.round(x, 6)


# Queries


def q_site_counts(spark, d):
    """Restriction sites per sequence, by one pattern and by several, with the pseudo-count of one."""
    s = F.col("seq")
    return sequences(spark, d).select("doc_id", (E.count_sites(s) + 1).alias("n_gatc"), (E.count_sites(s, "GANTC,GATC,CATG") + 1).alias("n_multi"), F.length("seq").cast("long").alias("seq_length"))


def q_site_totals(spark, d):
    """Contigs, sites, length and bp for every site."""
    rows = lengths(spark, d).filter("recounts is not null")
    return rows.agg(F.count("*").alias("n_contigs"), F.sum("recounts").alias("n_sites"), F.sum("length").alias("total_length"), r6(F.try_divide(F.sum("length").cast("double"), F.sum("recounts").cast("double"))).alias("bp_per_site"))


def q_reverse_complement(spark, d):
    """Reverse complements and their lines of 60 letters, as digests."""
    rc = E.reverse_complement(F.col("seq"))
    return sequences(spark, d).select("doc_id", F.md5(rc).alias("rc"), F.md5(E.wrapped(rc)).alias("lines"))


def q_links(spark, d):
    """The four oriented distances of each link between contigs."""
    return contacts.oriented_links(links(spark, d)).groupBy("ai", "bi", "ao", "bo").agg(F.count("*").alias("n"), F.sum("dist").alias("sum_dist"), F.min("dist").alias("min_dist"))


def q_pair_counts(spark, d):
    return contacts.pair_counts(links(spark, d), C.MIN_LINKS).select("a", "b", "n")


def q_link_summary(spark, d):
    return contacts.link_summary(links(spark, d))


def q_clm_lines(spark, d):
    """Distances of each pair and orientation in ascending order, as text."""
    rows = contacts.clm(links(spark, d))
    return rows.select("a", "b", "ao", "bo", "n", F.array_join(F.transform("links", lambda x: x.cast("string")), " ").alias("dists"))


def q_golden_hist(spark, d):
    return contacts.golden_histogram(clm(spark, d), ["libname", "a", "b", "ao", "bo"])


def _best(spark, d):
    return contacts.best_orientation(clm(spark, d), ["libname", "a", "b"], ["clm_id"])


def q_best_orientation(spark, d):
    return _best(spark, d).select("libname", "a", "b", "ao", "bo", "n", r6(F.col("sum_log")).alias("sum_log"), F.round("mean_dist", 4).alias("mean_dist"), "strandedness")


def q_strand_matrix(spark, d):
    """Links with the sign of the better orientation, both directions."""
    rows = _best(spark, d).filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("strandedness") * F.col("n")).alias("v"))
    return contacts.both_directions(rows, ao=None, bo=None).groupBy("a", "b").agg(F.sum("v").alias("v"))


def q_contact_matrix(spark, d):
    return contacts.contact_matrix(named_pairs(spark, d), "contig1", "contig2", "observedlinks")


def _distances(spark, d):
    return clm(spark, d).select(F.explode("links").alias("d"))


def q_link_bins(spark, d):
    return model.bin_counts(_distances(spark, d), "d")


def q_bin_norms(spark, d):
    return model.bin_norms(lengths(spark, d))


def _densities(spark, d):
    return model.densities(model.bin_counts(_distances(spark, d), "d"), model.bin_norms(lengths(spark, d)))


def q_distribution(spark, d):
    """Bins with their links, norms and densities, scaled by 10^12."""
    return _densities(spark, d).select("bin", "binstart", "binsize", "numlinks", "totalsize", r6(F.col("linkdensity") * E.double(1e12)).alias("density"))


def q_top_bin(spark, d):
    return model.top_bin(_densities(spark, d), 100)


def q_power_law(spark, d):
    """Least squares over the bins below the sparse tail."""
    rows = _densities(spark, d).persist()
    top = model.top_bin(rows, 100).first()[0]
    return model.fit_power_law(rows, top).select(r6(F.ln("a")).alias("ln_a"), r6(F.col("b")).alias("b"))


def q_model(spark, d):
    """Bins with their densities, by the power law where links are too few."""
    _, bins = model.make_model(_distances(spark, d), "d", lengths(spark, d), 100)
    return bins.select("bin", "numlinks", r6(F.log10("linkdensity")).alias("log_density"))


def q_extracted(spark, d):
    """Pairs of contigs by alignments, with the links expected by a model of the links within contigs."""
    rows = extract.extract(reads(spark, d), known(spark, d)).pairs
    return rows.select("ai", "bi", "a", "b", "observed", r6(F.col("expected")).alias("expected"))


def q_expected_intra(spark, d):
    """Expected links within each contig by the densities of `distribution`."""
    m = model.model_of(table(spark, d, "distribution"))
    return lengths(spark, d).select("contig", r6(model.expected_intra(F.col("length"), m)).alias("expected"))


def q_expected_inter(spark, d):
    """Expected links of the pairs if they were adjacent."""
    m = model.model_of(table(spark, d, "distribution"))
    c = known(spark, d).groupBy("contig").agg(F.max("length").alias("length"))
    rows = pair_totals(spark, d).join(c.toDF("a", "l1"), "a").join(c.toDF("b", "l2"), "b")
    return rows.select("a", "b", "n", r6(model.expected_inter(F.col("l1"), F.col("l2"), m)).alias("expected"))


def _density(spark, d):
    return contacts.link_density(pair_totals(spark, d), known(spark, d).groupBy("contig").agg(F.max("length").alias("length")))


def q_link_density(spark, d):
    return _density(spark, d).select("contig", "links", r6(F.col("log_density")).alias("log_density"))


def q_mad_outliers(spark, d):
    """Contigs whose link density lies outside median -+ 3.5 / 0.67449 MAD."""
    rows = _density(spark, d).persist()
    bounds = ordered.mad_bounds(rows, "log_density", C.OUTLIER_THRESHOLD, C.MAD_SCALE) or (0.0, 0.0)
    return rows.filter((F.col("log_density") < bounds[0]) | (F.col("log_density") > bounds[1])).select("contig", r6(F.col("log_density")).alias("log_density"))


def q_active_contigs(spark, d):
    """Contigs that are kept for ordering."""
    rows = _density(spark, d).persist()
    bounds = ordered.mad_bounds(rows, "log_density", C.OUTLIER_THRESHOLD, C.MAD_SCALE) or (0.0, 0.0)
    return contacts.active_contigs(rows, bounds[0]).select("contig", "length")


def q_pruned_density(spark, d):
    """Contigs that stay when those of low density go again and again."""
    rows = contacts.active_by_density(pair_totals(spark, d), known(spark, d).groupBy("contig").agg(F.max("length").alias("length")))
    return rows.select("contig", "links", r6(F.col("log_density")).alias("log_density"))


def q_active_summary(spark, d):
    """How many contigs are kept for ordering, and their length."""
    return q_active_contigs(spark, d).agg(F.count("*").alias("n_contigs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length"))


def q_l50(spark, d):
    return ordered.l50(lengths(spark, d), "length")


def q_decile(spark, d):
    """The element at a tenth of the sorted lengths."""
    v = ordered.element_at_share(lengths(spark, d), "length", 1, 10)
    return lengths(spark, d).filter(F.col("length") == (v or -1)).agg(F.first("length").alias("cutoff"), F.count("*").alias("n_equal"))


def _site_pairs(spark, d):
    c = known(spark, d).filter("recounts > 0").groupBy("contig").agg(F.max("recounts").alias("r"))
    return pair_totals(spark, d).join(c.toDF("a", "sites_a"), "a").join(c.toDF("b", "sites_b"), "b")


def _edges(spark, d):
    most = known(spark, d).filter("recounts > 0").agg(F.max("recounts")).first()[0] or 0
    return cluster.edge_weights(_site_pairs(spark, d), most)


def q_edge_weights(spark, d):
    return _edges(spark, d)


def q_repeat_factor(spark, d):
    return cluster.repeat_factors(_edges(spark, d), known(spark, d).select("contig").distinct()).select("contig", "links", r6(F.col("factor")).alias("factor"))


def q_skipped(spark, d):
    """Contigs that take no part in clustering, with the reason."""
    own = known(spark, d).groupBy("contig").agg(F.max("recounts").alias("recounts"))
    return cluster.skipped(own, cluster.repeat_factors(_edges(spark, d), own))


def q_skip_summary(spark, d):
    """How many contigs are skipped for each reason."""
    return q_skipped(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def q_normalised(spark, d):
    """Directed weights over the repeat factor of their first contig."""
    e = _edges(spark, d)
    return cluster.normalised(e, cluster.repeat_factors(e, known(spark, d).select("contig").distinct()))


def _strong(spark, d):
    """Edges with at least 1.5 times the mean weight."""
    e = _edges(spark, d)
    return e.crossJoin(F.broadcast(e.agg((F.avg("weight") * 1.5).alias("_m")))).filter("weight >= _m").select("a", "b", "weight")


def q_cluster(spark, d):
    """Chromosome groups by average linkage."""
    e = _strong(spark, d).persist()
    n = e.select(F.col("a").alias("c")).unionByName(e.select(F.col("b").alias("c"))).distinct().count()
    return cluster.cluster(e, n, 16)


def _fixed_clusters(spark, d):
    """Each contig in the lowest of its allele groups, as given clusters."""
    g = table(spark, d, "ctg_groups").filter("ctg is not null and groupid is not null")
    return g.groupBy(F.col("ctg").alias("contig")).agg(F.min("groupid").alias("cluster"))


def q_cluster_sizes(spark, d):
    own = known(spark, d).groupBy("contig").agg(F.max("length").alias("length"))
    return cluster.cluster_sizes(_fixed_clusters(spark, d), own).select("cluster", "n_members", "total_length", "rank")


def q_linkage(spark, d):
    """Average weight of each contig with each cluster."""
    both = contacts.both_directions(_edges(spark, d), ao=None, bo=None)
    return cluster.linkage(both, _fixed_clusters(spark, d)).select("contig", "cluster", r6(F.col("avg_weight")).alias("avg_weight"))


def q_recovered(spark, d):
    """Contigs in no cluster that clearly belong to one."""
    both = contacts.both_directions(_edges(spark, d), ao=None, bo=None)
    fixed = _fixed_clusters(spark, d)
    skip = known(spark, d).select("contig").distinct().join(fixed, "contig", "left_anti")
    return cluster.recover(both, fixed, skip, 1.5)


def q_allelic_label(spark, d):
    """Pairs within an allele group."""
    rows = prune.allelic(named_pairs(spark, d), table(spark, d, "ctg_groups"))
    return rows.select("pair_id", F.when(F.col("_allelic"), "allelic").otherwise("ok").alias("label"))


def q_best_per_group(spark, d):
    return prune.best_per_group(pair_totals(spark, d), table(spark, d, "ctg_groups"))


def q_cross_allelic(spark, d):
    """Pairs within an allele group, pairs that a matching of two groups leaves out, and the others."""
    return prune.prune(pair_totals(spark, d), table(spark, d, "ctg_groups"))


def q_label_counts(spark, d):
    """Pairs and links within an allele group, and of contigs in different groups or none."""
    rows = q_cross_allelic(spark, d).withColumn("kind", F.when(F.col("label") == "allelic", "within").otherwise("between"))
    return rows.groupBy("kind").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_links"))


def q_tour_score(spark, d):
    return order.tour_score(pair_totals(spark, d), tour(spark, d)).select("grp", r6(F.col("score")).alias("score"))


def q_tour_score_log(spark, d):
    return order.tour_score_log(pair_totals(spark, d), tour(spark, d)).select("grp", F.round("score", 3).alias("score"))


def _hists(spark, d):
    rows = clm(spark, d).filter("a <> b")
    turn = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(turn, y).otherwise(x)
    one = rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), pick(F.col("ao"), E.flip(F.col("bo"))).alias("ao"), pick(F.col("bo"), E.flip(F.col("ao"))).alias("bo"), "links")
    return contacts.golden_histogram(one, ["a", "b", "ao", "bo"])


def q_orientation_score(spark, d):
    return order.orientation_score(_hists(spark, d), tour(spark, d)).select("grp", F.round("score", 3).alias("score"))


def q_leading_signs(spark, d):
    """Orientations by the leading eigenvector of the strandedness matrix."""
    rows = _best(spark, d).filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("strandedness") * F.col("n")).alias("v"))
    return order.leading_signs(rows, tour(spark, d)).select("grp", "pos", "contig", "sign")


def q_improved_signs(spark, d):
    """Orientations after flips of groups and contigs, until none gains."""
    return order.improve_signs(_hists(spark, d), tour(spark, d)).select("grp", "pos", "contig", "sign")


def q_improved_order(spark, d):
    """Orders after a search within segments and of their places, until no group gets better."""
    return order.improve_order(pair_totals(spark, d), tour(spark, d)).select("grp", "pos", "contig")


def q_leave_one_out(spark, d):
    """What each contig adds to the score of its tour, as log10."""
    rows = order.leave_one_out(pair_totals(spark, d), tour(spark, d))
    return rows.select("grp", "contig", F.when(F.col("gain") > 1e-9, F.round(F.log10("gain"), 4)).otherwise(E.double(-9)).alias("log_gain"))


def q_pruned_tour(spark, d):
    """Tours without contigs that add far less than the others, until none does."""
    return order.prune_tour(pair_totals(spark, d), tour(spark, d)).select("grp", "pos", "contig", F.round("log_gain", 4).alias("log_gain"))


def q_sign_gain(spark, d):
    """Whether the searched orientations score at least as well as those of the tour, by group."""
    hists, before = _hists(spark, d), tour(spark, d)
    after = order.improve_signs(hists, before)
    rows = order.orientation_score(hists, before).toDF("grp", "_b").join(order.orientation_score(hists, after).toDF("grp", "_a"), "grp")
    return rows.select("grp", F.round("_b", 3).alias("score_before"), (F.col("_a") >= F.col("_b") - 1e-6).alias("not_worse"))


def q_true_distance(spark, d):
    """Mean distance of the better orientation against the true one by the tour."""
    rows = _best(spark, d).filter("a <> b and n >= 2").select("libname", "a", "b", "n", F.round("mean_dist", 4).alias("inferred"))
    return order.true_distances(rows, tour(spark, d))


def q_split_paths(spark, d):
    """Tours in pieces, parted where fewer links cross a join than half of the places of the path have."""
    return order.split_weak(links(spark, d), tour(spark, d), (1, 2))


def q_path_extremes(spark, d):
    """The longest and the shortest path of the tours."""
    per = tour(spark, d).groupBy("grp").agg(F.sum("size").alias("length"), F.count("*").alias("n"))
    return per.agg(F.min_by("grp", F.struct((-F.col("length")).alias("l"), "grp")).alias("longest"), F.max("length").alias("most"), F.min_by("grp", F.struct("length", "grp")).alias("shortest"), F.min("length").alias("least"))


def q_agp(spark, d):
    lines = release.agp(tour(spark, d))
    return lines.select("object", "object_beg", "object_end", "part", "type", "gap_length", "component", "component_end", "orientation")


def q_unplaced(spark, d):
    """Contigs of pairs that are in no tour."""
    own = named_pairs(spark, d).select(F.col("contig1").alias("contig")).unionByName(named_pairs(spark, d).select(F.col("contig2").alias("contig"))).distinct()
    return release.unplaced(own, tour(spark, d))


def q_scaffold_lines(spark, d):
    """Scaffolds of sequences in lines of 60: documents of a source in order of doc_id, every third one turned."""
    seqs = sequences(spark, d).filter("seq <> ''")
    src = table(spark, d, "documents").filter("source is not null").select("doc_id", "source")
    rows = seqs.join(src, "doc_id").select(F.col("source").alias("grp"), "doc_id", F.col("doc_id").cast("string").alias("contig"), F.length("seq").cast("long").alias("size"))
    at = ordered.prefix_sum(rows, ["grp"], "doc_id", F.lit(1), "pos").withColumn("orientation", F.when(F.col("pos") % 3 == 2, "-").otherwise("+"))
    lines = release.sequence_lines(release.agp(at), seqs.select(F.col("doc_id").cast("string").alias("name"), "seq"))
    return lines.groupBy("object").agg(F.count("*").alias("n_lines"), F.sum(F.length("seq")).alias("n_letters"), F.sum(F.length(F.regexp_replace("seq", "[^N]", ""))).alias("n_gap"), F.sum((F.col("line") + 1) * F.length(F.regexp_replace("seq", "[^A]", ""))).alias("sum_a"))


def q_heatmap(spark, d):
    return assess.heatmap(links(spark, d), tour(spark, d), 1_000_000)


def _bed(spark, d):
    """Ranges of one sequence per haplotype, from the tour."""
    at = order.placed(tour(spark, d))
    return at.select(F.col("grp").alias("seqid"), F.col("cum").cast("long").alias("start"), (F.col("cum") + F.col("size") - 1).cast("long").alias("end"), F.col("contig").alias("name"))


def _chrom_links(spark, d):
    """Links on the haplotypes: both ends moved to the coordinates of the tour."""
    at = order.placed(tour(spark, d)).select("grp", "contig", F.col("cum").cast("long").alias("cum"))
    rows = links(spark, d).join(at.toDF("ga", "a", "ca"), "a").join(at.toDF("gb", "b", "cb"), "b").filter("ga = gb")
    return rows.select(F.col("ga").alias("seqid"), (F.col("ca") + F.col("apos")).alias("a"), (F.col("cb") + F.col("bpos")).alias("b"))


def q_range_join(spark, d):
    """Points in the ranges they lie in."""
    met = assess.points_in_ranges(_chrom_links(spark, d), _bed(spark, d), "seqid", "a")
    return met.groupBy("seqid", "name").agg(F.count("*").alias("n"), F.min("a").alias("first_a"))


def _posteriors(spark, d):
    return assess.posteriors(assess.oriented_link_lengths(_chrom_links(spark, d), _bed(spark, d)), -0.8)


def q_posterior(spark, d):
    rows = _posteriors(spark, d)
    return rows.select("seqid", "name", "n_links", r6(F.col("log_fwd")).alias("log_fwd"), r6(F.col("log_rev")).alias("log_rev"), r6(F.col("postprob")).alias("postprob"))


def q_coverage(spark, d):
    """Depth of alignments along each query."""
    rows = table(spark, d, "paf").filter("query_start < query_end").withColumn("q", F.btrim(F.col("query_name"), F.lit(" \t"))).filter("q is not null")
    return assess.coverage(rows.select("q", "query_start", "query_end"), "q", "query_start", "query_end").withColumnsRenamed({"q": "query_name", "at": "pos"})


def _nodes(spark, d):
    return graph.end_nodes(links(spark, d), known(spark, d), 50_000)


def q_graph_edges(spark, d):
    return graph.edges(_nodes(spark, d))


def q_confidence(spark, d):
    return graph.confidence(graph.edges(_nodes(spark, d))).select("a", "b", "weight", r6(F.col("confidence")).alias("confidence"))


def q_best_partners(spark, d):
    return graph.best_partners(graph.edges(_nodes(spark, d)))


def q_chains(spark, d):
    """Contigs joined end to end by their best partners."""
    return graph.chains(graph.best_partners(graph.edges(_nodes(spark, d))), known(spark, d))


def q_chain_order(spark, d):
    """Place and direction of each contig in its chain."""
    return graph.chain_order(graph.best_partners(graph.edges(_nodes(spark, d))), known(spark, d)).select("contig", "n_contigs", "pos", "orientation")


def _graph(spark, d):
    return pair_totals(spark, d).select("a", "b", F.col("n").alias("weight"))


def q_modularity(spark, d):
    """Modularity of the contact graph with haplotypes as parts."""
    g = _graph(spark, d)
    nodes = g.select(F.col("a").alias("node")).unionByName(g.select(F.col("b").alias("node"))).distinct()
    return graph.modularity(g, nodes.withColumn("part", F.substring("node", -1, 1))).select(r6(F.col("q")).alias("q"))


def q_best_moves(spark, d):
    """Contigs that would raise modularity in another haplotype than their own."""
    g = _graph(spark, d)
    nodes = g.select(F.col("a").alias("node")).unionByName(g.select(F.col("b").alias("node"))).distinct()
    return graph.best_moves(g, nodes.withColumn("part", F.substring("node", -1, 1))).select("node", "part", F.round("gain", 9).alias("gain"))


def q_label_propagation(spark, d):
    return graph.label_propagation(_graph(spark, d), 3)


def q_carry_forward(spark, d):
    """The last line of a file that begins with a contig's letters, up to each line."""
    rows = table(spark, d, "paf_raw").filter("src_file is not null and line_no is not null").groupBy("src_file", "line_no").agg(F.min("raw_line").alias("raw_line"))
    head = F.when(F.startswith("raw_line", F.lit("shr_")), F.split("raw_line", "\t")[0])
    return carry_forward(rows, head, ["src_file"], ["line_no"], "last_shared").select("src_file", "line_no", "last_shared")


def q_confusion(spark, d):
    """How well observed over expected links tells pairs labelled ok."""
    rows = pairs(spark, d).filter("label is not null and label <> '' and observedlinks is not null and expectedlinksifadjacent > 0")
    rows = rows.select((F.col("observedlinks") / F.col("expectedlinksifadjacent")).alias("s"), (F.col("label") == "ok").alias("t"))
    out = assess.confusion(rows, "s", "t", [0.5, 1.0, 1.5, 2.0, 3.0, 5.0])
    return out.select("threshold", "tp", "fp", "tn", "fn", r6(F.col("tpr")).alias("tpr"), r6(F.col("fpr")).alias("fpr"), r6(F.col("acc")).alias("acc"))


def q_pareto_alpha(spark, d):
    """Exponent of a Pareto law of the distances of each library."""
    rows = clm(spark, d).select("libname", F.explode("links").alias("d")).filter(F.col("d") >= C.MIN_LINK_DIST)
    return rows.groupBy("libname").agg(r6(E.pareto_alpha(F.col("d"), C.MIN_LINK_DIST)).alias("alpha"))


def q_laws(spark, d):
    """Densities of link lengths at the starts of the bins by five laws, as log10."""
    x, least, most, alpha = F.col("binstart"), 2048.0, 1e8, 0.15
    laws = {"pareto": E.pareto(x, alpha, least), "bounded": E.bounded_pareto(x, alpha, least, most), "reciprocal": E.reciprocal(x, least, most), "exponential": E.exponential(x, 1e-6), "ends": E.uniform_pareto(x, alpha, least, 1e5)}
    rows = table(spark, d, "distribution").filter("binstart is not null")
    return rows.select("bin", "binstart", *[F.when(v > 1e-300, r6(F.log10(v))).alias(k) for k, v in laws.items()])


def q_tags(spark, d):
    """Typed tags of the alignments."""
    t = lambda n: tag_value(F.col("tags"), n)
    rows = table(spark, d, "paf").filter("tags is not null")
    return rows.groupBy("paf_id").agg(F.max(t("cm")["i"]).alias("cm"), F.max(F.round(t("dv")["f"].cast("double"), 6)).alias("dv"), F.max(t("tp")["s"]).alias("tp"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q_")}
