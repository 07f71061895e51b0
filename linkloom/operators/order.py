"""Order and orientation of contigs along a group: scores, and searches that improve them.

A tour is (grp, pos, contig, size[, sign]); contacts are sparse rows (a, b, n) with a <> b, one
direction each. Scores start from the contacts, so no pair without links is ever made. Searches
change bounded segments, or single contigs that don't touch each other, in parallel.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import exprs as E
from ..session import cut
from .components import connected_components
from .ordered import group_medians, prefix_sum

#: Contigs of a segment that one task rearranges.
SEGMENT = 64
#: Pieces of which all orders are tried, 46,080 at most, instead of a search.
TRIED = 6
#: Pairs of a connected part whose strandedness matrix one task holds, or of a group that one task chains, and entries of a vector that count as 0.
HELD, ZERO = 500_000, 1e-9


def placed(tour: DataFrame) -> DataFrame:
    """The tour with cum (sizes before) and mid (middle of each contig)."""
    return prefix_sum(tour, ["grp"], "pos", F.col("size"), "cum").withColumn("mid", F.col("cum") + F.col("size") / E.double(2))


def _ends(contacts: DataFrame, tour: DataFrame, cols: list[str]) -> DataFrame:
    """Contacts whose two contigs are in one group, the earlier one as 1."""
    one = tour.select("grp", F.col("contig").alias("a"), F.col("pos").alias("pos_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    two = tour.select(F.col("grp").alias("_g"), F.col("contig").alias("b"), F.col("pos").alias("pos_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return contacts.join(one, "a").join(two, "b").filter("grp = _g and pos_a <> pos_b").drop("_g")


def link_distances(contacts: DataFrame, tour: DataFrame, limit: int = C.LIMIT) -> DataFrame:
    """grp, a, b, n, dist between middles, up to the limit."""
    rows = _ends(contacts, placed(tour), ["mid"]).withColumn("dist", F.abs(F.col("mid_b") - F.col("mid_a")))
    return rows.filter((F.col("dist") <= limit) & (F.col("dist") > 0))


def tour_score(contacts: DataFrame, tour: DataFrame) -> DataFrame:
    """grp, score: minus the sum of links over distance; lower is better."""
    return link_distances(contacts, tour).groupBy("grp").agg((-F.sum(F.col("n") / F.col("dist"))).alias("score"))


def tour_score_log(contacts: DataFrame, tour: DataFrame) -> DataFrame:
    """grp, score: sum of links times ln distance over the limit; lower is better."""
    return link_distances(contacts, tour).groupBy("grp").agg(F.sum(F.col("n") * (F.ln("dist") - F.ln(E.double(C.LIMIT)))).alias("score"))


def leave_one_out(contacts: DataFrame, tour: DataFrame, limit: int = C.LIMIT, block: int = 256) -> DataFrame:
    """grp, pos, contig, size, gain: how much of the sum of links over distance a group owes to each contig.

    Without a contig its own links are lost, and the links over it get shorter by its size, which may
    bring them under the limit; so the gain of a contig that only keeps others apart is negative. A
    contact meets the contigs it spans in blocks of places, whose contigs are expanded and summed
    within the task. Contigs without a contact have gain 0. `contacts` holds each pair once.
    """
    at = cut(placed(tour.select("grp", "pos", "contig", "size")))
    most = at.agg(F.max("size")).first()[0] or 0
    rows = _ends(contacts.select("a", "b", "n"), at, ["mid"]).select("grp", F.least("pos_a", "pos_b").alias("p"), F.greatest("pos_a", "pos_b").alias("q"), "n", F.abs(F.col("mid_b") - F.col("mid_a")).alias("dist"))
    part = lambda dist: F.when((dist > 0) & (dist <= limit), F.col("n") / dist).otherwise(E.double(0))
    rows = cut(rows.filter(F.col("dist") <= limit + most))
    own = rows.select("grp", F.explode(F.array("p", "q")).alias("pos"), part(F.col("dist")).alias("d"))
    blocks = at.groupBy("grp", F.floor(F.col("pos") / block).alias("_blk")).agg(F.collect_list(F.struct("pos", "size")).alias("_held"))
    over = rows.filter("q - p > 1").select("*", F.explode(F.sequence(F.floor((F.col("p") + 1) / block), F.floor((F.col("q") - 1) / block))).alias("_blk"))
    over = over.join(blocks, ["grp", "_blk"]).select("grp", "p", "q", "n", "dist", F.inline("_held")).filter("pos > p and pos < q")
    over = over.select("grp", "pos", (part(F.col("dist")) - part(F.col("dist") - F.col("size"))).alias("d"))
    total = own.unionByName(over).groupBy("grp", "pos").agg(F.sum("d").alias("gain"))
    return at.select("grp", "pos", "contig", "size").join(total, ["grp", "pos"], "left").fillna(0.0, ["gain"])


def prune_tour(contacts: DataFrame, tour: DataFrame, max_rounds: int = 100) -> DataFrame:
    """grp, pos, contig, size, log_gain: the tour without contigs that add far less than the others of their group, until none does.

    Far less is a log10 of the gain (-9 for 1e-9 and less) under the median of the group less 3.5 /
    0.67449 median deviations. Places are dense again after each round. Rounds that don't end are an
    error.
    """
    now, links = tour.select("grp", "pos", "contig", "size"), cut(contacts.select("a", "b", "n"))
    for _ in range(max_rounds):
        gain = leave_one_out(links, now).withColumn("log_gain", F.when(F.col("gain") > 1e-9, F.log10("gain")).otherwise(E.double(-9)))
        gain = cut(gain.drop("gain"))
        mid = cut(group_medians(gain, ["grp"], "log_gain").toDF("grp", "_m"))
        off = gain.join(mid, "grp").withColumn("_d", F.abs(F.col("log_gain") - F.col("_m")))
        low = mid.join(group_medians(off, ["grp"], "_d").toDF("grp", "_mad"), "grp").select("grp", (F.col("_m") - C.OUTLIER_THRESHOLD / C.MAD_SCALE * F.col("_mad")).alias("_low"))
        rows = cut(gain.join(low, "grp"))
        if not rows.filter("log_gain < _low").limit(1).count():
            return gain
        kept = rows.filter("log_gain >= _low").select("grp", F.col("pos").alias("_p"), "contig", "size")
        now = cut(prefix_sum(kept, ["grp"], "_p", F.lit(1), "pos").select("grp", F.col("pos").cast("long").alias("pos"), "contig", "size"))
    raise RuntimeError(f"contigs still go after {max_rounds} rounds")


def true_distances(contacts: DataFrame, tour: DataFrame, elsewhere: int = 100_000_000) -> DataFrame:
    """The contacts with true_dist: from the start of the earlier contig to the end of the later one, or `elsewhere` in two groups."""
    at = placed(tour).select("grp", "contig", F.col("cum").cast("long").alias("s"), (F.col("cum") + F.col("size")).cast("long").alias("e"))
    rows = contacts.join(at.toDF("_ga", "a", "_sa", "_ea"), "a").join(at.toDF("_gb", "b", "_sb", "_eb"), "b")
    span = F.when(F.col("_sa") <= F.col("_sb"), F.col("_eb") - F.col("_sa")).otherwise(F.col("_ea") - F.col("_sb"))
    return rows.withColumn("true_dist", F.when(F.col("_ga") == F.col("_gb"), span).otherwise(elsewhere)).drop("_ga", "_sa", "_ea", "_gb", "_sb", "_eb")


def split_weak(links: DataFrame, tour: DataFrame, share: tuple[int, int] = (1, 10), reach: int = C.LINK_DIST, samples: int = 1000) -> DataFrame:
    """grp, pos, contig, strength, piece: the tour in pieces that part where few links cross a join.

    `links` has a, b, apos, bpos; those that span less than `reach` count over the places between
    their ends. A join is weak if fewer cross it than the element at `share` of what crosses evenly
    spaced places; joins within `reach` of an end of the path always hold.
    """
    at = placed(tour).select("grp", "pos", "contig", "size", "sign", F.col("cum").cast("long").alias("cum"))
    one = at.select("grp", F.col("contig").alias("a"), *[F.col(c).alias(f"_{c}a") for c in ("cum", "size", "sign")])
    two = at.select(F.col("grp").alias("_g"), F.col("contig").alias("b"), *[F.col(c).alias(f"_{c}b") for c in ("cum", "size", "sign")])
    place = lambda k, p: E.path_position(F.col(f"_cum{k}"), F.col(f"_size{k}"), F.col(p), F.col(f"_sign{k}"))
    rows = links.filter("a <> b").join(one, "a").join(two, "b").filter("grp = _g").select("grp", place("a", "apos").alias("x"), place("b", "bpos").alias("y"))
    rows = rows.filter(F.abs(F.col("x") - F.col("y")) < reach)
    events = rows.select("grp", F.inline(F.array(F.struct(F.least("x", "y").alias("at"), F.lit(1).cast("long").alias("d")), F.struct(F.greatest("x", "y").alias("at"), F.lit(-1).cast("long").alias("d")))))
    total = at.groupBy("grp").agg(F.sum("size").alias("_len"))
    step = F.greatest(E.int_div(F.col("_len"), F.lit(samples)), F.lit(1))
    even = total.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_len") - 1, step)).alias("at"))
    joins = at.select("grp", F.col("cum").alias("at"))
    points = even.unionByName(joins).withColumn("d", F.lit(0).cast("long"))
    steps = events.unionByName(points).groupBy("grp", "at").agg(F.sum("d").alias("d"))
    crossed = cut(prefix_sum(steps, ["grp"], "at", F.col("d"), "strength", block=1 << 20).select("grp", "at", "strength"))
    # At most `samples` + 1 places a path.
    weak = even.join(crossed, ["grp", "at"]).groupBy("grp").agg(F.sort_array(F.collect_list("strength")).alias("_c")).select("grp", F.get("_c", E.int_div(F.size("_c") * share[0], F.lit(share[1])).cast("int")).alias("_weak"))
    own = at.join(crossed.withColumnRenamed("at", "cum"), ["grp", "cum"]).join(weak, "grp").join(total, "grp")
    parts = (F.col("cum") >= reach) & (F.col("cum") < F.col("_len") - reach) & (F.col("strength") < F.col("_weak"))
    flagged = own.withColumn("_new", parts.cast("long"))
    return prefix_sum(flagged, ["grp"], "pos", F.col("_new"), "_p").select("grp", "pos", "contig", "strength", (F.col("_p") + F.col("_new")).cast("long").alias("piece"))


def _oriented(hists: DataFrame, tour: DataFrame) -> DataFrame:
    """Histograms that fit the signs of the tour, in the direction of the tour, with the gap between.

    The gap leaves out the contig just before the later one, as scores are given on that scale.
    """
    at = placed(tour).withColumn("orientation", F.when(F.col("sign") < 0, "-").otherwise("+"))
    before = at.select("grp", (F.col("pos") + 1).alias("pos"), F.col("cum").alias("cum_before"))
    at = at.join(before, ["grp", "pos"], "left")
    rows = _ends(hists, at, ["cum", "cum_before", "orientation"])
    fwd = rows.filter("pos_a < pos_b and ao = orientation_a and bo = orientation_b")
    turned = rows.filter("pos_a > pos_b").filter((E.flip(F.col("bo")) == F.col("orientation_b")) & (E.flip(F.col("ao")) == F.col("orientation_a")))
    gap = lambda first, last: F.col(f"cum_before_{last}") - F.col(f"cum_{first}")
    cols = lambda first, last: ["grp", F.col(first).alias("x"), F.col(last).alias("y"), "bucket", "cnt", gap(first, last).alias("gap")]
    return fwd.select(*cols("a", "b")).unionByName(turned.select(*cols("b", "a"))).filter(F.col("gap") <= C.LIMIT)


def _radius() -> Column:
    radii = F.array(*[E.double(r) for r in C.golden_radii()])
    return F.get(radii, F.col("bucket") - C.LB)


def orientation_score(hists: DataFrame, tour: DataFrame) -> DataFrame:
    """grp, score: minus the sum of bucket counts times ln(radius + gap); higher is better.

    `hists` has a, b, ao, bo, bucket, cnt in one direction of each pair; the other is derived.
    """
    return _oriented(hists, tour).groupBy("grp").agg((-F.sum(F.col("cnt") * F.ln(_radius() + F.col("gap")))).alias("score"))


def leading_signs(strands: DataFrame, tour: DataFrame, held: int = HELD, max_rounds: int = 2000) -> DataFrame:
    """The tour with signs of the leading eigenvectors of the strandedness matrix (rows a, b, v, one direction).

    Connected parts of a group say nothing of each other, so each has its own vector, whose first
    contig gets +. Parts of up to `held` pairs are solved in a task each, larger ones by joins, both by
    Lanczos steps until the residual is 0 up to rounding, or an error after `max_rounds`.
    Entries below the precision of the vectors (and contigs without links) count as 0 and get +.
    """
    members = tour.select("grp", "contig").distinct()
    rows = strands.filter("v <> 0 and a <> b").join(members.withColumnsRenamed({"contig": "a"}), "a").join(members.withColumnsRenamed({"contig": "b", "grp": "_g"}), "b").filter("grp = _g")
    key = lambda c: F.concat_ws("\x1f", "grp", c)
    rows = cut(rows.select(key("a").alias("a"), key("b").alias("b"), F.col("v").cast("double").alias("v")))
    part = cut(connected_components(rows, F.col("a"), F.col("b")).toDF("node", "part"))
    rows = cut(rows.join(part.toDF("a", "part"), "a"))
    many = rows.groupBy("part").agg(F.count("*").alias("_n")).filter(F.col("_n") > held).select("part")
    # Parts of more than `held` pairs are few.
    large = [r[0] for r in many.collect()]
    is_large = F.col("part").isin(large) if large else F.lit(False)
    x = rows.filter(~is_large).groupBy("part").applyInPandas(_one_vector(max_rounds), "part string, node string, x double")
    if large:
        x = x.unionByName(_leading_vectors(rows.filter(is_large).select("a", "b", "v"), part.filter(is_large).select("part", "node"), max_rounds))
    x = cut(tour.withColumn("node", key("contig")).join(x, "node", "left"))
    first = x.filter("part is not null").groupBy("part").agg((F.min_by("x", "pos") < 0).alias("_turn"))
    sign = F.when((F.col("x") != 0) & ((F.col("x") < 0) != F.col("_turn")), -1).otherwise(1)
    return x.drop("sign").join(first, "part", "left").select("grp", "pos", "contig", "size", sign.alias("sign"))


def leading_vector(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray, max_rounds: int = 2000, most: int = 40, keep: int = 10) -> np.ndarray:
    """Leading eigenvector of a symmetric matrix of n rows with entries v at (i, j) and (j, i), by restarted Lanczos steps."""
    times = lambda x: np.bincount(i, v * x[j], n) + np.bincount(j, v * x[i], n)
    basis, image = np.zeros((0, n)), np.zeros((0, n))
    r = np.random.default_rng(1).random(n) - 0.5
    for _ in range(max_rounds):
        for _ in range(2):
            r = r / np.linalg.norm(r)
            r = r - basis.T @ (basis @ r)
        r = r / np.linalg.norm(r)
        basis, image = np.vstack([basis, r]), np.vstack([image, times(r)])
        value, s = np.linalg.eigh(basis @ image.T)
        x, r = s[:, -1] @ basis, s[:, -1] @ image - value[-1] * (s[:, -1] @ basis)
        if np.linalg.norm(r) <= 1e-11 * abs(value[-1]):
            return x
        if len(basis) >= most:
            basis, image = s[:, -keep:].T @ basis, s[:, -keep:].T @ image
    raise RuntimeError(f"the eigenvector of a part of {n} contigs hasn't settled after {max_rounds} rounds")


def _one_vector(max_rounds: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.r_[rows["a"].to_numpy(str), rows["b"].to_numpy(str)], return_inverse=True)
        x = leading_vector(len(names), *at.reshape(2, -1), rows["v"].to_numpy(), max_rounds)
        return pd.DataFrame({"part": rows["part"].iloc[0], "node": names, "x": np.where(np.abs(x) > ZERO, x, 0.0)})

    return run


def _leading_vectors(rows: DataFrame, part: DataFrame, max_rounds: int, most: int = 24, keep: int = 8) -> DataFrame:
    """part, node, x: the leading eigenvector of each part of a symmetric matrix (rows a, b, v, one direction).

    Restarted Lanczos: a round multiplies the residual of the best vector so far by the matrix (a
    join) and adds it to the basis, an array in each row; only the dot products of the basis, a small
    matrix for each part, come to the driver. Ends when every residual is 0 up to rounding.
    """
    spark = part.sparkSession
    done = spark.createDataFrame([], "part string, node string, x double")
    both = cut(rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")))
    # A start that no eigenvector is likely to be orthogonal to.
    r = (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) + 0.5) / (1 << 20) - 0.5
    empty = F.array().cast("array<double>")
    basis = part.select("part", "node", empty.alias("v"), empty.alias("av"), r.alias("r"))
    dot = lambda c, x: F.aggregate(F.zip_with(x, c, lambda s, t: s * t), E.double(0), lambda s, t: s + t)
    scales: dict[str, float] = {}
    for _ in range(max_rounds):
        times = both.join(basis.select(F.col("node").alias("b"), "r"), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("v") * F.col("r")).alias("ar"))
        basis = cut(basis.join(times, "node").select("part", "node", F.array_append("v", F.col("r")).alias("v"), F.array_append("av", F.col("ar")).alias("av")))
        grams: dict[str, np.ndarray] = {}
        for p, g in basis.mapInPandas(_grams, "part string, g array<double>").collect():
            grams[p] = grams.get(p, 0) + np.array(g)
        if not grams:
            return done
        coefs, ready = [], []
        for p, g in grams.items():
            g = g.reshape((round(len(g) ** 0.5),) * 2)
            k = len(g) // 2
            best = _ritz(g[:k, :k], (g[:k, k:] + g[k:, :k]) / 2)
            if p in scales and g[k - 1, k - 1] ** 0.5 * scales[p] <= 1e-11 * best[0][0]:
                # The residual that came last is nothing but rounding, so the vector before it stands.
                k, g = k - 1, np.delete(np.delete(g, (k - 1, 2 * k - 1), 0), (k - 1, 2 * k - 1), 1)
                best = _ritz(g[:k, :k], (g[:k, k:] + g[k:, :k]) / 2)
                ready.append((p, [*best[1][:, 0].tolist(), 0.0]))
                continue
            theta, s = best[0][0], best[1][:, 0]
            c = np.r_[-theta * s, s]
            scales[p] = max(float(max(c @ g @ c, 0)) ** 0.5, 1e-12 * abs(theta), 1e-300)
            held = best[1][:, :keep].T if k >= most else np.eye(k)
            coefs.append((p, (-theta * s / scales[p]).tolist(), (s / scales[p]).tolist(), held.tolist()))
        if ready:
            found = basis.join(F.broadcast(spark.createDataFrame(ready, "part string, c array<double>")), "part").select("part", "node", dot(F.col("c"), F.col("v")).alias("x"))
            done = cut(done.unionByName(found.withColumn("x", F.when(F.abs("x") > ZERO, F.col("x")).otherwise(E.double(0)))))
        if not coefs:
            return done
        b = basis.join(F.broadcast(spark.createDataFrame(coefs, "part string, cv array<double>, ca array<double>, held array<array<double>>")), "part")
        turned = lambda c: F.transform("held", lambda h: dot(h, F.col(c)))
        basis = b.select("part", "node", turned("v").alias("v"), turned("av").alias("av"), (dot(F.col("cv"), F.col("v")) + dot(F.col("ca"), F.col("av"))).alias("r"))
    raise RuntimeError(f"eigenvectors of {len(coefs)} parts haven't settled after {max_rounds} rounds")


def _ritz(gram: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, the largest first, and their vectors of length 1, of a form on a basis with these dot products."""
    d = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    e, u = np.linalg.eigh(gram * np.outer(d, d))
    # Directions that are rounding alone are left out.
    use = e > 1e-10
    w = d[:, None] * u[:, use] / np.sqrt(e[use])
    value, s = np.linalg.eigh(w.T @ form @ w)
    return value[::-1], (w @ s)[:, ::-1]


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dot products of all basis vectors and their images, of the rows of each part that are met."""
    total: dict[str, np.ndarray] = {}
    for rows in batches:
        for p, some in rows.groupby("part"):
            m = np.c_[np.stack(some["v"].to_list()), np.stack(some["av"].to_list())]
            total[p] = total.get(p, 0) + m.T @ m
    yield pd.DataFrame({"part": list(total), "g": [g.ravel() for g in total.values()]})


def improve_signs(hists: DataFrame, tour: DataFrame) -> DataFrame:
    """Flip whole groups and single contigs while that improves the orientation score.

    The gain of each flip is computed from the contigs it shares histograms with; contigs flip that
    gain more than all of these, so that gains add up. Ends when no group and no contig gains by a
    flip; as every flip raises the score, that point is reached.
    """
    signs = cut(tour.select("grp", "pos", "contig", "size", "sign"))
    pairs = cut(_pair_scores(hists, signs))
    near = pairs.select("x", "y").distinct()
    near = cut(near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    turned = True
    while True:
        whole = cut(_fitting(pairs, signs).groupBy("grp").agg(F.sum(_change(-1, -1)).alias("gain")).filter("gain > 1e-9").select("grp", F.lit(-1).alias("_f")))
        if whole.limit(1).count():
            signs, turned = cut(_flipped(signs, whole, "grp")), True
        if not turned:
            return signs
        turned = False
        while True:
            rows = _fitting(pairs, signs)
            gain = rows.select(F.explode(F.array(F.struct(F.col("x").alias("contig"), _change(-1, 1).alias("d")), F.struct(F.col("y").alias("contig"), _change(1, -1).alias("d")))).alias("e"))
            gain = cut(gain.groupBy("e.contig").agg(F.sum("e.d").alias("gain")).filter("gain > 1e-9"))
            if not gain.limit(1).count():
                break
            rank = lambda c: F.struct(F.col("gain"), F.col(c))
            rivals = near.join(gain.withColumnRenamed("contig", "y"), "y").groupBy(F.col("x").alias("contig")).agg(F.max(rank("y")).alias("_r"))
            flips = gain.join(rivals, "contig", "left").filter(F.col("_r").isNull() | (rank("contig") > F.struct(F.col("_r.gain").alias("gain"), F.col("_r.y").alias("contig")))).select("contig", F.lit(-1).alias("_f"))
            signs, turned = cut(_flipped(signs, flips, "contig")), True


def _flipped(signs: DataFrame, flips: DataFrame, by: str) -> DataFrame:
    return signs.join(flips, by, "left").select("grp", "pos", "contig", "size", (F.col("sign") * F.coalesce("_f", F.lit(1))).alias("sign"))


def _fitting(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Pair scores with the signs of their contigs now, sx and sy."""
    one = signs.select("grp", F.col("contig").alias("x"), F.col("sign").alias("sx"))
    return pairs.join(one, ["grp", "x"]).join(one.toDF("grp", "y", "sy"), ["grp", "y"])


def _change(fx: int, fy: int) -> Column:
    """What a row adds to the score if the signs are multiplied by these, less what it adds now."""
    fits = lambda kx, ky: ((F.col("sx") * kx == F.col("ox")) & (F.col("sy") * ky == F.col("oy"))).cast("double")
    return F.col("s") * (fits(fx, fy) - fits(1, 1))


def _pair_scores(hists: DataFrame, tour: DataFrame) -> DataFrame:
    """grp, x, y, ox, oy, s: what each pair adds to the score with these signs of its earlier (x) and later (y) contig."""
    at = placed(tour)
    before = at.select("grp", (F.col("pos") + 1).alias("pos"), F.col("cum").alias("cum_before"))
    at = at.join(before, ["grp", "pos"], "left").select("grp", "pos", "contig", "cum", "cum_before")
    rows = _ends(hists, at, ["cum", "cum_before"])
    ahead = F.col("pos_a") < F.col("pos_b")
    ox = F.when(ahead, F.col("ao")).otherwise(E.flip(F.col("bo")))
    oy = F.when(ahead, F.col("bo")).otherwise(E.flip(F.col("ao")))
    number = lambda o: F.when(o == "-", -1).otherwise(1)
    gap = F.when(ahead, F.col("cum_before_b") - F.col("cum_a")).otherwise(F.col("cum_before_a") - F.col("cum_b"))
    x, y = F.when(ahead, F.col("a")).otherwise(F.col("b")), F.when(ahead, F.col("b")).otherwise(F.col("a"))
    kept = rows.withColumn("gap", gap).filter(F.col("gap") <= C.LIMIT)
    return kept.groupBy("grp", x.alias("x"), y.alias("y"), number(ox).alias("ox"), number(oy).alias("oy")).agg((-F.sum(F.col("cnt") * F.ln(_radius() + F.col("gap")))).alias("s"))


def segment_scores(orders: np.ndarray, size: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Scores of small orders, a row each: numbers of pieces, with len(size) added where a piece is turned round.

    Links have columns a, b (pieces), n, and how far into either piece they lie.
    """
    k = len(size)
    which, (a, b) = orders % k, links[:, :2].astype(int).T
    start, turned = np.empty(orders.shape), np.empty(orders.shape, bool)
    np.put_along_axis(start, which, np.cumsum(size[which], 1) - size[which], 1)
    np.put_along_axis(turned, which, orders >= k, 1)
    at = lambda p, off: start[:, p] + np.where(turned[:, p], size[p] - off, off)
    dist = np.abs(at(a, links[:, 3]) - at(b, links[:, 4]))
    return -np.where((dist > 0) & (dist <= C.LIMIT), links[:, 2] / np.maximum(dist, 1e-9), 0).sum(1)


def moved(orders: np.ndarray, kind: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Orders after one move each, i <= j: 0 two places swapped, 1 the tail from j put in front, 2 piece j put before i, 3 the stretch i..j turned over, 4 that with each of its pieces turned round."""
    t, i, j, kind = np.arange(k)[None, :], i[:, None], j[:, None], kind[:, None]
    inside = (t >= i) & (t <= j)
    swap = np.where(t == i, j, np.where(t == j, i, t))
    put = np.where(t == i, j, np.where((t > i) & (t <= j), t - 1, t))
    over = np.where(inside, i + j - t, t)
    out = np.take_along_axis(orders, np.where(kind == 0, swap, np.where(kind == 1, (t + j) % k, np.where(kind == 2, put, over))), 1)
    return np.where((kind == 4) & inside, (out + k) % (2 * k), out)


def descend(order: np.ndarray, size: np.ndarray, links: np.ndarray, some: int = 512) -> np.ndarray:
    """All moves are tried in a fixed mixed order, `some` at a time, and the best of these is made if it gains; ends when no move at all does."""
    k = len(size)
    i, j = np.triu_indices(k)
    kind = np.repeat(np.arange(5), len(i))
    i, j = np.tile(i, 5), np.tile(j, 5)
    use = np.flatnonzero((i < j) | (kind == 4))
    use = np.random.default_rng(0).permutation(use)
    parts = np.array_split(use, -(-len(use) // some)) if len(use) else []
    now, at, idle = segment_scores(order[None, :], size, links)[0], 0, 0
    while idle < len(parts):
        m = parts[at % len(parts)]
        new = moved(np.broadcast_to(order, (len(m), k)), kind[m], i[m], j[m], k)
        score = segment_scores(new, size, links)
        b = int(np.argmin(score))
        at, idle = at + 1, idle + 1
        if score[b] < now - 1e-12 * abs(now):
            order, now, idle = new[b], score[b], 0
    return order


def best_of_all(size: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The best of all orders and turns of a few pieces; the given order if none gains."""
    k = len(size)
    orders = np.array(list(itertools.permutations(range(k))))
    turns = np.array(list(itertools.product((0, k), repeat=k)))
    every = (orders[:, None, :] + turns[None, :, :]).reshape(-1, k)
    score = segment_scores(every, size, links)
    m = int(np.argmin(score))
    return every[m if score[m] < score[0] - 1e-12 * abs(score[0]) else 0]


def search(size: np.ndarray, links: np.ndarray, seed: int, people: int, stale: int, rate: float = C.MUTA_PROB) -> np.ndarray:
    """A genetic search by mutation alone, from the order that no single move betters: tournaments of three, the best one stays; ends after `stale` turns without gain. Of up to TRIED pieces all orders are tried."""
    rng, k = np.random.default_rng(seed), len(size)
    if k <= TRIED:
        return best_of_all(size, links)
    at = descend(np.arange(k), size, links)
    pool = np.tile(at, (people, 1))
    score = segment_scores(pool, size, links)
    best, idle = score[0], 0
    while idle < stale:
        picks = rng.integers(0, people, (people, 3))
        take = picks[np.arange(people), score[picks].argmin(1)]
        pool, score = pool[take], score[take]
        some = np.flatnonzero(rng.random(people) < rate)
        ends = np.sort(rng.integers(0, k, (len(some), 2)), 1)
        # Swaps 14 %, tails 14 %, single pieces 21 %, stretches 21 %, turned stretches 30 %.
        kind = np.searchsorted([0.14, 0.28, 0.49, 0.7], rng.random(len(some)), side="right")
        pool[some] = moved(pool[some], kind, ends[:, 0], ends[:, 1], k)
        score[some] = segment_scores(pool[some], size, links)
        pool[0], score[0] = at, best
        m = int(np.argmin(score))
        gains = score[m] < best - 1e-12 * abs(best)
        idle = 0 if gains else idle + 1
        if gains:
            at = descend(pool[m].copy(), size, links)
            pool[m], score[m] = at, segment_scores(at[None, :], size, links)[0]
            best = score[m]
    return at


def chained(size: np.ndarray, links: np.ndarray) -> np.ndarray:
    """An order that has linked contigs side by side; links have columns a, b (contigs by place), n.

    The two ends of pieces meet whose links weigh most over their distances then, each end once and no
    circle; what is joined is a piece, until no link leaves a piece. Pieces follow in the order of
    their mean places, contigs without links in theirs.
    """
    k, size = len(size), size.astype(float)
    (a, b), n = links[:, :2].astype(int).T, links[:, 2]
    # Pieces get new numbers when they are joined; `of` and `off` are a contig's piece and its middle in it.
    pieces, length = {c: np.array([c]) for c in np.unique(np.r_[a, b]).tolist()}, size.tolist()
    of, off = np.arange(k), size / 2
    while (use := of[a] != of[b]).any():
        a, b, n = a[use], b[use], n[use]
        turn = of[a] > of[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        long = np.array(length)
        code, at = np.unique(of[a] * len(long) + of[b], return_inverse=True)
        # How far the links lie from the left and right ends of their pieces.
        x, y = (off[a], long[of[a]] - off[a]), (off[b], long[of[b]] - off[b])
        value = np.stack([np.bincount(at, n / np.maximum(x[i] + y[j], 1e-9), len(code)) for i in (0, 1) for j in (0, 1)], 1).ravel()
        met: dict[tuple[int, int], tuple[int, int]] = {}
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (u := root.setdefault(v, v)) != v:  # noqa: B023
                root[v] = v = root.setdefault(u, u)  # noqa: B023
            return v

        ranked = np.argsort(-value, kind="stable")
        for p, q, e in zip((code[ranked // 4] // len(long)).tolist(), (code[ranked // 4] % len(long)).tolist(), (ranked % 4).tolist(), strict=True):
            one, two = (p, e // 2), (q, e % 2)
            if one not in met and two not in met and (u := find(p)) != (v := find(q)):
                met[one], met[two], root[u] = two, one, v
        done: set[int] = set()
        for p, end in list(met):
            if p in done or (p, 1 - end) in met:
                continue
            row, leave = [], end
            while True:
                done.add(p)
                held = pieces.pop(p)
                row.append(held if leave else held[::-1])
                if (p, leave) not in met:
                    break
                p, enter = met[p, leave]
                leave = 1 - enter
            row = np.concatenate(row)
            upto = np.cumsum(size[row])
            of[row], off[row] = len(length), upto - size[row] / 2
            pieces[len(length)] = row
            length.append(upto[-1])
    rows = sorted(pieces.values(), key=lambda r: r.mean())
    return np.concatenate([*rows, np.setdiff1d(np.arange(k), np.concatenate(rows))]) if rows else np.arange(k)


def _chains(tour: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """The tour of one group in the order of `chained`."""
    tour = tour.sort_values("pos", ignore_index=True)
    return tour.iloc[chained(tour["size"].to_numpy(), links[["pos_a", "pos_b", "n"]].to_numpy(float))].assign(pos=np.arange(len(tour)))


def improve_order(contacts: DataFrame, tour: DataFrame, segment: int = SEGMENT, people: int = C.NPOP, stale: int = C.NGEN, seed: int = C.SEED) -> DataFrame:
    """The tour with a score not worse than before.

    A group of up to HELD contacts begins with its contigs chained by these, if its score gets better,
    as contigs that lie far from those they are linked to would else move by a segment a turn.
    Each group is then cut into segments, which are rearranged by a genetic search in parallel; in the
    next turn the cuts lie half a segment further. Then whole segments are the pieces that change
    place or turn round, and so on with longer ones, until one stretch holds the whole group; links
    of longer pieces count at the mean of their places. A turn counts for a group only if the score
    of the whole group gets better. Ends when no group got better since all of these were last tried.
    A stretch that a search left as it was isn't searched again until it changes.

    `stale` is the patience of a group in turns without gain, as if one search went over all of it. Its
    stretches have it by their shares of the group's pieces, so that a contig is tried as often in a
    long group as in a short one cut into as many searches; whatever the share, a search only begins
    and ends where no single move gains.
    """
    now = cut(tour.select("grp", "pos", "contig", "size"))
    links = cut(contacts.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n")))
    longest = now.agg(F.max(F.col("pos") + 1)).first()[0] or 0
    kinds = [(1, 0), (1, 1)]
    while kinds[-1][0] * segment < longest:
        kinds += [(kinds[-1][0] * segment, k) for k in (0, 1)]
    # The last uncut stretches hold whole groups, so cutting these elsewhere only leaves something out.
    kinds.pop()
    old_s = cut(tour_score(links, now))
    near = cut(_ends(links, now, []).select("grp", "pos_a", "pos_b", "n"))
    held = near.groupBy("grp").agg(F.count("*").alias("_n")).filter(F.col("_n") <= HELD).select("grp")
    begun = cut(now.join(held, "grp", "left_semi").groupBy("grp").cogroup(near.join(held, "grp", "left_semi").groupBy("grp")).applyInPandas(_chains, now.schema))
    now, old_s, _ = _better(links, now, old_s, begun)
    schema = T.StructType([now.schema["grp"], *T.StructType.fromDDL("unit long, first long, start long, len long, turned boolean").fields])
    settled = now.sparkSession.createDataFrame([], "_sig long")
    # The rows are few and the searches long: by their bytes they would be put into one task.
    tasks = 4 * now.sparkSession.sparkContext.defaultParallelism
    turn = idle = 0
    while idle < len(kinds):
        piece, half = kinds[turn % len(kinds)]
        unit = F.floor(F.col("pos") / piece).cast("long")
        parts = placed(now).withColumn("unit", unit).withColumn("seg", F.floor((unit + half * (segment // 2)) / segment).cast("long"))
        units = parts.groupBy("grp", "seg", "unit").agg(F.sum("size").alias("size"), F.count("*").alias("len"), F.min("pos").alias("pos"), F.min("cum").alias("at"))
        # Numbers of pieces follow from the places, which are dense.
        whole = now.groupBy("grp").agg((F.floor(F.max("pos") / piece) + 1).cast("long").alias("n_units"))
        parts = cut(parts.join(units.select("grp", "unit", "at"), ["grp", "unit"]).withColumn("off", F.col("mid") - F.col("at")))
        # Contacts within a segment, gathered at the first of their pieces.
        ends = _ends(links, parts, ["seg", "unit", "off"]).filter("seg_a = seg_b and unit_a <> unit_b")
        first = F.col("unit_a") < F.col("unit_b")
        pick = lambda c, d: F.when(first, F.col(c)).otherwise(F.col(d))
        ends = ends.select("grp", pick("unit_a", "unit_b").alias("unit"), pick("unit_b", "unit_a").alias("other"), "n", pick("off_a", "off_b").alias("o"), pick("off_b", "off_a").alias("p"))
        mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
        ends = ends.groupBy("grp", "unit", "other").agg(F.sum("n").cast("double").alias("n"), mean("o"), mean("p"))
        ends = ends.groupBy("grp", "unit").agg(F.collect_list(F.array(F.col("other").cast("double"), "n", "o", "p")).alias("links"))
        # All that the search of a stretch depends on: its contigs, their places and the kind of pieces.
        sig = parts.groupBy("grp", "seg").agg(F.bit_xor(F.xxhash64(F.lit(piece), F.lit(half), "grp", "pos", "contig")).alias("_sig"))
        asked = cut(sig.join(settled, "_sig", "left_anti"))
        if not (n := asked.count()):
            turn, idle = turn + 1, idle + 1
            continue
        found = units.join(asked.select("grp", "seg"), ["grp", "seg"]).join(whole, "grp").join(ends, ["grp", "unit"], "left").repartition(min(4 * n, tasks), "grp", "seg").groupBy("grp", "seg").applyInPandas(_rearrange(seed + turn, people, stale), schema)
        inside = F.col("pos") - F.col("first")
        place = F.coalesce(F.col("start") + F.when(F.col("turned"), F.col("len") - 1 - inside).otherwise(inside), F.col("pos"))
        new = cut(parts.join(found, ["grp", "unit"], "left").select("grp", place.alias("pos"), "contig", "size", "seg", (place != F.col("pos")).alias("_moved")))
        stay = new.groupBy("grp", "seg").agg(F.bool_or("_moved").alias("_m")).filter("not _m").select("grp", "seg")
        settled = cut(settled.unionByName(asked.join(stay, ["grp", "seg"]).select("_sig")))
        new = new.select("grp", "pos", "contig", "size")
        now, old_s, better = _better(links, now, old_s, new)
        turn, idle = turn + 1, 0 if better else idle + 1
    return now


def _better(links: DataFrame, now: DataFrame, old_s: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The tour with the new order of groups whose score gets better, the scores, and whether there are such groups."""
    new_s = cut(tour_score(links, new).withColumnRenamed("score", "_new"))
    # Gains that rounding alone could make don't count.
    better = cut(old_s.join(new_s, "grp", "right").filter("_new < coalesce(score, 0D) - 1e-12 * abs(coalesce(score, 0D))").select("grp", "_new"))
    if not better.limit(1).count():
        return now, old_s, False
    now = cut(new.join(better, "grp", "left_semi").unionByName(now.join(better, "grp", "left_anti")))
    scores = better.select("grp", F.col("_new").alias("score"))
    return now, cut(scores.unionByName(old_s.join(better, "grp", "left_anti").select("grp", "score"))), True


def _rearrange(seed: int, people: int, stale: int):
    """Where each piece of a segment starts, and whether it is turned round."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit", ignore_index=True)
        place, k = {u: i for i, u in enumerate(rows["unit"])}, len(rows)
        links = sorted((i, place[int(l[0])], *l[1:]) for i, some in enumerate(rows["links"]) if some is not None for l in some)
        order = search(rows["size"].to_numpy(float), np.array(links), seed + int(rows["pos"].iloc[0]), people, -(-stale * k // int(rows["n_units"].iloc[0]))) if links else np.arange(k)
        which, length = order % k, rows["len"].to_numpy()
        start, turned = np.empty(k, np.int64), np.empty(k, bool)
        start[which] = rows["pos"].iloc[0] + np.cumsum(length[which]) - length[which]
        turned[which] = order >= k
        return pd.DataFrame({"grp": rows["grp"], "unit": rows["unit"], "first": rows["pos"], "start": start, "len": length, "turned": turned})

    return run
