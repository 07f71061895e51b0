"""Groups of records that are linked directly or indirectly, by randomised contraction.

In every round each vertex hooks to the neighbour (or itself) that comes first in a fresh hash
order, edges are relabelled and deduplicated, and what remains is contracted again. The mappings of
the rounds are then expanded backwards. The edges shrink by a constant factor a round, whatever the
length of chains or the size of hubs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key with at least this share of the rows is looked up by broadcast; there are at most 1 / SHARE.
SHARE = 1 / 500
#: Below so many rows of a key it isn't worth the detour.
LEAST = 50_000


def _lookup(left: DataFrame, key: str, right: DataFrame, right_key: str, hot: list[str], how: str = "inner") -> DataFrame:
    """Join with a right side that has each key once; the rows of `hot` keys, which are many on the left, meet theirs by broadcast."""
    right = right.withColumnRenamed(right_key, key)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how).unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, how))


def _hot(n: int, key: str, often: DataFrame) -> list[str]:
    """Keys with more than a share of n rows, by their counts; at most 1 / SHARE."""
    floor = max(LEAST, int(n * SHARE))
    return [r[0] for r in often.filter(F.col("_often") >= floor).select(key).collect()] if n >= floor else []


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(df: DataFrame, left: Column, right: Column, max_rounds: int = 100) -> DataFrame:
    """(seqname, groupname): each linked name with the bytewise smallest name of its group.

    Rows with a null on either side, and rows that link a name with itself, link nothing and bring
    in no name. Repeated rows change nothing; other columns are ignored; an empty table gives no
    rows.
    """
    edges = cut(_undirected(df.select(left.cast("string").alias("a"), right.cast("string").alias("b")).filter("a is not null and b is not null")))
    maps: list[tuple[DataFrame, int]] = []
    for r in range(max_rounds):
        order = lambda c: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min(order("b")).alias("_m"), F.count("*").alias("_often"))
        hooked = cut(hooked.select(F.col("a").alias("v"), F.least("_m", order("a"))["v"].alias("rep"), "_often"))
        # Every edge has two ends.
        vertices, ends, most = hooked.agg(F.count("*"), F.sum("_often"), F.max("_often")).first()
        if not vertices:
            break
        maps.append((hooked.select("v", "rep"), vertices))
        hot = _hot(ends // 2, "v", hooked) if most >= LEAST else []
        once = _lookup(edges, "a", hooked.select("v", F.col("rep").alias("ra")), "v", hot)
        twice = _lookup(once.select("ra", "b"), "b", hooked.select("v", F.col("rep").alias("rb")), "v", hot)
        edges = cut(_undirected(twice.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    else:
        raise RuntimeError(f"edges remain after {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("seqname"), F.col("b").alias("groupname"))
    label = maps[-1][0].select("v", F.col("rep").alias("root"))
    for m, n in reversed(maps[:-1]):
        # Half of a giant group's vertices may share one representative.
        hot = _hot(n, "rep", m.groupBy("rep").agg(F.count("*").alias("_often"))) if n >= LEAST else []
        # A representative without edges left was its group's last vertex.
        label = cut(_lookup(m, "rep", label, "v", hot, "left").select("v", F.coalesce("root", "rep").alias("root")))
    groups = label.groupBy("root").agg(F.min("v").alias("groupname"), F.count("*").alias("_often"))
    n = maps[0][1]
    named = _lookup(label, "root", groups.select("root", "groupname"), "root", _hot(n, "root", groups) if n >= LEAST else [])
    return named.select(F.col("v").alias("seqname"), "groupname")
