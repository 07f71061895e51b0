"""Overlapping and gapped ranges per entity.

The mergeable state is a sorted list of disjoint ranges of one entity within one tile of the
coordinate. Partial lists are made in every input partition, combined by merging in a reduction
tree, and only the first and last range of each tile are compared across tiles; so an entity with
a large share of all rows is merged by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Least width of a tile, and the most tiles that the whole coordinate is cut into.
TILE, MAX_TILES = 1 << 20, 4096
#: Partial lists that one task merges for an entity and tile; more are merged in another level.
FAN_IN = 64
#: Ranges held at once by a task while it merges.
FLUSH = 1 << 20

LISTS = "_name string, _tile long, _part int, starts array<long>, ends array<long>"
PIECES = "_name string, _tile long, kind string, span_from long, span_to long"


def _disjoint(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge ranges that overlap or touch, for each code; sorted by code and start."""
    order = np.lexsort((start, code))
    code, start, end = code[order], start[order], end[order]
    new = np.ones(len(code), bool)
    if len(code) > 1:
        # Running maximum of the end within a code: shift each code's values above all earlier ones.
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        lowest = end.min()
        rank = np.unique(end, return_inverse=True)[1].astype(np.int64)
        width = int(rank.max()) + 1
        group = np.zeros(len(code), np.int64)
        group[first[1:]] = 1
        group = np.cumsum(group)
        top = np.maximum.accumulate(group * width + rank) - group * width
        ends = np.empty(width, np.int64)
        ends[rank] = end
        reach = ends[top]
        new[1:] = (code[1:] != code[:-1]) | (start[1:] > reach[:-1])
        del lowest
    else:
        reach = end
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(code)] - 1
    return code[at], start[at], reach[last] if len(at) else end[:0]


def _tiles(code: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Cut ranges at the edges of tiles."""
    a, b = start // width, (end - 1) // width
    n = b - a + 1
    row = np.repeat(np.arange(len(code)), n)
    tile = np.repeat(a, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return code[row], tile, np.maximum(start[row], tile * width), np.minimum(end[row], (tile + 1) * width)


def _as_lists(names: pa.Array, code: np.ndarray, tile: np.ndarray, start: np.ndarray, end: np.ndarray, part: int) -> pa.RecordBatch:
    at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tile[1:] != tile[:-1])]) if len(code) else np.zeros(0, int)
    offsets = pa.array(np.r_[at, len(code)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(code[at])), pa.array(tile[at], pa.int64()), pa.array(np.full(len(at), part), pa.int32()),
         pa.ListArray.from_arrays(offsets, pa.array(start, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(end, pa.int64()))],
        ["_name", "_tile", "_part", "starts", "ends"],
    )


def _first_level(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            names = rows.column("_name").combine_chunks().dictionary_encode()
            names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
            code, start, end = _disjoint(names.indices.to_numpy().astype(np.int64), rows.column("_s").to_numpy(), rows.column("_e").to_numpy())
            code, tile, start, end = _tiles(code, start, end, width)
            return _as_lists(names.dictionary, code, tile, start, end, part)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= FLUSH:
                yield flush()
                held = []
        if held:
            yield flush()

    return run


def _merge(emit_pieces: bool, width: int, fan_in: int):
    """Merge the lists of each entity and tile; input sorted by both, so groups end in order."""

    def merged(rows: pa.Table) -> pa.RecordBatch:
        names = rows.column("_name").combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        code, tile = names.indices.to_numpy().astype(np.int64), rows.column("_tile").to_numpy()
        part = int(rows.column("_part")[0].as_py()) // fan_in if not emit_pieces else 0
        starts, ends = rows.column("starts").combine_chunks(), rows.column("ends").combine_chunks()
        n = np.diff(starts.offsets.to_numpy())
        # One number for entity and tile keeps the merge one sort; tiles are dense ranks.
        levels, rank = np.unique(tile, return_inverse=True)
        both = np.repeat(code * len(levels) + rank, n)
        both, start, end = _disjoint(both, starts.flatten().to_numpy(), ends.flatten().to_numpy())
        code, tile = both // len(levels), levels[both % len(levels)]
        if not emit_pieces:
            return _as_lists(names.dictionary, code, tile, start, end, part)
        same = (code[1:] == code[:-1]) & (tile[1:] == tile[:-1])
        edge = ~(np.r_[False, same] & np.r_[same, False])
        gap = np.flatnonzero(same)
        kind = np.r_[np.where(edge, "edge", "period"), np.full(len(gap), "gap")].astype(object)
        row = np.r_[np.arange(len(code)), gap]
        return pa.RecordBatch.from_arrays(
            [names.dictionary.take(pa.array(code[row])), pa.array(tile[row], pa.int64()), pa.array(kind, pa.string()),
             pa.array(np.r_[start, end[gap]], pa.int64()), pa.array(np.r_[end, start[gap + 1]], pa.int64())],
            ["_name", "_tile", "kind", "span_from", "span_to"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if pa.compute.sum(pa.compute.list_value_length(held.column("starts"))).as_py() < FLUSH:
                continue
            # All groups but the last are whole.
            last_n, last_t = held.column("_name")[-1].as_py(), held.column("_tile")[-1].as_py()
            tail = pa.compute.and_(pa.compute.equal(held.column("_name"), last_n), pa.compute.equal(held.column("_tile"), last_t))
            whole = held.filter(pa.compute.invert(tail))
            if whole.num_rows:
                yield merged(whole)
                held = held.filter(tail)
        if held is not None and held.num_rows:
            yield merged(held)

    return run


def tile_width(ranges: DataFrame, least: int = TILE) -> int:
    """A power of two by which the whole coordinate has at most MAX_TILES tiles."""
    lo, hi = ranges.agg(F.min("_s"), F.max("_e")).first()
    width = least
    while lo is not None and (hi - lo) // width >= MAX_TILES:
        width *= 2
    return width


def merge_intervals(df: DataFrame, name: Column, start: Column, end: Column, fan_in: int = FAN_IN, tile: int = TILE) -> DataFrame:
    """(name, kind, span_from, span_to): continuous covered periods and the gaps between them.

    Ranges are half-open; those that overlap or touch form one period. Rows with a null name, start
    or end, or with start >= end, are left out. Repeated rows change nothing. An empty table gives
    no rows; other columns are ignored.
    """
    ranges = df.select(name.cast("string").alias("_name"), start.cast("long").alias("_s"), end.cast("long").alias("_e")).filter("_name is not null and _s < _e")
    width = tile_width(ranges, tile)
    lists = ranges.mapInArrow(_first_level(width), LISTS)
    parts = ranges.rdd.getNumPartitions()
    while parts > fan_in:
        by = [F.col("_name"), F.col("_tile"), F.floor(F.col("_part") / fan_in).cast("int").alias("_up")]
        lists = lists.select("*", by[2]).repartition("_name", "_tile", "_up").sortWithinPartitions("_up", "_name", "_tile").drop("_up")
        lists = lists.mapInArrow(_merge_by_part(width, fan_in), LISTS)
        parts = -(-parts // fan_in)
    pieces = lists.repartition("_name", "_tile").sortWithinPartitions("_name", "_tile").mapInArrow(_merge(True, width, fan_in), PIECES)
    # At most two edges a tile: the inner periods and gaps of a tile are final already.
    edges = pieces.filter("kind = 'edge'")
    w = W.partitionBy("_name").orderBy("span_from")
    seen = edges.withColumn("_end", F.lag("span_to").over(w)).withColumn("_was", F.lag("_tile").over(w))
    joined = seen.withColumn("_run", F.sum(F.when(F.col("_end") == F.col("span_from"), 0).otherwise(1)).over(w))
    periods = joined.groupBy("_name", "_run").agg(F.min("span_from").alias("span_from"), F.max("span_to").alias("span_to")).withColumn("kind", F.lit("period"))
    across = seen.filter("_end < span_from and _was <> _tile").select("_name", F.lit("gap").alias("kind"), F.col("_end").alias("span_from"), F.col("span_from").alias("span_to"))
    out = ["_name", "kind", "span_from", "span_to"]
    return pieces.filter("kind <> 'edge'").select(out).union(periods.select(out)).union(across.select(out))


def _merge_by_part(width: int, fan_in: int):
    """A middle level of the tree: rows sorted by group of parts first, each group merged by itself."""
    one = _merge(False, width, fan_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            up = batch.column("_part").to_numpy() // fan_in
            cuts = np.r_[0, np.flatnonzero(up[1:] != up[:-1]) + 1, len(up)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if group is not None and up[a] != group:
                        yield from one(iter(held))
                        held = []
                    group = up[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from one(iter(held))

    return run
