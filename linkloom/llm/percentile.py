"""Percentiles of very many values per group with a bounded rank error, from mergeable summaries.

A summary is a set of sorted buffers with weights. Buffers of equal size K are collapsed by merging
them in order, each element as often as its weight, and keeping every W-th position, W being the sum
of weights. A collapse moves a rank by at most (W + 1) / 2, and these bounds add up; they are kept
with every buffer. Partitions make summaries first, a tree with a fixed fan-in merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of a buffer, and how many a group may have before they are collapsed into one.
K, BUFFERS = 256, 32
#: Summaries of one group that a task merges; more are merged in another level of the tree.
FAN_IN = 64
#: Values that a task holds at once.
FLUSH = 1 << 20

STATE = "_part int, weight long, err double, vals array<long>"


def collapse(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Collapse sorted values with weights into `size` values of one weight; the total must be a multiple of size."""
    reach = np.cumsum(weights)
    w = int(reach[-1]) // size
    return values[np.searchsorted(reach, np.arange(size, dtype=np.int64) * w + (w + 1) // 2)], w


def _summaries(code: np.ndarray, val: np.ndarray, weight: np.ndarray, err: np.ndarray, k: int, buffers: int):
    """For sorted groups, the buffers that remain: code, weight, err, start, end in the returned values.

    err holds a buffer's error on its first element, 0 elsewhere.
    """
    order = np.lexsort((val, code))
    err_of = np.bincount(code, err, minlength=int(code.max()) + 1) if len(code) else np.zeros(0)
    code, val, weight = code[order], val[order], weight[order]
    at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    n = np.diff(np.r_[at, len(code)])
    parts: list[tuple[int, int, float, np.ndarray]] = []
    big = n > k * buffers
    for i in np.flatnonzero(big):
        v, w = val[at[i] : at[i] + n[i]], weight[at[i] : at[i] + n[i]]
        total = int(w.sum())
        # What doesn't fill whole buffers stays as it is: single values, lowest first.
        single = np.flatnonzero(w == 1)[: total % k]
        if len(single) < total % k:
            # Too few single values: the lowest ones are parted from their weight.
            parts.extend(_parted(int(code[at[i]]), v, w, k, float(err_of[code[at[i]]])))
            continue
        mask = np.ones(len(v), bool)
        mask[single] = False
        out, width = collapse(v[mask], w[mask], k)
        parts.append((int(code[at[i]]), width, float(err_of[code[at[i]]]) + (width + 1) / 2, out))
        if len(single):
            parts.append((int(code[at[i]]), 1, 0.0, v[single]))
    small = np.repeat(~big, n)
    return code[small], val[small], weight[small], err_of, parts


def _parted(code: int, v: np.ndarray, w: np.ndarray, k: int, err: float):
    total, left = int(w.sum()), int(w.sum()) % k
    cut = np.cumsum(w)
    low = np.minimum(w, np.maximum(0, left - (cut - w)))
    out, width = collapse(v[w > low], (w - low)[w > low], k)
    yield code, width, err + (width + 1) / 2, out
    yield code, 1, 0.0, np.repeat(v, low)
    assert total == width * k + left


def _arrays(code: np.ndarray, vals: np.ndarray, weight: np.ndarray, err_of: np.ndarray, parts: list) -> tuple:
    """Rows of buffers: equal weights of a group stand together as one list."""
    order = np.lexsort((vals, weight, code))
    code, vals, weight = code[order], vals[order], weight[order]
    at = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (weight[1:] != weight[:-1])]) if len(code) else np.zeros(0, int)
    first = np.r_[True, code[at][1:] != code[at][:-1]] if len(at) else np.zeros(0, bool)
    rows_code = np.r_[code[at], np.array([p[0] for p in parts], np.int64)]
    rows_weight = np.r_[weight[at], np.array([p[1] for p in parts], np.int64)]
    rows_err = np.r_[np.where(first, err_of[code[at]], 0.0) if len(at) else np.zeros(0), np.array([p[2] for p in parts], float)]
    lengths = np.r_[np.diff(np.r_[at, len(code)]), np.array([len(p[3]) for p in parts], np.int64)]
    flat = np.concatenate([vals, *[p[3] for p in parts]]) if parts else vals
    return rows_code, rows_weight, rows_err, np.r_[0, np.cumsum(lengths)], flat


def _codes(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, pa.Table]:
    """A number for each row's key, and the distinct keys by that number."""
    code, sizes = None, []
    dicts = []
    for k in keys:
        d = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        now = d.indices.to_numpy().astype(np.int64)
        dicts.append(d.dictionary)
        sizes.append(max(1, len(d.dictionary)))
        code = now if code is None else code * sizes[-1] + now
    found, code = np.unique(code, return_inverse=True)
    cols, rest = [], found
    for d, n in zip(reversed(dicts), reversed(sizes), strict=True):
        cols.append(d.take(pa.array(rest % n)))
        rest = rest // n
    return code.astype(np.int64), pa.Table.from_arrays(list(reversed(cols)), keys)


def _emit(keys: list[str], names: pa.Table, part: int, rows: tuple) -> pa.RecordBatch:
    code, weight, err, offsets, flat = rows
    # All rows of a group stand together, as the readers after it expect.
    order = np.argsort(code, kind="stable")
    vals = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64())).take(pa.array(order))
    code, weight, err = code[order], weight[order], err[order]
    cols = [names.column(k).combine_chunks().take(pa.array(code)) for k in keys]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(code), part), pa.int32()), pa.array(weight, pa.int64()), pa.array(err, pa.float64()), vals], [*keys, "_part", "weight", "err", "vals"])


def _first_level(keys: list[str], k: int, buffers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            code, names = _codes(rows, keys)
            lists = rows.column("vals").combine_chunks()
            code = np.repeat(code, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            val = lists.flatten().to_numpy()
            c, v, w, e, parts = _summaries(code, val, np.ones(len(val), np.int64), np.zeros(len(val)), k, buffers)
            return _emit(keys, names, part, _arrays(c, v, w, e, parts))

        for batch in batches:
            held.append(batch)
            n += len(batch.column(batch.schema.get_field_index("vals")).flatten())
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _buffers(rows: pa.Table, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists = rows.column("vals").combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    err = np.zeros(int(n.sum()))
    starts = np.cumsum(n) - n
    filled = n > 0
    err[starts[filled]] = rows.column("err").to_numpy()[filled]
    return np.repeat(code, n), lists.flatten().to_numpy(), np.repeat(rows.column("weight").to_numpy(), n), err


def _by_group(keys: list[str], finish):
    """Apply `finish` to tables with whole groups; the input is sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += len(batch.column(batch.schema.get_field_index("vals")).flatten())
            if n < FLUSH:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            same = np.ones(rows.num_rows, bool)
            for k in keys:
                col, last = rows.column(k), rows.column(k)[-1]
                eq = pc.is_null(col) if not last.is_valid else pc.fill_null(pc.equal(col, last), False)
                same &= eq.to_numpy()
            cut = int(np.argmax(same))
            if cut:
                yield finish(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            n = sum(len(b.column(b.schema.get_field_index("vals")).flatten()) for b in held)
        if held:
            yield finish(pa.Table.from_batches(held).combine_chunks())

    return run


def _middle_level(keys: list[str], fan_in: int, k: int, buffers: int):
    def finish(rows: pa.Table) -> pa.RecordBatch:
        part = rows.column("_part").to_numpy() // fan_in
        code, names = _codes(rows.append_column("_up", pa.array(part, pa.int32())), [*keys, "_up"])
        out = _emit([*keys, "_up"], names, 0, _arrays(*_summaries(*_buffers(rows, code), k, buffers)))
        up = out.column(len(keys))
        cols = [*out.columns[: len(keys)], up, *out.columns[len(keys) + 2 :]]
        return pa.RecordBatch.from_arrays(cols, [*keys, "_part", "weight", "err", "vals"])

    return _by_group(keys, finish)


def _last_level(keys: list[str], k: int, buffers: int):
    def finish(rows: pa.Table) -> pa.RecordBatch:
        code, names = _codes(rows, keys)
        return _emit(keys, names, 0, _arrays(*_summaries(*_buffers(rows, code), k, buffers)))

    return _by_group(keys, finish)


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    state = T.StructType.fromDDL(STATE)
    return T.StructType([df.schema[k] for k in keys] + state.fields)


def summarise(df: DataFrame, keys: list[str], vals: str, k: int = K, buffers: int = BUFFERS, fan_in: int = FAN_IN) -> DataFrame:
    """One summary per key (rows: keys, _part, weight, err, vals) of the LONG values in the arrays `vals`.

    Keys must not be named like the result's other columns; what else the table holds is ignored.
    Arrays are used as they are: give only usable values, without nulls. Null keys form groups of
    their own. Groups without values give no row; an empty table gives none. Repeated rows count
    as often as they stand.
    """
    rows = df.select(*keys, F.col(vals).cast("array<long>").alias("vals")).filter(F.size("vals") > 0)
    # Kept, as the number of partial summaries of a key decides the levels of the tree.
    first = rows.mapInArrow(_first_level(keys, k, buffers), _schema(rows, keys)).persist()
    return combine(first, keys, k, buffers, fan_in)


def combine(parts: DataFrame, keys: list[str], k: int = K, buffers: int = BUFFERS, fan_in: int = FAN_IN) -> DataFrame:
    """Merge summaries of partitions, days or runs (told apart by _part) into one per key, by a tree."""
    schema = _schema(parts, keys)
    n_parts = (parts.agg(F.max("_part")).first()[0] or 0) + 1
    while n_parts > fan_in:
        up = F.floor(F.col("_part") / fan_in).cast("int")
        spread = parts.withColumn("_up", up).repartition(*keys, "_up").sortWithinPartitions(*keys, "_up").drop("_up")
        parts = spread.mapInArrow(_middle_level(keys, fan_in, k, buffers), schema)
        n_parts = -(-n_parts // fan_in)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_last_level(keys, k, buffers), schema)


def _quantiles(keys: list[str], pcts: list[int]):
    def finish(rows: pa.Table) -> pa.RecordBatch:
        code, names = _codes(rows, keys)
        code, val, weight, err = _buffers(rows, code)
        groups = names.num_rows
        error = np.bincount(code, err, minlength=groups)
        order = np.lexsort((val, code))
        code, val = code[order], val[order]
        reach = np.cumsum(weight[order])
        first = np.searchsorted(code, np.arange(groups))
        last = np.searchsorted(code, np.arange(groups), side="right") - 1
        base = np.where(first > 0, reach[first - 1], 0)
        n = reach[last] - base
        slack = np.ceil(error).astype(np.int64)
        at = lambda r: val[np.clip(np.searchsorted(reach, base + np.clip(r, 1, n)), first, last)]
        out: list[pa.Array] = [names.column(k).combine_chunks() for k in keys]
        cols, head = [], [*keys, "n_values", "rank_error"]
        for p in pcts:
            r = (n * p + 99) // 100
            r = np.maximum(r, 1)
            # A rank below 1 says nothing below; the true value is above the value just under rank r - slack.
            lo = np.where(r - slack > 1, at(r - slack - 1), np.iinfo(np.int64).min)
            lo = np.where(slack == 0, at(r), lo)
            hi = np.where(r + slack <= n, at(r + slack), np.iinfo(np.int64).max)
            cols += [pa.array(at(r), pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]
            head += [f"p{p}", f"p{p}_least", f"p{p}_most"]
        return pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), pa.array(slack, pa.int64()), *cols], head)

    return _by_group(keys, finish)


def quantiles(summary: DataFrame, keys: list[str], pcts: list[int]) -> DataFrame:
    """(keys, n_values, rank_error, pP, pP_least, pP_most for each P): the P-th percentile and its bounds.

    The true one is the least value v such that at least P % of values are <= v; it lies between
    pP_least and pP_most, which equal pP where rank_error is 0.
    """
    fields = [*[summary.schema[k] for k in keys], T.StructField("n_values", T.LongType()), T.StructField("rank_error", T.LongType())]
    fields += [T.StructField(f"p{p}{s}", T.LongType()) for p in pcts for s in ("", "_least", "_most")]
    return summary.mapInArrow(_quantiles(keys, pcts), T.StructType(fields))
