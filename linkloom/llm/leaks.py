"""Passages of test texts inside a corpus, by counting shared q-grams in diagonal bands.

Texts are lower-cased words with single spaces. The q-grams of a block of test items form an index
of bounded size that goes to all workers; several blocks are met in one pass over the corpus. For
every document, each q-gram it shares with an item is a hit on a diagonal (place in the document less
place in the item). A passage of `window` characters with at most `edits` edits, both an item's own,
leaves at least window - q + 1 - q * edits hits within a band of diagonals; bands overlap by the most
edits, so no passage falls between two. Regions with so many hits are kept and verified by a banded
alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q, EDITS, WORDS = 12, 2, 13
#: Characters of test items that one index holds (some 20 bytes each); more items are taken in blocks of this size, so many in a pass.
BLOCK, BLOCKS_A_PASS = 8_000_000, 4
#: Characters of documents that a task compares at a time.
CHUNK = 2_000_000
#: Hits that a task holds at a time.
HITS = 4_000_000
WORD = re.compile(r"[^\W_]+")
BASE, SLOT = np.uint64(0x9E3779B97F4A7C15), 22


def plain(text: str | None) -> str:
    """Lower-cased words with single spaces."""
    return " ".join(WORD.findall(text)).lower() if text else ""


def words(text: str | None) -> list[str]:
    return plain(text).split(" ") if text and WORD.search(text) else []


def _grams(text: str, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Hashes of 1, 2, 4, ... characters; those that q is the sum of are put one after the other.
    size, part, power = 1, codes, int(BASE)
    h, done = None, 0
    while True:
        if q & size:
            h = part[:n].copy() if h is None else h * np.uint64(power) + part[done : done + n]
            done += size
        if 2 * size > q:
            break
        part = part[:-size] * np.uint64(power) + part[size:]
        size, power = 2 * size, power * power % (1 << 64)
    h ^= h >> np.uint64(29)
    return h * BASE


@dataclass
class Index:
    """The q-grams of some items: sorted hashes, and for each the items and places it has."""

    q: int
    window: np.ndarray  # least length of a region of each item
    edits: np.ndarray  # of each item
    texts: list[str]
    passages: list[list[str]]  # runs of WORDS words, with a space on either side
    starts: np.ndarray  # where each text begins in the whole
    keys: np.ndarray
    first: np.ndarray
    places: np.ndarray
    slots: np.ndarray

    @property
    def least(self) -> np.ndarray:
        """Hits that a passage of each item leaves."""
        return self.window - self.q + 1 - self.q * self.edits


def own_window(w: list[str], n_words: int) -> int:
    """Length of an item's shortest run of n_words words, or of all if it has fewer."""
    total = np.r_[0, np.cumsum([len(x) for x in w])]
    k = min(n_words, len(w))
    return int((total[k:] - total[: len(total) - k]).min()) + k - 1 if w else 0


def build_index(texts: list[str | None], q: int, edits: int, window: int | None, n_words: int) -> Index:
    plain_texts, passages, windows = [], [], []
    for t in texts:
        w = words(t)
        plain_texts.append(" ".join(w))
        passages.append([f" {' '.join(w[i : i + n_words])} " for i in range(len(w) - n_words + 1)])
        windows.append(max(q, own_window(w, n_words) if window is None else window))
    window = np.array(windows, np.int64)
    edits = np.maximum(0, np.minimum(edits, (window - q) // q))
    hashes, places, starts, at = [], [], [], 0
    for t, reach in zip(plain_texts, windows, strict=True):
        h = _grams(t, q)
        hashes.append(h)
        places.append(np.arange(len(h)) + at)
        starts.append(at)
        at += len(t) + reach
    h, p = np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int32)
    order = np.argsort(h, kind="stable")
    h, p = h[order], p[order]
    keys, first = np.unique(h, return_index=True)
    slots = np.zeros(1 << SLOT, bool)
    slots[(keys >> np.uint64(64 - SLOT)).astype(np.int64)] = True
    return Index(q, window, edits, plain_texts, passages, np.array(starts, np.int64), keys, np.r_[first, len(h)].astype(np.int32), p, slots)


def _hits(index: Index, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of shared q-grams in the documents, their keys, and how many places in items each has.

    Parts have some HITS pairs of places at most (or one q-gram's) and begin so far before the last
    one's end that every passage lies in one.
    """
    at = np.flatnonzero(index.slots[(h >> np.uint64(64 - SLOT)).astype(np.int64)])
    key = np.searchsorted(index.keys, h[at])
    key[key == len(index.keys)] = 0
    same = index.keys[key] == h[at] if len(index.keys) else np.zeros(len(at), bool)
    at, key = at[same], key[same]
    n = (index.first[key + 1] - index.first[key]).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    if not len(at):
        return
    reach = int(index.window.max() + index.edits.max())
    part = np.cumsum(n) // HITS
    ends = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(at)]
    for lo, hi in zip(np.r_[0, ends[:-1]], ends, strict=True):
        lo = np.searchsorted(at, at[lo] - reach) if lo else 0
        yield at[lo:hi], key[lo:hi], n[lo:hi]


def _regions(index: Index, at: np.ndarray, key: np.ndarray, n: np.ndarray, doc_of: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, low diagonal, high diagonal, from, to) with enough hits in a band and window."""
    rows = np.repeat(np.arange(len(at)), n)
    place = index.places[np.repeat(index.first[key].astype(np.int64), n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
    x, item = at[rows], np.searchsorted(index.starts, place, side="right") - 1
    diag = x - place
    most = int(index.edits.max())
    step = max(8, 2 * most)
    low = diag // step
    # Each band reaches as many diagonals into the next one as there may be edits.
    twice = diag - low * step < most
    band = np.r_[low, low[twice] - 1]
    x, item, diag = np.r_[x, x[twice]], np.r_[item, item[twice]], np.r_[diag, diag[twice]]
    doc = doc_of[x]
    order = np.lexsort((x, band, item, doc))
    x, item, band, doc = x[order], item[order], band[order], doc[order]
    # The hit with which a region that begins at each hit has enough of them.
    a, b = np.arange(len(x)), np.arange(len(x)) + index.least[item] - 1
    a, b = a[b < len(x)], b[b < len(x)]
    reach = (index.window - index.q + index.edits)[item[a]]
    full = (doc[a] == doc[b]) & (item[a] == item[b]) & (band[a] == band[b]) & (x[b] - x[a] <= reach)
    out: list[tuple[int, int, int, int, int, int]] = []
    for i, j in zip(a[full], b[full], strict=True):
        lo, hi = int(x[i]), int(x[j]) + index.q
        now = (int(doc[i]), int(item[i]), int(band[i]) * step, int(band[i] + 1) * step + most)
        if out and out[-1][:4] == now and lo <= out[-1][5]:
            out[-1] = (*now, out[-1][4], max(hi, out[-1][5]))
        else:
            out.append((*now, lo, hi))
    return out


#: A state of the alignment in one number: score, then characters matched, then edits counted down.
_SCORE, _CHARS, _BASE = 1 << 40, 1 << 20, (1 << 20) - 1
_MATCH, _EDIT = _SCORE + _CHARS, 2 * _SCORE + 1
#: Regions aligned side by side.
SIDE = 256


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def align(docs: list[str], items: list[str], shifts: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, characters matched and edits of the best local alignment of each pair of texts in a band.

    The band has the diagonals shift .. shift + width (document less item). A match counts 1, an
    edit costs 2; of equal scores the one with more characters counts. The pairs run side by side.
    """
    k, r = width + 1, len(docs)
    a, b = [_codes(t) for t in docs], [_codes(t) for t in items]
    n, m = max(map(len, a), default=0), max(map(len, b), default=0)
    da, db = np.zeros((r, n), np.int64), np.full((r, m + 1), -1, np.int64)
    for i in range(r):
        da[i, : len(a[i])], db[i, : len(b[i])] = a[i], b[i]
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    shift, lanes, rows = np.array(shifts)[:, None], np.arange(k)[None, :], np.arange(r)[:, None]
    now, best, ramp = np.full((r, k), _BASE), np.full(r, _BASE), _EDIT * np.arange(k)[None, :]
    for i in range(n):
        # Lane l compares with place i - (shift + l) of the item.
        j = i - shift - lanes
        inside = (j >= 0) & (j < lb[:, None]) & (i < la)[:, None]
        same = db[rows, np.where(inside, j, m)] == da[:, i : i + 1]
        to = np.where(inside, now + np.where(same, _MATCH, -_EDIT), _BASE)
        # A character of the document left out comes from the lane before in the last row,
        to[:, 1:] = np.maximum(to[:, 1:], np.where(inside[:, 1:], now[:, :-1] - _EDIT, _BASE))
        # characters of the item left out from later lanes in this row.
        to = np.maximum.accumulate((to - ramp)[:, ::-1], axis=1)[:, ::-1] + ramp
        now = np.where(to < _SCORE, _BASE, to)
        best = np.maximum(best, now.max(axis=1))
    return best // _SCORE, best % _SCORE // _CHARS, _BASE - best % _CHARS


@dataclass
class Texts:
    """Documents that are compared together."""

    texts: list[str]
    starts: np.ndarray
    grams: np.ndarray
    doc_of: np.ndarray  # of each place


def held_texts(texts: list[str], q: int) -> Texts:
    pad = "\n" * q
    starts = np.cumsum([0, *(len(t) + len(pad) for t in texts)])
    return Texts(texts, starts, _grams(pad.join(texts) + pad, q), np.repeat(np.arange(len(texts)), np.diff(starts)))


def _compare(index: Index, held: Texts) -> dict[tuple[int, int], tuple[int, int, bool]]:
    """For pairs of document and item that are verified: characters, edits, and whether a passage of words is shared."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for at, key, n in _hits(index, held.grams):
        regions = _regions(index, at, key, n, held.doc_of)
        regions.sort(key=lambda x: x[5] - x[4])
        for i in range(0, len(regions), SIDE):
            _verify(index, held.texts, held.starts, regions[i : i + SIDE], best)
    done, texts = {}, held.texts
    for (doc, item), (chars, edits) in best.items():
        hay = f" {texts[doc]} "
        done[doc, item] = (chars, edits, any(p in hay for p in index.passages[item]))
    return done


def _verify(index: Index, texts: list[str], starts: np.ndarray, regions: list[tuple], best: dict[tuple[int, int], tuple[int, int]]) -> None:
    docs, items, shifts, width = [], [], [], 0
    for doc, item, lo, hi, a, b in regions:
        text, own, reach = texts[doc], index.texts[item], int(index.window[item])
        width = hi - lo
        d0, d1 = max(0, a - int(starts[doc]) - reach), min(len(text), b - int(starts[doc]) + reach)
        # Diagonals hold places in the wholes; seen from both texts they are less their starts.
        shift = lo - int(starts[doc]) + int(index.starts[item])
        i0 = max(0, d0 - shift - width)
        docs.append(text[d0:d1])
        items.append(own[i0 : max(i0, min(len(own), d1 - shift + 1))])
        shifts.append(shift - d0 + i0)
    score, chars, edits = align(docs, items, shifts, width)
    asked = np.array([r[1] for r in regions])
    for k in np.flatnonzero(score >= (index.window - 3 * index.edits)[asked]):
        pair = regions[k][:2]
        best[pair] = max(best.get(pair, (0, 0)), (int(chars[k]), int(edits[k])))


def _scan(indexes: list, item_ids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [i.value for i in indexes]
        # No shorter text has a region.
        least = min(int((ix.window - ix.edits).min()) for ix in parts)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            held, size, rows = [], 0, []
            for i in range(batch.num_rows):
                t = plain(texts[i].as_py())
                if len(t) >= least:
                    held.append(t)
                    rows.append(i)
                    size += len(t)
                if held and (size >= CHUNK or i == batch.num_rows - 1):
                    yield from emit(parts, keys, rows, held)
                    held, size, rows = [], 0, []
            if held:
                yield from emit(parts, keys, rows, held)

    def emit(parts: list[Index], keys: pa.Array, rows: list[int], held: list[str]) -> Iterator[pa.RecordBatch]:
        together = held_texts(held, parts[0].q)
        for ix, ids in zip(parts, item_ids, strict=True):
            found = _compare(ix, together)
            if found:
                pairs = list(found)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([rows[d] for d, _ in pairs])), pa.array([ids[i] for _, i in pairs], pa.int64())]
                    + [pa.array([found[p][j] for p in pairs], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))],
                    ["_k", "_item", "chars", "edits", "passage"],
                )

    return run


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, q: int = Q, edits: int = EDITS, n_words: int = WORDS, window: int | None = None, block: int = BLOCK) -> DataFrame:
    """(key, item_key, chars, edits, passage) for each document and item with a shared region.

    chars is the length of the best verified alignment, edits its edits; passage tells whether
    `n_words` consecutive words stand in both. `window` is the least length of a region; unless given
    it is, for each item, that of its own shortest run of n_words words (of all its words if it has
    fewer), so that every such run is found: a run without edits has window - q + 1 hits, more than
    the bound. `edits` is lowered for the items whose window is too short for it, not for others.

    Null and empty texts match nothing. Items shorter than q match nothing. Repeated documents each
    give their rows; item keys should be whole numbers without repeats. Other columns are ignored. An
    empty table gives no rows.
    """
    spark = df.sparkSession
    q = min(q, 2 * n_words - 1 if window is None else window)
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.length("_t") > 0)
    asked = items.select(F.col(item_key).cast("long").alias("_i"), F.col(item_text).alias("_t")).filter("_i is not null and length(_t) > 0")
    schema = T.StructType([rows.schema["_k"], *T.StructType.fromDDL("_item long, chars long, edits long, passage boolean").fields])
    total = asked.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = -(-total // block)
    done: DataFrame | None = None
    for b in range(0, blocks, BLOCKS_A_PASS):
        # A stated set of items, in blocks of bounded size; the corpus is read once for several.
        indexes, ids = [], []
        for c in range(b, min(b + BLOCKS_A_PASS, blocks)):
            part = asked.filter(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == c).orderBy("_i").collect()
            if part:
                indexes.append(spark.sparkContext.broadcast(build_index([r["_t"] for r in part], q, edits, window, n_words)))
                ids.append([r["_i"] for r in part])
        if indexes:
            found = rows.mapInArrow(_scan(indexes, ids), schema)
            done = found if done is None else done.unionByName(found)
    if done is None:
        done = spark.createDataFrame([], schema)
    return done.select(F.col("_k").alias(key), F.col("_item").alias(item_key), "chars", "edits", "passage")
