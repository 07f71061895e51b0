"""Texts of varying length in containers of one capacity, by the sum-of-squares rule.

Texts are dealt to shards by hash, and each shard is packed online: an item goes to the level (open
containers of one fill) that makes the sum of squared level counts smallest. What then remains in
poorly filled containers is dealt to fewer shards and packed again, so shards leave no waste behind.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Pieces of a shard: what one task packs at a time.
SHARD = 20_000
#: A container that is less full is packed again.
FULL = 0.97
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

PACKED = "_k long, piece int, first_token long, n_tokens long, container string"


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(path: str):
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for batch in texts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return count


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item (sizes 0 to capacity) and the fill of each container."""
    count = np.zeros(capacity + 1, np.int64)  # open containers at each level; full ones and level 0 don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        if s == 0 and fill:
            where[i] = len(fill) - 1
            continue
        # Change of the sum of squares if the item goes to level h: h loses one, h + s gains one.
        best, at = 2 * int(count[s]) + 1 if s < capacity else 0, 0
        if s < capacity:
            h = np.flatnonzero(count[1 : capacity - s + 1]) + 1
            if len(h):
                gain = np.where(h + s < capacity, 2 * count[h + s] + 1, 0) - 2 * count[h] + 1
                j = len(gain) - 1 - int(np.argmin(gain[::-1]))  # of equal levels the fullest
                if gain[j] <= best:
                    best, at = int(gain[j]), int(h[j])
        if at:
            c = stacks[at].pop()
            count[at] -= 1
            fill[c] += s
        else:
            c = len(fill)
            fill.append(s)
        where[i] = c
        if fill[c] < capacity:
            stacks[fill[c]].append(c)
            count[fill[c]] += fill[c] > 0
    return where, np.array(fill, np.int64)


def _shard(capacity: int, again: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "_k", "piece"], kind="stable")
        where, fill = pack(rows["n_tokens"].to_numpy(), capacity)
        name = f"{'r' if again else 's'}{rows['_shard'].iloc[0]}-"
        out = rows[["_k", "piece", "first_token", "n_tokens"]].copy()
        out["container"] = [name + str(c) for c in where]
        out["_fill"] = fill[where]
        return out

    return run


def pack_containers(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD, full: float = FULL) -> DataFrame:
    """(key, piece, first_token, n_tokens, container): every row packed once, no container overfull.

    A text longer than `capacity` tokens is cut into pieces of that many and a rest; no other text
    is cut. Null and empty texts have 0 tokens and are placed too. Repeated rows are each placed;
    null keys are kept; other columns are ignored. An empty table gives no rows.
    """
    sized = df.select(F.col(key).alias("_k"), token_counts(tokenizer)(F.col(text)).alias("_n"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity).cast("int") - 1, F.lit(0)))
    pieces = sized.select("_k", "_n", F.explode(cuts).alias("piece")).select(
        "_k", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.col("_n") - F.col("piece").cast("long") * capacity, F.lit(capacity).cast("long")).alias("n_tokens")
    )
    # Whole containers need no packing; the others are dealt by hash of all they have, equal rows apart by their place.
    whole = pieces.filter(F.col("n_tokens") == capacity).select("_k", "piece", "first_token", "n_tokens", F.concat(F.lit("w"), F.monotonically_increasing_id().cast("string")).alias("container"))
    part = pieces.filter(F.col("n_tokens") < capacity)
    shards = max(1, -(-df.count() // shard))
    dealt = part.withColumn("_h", F.xxhash64("_k", "piece", "n_tokens")).withColumn("_shard", F.pmod(F.col("_h"), F.lit(shards)))
    first = dealt.groupBy("_shard").applyInPandas(_shard(capacity, False), PACKED + ", _fill long").persist()
    good = F.col("_fill") >= int(full * capacity)
    left = first.filter(~good).withColumn("_h", F.xxhash64("_k", "piece")).withColumn("_shard", F.pmod(F.col("_h"), F.lit(max(1, shards // 8))))
    again = left.drop("container", "_fill").groupBy("_shard").applyInPandas(_shard(capacity, True), PACKED + ", _fill long")
    out = [F.col("_k").alias(key), "piece", "first_token", "n_tokens", "container"]
    return whole.select(out).unionByName(first.filter(good).select(out)).unionByName(again.select(out))
