"""Texts of varying length into containers of fixed capacity, with as little room left as possible.

Shortest-pack-first over the length histogram: lengths are placed longest first, each into the open packs with the most
room, and only the counts of packing patterns are kept; the work depends on the capacity, not on the number of texts. The
patterns are then joined back to the texts by their rank among those of equal length. Only a text longer than a container
is cut, into full containers and a rest.

Defined cases: a NULL or empty text has no tokens, one row with piece 0 and no container. A NULL id is kept as it is;
repeated rows are texts of their own. Empty tables give no rows. Texts are
tokenised whole, however long. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.session import HOT_ROWS, cut

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def tokenizer(path: str, pattern: str = PATTERN):
    """The byte-level BPE of a .tiktoken file, loaded once in each worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(texts: DataFrame, rec: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """rec, tokens of each text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"rec": b["rec"], "tokens": [len(encode(t)) if t else 0 for t in b["text"]]})

    return texts.select(F.col(rec).alias("rec"), F.col(text).alias("text")).mapInPandas(count, "rec long, tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns, from length -> number of pieces."""
    open_packs: dict[int, list[list]] = {}  # room left -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_packs if r >= length), default=None)
            if room is None:
                open_packs.setdefault(capacity - length, []).append([left, (length,)])
                break
            packs = open_packs[room]
            n, lengths = packs[-1]
            used = min(n, left)
            if used == n:
                packs.pop()
                if not packs:
                    del open_packs[room]
            else:
                packs[-1][0] -= used
            open_packs.setdefault(room - length, []).append([used, (*lengths, length)])
            left -= used
    return [(n, lengths) for packs in open_packs.values() for n, lengths in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """keys (length << 40 | first rank), sorted, and the container of each slot's first rank."""
    next_rank: dict[int, int] = {}
    rows, base = [], 0
    for n, lengths in patterns:
        for length in lengths:
            rank = next_rank.get(length, 0)
            rows.append((length << 40 | rank, base))
            next_rank[length] = rank + n
        base += n
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def pack(lengths: DataFrame, capacity: int = CAPACITY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rec, piece, tokens, container from lengths (rec, tokens)."""
    whole = lengths.select("rec", F.posexplode(
        F.when(F.col("tokens") <= capacity, F.array("tokens")).otherwise(
            F.concat(
                F.array_repeat(F.lit(capacity).cast("long"), F.floor(F.col("tokens") / capacity).cast("int")),
                F.filter(F.array(F.col("tokens") % capacity), lambda r: r > 0),
            )
        )
    ).alias("piece", "size"))
    whole = cut(whole)
    # so many slices that even if all pieces are of one length none holds more than about hot_rows
    slices = max(1, -(-whole.count() // hot_rows))
    pieces = whole.withColumn("slice", F.pmod(F.xxhash64("rec", "piece"), F.lit(slices)).cast("int"))
    counts = cut(pieces.filter("size > 0").groupBy("size", "slice").count())
    histogram = {int(r["size"]): int(r["n"]) for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    keys, first = slots(shortest_pack_first(histogram, capacity))
    # rank among equal lengths: the place in the slice after all smaller slices
    before = counts.select("size", "slice", (F.sum("count").over(W.partitionBy("size").orderBy("slice")) - F.col("count")).alias("before"))
    place = F.row_number().over(W.partitionBy("size", "slice").orderBy("rec", "piece")) - 1
    ranked = pieces.withColumn("place", place).join(before, ["size", "slice"], "left").select("rec", "piece", "size", (F.col("place") + F.col("before")).alias("rank"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, rank = b["size"].to_numpy(np.int64), b["rank"].fillna(0).to_numpy(np.int64)
            key = size << 40 | rank
            at = np.searchsorted(keys, key, "right") - 1
            box = pd.Series(first[at] + key - keys[at] if len(keys) else 0, index=b.index).astype("Int64").mask(size == 0)
            yield pd.DataFrame({"rec": b["rec"], "piece": b["piece"], "tokens": size, "container": box})

    return ranked.mapInPandas(assign, "rec long, piece int, tokens long, container long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container, pieces, tokens, room of each container."""
    return packed.filter("container is not null").groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens")).withColumn("room", capacity - F.col("tokens"))
