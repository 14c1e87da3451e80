"""Duplicates hidden by formatting: one record of each, with the number of its copies.

A record's canonical bytes are its folded id and its folded words in order. Recursive radix partitioning: buckets are the
prefixes of the canonical bytes; one that holds too many records is split by twice as many bytes until each fits. A bucket
that is still too large when its bytes are used up holds one key only and is spread over salts. In each bucket a trie over
the sorted keys has a counter at every terminal: the copies and the smallest id, with the ids that follow it.

Defined cases: NULL text is empty text. A record whose id field has neither letter nor digit has no copies and is a group
of its own. A NULL record id is no record. Rows repeated under one record id count once, by their smallest canonical key.
Texts of any length are used whole. Empty tables give no rows. Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canzona.session import cut, small

#: Records that a bucket may hold.
CAPACITY = 50_000
#: Bytes of the first prefix, doubled on each split.
FIRST_BYTES = 8
CHUNK = 8


def folded(c: Column) -> Column:
    """Letters and digits of c, regardless of case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def folded_words(*texts: Column) -> Column:
    """The words of all texts, folded and sorted; a word without letter or digit is none."""
    words = F.split(F.concat_ws(" ", *texts), r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+")
    return F.array_join(F.array_sort(F.filter(F.transform(words, folded), lambda w: w != "")), " ")


def canonical(records: DataFrame, rec: str, id_field: str, texts: list[str]) -> DataFrame:
    """rec, key: the canonical bytes of each record that can have copies, one row for each record id."""
    head = folded(F.col(id_field))
    return (
        records.filter(F.col(rec).isNotNull())
        .select(F.col(rec).alias("rec"), F.when(head != "", F.encode(F.concat(head, F.lit("\n"), folded_words(*map(F.col, texts))), "utf-8")).alias("key"))
        .groupBy("rec").agg(F.min("key").alias("key")).filter("key is not null")
    )


class Trie:
    """Byte trie in steps of CHUNK bytes; each terminal holds [count, smallest record]."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, rec: int) -> list[int]:
        node = self.root
        for i in range(0, len(key), CHUNK):
            node = node.setdefault(key[i : i + CHUNK], {})
        end = node.setdefault(None, [0, rec])
        end[0] += 1
        if rec < end[1]:
            end[1] = rec
        return end


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket, key, rec; a trie lives as long as its bucket lasts."""
    current, trie = None, Trie()
    for b in batches:
        kept, nth = [], []
        for bucket, salt, key, rec in zip(b["bucket"], b["salt"], b["key"], b["rec"]):
            if (bucket, salt) != current:
                current, trie = (bucket, salt), Trie()
            n, least = trie.add(key, rec)
            kept.append(least)  # sorted by rec within the key: the first is the smallest
            nth.append(n)
        yield pd.DataFrame({"key": b["key"], "salt": b["salt"], "rec": b["rec"], "kept": kept, "nth": nth})


def radix_buckets(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rec, key, bucket, salt: every bucket within the capacity, by recursive splitting on further bytes."""
    depth, done = FIRST_BYTES, []
    rest = cut(keyed)
    part = lambda n: F.substring("key", 1, n)
    while True:
        large = cut(rest.groupBy(part(depth).alias("prefix")).agg(F.count("*").alias("n"), F.max(F.length("key")).alias("longest")).filter(F.col("n") > capacity))
        n = large.count()
        if not n:
            return_parts = [*done, rest.select("rec", "key", part(depth).alias("bucket"), F.lit(0).alias("salt"))]
            break
        tagged = rest.withColumn("prefix", part(depth)).join(small(large, n), "prefix", "left")
        spent = F.col("longest") <= depth
        done.append(tagged.filter("n is null").select("rec", "key", F.col("prefix").alias("bucket"), F.lit(0).alias("salt")))
        salts = F.ceil(F.col("n") / capacity)
        done.append(tagged.filter(F.col("n").isNotNull() & spent).select("rec", "key", F.col("prefix").alias("bucket"), F.pmod(F.xxhash64("rec"), salts).cast("int").alias("salt")))
        rest = cut(tagged.filter(F.col("n").isNotNull() & ~spent).select("rec", "key"))
        depth *= 2
    out = return_parts[0]
    for p in return_parts[1:]:
        out = out.unionByName(p)
    return out


def collapse(keyed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rec, kept, copies: for each record the smallest record of its group and the size of the group."""
    buckets = radix_buckets(keyed, capacity).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "key", "rec")
    placed = cut(buckets.mapInPandas(_buckets, "key binary, salt int, rec long, kept long, nth long"))
    # terminals of single-key buckets over several salts are added up; the others have one part each
    ends = placed.groupBy("key", "salt").agg(F.max("nth").alias("n"), F.min("kept").alias("kept"))
    total = ends.groupBy("key").agg(F.sum("n").alias("copies"), F.min("kept").alias("kept"), F.collect_set("salt").alias("salts"))
    total = total.select("key", "copies", "kept", F.explode("salts").alias("salt"))
    return placed.select("key", "salt", "rec").join(total, ["key", "salt"]).select("rec", "kept", "copies")
