"""Near-duplicate sequences: all pairs whose sets of token runs are alike enough, and their groups.

LSH forest: in each of TREES trees a record has a signature, min-hashes of its runs of SHINGLE tokens. The records are sorted by
signature, tree by tree; those with the longest common prefixes lie side by side, and the neighbours whose prefix is DEPTH long at
least form a region. The depth adapts to the region: the records of one that holds at most REGION are candidates; a fuller one is
sorted again, in BRANCHES orders by further hashes of its own, any of which may agree, so that its records meet again in smaller
regions, for ROUNDS rounds at most. A region full to the last (its records agree in nearly everything) is compared whole, in blocks
that spread over the tasks. Candidates are checked exactly. Exact copies are one record until the end.

A scan of a sorted partition holds at most REGION records of a region; the longer ones pass through it. Signatures are never
stored: the keys of the trees are written once, further hashes are taken only for the records of full regions.

Chance that a pair of similarity s is no candidate: at most (1 - s^2 p)^TREES, p = (1 - (1 - s)^BRANCHES)^ROUNDS; for
s = 0.5 that is 0.06 % where no region is full and 0.1 % where all regions stay full to the last round.

Defined cases: NULL sequences and those under `least` tokens link to nothing. NULL tokens are a value of their own.
Of several rows of one record the largest sequence counts. Empty tables give no rows. Sequences are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canzona.llm.sequences import components, copy_classes, group_pairs, record_pairs, sequences
from canzona.session import HOT_ROWS, cut, small

SHINGLE, TREES, DEPTH, BRANCHES, ROUNDS, REGION = 5, 26, 2, 6, 4, 150
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of x, another for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def run_sets(shingle: int = SHINGLE):
    """A mapInArrow function: cls, seq -> cls, n, set (distinct run hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq = b.column("seq")
            flat = seq.flatten()
            tokens = np.asarray(flat.fill_null(np.iinfo(np.int32).min), dtype=np.int64).astype(np.uint64) if len(flat) else np.zeros(0, np.uint64)
            sizes = np.asarray(seq.value_lengths().fill_null(0), dtype=np.int64)
            ends = np.cumsum(sizes)
            h = np.zeros(max(len(tokens) - shingle + 1, 0), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(shingle):
                    h = mixed(h * _MIX[0] + tokens[k : len(tokens) - shingle + 1 + k], k)
            sets = [np.unique(h[lo : max(hi - shingle + 1, lo)]) for lo, hi in zip(ends - sizes, ends)]
            counts = np.array([len(s) for s in sets], dtype=np.int64)
            cat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("cls"), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(cat.view(np.int64)))], names=["cls", "n", "set"]
            )

    return run


def _rows(region: np.ndarray, label: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(label.view(np.int64)), pa.array(cls), pa.array(n)], names=["region", "label", "cls", "n"])


def _sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all sets, where each begins, and cls and n; of the sets that hold any."""
    n = np.asarray(b.column("n"), dtype=np.int32)
    cat = np.asarray(b.column("set").flatten(), dtype=np.int64).view(np.uint64)
    some = n > 0
    return cat, (np.cumsum(n) - n)[some], np.asarray(b.column("cls"))[some], n[some]


def tree_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, n, set -> one row a tree: region (tree and first hash), label (the next hashes of the signature), cls, n."""
    for b in batches:
        cat, starts, cls, n = _sets(b)
        for t in range(TREES if len(starts) else 0):
            sig = [np.minimum.reduceat(mixed(cat, t * DEPTH + k + 1), starts) for k in range(DEPTH)]
            label = np.zeros(len(cls), np.uint64)
            for x in sig[1:]:
                label = mixed(label ^ x, 7)
            yield _rows(mixed(sig[0], TREES * DEPTH + t + 1), label, cls, n)


def branch_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """region, label, cls, n, set of records in full regions -> one row a branch; each region has hashes of its own."""
    for b in batches:
        cat, starts, cls, n = _sets(b)
        some = np.asarray(b.column("n")) > 0
        here = mixed(np.asarray(b.column("region")).view(np.uint64) ^ mixed(np.asarray(b.column("label")).view(np.uint64), 3), 5)[some]
        for j in range(BRANCHES if len(starts) else 0):
            own = mixed(here, 11 + j)
            low = np.minimum.reduceat(mixed(cat ^ np.repeat(own, n), 13), starts)
            yield _rows(own, low, cls, n)


def neighbours(region: int = REGION):
    """A mapInArrow function over rows sorted by region and label: the pairs of neighbours (a, b), and the rows of full regions, where a is NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the region at the end of the last batch, region + 1 at most
        passing = False  # that region is full and its held rows are out already

        def out(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            none, empty = pa.nulls(len(rows[0]), pa.int64()), pa.nulls(len(a), pa.int64())
            col = lambda x, y, kind: pa.concat_arrays([x, y.cast(kind)])
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([none, pa.array(a)]), pa.concat_arrays([none, pa.array(b)]), *(col(pa.array(x), empty, pa.int64()) for x in rows)],
                names=["a", "b", "region", "label", "cls", "n"],
            )

        def pairs(cls: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # each row with all later ones of its region
            end = np.repeat(starts + sizes, sizes)
            row = np.concatenate([np.arange(s, s + k) for s, k in zip(starts, sizes)]) if len(starts) else np.zeros(0, np.int64)
            later = end - row - 1
            x = np.repeat(row, later)
            y = np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later) + x + 1
            fit = (2 * np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y])) & (cls[x] != cls[y])
            x, y = cls[x[fit]], cls[y[fit]]
            return np.minimum(x, y), np.maximum(x, y)

        def scan(cols: list[np.ndarray], final: bool) -> pa.RecordBatch:
            nonlocal held, passing
            r, lab, cls, n = cols
            # the common prefix with the row before is whole where both agree
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (lab[1:] != lab[:-1])]) if len(r) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[first, len(r)])
            full = sizes > region
            gone = 0
            if passing and len(first):
                full[0] = True
                gone = 1  # the row that marked the region is out already
            passing = False
            stay = first[:0]
            if not final and len(first):
                stay = first[-1:]
                passing = bool(full[-1])
            whole = ~full
            if len(stay):
                whole[-1] = False
            a, b = pairs(cls, n, first[whole], sizes[whole])
            keep = np.repeat(full, sizes)
            keep[:gone] = False
            held = [x[-1:] if passing else x[stay[0] :] for x in cols] if len(stay) else []
            return out([x[keep] for x in cols], a, b)

        for batch in batches:
            cols = [np.asarray(batch.column(c)).astype(np.int64) for c in ("region", "label", "cls", "n")]
            if len(cols[0]):
                yield scan([np.concatenate(x) for x in zip(held, cols)] if held else cols, False)
        if held:
            yield scan(held, True)

    return run


def _spread(keys: DataFrame, hot_rows: int = HOT_ROWS, share: int = 128) -> DataFrame:
    """keys in sorted order, a region in one partition; hot regions, as a sample by hash of cls shows them, in several.

    The parts of a hot region are fuller than a region may be, so no pair is formed in them and none is missed. A region that the
    sample does not show is scanned in one partition, which only takes longer.
    """
    some = keys.filter(F.pmod(F.xxhash64("cls"), F.lit(share)) == 0).groupBy("region", "label").count()
    hot = cut(some.filter(F.col("count") * share > hot_rows).select("region", "label", F.ceil(F.col("count") * share / hot_rows).cast("int").alias("salts")))
    hot = small(hot, hot.count())
    salt = F.coalesce(F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"), F.lit(0))
    salted = keys.join(hot, ["region", "label"], "left").withColumn("salt", salt).drop("salts")
    return salted.repartition("region", "label", "salt").sortWithinPartitions("region", "label", "salt", "cls").drop("salt")


def forest_candidates(sets: DataFrame, region: int = REGION, rounds: int = ROUNDS) -> DataFrame:
    """a < b: the distinct candidate pairs of sets (cls, n, set)."""
    row = "region long, label long, cls long, n int"
    scanned = "a long, b long, region long, label long, cls long, n long"
    keys = sets.mapInArrow(tree_keys, row)
    pairs = None
    for r in range(rounds + 1):
        seen = cut(_spread(keys).mapInArrow(neighbours(region), scanned))
        found = seen.filter("a is not null").select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        full = seen.filter("a is null").select("region", "label", "cls", F.col("n").cast("int").alias("n"))
        if not full.limit(1).count():
            break
        if r == rounds:
            pairs = pairs.unionByName(group_pairs(full, ["region", "label"], "cls", region))
        else:
            keys = full.join(sets.select("cls", "set"), "cls").mapInArrow(branch_keys, row)
    return pairs.distinct()


def near_classes(classes: DataFrame, region: int = REGION) -> DataFrame:
    """a < b, common, together: linked classes, at least half of whose distinct runs occur in both."""
    sets = cut(classes.select("cls", "seq").mapInArrow(run_sets(), "cls long, n int, set array<long>"))
    pairs = forest_candidates(sets, region)
    held = sets.select("cls", "set")
    checked = (
        pairs.join(held.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a")
        .join(held.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
        .select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    )
    return checked.withColumn("together", F.col("total") - F.col("common")).filter("2 * common >= together").select("a", "b", "common", "together")


def near_duplicates(records: DataFrame, rec: str, seq: str, least: int = 16) -> DataFrame:
    """doc_id_a, doc_id_b: all pairs of records alike enough."""
    classes, membership = copy_classes(sequences(records, rec, seq, least))
    return record_pairs(near_classes(classes), membership)


def near_groups(records: DataFrame, rec: str, seq: str, least: int = 16) -> DataFrame:
    """doc_id, class_id, group_id, copies, links: each record with its copy class, its group and its class's links to other classes."""
    classes, membership = copy_classes(sequences(records, rec, seq, least))
    pairs = cut(near_classes(classes).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    labels = components(pairs).select(F.col("node").alias("cls"), F.col("label"))
    each = classes.select("cls", "members").join(links, "cls", "left").join(labels, "cls", "left")
    return membership.join(each, "cls").select(
        F.col("rec").alias("doc_id"), F.col("cls").alias("class_id"), F.coalesce("label", "cls").alias("group_id"), F.col("members").alias("copies"), F.coalesce("links", F.lit(0)).alias("links")
    )
