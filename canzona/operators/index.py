"""The stratified index of figures: building, counting and looking up. Counts stay per stratum and are never pooled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.functions import encode as E

#: Notes whose windows are counted at once; a work is never divided.
NOTES_AT_ONCE = 50_000


def distinct_works(works: DataFrame) -> DataFrame:
    """One row for each doc_id, its first by added_at; a retried load adds nothing."""
    first = F.struct("added_at", F.coalesce("removed_at", F.lit("9999-12-31").cast("timestamp_ntz")))
    row = F.struct(*[c for c in works.columns if c != "doc_id"])
    return works.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(row, first).alias("_w")).select("doc_id", "_w.*")


def add_works(existing: DataFrame, incoming: DataFrame, least: int = min(E.LENGTHS)) -> DataFrame:
    """The works of incoming to be added: long enough, not yet there by (stratum, ext_id), each once."""
    fresh = incoming.filter(F.size("pitches") >= least).join(existing.select("stratum", "ext_id").distinct(), ["stratum", "ext_id"], "left_anti")
    return fresh.withColumn("_r", F.row_number().over(W.partitionBy("stratum", "ext_id").orderBy("doc_id"))).filter("_r = 1").drop("_r")


def unregistered(works: DataFrame, strata: DataFrame) -> DataFrame:
    """Works of strata that are not registered; an index is only built if there are none."""
    return works.join(strata.select(F.col("name").alias("stratum")), "stratum", "left_anti")


def windows(works: DataFrame, lengths=E.LENGTHS, encodings=E.INDEXED) -> DataFrame:
    """doc_id, stratum, year, encoding, n, pos, body: every window of every work. Encoded once a work, then sliced."""
    long_enough = works.filter(F.size("pitches") >= min(lengths)).withColumn("_tonic", (E.best_key(F.col("pitches")) / 2).cast("int"))
    coded = F.array(*[F.struct(F.lit(e).alias("encoding"), E.tokens(F.col("pitches"), e, F.col("_tonic")).alias("toks"), F.lit(int(e not in ("pitch", "scale_degree"))).alias("less")) for e in encodings])
    each = long_enough.select("doc_id", "stratum", "year", F.size("pitches").alias("notes"), F.explode(coded).alias("c"))
    each = each.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).filter("notes >= n")
    pos = F.explode(F.sequence(F.lit(0), F.col("notes") - F.col("n")))
    return each.withColumn("pos", pos).select(
        "doc_id", "stratum", "year", F.col("c.encoding").alias("encoding"), "n", "pos", F.array_join(F.slice("c.toks", F.col("pos") + 1, F.col("n") - F.col("c.less")), ",").alias("body")
    )


def _codes(pitches: np.ndarray, unknown: np.ndarray, encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all works in a row as whole numbers from 0, one a note, and where a token is NULL. Intervals stand at their first note."""
    if encoding in ("pitch", "scale_degree"):
        # scale degrees are a work's pitch classes turned by its tonic, so the same windows are alike in both
        return pitches % 12, unknown
    step, lost = np.diff(pitches, append=pitches[-1:]), unknown | np.append(unknown[1:], False)
    if encoding == "interval":
        return step - step.min(), lost
    step[lost] = -1 if encoding == "contour_refined" else 0  # as `contour` has it
    wide = (step > E.LEAP).astype(np.int64) - (step < -E.LEAP) if encoding == "contour_refined" else 0
    code = np.sign(step) + wide
    return code - code.min(), np.zeros(len(code), bool)


def _kinds(notes: np.ndarray, code: np.ndarray, less: int, lengths) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """n, works, kinds: for each length the works (by place) that have it, and how many different windows each has.

    A window's label is its work and then its tokens, as the digits of one number; a longer window adds a digit. Windows differ if
    their beginnings do, so only those go on whose beginning is in their work twice. Ranks replace the labels that were compared, and
    those that would pass 63 bits.
    """
    base, many = int(code.max()) + 1, len(notes)
    at = np.arange(len(code))
    work = label = np.repeat(np.arange(many), notes)
    left = np.repeat(np.cumsum(notes), notes) - at
    for n in range(less + 1, max(lengths) + 1):
        stays = left[at] >= n
        at, label = at[stays], label[stays]
        label, many = label * base + code[at + n - less - 1], many * base
        if n not in lengths and many * base < 2**63:
            continue
        order = np.argsort(label)
        at, label = at[order], label[order]
        again = np.zeros(len(label), bool)
        np.equal(label[1:], label[:-1], out=again[1:])
        if n in lengths:
            works = np.flatnonzero(notes >= n)
            yield n, works, notes[works] - n + 1 - np.bincount(work[at[again]], minlength=len(notes))[works]
        twice = again.copy()
        twice[:-1] |= again[1:]
        at, label = at[twice], np.cumsum(~again[twice]) - 1
        many = max(1, len(label) // 2)  # each rank is there twice at least


def _kinds_with_nulls(code: list, windows: int, width: int) -> int:
    """Different windows of one work's tokens: NULL tokens are left out of a window's text, and one without any other has no text."""
    return len({w for i in range(windows) if (w := tuple(t for t in code[i : i + width] if t is not None))})


def window_counts(works: DataFrame, lengths=E.LENGTHS, encodings=E.INDEXED, at_once: int = NOTES_AT_ONCE) -> DataFrame:
    """doc_id, encoding, n, windows, kinds, pos_sum: of all `windows` of a work how many there are, how many differ, and the sum of their places.

    works has one row a work. Its windows are counted there and none leaves it, so neither a shuffle nor a spill follows their number.
    """

    def part(ids: pa.Array, notes: np.ndarray, flat: pa.Array) -> Iterator[pa.RecordBatch]:
        unknown = np.asarray(flat.is_null())
        pitches = np.asarray(flat.fill_null(0), dtype=np.int64)
        first = np.cumsum(notes) - notes
        for encoding in encodings:
            less = int(encoding not in ("pitch", "scale_degree"))
            code, lost = _codes(pitches, unknown, encoding)
            holes = np.flatnonzero(np.add.reduceat(lost, first, dtype=np.int64)) if lost.any() else ()
            texts = {k: [None if x else c for c, x in zip(code[s : s + m].tolist(), lost[s : s + m])] for k, s, m in ((k, first[k], notes[k]) for k in holes)}
            found = []
            for n, who, kinds in _kinds(notes, code, less, lengths):
                windows = notes[who] - n + 1
                for k in texts:
                    if notes[k] >= n:
                        kinds[np.searchsorted(who, k)] = _kinds_with_nulls(texts[k], int(notes[k]) - n + 1, n - less)
                found.append((who, np.full(len(who), n, np.int32), windows, kinds, windows * (windows - 1) // 2))
            if found:
                who, *counts = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.repeat(encoding, len(who)), *map(pa.array, counts)], names=["doc_id", "encoding", "n", "windows", "kinds", "pos_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, flat = b.column("doc_id"), b.column("pitches").flatten()
            notes = np.asarray(b.column("pitches").value_lengths(), dtype=np.int64)
            first = np.cumsum(notes) - notes
            cuts = [0, *(np.flatnonzero(np.diff(first // at_once)) + 1).tolist(), len(notes)]
            for a, z in zip(cuts, cuts[1:]):
                if a < z:
                    yield from part(ids[a:z], notes[a:z], flat[first[a] : first[z - 1] + notes[z - 1]])

    return (
        works.filter(F.size("pitches") >= min(lengths)).select("doc_id", "pitches")
        .mapInArrow(run, "doc_id long, encoding string, n int, windows long, kinds long, pos_sum long")
    )


def postings(works: DataFrame, lengths=E.LENGTHS, encodings=E.INDEXED) -> DataFrame:
    """One row a figure and work, with its first place.

    All windows of a work lie in its row, so a work's repeated figures fall together there, by sorting its windows; nothing is shuffled.
    """
    long_enough = works.filter(F.size("pitches") >= min(lengths)).withColumn("_tonic", (E.best_key(F.col("pitches")) / 2).cast("int"))
    coded = F.array(*[F.struct(F.lit(e).alias("encoding"), E.tokens(F.col("pitches"), e, F.col("_tonic")).alias("toks"), F.lit(int(e not in ("pitch", "scale_degree"))).alias("less")) for e in encodings])
    each = long_enough.select("doc_id", "stratum", "year", F.size("pitches").alias("notes"), F.explode(coded).alias("c"))
    each = each.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).filter("notes >= n").select("doc_id", "stratum", "year", F.col("c.encoding").alias("encoding"), "n", F.col("c.toks").alias("toks"), (F.col("n") - F.col("c.less")).alias("width"), (F.col("notes") - F.col("n")).alias("last"))
    placed = each.withColumn("sorted", F.array_sort(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.struct(F.array_join(F.slice("toks", i + 1, F.col("width")), ",").alias("body"), i.alias("pos")))))
    once = F.filter("sorted", lambda x, i: (i == 0) | (F.get(F.col("sorted"), i - 1)["body"] != x["body"]))
    key = F.concat_ws(":", "encoding", F.col("n").cast("string"), "w.body")
    return placed.select("stratum", "encoding", "n", "doc_id", "year", F.explode(once).alias("w")).select("stratum", "encoding", "n", key.alias("fkey"), "doc_id", F.col("w.pos").alias("first_pos"), "year")


def figures(posted: DataFrame) -> DataFrame:
    """df, df_dated and earliest of each figure in each stratum; posted has one row a figure and work."""
    return posted.groupBy("stratum", "encoding", "n", "fkey").agg(
        F.count("*").alias("df"), F.count("year").alias("df_dated"), F.min("year").alias("earliest")
    )


def predates(year: Column, reference: int) -> Column:
    """The one rule of dates: known, and strictly before the reference year."""
    return year.isNotNull() & (year < reference)


def count_before(posted: DataFrame, reference: int) -> DataFrame:
    return posted.groupBy("stratum", "fkey").agg(F.count("*").alias("n_works"), F.count_if(predates(F.col("year"), reference)).alias("m_works"))


def rarity(figs: DataFrame) -> DataFrame:
    """Percentile of each figure: the share of strictly rarer ones of its stratum, encoding and length.

    Distinct df values are few, so figures are counted by df first; the window then runs over these counts only.
    """
    cell = ["stratum", "encoding", "n"]
    by_df = figs.groupBy(*cell, "df").agg(F.count("*").alias("_c"))
    part = W.partitionBy(*cell)
    ranks = by_df.withColumn("_below", F.sum("_c").over(part.orderBy("df")) - F.col("_c")).withColumn("_all", F.sum("_c").over(part))
    share = ranks.select(*cell, "df", F.round(100 * F.col("_below") / F.col("_all"), 6).alias("percentile"))
    return figs.join(share, [*cell, "df"])


def matches(posted: DataFrame, works: DataFrame, limit: int) -> DataFrame:
    """The first `limit` works of each figure, dated ones first."""
    order = W.partitionBy("stratum", "fkey").orderBy(F.col("year").asc_nulls_last(), "doc_id")
    top = posted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return top.join(works.select("doc_id", "title", "artist", "tradition"), "doc_id")


def statistics(works: DataFrame, posted: DataFrame, figs: DataFrame) -> DataFrame:
    counts = [works.select(F.lit("documents").alias("what"), F.lit(1).alias("x")), figs.select(F.lit("figures").alias("what"), F.lit(1).alias("x")), posted.select(F.lit("postings").alias("what"), F.lit(1).alias("x"))]
    return reduce(DataFrame.unionByName, [c.groupBy("what").agg(F.count("*").alias("rows")) for c in counts])
