"""Notes to phrases to hooks: gaps, sessions, the best window, recurrence and its score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.functions.encode import intervals, sequence_similarity

# The rest that ends a phrase, its longest and shortest length, distinct pitches and similarity of a recurrence.
REST, LONGEST, SHORTEST, DISTINCT, SIMILAR = 0.18, 16, 4, 3, 0.72


def _in_work():
    return W.partitionBy("doc_id").orderBy("pos")


def gaps(notes: DataFrame) -> DataFrame:
    """notes (doc_id, pos, pitch, onset, duration, conf) with the silence before each."""
    return notes.withColumn("gap", F.col("onset") - F.lag(F.col("onset") + F.col("duration")).over(_in_work()))


def sessions(notes: DataFrame) -> DataFrame:
    """doc_id, start, end (exclusive), notes, pitches, conf of each phrase long enough."""
    island = gaps(notes).withColumn("island", F.sum(F.coalesce((F.col("gap") > REST).cast("int"), F.lit(0))).over(_in_work()))
    cell = island.withColumn("part", F.floor((F.row_number().over(W.partitionBy("doc_id", "island").orderBy("pos")) - 1) / LONGEST))
    made = cell.groupBy("doc_id", "island", "part").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("notes"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "pitch"))), lambda x: x["pitch"]).alias("pitches"), F.avg("conf").alias("conf"),
    )
    return made.filter(F.col("notes") >= SHORTEST).drop("island", "part")


def melodic(phrases: DataFrame) -> DataFrame:
    return phrases.filter(F.size(F.array_distinct("pitches")) >= DISTINCT)


def recurrences(phrases: DataFrame) -> DataFrame:
    """doc_id, start, reps: how many other phrases of the same work are alike. A work has few phrases; equal ones meet by key."""
    p = phrases.select("doc_id", "start", intervals(F.col("pitches")).alias("iv"), F.size("pitches").alias("n"))
    other = p.select("doc_id", F.col("start").alias("start2"), F.col("iv").alias("iv2"), F.col("n").alias("n2"))
    # a common subsequence is no longer than the shorter phrase
    near = p.join(other, "doc_id").filter((F.col("start") != F.col("start2")) & (F.least("n", "n2") - 1 >= SIMILAR * (F.greatest("n", "n2") - 1)))
    alike = near.filter((F.col("iv") == F.col("iv2")) | (sequence_similarity(F.col("iv"), F.col("iv2")) >= SIMILAR))
    return p.select("doc_id", "start").join(alike.groupBy("doc_id", "start").agg(F.count("*").alias("reps")), ["doc_id", "start"], "left").fillna(0, ["reps"])


def hooks(phrases: DataFrame, top: int | None = None) -> DataFrame:
    """doc_id, start, end, reps, score and place of the melodic phrases, best first."""
    m = melodic(phrases)
    score = (1 + F.col("reps")) * (0.55 + 0.25 * F.least(F.col("notes"), F.lit(12)) / 12 + 0.2 * F.col("conf"))
    ranked = m.join(recurrences(m), ["doc_id", "start"]).withColumn("score", F.round(score, 9))
    placed = ranked.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("score").desc(), "start")))
    return (placed.filter(F.col("place") <= top) if top else placed).select("doc_id", "start", "end", "reps", "score", "place")


def best_window(notes: DataFrame, n: int) -> DataFrame:
    """doc_id, lo: the earliest of the n-note windows with the highest mean confidence."""
    w = _in_work().rowsBetween(0, n - 1)
    each = notes.withColumn("m", F.round(F.avg("conf").over(w), 9)).withColumn("c", F.count("*").over(w)).filter(F.col("c") == n)
    return each.groupBy("doc_id").agg(F.max_by("pos", F.struct("m", (-F.col("pos")).alias("o"))).alias("lo"), F.max("m").alias("mean"))
