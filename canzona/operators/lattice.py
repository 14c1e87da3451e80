"""Uncertain queries: the readings of a lattice, and expectation and variance of counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Width of the beam and least probability of a reading.
BEAM, LEAST = 64, 1e-4
_PATHS = "array<struct<ps:array<int>,pr:double>>"


def readings(slots: Column, beam: int = BEAM, least: float = LEAST) -> Column:
    """The most probable readings, best first, ties in the order of generation.

    slots: array of arrays of (pitch, w). Candidates without weight and empty slots are passed over. After each slot the best
    `beam` remain, of these the ones of at least `least`, or the single best if none is.
    """

    def extend(paths: Column, slot: Column) -> Column:
        usable = F.filter(slot, lambda c: c["w"] > 0)
        grown = F.flatten(F.transform(paths, lambda a: F.transform(usable, lambda c: F.struct(F.concat(a["ps"], F.array(c["pitch"])).alias("ps"), (a["pr"] * c["w"]).alias("pr")))))
        ranked = F.array_sort(F.transform(grown, lambda x, i: F.struct((-x["pr"]).alias("o"), i.alias("i"), x["ps"].alias("ps"), x["pr"].alias("pr"))))
        top = F.slice(F.transform(ranked, lambda x: F.struct(x["ps"].alias("ps"), x["pr"].alias("pr"))), 1, beam)
        kept = F.filter(top, lambda x: x["pr"] >= least)
        return F.when(F.size(usable) == 0, paths).when(F.size(kept) > 0, kept).otherwise(F.slice(top, 1, 1)).cast(_PATHS)

    seed = F.array(F.struct(F.array().cast("array<int>").alias("ps"), F.lit(1.0).alias("pr"))).cast(_PATHS)
    return F.when(F.size(slots) == 0, F.array().cast(_PATHS)).otherwise(F.aggregate(slots, seed, extend))


def first_reading(slots: Column) -> Column:
    """The first candidate of each slot that has any."""
    return F.transform(F.filter(slots, lambda s: F.size(s) > 0), lambda s: F.element_at(s, 1)["pitch"])


def entropy(slots: Column) -> Column:
    """Bits over all slots."""
    return F.aggregate(F.flatten(slots), F.lit(0.0), lambda t, c: t - F.when(c["w"] > 0, c["w"] * F.log2(c["w"])).otherwise(0.0))


def certain(pitches: Column) -> Column:
    """A typed sequence as a lattice of one candidate a slot."""
    return F.transform(pitches, lambda p: F.array(F.struct(p.alias("pitch"), F.lit(1.0).alias("w"))))


def exploded(queries: DataFrame, slots: str = "slots") -> DataFrame:
    """queries with one row a reading: ordinal, pitches, prob."""
    return queries.select("*", F.posexplode(readings(F.col(slots))).alias("ordinal", "_r")).select("*", F.col("_r.ps").alias("reading"), F.col("_r.pr").alias("prob")).drop("_r")


def estimates(counted: DataFrame, by: list[str]) -> DataFrame:
    """expected, variance, top1, paths, mass, modal for each group of readings with their count `hits`."""
    p, n = F.col("prob"), F.col("hits")
    sums = counted.groupBy(*by).agg(
        F.sum(p).alias("mass"), F.sum(p * n).alias("_e"), F.sum(p * n * n).alias("_q"), F.count("*").alias("paths"),
        F.max(F.when(F.col("ordinal") == 0, n)).alias("top1"), F.max(F.when(F.col("ordinal") == 0, p)).alias("_m"),
    )
    e = F.col("_e") / F.col("mass")
    return sums.select(*by, e.alias("expected"), F.greatest(F.col("_q") / F.col("mass") - e * e, F.lit(0.0)).alias("variance"), "top1", "paths", "mass", (F.col("_m") / F.col("mass")).alias("modal"))


def interval(expected: Column, variance: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Rounded bounds, half to even, the lower one not below 0."""
    half = z * F.sqrt(F.greatest(variance, F.lit(0.0)))
    return F.greatest(F.lit(0), F.bround(expected - half, 0)).cast("long"), F.bround(expected + half, 0).cast("long")
