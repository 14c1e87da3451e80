"""The derivation graph: upserts, bounded lineage and Katz centrality over edges src (derivative) -> dst (antecedent)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.session import cut


def upsert(edges: DataFrame) -> DataFrame:
    """The latest row of each (src, dst, source)."""
    latest = F.row_number().over(W.partitionBy("src", "dst", "source").orderBy(F.col("fetched_at").desc_nulls_last()))
    return edges.withColumn("_r", latest).filter("_r = 1").drop("_r")


def find_node(edges: DataFrame, query: str) -> str | None:
    """The id of the first label, in order of fetching, that contains the query in any case."""
    at = F.struct("fetched_at", "src", "dst", "source")
    ends = edges.select(at.alias("at"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("src").alias("id"), F.col("src_label").alias("label")), F.struct(F.lit(1).alias("k"), F.col("dst").alias("id"), F.col("dst_label").alias("label")))).alias("e"))
    row = ends.filter(F.contains(F.lower("e.label"), F.lit(query.lower().strip()))).agg(F.min(F.struct("at", "e.k", "e.id")).alias("m")).first()
    return row["m"]["id"] if row and row["m"] else None


def walk(edges: DataFrame, start: str, forward: bool, depth: int = 3) -> DataFrame:
    """node, depth: what is reached from start within depth steps, each once at its least depth."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("far")).distinct()
    seen = frontier = cut(edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int"))
    for k in range(1, depth + 1):
        new = steps.join(frontier.select("node"), "node").select(F.col("far").alias("node")).distinct()
        frontier = cut(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def katz(edges: DataFrame, alpha: float = 0.1, beta: float = 1.0, rounds: int = 100, tolerance: float = 1e-9, flush: int = 4) -> DataFrame:
    """node, score = beta * sum of alpha^k times the walks of k steps that end in the node. Repeated links count once.

    Rounds go on until no node gains more than the tolerance. Where alpha is not below the inverse of the graph's largest
    eigenvalue the sum has no limit, and an error tells so after `rounds` rounds.
    """
    links = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    gain = nodes.withColumn("s", F.lit(float(beta)))
    parts = []
    for k in range(1, rounds + 1):
        parts.append(gain)
        gain = links.join(gain.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.sum("s") * alpha).alias("s"))
        if k % flush == 0:
            gain = cut(gain)
            if not gain.filter(F.abs("s") > tolerance).limit(1).count():
                return reduce(DataFrame.unionByName, [*parts, gain]).groupBy("node").agg(F.sum("s").alias("score"))
    if links.limit(1).count():
        raise ValueError(f"no convergence in {rounds} rounds: alpha {alpha} is too large for this graph")
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("s").alias("score"))
