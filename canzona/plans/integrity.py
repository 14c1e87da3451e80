"""Queries over hierarchies and references: problems 3 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canzona.operators.hierarchy import descendants, hierarchy
from canzona.operators.orphans import orphans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges"), paths=True).select("node", F.array_join("path", " > ").alias("path"), "depth", "status")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(table(spark, d, "edges"), paths=True))


def p3_rings(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges")).filter("status <> 'tree'").groupBy("root").agg(
        F.sum((F.col("status") == "cycle").cast("long")).alias("ring_nodes"),
        F.sum((F.col("status") == "below_cycle").cast("long")).alias("hanging_nodes"),
        F.max("depth").alias("deepest"),
    )


def _orphan_postings(spark: SparkSession, d: str, distinct: bool) -> DataFrame:
    refs = table(spark, d, "postings").select("figure_id", "doc_id", "flushed_at")
    refs = refs.distinct() if distinct else refs
    figures = orphans(refs, table(spark, d, "figures"), "figure_id", "flushed_at").withColumn("target", F.lit("figures"))
    works = orphans(refs, table(spark, d, "works"), "doc_id", "flushed_at", "added_at", "removed_at").withColumn("target", F.lit("works"))
    return figures.unionByName(works)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphan_postings(spark, d, True).select("target", "reason", "period", "figure_id", "doc_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphan_postings(spark, d, False).groupBy("target", "reason", "period").agg(F.count("*").alias("postings"))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_rings": p3_rings, "p6_found": p6_found, "p6_report": p6_report}

_LATEST = """WITH RECURSIVE best AS (
  SELECT src AS node, arg_max(dst, fetched_at) AS parent FROM edges GROUP BY src),
ids AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
up AS (SELECT i.node, b.parent FROM ids i LEFT JOIN best b ON i.node = b.node),
ring_walk AS (
  SELECT node AS start, parent AS pos, 1 AS steps FROM up WHERE parent IS NOT NULL
  UNION
  SELECT w.start, u.parent, w.steps + 1 FROM ring_walk w JOIN up u ON u.node = w.pos
  WHERE u.parent IS NOT NULL AND w.pos <> w.start AND w.steps < 200),
on_ring AS (SELECT DISTINCT start AS node FROM ring_walk WHERE pos = start),
ring_min AS (
  SELECT w.start AS node, min(w.pos) AS root FROM ring_walk w JOIN on_ring r ON r.node = w.start GROUP BY w.start),
tree AS (
  SELECT node, node AS root, 0 AS depth, 'tree' AS status, node AS path FROM up WHERE parent IS NULL
  UNION ALL
  SELECT node, root, 0, 'cycle', node FROM ring_min
  UNION ALL
  SELECT u.node, t.root, t.depth + 1, CASE WHEN t.status = 'tree' THEN 'tree' ELSE 'below_cycle' END, t.path || ' > ' || u.node
  FROM tree t JOIN up u ON u.parent = t.node WHERE u.node NOT IN (SELECT node FROM on_ring))
"""
_ORPHANS = """SELECT DISTINCT 'figures' AS target, 'missing' AS reason, strftime(p.flushed_at, '%Y-%m') AS period, p.figure_id, p.doc_id, p.flushed_at, p.first_pos, p.rid
FROM (SELECT *, row_number() OVER () AS rid FROM postings) p WHERE p.figure_id NOT IN (SELECT figure_id FROM figures)
UNION ALL
SELECT 'works', CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN s.first_at > p.flushed_at THEN 'late' ELSE 'deleted' END,
  strftime(p.flushed_at, '%Y-%m'), p.figure_id, p.doc_id, p.flushed_at, p.first_pos, p.rid
FROM (SELECT *, row_number() OVER () AS rid FROM postings) p
LEFT JOIN (SELECT doc_id, min(added_at) AS first_at FROM works GROUP BY doc_id) s ON s.doc_id = p.doc_id
WHERE NOT EXISTS (SELECT 1 FROM works w WHERE w.doc_id = p.doc_id AND w.added_at <= p.flushed_at AND (w.removed_at IS NULL OR w.removed_at > p.flushed_at))"""
SQL = {
    "p3_found": _LATEST + "SELECT node, root, depth, status FROM tree",
    "p3_paths": _LATEST + "SELECT node, path, depth, status FROM tree",
    "p3_descendants": _LATEST + """, pairs AS (
  SELECT node AS ancestor, node, 0 AS distance FROM tree
  UNION ALL
  SELECT p.ancestor, u.node, p.distance + 1 FROM pairs p JOIN up u ON u.parent = p.node WHERE u.node NOT IN (SELECT node FROM on_ring))
SELECT ancestor, node, distance FROM pairs WHERE distance > 0""",
    "p3_rings": _LATEST + """SELECT root, CAST(sum(CASE WHEN status = 'cycle' THEN 1 ELSE 0 END) AS BIGINT) AS ring_nodes,
CAST(sum(CASE WHEN status = 'below_cycle' THEN 1 ELSE 0 END) AS BIGINT) AS hanging_nodes, max(depth) AS deepest FROM tree WHERE status <> 'tree' GROUP BY root""",
    "p6_found": f"SELECT DISTINCT target, reason, period, figure_id, doc_id FROM ({_ORPHANS})",
    "p6_report": f"SELECT target, reason, period, count(*) AS postings FROM ({_ORPHANS}) GROUP BY ALL",
}
