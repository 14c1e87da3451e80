"""Queries of the problems tagged llm, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canzona.llm import formdup, leakage, names, neardup, packing, quality, spans, termcount


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _terms(s: SparkSession, d: str) -> DataFrame:
    return termcount.figure_terms(table(s, d, "figures"), table(s, d, "postings"), table(s, d, "works"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return _terms(s, d).filter("mark is not null").select("stratum", "term", "mark")


def p5_terms(s: SparkSession, d: str) -> DataFrame:
    return _terms(s, d)


def p5_stored(s: SparkSession, d: str) -> DataFrame:
    """Where the stored counts of figures are wrong or missing."""
    return termcount.stored_counts(table(s, d, "figures"), table(s, d, "postings"), table(s, d, "works"))


def _collapsed(s: SparkSession, d: str) -> DataFrame:
    return formdup.collapse(formdup.canonical(table(s, d, "works"), "doc_id", "ext_id", ["title", "artist"]))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return _collapsed(s, d).filter("rec <> kept").select(F.col("kept").alias("doc_id_kept"), F.col("rec").alias("doc_id_copy"))


def p7_kept(s: SparkSession, d: str) -> DataFrame:
    """Every record kept with the number of records that it stands for, records without an id in themselves included."""
    groups = _collapsed(s, d).filter("rec = kept").select(F.col("rec").alias("doc_id"), "copies")
    ids = table(s, d, "works").select("doc_id", "ext_id").filter("doc_id is not null")
    loose = ids.groupBy("doc_id").agg(F.max(formdup.folded(F.col("ext_id"))).alias("k")).filter("k = ''").select("doc_id", F.lit(1).cast("long").alias("copies"))
    return groups.unionByName(loose)


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(s, d, "works"), "doc_id", "pitches")


def p2_groups(s: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(s, d, "works"), "doc_id", "pitches")


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(s, d, "works"), "doc_id", "pitches")


def p4_shared(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(s, d, "works"), "doc_id", "pitches")


def p4_places(s: SparkSession, d: str) -> DataFrame:
    places = table(s, d, "postings").join(table(s, d, "figures").select("figure_id", "n"), "figure_id").select("doc_id", "first_pos", "n")
    return spans.places_in_stretches(spans.shared_stretches(table(s, d, "works"), "doc_id", "pitches"), places)


def p8_assign(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(s, d, "documents"), "doc_id", "text")).withColumnRenamed("rec", "doc_id")


def p8_fill(s: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_assign(s, d))


def _quality(s: SparkSession, d: str) -> DataFrame:
    return quality.page_quality(table(s, d, "documents"), "doc_id", "text", quality.common_words(table(s, d, "common_words")))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return _quality(s, d).filter("junk_probability >= 0.5").select(F.col("rec").alias("doc_id"))


def p10_statistics(s: SparkSession, d: str) -> DataFrame:
    return _quality(s, d).withColumnRenamed("rec", "doc_id")


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(s, d, "documents"), table(s, d, "heldout"))


def p9_paraphrases(s: SparkSession, d: str) -> DataFrame:
    """Pages that tell a passage in other words."""
    return leakage.paraphrased(table(s, d, "documents"), table(s, d, "heldout"))


def p9_items(s: SparkSession, d: str) -> DataFrame:
    """For every held-out item, the number of pages that leak it."""
    pages = p9_found(s, d).groupBy("item_id").agg(F.count("*").alias("pages"))
    return table(s, d, "heldout").select("item_id", "suite").join(pages, "item_id", "left").fillna(0, ["pages"])


def _named(s: SparkSession, d: str) -> DataFrame:
    return names.named(names.mentions(table(s, d, "works"), table(s, d, "edges")), table(s, d, "artists"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _named(s, d).select("field", "rec", "artist_id").distinct()


def p1_spellings(s: SparkSession, d: str) -> DataFrame:
    """Every star: the known name, each of its spellings and how often it was typed."""
    found = _named(s, d).groupBy("artist_id", "value", "score").agg(F.count("*").alias("rows"))
    return found.join(table(s, d, "artists").select("artist_id", "name"), "artist_id").select("artist_id", "name", F.col("value").alias("spelling"), F.round("score", 6).alias("score"), "rows")


QUERIES = {"p1_found": p1_found, "p1_spellings": p1_spellings, "p9_found": p9_found, "p9_items": p9_items, "p9_paraphrases": p9_paraphrases, "p10_found": p10_found, "p10_statistics": p10_statistics, "p8_assign": p8_assign, "p8_fill": p8_fill, "p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p4_shared": p4_shared, "p4_places": p4_places, "p5_found": p5_found, "p5_terms": p5_terms, "p5_stored": p5_stored, "p7_found": p7_found, "p7_kept": p7_kept}

_TERMS = """WITH f AS (SELECT figure_id, stratum, regexp_replace(fkey, '[\\s\\x{a0}]+', '', 'g') AS bare FROM figures),
t AS (SELECT figure_id, stratum, lower(split_part(bare, ':', 1)) || substr(bare, length(split_part(bare, ':', 1)) + 1) AS term FROM f),
p AS (SELECT t.stratum, t.term, p.doc_id FROM postings p JOIN t USING (figure_id) WHERE p.doc_id IN (SELECT doc_id FROM works)),
c AS (SELECT stratum, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM p GROUP BY ALL),
z AS (SELECT stratum, count(DISTINCT doc_id) AS size FROM works GROUP BY ALL),
r AS (SELECT v.stratum, v.term, coalesce(c.occurrences, 0) AS occurrences, coalesce(c.records, 0) AS records,
  CASE WHEN coalesce(c.records, 0) <= 1 THEN 'rare' WHEN c.records * 100 > coalesce(z.size, 0) THEN 'common' END AS mark
  FROM (SELECT DISTINCT stratum, term FROM t) v LEFT JOIN c ON c.stratum = v.stratum AND c.term = v.term LEFT JOIN z ON z.stratum = v.stratum)
"""
_STORED = """WITH f AS (SELECT figure_id, stratum, df, df_dated, regexp_replace(fkey, '[\\s\\x{a0}]+', '', 'g') AS bare FROM figures),
t AS (SELECT figure_id, stratum, df, df_dated, lower(split_part(bare, ':', 1)) || substr(bare, length(split_part(bare, ':', 1)) + 1) AS term FROM f),
y AS (SELECT doc_id, max(year) AS year FROM works GROUP BY 1),
c AS (SELECT t.stratum, t.term, count(DISTINCT p.doc_id) AS records, count(DISTINCT p.doc_id) FILTER (WHERE y.year IS NOT NULL) AS dated
  FROM postings p JOIN t USING (figure_id) JOIN y ON y.doc_id = p.doc_id GROUP BY ALL)
SELECT t.figure_id, t.df, coalesce(c.records, 0) AS records, t.df_dated, coalesce(c.dated, 0) AS dated,
  CASE WHEN t.df IS NULL OR t.df_dated IS NULL THEN 'missing' WHEN t.df = coalesce(c.records, 0) AND t.df_dated = coalesce(c.dated, 0) THEN 'right' ELSE 'wrong' END AS state
FROM t LEFT JOIN c ON c.stratum = t.stratum AND c.term = t.term WHERE t.term IS NOT NULL AND t.stratum IS NOT NULL"""
_FOLD = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_KEYS = f"""WITH k AS (SELECT DISTINCT doc_id, {_FOLD.format('ext_id')} AS e,
  array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(coalesce(title, '') || ' ' || coalesce(artist, ''), '[\\s\\x{{a0}}]+'),
    lambda w: {_FOLD.format('w')}), lambda w: w <> '')), ' ') AS words FROM works),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY e, words) AS kept, count(*) OVER (PARTITION BY e, words) AS copies FROM k WHERE e <> '')
"""
_SEQS = "WITH w AS (SELECT doc_id, max(pitches) AS p FROM works WHERE pitches IS NOT NULL GROUP BY 1),\n"
_RUNS = _SEQS + """s AS (SELECT DISTINCT doc_id, p[i:i+4] AS g FROM (SELECT doc_id, p, unnest(range(1, len(p) - 3)) AS i FROM w WHERE len(p) >= 16)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 2 * k >= x.c + y.c - k)
"""
_SPANS = _SEQS + """k AS (SELECT doc_id, i - 1 AS pos, p[i:i+23] AS g, len(p) AS tokens FROM (SELECT doc_id, p, unnest(range(1, len(p) - 22)) AS i FROM w WHERE len(p) >= 24)),
r AS (SELECT g FROM k GROUP BY g HAVING count(DISTINCT doc_id) > 1),
cov AS (SELECT doc_id, any_value(tokens) AS tokens, count(DISTINCT c) AS shared_tokens FROM (SELECT doc_id, tokens, unnest(range(pos, pos + 24)) AS c FROM k JOIN r USING (g)) GROUP BY 1)
"""
SQL = {
    "p2_found": _RUNS + "SELECT a AS doc_id_a, b AS doc_id_b FROM pairs",
    "p4_found": _SPANS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id",
    "p4_shared": _SPANS + "SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, shared_tokens, round(shared_tokens / tokens, 6) AS share FROM cov",
    "p5_found": _TERMS + "SELECT stratum, term, mark FROM r WHERE mark IS NOT NULL",
    "p5_stored": _STORED,
    "p5_terms": _TERMS + "SELECT * FROM r",
    "p7_found": _KEYS + "SELECT kept AS doc_id_kept, doc_id AS doc_id_copy FROM g WHERE doc_id <> kept",
    "p7_kept": _KEYS + "SELECT doc_id, copies FROM g WHERE doc_id = kept UNION ALL SELECT DISTINCT doc_id, 1 FROM k WHERE e = ''",
}
