"""Queries over phrases, lattices, verdicts, the derivation graph and sources, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from canzona.functions import encode as E
from canzona.functions.signal import SHORTEST_NOTE
from canzona.operators import card as C
from canzona.operators import graph as G
from canzona.operators import index as I
from canzona.operators import lattice as L
from canzona.operators import phrases as H
from canzona.operators import verdict as V
from canzona.plans.figures import D, P, figs, index_sql, works
from canzona.plans.integrity import table
from canzona.session import cut, few
from canzona.sources import payloads as Y

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def note(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return note


# notes of every work, 0.4 s apart; a pitch divisible by seven sounds 0.2 s, others 0.3 s
N = f"""{D}, n AS (SELECT doc_id, pos, pitches[pos + 1] AS pitch, pos * 0.4::DOUBLE AS onset, CASE WHEN pitches[pos + 1] % 7 = 0 THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS duration,
  ((50 + (pitches[pos + 1] * 7 + pos) % 50) / 100.0)::DOUBLE AS conf FROM (SELECT doc_id, pitches, unnest(range(len(pitches))) AS pos FROM d))"""
_GAP = N + ", g AS (SELECT *, onset - lag(onset + duration) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM n)"
_PHR = _GAP + """, i AS (SELECT *, sum(CASE WHEN gap > 0.18 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g),
j AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) - 1) // 16 AS part FROM i),
ph AS (SELECT doc_id, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS notes, count(DISTINCT pitch) AS kinds, avg(conf) AS conf FROM j GROUP BY doc_id, island, part HAVING count(*) >= 4)"""


def notes(s: SparkSession, d: str) -> DataFrame:
    n = works(s, d).select("doc_id", F.posexplode("pitches").alias("pos", "pitch"))
    return n.select("doc_id", "pos", "pitch", (P("pos") * F.lit(0.4)).alias("onset"), F.when(P("pitch") % 7 == 0, 0.2).otherwise(0.3).alias("duration"), ((50 + (P("pitch") * 7 + P("pos")) % 50) / 100.0).alias("conf"))


# notes of 0.03 s for each unit of pitch modulo five; shorter ones than the limit are no notes
_LENGTHS = f"WITH {N} SELECT doc_id, pos, pitch, round((pitch % 5) * 0.03, 6)::DOUBLE AS duration FROM n"
add("flt_note_len", f"SELECT * FROM ({_LENGTHS}) WHERE duration >= {SHORTEST_NOTE}")(
    lambda s, d: notes(s, d).select("doc_id", "pos", "pitch", F.round((P("pitch") % 5) * F.lit(0.03), 6).alias("duration")).filter(P("duration") >= SHORTEST_NOTE))
add("win_gap", f"WITH {_GAP} SELECT doc_id, pos, round(gap, 6) AS gap FROM g")(lambda s, d: H.gaps(notes(s, d)).select("doc_id", "pos", F.round("gap", 6).alias("gap")))
add("win_phrase_session", f"WITH {_PHR} SELECT doc_id, start, stop FROM ph")(lambda s, d: H.sessions(notes(s, d)).select("doc_id", "start", P("end").alias("stop")))
add("flt_phrase_len", f"WITH {_PHR} SELECT doc_id, count(*) AS phrases FROM ph GROUP BY 1")(lambda s, d: H.sessions(notes(s, d)).groupBy("doc_id").agg(F.count("*").alias("phrases")))
add("flt_melodic", f"WITH {_PHR} SELECT doc_id, start FROM ph WHERE kinds >= 3")(lambda s, d: H.melodic(H.sessions(notes(s, d))).select("doc_id", "start"))
add("win_best_window", f"WITH {N}, w AS (SELECT doc_id, pos, round(avg(conf) OVER q, 9) AS m, count(*) OVER q AS c FROM n WINDOW q AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT doc_id, arg_max(pos, struct_pack(m := m, o := -pos)) AS lo FROM w WHERE c = 5 GROUP BY 1")(
    lambda s, d: H.best_window(notes(s, d), 5).select("doc_id", "lo"))
add("agg_mean_conf", f"WITH {N} SELECT doc_id, round(avg(conf), 6) AS mean_conf FROM n GROUP BY 1")(lambda s, d: notes(s, d).groupBy("doc_id").agg(F.round(F.avg("conf"), 6).alias("mean_conf")))
add("agg_diagnostics", f"WITH {_GAP} SELECT doc_id, count(*) AS n_notes, count(*) FILTER (gap > 0.18) AS wide_gaps, count(gap) AS gaps, round(list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1], 6) AS upper_median FROM g GROUP BY 1")(
    lambda s, d: H.gaps(notes(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_notes"), F.count_if(P("gap") > H.REST).alias("wide_gaps"), F.count("gap").alias("gaps"), F.sort_array(F.collect_list("gap")).alias("l"))
    .select("doc_id", "n_notes", "wide_gaps", "gaps", F.round(F.get("l", F.floor(P("gaps") / 2).cast("int")), 6).alias("upper_median")))
add("join_phrase_self")(lambda s, d: H.recurrences(H.melodic(H.sessions(notes(s, d)))))
# a work against its own reverse, both whole
add("lcs_similarity")(lambda s, d: works(s, d).select("doc_id", F.round(E.long_similarity(E.intervals(P()), E.intervals(F.reverse("pitches"))), 6).alias("similarity")))
add("agg_hook_score")(lambda s, d: H.hooks(H.sessions(notes(s, d))))
add("topk_hooks")(lambda s, d: H.hooks(H.sessions(notes(s, d)), 4))
add("stress_weights", f"WITH {N} SELECT doc_id, pos, CASE WHEN pos = max(pos) OVER (PARTITION BY doc_id) THEN 1.0 WHEN pos % 4 = 0 THEN 0.9 WHEN pos % 2 = 0 THEN 0.7 ELSE 0.4 END::DOUBLE AS weight FROM n")(
    lambda s, d: notes(s, d).select("doc_id", "pos", F.when(P("pos") == F.max("pos").over(W.partitionBy("doc_id")), 1.0).when(P("pos") % 4 == 0, 0.9).when(P("pos") % 2 == 0, 0.7).otherwise(0.4).alias("weight")))
add("join_onset_beat", f"WITH {N} SELECT doc_id, pos, CAST(round_even(onset / 0.5 - 1e-9, 0) AS BIGINT) AS beat FROM n")(
    lambda s, d: notes(s, d).withColumn("beats", F.transform(F.sequence(F.floor(P("onset") / 0.5).cast("int"), F.floor(P("onset") / 0.5).cast("int") + 1), lambda k: F.struct(F.round(F.abs(k * 0.5 - P("onset")), 9).alias("far"), k.alias("k"))))
    .select("doc_id", "pos", F.array_min("beats")["k"].cast("long").alias("beat")))
add("clip_window", f"WITH {_PHR} SELECT doc_id, start, CAST(round((start * 0.4 - 0.25) * 1000) AS BIGINT) AS from_ms, CAST(round((stop * 0.4 + 0.25) * 1000) AS BIGINT) AS to_ms FROM ph")(
    lambda s, d: H.sessions(notes(s, d)).select("doc_id", "start", F.round((P("start") * 0.4 - 0.25) * 1000).cast("long").alias("from_ms"), F.round((P("end") * 0.4 + 0.25) * 1000).cast("long").alias("to_ms")))
_POOL = f"{N}, pl AS (SELECT doc_id, pitch, sum(conf) AS mass FROM n GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(mass, 9) DESC, pitch) AS r FROM pl)"


def _pooled(s: SparkSession, d: str) -> DataFrame:
    mass = notes(s, d).groupBy("doc_id", "pitch").agg(F.sum("conf").alias("mass"))
    top = mass.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.round("mass", 9).desc(), "pitch"))).filter("r <= 3")
    return top.select("doc_id", "pitch", P("r").cast("long").alias("r"), F.round(P("mass") / F.sum("mass").over(W.partitionBy("doc_id")), 6).alias("posterior"))


add("agg_pool_posterior", f"WITH {_POOL} SELECT doc_id, pitch, r, round(mass / sum(mass) OVER (PARTITION BY doc_id), 6) AS posterior FROM rk WHERE r <= 3")(_pooled)
add("win_nlen_topk", f"WITH {_POOL} SELECT doc_id, pitch, r FROM rk WHERE r <= 3")(lambda s, d: _pooled(s, d).select("doc_id", "pitch", "r"))

# one uncertain query a work, its first five notes; the octave below is the rival reading, by work in three or all slots
_QS = """q AS (SELECT doc_id, pitches[1:5] AS ps, [0.7, 0.6, 0.3, 0.46][doc_id % 4 + 1]::DOUBLE AS a, doc_id % 4 >= 2 AS every FROM d WHERE len(pitches) >= 5),
b AS (SELECT *, unnest(range(32)) AS bits FROM q),
rd AS (SELECT doc_id, [ps[1] - 12 * (bits & 1), ps[2] - 12 * (bits >> 1 & 1), ps[3] - 12 * (bits >> 2 & 1), ps[4] - 12 * (bits >> 3 & 1), ps[5] - 12 * (bits >> 4 & 1)] AS reading,
  list_product([CASE WHEN i % 2 = 0 OR every THEN CASE WHEN bits >> i & 1 = 0 THEN a ELSE 1 - a END ELSE 1.0 END FOR i IN range(5)]) AS prob, bits FROM b WHERE every OR bits & 10 = 0),
rk2 AS (SELECT doc_id, reading, prob, 'interval:5:' || array_to_string(list_transform(range(1, 5), lambda i: reading[i + 1] - reading[i]), ',') AS fkey, row_number() OVER (PARTITION BY doc_id ORDER BY round(prob, 9) DESC, bits) - 1 AS ordinal FROM rd)
"""


def lattices(s: SparkSession, d: str) -> DataFrame:
    a = F.element_at(F.array(*map(F.lit, (0.7, 0.6, 0.3, 0.46))), (P("doc_id") % 4 + 1).cast("int"))
    slot = lambda p, i: F.when((i % 2 == 0) | (P("doc_id") % 4 >= 2), F.array(F.struct(p.alias("pitch"), a.alias("w")), F.struct((p - 12).alias("pitch"), (1 - a).alias("w")))).otherwise(F.array(F.struct(p.alias("pitch"), F.lit(1.0).alias("w"))))
    return works(s, d).filter(F.size("pitches") >= 5).select("doc_id", F.transform(F.slice("pitches", 1, 5), slot).alias("slots"))


def readings(s: SparkSession, d: str) -> DataFrame:
    return L.exploded(lattices(s, d)).select("doc_id", "ordinal", "reading", "prob", E.figure_key("interval", 5, E.tokens(P("reading"), "interval")).alias("fkey"))


add("lat_paths", f"WITH {D}, {_QS} SELECT doc_id, array_to_string(reading, ',') AS reading, round(prob, 9) AS prob FROM rk2")(lambda s, d: readings(s, d).select("doc_id", F.array_join(P("reading").cast("array<string>"), ",").alias("reading"), F.round("prob", 9).alias("prob")))
add("topk_beam", f"WITH {D}, {_QS} SELECT doc_id, count(*) AS paths, round(max(prob), 9) AS best FROM rk2 GROUP BY 1")(lambda s, d: readings(s, d).groupBy("doc_id").agg(F.count("*").alias("paths"), F.round(F.max("prob"), 9).alias("best")))
add("lat_top1", f"WITH {D}, {_QS} SELECT doc_id, array_to_string(ps, ',') AS reading FROM q")(lambda s, d: lattices(s, d).select("doc_id", F.array_join(L.first_reading(P("slots")).cast("array<string>"), ",").alias("reading")))
_ENT = f"WITH {D}, {_QS} SELECT doc_id, round((CASE WHEN every THEN 5 ELSE 3 END) * -(a * log2(a) + (1 - a) * log2(1 - a)), 6) AS bits FROM q"
add("lat_entropy", _ENT)(lambda s, d: lattices(s, d).select("doc_id", F.round(L.entropy(P("slots")), 6).alias("bits")))
QUERIES["agg_entropy"], SQL["agg_entropy"] = QUERIES["lat_entropy"], _ENT
add("agg_path_mass", f"WITH {D}, {_QS} SELECT doc_id, round(sum(prob), 6) AS mass FROM rk2 GROUP BY 1")(lambda s, d: readings(s, d).groupBy("doc_id").agg(F.round(F.sum("prob"), 6).alias("mass")))
add("agg_modal", f"WITH {D}, {_QS} SELECT doc_id, round(max(prob) FILTER (ordinal = 0) / sum(prob), 6) AS modal FROM rk2 GROUP BY 1")(
    lambda s, d: readings(s, d).groupBy("doc_id").agg(F.round(F.max(F.when(P("ordinal") == 0, P("prob"))) / F.sum("prob"), 6).alias("modal")))
_EST = index_sql() + ", " + _QS + """, names AS (SELECT DISTINCT stratum FROM d),
hits AS (SELECT rk2.doc_id, names.stratum, rk2.ordinal, rk2.prob, coalesce(f.df, 0) AS hits FROM rk2 CROSS JOIN names LEFT JOIN f ON f.fkey = rk2.fkey AND f.stratum = names.stratum),
es AS (SELECT doc_id, stratum, sum(prob) AS mass, sum(prob * hits) / sum(prob) AS expected, greatest(sum(prob * hits * hits) / sum(prob) - pow(sum(prob * hits) / sum(prob), 2), 0) AS variance,
  max(hits) FILTER (ordinal = 0) AS top1, count(*) AS paths, max(prob) FILTER (ordinal = 0) / sum(prob) AS modal FROM hits GROUP BY 1, 2)
"""


def counted(s: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    """Every reading in every stratum with its count; counts: stratum, fkey, df, the index if it is there already."""
    names = few(works(s, d), "stratum")
    asked = readings(s, d).withColumn("stratum", F.explode(F.array(*map(F.lit, names))))
    counts = figs(s, d) if counts is None else counts
    return asked.join(counts.select("stratum", "fkey", "df"), ["stratum", "fkey"], "left").withColumn("hits", F.coalesce("df", F.lit(0)))


def estimates(s: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    return L.estimates(counted(s, d, counts), ["doc_id", "stratum"])


_SHOW = ["round(expected, 5) AS expected", "round(variance, 4) AS variance"]
add("join_readings_counts", _EST + "SELECT doc_id, stratum, sum(hits)::BIGINT AS hits, count(*) AS readings FROM hits GROUP BY 1, 2")(lambda s, d: counted(s, d).groupBy("doc_id", "stratum").agg(F.sum("hits").alias("hits"), F.count("*").alias("readings")))
add("lat_estimate", _EST + "SELECT doc_id, stratum, round(expected, 5) AS expected, round(variance, 4) AS variance, top1, paths FROM es")(lambda s, d: estimates(s, d).selectExpr("doc_id", "stratum", *_SHOW, "top1", "paths"))
add("agg_expected", _EST + "SELECT doc_id, stratum, round(expected, 5) AS expected FROM es")(lambda s, d: estimates(s, d).selectExpr("doc_id", "stratum", _SHOW[0]))
_BOUND = "greatest(0, round_even(round(expected, 9) - 1.96 * sqrt(round(variance, 9)), 0))::BIGINT AS low, round_even(round(expected, 9) + 1.96 * sqrt(round(variance, 9)), 0)::BIGINT AS high"


def bounded(s: SparkSession, d: str, counts: DataFrame | None = None) -> DataFrame:
    low, high = L.interval(F.round("expected", 9), F.round("variance", 9))
    return estimates(s, d, counts).withColumn("low", low).withColumn("high", high)


add("agg_interval", _EST + f"SELECT doc_id, stratum, {_BOUND} FROM es")(lambda s, d: bounded(s, d).select("doc_id", "stratum", "low", "high"))
_CELLS = _EST + f""", mm AS (SELECT p.*, row_number() OVER (PARTITION BY p.stratum, fkey ORDER BY p.year NULLS LAST, doc_id) AS place, coalesce(d.tradition, '') AS tradition FROM p JOIN d USING (doc_id)),
fo AS (SELECT stratum, fkey, bool_and(tradition IN ('folk', 'traditional', '')) AS all_folk FROM mm WHERE place <= 8 GROUP BY 1, 2),
ra AS (SELECT *, round(100.0 * (rank() OVER (PARTITION BY stratum, encoding, n ORDER BY df) - 1) / count(*) OVER (PARTITION BY stratum, encoding, n), 6) AS percentile FROM f),
nd AS (SELECT stratum, count(*) AS n_docs FROM d GROUP BY 1),
ce AS (SELECT es.*, {_BOUND}, (CASE WHEN q.every THEN q.a ELSE (3 * q.a + 2) / 5 END) AS conf, ra.percentile, ra.earliest, fo.all_folk, nd.n_docs FROM es JOIN q USING (doc_id) JOIN nd ON nd.stratum = es.stratum
  LEFT JOIN ra ON ra.stratum = es.stratum AND ra.fkey = 'interval:5:' || array_to_string(list_transform(range(1, 5), lambda i: q.ps[i + 1] - q.ps[i]), ',')
  LEFT JOIN fo ON fo.stratum = es.stratum AND fo.fkey = ra.fkey),
ve AS (SELECT doc_id, max(conf) AS conf, max(paths) AS paths, max(mass) AS mass, max(modal) AS modal, bool_or(round(expected, 2) > 0) AS any_hit, coalesce(bool_and(all_folk) FILTER (round(expected, 2) > 0), true) AS folk,
  bool_and(earliest IS NULL) FILTER (round(expected, 2) > 0) AS undated, max(percentile) FILTER (round(expected, 2) > 0) AS worst,
  min(stratum) FILTER (round(expected, 2) > 0 AND high - low > 2 * round(expected, 2)) AS wide FROM ce GROUP BY 1),
ru AS (SELECT *, CASE WHEN round(conf, 9) < 0.45 THEN 1 WHEN paths > 0 AND round(mass, 9) < 0.40 THEN 2 WHEN modal > 0 AND modal < 0.12 THEN 3 WHEN NOT any_hit THEN 5 WHEN folk THEN 6
  WHEN worst >= 60 THEN 7 WHEN worst <= 40 THEN 8 ELSE 9 END AS rule FROM ve)
"""


def cells(s: SparkSession, d: str) -> DataFrame:
    w = cut(works(s, d))
    p = cut(I.postings(w, (5,), ("interval",)))
    counts = cut(I.figures(p))
    asked = lattices(s, d).select("doc_id", (F.aggregate("slots", F.lit(0.0), lambda t, x: t + x[0]["w"]) / 5).alias("mean_confidence"), E.figure_key("interval", 5, E.tokens(L.first_reading(P("slots")), "interval")).alias("fkey"))
    folk = I.matches(p, w, 8).groupBy("stratum", "fkey").agg(F.bool_and(F.coalesce("tradition", F.lit("")).isin(*V.FOLK)).alias("all_folk"))
    shown = I.rarity(counts).select("stratum", "fkey", "percentile", "earliest").join(folk, ["stratum", "fkey"], "left")
    docs = w.groupBy("stratum").agg(F.count("*").alias("n_docs"))
    return bounded(s, d, counts).join(asked, "doc_id").join(shown, ["stratum", "fkey"], "left").join(F.broadcast(docs), "stratum").withColumn("mean_confidence", F.round("mean_confidence", 9)).withColumn("mass", F.round("mass", 9))


def verdicts(s: SparkSession, d: str) -> DataFrame:
    return V.ladder(cells(s, d), "doc_id")


_VERDICT = "CASE WHEN rule <= 3 THEN 'insufficient_confidence' WHEN rule IN (5, 8) THEN 'distinctive' WHEN rule = 6 THEN 'no_single_originator' ELSE 'commonplace' END AS verdict"
add("verdict_ladder", _CELLS + f"SELECT doc_id, rule, {_VERDICT} FROM ru")(lambda s, d: verdicts(s, d).select("doc_id", "rule", "verdict"))
for _k, _rules in (("vd_1", (1,)), ("vd_2", (2,)), ("vd_3", (3,)), ("vd_5", (5,)), ("vd_6", (6,)), ("vd_7", (7, 8, 9))):
    add(_k, _CELLS + f"SELECT doc_id, {_VERDICT} FROM ru WHERE rule IN ({', '.join(map(str, _rules))})")(lambda s, d, r=_rules: verdicts(s, d).filter(P("rule").isin(*r)).select("doc_id", "verdict"))
add("vd_4", _CELLS + "SELECT doc_id, wide FROM ru WHERE rule > 3 AND wide IS NOT NULL")(lambda s, d: verdicts(s, d).withColumn("wide", F.regexp_extract("reasons", "the interval is wide in ([^;]+)", 1)).filter("wide <> ''").select("doc_id", "wide"))
add("cards")(lambda s, d: (lambda c: c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("stratum", "n_docs", "expected", "low", "high", "percentile", "earliest"))).alias("strata")).join(V.ladder(c, "doc_id"), "doc_id"))(cut(cells(s, d))))

# typed sequences: five notes of every work whose id is divisible by 20; of every other one a note is moved out of reach
_CARD = index_sql() + """, q AS (SELECT doc_id AS query_id, coalesce(year, 1900) AS reference_year, CASE WHEN doc_id % 40 = 20 THEN [pitches[1], pitches[2] + 37, pitches[3], pitches[4], pitches[5]] ELSE pitches[1:5] END AS ps
  FROM d WHERE doc_id % 20 = 0 AND len(pitches) >= 5),
qk AS (SELECT *, 'interval:5:' || array_to_string(list_transform(range(1, 5), lambda i: ps[i + 1] - ps[i]), ',') AS fkey FROM q),
sn AS (SELECT stratum, count(*) AS n_docs, count(*) FILTER (year IS NULL) AS undated FROM d GROUP BY 1),
ct AS (SELECT qk.query_id, p.stratum, count(*) AS n_works, count(*) FILTER (p.year < qk.reference_year) AS m_works FROM qk JOIN p USING (fkey) GROUP BY 1, 2),
mt AS (SELECT stratum, fkey, bool_and(tradition IN ('folk', 'traditional', '')) AS all_folk, string_agg(doc_id, ',' ORDER BY place) AS matches FROM (
  SELECT p.stratum, p.fkey, p.doc_id, coalesce(d.tradition, '') AS tradition, row_number() OVER (PARTITION BY p.stratum, p.fkey ORDER BY p.year NULLS LAST, p.doc_id) AS place
  FROM p JOIN d USING (doc_id) WHERE p.fkey IN (SELECT fkey FROM qk)) WHERE place <= 8 GROUP BY 1, 2),
ra AS (SELECT *, round(100.0 * (rank() OVER (PARTITION BY stratum, encoding, n ORDER BY df) - 1) / count(*) OVER (PARTITION BY stratum, encoding, n), 6) AS percentile FROM f),
ce AS (SELECT qk.query_id, sn.*, coalesce(ct.n_works, 0) AS n_works, coalesce(ct.m_works, 0) AS m_works, ra.percentile, ra.earliest, coalesce(mt.matches, '') AS matches, mt.all_folk FROM qk CROSS JOIN sn
  LEFT JOIN ct ON ct.query_id = qk.query_id AND ct.stratum = sn.stratum LEFT JOIN ra ON ra.fkey = qk.fkey AND ra.stratum = sn.stratum LEFT JOIN mt ON mt.fkey = qk.fkey AND mt.stratum = sn.stratum),
ve AS (SELECT query_id, bool_or(n_works > 0) AS any_hit, coalesce(bool_and(all_folk) FILTER (n_works > 0), true) AS folk, max(percentile) FILTER (n_works > 0) AS worst FROM ce GROUP BY 1),
ru AS (SELECT query_id, CASE WHEN NOT any_hit THEN 5 WHEN folk THEN 6 WHEN worst >= 60 THEN 7 WHEN worst <= 40 THEN 8 ELSE 9 END AS rule FROM ve)
SELECT ce.query_id, stratum, n_docs, undated, n_works, m_works, percentile, earliest, matches, rule,
  CASE WHEN rule IN (5, 8) THEN 'distinctive' WHEN rule = 6 THEN 'no_single_originator' ELSE 'commonplace' END AS verdict FROM ce JOIN ru USING (query_id)"""


def card_symbolic(s: SparkSession, d: str) -> DataFrame:
    w = cut(works(s, d))
    five = F.slice("pitches", 1, 5)
    moved = F.transform(five, lambda x, i: F.when(i == 1, x + 37).otherwise(x))
    asked = w.filter("doc_id % 20 = 0 and size(pitches) >= 5").select(P("doc_id").alias("query_id"), F.when(P("doc_id") % 40 == 20, moved).otherwise(five).alias("pitches"), F.coalesce("year", F.lit(1900)).alias("reference_year"))
    return C.symbolic_cards(asked, w)


add("card_symbolic", _CARD)(card_symbolic)

# the derivation graph
add("sink_edges", "SELECT src, dst, source, max(fetched_at) AS fetched_at FROM edges GROUP BY 1, 2, 3")(lambda s, d: G.upsert(table(s, d, "edges")).select("src", "dst", "source", "fetched_at"))
add("set_nodes", "SELECT src AS node FROM edges UNION SELECT dst FROM edges")(lambda s, d: table(s, d, "edges").select(P("src").alias("node")).union(table(s, d, "edges").select("dst")).distinct())
add("agg_ledger_stats", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY src, dst, source ORDER BY fetched_at DESC) AS r FROM edges) SELECT count(*) AS edges, count(DISTINCT src) AS works, count(DISTINCT source) AS sources, count(*) FILTER (src_year IS NOT NULL AND dst_year IS NOT NULL) AS dated FROM l WHERE r = 1")(
    lambda s, d: G.upsert(table(s, d, "edges")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("works"), F.countDistinct("source").alias("sources"), F.count_if(P("src_year").isNotNull() & P("dst_year").isNotNull()).alias("dated")))
_START = """st AS (SELECT arg_min(id, struct_pack(f := fetched_at, a := src, b := dst, c := source, k := k)) AS id FROM (
  SELECT fetched_at, src, dst, source, 0 AS k, src AS id, src_label AS label FROM edges UNION ALL SELECT fetched_at, src, dst, source, 1, dst, dst_label FROM edges) WHERE contains(lower(label), 'ribbon')),
up AS (SELECT id AS node, 0 AS depth FROM st UNION SELECT e.dst, up.depth + 1 FROM up JOIN edges e ON e.src = up.node WHERE up.depth < 3),
down AS (SELECT id AS node, 0 AS depth FROM st UNION SELECT e.src, down.depth + 1 FROM down JOIN edges e ON e.dst = down.node WHERE down.depth < 3)
"""


def lineage(s: SparkSession, d: str, query: str = "ribbon") -> DataFrame:
    e = table(s, d, "edges")
    start = G.find_node(e, query)
    return G.walk(e, start, True).withColumn("way", F.lit("antecedents")).unionByName(G.walk(e, start, False).withColumn("way", F.lit("descendants"))).select("way", "node", "depth")


_LINEAGE = "WITH RECURSIVE " + _START + "SELECT way, node, depth FROM (SELECT 'antecedents' AS way, node, min(depth) AS depth FROM up GROUP BY 2 UNION ALL SELECT 'descendants', node, min(depth) FROM down GROUP BY 2) WHERE depth > 0"
add("graph_lineage", _LINEAGE)(lineage)
add("join_edge_walk", _LINEAGE.replace("SELECT way, node, depth FROM (", "SELECT way, depth, count(*) AS nodes FROM (") + " GROUP BY 1, 2")(lambda s, d: lineage(s, d).groupBy("way", "depth").agg(F.count("*").alias("nodes")))
_KATZ = """WITH RECURSIVE l AS (SELECT DISTINCT src, dst FROM edges), w AS (
  SELECT node, 0 AS k, 1.0::DOUBLE AS walks FROM (SELECT src AS node FROM l UNION SELECT dst FROM l)
  UNION ALL SELECT l.dst, w.k + 1, sum(w.walks)::DOUBLE FROM w JOIN l ON l.src = w.node WHERE w.k < 12 GROUP BY l.dst, w.k + 1),
k AS (SELECT node, round(sum(pow(0.1, k) * walks), 5) AS score FROM w GROUP BY 1)
"""
add("graph_katz", _KATZ + "SELECT * FROM k")(lambda s, d: G.katz(table(s, d, "edges")).select("node", F.round("score", 5).alias("score")))
add("topk_katz", _KATZ + "SELECT * FROM k ORDER BY score DESC, node LIMIT 20")(lambda s, d: G.katz(table(s, d, "edges")).select("node", F.round("score", 5).alias("score")).orderBy(P("score").desc(), "node").limit(20))

# sources and sinks of text
add("src_year_parse", "SELECT doc_id, CASE WHEN regexp_full_match(ltrim(substr(issue_date, 1, 4), '-'), '\\s*[0-9]+\\s*') THEN nullif(TRY_CAST(ltrim(substr(issue_date, 1, 4), '-') AS INT), 0) END AS year FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", Y.year_of(P("issue_date")).alias("year")))


def _lines(s: SparkSession, d: str) -> DataFrame:
    w = works(s, d)
    line = F.to_json(F.struct(P("doc_id").cast("string").alias("id"), F.coalesce("year", F.lit(-1)).alias("year"), P("title").alias("tunefamily_full"), P("artist").alias("origin"), F.struct(P("pitches").alias("midipitch")).alias("features")))
    return w.select(line.alias("value")).unionByName(s.createDataFrame([("{broken",)], "value string"))


add("src_jsonl", f"WITH {D} SELECT doc_id::VARCHAR AS ext_id, coalesce(title, doc_id::VARCHAR) AS title, coalesce(artist, '') AS artist, CASE WHEN year > 0 THEN year END AS year, array_to_string(pitches, ',') AS pitches FROM d WHERE len(pitches) >= 12")(
    lambda s, d: Y.melodies(_lines(s, d)).withColumn("pitches", F.array_join(P("pitches").cast("array<string>"), ",")))
_uri = lambda c: F.struct(F.concat(F.lit("http://example.org/entity/"), c).alias("value"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    b = F.struct(_uri(P("src")).alias("work"), _uri(P("dst")).alias("basedOn"), F.struct(P("src_label").alias("value")).alias("workLabel"), F.struct(F.concat(P("src_year").cast("string"), F.lit("-01-01")).alias("value")).alias("workDate"))
    return table(s, d, "edges").select(F.to_json(F.struct(F.struct(F.array(b).alias("bindings")).alias("results"))).alias("value"))


add("src_wikidata", "SELECT src, dst, coalesce(src_label, '') AS src_label, src_year FROM edges")(lambda s, d: Y.query_links(_answers(s, d)).select("src", "dst", "src_label", "src_year"))


def _relations(s: SparkSession, d: str) -> DataFrame:
    r = F.struct(P("relation").alias("type"), F.when(P("dst_year") % 2 == 0, "backward").otherwise("forward").alias("direction"), F.struct(P("dst").alias("id"), P("dst_label").alias("title")).alias("work"))
    return table(s, d, "edges").select(F.to_json(F.struct(P("src").alias("id"), F.coalesce("src_label", F.lit("")).alias("title"), F.array(r).alias("relations"))).alias("value"))


add("src_musicbrainz", "SELECT CASE WHEN dst_year % 2 = 0 THEN dst ELSE src END AS src, CASE WHEN dst_year % 2 = 0 THEN src ELSE dst END AS dst, coalesce(relation, 'related') AS relation FROM edges")(lambda s, d: Y.work_links(_relations(s, d)).select("src", "dst", "relation"))
add("sink_json", f"""WITH {D} SELECT '{{"doc_id":' || doc_id || ',"stratum":"' || stratum || '","n_notes":' || n_notes || '}}' AS card FROM d""")(lambda s, d: works(s, d).select(F.to_json(F.struct("doc_id", "stratum", "n_notes")).alias("card")))
