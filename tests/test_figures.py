import random

import numpy as np
from pyspark.sql import functions as F

from canzona.functions import encode as E
from canzona.functions import signal as S
from canzona.operators import graph, index, lattice
from canzona.sources import midi
from canzona.streaming import ingest

WORK = "doc_id bigint, stratum string, ext_id string, title string, artist string, year int, tradition string, pitches array<int>"
TUNE = [60, 62, 64, 65, 67, 69, 71, 72, 74]
ROWS = [(1, "alpha", "a1", "t", "", 1900, "pop", TUNE), (2, "alpha", "a2", "t", "", None, "pop", TUNE), (3, "beta", "b1", "t", "", 1800, "folk", TUNE)]


def test_counts_stay_in_their_stratum(spark):
    p = index.postings(spark.createDataFrame(ROWS, WORK), (5,), ("interval",))
    got = {(r.stratum, r.fkey): r for r in index.figures(p).collect()}
    f = got["alpha", "interval:5:2,2,1,2"]
    assert (f.df, f.df_dated, f.earliest) == (2, 1, 1900) and got["beta", "interval:5:2,2,1,2"].df == 1
    before = {(r.stratum, r.fkey): r.m_works for r in index.count_before(p, 1950).collect()}
    assert before["alpha", "interval:5:2,2,1,2"] == 1
    again = index.count_before(p, 1900).filter("stratum = 'alpha' and m_works > 0").count()
    assert again == 0  # a work of the year itself does not predate it


def test_works_are_added_once(spark):
    w = spark.createDataFrame(ROWS, WORK)
    assert index.add_works(w, w).count() == 0
    assert index.add_works(w.limit(0), w.unionAll(w)).count() == 3
    strata = spark.createDataFrame([("alpha",)], "name string")
    assert [r.stratum for r in index.unregistered(w, strata).collect()] == ["beta"]


def test_windows_against_brute_force(spark):
    rng = random.Random(1)
    tunes = [[rng.randrange(55, 80) for _ in range(rng.randrange(0, 25))] for _ in range(12)]
    df = spark.createDataFrame([(k, "s", "", "", "", None, "", t) for k, t in enumerate(tunes)], WORK)
    got = {(r.doc_id, r.n, r.pos, r.body) for r in index.windows(df, (4, 6), ("interval",)).collect()}
    want = {(k, n, i, ",".join(str(b - a) for a, b in zip(t[i:i + n], t[i + 1:i + n]))) for k, t in enumerate(tunes) for n in (4, 6) for i in range(len(t) - n + 1)}
    assert got == want


def test_encodings_follow_transposition(spark):
    df = spark.createDataFrame([([60, 62, 64, 62, 60], [67, 69, 71, 69, 67])], "a array<int>, b array<int>")
    for enc in E.ENCODINGS:
        t = lambda c: E.tokens(F.col(c), enc, (E.best_key(F.col(c)) / 2).cast("int"))
        r = df.select(t("a").alias("a"), t("b").alias("b")).first()
        assert (r.a == r.b) == (enc != "pitch") and len(r.a) == E.width(enc, 5)


def test_lattice(spark):
    slots = "slots array<array<struct<pitch:int,w:double>>>"
    q = spark.createDataFrame([([[(60, 0.6), (48, 0.4)], [(62, 1.0)], [(64, 0.5), (63, 0.5)]],)], slots)
    r = lattice.exploded(q).collect()
    assert len(r) == 4 and r[0].reading == [60, 62, 64] and abs(sum(x.prob for x in r) - 1) < 1e-9
    e = lattice.estimates(lattice.exploded(q).withColumn("hits", F.when(F.col("reading") == F.array(F.lit(60), F.lit(62), F.lit(64)), 10).otherwise(0)).withColumn("k", F.lit(1)), ["k"]).first()
    assert abs(e.expected - 3) < 1e-9 and e.top1 == 10 and e.variance >= 0
    wide = spark.createDataFrame([([[(60 + k, 1 / 3) for k in range(3)]] * 8,)], slots)
    assert wide.select(F.size(lattice.readings(F.col("slots"), 16)).alias("n")).first().n <= 16
    empty = spark.createDataFrame([([],), ([[], [(60, 0.0)]],)], slots).select(F.size(lattice.readings(F.col("slots"))).alias("n"), F.size(lattice.first_reading(F.col("slots"))).alias("f"))
    assert [r.n for r in empty.collect()] == [0, 1]


def test_similarity_against_table(spark):
    rng = random.Random(2)
    pairs = [([rng.randrange(3) for _ in range(rng.randrange(7))], [rng.randrange(3) for _ in range(rng.randrange(7))]) for _ in range(40)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1] / max(len(a), len(b)) if a and b else 0.0

    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<int>, b array<int>")
    got = {r.k: r.s for r in df.select("k", E.sequence_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(abs(got[k] - lcs(a, b)) < 1e-9 for k, (a, b) in enumerate(pairs))


def test_midi_round_trip_and_choice_of_track(spark, tmp_path):
    tune = [72, 74, 76, 74, 72, 71, 69, 71, 72, 76, 74, 72, 71, 69]
    notes = [(p, k, k + 0.5) for k, p in enumerate(tune)]
    bass = [(40, k, k + 1.0) for k in range(14)]
    chords = [(p, k, k + 4.0) for k in range(0, 56, 4) for p in (48, 52, 55)]
    parts = {"a/Air (1900).mid": [("bass", bass), ("chords", chords), ("melody", notes)], "b/two.mid": [("", bass), ("", notes)], "b/three.mid": [("chords", chords)], "a/AIR.2.mid": [("melody", notes)]}
    for name, tracks in parts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(midi.file_bytes(tracks))
    (tmp_path / "b/broken.mid").write_bytes(b"broken")
    load = lambda **how: {r.path.split("/", 1)[-1].split(tmp_path.name + "/")[-1]: r.pitches for r in midi.load_folder(spark, str(tmp_path), least=12, **how).collect()}
    found = load()
    assert set(found) == {"a/AIR.2.mid", "b/two.mid"} and all(x == tune for x in found.values())
    assert len(load(limit=1)) == 1 and load(glob="none*") == {}
    line = lambda ns: [r[0] for r in spark.createDataFrame([([(s, -p, e) for p, s, e in ns],)], f"notes array<{midi.NOTE}>").select(F.explode(midi.top_line(F.array_sort("notes"))).alias("x")).select(-F.col("x.below")).collect()]
    assert line([(60, 0.0, 2.0), (64, 0.0, 2.0)]) == [64] and line([(60, 0.0, 4.0), (67, 1.0, 3.0)]) == [60, 67] and line([(60, 0.0, 4.0), (50, 1.0, 2.0), (55, 4.0, 5.0)]) == [60, 55]
    assert midi.tracks(midi.file_bytes([("melody", notes)]))[0] == ("melody", notes)


def test_sound_is_heard_as_written():
    truth = [64, 60, 57, 55, 60, 60, 62, 60, 64, 65]
    x = S.melody(truth, [0.34] * 10)
    found = S.notes(S.track(x), S.onsets(x))
    assert [n[2][0][0] for n in found] == truth
    assert all(abs(sum(w for _, w in n[2]) - 1) < 1e-9 and sorted((w for _, w in n[2]), reverse=True) == [w for _, w in n[2]] for n in found)
    assert 40 < S.tempo(x)[0] < 260
    back = S.read_wav(S.wav_bytes(x))
    assert len(back) == len(x) and np.abs(back - x / np.abs(x).max()).max() < 1e-3
    assert S.lead_signal(x)[0] is x


def test_graph(spark):
    e = spark.createDataFrame([("c", "b", "C", "B", "s", 1.0), ("b", "a", "B", "A tune", "s", 2.0), ("b", "a", "B", "A tune", "t", 3.0)], "src string, dst string, src_label string, dst_label string, source string, fetched_at double")
    score = {r.node: r.score for r in graph.katz(e).collect()}
    assert abs(score["c"] - 1) < 1e-9 and abs(score["b"] - 1.1) < 1e-9 and abs(score["a"] - 1.11) < 1e-9
    assert graph.find_node(e, " a TUNE") == "a" and graph.find_node(e, "zzz") is None
    assert {(r.node, r.depth) for r in graph.walk(e, "c", True).collect()} == {("b", 1), ("a", 2)}
    assert graph.upsert(e.unionAll(e)).count() == 3


def test_stream_adds_each_work_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    w = spark.createDataFrame(ROWS, WORK)
    w.coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(WORK).parquet(source)
    ingest.start(stream(), target, str(tmp_path / "ck"), lengths=(5,), encodings=("interval",)).awaitTermination()
    w.coalesce(1).write.mode("append").parquet(source)  # the same works are delivered again
    ingest.start(stream(), target, str(tmp_path / "ck"), lengths=(5,), encodings=("interval",)).awaitTermination()
    got = ingest.figures(spark, target).filter("stratum = 'alpha' and fkey = 'interval:5:2,2,1,2'").first()
    assert got.df == 2 and got.df_dated == 1


def test_symbolic_cards(spark):
    from canzona.operators import card

    works = spark.createDataFrame(ROWS, WORK)
    asked = spark.createDataFrame([(1, TUNE, 1950), (2, [p + 5 for p in TUNE], None), (3, [1, 90, 2, 80, 3, 70, 4, 60, 5], 1950), (4, [], 1950), (5, None, 1950)], "query_id bigint, pitches array<int>, reference_year int")
    got = {(r.query_id, r.stratum): r for r in card.symbolic_cards(asked, works).collect()}
    assert set(got) == {(q, s) for q in (1, 2, 3) for s in ("alpha", "beta")}
    one = got[1, "alpha"]
    assert (one.n_works, one.m_works, one.undated, one.earliest, one.matches, one.n_docs) == (2, 1, 1, 1900, "1,2", 2)
    assert got[1, "beta"].m_works == 1 and got[2, "alpha"].m_works is None and got[2, "alpha"].n_works == 2
    assert got[3, "beta"].n_works == 0 and got[3, "alpha"].verdict == "distinctive" and got[3, "alpha"].matches == ""
    assert card.symbolic_cards(asked.limit(0), works).count() == 0
