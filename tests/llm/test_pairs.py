import random

from pyspark.sql import functions as F

from canzona.llm import neardup, spans
from canzona.llm.sequences import components

WORKS = "id bigint, seq array<int>"


def tunes(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            s = list(rng.choice(rows)[1] or [1] * 30)
            for _ in range(rng.randrange(4)):
                if s:
                    s[rng.randrange(len(s))] = rng.randrange(40, 90)
            if rng.random() < 0.3:
                s = s[: len(s) // 2] + [rng.randrange(40, 90) for _ in range(20)]
        else:
            s = [rng.randrange(40, 90) for _ in range(rng.randrange(0, 70))]
        rows.append((k, s))
    rows += [(900, None), (901, []), (902, [60] * 200), (903, [60] * 200), (904, [60] * 31), (905, [None] * 30), (906, [None] * 30)]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = tunes(1)
    runs = {k: {tuple(s[i:i + 5]) for i in range(len(s) - 4)} for k, s in rows if s and len(s) >= 16}
    want = {(a, b) for a in runs for b in runs if a < b and 2 * len(runs[a] & runs[b]) >= len(runs[a] | runs[b])}
    df = spark.createDataFrame(rows + rows[:9], WORKS).withColumn("cls", F.lit(1)).withColumn("members", F.lit(2))
    got = [tuple(r) for r in neardup.near_duplicates(df, "id", "seq").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    assert neardup.near_duplicates(df.limit(0), "id", "seq").count() == 0


def test_full_regions_lose_nothing(spark):
    rng = random.Random(4)
    base = [rng.randrange(40, 90) for _ in range(60)]
    rows = [(k, base[:40] + [rng.randrange(40, 90)] + base[41:]) for k in range(60)]
    runs = {k: {tuple(s[i:i + 5]) for i in range(len(s) - 4)} for k, s in rows}
    want = {(a, b) for a in runs for b in runs if a < b and 2 * len(runs[a] & runs[b]) >= len(runs[a] | runs[b])}
    df = spark.createDataFrame(rows, WORKS)
    from canzona.llm.sequences import copy_classes, record_pairs, sequences

    classes, members = copy_classes(sequences(df, "id", "seq", 16), hot_rows=3)
    assert {tuple(r) for r in record_pairs(neardup.near_classes(classes, region=5), members).collect()} == want


def test_groups(spark):
    rows = [(1, list(range(40))), (2, list(range(40))), (3, list(range(1, 41))), (4, [5] * 7 + list(range(50, 90)))]
    got = {r.doc_id: (r.class_id, r.group_id, r.copies, r.links) for r in neardup.near_groups(spark.createDataFrame(rows, WORKS), "id", "seq").collect()}
    assert got == {1: (1, 1, 2, 1), 2: (1, 1, 2, 1), 3: (3, 1, 1, 1), 4: (4, 4, 1, 0)}


def test_components(spark):
    rng = random.Random(6)
    edges = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60)) if a < b]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label


def test_shared_spans_against_brute_force(spark):
    rows = tunes(2)
    grams = {k: {tuple(s[i:i + 24]) for i in range(len(s) - 23)} for k, s in rows if s}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    df = spark.createDataFrame(rows + rows[:5], WORKS)
    got = [tuple(r) for r in spans.shared_spans(df, "id", "seq").collect()]
    assert len(got) == len(set(got)) and set(got) == want and (902, 904) in want
    share = {r.doc_id: (r.tokens, r.shared_tokens) for r in spans.shared_share(df, "id", "seq").collect()}
    for k, s in rows:
        cover = {i + j for i in range(len(s or []) - 23) if any(tuple(s[i:i + 24]) in g for o, g in grams.items() if o != k) for j in range(24)}
        assert share.get(k, (0, 0))[1] == len(cover)
    assert spans.shared_spans(df.limit(0), "id", "seq").count() == 0


def test_places(spark):
    stretches = spark.createDataFrame([(1, 0, 24, 90), (1, 50, 80, 90)], "doc_id bigint, start int, end int, tokens int")
    places = spark.createDataFrame([(1, 0, 24), (1, 1, 24), (1, 50, 30), (1, 30, 5), (2, 0, 5), (1, None, 5)], "doc_id bigint, first_pos int, n int")
    got = {r.doc_id: (r.places, r.shared_places) for r in spans.places_in_stretches(stretches, places).collect()}
    assert got == {1: (4, 2), 2: (1, 0)}
