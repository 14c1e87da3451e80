import datetime
import random

from canzona.functions import encode as E
from canzona.plans.inquiry import QUERIES


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y and x is not None else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence_against_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice([None, 0, 1, 2, 3]) for _ in range(rng.randrange(90))] for _ in range(2))
        assert E.common_subsequence(a, b) == lcs(a, b)


def test_whole_works_are_compared(spark, tmp_path):
    rng = random.Random(4)
    tunes = [[rng.randrange(60, 68) for _ in range(n)] for n in (0, 1, 2, 9, 17, 40, 90, 200)]
    at = datetime.datetime(2023, 1, 1)
    spark.createDataFrame([(k, at, at, t) for k, t in enumerate(tunes)] + [(90, at, at, None)], "doc_id bigint, added_at timestamp, removed_at timestamp, pitches array<int>").write.parquet(f"{tmp_path}/works.parquet")
    got = {r.doc_id: r.similarity for r in QUERIES["lcs_similarity"](spark, str(tmp_path)).collect()}
    iv = lambda t: [y - x for x, y in zip(t, t[1:])]
    assert got == {k: round(lcs(iv(t), iv(t[::-1])) / (len(t) - 1), 6) if len(t) > 1 else 0.0 for k, t in enumerate(tunes)}
