import random
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from canzona.functions import encode as E
from canzona.operators import index
from canzona.plans.catalog import QUERIES, SQL

WORK = "doc_id bigint, stratum string, ext_id string, title string, artist string, year int, tradition string, n_notes int, pitches array<int>, added_at timestamp_ntz, removed_at timestamp_ntz"
AT = datetime(2024, 1, 1)


def saved(spark, to, tunes):
    rows = [(k, "s", f"e{k}", "t", "", None, "", len(t or []), t, AT, None) for k, t in tunes]
    df = spark.createDataFrame([*rows, (7, *rows[7][1:8], [1] * 30, datetime(2025, 1, 1), None)], WORK)  # work 7 is loaded again
    df.repartition(3).write.parquet(f"{to}/works.parquet")


def odd_tunes():
    rng = random.Random(3)
    tunes = [[rng.choice((60, 62, 64, 67)) for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    tunes += [[60, 62, 64, 65] * 12, [60] * 25, [-3, 5, -14, 127, 0, 1] * 4, [rng.randrange(-(10**9), 10**9) for _ in range(30)] * 2]
    tunes += [[60, None, 62, 64, None, None, 65] * 4, [60, 62, *[None] * 14, 62, 60, 62, 64], [None] * 16, [], [60, 61, 62], None]
    return list(enumerate(tunes))


def test_all_windows_are_counted_as_sql_counts_them(spark, tmp_path):
    saved(spark, tmp_path, odd_tunes())
    duckdb_ = duckdb.connect()
    duckdb_.execute(f"CREATE VIEW works AS SELECT * FROM '{tmp_path}/works.parquet/*.parquet'")
    want = duckdb_.sql(SQL["ngrams_all"]).fetchall()
    got = QUERIES["ngrams_all"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000


def test_works_taken_together_or_apart_count_alike(spark):
    df = spark.createDataFrame([(k, t) for k, t in odd_tunes() if t and None not in t], "doc_id bigint, pitches array<int>").coalesce(1)
    full = df.withColumns({"stratum": F.lit("s"), "year": F.lit(1)})
    each = index.windows(full, (4, 5, 12), E.ENCODINGS).groupBy("doc_id", "encoding", "n").agg(F.count("*").alias("windows"), F.countDistinct("body").alias("kinds"), F.sum("pos").alias("pos_sum"))
    want = sorted(map(tuple, each.collect()))
    for at_once in (1, 70, 10**6):
        assert sorted(map(tuple, index.window_counts(df, (4, 5, 12), E.ENCODINGS, at_once).collect())) == want


def test_no_window_leaves_its_work(spark, tmp_path):
    saved(spark, tmp_path, odd_tunes())
    plan = QUERIES["ngrams_all"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1  # the works, each once
