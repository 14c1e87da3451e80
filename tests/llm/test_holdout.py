import os
import random

import pytest

from canzona.llm import quality
from canzona.llm.holdout import CALIBRATION, EVALUATION

DATA = "/root/testdata"


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="without the test tables")
def test_statistics_of_the_checked_pages(spark):
    for sf in ("0.01", "0.1"):
        common = quality.common_words(spark.read.parquet(f"{DATA}/sf{sf}/common_words.parquet"))
        ids = {i: s for scale, i, _, s in CALIBRATION + EVALUATION if scale == sf}
        pages = spark.read.parquet(f"{DATA}/sf{sf}/documents.parquet").select("doc_id", "text").filter("doc_id in (" + ",".join(map(str, ids)) + ")").collect()
        assert {r.doc_id for r in pages} == set(ids)
        for r in pages:
            assert quality.statistics(r.text, common) == pytest.approx(ids[r.doc_id], abs=1e-3)


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="without the test tables")
def test_evaluation_pages_are_classed_as_by_eye(spark):
    d = f"{DATA}/sf0.1"
    common = quality.common_words(spark.read.parquet(f"{d}/common_words.parquet"))
    junk = {i: y for scale, i, y, _ in EVALUATION}
    got = {r.rec: r.junk_probability for r in quality.page_quality(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", common).collect() if r.rec in junk}
    wrong = [i for i, y in junk.items() if (got[i] >= 0.5) != (y == 1)]
    print(len(junk), wrong)
    assert len(wrong) <= 0.03 * len(junk)


def test_lists_that_read_like_prose_vote_for_junk():
    rng = random.Random(3)
    common = frozenset("the of and for by his a with".split())
    noun = lambda: rng.choice("basket whistle harbour notice valley".split())
    entries = "\n".join(f"The {noun().title()} and {noun().title()}, of {noun().title()} for {noun().title()}" for _ in range(30))
    assert quality.prose_lines(entries, common) < 0.2
    words = [w for _ in range(60) for w in ("the", noun(), "of", "a", noun(), "with", "his", noun(), "passed", "by")]
    rng.shuffle(words)
    assert quality.prose_lines("\n".join(" ".join(words[k:k + 7]) for k in range(0, len(words), 7)), common) > 0.8
    assert quality.prose_lines(None, common) == quality.prose_lines(" \n", common) == 0
