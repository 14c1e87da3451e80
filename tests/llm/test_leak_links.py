import random

from canzona.llm import leakage
from test_texts import lines, prose


def _passages(rng, n=20):
    return [prose(rng, 60) for _ in range(n)]


def _found(spark, pages, words, search=leakage.leaked, questions=None):
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    held = spark.createDataFrame([(k, " ".join(w), (questions or {}).get(k)) for k, w in enumerate(words)], "item_id bigint, passage string, question string")
    return {tuple(r) for r in search(df, held).collect()}


def test_narrow_columns_that_alternate(spark):
    rng = random.Random(5)
    words = _passages(rng)
    left, right = lines(words[7][3:39], 3).split("\n"), lines(prose(rng, 72), 3).split("\n")
    pages = [
        lines(prose(rng, 90) + words[3][10:34] + prose(rng, 80)),
        "\n".join(x for k, a in enumerate(left) for x in (a, *right[2 * k:2 * k + 2])),
        lines(prose(rng, 60) + words[5][10:24] + prose(rng, 60)),
    ]
    assert _found(spark, pages, words) == {(0, 3), (1, 7)}


def test_separate_misread_words_leave_few_neighbours(spark):
    rng = random.Random(8)
    words = _passages(rng)
    pages, want = [], set()
    for k in range(20):
        run = words[k][20:44]
        for j in rng.sample(range(1, 23), 6):
            run[j] = run[j][:1] + "w" + run[j][2:] if len(run[j]) > 3 else run[j][:-1] + "w"
        pages.append(lines(prose(rng, 60) + run + prose(rng, 60)))
        p = leakage.Page(pages[-1])
        if leakage.longest_run(p, [leakage.canonical(w) for w in words[k]], 0, len(p.words), 19) >= 19:
            want.add((k, k))
    got = _found(spark, pages, words)
    # what the alignment takes is found by the search
    assert len(want) >= 10 and got == want


def test_quotation_after_many_broken_line_ends(spark):
    rng = random.Random(9)
    words = _passages(rng)
    pages = []
    for breaks in (0, 300, 800):
        before = "\n".join(f"{' '.join(prose(rng, 3))} gar-\nden" for _ in range(breaks))
        pages.append(before + "\n" + lines(words[2][10:40]) + "\n" + lines(prose(rng, 50)))
    assert _found(spark, pages, words) == {(0, 2), (1, 2), (2, 2)}


def test_passages_in_blocks(spark, monkeypatch):
    rng = random.Random(10)
    words = _passages(rng)
    pages = [lines(prose(rng, 30) + words[k][10:40] + prose(rng, 30)) for k in range(6)]
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 3)
    assert _found(spark, pages, words) == {(k, k) for k in range(6)}


def test_paraphrases(spark):
    rng = random.Random(11)
    words = _passages(rng)
    told = [x for k, w in enumerate(words[4]) for x in ([w, "quite"] if k % 7 == 3 else [] if k % 9 == 5 else [w])]
    pages = [lines(told), lines(words[5]), lines(prose(rng, 80)), None, ""]
    found = _found(spark, pages, words, lambda d, h: leakage.paraphrased(d, h))
    # page 0 keeps no 20 words in a row; page 1 is the passage itself
    p = leakage.Page(pages[0])
    assert leakage.longest_run(p, [leakage.canonical(w) for w in words[4]], 0, len(p.words), 19) < 19 or (0, 4) in _found(spark, pages, words)
    assert found <= {(0, 4)} and (1, 5) in _found(spark, pages, words)


def test_common_subsequence():
    rng = random.Random(12)
    for _ in range(50):
        a, b = [rng.choice("abcde") for _ in range(rng.randrange(30))], [rng.choice("abcde") for _ in range(rng.randrange(1, 30))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert leakage.lcs_words(a, b, 0, len(a)) == best[-1][-1]
