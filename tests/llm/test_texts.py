import random

import numpy as np

from canzona.llm import leakage, quality
from canzona.llm.holdout import CALIBRATION, EVALUATION

NOUNS = [a + b for a in ("gar", "fen", "hol", "tim", "wag", "lan", "mor", "pel", "quin", "dus") for b in ("den", "ter", "low", "ber", "on", "tern", "rock", "ham", "ster", "kin", "dle", "mar")]
SMALL = "the of and to in is was for on with".split()


def prose(rng, n):
    return [rng.choice(SMALL) if k % 2 else rng.choice(NOUNS) for k in range(n)]


def lines(words, width=6):
    return "\n".join(" ".join(words[k:k + width]) for k in range(0, len(words), width))


def test_leaks(spark):
    rng = random.Random(1)
    items = [(k, " ".join(prose(rng, 60)).capitalize() + ".") for k in range(20)]
    quote = lambda k, a, n: items[k][1].lower().rstrip(".").split()[a:a + n]
    pages, want = [], set()

    def page(text, *found):
        pages.append((len(pages), text))
        want.update((len(pages) - 1, f) for f in found)

    page(lines(prose(rng, 90) + quote(3, 10, 24) + prose(rng, 80)), 3)
    page(lines(quote(4, 0, 60)).upper(), 4)
    page(lines(prose(rng, 60) + quote(5, 10, 14) + prose(rng, 60)))
    w = quote(6, 5, 40)
    rng.shuffle(w)
    page(lines(prose(rng, 40) + w))
    left, right = lines(quote(7, 3, 36)).split("\n"), lines(prose(rng, 36)).split("\n")
    page("\n".join(x for p in zip(left, right) for x in p), 7)
    page("\n".join(f"{a}   {b}" for a, b in zip(left, right)), 7)
    broken = lines(quote(8, 12, 30)).replace("n", "u", 2).replace("garden", "gar-\nden")
    page(broken.split("\n")[0] + "\n[ADVT.]\nBEST COAL\n" + "\n".join(broken.split("\n")[1:]), 8)
    page(lines(prose(rng, 4_000) + quote(9, 20, 30) + prose(rng, 2_000)), 9)
    page(None)
    page("")
    df = spark.createDataFrame(pages + [pages[0]], "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'x' as passage")
    held = spark.createDataFrame(items + [(90, None), (91, "too short a passage"), (None, items[0][1])], "item_id bigint, passage string").selectExpr("*", "'y' as text")
    assert {tuple(r) for r in leakage.leaked(df, held).collect()} == want
    assert leakage.leaked(df.limit(0), held).count() == 0 and leakage.leaked(df, held.limit(0)).count() == 0


def test_alignment_pieces():
    assert leakage.canonical("Tbe modern") == leakage.canonical("The rnodern") and leakage.alike("discovered", "disc0vered") and not leakage.alike("mill", "garden")
    p = leakage.passage_words("one two three four five six seven eight")
    assert leakage.longest_run(leakage.Page("zero one two\nthree fo-\nur five six"), p, 0, 8, 99) >= 5


COMMON = frozenset(SMALL)


def test_quality(spark):
    rng = random.Random(2)
    pages, junk = [], set()
    for k in range(120):
        n = rng.randrange(8, 40)
        if k % 3:
            text = lines([w if rng.random() > 0.03 else w[::-1] for w in prose(rng, n * 7)], 7) + "."
        else:
            junk.add(k)
            text = "\n".join([f"{rng.choice(NOUNS).capitalize()} .. {rng.randrange(99)} .. {rng.randrange(99)}" for _ in range(n)] if k % 2 else ["~" * 9 + "|" * rng.randrange(9) + "¦" for _ in range(n)])
        pages.append((k, text))
    pages += [(200, None), (201, ""), (202, " \n\t\n"), (203, "the " + NOUNS[0] + " was in the " + NOUNS[1] + "\n" * 2 + lines(prose(rng, 30_000), 8)), (None, "x"), (1, pages[1][1])]
    df = spark.createDataFrame(pages, "id bigint, t string").selectExpr("*", "1 as rec", "2 as text", "3 as words")
    got = {r.rec: r.junk_probability for r in quality.page_quality(df, "id", "t", COMMON).collect()}
    assert {k for k, p in got.items() if p >= 0.5} == junk | {200, 201, 202} and len(got) == 124
    assert quality.page_quality(df.limit(0), "id", "t", COMMON).count() == 0
    only = quality.page_quality(df.filter("id in (0, 3)"), "id", "t", COMMON).collect()
    assert all(r.junk_probability >= 0.5 for r in only)


def test_statistics_by_hand():
    s = dict(zip(quality.STATS, quality.statistics("The mill was closed.\n\n12 34", COMMON)))
    assert s["words"] == 4 and s["mean_word_length"] == 4 and s["punctuated_lines"] == 0.5 and s["common_share"] == 0.5 and s["digit_lines"] == 0.5


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)).astype(float)
    m = quality.Boosted(trees=80).fit(x[:600], y[:600])
    score = m.score(x[600:])
    assert ((score > 0) == (y[600:] > 0)).mean() > 0.85
    a, b = quality.platt(score, y[600:])
    p = 1 / (1 + np.exp(-(a * score + b)))
    assert a > 0 and abs(p.mean() - y[600:].mean()) < 0.1


def test_holdout_has_both_kinds():
    for pages in (CALIBRATION, EVALUATION):
        assert {r[2] for r in pages} == {0, 1} and all(len(r[3]) == len(quality.STATS) for r in pages)
    assert not {r[:2] for r in CALIBRATION} & {r[:2] for r in EVALUATION}
