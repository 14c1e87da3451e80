"""Per-document text statistics, and which documents are not natural prose.

The statistics of each text are taken in one pass over its lines. Weak labels come from what the statistics do not hold: how
lines hang together. A line votes for prose if it reads like running text, goes on from or into a neighbouring line (a small
letter, a broken word, capitals throughout) and has a shape of words and signs that the page does not repeat; a page is weakly
prose or junk where most of its lines are, by a margin. Gradient-boosted trees learn from a bounded sample of these pages, seeing
their statistics only. Their scores are calibrated (Platt) on the hand-checked pages `holdout.CALIBRATION`, which were never
trained on, and a text is no prose where the probability of junk reaches one half; `holdout.EVALUATION` measures the outcome.

Defined cases: a NULL, empty or blank text has zero statistics and is junk. Lines of white space are not counted. Texts are
read whole, however long. Rows repeated under one id give one row, of the largest text. A NULL id is no document. Without
any weakly labelled text of both kinds the share of running lines decides alone. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canzona.llm.holdout import CALIBRATION, EVALUATION
from canzona.session import cut

#: Pages that are weakly labelled, about, and of these the pages of each kind used for training, at most; chosen by hash of the id.
LABEL_ROWS, TRAIN_ROWS = 20_000, 3_000
#: Common words that are held in every task, at most.
COMMON_WORDS = 200_000
#: Shares of prose lines that make a page weakly junk or prose.
JUNK_LINES, PROSE_LINES = 0.4, 0.6
#: A shape of words is repeated if more lines than one, and than this share of the page, have it.
REPEATED = 0.05
STATS = [
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "punctuated_lines", "common_share", "running_lines", "common_lines",
    "digit_lines", "lower_starts", "upper_words", "short_words", "mean_line_length", "repeated_lines", "sentence_ends", "word_variety",
]
_WORD = re.compile(r"[^\W\d_]+")
_LEADER = re.compile(r"\.\s?\.|\s—\s*\d|\t|\s{2,}\S+\s{2,}|^\s*(?:[•*·—-]|\(\d+\))\s|[a-zà-ÿ][A-Z](?![^\W_])")
_DIGIT = re.compile(r"\d")
_HYPHEN = re.compile(r"[-=¬‐‑­]\s*$")
_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def statistics(text: str | None, common: frozenset[str]) -> list[float]:
    """The values of STATS."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return [0.0] * len(STATS)
    n = len(lines)
    words, hits, uppers, shorts, letters, digits, symbols, chars = 0, 0, 0, 0, 0, 0, 0, 0
    ended = running = with_common = with_digit = lower_start = sentence = 0
    kinds: set[str] = set()
    for line in lines:
        size = len(line)
        tokens = _WORD.findall(line)
        low = _WORD.findall(line.lower())
        k = len(tokens)
        in_common = sum(map(common.__contains__, low))
        lens = list(map(len, tokens))
        count = sum(lens)
        spaces = line.count(" ") + line.count("\t")
        d = sum(map(str.isdigit, line)) if _DIGIT.search(line) else 0
        upper = sum(map(ne, tokens, low))
        short = lens.count(1) + lens.count(2)
        words, hits, uppers, shorts = words + k, hits + in_common, uppers + upper, shorts + short
        letters, digits, symbols, chars = letters + count, digits + d, symbols + size - spaces - count - d, chars + size
        last, head = line.rstrip()[-1], line.lstrip()[0]
        ended += last in ".,;:!?"
        sentence += last in ".!?"
        lower_start += head.islower()
        with_common += in_common > 0
        with_digit += d > 1
        # a broken line of long words may be without a common word
        if k >= 2 and (in_common * 5 >= k or (upper * 2 <= k and count > 6 * k)) and d * 12 <= size and count * 10 >= 7 * (size - spaces) and short * 2 <= k and count >= 3 * k:
            running += not _LEADER.search(line)
        kinds.update(low)
    w = max(words, 1)
    return [
        float(words), letters / w, symbols / max(chars, 1), digits / max(chars, 1), ended / n, hits / w, running / n, with_common / n, with_digit / n, lower_start / n,
        uppers / w, shorts / w, chars / n, 1 - len(set(lines)) / n, sentence / n, min(len(kinds) / min(w, 400), 1.0),
    ]


def prose_lines(text: str | None, common: frozenset[str]) -> float:
    """The share of lines that vote for prose; 0 for a text without lines."""
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return 0.0
    n, reads, small, broken, capital, shapes = len(lines), [], [], [], [], []
    for line in lines:
        pieces = _PIECE.findall(line)
        low = [p.lower() for p in pieces]
        tokens = [(p, q) for p, q in zip(pieces, low) if p[0].isalpha()]
        k, letters, inked = len(tokens), sum(len(p) for p, _ in tokens), len("".join(line.split()))
        known, upper, short = sum(q in common for _, q in tokens), sum(p != q for p, q in tokens), sum(len(p) < 3 for p, _ in tokens)
        digits = sum(map(str.isdigit, line))
        reads.append(
            k >= 2 and (known * 5 >= k or (upper * 2 <= k and letters > 6 * k)) and digits * 12 <= len(line) and letters * 10 >= 7 * inked
            and short * 2 <= k and letters >= 3 * k and not _LEADER.search(line)
        )
        small.append(line[0].islower())
        broken.append(bool(_HYPHEN.search(line)))
        capital.append(k > 0 and sum(p == p.upper() for p, _ in tokens) * 10 >= 7 * k)
        shapes.append(" ".join("0" if p[0].isdigit() else p if not p[0].isalpha() else q if q in common else "A" if p != q else "a" for p, q in zip(pieces, low)))
    times: dict[str, int] = {}
    for x in shapes:
        times[x] = times.get(x, 0) + 1
    joined = [False, *(small[i] or broken[i - 1] or (capital[i - 1] and capital[i]) for i in range(1, n)), False]
    most = max(1, REPEATED * n)
    return sum(reads[i] and (joined[i] or joined[i + 1]) and times[shapes[i]] <= most for i in range(n)) / n


def page_statistics(texts: DataFrame, rec: str, text: str, common: frozenset[str], label_share: float = 0.0) -> DataFrame:
    """rec, the columns of STATS, and prose_lines for a share of the ids; one row for each record id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = np.array([statistics(t, common) for t in b["text"]], dtype=float).reshape(len(b), len(STATS))
            out = pd.DataFrame(rows, columns=STATS)
            out.insert(0, "rec", b["rec"].to_numpy())
            out["prose_lines"] = [prose_lines(t, common) if chosen else None for t, chosen in zip(b["text"], b["chosen"])]
            yield out

    chosen = F.pmod(F.xxhash64(F.col(rec).cast("long")), F.lit(1 << 40)) / float(1 << 40) < label_share
    rows = texts.filter(F.col(rec).isNotNull()).select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text"), chosen.alias("chosen"))
    each = rows.mapInPandas(run, "rec long, " + ", ".join(f"{c} double" for c in STATS) + ", prose_lines double")
    return each.groupBy("rec").agg(F.max(F.struct(*STATS, "prose_lines")).alias("s")).select("rec", "s.*")


class Boosted:
    """Gradient-boosted regression trees with logistic loss over binned columns."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.model: list[dict] = []
        self.start = 0.0

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = {"value": self.rate * total_g / (total_h + 1.0)}
        if depth == 0 or len(rows) < 20:
            return leaf
        best, where = total_g**2 / (total_h + 1.0) + 1e-6, None
        for j in range(codes.shape[1]):
            c = codes[rows, j]
            gs, hs = np.cumsum(np.bincount(c, g[rows], self.bins)), np.cumsum(np.bincount(c, h[rows], self.bins))
            gain = gs**2 / (hs + 1.0) + (total_g - gs) ** 2 / (total_h - hs + 1.0)
            gain[np.cumsum(np.bincount(c, minlength=self.bins)) < 5] = 0
            k = int(np.argmax(gain[:-1]))
            if gain[k] > best:
                best, where = gain[k], (j, k)
        if where is None:
            return leaf
        j, k = where
        left = codes[rows, j] <= k
        if left.all() or not left.any():
            return leaf
        return {"column": j, "below": self.edges[j][k], "left": self._grow(codes, g, h, rows[left], depth - 1), "right": self._grow(codes, g, h, rows[~left], depth - 1)}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], q)) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        self.edges = [np.append(e, np.inf) for e in self.edges]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.model.append(tree)
            score += self._walk(tree, x)
        return self

    def _walk(self, tree: dict, x: np.ndarray) -> np.ndarray:
        if "value" in tree:
            return np.full(len(x), tree["value"])
        left = x[:, tree["column"]] <= tree["below"]
        return np.where(left, self._walk(tree["left"], x), self._walk(tree["right"], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._walk(t, x) for t in self.model), np.zeros(len(x)))


def platt(score: np.ndarray, junk: np.ndarray, steps: int = 3_000, ridge: float = 0.02) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a score + b))), by gradient steps on the scaled scores with a small ridge.

    a stays positive, so that the order of the scores holds: checked pages of another kind than the texts can blur them, no more.
    """
    scale = float(np.abs(score).max()) or 1.0
    z, a, b = score / scale, 1.0, 0.0
    for _ in range(steps):
        wrong = 1 / (1 + np.exp(-(a * z + b))) - junk
        a, b = max(a - ((wrong * z).mean() + ridge * 0.1 * a), 0.1), b - (wrong.mean() + ridge * 0.1 * b)
    return a / scale, b


def trained(stats: DataFrame, train_rows: int = TRAIN_ROWS):
    """(model, a, b), or None if one kind is absent."""
    u = F.pmod(F.xxhash64("rec"), F.lit(1 << 40))
    share = F.col("prose_lines")
    label = F.when(share <= JUNK_LINES, 1).when(share >= PROSE_LINES, 0)
    labelled = stats.filter("words > 0").select(*STATS, label.alias("junk"), u.alias("u"), "rec").filter("junk is not null")
    # the checked pages lie in the test tables themselves; they are kept from the trees, not only their labels
    labelled = labelled.filter(~F.col("rec").isin([i for _, i, _, _ in CALIBRATION + EVALUATION]))
    rows = []
    for kind in (0, 1):
        # the labelled pages are few; the smallest hashes of each kind
        rows += labelled.filter(F.col("junk") == kind).orderBy("u", "rec").limit(train_rows).select(*STATS, "junk").collect()
    data = np.array(rows, dtype=float).reshape(len(rows), len(STATS) + 1)
    y = data[:, -1]
    if not len(y) or y.min() == y.max():
        return None
    model = Boosted().fit(data[:, :-1], y)
    score = model.score(np.array([s for *_, s in CALIBRATION], dtype=float))
    a, b = platt(score, np.array([junk for _, _, junk, _ in CALIBRATION], dtype=float))
    # one half lies well between the two kinds as the trees score them, even if the checked pages are of another kind than the texts
    own = model.score(data[:, :-1])
    prose, junk = np.median(own[y == 0]), np.median(own[y == 1])
    middle = np.clip(-b / a, prose + (junk - prose) / 4, junk - (junk - prose) / 4)
    return model, a, -a * middle


def page_quality(texts: DataFrame, rec: str, text: str, common: frozenset[str], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """rec, STATS, junk_probability."""
    share = min(1.0, LABEL_ROWS / max(texts.count(), 1))
    stats = cut(page_statistics(texts, rec, text, common, share))
    fit = trained(stats, train_rows)
    stats = stats.drop("prose_lines")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[STATS].to_numpy(float)
            if fit is None:
                p = 1 - b["running_lines"].to_numpy()
            else:
                model, a, bias = fit
                p = 1 / (1 + np.exp(-np.clip(a * model.score(x) + bias, -30, 30)))
            yield b.assign(junk_probability=np.where(b["words"] > 0, p, 1.0))

    return stats.mapInPandas(run, stats.schema.simpleString()[7:-1].replace(":", " ") + ", junk_probability double")


def common_words(table: DataFrame, most: int = COMMON_WORDS) -> frozenset[str]:
    """The list of common words. All of it goes to every task, so a table of more than `most` words is refused, not cut."""
    words = table.filter("word is not null").select(F.lower("word").alias("word")).distinct()
    n = words.count()
    if n > most:
        raise ValueError(f"{n} common words; at most {most} are taken")
    return frozenset(r[0] for r in words.collect())
