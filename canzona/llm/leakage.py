"""Evaluation passages that appear, whole or in part, in a corpus of pages.

Latent semantic retrieval: the terms are the words of the passages and their pairs of neighbours, weighted by TF-IDF whose
document frequencies count the blocks of all pages. A distributed randomised SVD of the passages' segments (a Gaussian sketch
summed over the executors, then Nystroem) gives the latent space. Each window of a page, two neighbouring blocks of words, is
compared with all segments by the cosine there; what comes near is compared again by the terms themselves. Every candidate page
is then aligned whole with the passage: the longest common run of passage words in page order, which may jump over foreign lines
and pass broken, misread, joined or split words, but never a word of the passage. Paraphrases (`paraphrased`) are checked by
their longest common subsequence with the passage and by the answer to the question.

The passages are a stated query set; they are searched in blocks of about ITEM_BLOCK, so that what each executor holds is
bounded. The basis is fitted on all segments of a block, no sample is taken; every window of every page is searched.

Characters that scans confuse are one character here (`canonical`), in pages and passages alike.

Defined cases: NULL or empty texts and passages match nothing. Passages shorter than `least` words cannot leak. Pages are
searched whole, however long. Rows repeated under one id are searched each and give one result. NULL ids are skipped.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, BLOCK, SEGMENT, SEGMENT_STRIDE = 20, 30, 24, 12
#: Passages searched at once; more are searched block by block. Partial sums of the sketch.
ITEM_BLOCK, SKETCHES = 400, 3
RANK, EXTRA = 384, 16
#: The cosine in the latent space from which a window is a candidate, and the least overlap in the terms themselves.
NEAR, OVERLAP = 0.4, 0.3
#: The least part of a window's length that counts as its length in the latent space.
GUARD = 0.35
#: Terms in more than this share of the blocks, and this number besides, say nothing about a passage.
COMMON, COMMON_LEAST = 0.0125, 20
#: Part of a passage's words that a paraphrase keeps in order.
LCS_SHARE = 0.6
#: Lines that may stand between two parts of a quotation: other columns and adverts.
GAP_LINES = 8
#: A run may miss so many words at its ends, where a misread word cannot be told from the next one of the page.
SLACK = 1

_BROKEN = re.compile(r"[-=¬‐‑­]\s*\n")
_TOKEN = re.compile(r"[^\W_]+")
_SAME = str.maketrans(
    {**dict.fromkeys("0aöäàáâø", "o"), **dict.fromkeys("1ijíî", "l"), **dict.fromkeys("5fſt", "s"), **dict.fromkeys("eéèêë", "c"), **dict.fromkeys("b68", "h"), **dict.fromkeys("uvüùû", "n")}
)


_PUNCTUATION = str.maketrans(dict.fromkeys("—–‐‑’‘“”„•□■…―", " ") | {"ſ": "s"})


def _table(fold: bool) -> bytes:
    """Of each Latin-1 character its small letter, or, folded, its canonical character and a space for what is in no word."""
    out = bytearray()
    for k in range(256):
        c = chr(k) if k == 0xB5 else chr(k).lower()
        if fold:
            c = c.translate(_SAME) if c.isalnum() else c if c == "\n" else " "
        out += c.encode("latin-1")
    return bytes(out)


_LOWER, _FOLDED = _table(False), _table(True)


def canonical(text: str) -> str:
    """text in small letters, with characters and pairs that scans confuse made one, and spaces for what is in no word."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        text = text.translate(_PUNCTUATION)
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            plain = text.lower().replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "u").translate(_SAME)
            return "\n".join(" ".join(_TOKEN.findall(part)) for part in plain.split("\n"))
    raw = raw.translate(_LOWER).replace(b"rn", b"m").replace(b"vv", b"w").replace(b"cl", b"d").replace(b"ii", b"u")
    return raw.translate(_FOLDED).decode("latin-1")


def passage_words(text: str | None) -> list[str]:
    return canonical(text or "").split()


class Page:
    """The words of a page with their line and their distance from both ends of it."""

    def __init__(self, text: str) -> None:
        self.words, self.line, self.first, self.last = [], [], [], []
        for k, part in enumerate(canonical(text).split("\n")):
            w = part.split()
            self.words += w
            self.line += [k] * len(w)
            self.first += range(len(w))
            self.last += range(len(w) - 1, -1, -1)
        # letters before each word, and which letters each word has
        self.size = [0, *accumulate(map(len, self.words))]
        self.mask = list(map(_letters, self.words))


@lru_cache(1 << 17)
def _letters(word: str) -> int:
    """A bit for each letter of the word."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(1 << 18)
def alike(a: str, b: str) -> bool:
    """Within an edit distance of three tenths of the longer string, one at least from two characters on."""
    if a == b:
        return True
    n = max(len(a), len(b))
    most = max(1, n * 3 // 10) if n > 1 else 0
    if abs(len(a) - len(b)) > most:
        return False
    # each edit takes away one letter and brings another at most
    m1, m2 = _letters(a), _letters(b)
    if (m1 & ~m2).bit_count() > most or (m2 & ~m1).bit_count() > most:
        return False
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        least = i
        for j, y in enumerate(b, 1):
            d = above[j - 1]
            if x != y:
                e, g = above[j], row[-1]
                d = (d if d <= e and d <= g else e if e <= g else g) + 1
            row.append(d)
            if d < least:
                least = d
        if least > most:
            return False
        above = row
    return above[-1] <= most


#: (passage words, page words) of a step over misread, joined or split words, the last of each being alike.
_STEPS = [(2, 2), (2, 3), (3, 2), (3, 3), (2, 4), (3, 4)]


def longest_run(page: Page, passage: list[str], lo: int, hi: int, enough: int, shorter: bool = True) -> int:
    """Words of the longest run of the passage in the page's words lo..hi; stops at `enough`; without `shorter`, runs that cannot reach it count 0."""
    words, line, first, last, size, mask = page.words, page.line, page.first, page.last, page.size, page.mask
    where: dict[str, list[int]] = {}
    # a step passes two words of the passage at most, so words in no such chain of the page's words start or carry no run
    here = set(words[lo:hi])
    chain: list[int] = []
    for k in [*(k for k, w in enumerate(passage) if w in here), len(passage) + 9]:
        if chain and k - chain[-1] > 3:
            if shorter or chain[-1] - chain[0] + 1 >= enough:
                for j in chain:
                    where.setdefault(passage[j], []).append(j)
            chain = []
        chain.append(k)
    if not where:
        return 0
    wide = len(passage) + 4
    # letters and their number in the words that a step of 2 or 3 passes before each passage word
    m1 = [0, *map(_letters, passage)]
    n1 = [0, *map(len, passage)]
    passed = {1: [], 2: list(zip(m1, n1)), 3: [(a | b, x + y) for a, b, x, y in zip(m1, [0, *m1], n1, [0, *n1])]}
    ends: list[list] = [[] for _ in passage]  # where runs reached each passage word near a line's end: (page word, (score, start))
    inner: list[list] = [[] for _ in passage]  # and elsewhere
    cells: dict[int, tuple[float, int]] = {}  # by page word x wide + passage word
    top = 0.0
    run = 0
    for t in range(lo, hi):
        for p in where.get(words[t], ()):
            best = (1.0, p)
            before = cells.get((t - 1) * wide + p - 1) if p else None
            if before:
                best = (before[0] + 1, before[1])
            else:
                for dp, dt in _STEPS:
                    c = cells.get((t - dt) * wide + p - dp) if p >= dp else None
                    if c and c[0] + dp - 0.1 > best[0]:
                        # the same bounds as in alike, without the words
                        letters, n = passed[dp][p]
                        here_n = size[t] - size[t - dt + 1]
                        most = (n if n > here_n else here_n) * 3 // 10 or 1
                        if -most <= n - here_n <= most:
                            here_letters = mask[t - 1] if dt == 2 else mask[t - 1] | mask[t - 2] if dt == 3 else mask[t - 1] | mask[t - 2] | mask[t - 3]
                            if (letters & ~here_letters).bit_count() <= most >= (here_letters & ~letters).bit_count() and alike("".join(words[t - dt + 1 : t]), "".join(passage[p - dp + 1 : p])):
                                best = (c[0] + dp - 0.1, c[1])
                f, at = first[t], line[t]
                # a run leaves a line at its end or enters one at its start; a word broken there is put together
                for dp in (1, 2, 3) if f <= 2 else (1,):
                    if p < dp:
                        break
                    for where_from in (ends[p - dp], inner[p - dp]) if f == 0 and dp == 1 else (ends[p - dp],):
                        for t2, c in reversed(where_from):
                            if line[t2] < at - GAP_LINES:
                                break
                            e = last[t2]
                            score = c[0] + dp - (1.5 if f and e else 1.0)
                            if line[t2] == at or score <= best[0]:
                                continue
                            if dp == 1:
                                if f == 0 or e == 0:
                                    best = (score, c[1])
                            elif f + e > 0:
                                n = passed[dp][p][1]
                                here_n = size[t2 + 1 + e] - size[t2 + 1] + size[t] - size[t - f]
                                most = (n if n > here_n else here_n) * 3 // 10 or 1
                                if -most <= n - here_n <= most and alike("".join(words[t2 + 1 : t2 + 1 + e]) + "".join(words[t - f : t]), "".join(passage[p - dp + 1 : p])):
                                    best = (score, c[1])
            cells[t * wide + p] = best
            (ends if last[t] <= 2 else inner)[p].append((t, best))
            if best[0] > top:
                top, run = best[0], p - best[1] + 1
                if run >= enough:
                    return run
    return run


def lcs_words(page: list[str], passage: list[str], lo: int, hi: int) -> int:
    """Length of the longest common subsequence of page[lo:hi] and the passage, bit-parallel over the passage's words."""
    at: dict[str, int] = {}
    for k, w in enumerate(passage):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(passage)) - 1
    row = full
    for w in page[max(lo, 0) : hi]:
        m = at.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(passage) - row.bit_count()


def _words(text: str | None) -> list[str]:
    return canonical(_BROKEN.sub("", text or "")).split()


class Terms:
    """The words of the passages and their pairs of neighbours, numbered; texts become occurrences of these terms in blocks."""

    def __init__(self, passages: list[list[str]]) -> None:
        self.word = {w: k for k, w in enumerate(sorted({w for ws in passages for w in ws}))}
        ids = [self.ids(w) for w in passages]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[:-1] * len(self.word) + x[1:] for x in ids)]))
        self.size = len(self.word) + len(self.pairs)

    def ids(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for those of no passage."""
        return np.fromiter(map(self.word.get, words, repeat(-1)), np.int64, len(words))

    def blocks(self, texts: list[np.ndarray], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, term) of each occurrence in order of the blocks, a pair lying where its second word does; and the text of each block."""
        sizes = np.array([len(x) for x in texts], np.int64)
        count = -(-sizes // block)
        owner = np.repeat(np.arange(len(texts)), count)
        w = np.concatenate([np.zeros(0, np.int64), *texts])
        text = np.repeat(np.arange(len(texts)), sizes)
        where = (np.cumsum(count) - count)[text] + (np.arange(len(w)) - (np.cumsum(sizes) - sizes)[text]) // block
        known = np.flatnonzero(w >= 0)
        second = known[1:][(known[1:] - known[:-1] == 1) & (text[known[1:]] == text[known[:-1]])]
        key = w[second - 1] * len(self.word) + w[second]
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        held = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        b = np.concatenate([where[known], where[second[held]]])
        term = np.concatenate([w[known], len(self.word) + at[held]])
        order = np.argsort(b, kind="stable")
        return b[order], term[order], owner


def _counted(pages: DataFrame, terms: Terms) -> tuple[int, np.ndarray]:
    """The number of blocks of all pages, and of each term the number of blocks that have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(terms.size, np.int64), 0
        for b in batches:
            for lo in range(0, len(b), 128):  # what fits the cache
                block, term, owner = terms.blocks([terms.ids(_words(t)) for t in b["text"].iloc[lo : lo + 128]])
                n += len(owner)
                df += np.bincount(np.unique(block * terms.size + term) % terms.size, minlength=terms.size)
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-1, seen], "df": np.r_[n, df[seen]]})

    counts = pages.select("text").mapInPandas(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # one row a term
    df = np.zeros(terms.size + 1)
    df[counts["term"]] = counts["df"]  # the blocks' number, of term -1, comes last
    return int(df[-1]), df[:-1]


def weights(blocks: int, df: np.ndarray) -> np.ndarray:
    """Inverse document frequency; terms in more than a share of the blocks and a number besides say nothing and weigh 0."""
    return np.where(df > COMMON * blocks + COMMON_LEAST, 0, np.log((blocks + 2) / (df + 1))).astype(np.float32)


def _segments(passages: list[list[str]], terms: Terms, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping segments of the passages as weighted rows of length 1: (row, term, value), sorted; of each row its passage and length before."""
    parts, owner = [], []
    for k, w in enumerate(passages):
        for s in range(0, max(1, len(w) - SEGMENT + SEGMENT_STRIDE), SEGMENT_STRIDE):
            parts.append(terms.ids(w[s : s + SEGMENT]))
            owner.append(k)
    row, term, _ = terms.blocks(parts, SEGMENT)
    key = np.unique(row[weight[term] > 0] * terms.size + term[weight[term] > 0])
    row, term = key // terms.size, key % terms.size
    value = weight[term]
    norm = np.sqrt(np.bincount(row, value.astype(float) ** 2, len(owner)))
    return row, term, (value / np.maximum(norm, 1e-9)[row]).astype(np.float32), np.array(owner, np.int64), norm


def _summed(at: np.ndarray, rows: np.ndarray, value: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the sum of value x rows of `of`; at is sorted. In pieces that fit the cache."""
    out = np.zeros((n, of.shape[1]), np.float32)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    for s in range(0, len(starts), 64):
        begin, end = starts[s], starts[s + 64] if s + 64 < len(starts) else len(at)
        part = starts[s : s + 64]
        out[at[part]] = np.add.reduceat(of[rows[begin:end]] * value[begin:end, None], part - begin, axis=0)
    return out


def latent_basis(spark: SparkSession, passages: list[list[str]], terms: Terms, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the passages' segments by a randomised SVD: a Gaussian sketch summed over the executors, then Nystroem."""
    width = min(rank + EXTRA, terms.size)

    def omega() -> np.ndarray:
        return np.random.default_rng(7).standard_normal((terms.size, width), dtype=np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [w.split() for b in batches for w in b["words"]]
        row, term, value, owner, _ = _segments(mine, terms, weight)
        y = _summed(row, term, value, omega(), len(owner))
        order = np.argsort(term, kind="stable")
        total = _summed(term[order], row[order], value[order], y, terms.size)
        yield pd.DataFrame({"sum": [total.tobytes()]})

    held = spark.createDataFrame(pd.DataFrame({"words": [" ".join(w) for w in passages]}), "words string")
    total = np.zeros((terms.size, width), np.float32)
    for part in held.repartition(SKETCHES).mapInPandas(run, "sum binary").toLocalIterator():  # one matrix of terms x rank at a time
        total += np.frombuffer(part[0], np.float32).reshape(total.shape)
    inner = (omega().T @ total).astype(np.float64)
    s, u = np.linalg.eigh((inner + inner.T) / 2)
    keep = s > 1e-6 * max(s.max(initial=0), 1e-12)
    half = total @ (u[:, keep] / np.sqrt(s[keep])).astype(np.float32)
    del total
    # the left singular vectors of half are those of its small Gram matrix
    s, u = np.linalg.eigh((half.T @ half).astype(np.float64))
    keep = np.flatnonzero(s > 1e-4 * max(s.max(initial=0), 1e-12))[::-1][:rank]  # less is rounding
    return half @ (u[:, keep] / np.sqrt(s[keep])).astype(np.float32)


class Search:
    """The passages in the latent space of their segments, ready to be searched with pages."""

    def __init__(self, passages: list[list[str]], terms: Terms, weight: np.ndarray, basis: np.ndarray) -> None:
        self.terms, self.weight = terms, weight
        row, term, value, self.owner, self.length = _segments(passages, terms, weight)
        q = _summed(row, term, value, basis, len(self.owner))
        self.basis = basis
        self.basis *= weight[:, None]
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T.copy()
        #: The segments' own values, to compare without the latent space.
        self.keys, self.values = row * terms.size + term, value

    def near(self, texts: list[np.ndarray], near: float, overlap: float) -> list[tuple[int, int]]:
        """(text, passage): two neighbouring blocks of the text come near a segment, in the latent space and then in the terms themselves."""
        block, term, owner = self.terms.blocks(texts)
        some = self.weight[term] > 0
        block, term = block[some], term[some]
        if not len(block):
            return []
        n, one = len(owner), np.ones(len(term), np.float32)
        latent = _summed(block, term, one, self.basis, n)
        energy = np.bincount(block, self.weight[term].astype(float) ** 2, n)
        goes_on = np.flatnonzero(owner[1:] == owner[:-1])
        latent[goes_on] += latent[goes_on + 1]
        energy[goes_on] += energy[goes_on + 1]
        norm = np.sqrt(energy)
        # of a window hardly in the latent space the direction there means little
        latent /= np.maximum(np.maximum(np.linalg.norm(latent, axis=1), GUARD * norm), 1e-9)[:, None]
        hit, seg = np.nonzero(latent @ self.queries >= near)
        if not len(hit):
            return []
        begin = np.searchsorted(block, np.arange(n + 1))
        last = np.arange(n)
        last[goes_on] += 1
        lo, size = begin[hit], begin[last[hit] + 1] - begin[hit]
        which = np.repeat(np.arange(len(hit)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        once = np.unique(which * self.terms.size + term[at])
        which, found = once // self.terms.size, once % self.terms.size
        key = seg[which] * self.terms.size + found
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        product = np.bincount(which, np.where(self.keys[place] == key, self.values[place] * self.weight[found], 0), len(hit))
        # the geometric mean of the cosine and the part of the segment that the window has
        keep = product >= overlap * np.sqrt(norm[hit] * self.length[seg])
        return sorted(set(zip(owner[hit[keep]].tolist(), self.owner[seg[keep]].tolist())))


def leaked(pages: DataFrame, items: DataFrame, rec: str = "doc_id", text: str = "text", least: int = LEAST, near: float = NEAR, overlap: float = OVERLAP, verify: bool = True) -> DataFrame:
    """doc_id, item_id: the pages that print at least `least` consecutive words of a passage. verify=False: all near pairs."""

    def check(page: Page, passage: list[str], question: list[str]) -> bool:
        return not verify or longest_run(page, passage, 0, len(page.words), least - SLACK, False) >= least - SLACK

    return _searched(pages, items, rec, text, least, near, overlap, check)


def paraphrased(pages: DataFrame, items: DataFrame, rec: str = "doc_id", text: str = "text", least: int = LEAST, share: float = LCS_SHARE) -> DataFrame:
    """doc_id, item_id: the pages that tell a passage in other words, without `least` consecutive ones of it.

    The longest common subsequence of the passage and a stretch of the page one and a half times as long holds `share` of the
    passage's words; and the answer is there: of the question's words that the passage has, the stretch has one, if there are any.
    """

    def check(page: Page, passage: list[str], question: list[str]) -> bool:
        width = len(passage) * 3 // 2
        asked = set(question) & set(passage)
        for lo in range(0, max(1, len(page.words) - width // 2), max(width // 3, 1)):
            if lcs_words(page.words, passage, lo, lo + width) >= share * len(passage) and (not asked or asked & set(page.words[lo : lo + width])):
                return longest_run(page, passage, 0, len(page.words), least - SLACK, False) < least - SLACK
        return False

    return _searched(pages, items, rec, text, least, NEAR, OVERLAP, check)


def _searched(pages: DataFrame, items: DataFrame, rec: str, text: str, least: int, near: float, overlap: float, check: Callable[[Page, list[str], list[str]], bool]) -> DataFrame:
    """doc_id, item_id of the near pairs that pass the check, the passages taken in blocks of about ITEM_BLOCK."""
    pages = pages.select(F.col(rec).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    asked = F.col("question") if "question" in items.columns else F.lit(None).cast("string")
    items = items.filter("item_id is not null and passage is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage", asked.alias("question"))
    n = -(-items.count() // ITEM_BLOCK)
    found = pages.select("doc_id", F.col("doc_id").cast("long").alias("item_id")).filter("false")
    for k in range(n):
        # a block is bounded whatever the number of passages
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        one = _block(pages, [(r[0], passage_words(r[1]), passage_words(r[2])) for r in rows], least, near, overlap, check)
        found = found.unionByName(one) if one is not None else found
    return found.distinct()


def _block(pages: DataFrame, items: list[tuple[int, list[str], list[str]]], least: int, near: float, overlap: float, check: Callable[[Page, list[str], list[str]], bool]) -> DataFrame | None:
    items = sorted(x for x in items if len(x[1]) >= least)
    if not items:
        return None
    passages = [x[1] for x in items]
    terms = Terms(passages)
    weight = weights(*_counted(pages, terms))
    search = Search(passages, terms, weight, latent_basis(pages.sparkSession, passages, terms, weight))
    search = pages.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = search.value
        for big in batches:
            docs, held = [], []
            for lo in range(0, len(big), 128):
                texts = big["text"].iloc[lo : lo + 128].tolist()
                read: dict[int, Page] = {}
                for k, item in s.near([s.terms.ids(_words(t)) for t in texts], near, overlap):
                    if k not in read:
                        read[k] = Page(texts[k])
                    if check(read[k], passages[item], items[item][2]):
                        docs.append(big["doc_id"].iloc[lo + k])
                        held.append(items[item][0])
            yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="int64"), "item_id": pd.Series(held, dtype="int64")})

    return pages.mapInPandas(run, "doc_id long, item_id long")
