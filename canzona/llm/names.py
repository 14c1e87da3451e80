"""Variant spellings of names typed by people, each led back to the entity it stands for, or to none.

Every distinct value is read as a whole and in the parts that brackets, dashes, colons and slashes make of it. The padded
q-grams of its words are min-hashed and banded; the number of bands follows from the collision curve, so that a word with one
slip in six letters meets the known word with the wanted recall. A known name is met by the word without which no similarity
reaches the threshold: the last one of a person, the longest of an ensemble that is no kind of ensemble. Names that meet are
compared by Monge-Elkan similarity, whose inner measure knows slips, initials, abbreviations and short forms. Short forms come from
a table and are learned: a word typed with the last names of several entities of one given name, and hardly with others, is a
short form of it. Star clustering: the known names are the centres; each variant joins the most similar centre within the threshold.

Defined cases: NULL, empty values and placeholders stand for nobody. Of equally similar centres the smaller id is taken.
Values of any length are read whole. Values that repeat are compared once. Empty tables give no rows. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canzona.llm.neardup import mixed
from canzona.session import cut, hot_keys, replicated, salted, small

Q, ROWS, RECALL, AT = 2, 2, 0.999, 0.35
#: Monge-Elkan similarity from which a variant joins a centre, and the least a matched word may have.
THRESHOLD, LEAST_WORD = 0.88, 0.8

#: Words beside a name: forms of address, roles, small words.
BESIDE = frozenset("mr mrs ms miss mme mlle dr prof sgt capt sir rev sr jr sen jun esq comp arr arranger composer et al the of and by feat".split())
#: Short forms of given names in common use; others are learned from the values.
SHORT_FORMS = {
    "alexander": "alec alex sandy sasha lex", "anthony": "tony ant", "benjamin": "ben benny benji", "christopher": "chris kit topher",
    "dorothea": "dora dot dottie thea dolly", "edward": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betty eliza bess bessie libby lisa elsie",
    "frederick": "fred freddy freddie fritz", "gertrude": "trudy gert gertie", "henry": "harry hal hank", "josephine": "jo josie",
    "katherine": "kate kathy katie kitty kit kay", "leopold": "leo", "margaret": "maggie meg peggy greta madge marge daisy rita", "nicholas": "nick nicky",
    "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "rob bob bobby bert", "susannah": "sue susie susan",
    "theodore": "theo ted teddy", "valentina": "val tina", "wilhelmina": "mina minnie wilma billie", "william": "will willy willie bill billy liam",
}
#: A learned short form is typed with the last names of so many entities of its given name, of so large a part of all its last
#: names, and so many times as often as by chance.
LEARN_NAMES, LEARN_SHARE, LEARN_LIFT = 3, 0.6, 8.0
#: Short forms that are held in every task, at most: a dictionary, which does not grow with the values.
MOST_FORMS = 50_000
#: Kinds of ensembles and their irregular abbreviations; regular ones keep the first letter and the order.
KINDS = frozenset("orchestra quartet quintet trio string brass band choral choir society dance company ensemble singers chorus".split())
IRREGULAR = {"4tet": "quartet", "qtet": "quartet", "4tett": "quartet", "5tet": "quintet", "3o": "trio"}
_WORD = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"\s+-+\s+|\s+[–—]\s+|:\s|\s/\s|[()\[\]]")
#: A small word with a full stop before another word abbreviates a name.
_STOPPED = re.compile(r"\b(\w+)\.(?=\s*\w)")
#: These are titles and the like, with a full stop as without.
_SMALL = frozenset("the of and by".split())
_FOLD = str.maketrans({"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d"})


def folded(text: str) -> str:
    """Small letters without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().translate(_FOLD)) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """The words of a name, without those that only stand beside it; apostrophes close up."""
    plain = folded(text).replace("'", "").replace("’", "")
    stopped = {m.start() for m in _STOPPED.finditer(plain) if m[1] in _SMALL}
    return [m[0] for m in _WORD.finditer(plain) if m[0] not in BESIDE or m.start() in stopped]


def readings(value: str | None) -> list[list[str]]:
    """The word lists a value may be read as: as a whole, and in its parts."""
    value = value or ""
    parts = [value, *(_PARTS.split(value) if _PARTS.search(value) else [])]
    found = [words(p) for p in parts]
    return [w for k, w in enumerate(found) if w and w not in found[:k]]


def slips(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps between a and b, most + 1 if more."""
    if abs(len(a) - len(b)) > most or len(set(a) - set(b)) > most or len(set(b) - set(a)) > most:
        return most + 1
    before, above = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, above = above, row
    return min(above[-1], most + 1)


def _in_order(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def near_word(a: str, b: str) -> float:
    """Similarity of a word with slips to a known word."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if min(len(a), len(b)) < 3:
        return 0.0
    d = slips(a, b, 1 if n < 8 else 2)
    if d == 1:
        return 1 - 1 / max(n, 8)
    return 0.82 if d == 2 and n >= 9 and a[0] == b[0] else 0.0


class ShortForms:
    """Given name -> its short forms, and all of both."""

    def __init__(self, forms: dict[str, set[str]]) -> None:
        self.forms = forms
        self.all = set(forms).union(*forms.values())


def near_given(a: str, given: str, short: ShortForms) -> float:
    """Similarity of a typed to a known given name: short form, initial, abbreviation or slip."""
    if a == given:
        return 1.0
    mine = short.forms.get(given, ())
    if a in mine:
        return 0.97
    if len(a) == 1:
        return 0.9 if a == given[0] else 0.0
    if given.startswith(a):
        return 0.95
    # a slip must not turn one short form into another name's
    if a in short.all:
        return 0.0
    best = near_word(a, given)
    if len(a) >= 4:
        best = max([best, *(0.85 for s in mine if len(s) >= 4 and slips(a, s, 1) == 1)])
    return best


def near_kind(a: str, kind: str) -> float:
    """Similarity of a word to the kind of an ensemble."""
    a = IRREGULAR.get(a, a)
    if a == kind:
        return 1.0
    if len(a) == 1:
        return 0.9 if a == kind[0] else 0.0
    if 2 <= len(a) < len(kind) and a[0] == kind[0] and _in_order(a, kind) and a not in KINDS:
        return 0.95
    return 0.0 if a in KINDS else near_word(a, kind)


def monge_elkan(typed: list[str], known: list[str], ensemble: bool, short: ShortForms) -> float:
    """The mean similarity of each known word to its best typed word, 0 if a needed word has none or a typed word is left over."""
    # what is left over may be single letters only
    if sum(len(w) > 1 for w in typed) > len(known):
        return 0.0
    free = list(range(len(typed)))
    total, counted = 0.0, 0
    if ensemble:
        order = [(w, near_kind if w in KINDS else near_word) for w in sorted(known, key=lambda w: w in KINDS)]
    else:
        order = [(known[-1], near_word), *([(known[0], lambda a, given: near_given(a, given, short))] if len(known) > 1 else [])]
    for w, near in order:
        score, k = max(((near(typed[i], w), -i) for i in free), default=(0.0, 0))
        if score < LEAST_WORD:
            return 0.0
        free.remove(-k)
        total, counted = total + score, counted + 1
    middle = [] if ensemble else known[1:-1]
    for i in free:
        w = typed[i]
        fits = max((1.0 if w[0] == m[0] and 1 in (len(w), len(m)) or m.startswith(w) else near_word(w, m) for m in middle), default=0.0)
        if ensemble or len(w) > 1 and fits < LEAST_WORD:
            return 0.0
        # an initial more than the known name has is harmless, another one is not
        total, counted = total + (fits or (0.6 if middle else 0.9)), counted + 1
    return total / counted


def bands(at: float = AT, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands so that words of Jaccard similarity `at` collide with probability `recall`: 1 - (1 - at^rows)^bands."""
    return math.ceil(math.log(1 - recall) / math.log(1 - at**rows))


def band_keys(words_: list[str], n: int, rows: int = ROWS, q: int = Q) -> np.ndarray:
    """(words, n): one key a band from the min-hashes of the padded q-grams of each word."""
    pad = "#" * (q - 1)
    grams = [[hash_gram(p[k : k + q]) for k in range(len(p) - q + 1)] for p in (pad + w + pad for w in words_)]
    flat = np.array([g for x in grams for g in x], np.uint64)
    sizes = np.array([len(x) for x in grams], np.int64)
    starts = np.cumsum(sizes) - sizes
    keys = np.zeros((len(words_), n), np.uint64)
    for k in range(n if len(words_) else 0):
        key = np.full(len(words_), k, np.uint64)
        for r in range(rows):
            key = mixed(key ^ np.minimum.reduceat(mixed(flat, k * rows + r + 1), starts), r + 101)
        keys[:, k] = key
    return keys.view(np.int64)


def hash_gram(gram: str) -> int:
    return int.from_bytes(gram.encode("utf-8")[:8].ljust(8, b"\0"), "big")


def _banded(words_: DataFrame) -> DataFrame:
    """word, key of each band."""
    n = bands()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": np.repeat(b["word"].to_numpy(object), n), "key": band_keys(b["word"].tolist(), n).reshape(-1)})

    return words_.mapInPandas(run, "word string, key long")


def needed_words(name: str, ensemble: bool) -> list[str]:
    """Of the words of a known name those of which one must be typed nearly alike."""
    w = words(name)
    if not ensemble:
        return w[-1:]
    own = [x for x in w if x not in KINDS]
    return [max(own, key=len)] if own else w


def learned_forms(names: DataFrame, known: DataFrame) -> DataFrame:
    """form, given: words that stand beside the last names of several known persons of this given name, and hardly beside others."""

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(x, y) for v in b["value"] for r in readings(v) if len(r) <= 3 for i, x in enumerate(r) for j, y in enumerate(r) if i != j and len(x) > 1 and len(y) > 1}
            yield pd.DataFrame(list(rows), columns=["form", "last"])

    def persons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [words(n) for n in b["name"]]
            yield pd.DataFrame([(x[0], x[-1]) for x in w if len(x) > 1], columns=["given", "last"])

    people = cut(known.filter("kind is null or kind <> 'ensemble'").select("name").mapInPandas(persons, "given string, last string").distinct())
    lasts = people.select("last").distinct()
    total = lasts.count()
    typed = cut(names.mapInPandas(beside, "form string, last string").distinct().join(small(lasts, total), "last"))
    by_form = typed.groupBy("form").agg(F.count("*").alias("of"))
    by_given = people.groupBy("given").agg(F.count("*").alias("held"))
    pairs = typed.join(small(people, people.count()), "last").groupBy("form", "given").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("of")
    return (
        pairs.join(by_form, "form").join(by_given, "given")
        .filter((F.col("form") != F.col("given")) & (F.col("n") >= LEARN_NAMES) & (share >= LEARN_SHARE) & (share * total >= LEARN_LIFT * F.col("held")))
        .select("form", "given")
    )


def linked_values(values: DataFrame, known: DataFrame, hot_rows: int = 50_000, short_forms: dict[str, str] = SHORT_FORMS) -> DataFrame:
    """value, artist_id, score: the centre each distinct value of `value` joins. known: artist_id, name, kind."""
    tasks = values.sparkSession.sparkContext.defaultParallelism * 2

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, w) for v in b["value"] for w in {w for r in readings(v) for w in r if len(w) > 1}]
            yield pd.DataFrame(rows, columns=["value", "word"])

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, k, w) for i, n, k in zip(b["artist_id"], b["name"], b["kind"]) for w in needed_words(n, k == "ensemble")]
            yield pd.DataFrame(rows, columns=["artist_id", "name", "kind", "known_word"])

    known = known.select(F.col("artist_id").cast("long").alias("artist_id"), "name", "kind").filter("artist_id is not null and name is not null")
    names = cut(values.select("value").filter("value is not null").distinct().repartition(tasks))
    spoken = cut(names.mapInPandas(split, "value string, word string"))
    by_word = cut(known.mapInPandas(needed, "artist_id long, name string, kind string, known_word string"))
    theirs = cut(_banded(by_word.select(F.col("known_word").alias("word")).distinct()).withColumnRenamed("word", "known_word"))
    meets = _banded(spoken.select("word").distinct().repartition(tasks)).join(small(theirs, theirs.count()), "key").select("word", "known_word").distinct()

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near_word(x, y) >= LEAST_WORD for x, y in zip(a, b)], dtype=bool)

    meets = cut(meets.repartition(tasks).filter(close("word", "known_word")))
    near = cut(meets.join(by_word, "known_word").select("word", "artist_id", "name", "kind").distinct())
    forms = {k: set(v.split()) for k, v in short_forms.items()}
    rows = learned_forms(names, known).limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} short forms learned")
    for r in rows:
        forms.setdefault(r["given"], set()).add(r["form"])
    short = ShortForms(forms)
    # one word, a common last name, may be in a large part of all values
    hot = cut(hot_keys(spoken, "word", hot_rows))
    hot = small(hot, hot.count())
    pairs = salted(spoken, hot, "word", F.col("value")).join(replicated(near, hot, "word"), ["word", "salt"]).select("value", "artist_id", "name", "kind").distinct()

    @F.pandas_udf("double")
    def similarity(value: pd.Series, name: pd.Series, kind: pd.Series) -> pd.Series:
        read: dict[str, list[list[str]]] = {}
        out = []
        for v, n, k in zip(value, name, kind):
            if v not in read:
                read[v] = readings(v)
            w = words(n)
            out.append(max((monge_elkan(x, w, k == "ensemble", short) for x in read[v]), default=0.0) if w else 0.0)
        return pd.Series(out, dtype=float)

    scored = pairs.repartition(tasks).withColumn("score", similarity("value", "name", "kind")).filter(F.col("score") >= THRESHOLD)
    return scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("artist_id")).alias("nid"))).alias("s")).select(
        "value", (-F.col("s.nid")).alias("artist_id"), F.col("s.score").alias("score")
    )


def named(mentions: DataFrame, known: DataFrame, hot_rows: int = 50_000) -> DataFrame:
    """mentions (field, rec, value) with artist_id, only those that name a known entity."""
    links = cut(linked_values(mentions, known))
    hot = cut(hot_keys(mentions.filter("value is not null"), "value", hot_rows))
    hot = small(hot, hot.count())
    rows = salted(mentions.filter("value is not null"), hot, "value", F.col("rec"))
    return rows.join(replicated(links, hot, "value"), ["value", "salt"]).select("field", "rec", "value", "artist_id", "score")


def mentions(works: DataFrame, edges: DataFrame) -> DataFrame:
    """field, rec, value of the three name fields."""
    link = F.concat_ws("|", "src", "dst", "source")
    return works.select(F.lit("works.artist").alias("field"), F.col("doc_id").cast("string").alias("rec"), F.col("artist").alias("value")).unionByName(
        edges.select(F.lit("edges.src_label").alias("field"), link.alias("rec"), F.col("src_label").alias("value"))
    ).unionByName(edges.select(F.lit("edges.dst_label").alias("field"), link.alias("rec"), F.col("dst_label").alias("value")))
