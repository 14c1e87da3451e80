"""Column expressions on integer sequences: encodings, key estimate, figure keys, pitch names and counts' presentation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Encodings, their default lengths and the leap of the refined contour.
ENCODINGS = ("pitch", "interval", "scale_degree", "contour_refined", "contour_gross")
INDEXED = ("interval", "scale_degree", "contour_refined")
LENGTHS = (5, 7, 9)
LEAP = 2
# The Krumhansl-Schmuckler key profiles.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
# Pitch-class names.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def pitch_classes(p: Column) -> Column:
    return F.transform(p, lambda x: F.pmod(x, F.lit(12)))


def intervals(p: Column) -> Column:
    """Successive differences, one fewer than notes; empty for fewer than two notes."""
    steps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(F.size(p) < 2, F.array().cast("array<int>")).otherwise(steps)


def contour(p: Column, refined: bool) -> Column:
    def letter(d: Column) -> Column:
        if not refined:
            return F.when(d > 0, "U").when(d < 0, "D").otherwise("S")
        return F.when(d == 0, "S").when(d > LEAP, "U").when(d > 0, "u").when(d < -LEAP, "D").otherwise("d")

    return F.transform(intervals(p), letter)


def scale_degrees(p: Column, tonic: Column) -> Column:
    return _once(tonic, lambda t: F.transform(p, lambda x: F.pmod(x - t, F.lit(12))))


def key_scores(p: Column) -> Column:
    """24 scores, major before minor for each tonic: the pitch-class histogram's dot products with the turned profiles."""
    # one pass over the notes gives the histogram; a score is a pass over its 12 bins
    zero = F.array(*[F.lit(0)] * 12)
    counts = F.aggregate(p, zero, lambda acc, x: F.transform(acc, lambda v, i: F.when(i == F.pmod(x, F.lit(12)), v + 1).otherwise(v)))
    turned = F.array(*[F.array(*[F.lit(profile[(pc - tonic) % 12]) for pc in range(12)]) for tonic in range(12) for profile in (MAJOR, MINOR)])
    n = F.greatest(F.size(p), F.lit(1))
    share = F.transform(counts, lambda v: v / n)
    dot = lambda prof, bins: F.round(F.aggregate(F.zip_with(prof, bins, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 9)
    return _once(share, lambda bins: F.transform(turned, lambda prof: dot(prof, bins)))


def _once(value: Column, use) -> Column:
    """use(value), with value taken once for each row: bound to a variable, it is not repeated wherever use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def best_key(p: Column) -> Column:
    """0..23, tonic x 2 + (1 if minor); the first of equal scores. Empty sequences give 0."""
    first = _once(key_scores(p), lambda scores: F.array_position(scores, F.array_max(scores)).cast("int") - 1)
    return F.when(F.size(p) == 0, 0).otherwise(first)


def tokens(p: Column, encoding: str, tonic: Column | None = None) -> Column:
    """The tokens of a sequence under an encoding, as strings."""
    raw = {
        "pitch": lambda: pitch_classes(p), "interval": lambda: intervals(p), "scale_degree": lambda: scale_degrees(p, tonic),
        "contour_refined": lambda: contour(p, True), "contour_gross": lambda: contour(p, False),
    }[encoding]()
    return raw.cast("array<string>")


def width(encoding: str, n: int) -> int:
    """Tokens of an n-note figure."""
    return n if encoding in ("pitch", "scale_degree") else n - 1


def figure_key(encoding: Column | str, n: Column | int, body: Column) -> Column:
    enc = F.lit(encoding) if isinstance(encoding, str) else encoding
    return F.concat_ws(":", enc, (F.lit(n) if isinstance(n, int) else n).cast("string"), F.array_join(body, ","))


def pitch_name(p: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, NAMES)), F.pmod(p, F.lit(12)) + 1), (F.floor(p / 12) - 1).cast("string"))


def parse_pitches(text: Column) -> Column:
    """Whole numbers and note names (letter, accidentals, octave; octave 4 where none is readable), anything else dropped."""
    parts = F.filter(F.split(F.trim(F.lower(text)), r"[\s,]+"), lambda t: t != "")
    steps = F.create_map(*[F.lit(v) for kv in zip("cdefgab", (0, 2, 4, 5, 7, 9, 11)) for v in kv])

    def one(t: Column) -> Column:
        head, marks, rest = (F.regexp_extract(t, r"^([a-g])([#b♯♭]*)(.*)$", k) for k in (1, 2, 3))
        up = F.length(F.regexp_replace(marks, "[b♭]", ""))
        octave = F.coalesce(rest.try_cast("int"), F.lit(4))
        named = F.when(head != "", F.try_element_at(steps, head) + up - (F.length(marks) - up) + (octave + 1) * 12)
        return F.coalesce(t.try_cast("int"), named)

    return F.filter(F.transform(parts, one), lambda x: x.isNotNull())


def hz_to_midi(f: Column) -> Column:
    return F.when(f > 0, 69 + 12 * F.log2(f / 440)).otherwise(F.lit(0.0))


def midi_to_hz(p: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (p - 69) / 12)


def sequence_similarity(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence over the longer length, one row of the table at a time; 0 if either is empty."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def line(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.zip_with(b, F.arrays_zip(F.slice(row, 1, F.size(b)).alias("diagonal"), F.slice(row, 2, F.size(b)).alias("above")), lambda y, o: F.struct(y.alias("y"), o["diagonal"].alias("d"), o["above"].alias("u"))),
            F.array(F.lit(0)),
            lambda acc, c: F.concat(acc, F.array(F.when(c["y"] == x, c["d"] + 1).otherwise(F.greatest(c["u"], F.element_at(acc, -1))))),
        )

    last = F.aggregate(a, zero, line)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.element_at(last, -1) / F.greatest(F.size(a), F.size(b)))


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit a place of b; None equals nothing."""
    where: dict = {}
    for k, y in enumerate(b):
        if y is not None:
            where[y] = where.get(y, 0) | 1 << k
    full = (1 << len(b)) - 1
    free = full
    for x in a:
        hit = free & where.get(x, 0)
        free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


def long_similarity(a: Column, b: Column) -> Column:
    """sequence_similarity for sequences of any length, in Arrow batches."""

    @F.pandas_udf("double")
    def each(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([common_subsequence(x, y) / max(len(x), len(y)) if len(x) and len(y) else 0.0 for x, y in ((list(p), list(q)) for p, q in zip(xs, ys))], dtype="float64")

    return each(a, b)
