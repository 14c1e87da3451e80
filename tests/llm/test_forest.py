import random

from canzona.llm import neardup
from canzona.llm.sequences import copy_classes, record_pairs, sequences


def test_large_family_near_one_half(spark):
    rng = random.Random(9)
    base = [[rng.randrange(10_000) for _ in range(10)] for _ in range(12)]
    rows = [(k, [x for block in base for x in (block if rng.random() < 0.82 else [rng.randrange(10_000) for _ in range(10)])]) for k in range(220)]
    runs = {k: {tuple(s[i:i + 5]) for i in range(len(s) - 4)} for k, s in rows}
    want = {(a, b) for a in runs for b in runs if a < b and 2 * len(runs[a] & runs[b]) >= len(runs[a] | runs[b])}
    classes, members = copy_classes(sequences(spark.createDataFrame(rows, "id bigint, seq array<int>"), "id", "seq", 16))
    got = {tuple(r) for r in record_pairs(neardup.near_classes(classes, region=3), members).collect()}
    print(len(want), len(want - got))
    assert got <= want and len(want) > 5_000
    # (1 - s^2 p)^TREES: 0.07 % at one half
    assert len(want - got) <= 0.001 * len(want)


def test_full_to_the_last_round(spark):
    rng = random.Random(10)
    base = [rng.randrange(10_000) for _ in range(80)]
    rows = [(k, base[:40] + [rng.randrange(10_000)] + base[41:]) for k in range(150)]
    classes, members = copy_classes(sequences(spark.createDataFrame(rows, "id bigint, seq array<int>"), "id", "seq", 16))
    got = [tuple(r) for r in record_pairs(neardup.near_classes(classes, region=20), members).collect()]
    assert len(got) == len(set(got)) == 150 * 149 // 2


def test_regions_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    keys = sorted((rng.randrange(12), rng.randrange(3)) for _ in range(300))
    rows = [(r, l, 100 + k, 10) for k, (r, l) in enumerate(keys)]
    want, full = set(), set()
    for key in set(keys):
        mine = [c for r, l, c, _ in rows if (r, l) == key]
        if len(mine) > 9:
            full |= set(mine)
        else:
            want |= {(a, b) for a in mine for b in mine if a < b}
    assert want and full
    for size in (1, 2, 3, 7, 50, 300):
        batches = (pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows[k:k + size])], names=["region", "label", "cls", "n"]) for k in range(0, 300, size))
        out = [r for b in neardup.neighbours(9)(batches) for r in b.to_pylist()]
        pairs, rest = [(r["a"], r["b"]) for r in out if r["a"] is not None], [r["cls"] for r in out if r["a"] is None]
        assert sorted(pairs) == sorted(want) and sorted(rest) == sorted(full)
