import random

import pytest

from canzona.operators.hierarchy import descendants, hierarchy
from canzona.operators.orphans import orphans

EDGES = "src string, dst string, fetched_at double"


def placed(spark, rows, **how):
    return {r.node: (r.root, r.depth, r.status) for r in hierarchy(spark.createDataFrame(rows, EDGES), **how).collect()}


def test_trees_rings_and_latest_links(spark):
    rows = [("b", "a", 1.0), ("c", "b", 1.0), ("c", "x", 0.5), ("r1", "r2", 1.0), ("r2", "r1", 1.0), ("u", "r2", 1.0), ("s", "s", None), (None, "n", 1.0), ("m", None, 1.0)]
    got = placed(spark, rows)
    assert got["c"] == ("a", 2, "tree") and got["x"] == ("x", 0, "tree") and got["n"] == ("n", 0, "tree") and got["m"] == ("m", 0, "tree")
    assert got["r1"] == ("r1", 0, "cycle") and got["r2"] == ("r1", 0, "cycle") and got["u"] == ("r1", 1, "below_cycle") and got["s"] == ("s", 0, "cycle")


def test_empty_edges_and_extra_columns(spark):
    assert placed(spark, []) == {}
    df = spark.createDataFrame([("b", "a", 1.0, 7, 8)], EDGES + ", root int, depth int")
    assert {r.node for r in hierarchy(df).collect()} == {"a", "b"}


def test_deep_chain_hot_parent_and_paths(spark):
    rows = [(f"n{k + 1:03d}", f"n{k:03d}", 1.0) for k in range(30)] + [(f"leaf{k:03d}", "n010", 1.0) for k in range(200)]
    df = hierarchy(spark.createDataFrame(rows, EDGES), paths=True, hot_rows=20).cache()
    got = {r.node: r for r in df.collect()}
    assert got["n030"].depth == 30 and got["n030"].path[0] == "n000" and len(got["n030"].path) == 31
    assert len(got) == 231 and all(got[f"leaf{k:03d}"].depth == 11 for k in range(200))
    assert descendants(df).filter("ancestor = 'n010'").count() == 220


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"{k}", f"{rng.randrange(120)}", rng.random()) for k in range(120) for _ in range(rng.randrange(3))]
    parent = {}
    for s, d, t in rows:
        parent[s] = max(parent.get(s, (-1, "")), (t, d))
    parent = {s: d for s, (_, d) in parent.items()}
    want = {}
    for n in {x for s, d, _ in rows for x in (s, d)}:
        seen, at = [], n
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            ring = seen[seen.index(at):]
            want[n] = (min(ring), 0 if n in ring else seen.index(at), "cycle" if n in ring else "below_cycle")
        else:
            want[n] = (at, len(seen), "tree")
    assert placed(spark, rows) == want


def test_orphans_against_brute_force(spark):
    rng = random.Random(5)
    stamp = lambda k: f"2023-{1 + k // 28:02d}-{1 + k % 28:02d}"
    parents = [(rng.randrange(8), rng.randrange(200) if rng.random() > 0.1 else None, rng.choice([None, rng.randrange(200)])) for _ in range(14)]
    refs = [(rng.choice([None, *range(10)]), rng.choice([None, *range(200)]), k) for k in range(300)]
    day = lambda x: None if x is None else f"{stamp(x)} 00:00:00"
    p = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in parents], "key int, a string, b string").selectExpr("key", "cast(a as timestamp_ntz) a", "cast(b as timestamp_ntz) b")
    r = spark.createDataFrame([(k, day(t), i) for k, t, i in refs], "key int, t string, reason int").selectExpr("key", "cast(t as timestamp_ntz) t", "reason i", "'x' period")
    want = set()
    for k, t, i in refs:
        own = [x for x in parents if x[0] == k]
        if k is None or (t is None and own):
            continue
        if not own:
            want.add((i, "missing"))
        elif not any(a is not None and a <= t and (b is None or b > t) for _, a, b in own):
            first = min((a for _, a, _ in own if a is not None), default=None)
            want.add((i, "late" if first is not None and first > t else "deleted"))
    for hot in (50_000, 5):
        assert {(x.i, x.reason) for x in orphans(r, p, "key", "t", "a", "b", hot_rows=hot).collect()} == want
    assert orphans(r.limit(0), p, "key", "t", "a", "b").count() == 0
    assert {x.reason for x in orphans(r, p.limit(0), "key", "t", "a", "b").collect()} == {"missing"}
    assert {x.key for x in orphans(r, p, "key", "t").collect()} == {k for k, _, _ in refs if k is not None} - {x[0] for x in parents}


def test_lists_that_grow_are_refused(spark):
    from canzona.session import few

    names = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "name string")
    assert few(names, "name") == ["a", "b"]
    with pytest.raises(ValueError):
        few(names, "name", most=1)


def test_katz_without_a_limit_is_told(spark):
    from canzona.operators import graph

    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {r.node: round(r.score, 6) for r in graph.katz(ring, 0.1).collect()} == {"a": round(1 / 0.9, 6), "b": round(1 / 0.9, 6)}
    with pytest.raises(ValueError):
        graph.katz(ring, 1.5, rounds=8)
    assert graph.katz(ring.limit(0)).count() == 0
