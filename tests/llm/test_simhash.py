import random
from itertools import combinations

import pytest
import xxhash

from seriesloom.llm import simhash
from seriesloom.llm.simhash import links, near_duplicates


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(texts):
    fps = {d: plain(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (f"{fps[d]:016x}", find(d)) for d in texts}


def got(df, **kw):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df, **kw).collect()}


def test_small_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df) == brute({r.doc_id: r.text for r in df.collect()})


def test_odd_texts_and_long_texts(spark):
    texts = {5: None, 3: "", 9: " \t\n ", 1: "A b", 2: "a B", 7: "é É x\x1cy z w", 8: "w " * 20000, 4: "w " * 20000, 6: "one two three four five"}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, fp string")
    assert got(df) == brute(texts)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("long_list", [4096, 2])
def test_links_join_what_all_pairs_join(spark, long_list):
    rng = random.Random(3)
    codes = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                at ^= 1 << b
            codes.add(at - (1 << 64) if at >= 1 << 63 else at)
    codes = sorted(codes)

    def classes(edges):
        root = {c: c for c in codes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return {c: min(d for d in codes if find(d) == find(c)) for c in codes}

    m = (1 << 64) - 1
    want = classes((a, b) for a, b in combinations(codes, 2) if ((a ^ b) & m).bit_count() <= 4)
    have = [tuple(r) for r in links(spark.createDataFrame([(c,) for c in codes], "fp long"), long_list=long_list).collect()]
    assert classes(have) == want
    assert simhash.LONG_LIST > 1000


@pytest.mark.parametrize("long_list", [4096, 2])
def test_exploded_tables_are_not_broadcast(spark, long_list, monkeypatch):
    """However small Spark takes them for."""
    plans = {}

    def seen(df, label, **options):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, label, **options)

    stored = simhash.stored
    monkeypatch.setattr(simhash, "stored", seen)
    df = spark.createDataFrame([(i, f"a b c d {i // 9}") for i in range(40)], "doc_id long, text string")
    last = near_duplicates(df, long_list=long_list)
    assert "BroadcastHashJoin" not in plans["lists"] and "SortMergeJoin" in plans["lists"]
    assert last._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0].count("SortMergeJoin") == 1
    edges = simhash._long_list_edges(spark.createDataFrame([(0, 0, 1 << 40), (0, 0, 3 << 40)], "s int, key long, fp long"), 4)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2  # the fixed table of flips, on either side
    assert [tuple(r) for r in edges.collect()] == [(1 << 40, 3 << 40)]
