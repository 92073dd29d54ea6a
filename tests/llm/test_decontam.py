import hashlib
import re
from collections import Counter

import pytest

from seriesloom.llm import decontam
from seriesloom.llm.decontam import decontaminate


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes = {len(w) for w in wins}
    df = Counter(x for _, t in docs for x in words(t))
    rarest = {key: sorted(set(key), key=lambda x: (df[x], x))[:3] for key in wins}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[key]
        near = set()
        for key, (first, *rest) in rarest.items():
            if any(all(r in w[max(0, p - 9) : p + 10] for r in rest) for p in range(len(w)) if w[p] == first):
                near |= {i for i in wins[key] if i is not None}
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=str)


def got(docs, bench):
    return sorted((tuple(r) for r in decontaminate(docs, bench).collect()), key=str)


def test_whole_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(docs, bench) == want
    assert sum(r[5] for r in want) > 5


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "b C"), (3, None), (4, "..."), (5, "z z z z z z z z z z z"), (6, "É é x"), (7, "b c"), (None, "q w e r t y u i o p")]
DOCS = [(1, "a b c d e f g h i j k l m"), (2, None), (3, ""), (4, "z " * 40), (5, "é É X é é x"), (5, "É é x, B-c b.c"), (6, "q w e r t y u i o p"), (None, "b c"), (8, "a b c d e f g h i x j"), (9, "--- !!")]


LONG = [(20, "lorem ipsum " * 60_000 + "a b c d e f g h i j k l " + "dolor " * 10)]


@pytest.mark.parametrize("limit", [decontam.BROADCAST_ROWS, 0])
def test_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame([(d, t, "n", 1) for d, t in DOCS + LONG], "doc_id long, text string, term string, pos int")
    bench = spark.createDataFrame([(d, t, 2) for d, t in ITEMS], "item_id long, text string, rid int")
    assert got(docs, bench) == brute(DOCS + LONG, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(docs, bench.limit(0)) == brute(DOCS, [])
    assert got(docs.limit(0), bench) == []


def test_proximity(spark):
    docs = [(1, "r1 x r2 x x r3"), (2, "r1 r2 " + "x " * 60 + "r3"), (3, "r3 r2 r1"), (4, "r1 r2 " + "x " * 7 + "r3"), (5, "r1 r2 " + "x " * 9 + "r3")]
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "r1 r2 r3")], "item_id long, text string"))
    rows = {r.doc_id: r for r in found.collect()}
    assert [d for d in rows if rows[d].n_near] and {d for d in rows if rows[d].n_near} == {d for d, *_, n in brute(docs, [(1, "r1 r2 r3")]) if n}
    assert rows[1].n_near == 1 and rows[2].n_near == 0 and rows[3].n_near == 1 and not any(r.contaminated for r in rows.values())
