import random
from collections import Counter

import numpy as np

from seriesloom.llm import simhash
from seriesloom.llm.simhash import similar_documents


def sets(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar_pairs(texts):
    """All pairs of different shingle sets with a Jaccard of 0.8 or more."""
    found = {d: sets(t) for d, t in texts.items()}
    holders, out = {}, set()
    for d in sorted(texts):
        shared = Counter(e for s in found[d] for e in holders.get(s, ()))
        out |= {(e, d) for e, o in shared.items() if 5 * o >= 4 * (len(found[d]) + len(found[e]) - o)}
        for s in found[d]:
            holders.setdefault(s, []).append(d)
    return out


def brute(texts):
    """The smallest id of each document's group, from the Jaccard of all pairs."""
    found = {d: sets(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bare = [d for d in texts if not found[d]]
    for a, b in [*((bare[0], d) for d in bare), *similar_pairs(texts)]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d: find(d) for d in texts}


def got(df, **kw):
    return {r.doc_id: r.component_id for r in similar_documents(df, **kw).collect()}


def held(texts, mine, least):
    """No group joins what brute force keeps apart; of all similar pairs the share
    ``least`` is in one group."""
    want = brute(texts)
    assert all(want[d] == want[c] for d, c in mine.items())
    pairs = [p for p in similar_pairs(texts) if sets(texts[p[0]]) != sets(texts[p[1]])]
    caught = sum(mine[a] == mine[b] for a, b in pairs)
    assert pairs and caught >= least * len(pairs), (caught, len(pairs))
    return caught / len(pairs)


def test_small_table_against_jaccard_of_all_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    held(texts, got(df), 0.95)


def test_odd_texts(spark):
    texts = {5: None, 3: "", 9: " \t\n ", 1: "A b", 2: "a B", 7: "é É x\x1cy z w", 8: "w " * 20000, 4: "w " * 20000, 6: "one two three four five"}
    df = spark.createDataFrame([(k, v, "c", 7) for k, v in texts.items()], "doc_id long, text string, code string, n int")
    assert got(df) == brute(texts)


def test_copies_of_a_similarity_near_the_threshold(spark):
    rng = random.Random(5)
    texts, word = {}, lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(80)]
    for k in range(20):
        first = [word() for _ in range(rng.randint(30, 200))] + (shared if k % 2 else [])
        for _ in range(8):
            now = list(first)
            for _ in range(rng.randint(0, max(1, len(first) // 25))):
                now[rng.randrange(len(now))] = word()
            texts[len(texts)] = " ".join(now)
    assert 20 < len(set(brute(texts).values())) < 160
    held(texts, got(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), 0.95)


def test_recall_at_the_threshold_itself(spark):
    """Pairs, each alone, whose Jaccard is 0.80 to 0.82."""
    rng = random.Random(9)
    texts = {}
    for k in range(150):
        first = [f"w{rng.randrange(10**7)}" for _ in range(304)]
        now = list(first)
        for at in range(10, 300, 50):  # six words apart: thirty shingles of three hundred go
            now[at] = f"x{rng.randrange(10**7)}"
        texts[2 * k], texts[2 * k + 1] = " ".join(first), " ".join(now[:-1])
    pairs = similar_pairs(texts)
    assert len(pairs) == 150
    held(texts, got(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), 0.9)


def test_wide_fingerprints_bit_by_bit():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 199, 200, 1000):
        hashes = rng.integers(0, 1 << 63, n).astype(np.uint64)
        lanes = hashes[:, None] * simhash._LANES
        lanes ^= lanes >> np.uint64(32)
        lanes *= np.uint64(0xD6E8FEB86659FD93)
        lanes ^= lanes >> np.uint64(29)
        want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in lanes[:, k]) > n) for k in range(8)]
        assert simhash.wide_fingerprint(hashes).view(np.uint64).tolist() == want


def test_the_tally_counts_equal_bytes(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (40, simhash.WIDE), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    rows = [(x.view(np.int64).tolist(), y.view(np.int64).tolist(), int((x == y).sum())) for x, y in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, want int")
    names = ", ".join(f"'p{i}', {{0}}[{i}]" for i in range(simhash.WIDE // 8))
    df = df.selectExpr(f"named_struct({names.format('x')}) AS x", f"named_struct({names.format('y')}) AS y", "want")
    assert df.where(f"{simhash._shared('x', 'y')} != want").count() == 0


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
