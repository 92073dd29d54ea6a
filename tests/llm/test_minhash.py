import hashlib
import random

import xxhash

from seriesloom.llm import minhash
from seriesloom.llm.minhash import BINS, TRIES, add_bins, fingerprints, with_edited_and_next


def x64(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), h)
    return h - 2**64 if h >= 2**63 else h


def bins(text):
    words = [w for w in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return None
    w = [xxhash.xxh64_intdigest(a.encode(), 42) for a in words]
    hs = [x64(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [x64([w[k] if k < len(w) else k - 5 for k in range(4)])]
    shift = minhash._SHIFT
    low = {}
    for h in hs:
        b = (h & (2**64 - 1)) >> shift
        low[b] = min(low.get(b, 2**64), h & minhash._EMPTY)
    order = [*range(BINS // 2, BINS), *range(BINS // 2)]
    tries, out = minhash._tries(), []
    for i, b in enumerate(order):
        if low.get(b, minhash._EMPTY) != minhash._EMPTY:
            out.append(low[b])
            continue
        full = [j for j, c in enumerate(order) if low.get(c, minhash._EMPTY) != minhash._EMPTY]
        j = next((t for t in tries[i * TRIES : i * TRIES + TRIES] if t in full), None)
        if j is None:
            j = min((x64x(i, j) & -BINS) | j for j in full) & (BINS - 1)
        out.append(low[order[j]])
    return out


def x64x(*ints):
    h = 42
    for v in ints:
        h = xxhash_int(v, h)
    return h - 2**64 if h >= 2**63 else h


def xxhash_int(v, seed):
    return xxhash.xxh64_intdigest(v.to_bytes(4, "little"), seed)


def digits(text):
    b = bins(text)
    return "" if b is None else "".join("0123456789abcdef"[v & 15] for v in b)


def like(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / BINS
    return max(0.0, (same - 1 / 16) / (15 / 16))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        e = t[: len(t) - k] + n[:k]
        a, b, c = digits(t), digits(e), digits(n)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in with_edited_and_next(df).collect()), key=str)


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows(spark):
    rows = [(7, None), (3, ""), (9, "a"), (9, "a"), (9, "a b c"), (-5, "é ü 漢 字 x y z"), (100, "w " * 30000), (None, "n o p q r s"), (None, None), (8, " \t\x0b "), (2, "a b c d e")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, stretch int, bins string")
    assert got(df) == brute(rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert got(one) == brute([(1, "a b c d e f g h")])
    assert got(one.limit(0)) == []


def test_likeness_is_near_jaccard(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(3000)]
    rows, truth = [], {}
    for k in range(0, 20):
        other = base[: 3000 - 120 * k] + [f"v{k}_{i}" for i in range(120 * k)]
        rows.append((k, " ".join(base), " ".join(other)))
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, other))
        truth[k] = len(a & b) / len(a | b)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, a string, b string")
    df = add_bins(add_bins(df, "a", "x"), "b", "y").select("k", minhash.likeness("x", "y").alias("j"))
    for r in df.collect():
        assert abs(r.j - truth[r.k]) < 0.13


def test_fingerprint_column(spark):
    df = spark.createDataFrame([("a b c d e f", 1), (None, 2)], "text string, fingerprint int")
    assert {len(r.fingerprint) for r in fingerprints(df).collect()} == {0, BINS}
