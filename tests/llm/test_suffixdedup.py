import hashlib
import random

import numpy as np
import pytest

from seriesloom.llm.suffixdedup import maximal_repeats, remove_repeats


def brute(rows, w=200):
    seen = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, b in texts:
        for i in range(len(b) - w + 1):
            seen[b[i : i + w]] = seen.get(b[i : i + w], 0) + 1
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r)[:5] for r in remove_repeats(df, **kw).collect()), key=str)


def variants():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(300)) for _ in range(3)]
    rows = []
    for d in range(40):
        t = rng.choice(base)
        a, b = sorted(rng.sample(range(len(t)), 2))
        t = t[a:b]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t = t[:at] + word() + t[at + rng.randint(0, 3) :]
        if rng.random() < 0.3:
            t += t[: rng.randint(0, len(t))] + word() * 60
        rows.append((d, t))
    return rows


ODD = [(1, None), (2, ""), (3, "a" * 199), (4, "a" * 200), (5, "ab" * 30000), (5, "x"), (5, "x"), (None, "Ha " * 100), (6, "é" * 150), (7, "q" + "é" * 100)]


@pytest.mark.parametrize("kw", [{}, {"large": 0}, {"large": 2, "batch_bytes": 500}])
def test_variants_against_brute_force(spark, kw):
    rows = variants()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **kw) == brute(rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in ODD], "doc_id long, text string, rid int, m int")
    assert got(df) == brute(ODD)
    assert got(df.limit(0)) == []


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_maximal_repeats_are_the_brute_forced_ones():
    rng = random.Random(7)
    for _ in range(40):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))
        want = {}
        for n in range(3, len(data) + 1):
            places = {}
            for i in range(len(data) - n + 1):
                places.setdefault(data[i : i + n], []).append(i)
            for s, p in places.items():
                if len(p) > 1:
                    lefts = {data[i - 1] if i else -1 for i in p}
                    rights = {data[i + n] if i + n < len(data) else -i for i in p}
                    if len(lefts) > 1 and len(rights) > 1:
                        want[s] = p
        have = {data[p[0] : p[0] + n]: sorted(p.tolist()) for n, p in maximal_repeats(np.frombuffer(data, np.uint8), 3) if n < 7}
        assert {k: v for k, v in have.items() if len(k) >= 3} == {k: v for k, v in want.items() if len(k) < 7}


def test_a_periodic_text_makes_few_runs():
    from seriesloom.llm.suffixdedup import _runs

    for unit in (b"a", b"ab", b"abc ", b"0123456789 and so on, "):
        text = (unit * 200_000)[:200_000]
        who, start, count, times, m, h = _runs([text, b"x" * 150, text[:500]], 200)
        assert len(start) < 20
        assert (count * times)[who == 0].sum() == len(text) - 199
        own = who == 0
        assert (start[own][1:] == (start + count * times)[own][:-1]).all()


def test_long_texts_are_cut_without_losing_a_window(monkeypatch):
    from seriesloom.llm import suffixdedup

    monkeypatch.setattr(suffixdedup, "STRETCH", 64)
    for n in (0, 1, 199, 200, 201, 263, 264, 265, 1000):
        text = bytes(i % 251 for i in range(n))
        cut = list(suffixdedup._stretches([b"ab", text], 200))
        assert cut[0] == (0, 0, b"ab")
        starts = [at + i for who, at, part in cut if who == 1 for i in range(len(part) - 199)]
        assert starts == list(range(max(0, n - 199)))
        assert all(text[at : at + len(part)] == part for who, at, part in cut if who == 1)


def test_a_long_periodic_text_beside_others(spark):
    rows = [(1, "Ha " * 400_000), (2, "no " * 100), (3, "Ha " * 70), (4, "z" * 300)]
    got_rows = {r[0]: r for r in got(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got_rows[1][1:4] == (1_200_000, 1_200_000, 1) and got_rows[3][2] == 210 and got_rows[2][2] == 300 and got_rows[4][2] == 300
