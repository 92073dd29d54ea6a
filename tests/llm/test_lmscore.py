import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from seriesloom.llm import lmscore
from seriesloom.llm.lmscore import Lattice

FILE = public_tokenizers.path("piece_bpe_32k.model")


def toy():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    p = np.array([1e-3] * 256 + [0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.02])
    return pieces, Lattice(pieces, {b: b for b in range(256)}, np.log(p)), p


def ways(word, pieces, p):
    """All segmentations as lists of piece numbers, by plain recursion."""
    index = {x: i for i, x in enumerate(pieces) if i >= 256}

    def go(rest):
        if not rest:
            yield []
            return
        for n in range(1, len(rest) + 1):
            if rest[:n] in index:
                for tail in go(rest[n:]):
                    yield [index[rest[:n]], *tail]
        if rest[0] not in index:
            for tail in go(rest[1:]):
                yield [*rest[0].encode(), *tail]

    return list(go("▁" + word))


@pytest.mark.parametrize("word", ["a", "ab", "abab", "bababb", "é", "aéb", "漢b"])
def test_marginal_and_expectation_equal_enumeration(word):
    pieces, lattice, p = toy()
    found = ways(word, pieces, p)
    weight = [math.prod(p[i] for i in w) for w in found]
    assert math.isclose(lattice.log_marginals([word, "a"])[0], math.log(sum(weight)), rel_tol=1e-9)
    uses = np.zeros(len(p))
    for w, x in zip(found, weight, strict=True):
        for i in w:
            uses[i] += x / sum(weight)
    assert np.allclose(lattice.expected([word]), uses)


def rows():
    rng = random.Random(4)
    out = [(d, " ".join(rng.choice(["The", "of", "x" * rng.randint(1, 4), "né", f"q{rng.randint(0, 9)}"]) for _ in range(rng.randint(0, 30)))) for d in range(40)]
    return [*out, (7, "The"), (7, "The"), (None, "a\x1cb \t c"), (99, None), (98, ""), (97, "long " * 20000)]


@pytest.mark.parametrize("frequent", [lmscore.FREQUENT, 3])
def test_counts_and_sums(spark, frequent):
    data = rows()
    train = [r for r in data if r[0] is not None and r[0] % 3]
    c = Counter(w for _, t in train for w in lmscore.words_of(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    c_of = lambda w: c.get(w, 0)
    df = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, c int").repartition(3)
    model = lmscore.train(df.where("doc_id % 3 != 0"), FILE)
    assert (model.tokens, model.types, model.n_docs) == (n, v, len(train))
    lattice = model.lattice()
    share = model.discount * v / n
    end = (math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1))), model.end()[1])
    want = []
    for d, t in data:
        ws = lmscore.words_of(t)
        base = sum(math.log10((c_of(w) + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + end[0]
        logs = lattice.log_marginals([w.decode() for w in ws]) if ws else []
        mix = sum(math.log10(max(c_of(w) - model.discount, 0) / n + share * (1 - lmscore.END) * math.exp(x)) for w, x in zip(ws, logs, strict=True)) + end[1]
        want.append((d, len(ws) + 1, sum(c_of(w) > 0 for w in ws) + 1, round(base, 4), round(mix, 4)))
    got = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in lmscore.score(df, model, frequent=frequent).collect()]
    key = lambda r: (str(r[0]), r[1:])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-6, atol=1e-3)


def test_nothing_to_learn_from_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lmscore.train(none, FILE)
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lmscore.score(df, model).first()
    assert r.n_tokens == 3 and r.n_known == 0 and math.isfinite(r.score)
    assert lmscore.score(none, model).count() == 0


@pytest.mark.parametrize("word", ["ab" * 300, "abé" * 150, "b" * 401])
def test_long_words_alone_as_in_groups(word, monkeypatch):
    _, lattice, p = toy()
    alone, uses = lattice.log_marginals([word, "a"]), lattice.expected([word, "ab"])
    monkeypatch.setattr(lmscore, "LONG_WORD", 10**9)
    assert np.allclose(alone, lattice.log_marginals([word, "a"])) and np.allclose(uses, lattice.expected([word, "ab"]))


def test_a_very_long_word_takes_seconds():
    import time

    _, lattice, _ = toy()
    begun = time.perf_counter()
    assert np.isfinite(lattice.log_marginals(["ab" * 100_000])).all() and np.isfinite(lattice.expected(["ba" * 50_000])).all()
    assert time.perf_counter() - begun < 20


def test_probabilities_sum_to_no_more_than_one():
    """Over all words of two letters up to a length, the end included."""
    from itertools import product

    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "b", "ab", "▁ab"]
    p = np.array([0.0] * 256 + [0.1, 0.1, 0.05, 0.05, 0.05, 0.1])
    with np.errstate(divide="ignore"):
        lattice = Lattice(pieces, {b: b for b in range(256)}, np.log(p / p.sum()))
    words = ["".join(w) for n in range(0, 11) for w in product("ab", repeat=n)]
    counts = {"a": 5, "ab": 2, "bb": 1}
    model = lmscore.Model(None, 4, sum(counts.values()) + 4, len(counts) + 1, 0.5, lattice.logp, FILE)
    logs = model.spelled(lattice, words)
    assert 0.9 < np.exp(logs).sum() <= 1 - lmscore.END + 1e-9
    total = (10 ** model.mixed(np.array([float(counts.get(w, 0)) for w in words]), logs)).sum() + 10 ** model.end()[1]
    assert 0.95 < total <= 1 + 1e-9


def test_held_out_words_are_likelier_than_by_plain_counts_with_spelling(spark):
    """A token of held-out text against the plain counts' share of unseen words spread
    over the bytes of each: what a base that spelled them would give."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lmscore.train(df.where("doc_id % 10 != 0"), FILE)
    held = df.where("doc_id % 10 = 0")
    seen = {bytes(r.word): r.c for r in model.counts.collect()}
    spelled = tokens = 0.0
    for r in held.collect():
        for w in lmscore.words_of(r.text):
            spelled += 0.0 if w in seen else (len(w) + 1) * math.log10(1 / 257)
            tokens += 1
    sums = lmscore.score(held, model).agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert sums["sum(score)"] > sums["sum(base_score)"] + spelled
    assert sums["sum(score)"] / sums["sum(n_tokens)"] > -6


def test_commonest_words_are_one_comparison_for_any_number_of_levels(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), i) for i in range(1, 400)] + [(b"long" * 20, 900)], "word binary, c long")
    for frequent in (0, 1, 7, 150, 10_000):
        found = lmscore.commonest(counts, frequent)
        assert found._jdf.queryExecution().optimizedPlan().toString().upper().count("LOG2(") <= 2
        got = sorted(r.c for r in found.collect())
        assert len(got) <= frequent and 900 not in got
        below = max((c for c in range(1, 400) if c not in got), default=0)
        level = lambda c: math.floor(16 * math.log2(c))
        assert all(c in got for c in range(1, 400) if below and level(c) > level(below))


def test_gathered_batches_keep_all_rows():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([b"x" * (i % 50)] * i, pa.binary())], names=["word"]) for i in range(1, 60)]
    whole = [w for b in batches for w in b.column(0).to_pylist()]
    for rows, size in ((1, 1), (100, 10**9), (10**9, 500), (10**9, 10**9)):
        out = list(lmscore.gathered(iter(batches), rows, size))
        assert [w for b in out for w in b.column(0).to_pylist()] == whole
    assert len(out) == 1 and not list(lmscore.gathered(iter([])))
