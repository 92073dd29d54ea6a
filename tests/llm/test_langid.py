import random
import zlib

import numpy as np
import pytest

from seriesloom.llm import langid


def test_grams_are_those_of_each_text_alone():
    texts = ["", "a", "Ab", "héllo", "漢字 x" * 3]
    for n, (found, have) in zip(langid.ORDERS, langid.grams(texts), strict=True):
        assert have.tolist() == [max(0, len(t) - n + 1) for t in texts]
        alone = [g.tolist() for t in texts for k, (g, _) in zip(langid.ORDERS, langid.grams([t]), strict=True) if k == n]
        assert found.tolist() == [x for g in alone for x in g]


def rows(n=60):
    rng = random.Random(3)
    parts = {"xx": ["ka", "lo", "mi", "ne"], "yy": ["sch", "ung", "eit", "üb"], "zz": ["ção", "nh", "lh", "ões"]}
    return [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(20)), k) for i, k in enumerate(k for k in parts for _ in range(n))]


def test_learns_and_answers_every_row(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 4 != 0"))
    assert model.languages == ["xx", "yy", "zz"]
    assert (model.weights == 0).mean() > 0.9  # sparse
    held = langid.identify(docs.where("doc_id % 4 = 0"), model).collect()
    assert all(r.lang_pred == r.lang for r in held)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 !", 5), (3, "12 !", 5), (None, "kalo " * 40000, 5)], "doc_id long, text string, score int")
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in langid.identify(odd, model).collect())
    assert got == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("3", "und", False), ("None", "xx", True)]
    assert langid.identify(odd.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert langid.identify(docs, model).first().lang_pred == "und"


def test_document_frequencies_are_counted(spark):
    docs = spark.createDataFrame([("ab",), ("ab",), ("b",), (None,)], "text string")
    df, n = langid.document_frequencies(docs)
    want = np.zeros(langid.FEATURES, int)
    for t in ("ab", "ab", "b"):
        want[langid.counted(t)[0]] += 1
    assert n == 4 and (df == want).all()


def test_temperature_fits_overconfidence():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 400)
    sure = np.where(rng.random(400) < 0.75, labels, 1 - labels)
    logits = np.eye(2)[sure] * 6
    assert langid._temperature(logits, labels) == pytest.approx(5.0, rel=0.2)


def test_held_out_accuracy(spark):
    from seriesloom.llm.queries import op7_langid

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in op7_langid(spark, sf).collect() if r.held_out]
    assert len(held) == sum(zlib.crc32(str(d).encode()) % 4 == 2 for d in lang)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_learning_equals_a_plain_loop(spark):
    """TF-IDF, follow-the-regularised-leader with both penalties and the folded weights,
    coordinate by coordinate."""
    import math
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    data = rows(8)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.train(docs)
    df = Counter(f for _, t, _ in data for f in langid.counted(t)[0].tolist())
    idf = lambda f: math.log((1 + len(data)) / (1 + df[f])) + 1
    held = F.pmod(F.xxhash64(F.lit("held"), "draw", "f"), F.lit(5)) == 0
    picked = langid.sample(docs, {k: 1.0 for k in ("xx", "yy", "zz")}, "doc_id", "text", "lang").withColumn("held", held).collect()
    assert len(picked) == len(data)
    picked = sorted(picked, key=lambda r: (r.draw, r.label, bytes(r.f)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 0.01
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(4):
        for r in picked:
            if r.held:
                continue
            f, c = np.frombuffer(r.f, "<u2").tolist(), np.frombuffer(r.c, "<f4").tolist()
            x = [(a, 30.0 * b / sum(c) * idf(a)) for a, b in zip(f, c, strict=True)] + [(langid.FEATURES, 1.0)]
            u = [sum(v * weight((a, k)) for a, v in x) for k in range(3)]
            e = [math.exp(v - max(u)) for v in u]
            for k, label in enumerate(("xx", "yy", "zz")):
                for a, v in x:
                    g, w = v * (e[k] / sum(e) - (label == r.label)), weight((a, k))
                    z[a, k] += g - (math.sqrt(n[a, k] + g * g) - math.sqrt(n[a, k])) / alpha * w
                    n[a, k] += g * g
    for k in range(3):
        assert model.bias[k] == pytest.approx(weight((langid.FEATURES, k)), abs=1e-9)
        for a in df:
            assert model.weights[a, k] == pytest.approx(weight((a, k)) * idf(a) * 30.0, abs=1e-7)


def test_one_long_text_in_stretches(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdé ") for _ in range(5000))
    weights = np.random.default_rng(0).normal(size=(langid.FEATURES, 2))
    model = langid.Model(["a", "b"], weights, np.zeros(2), 1.0)
    want, counts = model.predict([text, "ab"]), langid.counted(text)
    for long in (1, 2, 3, 7, 1000, 4999):
        monkeypatch.setattr(langid, "LONG", long)
        monkeypatch.setattr(langid.stretches, "__defaults__", (long,))
        got = model.predict([text, "ab"])
        assert got[0] == want[0] and np.allclose(got[1], want[1])
        assert all((a == b).all() for a, b in zip(langid.counted(text), counts, strict=True))
