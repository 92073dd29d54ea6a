from collections import defaultdict

import pytest

import corpus_pipeline as cp
from tests.llm import test_decontam, test_linededup, test_packing, test_similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_id(spark, docs):
    odd = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123 !!", "en", "s", 0)], docs.schema)
    kept = cp.language_id(spark, docs.unionByName(odd), SF)
    assert kept.columns == docs.columns
    got = rows(kept)
    assert -1 not in got and -2 not in got
    assert len(got) >= 0.97 * docs.count()
    assert all(got[d].text == r.text for d, r in rows(docs).items() if d in got)


def test_line_dedup(spark, docs):
    got = cp.line_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    want = {d: t for d, t, n, gone in test_linededup.brute([(r.doc_id, r.text) for r in docs.collect()]) if gone < n or not gone}
    assert {d: r.text for d, r in rows(got).items()} == want
    assert all(r.n_chars == len(r.text) for r in rows(got).values())


def test_near_dedup(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = cp.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    groups = defaultdict(set)
    for d, c in test_similar.brute(texts).items():
        groups[c].add(d)
    kept = set(rows(got))
    assert all(c in kept for c in groups)
    spare = sum(len(g) - 1 for g in groups.values())
    assert len(kept) - len(groups) <= 0.05 * spare


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_removed int, code long, n int, __lang string, contaminated boolean, start long, __key long, __gone int, __no int"


@pytest.mark.parametrize("k", range(4))
def test_odd_rows_and_clashing_names(spark, docs, k):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and
    columns named like the operators' own."""
    more = (7, 7, 7, 7, "l", True, 7, 7, 7, 7)
    long = "the quick brown fox jumps over the lazy dog and then runs away from it again " * 20_000
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\n\t", "en", "s", 4), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (None, "one two three", None, "s", 13)]
    plain = [(r.doc_id + 100, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    df = spark.createDataFrame([(*r, *more) for r in odd + plain], CLASHING)
    got = cp.STAGES[k][1](spark, df, SF)
    assert got.columns == df.columns
    found = got.collect()
    assert all(tuple(r[5:]) == more for r in found)
    ids = [r.doc_id for r in found]
    if k == 0:
        assert not {1, 2, 3} & set(ids) and ids.count(4) == 2
    if k == 1:
        assert {1, 2, 3, None} <= set(ids) and ids.count(4) == 1
    if k == 2:
        assert ids.count(4) == 1 and len({1, 2, 3} & set(ids)) == 1
    if k == 3:
        assert {1, 2, 3, None} <= set(ids) and ids.count(4) == 2


def test_decontaminate(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = test_decontam.brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench])
    got = cp.decontaminate(spark, docs, SF)
    assert got.columns == docs.columns
    assert set(rows(got)) == {r[0] for r in want if not r[5]}


def test_whole_run_is_its_stages_in_turn(spark, docs):
    now = docs
    for _, stage in cp.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
    pieces = cp.run(spark, SF).collect()
    test_packing.check(pieces, {r.doc_id: r.text for r in now.collect()})


def test_repeated_and_missing_ids(spark, docs):
    odd = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9), (2, "x y", "en", "s", 3)], docs.schema)
    assert len(cp.near_dedup(spark, odd, SF).collect()) == 2
    assert len(cp.decontaminate(spark, odd, SF).collect()) == 4
    assert cp.line_dedup(spark, odd, SF).count() == 3


@pytest.mark.parametrize("k", range(5))
def test_no_documents(spark, docs, k):
    assert cp.STAGES[k][1](spark, docs.limit(0), SF).count() == 0
