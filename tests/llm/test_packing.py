import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesloom.llm.packing import WINDOW, encoder, pack, padded_length

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", None, "don't we'll", "a\x1cb c", "Ünï çé́ İx ΑΣ ΑΣ.", "x" * 9000, "<|endoftext|> a", "한국 ᄒ", "word, word; end", " a b", "1234 ab12 --!"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_equal_the_tokenizers_own(texts):
    flat, counts = encoder(PATH)(texts)
    want = [Tokenizer_().encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


def Tokenizer_(kept=[]):
    if not kept:
        kept.append(Tokenizer.from_file(PATH))
    return kept[0]


def check(rows, texts):
    by_doc, seqs = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array(Tokenizer_().encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s, pieces in seqs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == WINDOW or s == max(seqs)


def test_round_trip(spark):
    texts = dict(enumerate(ODD + ["the same text"] * 3))
    df = spark.createDataFrame([(k, v, "z", 1) for k, v in texts.items()], "doc_id long, text string, start string, length int")
    check(pack(df.repartition(3), PATH).collect(), texts)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(pack(df, PATH).collect(), {r.doc_id: r.text for r in df.collect()})


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("n,want", [(1, 1), (5, 8), (4096, 4096), (4000, 4096)])
def test_padding(n, want):
    assert padded_length(n) == want
