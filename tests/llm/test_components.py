import pytest

from seriesloom.llm.common import components


def test_a_chain_settles_or_is_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(201)}
    with pytest.raises(RuntimeError):
        components(chain, rounds=2)


def test_keys_tell_rows_apart_and_follow_ids_and_texts(spark):
    from seriesloom.llm.common import keyed

    rows = [(1, "b"), (1, None), (1, "a"), (1, "a"), (None, "z"), (None, None), (0, "c")] + [(5, f"t{i % 40:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted(keyed(df).collect(), key=lambda r: (r["__key"].doc_id is not None, r["__key"]["doc_id"] or 0, r["__key"]["no"]))
    assert len({r["__key"] for r in found}) == len(rows)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert [(r.doc_id, r.text) for r in found] == sorted(rows, key=order)
    plain = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert {(r.doc_id, r["__key"]) for r in keyed(plain).collect()} == {(1, 1), (2, 2)}
