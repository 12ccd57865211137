"""Language identification: held-out accuracy and edge cases."""

import math

import numpy as np
import pytest

from leakfree.llm.language import features, op2_language, train


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.select("doc_id", "lang").join(op2_language(docs), "doc_id").collect()


def test_held_out_accuracy(predicted):
    import zlib

    assert len(predicted) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in predicted)
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in predicted if r.held_out and r.lang == lang]
        assert len(own) > 15 and sum(r.lang_pred == lang for r in own) / len(own) > 0.93


def test_features():
    assert features(None) is None and features("12 !?") is None
    x = features("Ab " * 400_000)
    assert x @ x == pytest.approx(1.0) and np.count_nonzero(x) <= 9
    assert features("A-b") @ features("a  b") == pytest.approx(1.0) and not math.isnan(x.sum())


def test_nulls_rare_labels_and_empty_tables(spark):
    rows = [(None, "the cat", "en"), (1, None, "en"), (2, "...", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as x", "3 as y")
    assert {(r.doc_id, r.lang_pred, r.score) for r in op2_language(df).collect()} == {(None, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)}
    assert op2_language(df.limit(0)).collect() == []
    rows = [(i, "zzz yyy" if i % 2 else "aba bab", "qq" if i % 2 else None) for i in range(20)]
    one = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert one.predict("aba") == ("qq", 1.0) and one.predict("") == ("und", 0.0)
