"""Quality rules against SQL and small cases."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest

from leakfree.llm import quality as Q

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check import compare, connect  # noqa: E402


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x a b c d a b c", "a a a a a", "a b a b a b", "é👍 | <x>\n\n \né👍 | <x>\nq",
         "l\nl \nl\n l", "a\x0bb\x0cc\x1cd e", "the of and " * 70]


def test_base_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a")], "doc_id long, text string").selectExpr("*", "'en' as lang", "1 as key", "2 as chars", "3 as en")
    got = {r.doc_id: r for r in Q.op4_quality(df).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert Q.op4_quality(df.limit(0)).count() == 0


def test_equals_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    problem, n, *_ = compare(Q.op4_quality(docs), connect(sf), Q.ORACLE)
    assert problem is None and n > 0


def test_prose_stays_and_symbol_salad_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = Q.op4_quality(docs).join(labels, "doc_id").where("quality = 1 and not base_failed").collect()
    assert sum(r.kept for r in good) / len(good) > 0.98
    salad = " ".join("###" + w + "*** |" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa".split() for _ in "12345678")
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, " ".join(f"{w}{i}" for i, w in enumerate(salad.split())), None)], docs.select("doc_id", "text", "lang").schema))
    assert [(r.base_failed, r.kept) for r in Q.op4_quality(more).where("doc_id = -1").collect()] == [(False, False)]


def test_divergence(spark):
    row = spark.createDataFrame([([1, 1],), ([5, 0],), ([0, 0],)], "h array<long>").select(Q.divergence(Q.F.col("h"), [2, 2]).alias("a"), Q.divergence(Q.F.col("h"), [0, 3]).alias("b")).collect()
    assert row[0].a == 0 and row[1].b == pytest.approx(1.0) and row[2].a is None


def test_languages_without_common_words_are_judged_by_characters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    greek = "λόγος ανθρώπων θάλασσα ουρανός δρόμος βιβλίο παιδί σχολείο πόλη ημέρα νύχτα φως".split()
    rnd = __import__("random").Random(1)
    more = [(-1 - i, " ".join(rnd.choice(greek) + rnd.choice(greek) for _ in range(150)), lang) for i, lang in enumerate(("xx", "el"))]
    more.append((-3, " ".join(rnd.choice(greek) + rnd.choice(greek) for _ in range(150)), "qq"))
    got = {r.doc_id: r for r in Q.op4_quality(docs.union(spark.createDataFrame(more, docs.schema))).where("doc_id < 0").collect()}
    assert all(r.kept for r in got.values()) and len(got) == 3


def test_other_and_rare_labels_equal_sql(spark):
    """Common, rare and unknown labels, nulls, repeated and long rows: the same verdicts as the SQL text."""
    import random

    import duckdb

    rnd = random.Random(6)
    rows, codes = [], ["en", "de", "fi", "ru", "xx", None]
    for i in range(2400):
        code = rnd.choice(codes) if i % 40 else f"rare{i % 7}"
        words = list(Q.COMMON_WORDS.get(code, Q.COMMON_WORDS["pl"])) + ["слово", "Wort", "word", "x1", "#|", "12"]
        rows.append((i, " ".join(rnd.choices(words, k=rnd.choice([3, 60, 130]))).replace(" x1", "\n"), code))
    rows += [(None, "the of and " * 200, "en"), (5, None, "en"), (6, "", "rare9"), (7, " \n", None), (8, "Ω" * 500 + " " + "ω " * 200, "zz"), (9, "word " * 300_000, "en")]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as en", "2 as refs", "3 as own", "4 as shares")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    got = Q.op4_quality(df)
    problem, n, *_ = compare(got, con, Q.ORACLE)
    assert problem is None and n == len(rows)
    assert 0.02 < got.where("kept").count() / n < 0.98
