"""Licence scan against SQL and spelling variants."""

import re
import sys
import textwrap
from pathlib import Path

from leakfree.llm import licences as L

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check import compare, connect  # noqa: E402

MIT = L.KNOWN[0][1]
ROWS = [
    (1, MIT), (2, MIT.upper().replace(",", " ;").replace("<year> <holders>", "2020 Somebody, Ltd.\nAll rights reserved.")),
    (3, MIT + " more"), (4, None), (5, ""), (6, "--- ..."), (7, "x\nReleased under the MIT Licence!\n  released UNDER the mit license\ny"),
    (7, "Licensed under CC BY-NC 4.0."), (None, "Licensed   under the Apache Licence (Version 2.0)"), (8, "copyright (c) me\n© you\n(C) they"),
    (9, "The copyright holders practise per cent per cent licence licence"), (9, "The copyright holders practise per cent per cent licence licence"),
]


def test_cases_equal_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as key", "2 as digest", "3 as license", "4 as size")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", ROWS)
    got = L.op3_licences(df)
    problem, *_ = compare(got, con, L.ORACLE)
    assert problem is None
    texts = [(r.doc_id, r.license) for r in got.where("unit = 'text' and license is not null").collect()]
    assert sorted(texts, key=str) == sorted([(1, "MIT"), (2, "MIT"), (7, "CC-BY-NC-4.0"), (None, "Apache-2.0")], key=str)
    lines = {(r.doc_id, r.license, r.n) for r in got.where("unit = 'line'").collect()}
    assert (7, "MIT", 2) in lines and (7, "CC-BY-NC-4.0", 1) in lines and len(lines) == 3
    assert {r.digest for r in got.where("doc_id in (4, 5, 6, 8) and unit = 'text'").collect()} == {None}
    form = df.select(L.canonical(L.F.col("text")).alias("f")).where("f like 'the copyright%'").first().f
    assert form == "the copyright owners practice percent percent license license"
    assert L.op3_licences(df.limit(0)).count() == 0


def test_documents_equal_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op3_licences(spark.read.parquet(f"{sf}/documents.parquet"))
    problem, n, *_ = compare(got, connect(sf), L.ORACLE)
    assert problem is None and n > 1000


def test_wrapping_does_not_change_a_digest(spark):
    texts = [(n, t) for n, t in L.KNOWN if len(t) > 200]
    notice = "Copyright (c) 2020 Somebody, Ltd.\n\n"
    rows = []
    for i, (_, t) in enumerate(texts):
        for width in (30, 40, 50, 60, 65, 68, 70, 72, 75, 78, 79, 80, 100, 120):
            rows.append((i, notice + "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))))
    got = L.op3_licences(spark.createDataFrame(rows, "doc_id long, text string")).where("unit = 'text'").collect()
    assert len(got) == len(rows) and [(r.doc_id, r.license) for r in got if r.license != texts[r.doc_id][0]] == []


def test_notices_go_and_prose_stays(spark):
    notices = ["Copyright 2020 X", "copyright Somebody", "(c) 2020 X", "© X", " * Copyright: Authors", "// COPYRIGHT (C) X", "All rights reserved."]
    prose = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "copyright notice, this list", "copyright", "copyrighted work"]
    df = spark.createDataFrame([(x,) for x in notices + prose], "t string")
    got = {r.t: r.c for r in df.select("t", L.canonical(L.F.col("t")).alias("c")).collect()}
    assert {t for t, c in got.items() if c} == set(prose)


def test_every_published_text_is_known_at_any_width(spark):
    rows = []
    for name, text in L.known_texts():
        if len(text) > 200:
            paragraphs = re.split(r"\n\s*\n", text)
            for width in (30, 66, 72, 79, 100):  # a notice keeps its lines
                rows.append((len(rows), "\n\n".join(p if re.search(r"(?i)copyright (\(c\)|\[)", p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in paragraphs), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = {r.doc_id: r.license for r in L.op3_licences(df).where("unit = 'text'").collect()}
    missed = {(n, k) for k, _, n in rows if got[k] != n}
    assert {n for _, _, n in rows} >= {*L.TEXTS, "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later"} and missed == set()


def test_wrapped_texts_and_notices_equal_sql(spark):
    """The SQL text has all known texts, and drops and joins the same lines."""
    import duckdb

    rows = [(i, "Copyright (c) 2020 Somebody, Ltd.\n\n" + "\n\n".join(textwrap.fill(" ".join(p.split()), 64) for p in t.split("\n\n")))
            for i, (_, t) in enumerate(L.known_texts()) if i % 9 == 0]
    lines = ["Copyright 2020 X", "copyright notice and this", "COPYRIGHT HOLDERS BE LIABLE", "copyright holders (c)", "(c) the licence", "(c) 2020 bar", "©",
             "copyright", "copyright: or", "copyright(c)x", "copyrighted 2020", "all rights reserved.", "* (c)", "per\ncent of non-\ncommercial", "copyright - laws", "copyright lawson"]
    rows += [(1000 + i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = L.op3_licences(df)
    problem, *_ = compare(got, con, L.ORACLE)
    assert problem is None
    assert len({r.license for r in got.where("unit = 'text' and license is not null").collect()}) >= 5
