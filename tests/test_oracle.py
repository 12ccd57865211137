"""Registered queries against their SQL texts on the smallest tables.

A sample runs by default; ``LEAKFREE_ALL=1`` runs every query.
"""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

ORACLES = entry.oracle_sql()
SAMPLE = ("v1_", "v3_", "p1_", "p12_", "p23_", "p29_", "j1_", "j10_", "j11_", "j12_", "a9_", "a14_", "a17_", "a18_", "a20_", "a26_",
          "a29_", "a30_", "w3_", "w6_", "w9_", "w15_", "w19_", "w21_", "m1_", "m6_", "m8_", "m11_", "m15_", "s1_", "s6_", "s7_", "s18_", "st", "t2_", "u2_")
NAMES = sorted(ORACLES) if os.environ.get("LEAKFREE_ALL") else sorted(n for n in ORACLES if n.startswith(SAMPLE))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    problem, *_ = compare(entry.queries()[name](spark, sf), con, ORACLES[name])
    assert problem is None, problem


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "fp_r3" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
