import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.functions import expr as E
from leakfree.functions import names as N
from leakfree.functions import odds as O
from leakfree.functions import scoring as S

from conftest import rows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_rounding_follows_numpy(spark):
    values = [0.285, 1.005, 0.125, 2.675, -0.125, 1e6 + 0.005, 3.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(E.round_even("v", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in values]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (5.0,)], "v double")
    assert [r[0] for r in df.select(E.clip("v", 0.0, 2.0)).collect()] == [None, 0.0, 2.0]


def test_bins_are_right_open_and_steps_closed(spark):
    df = spark.createDataFrame([(None,), (23.0,), (24.0,), (30.0,)], "v double")
    assert [r[0] for r in df.select(E.bin_index("v", (24, 26, 28, 30))).collect()] == [-1, 0, 1, 4]


@pytest.mark.parametrize("day, season, upcoming", [((2025, 8, 31), 2024, 2025), ((2025, 9, 1), 2025, 2025)])
def test_season_labels(spark, day, season, upcoming):
    d = F.lit(dt.date(*day))
    assert one(spark, E.season_label(d)) == season
    assert one(spark, E.upcoming_season_label(d)) == upcoming


def test_hash_jitter_matches_md5(spark):
    h = int(hashlib.md5(b"Ann|3").hexdigest()[:8], 16)
    got = one(spark, E.hash_jitter("n", "t", 24.0), n="Ann", t=3)
    assert got == pytest.approx((h / 0xFFFFFFFF - 0.5) * 48)


def test_scoring_values(spark):
    df = spark.createDataFrame(
        [("WR", 5.0, 50.0, None), ("TE", 5.0, 120.0, 310.0)], "position string, receptions double, receiving_yards double, passing_yards double")
    assert [r[0] for r in df.select(S.skill_points(df)).collect()] == [10.0, 29.4]
    assert [r[0] for r in df.select(S.skill_points(df, S.HALF)).collect()] == [7.5, 26.9]
    assert [r[0] for r in df.select(S.skill_points(df, S.STANDARD)).collect()] == [5.0, 24.4]
    custom = S.resolve_rules(custom={"te_reception_bonus": 1, "bonus_rec_100": 3, "bonus_pass_300": 2, "unknown": 1})
    assert [r[0] for r in df.select(S.skill_points(df, custom)).collect()] == [10.0, 39.4]
    assert S.rules_label(custom) == "custom" and S.rules_label(S.HALF) == "half"


def test_rules_in_columns_equal_rules_in_plan(spark):
    df = spark.createDataFrame([("TE", 5.0, 120.0)], "position string, receptions double, receiving_yards double")
    custom = S.resolve_rules(custom={"te_reception_bonus": 1, "bonus_rec_100": 3})
    wide = df.withColumns({r: F.lit(w) for r, w in custom.items()})
    assert wide.select(S.skill_points(df, {r: F.col(r) for r in custom})).first()[0] == df.select(S.skill_points(df, custom)).first()[0]


def test_kicker_values(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 3.0, 1.0)], "fg_made_0_19 double, fg_made_30_39 double, fg_made_40_49 double, fg_made_50_59 double, pat_made double, fg_missed double")
    assert df.select(S.kicker_points(df)).first()[0] == 18.0
    assert df.select(S.kicker_points(df, S.resolve_rules(custom={"fg_miss": -1}))).first()[0] == 17.0
    flat = spark.createDataFrame([(2.0, 1.0)], "fg_made double, pat_made double")
    assert flat.select(S.kicker_points(flat)).first()[0] == 7.0


def test_defence_values(spark):
    df = spark.createDataFrame([(float(p),) for p in (0, 3, 10, 17, 24, 30, 45)] + [(None,)], "points_allowed double")
    assert [r[0] for r in df.select(S.defence_points(df)).collect()] == [10, 7, 4, 1, 0, -1, -4, 10]
    full = spark.createDataFrame([(3.0, 2.0, 1.0, 10.0)], "def_sacks double, def_interceptions double, def_tds double, points_allowed double")
    assert full.select(S.defence_points(full)).first()[0] == 17.0


def test_name_keys_differ(spark):
    df = spark.createDataFrame([("Odell Beckham Jr.",), ("Ken Walker III",), ("A.J. Brown",), (None,)], "n string")
    assert [r[0] for r in df.select(N.word_key("n")).collect()] == ["odell beckham", "ken walker", "aj brown", None]
    assert [r[0] for r in df.select(N.letter_key("n")).collect()] == ["odellbeckham", "kenwalker", "ajbrown", ""]


def test_defence_name_is_idempotent(spark):
    df = spark.createDataFrame([("PHI", "DEF"), ("PHI DST", "DEF"), ("Jake", "K")], "n string, p string")
    once = df.withColumn("n", N.defence_name("n", "p"))
    assert [r[0] for r in once.select("n").collect()] == ["PHI DST", "PHI DST", "Jake"]


def test_odds(spark):
    df = spark.createDataFrame([(-110.0, 150.0)], "a double, b double")
    got = df.select(O.implied_probability("a"), O.implied_probability("b"), O.unit_profit("a"), O.unit_profit("b"), O.unit_profit("a", F.lit(False))).first()
    assert list(got) == pytest.approx([110 / 210, 0.4, 100 / 110, 1.5, -1.0])
    even = df.select(O.fair_probability("a", "a")).first()[0]
    assert even == pytest.approx(0.5)


def test_better_side_prefers_over_on_ties(spark):
    df = spark.createDataFrame([(0.5, -110.0, -110.0), (0.2, -110.0, -110.0)], "p double, o double, u double")
    got = [r[0] for r in df.select(O.better_side("p", "o", "u")).collect()]
    assert got[0]["side"] == "over" and got[1]["side"] == "under"


def test_many_rule_sets_scan_once(spark):
    df = spark.createDataFrame([(1, 5.0)], "player_id int, receptions double")
    out = S.with_points_per_rule_set(df, {"ppr": S.PPR, "standard": S.STANDARD})
    assert rows(out, "rules", "fp") == [("ppr", 5.0), ("standard", 0.0)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
