"""No output before a cut, and no feature at the cut, may depend on rows at or after it."""

import pytest
from pyspark.sql import functions as F

from leakfree import adapters as A
from leakfree.functions.expr import order_key
from leakfree.functions.scoring import with_points
from leakfree.operators import career as K
from leakfree.operators import joins as J
from leakfree.operators import rollups as U
from leakfree.operators import trailing as T
from leakfree.plans import features as FT
from leakfree.plans import games as GM
from leakfree.plans import projection as PR
from leakfree.plans import rookies as RK
from leakfree.plans import season as SE

from conftest import rows

CUT = 199901
STATS = ("passing_yards", "passing_tds", "receptions", "receiving_yards", "rushing_yards", "targets", "carries", "attempts", "target_share")


@pytest.fixture(scope="module")
def weekly(spark, sf):
    return A.weekly(spark, sf).cache()


@pytest.fixture(scope="module")
def games(spark, sf):
    return A.games(spark, sf).cache()


def mutate(df, columns, cut=CUT):
    """The same frame with every stat at or after the cut replaced by nonsense."""
    late = order_key() >= cut
    return df.withColumns({c: F.when(late, F.col(c) * -7.0 + 1234.0).otherwise(F.col(c)) for c in columns})


def scored(w):
    return with_points(w)


def close(found):
    """Sums may be taken in another order; nine digits are compared."""
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found]


def check(make, original, changed, upto):
    a, b = (make(x).where(upto) for x in (original, changed))
    got = close(rows(a))
    assert got and got == close(rows(b))


UPTO = f"season * 100 + week <= {CUT}"


def test_trailing_features(weekly):
    make = lambda w: T.trailing_mean(scored(w), ["fp", "targets"], (3, 5)).select("player_id", "season", "week", "fp_r3", "fp_r5", "targets_r5")
    check(make, weekly, mutate(weekly, STATS), UPTO)


def test_allowed_form(weekly):
    check(lambda w: T.allowed_form(scored(w), (3, 5)), weekly, mutate(weekly, STATS), UPTO)


def test_feature_table(spark, sf, weekly, games):
    def make(w):
        f = FT.feature_table(w, games, A.reports(spark, sf))
        cols = [c for c in FT.feature_columns() if c in f.columns]
        return f.select("player_id", "season", "week", *cols)
    check(make, weekly, mutate(weekly, STATS), UPTO)


def test_team_form(games):
    changed = mutate(games, ["home_score", "away_score"])
    # teams here play several games a week, and a later game may use an earlier one of its week
    check(GM.team_form, games, changed, f"season * 100 + week < {CUT}")


def test_difficulty_and_quality_enter_the_next_season(weekly, games):
    targets = J.seasons_with_next(weekly)
    check(lambda w: U.defence_difficulty(scored(w), targets), weekly, mutate(weekly, STATS), F.col("season") <= 1999)
    check(lambda g: U.opponent_quality(g, targets, schedule=games), games, mutate(games, ["home_score", "away_score"]), F.col("season") <= 1999)


def test_career_features(weekly):
    def make(w):
        return K.career_features(U.season_rollup(scored(w)))
    check(make, weekly, mutate(weekly, STATS), F.col("season") < 1999)


def test_upside_and_career_high(weekly):
    check(lambda w: K.upside_features(scored(w)), weekly, mutate(weekly, STATS), F.col("season") < 1999)


def test_age_curves_ignore_the_valued_season(spark, sf):
    s = A.seasons(spark, sf)
    births = s.select("player_id", "season", (1970 + F.col("player_id") % 9).cast("int").alias("birth_year"))
    changed = s.withColumn("fp", F.when(F.col("season") >= 1999, F.col("fp") * 9).otherwise(F.col("fp")))
    make = lambda x: K.age_curves(x, births, 1999, ["QB", "RB", "WR"], min_games=1, min_pairs=1)
    check(make, s, changed, F.lit(True))


def test_entrants_learn_from_earlier_classes(spark, sf):
    s, p = A.seasons(spark, sf), A.draft_picks(spark, sf)
    changed = s.withColumn("fp", F.when(F.col("season") >= 1996, F.col("fp") * 9 + 1).otherwise(F.col("fp")))
    check(lambda x: RK.rookie_projection(p, x, 1996), s, changed, F.lit(True))


class Spy:
    """A projector that only records which keys it is shown."""

    learns = True

    def __init__(self):
        self.seen = []

    def fit(self, train):
        self.train_max = train.agg(F.max(order_key())).first()[0]
        return self

    def predict(self, test):
        low = test.agg(F.min(order_key())).first()[0]
        if low is not None:
            self.seen.append((self.train_max, low))
        return test.withColumn("pred", F.lit(0.0))


def frame(spark, per_week=6):
    data = [(s, w, p, "QB", float(p + w), float(p)) for s in (2021, 2022, 2023) for w in (1, 2, 3) for p in range(per_week)]
    return spark.createDataFrame(data, "season int, week int, player_id int, position string, fp double, fp_r3 double")


def test_walk_forward_trains_on_the_past_only(spark):
    spy = Spy()
    out = PR.walk_forward(frame(spark), spy, [2023], min_train_rows=5)
    assert out.count() == 18 and len(spy.seen) == 3
    assert all(train < test for train, test in spy.seen)
    assert [t for t, _ in spy.seen] == sorted({t for t, _ in spy.seen})


def test_walk_forward_without_history_is_empty(spark):
    out = PR.walk_forward(frame(spark), Spy(), [2023], min_train_rows=10_000)
    assert out.count() == 0 and out.columns == ["season", "week", "player_id", "position", "fp", "pred"]


def test_season_refit_never_sees_its_season(spark):
    spy = Spy()
    PR.walk_forward(frame(spark), spy, [2022, 2023], min_train_rows=5, refit="season")
    assert spy.seen == [(202103, 202201), (202203, 202301)]


def test_pick_curve_never_rises(spark):
    data = [(p, p % 7 + 2015, float(300 - p + (p * 37) % 50)) for p in range(1, 258, 2)]
    fit = RK.PickCurve().fit(spark.createDataFrame(data, "pick int, season int, fp double"))
    grid = fit.predict(spark.range(1, 260).select(F.col("id").cast("int").alias("pick"))).orderBy("pick").select("proj").collect()
    values = [r[0] for r in grid]
    assert all(a >= b for a, b in zip(values, values[1:]))


def test_anchor_regresses_starters(spark):
    f = spark.createDataFrame([(1, 2023, 100.0, 10, 8.0, 10.0, 2), (2, 2023, 100.0, 10, 8.0, 10.0, 2)],
                              "player_id int, tseason int, p_fp double, p_games int, c_ppg_wavg double, c_games_avg double, c_seasons int")
    starting = spark.createDataFrame([(1, 2023)], "player_id int, season int")
    got = {r["player_id"]: r["anchor"] for r in SE.prior_anchor(f, starting).collect()}
    assert got[2] == pytest.approx(9.0 * 10.0) and got[1] == pytest.approx(9.0 * (10 * 2 + 15.5 * 8) / 10)


def test_season_operators_ignore_other_season_types_and_positions(spark, sf):
    from leakfree import adapters
    from leakfree.operators import rollups
    from leakfree.queries import windows

    weekly = adapters.weekly(spark, sf)
    regular = weekly.where("season_type = 'REG'")
    skill = regular.where("position in ('QB', 'RB', 'WR', 'TE')")
    assert skill.count() < regular.count() < weekly.count()
    for f, few in ((rollups.player_volume, skill), (rollups.pass_rate, regular)):
        a, b = (sorted(map(str, f(x).collect())) for x in (few, weekly))
        assert a == b
    keys = ["player_id", "season", "week"]
    assert windows.skilled(spark, sf).select(*keys).exceptAll(skill.select(*keys)).isEmpty()
    assert skill.select(*keys).exceptAll(windows.skilled(spark, sf).select(*keys)).isEmpty()
