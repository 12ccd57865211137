import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakfree.operators import career as K
from leakfree.operators import context as X
from leakfree.operators import correlation as C
from leakfree.operators import joins as J
from leakfree.operators import lineup as L
from leakfree.operators import metrics as M
from leakfree.operators import ordered as Q
from leakfree.operators import pools as P
from leakfree.operators import ranking as R
from leakfree.operators import reshape as G
from leakfree.operators import rollups as U
from leakfree.operators import trailing as T

from conftest import by, rows


def weeks(spark, values, pid=1):
    return spark.createDataFrame([(pid, 2023, i + 1, float(v)) for i, v in enumerate(values)], "player_id int, season int, week int, fp double")


def test_trailing_mean_excludes_the_current_row(spark):
    out = T.trailing_mean(weeks(spark, [10, 20, 30, 40]), ["fp"], (2,))
    assert [r[0] for r in out.orderBy("week").select("fp_r2").collect()] == [None, 10, 15, 25]


def test_trailing_mean_needs_three_rows(spark):
    out = T.trailing_mean(weeks(spark, [10, 20, 30, 40, 50]), ["fp"], (8,), min_rows=3)
    assert [r[0] for r in out.orderBy("week").select("fp_r8").collect()] == [None, None, None, 20, 25]


def test_chunked_windows_equal_plain_windows(spark):
    rng = random.Random(3)
    data = [(t, s, w, g, float(rng.randint(0, 50)) if rng.random() > 0.1 else None)
            for t in ("a", "b") for s in (1, 2, 3, 4) for w in range(rng.randint(1, 9)) for g in range(rng.randint(1, 3))]
    df = spark.createDataFrame(data, "team string, season int, week int, game int, pf double")
    plain = T.trailing_mean(df, ["pf"], (3, 8), ["team"], ["season", "week", "game"], min_rows=2)
    chunked = T.trailing_mean_chunked(df, ["pf"], (3, 8), ["team"], ["season", "week", "game"], "season", min_rows=2)
    cols = ("team", "season", "week", "game", "pf_r3", "pf_r8")
    assert rows(plain, *cols) == rows(chunked, *cols)


def test_allowed_form(spark):
    data = [(2023, w, "D", "WR", v) for w, v in ((1, 20.0), (2, 30.0), (3, 99.0))]
    df = spark.createDataFrame(data, "season int, week int, opponent_team string, position string, fp double")
    out = T.allowed_form(df, (2,)).orderBy("week")
    assert [r[0] for r in out.select("def_fp_allowed_r2").collect()] == [None, 20, 25]


def test_implied_totals(spark):
    df = spark.createDataFrame([("g", 2023, 1, "KC", "DEN", 3.0, 46.0), ("h", 2023, 1, "A", "B", None, 40.0)],
                               "game_id string, season int, week int, home_team string, away_team string, spread_line double, total_line double")
    assert by(G.implied_totals(df), "team", "team_implied_total") == {"KC": 24.5, "DEN": 21.5}


@pytest.mark.parametrize("n", [2, 4, 5, 8])
def test_round_robin_is_a_valid_slate(spark, n):
    slate = rows(G.round_robin(spark.range(n * 2).select(F.col("id").cast("int").alias("p")), "p", n), "p", "team_a", "team_b")
    for p in range(n * 2):
        teams = [t for r in slate if r[0] == p for t in r[1:]]
        assert len(teams) == len(set(teams)) == n - n % 2
    cycle = n - 1 + n % 2
    met = [frozenset(r[1:]) for r in slate if r[0] < cycle]
    assert len(set(met)) == len(met) == n * (n - 1) // 2


def test_rank_and_row_numbers_over_hot_groups(spark):
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 else "cold", float(rng.randint(0, 9))) for i in range(300)] + [(999, "hot", None)]
    df = spark.createDataFrame(data, "id int, g string, v double")
    ranks = by(Q.competition_rank(df, ["g"], "v", "r"), "id", "r")
    averages = by(Q.competition_rank(df, ["g"], "v", "r", descending=False, method="average"), "id", "r")
    places = by(Q.row_numbers(df.where("v is not null"), ["g"], [F.col("v").desc(), F.col("id").asc()], "r"), "id", "r")
    for i, g, v in data:
        mine = [x for _, h, x in data if h == g and x is not None]
        if v is None:
            assert ranks[i] is None
            continue
        assert ranks[i] == 1 + sum(x > v for x in mine)
        assert averages[i] == sum(x < v for x in mine) + (sum(x == v for x in mine) + 1) / 2
        assert places[i] == 1 + sum((x, -j) > (v, -i) for j, h, x in data if h == g and x is not None)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=101), rng.integers(0, 4, size=50).astype(float)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: list(r)[1:] for r in Q.group_quantiles(df, ["g"], "v", probs).collect()}
    assert got["a"] == pytest.approx(np.quantile(a, probs)) and got["b"] == pytest.approx(np.quantile(b, probs))


def test_top_values_carry_tie_sharing_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in (5.0, 5.0, 4.0, 3.0, None)], "g string, v double")
    assert rows(Q.top_values(df, ["g"], "v", 2), "v", "rank") == [(4.0, 3), (5.0, 1)]


def test_tail_shares_are_strict(spark):
    pool = spark.createDataFrame([("k", v) for v in (-3.0, 0.0, 0.0, 3.0)], "k string, residual double")
    asked = spark.createDataFrame([(1, "k", 0.0), (2, "k", -9.0), (3, "k", 2.5)], "id int, k string, need double")
    out = {r["id"]: (r["p_above"], r["p_below"]) for r in P.tail_shares(asked, pool, ["k"], "need").collect()}
    assert out == {1: (0.25, 0.25), 2: (1.0, 0.0), 3: (0.25, 0.75)}


def test_inverse_cdf_equals_numpy(spark):
    values = [4.0, -1.0, 2.0, 2.0, 7.5]
    pool = P.ranked_pool(spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)], "i int, k string, residual double"), ["k"], ident=["i"])
    us = [0.0, 0.1, 0.5, 0.77, 1.0]
    draws = spark.createDataFrame([("k", u) for u in us], "k string, u double")
    got = by(P.inverse_cdf(draws, pool, ["k"], "u"), "u", "draw")
    assert [got[u] for u in us] == pytest.approx(np.quantile(values, us))


def test_pair_sums_equal_explicit_pairs(spark):
    rng = random.Random(7)
    data = [(i, 2023, w, f"t{i % 3}", f"t{(i + 1 + w) % 3}", ("QB", "RB", "WR", "TE")[(i + w) % 4], float(rng.randint(-20, 20)))
            for w in range(6) for i in range(30)]
    df = spark.createDataFrame(data, "player_id int, season int, week int, recent_team string, opponent_team string, position string, residual double")
    got = {r["relation"]: (r["n_pairs"], r["rho"]) for r in C.estimate_relations(df).collect()}
    pc = ("WR", "TE")

    def pairs(pa, pb, same, mirrored):
        for a, b in itertools.product(data, data):
            if a[2] != b[2] or a[5] not in pa or b[5] not in pb:
                continue
            if mirrored:
                ok = a[3] == b[4] and a[4] == b[3]
            else:
                ok = a[3] == b[3] and (a[0] < b[0] if same else a[0] != b[0])
            if ok:
                yield a[6], b[6]

    for name, args in {"qb_pc": (("QB",), pc, False, False), "pc_pc": (pc, pc, True, False), "rb_pc": (("RB",), pc, False, False),
                       "qb_rb": (("QB",), ("RB",), False, False), "opp_qb_pc": (("QB",), pc, False, True), "opp_pc_pc": (pc, pc, False, True)}.items():
        xy = list(pairs(*args))
        want = float(np.corrcoef([x for x, _ in xy], [y for _, y in xy])[0, 1]) if len(xy) >= 30 else 0.0
        assert got[name][0] == len(xy)
        assert got[name][1] == pytest.approx(want, abs=1e-9)


def test_relation_of_players(spark):
    df = spark.createDataFrame([("A", "B", "QB", "A", "B", "WR"), ("A", "B", "QB", "C", "D", "WR"), ("A", "B", "QB", "B", "A", "WR")],
                               "ta string, oa string, pa string, tb string, ob string, pb string")
    got = [r[0] for r in df.select(C.relation_rho(*df.columns)).collect()]
    assert got == [C.RHO["qb_pc"], 0.0, C.RHO["opp_qb_pc"]]


def test_strictly_prior_uses_only_earlier_seasons(spark):
    h = spark.createDataFrame([("d", 2021, 2.0), ("d", 2022, 1.0)], "team string, season int, v double")
    out = by(J.strictly_prior(h, ["team"], "v", J.seasons_with_next(h), 9.0, "x", decay=0.5), "season", "x")
    assert out == {2021: 9.0, 2022: 2.0, 2023: pytest.approx((2.0 * 0.25 + 1.0 * 0.5) / 0.75)}


def test_career_means_decay(spark):
    agg = spark.createDataFrame([(1, 2020, 10, 100.0, 0.1), (1, 2022, 10, 200.0, None)], "player_id int, season int, games int, fp double, tgt_share double")
    got = {r["season"]: r for r in K.career_features(agg).collect()}
    w = 0.6 ** 2
    assert got[2022]["c_fp_wavg"] == pytest.approx((200 + 100 * w) / (1 + w))
    assert got[2022]["c_tgt_share_wavg"] == pytest.approx(0.1 * w / (1 + w))
    assert got[2022]["c_fp_trend"] == 100.0 and got[2020]["c_fp_trend"] == 0.0 and got[2022]["c_seasons"] == 2


def test_weekly_shape(spark):
    df = weeks(spark, [4, 4, 30, 4, 28])
    r = K.weekly_shape(df).first()
    mean = 14.0
    assert r["ceiling"] == pytest.approx((30 + 28 + 4) / 3) and r["floor"] == 4.0
    assert r["boom"] == pytest.approx(2 / 5) and r["stdev"] == pytest.approx(np.std([4, 4, 30, 4, 28])) and mean == 14.0


def test_career_high_excludes_debuts(spark):
    t = spark.createDataFrame([(1, 2022, 200.0), (1, 2023, 300.0), (2, 2023, 400.0), (3, 2022, 310.0), (3, 2023, 300.0)], "player_id int, season int, touches double")
    assert by(K.career_high(t, 2024), "player_id", "career_year") == {1: True, 2: False, 3: False}


def test_absence_streaks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5)], "e string, p int")
    out = rows(T.absence_streaks(df, "e", "p", F.lit(6)), "p", "absent_streak", "injured")
    assert out == [(1, 0, False), (2, 0, False), (3, 1, False), (4, 2, True), (5, 0, False), (6, 1, False)]


def test_seeding_only_before_the_first_value(spark):
    df = spark.createDataFrame([(1, 2023, 1, None, 7.0), (1, 2023, 2, 3.0, 7.0), (1, 2023, 3, None, 7.0)], "player_id int, season int, week int, v double, prior double")
    assert [r[0] for r in df.select("week", T.seed_unseen("v", "prior", ["player_id"]).alias("x")).orderBy("week").select("x").collect()] == [7.0, 3.0, None]


def test_sequences_are_right_aligned(spark):
    df = weeks(spark, [1, 2, 3])
    out = T.last_k_sequences(df, ["fp"], 2, {"fp": (F.lit(0.0), F.lit(1.0))}).orderBy("week")
    assert [r["sequence"] for r in out.collect()] == [[[0.0], [0.0]], [[0.0], [1.0]], [[1.0], [2.0]]]


ELIGIBLE = {"QB": {"QB"}, "RB": {"RB"}, "WR": {"WR"}, "TE": {"TE"}, "K": {"K"}, "DEF": {"DEF"},
            **{c: set(w) for c, w in L.FLEX_CLASSES.items()}}


def greedy(players, slots):
    """Reference filling, written the slow way: one slot after the other."""
    order = [p for p in ("QB", "RB", "WR", "TE") for _ in range(slots.pure.get(p, 0))]
    order += [c for c in L.FLEX_CLASSES for _ in range(slots.flex.get(c, 0))]
    order += [p for p in ("DEF", "K") for _ in range(slots.pure.get(p, 0))]
    left, out = sorted(players, key=lambda p: (-p[2], p[0])), {}
    for slot in order:
        hit = next((p for p in left if p[1] in ELIGIBLE[slot]), None)
        if hit:
            left.remove(hit)
            out[hit[0]] = slot
    return out


SLOT_SETS = [
    L.DEFAULT, L.STANDARD, L.Slots({"QB": 1, "RB": 1}, {"WRTE": 1, "FLEX": 1, "SUPERFLEX": 1}),
    L.Slots({"RB": 1, "WR": 1}, {"WRTE": 1, "RBWR": 2}),
]


@pytest.mark.parametrize("slots", SLOT_SETS)
def test_slots_equal_greedy_filling(spark, slots):
    rng = random.Random(11)
    data = [(t, f"p{i:02d}", rng.choice(("QB", "RB", "WR", "TE", "DEF", "K")), float(rng.randint(0, 9))) for t in range(12) for i in range(rng.randint(0, 15))]
    df = spark.createDataFrame(data, "team int, player string, position string, pred double")
    got = {}
    for r in L.assign_slots(df, ["team"], "pred", "player", slots).collect():
        got.setdefault(r["team"], {})[r["player"]] = r["slot"]
    for t in range(12):
        assert got.get(t, {}) == greedy([d[1:] for d in data if d[0] == t], slots)


@pytest.mark.parametrize("slots", SLOT_SETS)
def test_marginal_gain_equals_refilling(spark, slots):
    rng = random.Random(13)
    pos = ("QB", "RB", "WR", "TE", "K")
    roster = [(0, t, f"r{t}{i:02d}", rng.choice(pos), float(rng.randint(0, 30))) for t in range(3) for i in range(9)]
    free = [(0, f"f{i:02d}", rng.choice(pos), float(rng.randint(0, 40)) + i / 100) for i in range(60)]
    got = {}
    out = L.marginal_gain(
        spark.createDataFrame(roster, "lg int, team int, player string, position string, pred double"),
        spark.createDataFrame(free, "lg int, player string, position string, pred double"),
        ["team"], ["lg"], "pred", "player", slots, top=4)
    for r in out.collect():
        got.setdefault(r["team"], []).append((r["place"], r["player"], round(r["gain"], 6), r["replaces"]))
    pool = sorted(free, key=lambda f: (-f[3], f[1]))
    for t in range(3):
        mine = [r[2:] for r in roster if r[1] == t]
        value = {p[0]: p[2] for p in mine} | {f[1]: f[3] for f in pool}
        base = greedy(mine, slots)
        want = []
        for _, name, p, v in pool:
            new = greedy([*mine, (name, p, v)], slots)
            gain = sum(value[x] for x in new) - sum(value[x] for x in base)
            if gain > 1e-6:
                gone = sorted(set(base) - set(new))
                want.append((-round(gain, 6), name, gone[0] if gone else None))
        want = [(i + 1, n, -g, x) for i, (g, n, x) in enumerate(sorted(want)[:4])]
        assert sorted(got.get(t, [])) == want


def test_marginal_gain_meets_free_agents_once(spark, monkeypatch):
    """Free agents are numbered once for all teams; what a team tries does not grow with the pool."""
    kept, stored = {}, L.stored
    monkeypatch.setattr(L, "stored", lambda df, name="stage": kept.setdefault(name, stored(df, name)))
    slots, teams, agents, top = L.Slots({"QB": 1, "RB": 1}, {}), 20, 3000, 2
    roster = [(0, t, f"r{t}{p}", p, float(t * 100 + i)) for t in range(teams) for i, p in enumerate(("QB", "RB"))]
    free = [(0, f"f{i:04d}", ("QB", "RB")[i % 2], i * 0.7) for i in range(agents)]
    out = L.marginal_gain(
        spark.createDataFrame(roster, "lg int, team int, player string, position string, pred double"),
        spark.createDataFrame(free, "lg int, player string, position string, pred double"), ["team"], ["lg"], "pred", "player", slots, top=top)
    assert len(out.collect()) == top * teams
    assert kept["placed"].count() == agents + 2 * 2 * len({r[4] for r in roster})
    assert kept["tried"].count() <= teams * 2 * (2 * 2 + 1) * top


def test_score_board_values(spark):
    data = [(i, f"p{i}", p, float(v)) for i, (p, v) in enumerate([("QB", 300), ("QB", 250), ("RB", 200), ("RB", 150), ("RB", 100), ("WR", 180)])]
    df = spark.createDataFrame(data, "player_id int, player string, position string, proj double")
    league = {"teams": 1, "budget": 100, "roster_spots": 10, "starters": {"QB": 1, "RB": 1, "WR": 1, "TE": 1}, "flex": 0}
    got = {r["player_id"]: (r["vor"], r["auction"]) for r in R.score_board(df, league).collect()}
    assert got[0][0] == 17.5 and got[1][0] == 0.0 and got[2][0] == 50.0 and got[4][0] == -50.0 and got[5][0] == 0.0
    assert got[2][1] == round(1 + 50.0 / 67.5 * 90)


def test_replacement_ranks_deepen(spark):
    base = R.replacement_ranks(R.DEFAULT_LEAGUE)
    assert base == {"QB": 12, "RB": 28, "WR": 42, "TE": 14}
    assert R.replacement_ranks({**R.DEFAULT_LEAGUE, "superflex": 1})["QB"] == 24


def test_sort_match_leaves_small_rooms(spark):
    df = spark.createDataFrame([(1, "A", "RB", 2.0, 50.0), (2, "A", "RB", 1.0, 40.0), (3, "B", "RB", 1.0, 30.0), (4, "A", "WR", 1.0, 60.0), (5, "A", "RB", None, 99.0)],
                               "player_id int, team string, position string, ord double, proj double")
    out = by(R.sort_match(df, ["team"], "ord", "proj", "player_id", F.col("position") == "RB"), "player_id", "proj")
    assert out == {1: 40.0, 2: 50.0, 3: 30.0, 4: 60.0, 5: 99.0}


def test_ended_hurt(spark):
    cols = "player_id string, season int, week int, team string, game_type string, report_status string, report_primary_injury string"
    reports = spark.createDataFrame([
        ("a", 2023, 20, "T", "DIV", "Out", "Knee"), ("a", 2023, 21, "T", "CON", "Out", "Knee"), ("a", 2023, 21, "T", "CON", "Doubtful", "Knee"),
        ("b", 2023, 5, "T", "REG", "Out", "Ankle"), ("c", 2023, 22, "T", "SB", "Out", "Illness"), ("d", 2023, 22, "T", "SB", "Out", "Not injury related - rest"),
        ("e", 2023, 22, "T", "SB", "Questionable", "Toe")], cols)
    finish = spark.createDataFrame([(2023, "T", 22)], "season int, team string, finish int")
    got = {r["player_id"]: (r["ended_hurt"], r["weeks_out"], r["last_round"]) for r in X.injury_seasons(reports, finish).collect()}
    assert got == {"a": (True, 2, "CON"), "b": (False, 1, "REG"), "c": (False, 1, "SB")}


def test_latest_status_wins(spark):
    r = spark.createDataFrame([("a", 2024, 1, "ACT"), ("a", 2024, 9, "RES"), ("b", 2024, 1, "RES"), ("b", 2024, 9, "ACT")], "player_id string, season int, week int, status string")
    assert rows(X.roster_status(r, 2024)) == [("a", "on injured reserve")]


def test_line_needs_two_down(spark):
    chart = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 4), ("B", 5)], "team string, player_id int")
    avail = spark.createDataFrame([(1, True, None, None), (4, False, "on PUP", None), (5, False, None, "IR"), (2, False, None, "Questionable")],
                                  "player_id int, ended_hurt boolean, status string, live_code string")
    names = spark.createDataFrame([(4, "Zed"), (5, "Abe")], "player_id int, full_name string")
    assert rows(X.line_context(chart, avail, names)) == [("B", 2, "Abe, Zed")]


def test_spearman_equals_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.repeat([1, 2, 3], 40), "a": rng.integers(0, 8, 120).astype(float), "b": rng.normal(size=120)})
    pdf.loc[pdf.g == 3, "a"] = 1.0
    got = by(M.group_spearman(spark.createDataFrame(pdf), ["g"], "a", "b"), "g", "spearman")
    for g in (1, 2):
        x = pdf[pdf.g == g]
        assert got[g] == pytest.approx(x["a"].rank().corr(x["b"].rank()))
    assert got[3] is None


def test_bootstrap_equals_a_direct_resample(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    r = M.bootstrap_mean(df, "v", ["i"], resamples=50, draw=M.arithmetic_draw(4)).first()
    n = len(values)
    means = [np.mean([values[(b * 7919 + i * 104729 + b * i * 31 + 4) % n] for i in range(n)]) for b in range(50)]
    assert (r["low"], r["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    again = M.bootstrap_mean(df, "v", ["i"], resamples=50)
    assert again.first() == M.bootstrap_mean(df, "v", ["i"], resamples=50).first()


def test_stacked_ranks_equal_single_ones(spark):
    from leakfree.operators import ordered as O

    rnd = np.random.default_rng(1)
    data = [(i, ["a", "b", None][i % 3], float(rnd.integers(9)) if i % 7 else None, int(rnd.integers(5))) for i in range(90)]
    df = spark.createDataFrame(data, "i int, g string, x double, y int")
    for method in ("min", "average"):
        for down in (True, False):
            got = O.stacked_ranks(df, {"rx": (["g"], "x"), "ry": ([], "y")}, down, method)
            want = O.competition_rank(O.competition_rank(df, ["g"], "x", "rx", down, method), [], "y", "ry", down, method)
            assert rows(got, *want.columns) == rows(want)


def test_resamples_draw_n_rows_and_do_not_depend_on_the_layout(spark, monkeypatch):
    draw = M.hashed_draw(3)
    for n in (1, 5, 700, M.PART + 40):
        parts = [np.hstack(list(draw(40, 9, n, first, min(M.PART, n - first)))) for first in range(0, n, M.PART)]
        counts = np.hstack(parts)
        assert counts.shape == (40, n) and (counts.sum(axis=1) == n).all()
    counts = np.hstack(list(draw(4000, 1, 5, 0, 5)))
    assert abs(counts.mean(axis=0) - 1).max() < 0.06 and abs(counts.var(axis=0) - 0.8).max() < 0.1
    for n in (1, 6, 12, 35):
        want = [[sum((b * 7919 + i * 104729 + b * i * 31 + 11) % n == j for i in range(n)) for j in range(n)] for b in range(60)]
        assert np.hstack(list(M.arithmetic_draw(11)(60, 0, n, 0, n))).tolist() == want
    monkeypatch.setattr(M, "PART", 64)
    df = spark.range(300).selectExpr("id as i", "if(id % 3 = 0, null, 'x') as g", "double(id % 7) as v")
    a, b = (sorted(map(tuple, M.bootstrap_mean(df.repartition(p), "v", ["i"], ["g"], resamples=200).collect()), key=str) for p in (1, 13))
    assert a == b and len(a) == 2 and all(r[3] < r[2] < r[4] for r in a)


def test_sweep_intervals_pair_slots_and_share_resamples(spark):
    rows = [(f, s, k, 1 + (s + k + int(f * 4)) % 12, (s + k) % 12 == 0) for f in (0.0, 0.5) for s in range(4) for k in range(12)]
    df = spark.createDataFrame(rows, "fraction double, season int, slot int, place int, won boolean")
    got = {(r.fraction, r.metric): r for r in M.sweep_intervals(df, resamples=300).collect()}
    assert len(got) == 9 and all(r.n == 48 and r.n_clusters == 4 for r in got.values())
    assert got[0.5, "title_rate_delta"].low == got[0.5, "title_rate_delta"].high == 0.0
    delta = np.mean([b[3] - a[3] for a, b in zip(rows[:48], rows[48:], strict=True)])
    assert got[0.5, "mean_finish_delta"].estimate == pytest.approx(delta)


def test_standings_settle_ties_on_the_bench(spark):
    matches = spark.createDataFrame([(0, 0, 1)], "p int, team_a int, team_b int")
    scores = spark.createDataFrame([(0, 0, 50.0, 10.0), (0, 1, 50.0, 20.0)], "p int, team int, score double, bench double")
    assert by(M.standings(matches, scores, "p"), "team", "wins") == {0: 0.5, 1: 0.5}
    assert by(M.standings(matches, scores, "p", bench="bench"), "team", "wins") == {0: 0.0, 1: 1.0}


def test_modal_team_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "B", 3), (1, "A", 3), (1, "C", 1)], "player_id int, team string, n int")
    assert rows(U.modal_value(df, ["player_id"], "team", "n")) == [(1, "A")]


def test_resolution_drops_ambiguous_names(spark):
    roster = spark.createDataFrame([("1", "ann", "WR"), ("2", "bob", "WR"), ("3", "bob", "WR"), ("4", "cid", "RB")], "player_id string, name_key string, position string")
    live = spark.createDataFrame([(" 1 ", "zzz", "WR", "IR"), (None, "ann", "WR", "Out"), (None, "bob", "WR", "Out"), (None, "cid", "RB", "Sus")],
                                 "gsis_id string, name_key string, position string, live_code string")
    assert rows(J.resolve_entities(live, roster, ["live_code"])) == [("1", True, "IR"), ("4", False, "Sus")]


def test_duplicate_keys_and_unpaired_rows_fail(spark):
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="duplicate key"):
        J.assert_unique(twice, ["k"]).collect()
    with pytest.raises(Exception, match="one to one"):
        J.strict_pairs(twice.limit(1), spark.createDataFrame([(2, 3)], "k int, v int"), ["k"], ["v"]).collect()
