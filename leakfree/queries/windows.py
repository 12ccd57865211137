"""Window functions (W1-W21)."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import scoring as S
from ..operators import career as K
from ..operators import lineup as L
from ..operators import ordered as Q
from ..operators import ranking as R
from ..operators import rollups as U
from ..operators import trailing as T
from ..session import stored
from . import projections  # noqa: F401  (registers the scored rows)
from .base import cte, even, q6, query, r6, sql

KEYS = ["player_id", "season", "week"]


def scored(spark, d):
    return S.with_points(A.weekly(spark, d))


def skilled(spark, d):
    """The scored rows of regular seasons and skill positions, which the season operators are about."""
    return U.regular_skill(scored(spark, d))


def trail(spark, d):
    """Scored rows with trailing means over 3 and 5 rows."""
    return T.trailing_mean(scored(spark, d), ["fp"], (3, 5))


def residuals(spark, d):
    """Out-of-sample errors of the trailing mean: pred = fp_r3, residual = fp - pred."""
    t = trail(spark, d).where(F.col("fp_r3").isNotNull())
    return t.withColumn("pred", r6("fp_r3")).withColumn("residual", r6(F.col("fp") - F.col("pred")))


def mixed_residuals(spark, d):
    """Residuals with the positions spread over every team."""
    k = F.col("player_id") % 4
    return residuals(spark, d).withColumn(
        "position", F.when(k == 0, "QB").when(k == 1, "RB").when(k == 2, "WR").otherwise("TE"))


def frame(n):
    return f"rows between {n} preceding and 1 preceding"


cte("trail", f"""
select *, avg(fp) over (partition by player_id order by season, week {frame(3)}) as fp_r3,
       avg(fp) over (partition by player_id order by season, week {frame(5)}) as fp_r5 from scored""", ("scored",))
cte("resid", f"""
select *, {q6('fp - pred')} as residual from (select *, {q6('fp_r3')} as pred from trail where fp_r3 is not null)""", ("trail",))

cte("mixed", "select * replace (case player_id % 4 when 0 then 'QB' when 1 then 'RB' when 2 then 'WR' else 'TE' end as position) from resid", ("resid",))

W1_COLS = ["fp", "targets", "receiving_yards", "receiving_epa"]


@query("w1_trailing_mean", sql("select player_id, season, week, " + ", ".join(
    f"{q6(f'avg({c}) over (partition by player_id order by season, week {frame(n)})')} as {c}_r{n}" for n in (3, 5) for c in W1_COLS)
    + " from scored", "scored"))
def w1(spark, d):
    t = T.trailing_mean(scored(spark, d), W1_COLS, (3, 5))
    return t.select(*KEYS, *[r6(f"{c}_r{n}").alias(f"{c}_r{n}") for n in (3, 5) for c in W1_COLS])


cte("allowed_form", f"""
select opponent_team, position, season, week,
  avg(a) over (partition by opponent_team, position order by season, week {frame(3)}) as def_fp_allowed_r3,
  avg(a) over (partition by opponent_team, position order by season, week {frame(5)}) as def_fp_allowed_r5
from (select opponent_team, position, season, week, sum(fp) as a from scored group by all)""", ("scored",))


@query("w2_allowed_form", sql(f"""
select opponent_team, position, season, week, {q6('def_fp_allowed_r3')} as def_fp_allowed_r3, {q6('def_fp_allowed_r5')} as def_fp_allowed_r5 from allowed_form""", "allowed_form"))
def w2(spark, d):
    a = T.allowed_form(scored(spark, d), (3, 5))
    return a.select(*a.columns[:4], *[r6(c).alias(c) for c in a.columns[4:]])


cte("team_form", """
select *, case when count(pf) over w >= 3 then avg(pf) over w end as pf_form, case when count(pa) over w >= 3 then avg(pa) over w end as pa_form
from (select game_id, season, week, home_team as team, home_score as pf, away_score as pa, 1 as is_home from games union all
      select game_id, season, week, away_team, away_score, home_score, 0 from games)
window w as (partition by team order by season, week, game_id rows between 8 preceding and 1 preceding)""", ("games",))


@query("w3_team_form", sql(f"select game_id, team, {q6('pf_form')} as pf_form, {q6('pa_form')} as pa_form from team_form", "team_form"))
def w3(spark, d):
    from ..plans.games import team_form

    return team_form(A.games(spark, d)).select("game_id", "team", r6("pf_form").alias("pf_form"), r6("pa_form").alias("pa_form"))


@query("w4_form_before_cut", sql(f"""
select player_id, {even('avg(fp)', 2)} as pred from (
  select player_id, fp, row_number() over (partition by player_id order by season desc, week desc) as rn from scored
  where season * 100 + week < 200006 and player_id in (select player_id from scored where season * 100 + week < 200006 group by 1 having max(season) >= 1999))
where rn <= 5 group by player_id""", "scored"))
def w4(spark, d):
    return T.form_before(scored(spark, d), "player_id", 200006, 5, active_since=1999)


@query("w5_next_season", sql("""
select player_id, season, fp, case when lead(season) over w = season + 1 then lead(fp) over w end as next_fp
from seasons window w as (partition by player_id order by season)""", "seasons"))
def w5(spark, d):
    return K.next_season(A.seasons(spark, d).select("player_id", "season", "fp"), "fp")


DECAY = "sum({v} * power(0.6, -(season - s0)::double)) over w / sum(power(0.6, -(season - s0)::double)) over w"
cte("career", f"""
select player_id, season, {DECAY.format(v='fp')} as c_fp_wavg, {DECAY.format(v='ppg')} as c_ppg_wavg,
  {DECAY.format(v='coalesce(tgt_share, 0.0)')} as c_tgt_share_wavg, avg(games) over w as c_games_avg, min(games) over w as c_games_min,
  cast(count(*) over w as int) as c_seasons, coalesce(fp - lag(fp) over (partition by player_id order by season), 0.0) as c_fp_trend,
  max(fp) over w as c_best_fp
from (select *, fp / greatest(games, 1) as ppg, min(season) over (partition by player_id) as s0 from seasons)
window w as (partition by player_id order by season rows between unbounded preceding and current row)""", ("seasons",))


@query("w6_decayed_career", sql(f"""
select player_id, season, {q6('c_fp_wavg')} as c_fp_wavg, {q6('c_ppg_wavg')} as c_ppg_wavg, {q6('c_tgt_share_wavg')} as c_tgt_share_wavg from career""", "career"))
def w6(spark, d):
    c = K.career_features(A.seasons(spark, d))
    return c.select("player_id", "season", *[r6(x).alias(x) for x in ("c_fp_wavg", "c_ppg_wavg", "c_tgt_share_wavg")])


@query("w7_cumulative_career", sql(f"""
select player_id, season, {q6('c_games_avg')} as c_games_avg, c_games_min, c_seasons, {q6('c_fp_trend')} as c_fp_trend, c_best_fp from career""", "career"))
def w7(spark, d):
    c = K.career_features(A.seasons(spark, d))
    return c.select("player_id", "season", r6("c_games_avg").alias("c_games_avg"), "c_games_min", "c_seasons",
                    r6("c_fp_trend").alias("c_fp_trend"), "c_best_fp")


cte("touches", "select player_id, season, sum(coalesce(carries, 0) + coalesce(targets, 0)) as touches from weekly where season_type = 'REG' group by all", ("weekly",))


def touches(spark, d):
    return A.weekly(spark, d).where(F.col("season_type") == "REG").groupBy("player_id", "season").agg(
        F.sum(F.coalesce("carries", F.lit(0.0)) + F.coalesce("targets", F.lit(0.0))).alias("touches"))


cte("career_high", """
select player_id, coalesce(peak, 0) >= 50 and touches >= 250 and touches >= coalesce(peak, 0) as career_year, round_even(touches, 0) as prior_touches from (
  select *, max(touches) over (partition by player_id order by season rows between unbounded preceding and 1 preceding) as peak
  from (select player_id, season, touches * 5 as touches from touches)) where season = 2000""", ("touches",))


@query("w8_career_high", sql("select * from career_high", "career_high"))
def w8(spark, d):
    t = touches(spark, d).withColumn("touches", F.col("touches") * 5)
    return K.career_high(t, 2001)


cte("shape_board", """
select b.*, s.u_ceiling, s.u_floor from board b left join (
  select player_id, max(fp) as u_ceiling, min(fp) as u_floor from seasons where season < (select max(season) from seasons) group by 1) s using (player_id)""", ("board", "seasons"))


def shape_table(spark, d):
    s = A.seasons(spark, d)
    return s.where(F.col("season") < s.agg(F.max("season")).scalar()).groupBy("player_id").agg(
        F.max("fp").alias("u_ceiling"), F.min("fp").alias("u_floor"))


@query("w9_upside_flags", sql("""
select player_id, round_even(u_ceiling, 1) as ceiling, round_even(u_floor, 1) as floor,
  coalesce(cr <= 24 and pr >= 20 and pr - cr >= 10, false) as sleeper, coalesce(fr <= 12 and pr <= 24, false) as anchor from (
  select *, case when u_ceiling is not null then rank() over (partition by position order by u_ceiling desc nulls last) end as cr,
    case when u_floor is not null then rank() over (partition by position order by u_floor desc nulls last) end as fr,
    rank() over (partition by position order by proj desc) as pr from shape_board)""", "shape_board"))
def w9(spark, d):
    return R.upside_flags(A.board(spark, d), shape_table(spark, d)).select("player_id", "ceiling", "floor", "sleeper", "anchor")


@query("w9_rank_in_position", sql("""
select player_id, case when u_ceiling is not null then cast(rank() over (partition by position order by u_ceiling desc nulls last) as int) end as ceil_rank from shape_board""", "shape_board"))
def w9b(spark, d):
    b = A.board(spark, d).join(shape_table(spark, d), "player_id", "left")
    return Q.competition_rank(b, ["position"], "u_ceiling", "ceil_rank").select("player_id", "ceil_rank")


cte("adp", "select replace(translate(c_name, '0123456789', 'abcdefghij'), '#', ' ') as player, cast(1 + (c_custkey * 37) % 400 as varchar) as adp from customer where c_custkey % 3 <> 0")


def adp(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").where(k % 3 != 0).select(
        A.letter_name(F.col("c_name")).alias("player"), (1 + (k * 37) % 400).cast("string").alias("adp"))


cte("room", """
select b.team, b.position, b.player, b.proj as score, cast(a.adp as double) as adp from board b left join adp a on a.player = b.player""", ("board", "adp"))


@query("w10_room_leader", sql("""
select team, position, player as top_player, score as top_score from (
  select *, row_number() over (partition by team, position order by coalesce(adp, 1e9), score desc, player) as rn from room) where rn = 1""", "room"))
def w10(spark, d):
    b = A.board(spark, d).withColumnRenamed("proj", "score").join(adp(spark, d), "player", "left").withColumn("adp", F.col("adp").try_cast("double"))
    return R.room_leader(b)


cte("keyed", """
select *, cast((player_id * 13) % 7 as int) as ord from board where position = 'RB' and player_id % 4 <> 0""", ("board",))


@query("w11_sort_match", sql("""
select b.player_id, coalesce(round_even(v.proj, 1), b.proj) as proj from board b left join (
  select k.player_id, x.proj from
    (select *, row_number() over (partition by team order by ord, proj desc, player_id) as i, count(*) over (partition by team) as n from keyed) k
    join (select *, row_number() over (partition by team order by proj desc, player_id) as i from keyed) x on k.team = x.team and k.i = x.i
  where k.n >= 2) v using (player_id)""", "keyed"))
def w11(spark, d):
    b = A.board(spark, d).withColumn("ord", F.when(F.col("player_id") % 4 != 0, ((F.col("player_id") * 13) % 7).cast("int")))
    return R.sort_match(b, ["team"], "ord", "proj", "player_id", F.col("position") == "RB").select("player_id", "proj")


cte("vor_board", """
select b.*, round_even((proj - repl) * case position when 'QB' then 0.35::double when 'TE' then 0.5::double else 1.0::double end, 1) as vor from board b join (
  select position, max_by(proj, rn) as repl from (
    select position, proj, row_number() over (partition by position order by proj desc, player_id) as rn from board)
  where rn <= case position when 'QB' then 13 when 'RB' then 29 when 'WR' then 43 when 'TE' then 15 end group by position) r using (position)""", ("board",))


@query("w12_consensus_delta", sql("""
select player_id, our_rank, cast(a.adp as double) as adp, round_even(cast(a.adp as double) - our_rank, 0) as adp_delta from (
  select *, cast(rank() over (order by vor desc) as int) as our_rank from vor_board) b left join adp a on lower(a.player) = lower(b.player)""", "vor_board", "adp"))
def w12(spark, d):
    b = R.score_board(A.board(spark, d))
    return R.consensus_delta(b, adp(spark, d)).select("player_id", "our_rank", "adp", "adp_delta")


@query("w13_upside_bonus", sql("""
select player_id, round_even(greatest(proj + 0.25::double * (coalesce(u_ceiling - med, 0.0) * 17), 0.0), 1) as proj from shape_board
join (select position, quantile_cont(u_ceiling, 0.5) as med from shape_board group by 1) using (position)""", "shape_board"))
def w13(spark, d):
    b = A.board(spark, d).join(shape_table(spark, d), "player_id", "left")
    return R.upside_bonus(b, "u_ceiling", 0.25).select("player_id", "proj")


cte("edges", "select position, quantile_cont(pred, 0.2) as e1, quantile_cont(pred, 0.4) as e2, quantile_cont(pred, 0.6) as e3, quantile_cont(pred, 0.8) as e4 from resid group by 1", ("resid",))
cte("binned", """
select r.*, cast((pred >= e1)::int + (pred >= e2)::int + (pred >= e3)::int + (pred >= e4)::int as int) as bin from resid r join edges using (position)""", ("resid", "edges"))


@query("w14_quantile_bins", sql("select player_id, season, week, bin from binned", "binned"))
def w14(spark, d):
    from ..operators.pools import with_bins

    return with_bins(residuals(spark, d)).select(*KEYS, "bin")


SEQ = ("fp", "targets", "carries")


@query("w15_last_k_sequence", sql(f"""
select player_id, season, week, n_games, {q6('checksum', 4)} as checksum from (
  select player_id, season, week, count(*) over w as n_games,
    coalesce(sum(z1 + 2 * z2 + 3 * z3) over w, 0.0) as checksum from (
    select s.*, coalesce((fp - m1) / d1, 0.0) as z1, coalesce((targets - m2) / d2, 0.0) as z2, coalesce((carries - m3) / d3, 0.0) as z3
    from scored s, (select avg(fp) as m1, stddev_pop(fp) as d1, avg(targets) as m2, stddev_pop(targets) as d2, avg(carries) as m3, stddev_pop(carries) as d3 from scored where season < 2000))
  window w as (partition by player_id order by season, week rows between 8 preceding and 1 preceding))""", "scored"))
def w15(spark, d):
    s = scored(spark, d)
    seq = T.last_k_sequences(s, SEQ, 8, T.train_scale(s.where(F.col("season") < 2000), SEQ))
    blank = F.filter("sequence", lambda v: F.forall(v, lambda x: x == 0.0))
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, v: acc + v[0] + 2 * v[1] + 3 * v[2])
    return seq.select(*KEYS, (F.size("sequence") - F.size(blank)).cast("bigint").alias("n_games"), r6(total, 4).alias("checksum"))


@query("w16_running_mean", sql(f"""
select player_id, season, week, {q6('avg(pred) over (partition by player_id, season order by week rows between unbounded preceding and current row)')} as form from resid""", "resid"))
def w16(spark, d):
    form = T.running_mean("pred", ["player_id", "season"], ["week"])
    return residuals(spark, d).select(*KEYS, r6(form).alias("form"))


@query("w17_absence_streak", """
with present as (select distinct user_id as entity, cast(dayofmonth(ts) as int) as period from events),
 grid as (select entity, cast(unnest(range(f, l + 1)) as int) as period from (select entity, min(period) as f from present group by 1), (select max(period) as l from present)),
 seen as (select g.entity, g.period, max(p.period) over (partition by g.entity order by g.period) as last_seen from grid g left join present p using (entity, period))
select entity, period, period - last_seen as absent_streak, period - last_seen >= 2 as injured from seen""")
def w17(spark, d):
    e = A.table(spark, d, "events").select(F.col("user_id").alias("entity"), F.dayofmonth("ts").alias("period"))
    return T.absence_streaks(e, "entity", "period", e.agg(F.max("period")).scalar())


@query("w18_seed_unseen", sql("""
select player_id, season, week, coalesce(v, case when not coalesce(bool_or(v is not null) over (partition by player_id order by season, week rows between unbounded preceding and 1 preceding), false) then prior end) as value
from (select player_id, season, week, case when fp > 70 then fp end as v, target_share as prior from scored)""", "scored"))
def w18(spark, d):
    s = scored(spark, d).select(*KEYS, F.when(F.col("fp") > 70, F.col("fp")).alias("v"), F.col("target_share").alias("prior"))
    return s.select(*KEYS, T.seed_unseen("v", "prior", ["player_id"]).alias("value"))


SLOTS = L.Slots({"QB": 1, "RB": 2, "WR": 2, "TE": 1, "K": 1}, {"WRTE": 1, "FLEX": 1, "SUPERFLEX": 1})


def lineup_rows(spark, d):
    """Weekly rows grouped into lineups: one team per opponent code, projection = trailing mean."""
    return trail(spark, d).select(
        *KEYS, F.col("opponent_team").alias("team"), "position", F.col("player_id").cast("string").alias("player"),
        r6("fp_r3").alias("pred"), "fp")


cte("lineup_rows", f"select player_id, season, week, opponent_team as team, position, cast(player_id as varchar) as player, {q6('fp_r3')} as pred, fp from trail", ("trail",))
ORD = "partition by {p} order by coalesce(pred, -1) desc, player"
_G = "season, week, team"
cte("pass1", f"""
select *, case when prn <= case position when 'QB' then 1 when 'RB' then 2 when 'WR' then 2 when 'TE' then 1 when 'K' then 1 else 0 end then position end as s1 from (
  select *, row_number() over ({ORD.format(p=_G + ', position')}) as prn from lineup_rows)""", ("lineup_rows",))
for _i, (_c, _who) in enumerate((("WRTE", "'WR','TE'"), ("FLEX", "'RB','WR','TE'"), ("SUPERFLEX", "'QB','RB','WR','TE'")), 2):
    cte(f"pass{_i}", f"""
select * exclude (free, frn), coalesce(s{_i - 1}, case when free and frn <= 1 then '{_c}' end) as s{_i} from (
  select *, row_number() over (partition by {_G}, free order by coalesce(pred, -1) desc, player) as frn from (
    select *, s{_i - 1} is null and position in ({_who}) as free from pass{_i - 1}))""", (f"pass{_i - 1}",))


@query("w19_assign_slots", sql("select season, week, team, player_id, s4 as slot from pass4 where s4 is not null", "pass4"))
def w19(spark, d):
    return L.assign_slots(lineup_rows(spark, d), ["season", "week", "team"], "pred", "player", SLOTS).select(
        "season", "week", "team", "player_id", "slot")


@query("w21_locked_lineup", sql(f"""
select season, week, team, {q6('coalesce(sum(case when s4 is not null then fp end), 0.0)')} as score, {q6('sum(case when s4 is null then fp else 0.0 end)')} as bench,
  count(s4) as starters from pass4 group by all""", "pass4"))
def w21(spark, d):
    r = L.score_locked(lineup_rows(spark, d), ["season", "week", "team"], "pred", "fp", "player", SLOTS)
    return r.select("season", "week", "team", r6("score").alias("score"), r6("bench").alias("bench"), "starters")


GAIN_SLOTS = L.Slots({"QB": 1, "RB": 1, "WR": 1, "TE": 1}, {"FLEX": 1})


def _filled(source, keys):
    """SQL of the lineup of one slot per position and a flex, from a table of rows."""
    inner = f"select *, row_number() over (partition by {keys}, position order by coalesce(pred, -1) desc, player) as prn from {source}"
    free = f"select *, not (prn <= 1 and position in ('QB', 'RB', 'WR', 'TE')) and position in ('RB', 'WR', 'TE') as free, prn <= 1 and position in ('QB', 'RB', 'WR', 'TE') as pure from ({inner})"
    return f"select * from (select *, row_number() over (partition by {keys}, free order by coalesce(pred, -1) desc, player) as frn from ({free})) where pure or (free and frn <= 1)"


@query("w20_marginal_gain", sql(f"""
with known as (select * from lineup_rows where pred is not null), own as (select * from known where (player_id + week) % 3 <> 0),
agents as (select season, week, player, position, pred from known where (player_id + week) % 3 = 0),
tried as (select t.season, t.week, t.team, f.player as cand, f.player, f.position, f.pred from (select distinct season, week, team from own) t join agents f using (season, week)
  union all select o.season, o.week, o.team, f.player, o.player, o.position, o.pred from own o join agents f using (season, week)),
base as ({_filled('own', 'season, week, team')}), new as ({_filled('tried', 'season, week, team, cand')}),
sums as (select n.season, n.week, n.team, n.cand, sum(n.pred) as total, list(n.player) as now from new n group by all),
bases as (select season, week, team, sum(pred) as total, list(player) as started from base group by all),
gains as (select s.season, s.week, s.team, s.cand, round(s.total - coalesce(b.total, 0), 9) as g, list_min(list_filter(b.started, lambda x: not list_contains(s.now, x))) as replaces
  from sums s left join bases b using (season, week, team))
select season, week, team, cand as player, {q6('g')} as gain, replaces, place from (
  select *, cast(row_number() over (partition by season, week, team order by g desc, cand) as int) as place from gains where g > 1e-6) where place <= 5""", "lineup_rows"))
def w20(spark, d):
    rows = stored(lineup_rows(spark, d).where(F.col("pred").isNotNull()).drop("fp"), "lineups")
    owned = (F.col("player_id") + F.col("week")) % 3 != 0
    free = rows.where(~owned).select("season", "week", "player", "position", "pred")
    got = L.marginal_gain(rows.where(owned), free, ["team"], ["season", "week"], "pred", "player", GAIN_SLOTS, top=5)
    return got.withColumn("gain", r6("gain"))
