"""Aggregations (A1-A36)."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import expr as E
from ..operators import career as K
from ..operators import context as X
from ..operators import correlation as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import rollups as U
from .base import cte, even, q6, query, r6, sql
from .joins import depth_chart, line_tables, rho_sql, runs
from .projections import slate
from .windows import adp, mixed_residuals, residuals, scored, skilled, trail  # adp is shared with the board queries


def touches_of(weekly):
    """Carries and targets per entity and season."""
    return weekly.where(F.col("season_type") == "REG").groupBy("player_id", "season").agg(
        F.sum(F.coalesce("carries", F.lit(0.0)) + F.coalesce("targets", F.lit(0.0))).alias("touches"))


cte("rollup", """
select player_id, season, min(position) as position, min(player_display_name) as player, count(*) as games, sum(fp) as fp, sum(targets) as targets, sum(carries) as carries,
  sum(receptions) as receptions, sum(receiving_yards) as rec_yds, sum(rushing_yards) as rush_yds, sum(passing_yards) as pass_yds, sum(passing_tds) as pass_tds,
  sum(rushing_tds) as rush_tds, sum(receiving_tds) as rec_tds, avg(target_share) as tgt_share from skill group by player_id, season""", ("skill",))


@query("a1_season_rollup", sql(f"select * replace ({q6('fp')} as fp, {q6('tgt_share')} as tgt_share) from rollup", "rollup"))
def a1(spark, d):
    return U.season_rollup(skilled(spark, d)).withColumns({"fp": r6("fp"), "tgt_share": r6("tgt_share")})


@query("a2_points_allowed", sql(f"select opponent_team, position, season, week, {q6('sum(fp)')} as allowed from skill group by opponent_team, position, season, week", "skill"))
def a2(spark, d):
    return U.points_allowed(skilled(spark, d), ("season", "week")).withColumn("allowed", r6("allowed"))


@query("a3_league_ratio", sql(f"select opponent_team, position, season, {q6('allowed / greatest(avg(allowed) over (partition by season, position), 1.0)')} as difficulty from allowed", "allowed"))
def a3(spark, d):
    r = U.relative_to_league(U.points_allowed(skilled(spark, d)), "allowed", ["season", "position"], "difficulty")
    return r.select("opponent_team", "position", "season", r6("difficulty").alias("difficulty"))


@query("a4_modal_team", sql("select player_id, season, team from (select *, row_number() over (partition by player_id, season order by n_weeks desc, team) as rn from rosters) where rn = 1", "rosters"))
def a4(spark, d):
    return U.modal_value(A.rosters(spark, d), ["player_id", "season"], "team", "n_weeks")


@query("a5_last_home_coach", sql("""
select season, home_team as team, home_coach as coach from (
  select *, row_number() over (partition by season, home_team order by week desc, game_id desc) as rn from games where game_type = 'REG') where rn = 1""", "games"))
def a5(spark, d):
    return U.last_home_value(A.games(spark, d), "home_coach", "coach")


cte("plays", """
select cast(year(l_shipdate) as int) as season, cast(month(l_shipdate) as int) as week, case when l_returnflag = 'N' then 'run' else 'pass' end as play_type,
  l_quantity * 2 as yardline_100, l_discount - 0.05::double as epa, cast(l_partkey % 25 as int) as defteam, cast(l_returnflag <> 'N' as int) as pass, cast(l_returnflag = 'N' as int) as rush,
  cast(l_linenumber = 7 as int) as sack, cast(l_linenumber = 6 as int) as qb_hit, case when l_linenumber > 1 then l_suppkey end as receiver_player_id, l_suppkey as rusher_player_id, l_partkey % 100 as passer_player_id from lineitem""")


def plays(spark, d):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return A.table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), F.when(flag == "N", "run").otherwise("pass").alias("play_type"),
        (F.col("l_quantity") * 2).alias("yardline_100"), (F.col("l_discount") - 0.05).alias("epa"), (F.col("l_partkey") % 25).cast("int").alias("defteam"),
        (flag != "N").cast("int").alias("pass"), (flag == "N").cast("int").alias("rush"), (line == 7).cast("int").alias("sack"), (line == 6).cast("int").alias("qb_hit"),
        F.when(line > 1, F.col("l_suppkey")).alias("receiver_player_id"), F.col("l_suppkey").alias("rusher_player_id"), (F.col("l_partkey") % 100).alias("passer_player_id"))


@query("a6_redzone_counts", sql("""
select player_id, season, week, cast(r20 as bigint) as rz_targets, cast(r10 as bigint) as i10_targets, cast(u20 as bigint) as rz_carries, cast(u10 as bigint) as i10_carries, cast(p20 as bigint) as rz_pass_att from
 (select receiver_player_id as player_id, season, week, sum((yardline_100 <= 20)::int) as r20, sum((yardline_100 <= 10)::int) as r10 from plays where play_type = 'pass' and receiver_player_id is not null group by all) a
 full join (select rusher_player_id as player_id, season, week, sum((yardline_100 <= 20)::int) as u20, sum((yardline_100 <= 10)::int) as u10 from plays where play_type = 'run' group by all) b using (player_id, season, week)
 full join (select passer_player_id as player_id, season, week, sum((yardline_100 <= 20)::int) as p20 from plays where play_type = 'pass' group by all) c using (player_id, season, week)""", "plays"))
def a6(spark, d):
    return U.redzone_counts(plays(spark, d))


@query("a7_defence_quality", sql(f"""
select defteam as opponent_team, season, week, {q6('avg(case when pass = 1 then epa end)')} as def_pass_epa, {q6('avg(case when rush = 1 then epa end)')} as def_rush_epa,
  {q6('(sum(sack) + sum(qb_hit)) * 1.0::double / nullif(sum(pass), 0)')} as def_pressure from plays group by all""", "plays"))
def a7(spark, d):
    q = U.defence_quality(plays(spark, d))
    return q.select("opponent_team", "season", "week", *[r6(c).alias(c) for c in ("def_pass_epa", "def_rush_epa", "def_pressure")])


cte("volume", """
select player_id, season, position, case when position = 'RB' then sum(carries) + sum(targets) when position in ('WR', 'TE') then sum(targets) else sum(attempts) end as vol from weekly where season_type = 'REG' and position in ('QB', 'RB', 'WR', 'TE') group by player_id, season, position""", ("weekly",))


@query("a8_player_volume", sql("select * from volume", "volume"))
def a8(spark, d):
    return U.player_volume(A.weekly(spark, d))


cte("teams", "select distinct player_id, season, cast((recent_team + (season * player_id) % 3) % 25 as int) as team from weekly where player_id % 9 <> season % 9", ("weekly",))


def teams(spark, d):
    """One team per entity and season; some move between seasons, some are on no roster."""
    k, s = F.col("player_id"), F.col("season")
    return A.weekly(spark, d).where(k % 9 != s % 9).select(
        k, s, ((F.col("recent_team") + (s * k) % 3) % 25).cast("int").alias("team")).distinct()


cte("shares", """
select d.player_id, d.season + 1 as tseason, vol / greatest(room_vol, 1.0) as opp_share, coalesce(vac, 0.0) / greatest(pt, 1.0) as vac_share, greatest(room_vol - vol, 0.0) as comp_vol, room_vol, pt
from (select v.*, n.team, t.team as pteam from volume v left join teams n on n.player_id = v.player_id and n.season = v.season + 1 left join teams t on t.player_id = v.player_id and t.season = v.season
      where v.season + 1 in (select season from teams)) d
left join (select v.season, n.team, v.position, sum(vol) as room_vol from volume v join teams n on n.player_id = v.player_id and n.season = v.season + 1 group by all) r on r.season = d.season and r.team = d.team and r.position = d.position
left join (select v.season, t.team, v.position, sum(vol) as pt, sum(case when n.team is null or n.team <> t.team then vol else 0.0 end) as vac
           from volume v join teams t on t.player_id = v.player_id and t.season = v.season left join teams n on n.player_id = v.player_id and n.season = v.season + 1 group by all) o on o.season = d.season and o.team = d.team and o.position = d.position""", ("volume", "teams"))


@query("a9_room_shares", sql("""
select player_id, tseason, case when room_vol is not null then opp_share end as opp_share, case when pt is not null then vac_share end as vac_share, case when room_vol is not null then comp_vol end as comp_vol from shares""", "shares"))
def a9(spark, d):
    return U.room_shares(U.player_volume(A.weekly(spark, d)), teams(spark, d))


cte("turnover", """
select p.team, p.position, sum(case when n.team = p.team then 0.0 else p.fp end) as vacated_fp, sum(case when n.team = p.team then p.fp else 0.0 end) as returning_fp,
  arg_min(case when n.team = p.team then p.player end, case when n.team = p.team then row(-p.fp, p.player_id) end) as blocked_by, coalesce(max(case when n.team = p.team then p.fp end), 0.0) as blocked_by_fp
from (select r.player_id, r.position, r.player, r.fp, t.team from rollup r join teams t using (player_id, season) where r.season = 1999) p
left join (select player_id, team from teams where season = 2000) n using (player_id) group by all""", ("rollup", "teams"))


@query("a10_room_turnover", sql(f"select team, position, {q6('vacated_fp')} as vacated_fp, {q6('returning_fp')} as returning_fp, blocked_by, {q6('blocked_by_fp')} as blocked_by_fp from turnover", "turnover"))
def a10(spark, d):
    t = U.room_turnover(U.season_rollup(skilled(spark, d)), teams(spark, d), 2000)
    return t.select("team", "position", "blocked_by", *[r6(c).alias(c) for c in ("vacated_fp", "returning_fp", "blocked_by_fp")])


cte("pass_rates", f"select season, recent_team as team, {even('sum(attempts) / nullif(sum(attempts) + sum(carries), 0)', 3)} as pass_rate from weekly where season_type = 'REG' group by season, recent_team", ("weekly",))


@query("a11_pass_rate", sql("select * from pass_rates", "pass_rates"))
def a11(spark, d):
    return U.pass_rate(A.weekly(spark, d))


cte("shape", """
select player_id, season, sum(case when hi <= 3 then c end)::double / count(case when hi <= 3 then c end) / 100.0::double as ceiling,
  sum(case when lo <= 3 then c end)::double / count(case when lo <= 3 then c end) / 100.0::double as floor,
  case when sum(c) > 0 then count(case when 2 * c * n >= 3 * t then 1 end)::double / count(*) else 0.0 end as boom,
  sqrt((count(*) * sum(c * c) - sum(c) * sum(c))::double) / count(*) / 100.0::double as stdev from (
  select *, row_number() over (partition by player_id, season order by c desc, week) as hi, row_number() over (partition by player_id, season order by c, week) as lo,
    count(*) over (partition by player_id, season) as n, sum(c) over (partition by player_id, season) as t
  from (select *, cast(round(fp * 100) as bigint) as c from skill)) group by player_id, season""", ("skill",))


@query("a12_weekly_shape", sql(f"select player_id, season, {q6('ceiling')} as ceiling, {q6('floor')} as floor, {q6('boom')} as boom, {q6('stdev')} as stdev from shape", "shape"))
def a12(spark, d):
    s = K.weekly_shape(skilled(spark, d), decimals=2)
    return s.select("player_id", "season", *[r6(c).alias(c) for c in ("ceiling", "floor", "boom", "stdev")])


cte("faced", """
select s.player_id, s.season, coalesce(avg(r.diff), 1.0) as sched_faced, sum(s.fp) as p_fp from skill s left join rel r on r.def_team = s.opponent_team and r.position = s.position and r.season = s.season group by all""", ("skill", "rel"))


@query("a13_schedule_faced", sql(f"select player_id, season, {q6('sched_faced')} as sched_faced, {even('p_fp / greatest(sched_faced, 0.3)', 1)} as p_fp_adj from faced", "faced"))
def a13(spark, d):
    return U.schedule_faced(skilled(spark, d)).withColumn("sched_faced", r6("sched_faced"))


cte("aged", """
select s.*, lead(fp) over (partition by player_id order by season) as nfp, lead(season) over (partition by player_id order by season) = season + 1 as ok,
  season - 1965 - player_id % 12 as age, case position when 'RB' then 'RB' when 'QB' then 'QB' else 'WRTE' end as pg from seasons s""", ("seasons",))
AGE_BIN = "case when age < 24 then 0 when age < 26 then 1 when age < 28 then 2 when age < 30 then 3 else 4 end"


def aged(spark, d):
    s = K.next_season(A.seasons(spark, d), "fp").withColumn("age", F.col("season") - 1965 - (F.col("player_id") % 12))
    from ..plans.season import AGE_EDGES, age_group

    return s.withColumns({"pg": age_group("position"), "ab": E.bin_index("age", AGE_EDGES)})


@query("a14_age_calibration", sql(f"""
select b.player_id, {q6('b.proj * (1 + 0.35 * (least(greatest(coalesce(c.ratio, 1.0), 0.8), 1.25) - 1))')} as proj from (select *, fp as proj, {AGE_BIN} as ab from aged where season = 2000) b left join (
  select pg, {AGE_BIN} as ab, sum(nfp) / greatest(sum(fp), 1.0) as ratio from aged where ok and nfp >= 20 and season < 1999 group by all) c on c.pg = b.pg and c.ab = b.ab""", "aged"))
def a14(spark, d):
    a = aged(spark, d)
    train = a.where((F.col("next_fp") >= 20) & (F.col("season") < 1999))
    table = M.ratio_calibration(train, ["pg", "ab"], "next_fp", "fp")
    board = a.where(F.col("season") == 2000).withColumn("proj", F.col("fp"))
    out = M.apply_calibration(board, table, ["pg", "ab"], "proj", 0.35, (0.8, 1.25))
    return out.select("player_id", r6("proj").alias("proj"))


@query("a15_tier_calibration", sql(f"""
select tier, {q6('sum(coalesce(actual, 0.0)) / greatest(sum(proj), 1.0)')} as ratio from (
  select case when p.pick <= 40 then 0 when p.pick <= 120 then 1 else 2 end as tier, 700.0 - p.pick as proj, s.fp as actual
  from picks p left join seasons s on s.player_id = p.gsis_id and s.season = p.season and s.games > 1 where p.season >= (select min(season) from seasons) + 0 and p.season < 2000) group by all""", "picks", "seasons"))
def a15(spark, d):
    from ..plans.rookies import pick_tier

    s = A.seasons(spark, d)
    prior = A.draft_picks(spark, d).where(F.col("season") < 2000).select(
        F.col("gsis_id").alias("player_id"), "season", "pick", (700.0 - F.col("pick")).alias("proj"))
    actual = s.where(F.col("games") > 1).select("player_id", "season", F.col("fp").alias("actual"))
    t = M.tiered_calibration(prior, actual, ["player_id", "season"], pick_tier("pick"), s.agg(F.min("season")).scalar())
    return t.withColumn("ratio", r6("ratio"))


@query("a16_error_metrics", sql(f"""
select season, count(*) as n, {q6('avg(abs(pred - fp))')} as mae, {q6('sqrt(avg((pred - fp) * (pred - fp)))')} as rmse from resid group by season""", "resid"))
def a16(spark, d):
    m = M.error_metrics(residuals(spark, d), group=["season"])
    return m.select("season", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"))


cte("spear", """
select season, week, count(*) as n, case when max(pred) > min(pred) and max(fp) > min(fp) then corr(ra, rb) end as spearman from (
  select *, rank() over (partition by season, week order by pred) + (count(*) over (partition by season, week, pred) - 1) / 2.0 as ra,
    rank() over (partition by season, week order by fp) + (count(*) over (partition by season, week, fp) - 1) / 2.0 as rb from resid) group by all""", ("resid",))


@query("a17_weekly_spearman", sql(f"select season, week, n, {q6('spearman')} as spearman from spear", "spear"))
def a17(spark, d):
    return M.group_spearman(residuals(spark, d), ["season", "week"], "pred", "fp").withColumn("spearman", r6("spearman"))


@query("a17_mean_spearman", sql(f"select {q6('avg(spearman)')} as weekly_spearman from spear", "spear"))
def a17b(spark, d):
    return M.mean_spearman(residuals(spark, d), ["season", "week"], "pred", "fp").withColumn("weekly_spearman", r6("weekly_spearman"))


@query("a18_interval_coverage", sql(f"""
, pool as (select position, residual from resid where season = 1998),
b as (select position, quantile_cont(residual, 0.10) as a10, quantile_cont(residual, 0.25) as a25, quantile_cont(residual, 0.75) as a75, quantile_cont(residual, 0.90) as a90 from pool group by 1),
ev as (select e.*, fp - pred as need from resid e where season = 1999),
pit as (select e.player_id, e.week, e.position, avg(case when p.residual < e.need then 1.0::double else 0.0::double end) as pit from ev e join pool p using (position) group by all)
select position, count(*) as n, {q6('avg(case when fp >= pred + a10 and fp <= pred + a90 then 1.0::double else 0.0::double end)')} as cover80,
  {q6('avg(case when fp >= pred + a25 and fp <= pred + a75 then 1.0::double else 0.0::double end)')} as cover50, {q6('avg(pit)')} as mean_pit
from ev join b using (position) join pit using (player_id, week, position) group by all""", "resid").replace(")\n, pool", "),\npool"))
def a18(spark, d):
    r = residuals(spark, d)
    ev = r.where(F.col("season") == 1999)
    out = M.interval_coverage(ev, r.where(F.col("season") == 1998), ["position"])
    return out.select("position", "n", *[r6(c).alias(c) for c in ("cover80", "cover50", "mean_pit")])


@query("a19_error_correlation", sql(f"select season, {q6('corr(fp_r3 - fp, fp_r5 - fp)')} as error_corr from trail where fp_r3 is not null group by season", "trail"))
def a19(spark, d):
    return M.error_correlation(trail(spark, d).where(F.col("fp_r3").isNotNull()), "fp_r3", "fp_r5", group=["season"]).withColumn("error_corr", r6("error_corr"))


BOOT = """
, v as (select *, row_number() over (partition by fraction order by {order}) - 1 as i, count(*) over (partition by fraction) as n from {src}),
picks_b as (select v.fraction, b, (b * 7919 + v.i * 104729 + b * v.i * 31 + 11) % v.n as i from v, range(2000) as r(b)),
means as (select p.fraction, p.b, avg(v.x) as m from picks_b p join v on v.fraction = p.fraction and v.i = p.i group by all)
"""


@query("a20_bootstrap_mean", sql((BOOT.format(order="season, slot", src="(select *, place::double as x from runs)") + f"""
select fraction, (select count(*) from runs r where r.fraction = means.fraction) as n, {q6('(select avg(place) from runs r where r.fraction = means.fraction)')} as estimate,
  {q6('quantile_cont(m, 0.025)')} as low, {q6('quantile_cont(m, 0.975)')} as high from means group by fraction"""), "runs").replace(")\n, v as", "),\nv as"))
def a20(spark, d):
    b = M.bootstrap_mean(runs(spark, d), "place", ["season", "slot"], ["fraction"], 2000, draw=M.arithmetic_draw(11))
    return b.select("fraction", "n", *[r6(c).alias(c) for c in ("estimate", "low", "high")])


@query("a21_cluster_bootstrap", sql((BOOT.format(order="season", src="(select fraction, season, avg(place) as x from runs group by all)") + f"""
select fraction, (select count(*) from runs r where r.fraction = means.fraction) as n, (select count(distinct season) from runs r where r.fraction = means.fraction) as n_clusters,
  {q6('(select avg(x) from v where v.fraction = means.fraction)')} as estimate, {q6('quantile_cont(m, 0.025)')} as low, {q6('quantile_cont(m, 0.975)')} as high from means group by fraction"""), "runs").replace(")\n, v as", "),\nv as"))
def a21(spark, d):
    b = M.cluster_bootstrap_mean(runs(spark, d), "place", ["season"], ["fraction"], resamples=2000, draw=M.arithmetic_draw(11))
    return b.select("fraction", "n", "n_clusters", *[r6(c).alias(c) for c in ("estimate", "low", "high")])


BIG_LEAGUE = {**R.DEFAULT_LEAGUE, "flex": 2, "wrte": 1, "rbwr": 1, "superflex": 1}


@query("a22_score_board", sql(f"""
select player_id, vor, cast(round_even(1 + greatest(vor, 0) / t * 2220.0::double, 0) as int) as auction from vor_board, (select cast(sum(cast(greatest(vor, 0) * 10 as decimal(18,0))) as double) / 10 as t from vor_board)""", "vor_board"))
def a22(spark, d):
    return R.score_board(A.board(spark, d)).select("player_id", "vor", "auction")


@query("a23_replacement_ranks", """
with l as (select n_nationkey as league, 8 + n_nationkey % 7 as teams, 1 + n_nationkey % 2 as qb, 2 as rb, 2 + n_nationkey % 3 as wr, 1 as te, n_nationkey % 3 as flex, n_nationkey % 2 as superflex from nation),
b as (select *, teams * qb as q0, teams * rb as r0, teams * wr as w0, teams * te as t0 from l)
select league, cast(q0 + teams * superflex as int) as "QB", cast(r0 + round_even(teams * flex * r0 / (r0 + w0 + t0)::double, 0) as int) as "RB",
  cast(w0 + round_even(teams * flex * w0 / (r0 + w0 + t0)::double, 0) as int) as "WR", cast(t0 + round_even(teams * flex * t0 / (r0 + w0 + t0)::double, 0) as int) as "TE" from b""")
def a23(spark, d):
    k = F.col("n_nationkey")
    ranks = R.replacement_rank_columns(
        8 + k % 7, {"QB": 1 + k % 2, "RB": F.lit(2), "WR": 2 + k % 3, "TE": F.lit(1)}, k % 3, k % 2)
    return A.table(spark, d, "nation").select(k.alias("league"), *[c.cast("int").alias(p) for p, c in ranks.items()])


@query("a24_position_counts", sql("""
select team, count(*) filter (position = 'QB') as "QB", count(*) filter (position = 'RB') as "RB", count(*) filter (position = 'WR') as "WR", count(*) filter (position = 'TE') as "TE" from board group by team""", "board"))
def a24(spark, d):
    return M.position_counts(A.board(spark, d), ["team"], R.POSITIONS)


cte("team_scores", "select player_id as team, cast((season - 1995) * 12 + week - 1 as int) as period, cast(round_even(fp / 40, 0) as double) as score, targets as bench from scored", ("scored",))
cte("matches", "select period, team_a, team_b from slate where team_a < n and team_b < n", ("slate",))


def team_scores(spark, d):
    return scored(spark, d).select(
        F.col("player_id").alias("team"), ((F.col("season") - 1995) * 12 + F.col("week") - 1).cast("int").alias("period"),
        F.rint(F.col("fp") / 40).alias("score"), F.col("targets").alias("bench"))


def standings_sql(win: str) -> str:
    return f"""
select team, wins, pf, cast(row_number() over (order by wins desc, pf desc, team) as int) as place from (
  select t.team, coalesce(w.wins, 0.0) as wins, t.pf from (select team, sum(score) as pf from team_scores group by 1) t left join (
    select team, sum(win) as wins from (
      select period, unnest([team_a, team_b]) as team, unnest([w, 1.0::double - w]) as win from (
        select m.*, {win} as w from (select m.*, coalesce(a.score, 0.0) as sa, coalesce(b.score, 0.0) as sb, coalesce(a.bench, 0.0) as ba, coalesce(b.bench, 0.0) as bb
          from matches m left join team_scores a on a.period = m.period and a.team = m.team_a left join team_scores b on b.period = m.period and b.team = m.team_b) m)) group by 1) w using (team))"""


@query("a25_standings", sql(standings_sql("(case when sa > sb then 1.0 when sa < sb then 0.0 else 0.5 end)::double"), "matches", "team_scores"))
def a25(spark, d):
    return M.standings(slate(spark, d), team_scores(spark, d), "period")


@query("a26_standings_bench_tiebreak", sql(standings_sql("(case when sa > sb then 1.0 when sa < sb then 0.0 when ba > bb then 1.0 when ba < bb then 0.0 else 0.5 end)::double"), "matches", "team_scores"))
def a26(spark, d):
    return M.standings(slate(spark, d), team_scores(spark, d), "period", bench="bench")


@query("a27_sweep_summary", sql(f"""
select fraction, season, count(*) as n_slots, {q6('avg(place)')} as mean_finish, {q6('avg((place <= 6)::int)')} as playoff_rate, cast(sum(won::int) as bigint) as titles, {q6('avg(won::int)')} as title_rate
from runs group by rollup (fraction, season) having fraction is not null""", "runs"))
def a27(spark, d):
    s = M.sweep_summary(runs(spark, d))
    return s.withColumns({c: r6(c) for c in ("mean_finish", "playoff_rate", "title_rate")})


cte("sweep", """
select fraction, season, slot, unnest(['mean_finish', 'playoff_rate', 'title_rate']) as metric, unnest([place::double, (place <= 6)::int::double, won::int::double]) as value from runs""", ("runs",))
cte("sweep_all", """
select * from sweep union all select a.fraction, a.season, a.slot, a.metric || '_delta', a.value - b.value from sweep a join sweep b using (season, slot, metric) where a.fraction <> 0 and b.fraction = 0""", ("sweep",))


@query("a27_sweep_intervals", sql(f"""
select fraction, metric, any_value(n) as n, any_value(c) as n_clusters, {q6('any_value(e)')} as estimate, {q6('quantile_cont(m, 0.025)')} as low, {q6('quantile_cont(m, 0.975)')} as high from (
  with v as (select fraction, metric, season, avg(value) as x, count(*) as rows, row_number() over (partition by fraction, metric order by season) - 1 as i, count(*) over (partition by fraction, metric) as n
    from sweep_all group by fraction, metric, season),
  drawn as (select fraction, metric, n, b, (b * 7919 + i * 104729 + b * i * 31 + 11) % n as i from v, range(2000) as r(b)),
  means as (select d.fraction, d.metric, d.b, avg(v.x) as m from drawn d join v using (fraction, metric, i) group by all)
  select means.*, t.n, t.c, t.e from means join (select fraction, metric, cast(sum(rows) as bigint) as n, count(*) as c, avg(x) as e from v group by all) t using (fraction, metric)) group by fraction, metric""", "sweep_all"))
def a27b(spark, d):
    s = M.sweep_intervals(runs(spark, d), draw=M.arithmetic_draw(11))
    return s.select("fraction", "metric", "n", "n_clusters", *[r6(c).alias(c) for c in ("estimate", "low", "high")])


@query("a28_lift", sql(f"""
select season, {q6('o.t')} as title_rate, {q6('b.t')} as base_title_rate, {q6('o.p')} as playoff_rate, {q6('b.p')} as base_playoff_rate, {q6('o.f')} as mean_finish, {q6('b.f')} as base_mean_finish,
  {q6('o.t - b.t')} as title_lift, {q6('o.p - b.p')} as playoff_lift from (select season, avg(won::int) as t, avg((place <= 6)::int) as p, avg(place) as f from runs where fraction = 0.75 group by 1) o
join (select season, avg(won::int) as t, avg((place <= 6)::int) as p, avg(place) as f from runs where fraction = 0.0 group by 1) b using (season)""", "runs"))
def a28(spark, d):
    r = runs(spark, d).withColumn("label", F.when(F.col("fraction") == 0.75, "ours").when(F.col("fraction") == 0.0, "naive"))
    t = M.lift(r, "label", "ours", "naive", ["season"])
    return t.select("season", *[r6(c).alias(c) for c in t.columns if c != "season"])


cte("event_games", "select cast(year(ts) as int) as season, cast(dayofmonth(ts) as int) as week, cast(user_id % 25 as int) as home_team, cast((user_id + 11) % 25 as int) as away_team, case when dayofmonth(ts) <= 20 + (user_id % 25) % 11 then value end as home_score from events")
cte("finish", "select season, team, max(week) as finish from (select season, home_team as team, week from event_games where home_score is not null union all select season, away_team, week from event_games where home_score is not null) group by all", ("event_games",))
cte("report_finish", "select season, team, max(week) as finish from reports group by all", ("reports",))
INJURIES = """
select h.player_id, h.season, h.weeks_out, h.last_injury, h.last_week, h.last_round, coalesce(h.last_week >= coalesce(f.finish, (select max(finish) from finish f2 where f2.season = h.season)) - 1 and coalesce(h.last_injury <> 'Illness', true), false) as ended_hurt from (
  select player_id, season, count(distinct week) as weeks_out, arg_max(row(team, report_primary_injury, week, game_type), k) as l, l[2] as last_injury, l[3] as last_week, l[4] as last_round, l[1] as team from (
    select *, row_number() over (partition by player_id, season order by week, report_primary_injury nulls first, game_type, team) as k from reports
    where report_status in ('Out', 'Doubtful') and lower(coalesce(report_primary_injury, '')) not like '%not injury related%') group by player_id, season) h left join finish f on f.season = h.season and f.team = h.team"""
cte("injuries", INJURIES, ("reports", "finish"))


def event_games(spark, d):
    u = F.col("user_id")
    return A.table(spark, d, "events").select(
        F.year("ts").alias("season"), F.dayofmonth("ts").alias("week"), (u % 25).cast("int").alias("home_team"), ((u + 11) % 25).cast("int").alias("away_team"),
        F.when(F.dayofmonth("ts") <= 20 + (u % 25) % 11, F.col("value")).alias("home_score"))


def injuries(spark, d):
    return X.injury_seasons(A.reports(spark, d), X.team_finish(event_games(spark, d)))


@query("a29_injury_seasons", sql("select * from injuries", "injuries"))
def a29(spark, d):
    return injuries(spark, d)


@query("a29_report_finish", sql(INJURIES.replace("finish f", "report_finish f"), "reports", "report_finish"))
def a29c(spark, d):
    reports = A.reports(spark, d)
    return X.injury_seasons(reports, X.report_finish(reports))


cte("statuses", "select player_id, season, week, case cast(receptions + player_id as int) % 6 when 0 then 'RES' when 1 then 'PUP' when 2 then 'CUT' else 'ACT' end as status from weekly", ("weekly",))
cte("status_now", "select player_id, case status when 'RES' then 'on injured reserve' when 'PUP' then 'on PUP' else 'released' end as status from (select *, row_number() over (partition by player_id order by week desc, status) as rn from statuses where season = 2000) where rn = 1 and status <> 'ACT'", ("statuses",))
cte("live_s", "select s_suppkey + 10 as player_id, case s_suppkey % 3 when 0 then 'IR' when 1 then 'Questionable' else 'Sus' end as live_code, 'body' || cast(s_suppkey as varchar) as live_body from supplier where s_suppkey % 4 = 1")
cte("avail", """
select player_id, weeks_out, last_injury, last_week, last_round, coalesce(ended_hurt, false) as ended_hurt, status, live_code, live_body, cast(null as varchar) as live_note, cast(null as varchar) as news_date
from (select * exclude (season) from injuries) i full join status_now using (player_id) full join live_s using (player_id)""", ("injuries", "status_now", "live_s"))


def statuses(spark, d):
    m = (F.col("receptions") + F.col("player_id")).cast("int") % 6
    return A.weekly(spark, d).select("player_id", "season", "week", F.when(m == 0, "RES").when(m == 1, "PUP").when(m == 2, "CUT").otherwise("ACT").alias("status"))


def avail(spark, d):
    k = F.col("s_suppkey")
    live = A.table(spark, d, "supplier").where(k % 4 == 1).select(
        (k + 10).alias("player_id"), F.when(k % 3 == 0, "IR").when(k % 3 == 1, "Questionable").otherwise("Sus").alias("live_code"),
        F.concat(F.lit("body"), k.cast("string")).alias("live_body"))
    return X.availability(injuries(spark, d).drop("season"), X.roster_status(statuses(spark, d), 2000), live)


@query("a29_availability", sql("select * from avail", "avail"))
def a29b(spark, d):
    return avail(spark, d)


SUP_LETTERS = "replace(translate({0}, '0123456789', 'abcdefghij'), '#', ' ')"
cte("sup_adp", f"select {SUP_LETTERS.format('s_name')} as player, cast(1 + (s_suppkey * 37) % 90 as varchar) as adp from supplier where s_suppkey % 3 <> 0")
cte("named_rollup", f"select * replace ({SUP_LETTERS.format('player')} as player) from rollup", ("rollup",))
cte("proom", """
select n.player_id, n.team, l.player, l.position, l.fp as score, try_cast(a.adp as double) as adp from (select player_id, team from teams where season = 2000) n
join (select * from named_rollup where season = 1999) l using (player_id) left join sup_adp a on a.player = l.player""", ("teams", "named_rollup", "sup_adp"))
cte("coaches", "select season, home_team as team, home_coach as coach from (select *, row_number() over (partition by season, home_team order by week desc, game_id desc) as rn from games where game_type = 'REG') where rn = 1", ("games",))


@query("a30_player_context", sql(f"""
, top as (select team, position, player as tp, score as ts from (select *, row_number() over (partition by team, position order by coalesce(adp, 1e9), score desc, player) as rn from proom) where rn = 1),
p2 as (select l.player_id, l.position, l.fp, t.team as pteam, n.team from (select * from rollup where season = 1999) l join (select * from teams where season = 1999) t using (player_id) left join (select * from teams where season = 2000) n using (player_id)),
vac as (select pteam as team, position, sum(fp) as v from p2 where team is null or team <> pteam group by all),
dep as (select player_id, min(try_cast(depth_team as double)) as depth_rank from depth where season = 2000 and try_cast(depth_team as double) is not null group by 1)
select r.player_id, r.team, t.team as prior_team, coalesce(t.team <> r.team, false) as moved, case when r.player <> tp then tp end as blocked_by,
  {even('case when r.player = tp then 0.0::double else ts end', 1)} as blocked_by_fp, {even('coalesce(v, 0.0)', 1)} as vacated_fp, dep.depth_rank, pr.pass_rate,
  coalesce(c1.coach <> c0.coach, false) as new_coach, a.* exclude (player_id, ended_hurt), coalesce(a.ended_hurt, false) as ended_hurt,
  case when r.position = 'RB' then coalesce(l.ol_out, 0) else 0 end as ol_out, case when r.position = 'RB' then l.ol_names end as ol_names
from proom r join top using (team, position) left join vac using (team, position) left join (select player_id, team from teams where season = 1999) t on t.player_id = r.player_id
left join dep on dep.player_id = r.player_id left join pass_rates pr on pr.season = 1999 and pr.team = r.team
left join coaches c1 on c1.season = 2000 and c1.team = r.team left join coaches c0 on c0.season = 1999 and c0.team = r.team
left join avail a on a.player_id = r.player_id left join nation_line_ctx l on l.team = r.team""",
    "proom", "rollup", "teams", "depth", "pass_rates", "coaches", "avail", "nation_line_ctx").replace(")\n, top", "),\ntop"))
def a30(spark, d):
    s, w = skilled(spark, d), A.weekly(spark, d)
    agg = U.season_rollup(s).withColumn("player", A.letter_name(F.col("player")))
    k = F.col("s_suppkey")
    market = A.table(spark, d, "supplier").where(k % 3 != 0).select(A.letter_name(F.col("s_name")).alias("player"), (1 + (k * 37) % 90).cast("string").alias("adp"))
    depth = J.best_match(depth_chart(spark, d).where(F.col("season") == 2000), "player_id", "depth_team").withColumnRenamed("depth_team", "depth_rank")
    chart, line_avail, names = line_tables(spark, d, nations=True)
    line = X.line_context(X.line_starters(chart), line_avail, names)
    return X.player_context(agg, teams(spark, d), market, depth, w, A.games(spark, d), avail(spark, d), line, 2000)


cte("steps", """
select position, age + 1 as age, avg(ratio) as step from (
  select position, season - 1965 - player_id % 12 as age, case when lead(season) over w = season + 1 then least(greatest((lead(ppg) over w) / greatest(ppg, 1.0), 0.4), 1.8) end as ratio
  from (select *, fp / greatest(games, 1) as ppg from seasons where season < 2001 and games >= 3) window w as (partition by player_id order by season))
where ratio is not null and age between 21 and 36 group by all having count(*) >= 8""", ("seasons",))
cte("curve_rel", """
select p.position, g.age, exp(sum(ln(case when g.age = 21 then 1.0 else coalesce(s.step, 1.0) end)) over (partition by p.position order by g.age)) as rel
from (values ('QB'), ('RB'), ('WR'), ('TE')) as p(position) cross join (select cast(unnest(range(21, 37)) as int) as age) g left join steps s on s.position = p.position and s.age = g.age""", ("steps",))
cte("age_curves", "select position, age, rel / max(rel) over (partition by position) as curve from curve_rel", ("curve_rel",))


def age_curves(spark, d):
    s = A.seasons(spark, d)
    births = s.select("player_id", "season", (1965 + F.col("player_id") % 12).cast("int").alias("birth_year"))
    return K.age_curves(s, births, 2001, R.POSITIONS, min_games=3)


@query("a31_age_curves", sql(f"select position, age, {q6('curve')} as curve from age_curves", "age_curves"))
def a31(spark, d):
    return age_curves(spark, d).withColumn("curve", r6("curve"))


@query("a32_multi_year_value", sql(f"""
select v.player_id, v.age, {even("sum(greatest(vor, 0.0) * (coalesce(a.curve, 0.0) / coalesce(b.curve, 1.0)) * power(0.85::double, t))", 1)} as dynasty_value from (
  select v.*, coalesce(case when player_id % 10 <> 0 then cast(2001 - 1965 - player_id % 12 as int) end, 27) as age from vor_board v) v, range(4) as r(t)
left join age_curves a on a.position = v.position and a.age = v.age + t left join age_curves b on b.position = v.position and b.age = least(greatest(v.age, 21), 36) group by v.player_id, v.age""", "vor_board", "age_curves"))
def a32(spark, d):
    b = R.score_board(A.board(spark, d)).withColumn(
        "age", F.when(F.col("player_id") % 10 != 0, (2001 - 1965 - F.col("player_id") % 12).cast("int")))
    return R.multi_year_value(b, age_curves(spark, d)).select("player_id", "age", "dynasty_value")


cte("ranked_board", """
select *, cast(row_number() over (order by vor desc, player_id) as int) as overall_rank, cast(row_number() over (partition by position order by vor desc, player_id) as int) as position_rank from (
  select v.*, cast(round_even(1 + greatest(vor, 0) / t * 2220.0::double, 0) as int) as auction from vor_board v, (select cast(sum(cast(greatest(vor, 0) * 10 as decimal(18,0))) as double) / 10 as t from vor_board))""", ("vor_board",))


def ranked_board(spark, d):
    return R.board_ranks(R.score_board(A.board(spark, d)))


@query("a33_keeper_surplus", sql("""
select k.team, k.player, k.position, k.auction as value, cast(round_even(c, 0) as int) as cost, cast(round_even(k.auction - c, 0) as int) as surplus from (
  select r.*, case when player_id % 2 = 0 then (1 + player_id % 30)::double else coalesce(p.price, 1.0)::double end as c from ranked_board r
  left join (select overall_rank - 1 as at, auction as price from ranked_board) p on p.at = greatest(0, ((1 + r.player_id % 30) - 1) * 12)) k""", "ranked_board"))
def a33(spark, d):
    r = ranked_board(spark, d)
    keepers = r.select("team", "player", (1 + F.col("player_id") % 30).alias("cost"),
                       F.when(F.col("player_id") % 2 == 0, "auction").otherwise("round").alias("cost_type"))
    return R.keeper_surplus(r, keepers).select("team", "player", "position", "value", "cost", "surplus")


@query("a34_trade_totals", sql(f"""
select trade_id, auction_a, auction_b, vor_a, vor_b, auction_a - auction_b as diff,
  case when abs(auction_a - auction_b) <= 5 then 'roughly even' when auction_a > auction_b then 'Side A wins by $' || (auction_a - auction_b) else 'Side B wins by $' || (auction_b - auction_a) end as verdict from (
  select player_id % 50 as trade_id, cast(sum(case when player_id // 50 % 2 = 0 then auction else 0 end) as bigint) as auction_a, cast(sum(case when player_id // 50 % 2 = 1 then auction else 0 end) as bigint) as auction_b,
    {even("sum(case when player_id // 50 % 2 = 0 then vor else 0.0 end)", 1)} as vor_a, {even("sum(case when player_id // 50 % 2 = 1 then vor else 0.0 end)", 1)} as vor_b from ranked_board group by 1)""", "ranked_board"))
def a34(spark, d):
    b = R.score_board(A.board(spark, d))
    k = F.col("player_id")
    sides = b.select((k % 50).alias("trade_id"), F.when(F.floor(k / 50) % 2 == 0, "a").otherwise("b").alias("side"), F.upper("player").alias("player"))
    return R.trade_totals(b, sides)


@query("a35_compare", sql("""
select player_id % 40 as comparison, player_id, player, position, vor, auction, overall_rank, position_rank, row_number() over (partition by player_id % 40 order by vor desc, overall_rank) = 1 as best_value from ranked_board""", "ranked_board"))
def a35(spark, d):
    r = ranked_board(spark, d)
    asked = r.select((F.col("player_id") % 40).alias("comparison"), F.upper("player").alias("player"))
    return R.compare(r, asked, "comparison")


PAIR = {
    "qb_pc": ("a.position = 'QB' and b.position in ('WR', 'TE')", "<>"), "pc_pc": ("a.position in ('WR', 'TE') and b.position in ('WR', 'TE')", "<"),
    "rb_pc": ("a.position = 'RB' and b.position in ('WR', 'TE')", "<>"), "qb_rb": ("a.position = 'QB' and b.position = 'RB'", "<>"),
}
OPP = {"opp_qb_pc": "a.position = 'QB' and b.position in ('WR', 'TE')", "opp_pc_pc": "a.position in ('WR', 'TE') and b.position in ('WR', 'TE')"}


@query("a36_correlation_map", sql(" union all ".join(
    [f"select '{n}' as relation, * from ({rho_sql('', '')} from (select a.residual as x, b.residual as y from mixed a join mixed b using (season, week, recent_team) where {c} and a.player_id {op} b.player_id))" for n, (c, op) in PAIR.items()]
    + [f"select '{n}', * from ({rho_sql('', '')} from (select a.residual as x, b.residual as y from mixed a join mixed b on a.season = b.season and a.week = b.week and a.recent_team = b.opponent_team and a.opponent_team = b.recent_team where {c}))" for n, c in OPP.items()]), "mixed"))
def a36(spark, d):
    m = C.estimate_relations(mixed_residuals(spark, d))
    return m.select("relation", "n_pairs", r6("rho", 4).alias("rho"))
