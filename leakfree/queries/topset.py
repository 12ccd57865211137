"""Sorts, limits, top-k (T1-T5) and set operations (U1-U4)."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import ranking as R
from ..plans import board as B
from .base import query, sql
from .joins import roster_names
from .projections import word_key_sql
from .windows import scored


@query("t1_global_sort", sql("select season, week, player_id, fp from scored order by season, week, player_id", "scored"))
def t1(spark, d):
    return scored(spark, d).select("season", "week", "player_id", "fp").orderBy("season", "week", "player_id")


@query("t2_best_available", sql(f"""
select player_id, player, position, vor from vor_board where position = 'WR' and {word_key_sql('player')} not in (select {word_key_sql('player')} from board where player_id % 3 = 0)
order by vor desc, player_id limit 15""", "vor_board"))
def t2(spark, d):
    b = R.score_board(A.board(spark, d))
    taken = b.where(F.col("player_id") % 3 == 0).select("player")
    return R.best_available(b, taken, "WR", 15).select("player_id", "player", "position", "vor")


@query("t3_top_k_by_table", sql("""
select player_id, position, proj from (select *, row_number() over (partition by position order by proj desc, player_id) as rn from board)
where rn <= case position when 'QB' then 15 when 'RB' then 32 when 'WR' then 40 when 'TE' then 15 end""", "board"))
def t3(spark, d):
    from ..plans.season import ADP_STARTERS, ADP_STARTERS_OTHER

    t = R.top_k_by_table(A.board(spark, d), "position", [F.col("proj").desc(), F.col("player_id").asc()], ADP_STARTERS, ADP_STARTERS_OTHER)
    return t.select("player_id", "position", "proj")


@query("t4_shortlist", sql("""
select team, position, player_id, proj from (select *, row_number() over (partition by team, position order by proj desc, player_id) as rn from board) where rn <= 6""", "board"))
def t4(spark, d):
    return R.shortlist(A.board(spark, d), ["team", "position"], "proj", "player_id").select("team", "position", "player_id", "proj")


@query("t5_latest_row", sql("""
select player_id, season, position, player, games, fp from (select *, row_number() over (partition by player_id order by season desc) as rn from seasons) where rn = 1""", "seasons"))
def t5(spark, d):
    s = A.seasons(spark, d).select("player_id", "season", "position", "player", "games", "fp")
    return R.latest_per_entity(s, "player_id", [F.col("season")])


@query("u1_union_all", sql("""
select cast(home_team as varchar) as team, season, week, home_score as points from games union all
select cast(away_team as varchar), season, week, away_score from games union all select player_display_name, season, week, fp from scored""", "games", "scored"))
def u1(spark, d):
    from ..operators.reshape import scores_by_team

    t = scores_by_team(A.games(spark, d)).select(F.col("team").cast("string").alias("team"), "season", "week", F.col("pf").alias("points"))
    return t.unionByName(scored(spark, d).select(F.col("player_display_name").alias("team"), "season", "week", F.col("fp").alias("points")))


@query("u2_keep_first", sql("""
select player_id, player, position, proj from (select *, row_number() over (partition by player_id order by p, -proj, player) as rn from (
  select player_id, player, position, proj, 0 as p from board where player_id % 2 = 0
  union all select gsis_id, pfr_player_name, position, 300.0 - pick, 1 from picks)) where rn = 1""", "board", "picks"))
def u2(spark, d):
    entrants = A.draft_picks(spark, d).select(
        F.col("gsis_id").alias("player_id"), F.col("pfr_player_name").alias("player"), "position", (300.0 - F.col("pick")).alias("proj"))
    return B.combine(A.board(spark, d).where(F.col("player_id") % 2 == 0), entrants)


@query("u3_distinct", sql("select distinct season, position, opponent_team from weekly", "weekly"))
def u3(spark, d):
    return A.weekly(spark, d).select("season", "position", "opponent_team").distinct()


@query("u4_unrostered", sql(f"""
select player_id, player, {word_key_sql('player')} not in (select {word_key_sql('full_name')} from roster_names where player_id % 4 <> 0) as no_team from board""", "board", "roster_names"))
def u4(spark, d):
    names = roster_names(spark, d).where(F.col("player_id").cast("bigint") % 4 != 0)
    return B.flag_unrostered(A.board(spark, d), names).select("player_id", "player", "no_team")
