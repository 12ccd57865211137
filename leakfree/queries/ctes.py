"""SQL texts of the adapters, written for the oracle engine."""

from .base import cte

POSITION_CASE = (
    "case r_name when 'AFRICA' then 'QB' when 'AMERICA' then 'RB' when 'ASIA' then 'WR' "
    "when 'EUROPE' then 'TE' when 'MIDDLE EAST' then 'K' end"
)
SEGMENT_CASE = (
    "case c_mktsegment when 'AUTOMOBILE' then 'QB' when 'BUILDING' then 'RB' when 'FURNITURE' then 'WR' "
    "when 'HOUSEHOLD' then 'TE' when 'MACHINERY' then 'WR' end"
)


def _n(cond: str) -> str:
    return f"sum(case when {cond} then 1.0::double else 0.0::double end)"


def _y(cond: str) -> str:
    return f"sum(case when {cond} then l_quantity else 0.0::double end)"


cte("supp", f"""
select s_suppkey, s_name, s_nationkey, n_name, r_name, {POSITION_CASE} as position
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")

cte("weekly", f"""
select cast(l_suppkey as bigint) as player_id, min(s_name) as player_display_name, min(position) as position,
       cast(year(l_shipdate) as int) as season, cast(month(l_shipdate) as int) as week,
       case when month(l_shipdate) <= 11 then 'REG' else 'POST' end as season_type,
       cast(min(s_nationkey) as int) as recent_team, cast(sum(l_orderkey) % 25 as int) as opponent_team,
       {_y("l_returnflag = 'A'")} as passing_yards, {_n("l_returnflag = 'A'")} as passing_tds,
       {_n("l_linenumber = 1")} as interceptions, {_y("l_returnflag = 'N'")} as rushing_yards,
       {_n("l_returnflag = 'N' and l_linenumber <= 2")} as rushing_tds, cast(count(*) as double) as receptions,
       {_y("l_returnflag = 'R'")} as receiving_yards, {_n("l_returnflag = 'R'")} as receiving_tds,
       {_n("l_linenumber = 7")} as rushing_fumbles_lost,
       cast(count(*) + {_n("l_linenumber = 2")} as double) as targets,
       {_n("l_returnflag = 'N'")} as carries, {_n("l_returnflag = 'A'")} as attempts,
       {_n("l_returnflag = 'R'")} / count(*) as target_share,
       cast(sum(case when l_returnflag = 'R' then cast(l_discount as decimal(18,2)) end) as double) as receiving_epa,
       {_n("l_linenumber <= 2")} as fg_made_0_19, {_n("l_linenumber = 3")} as fg_made_40_49,
       {_n("l_linenumber = 4")} as fg_made_50_59, {_n("l_linenumber = 5")} as pat_made,
       {_n("l_linenumber = 6")} as fg_missed
from lineitem join supp on l_suppkey = s_suppkey
group by l_suppkey, year(l_shipdate), month(l_shipdate)""", ("supp",))

cte("seasons", f"""
select cast(o_custkey as bigint) as player_id, cast(year(o_orderdate) as int) as season,
       min({SEGMENT_CASE}) as position, min(c_name) as player, count(*) as games,
       cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 1000 as fp, cast(min(c_nationkey) as int) as team,
       {_n("o_orderstatus = 'F'")} as carries, {_n("o_orderstatus = 'O'")} as targets,
       {_n("o_orderpriority = '1-URGENT'")} / count(*) as tgt_share
from orders join customer on o_custkey = c_custkey
group by o_custkey, year(o_orderdate)""")

cte("gbase", """
select cast(year(l_shipdate) as int) as season, cast(month(l_shipdate) as int) as week,
       cast(s_nationkey as int) as home_team, cast(c_nationkey as int) as away_team,
       sum(case when l_returnflag <> 'R' then l_quantity else 0 end) as home_score,
       sum(case when l_returnflag = 'R' then l_quantity else 0 end) as away_score,
       cast(sum(l_linenumber) % 15 as double) as sp, cast(sum(l_orderkey) % 40 as double) as tl,
       cast(sum(l_suppkey) % 40 as double) as ov, cast(sum(l_partkey) % 40 as double) as un,
       cast(sum(l_linenumber) as bigint) as ln
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
     join supplier on l_suppkey = s_suppkey
where s_nationkey <> c_nationkey
group by year(l_shipdate), month(l_shipdate), s_nationkey, c_nationkey""")

cte("games", """
select concat_ws('_', season, week, home_team, away_team) as game_id, season, week,
       case when week <= 11 then 'REG' else 'CON' end as game_type, home_team, away_team, home_score, away_score,
       home_score - away_score as result, home_score + away_score as total,
       case when ln % 11 <> 0 then sp - 7.0 end as spread_line, tl + 20.0 as total_line,
       -100.0 - ov as over_odds, -100.0 - un as under_odds, -100.0 - un as home_spread_odds,
       -100.0 - ov as away_spread_odds, -110.0 - ov as home_moneyline, 110.0 + un as away_moneyline,
       cast(ln % 7 + 4 as double) as home_rest, cast(ln % 5 + 4 as double) as away_rest,
       cast(ln % 3 = 0 as int) as div_game,
       case ln % 4 when 0 then 'dome' when 1 then 'closed' else 'outdoors' end as roof,
       case when ln % 10 = 0 then 'Neutral' else 'Home' end as location,
       case when ln % 6 <> 5 then sp + 2.0 end as wind, tl + 30.0 as temp,
       'Coach ' || cast((home_team + season * week) % 3 as varchar) as home_coach
from gbase""", ("gbase",))

cte("reports", """
select user_id as player_id, cast(year(ts) as int) as season, cast(dayofmonth(ts) as int) as week,
       cast(user_id % 25 as int) as team,
       case when dayofmonth(ts) <= 24 then 'REG' when dayofmonth(ts) <= 26 then 'WC'
            when dayofmonth(ts) <= 28 then 'CON' else 'SB' end as game_type,
       case event_type when 'error' then 'Out' when 'view' then 'Questionable' when 'signup' then 'Doubtful' end as report_status,
       case event_type when 'click' then 'Limited Participation' when 'purchase' then 'Did Not Participate' else 'Full' end as practice_status,
       case event_id % 7 when 0 then 'Illness' when 1 then 'Not Injury Related - personal' when 2 then 'Knee' when 3 then 'Ankle' end as report_primary_injury,
       value, event_id, ts
from events""")

cte("rosters", """
select cast(l_suppkey as bigint) as player_id, cast(year(l_shipdate) as int) as season, p_brand as team, count(*) as n_weeks
from lineitem join part on l_partkey = p_partkey
group by l_suppkey, year(l_shipdate), p_brand""")

cte("prop_lines", """
select cast(s_suppkey as bigint) as player_id, s_name as player, r_name as market, position,
       cast((s_suppkey % 50) * 4 + 20 as double) + 0.5 as line,
       cast(case when s_suppkey % 3 = 0 then 105 + s_suppkey % 20 else -105 - s_suppkey % 20 end as double) as over_odds,
       cast(case when s_suppkey % 3 = 0 then -125 - s_suppkey % 20 else -110 end as double) as under_odds
from supp""", ("supp",))

cte("name_variants", """
select c_custkey as player_id, c_name as name_a,
       case c_custkey % 4 when 0 then upper(c_name) when 1 then concat(c_name, ' Jr.')
            when 2 then concat('  ', c_name, ' III') else replace(c_name, '#', ' # ') end as name_b
from customer""")

cte("picks", f"""
select f.season, cast(c_custkey as bigint) as gsis_id, cast((c_custkey * 7) % 257 + 1 as int) as pick,
       cast(floor(((c_custkey * 7) % 257) / 32 + 1) as int) as round, {SEGMENT_CASE} as position,
       c_name as pfr_player_name, case c_custkey % 5 when 0 then 'GNB' when 1 then 'KAN' when 2 then 'SFO' when 3 then 'DAL' else 'TAM' end as team
from (select o_custkey, cast(min(year(o_orderdate)) as int) as season from orders group by o_custkey) f
     join customer on f.o_custkey = c_custkey""")

cte("board", """
select player_id, replace(translate(player, '0123456789', 'abcdefghij'), '#', ' ') as player, position, team,
       round_even(fp, 1) as proj
from seasons where season = (select max(season) from seasons)""", ("seasons",))
