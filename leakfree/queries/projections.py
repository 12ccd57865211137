"""Projections, filters and predicates (P1-P30)."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import expr as E
from ..functions import names as N
from ..functions import odds as O
from ..functions import scoring as S
from ..operators import correlation as C
from ..operators import reports as R
from ..operators import reshape as G
from . import ctes  # noqa: F401  (registers the adapter texts)
from .base import cte, even, query, sql

KEYS = ["player_id", "season", "week"]


def ppr_sql(reception: str = "1.0", te: str | None = None, bonuses: bool = False) -> str:
    """Oracle text of the scoring expression over the weekly columns."""
    def d(x):
        return f"{x}::double"
    text = (
        f"coalesce(passing_yards,0)*{d('0.04')} + coalesce(passing_tds,0)*{d('4.0')} + coalesce(interceptions,0)*{d('-2.0')}"
        f" + coalesce(rushing_yards,0)*{d('0.1')} + coalesce(rushing_tds,0)*{d('6.0')} + coalesce(receptions,0)*{d(reception)}"
        f" + coalesce(receiving_yards,0)*{d('0.1')} + coalesce(receiving_tds,0)*{d('6.0')}"
        f" + coalesce(rushing_fumbles_lost,0)*{d('-2.0')}"
    )
    if te:
        text += f" + case when position = 'TE' then receptions*{d(te)} else 0 end"
    if bonuses:
        text += (
            " + case when rushing_yards >= 100 then 3.0::double else 0 end"
            " + case when receiving_yards >= 100 then 2.0::double else 0 end"
            " + case when passing_yards >= 300 then 1.0::double else 0 end"
        )
    return even(text, 2)


cte("scored", f"select *, {ppr_sql()} as fp from weekly", ("weekly",))
cte("skill", "select * from scored where season_type = 'REG' and position in ('QB', 'RB', 'WR', 'TE')", ("scored",))

CUSTOM = S.resolve_rules(custom={
    "te_reception_bonus": 0.5, "bonus_rush_100": 3, "bonus_rec_100": 2, "bonus_pass_300": 1, "not_a_rule": 9,
})


@query("p1_scoring", sql(
    f"select player_id, season, week, {ppr_sql()} as fp, {ppr_sql(te='0.5', bonuses=True)} as fp_custom from weekly", "weekly"))
def p1(spark, d):
    w = A.weekly(spark, d)
    return w.select(*KEYS, S.skill_points(w).alias("fp"), S.skill_points(w, CUSTOM).alias("fp_custom"))


@query("p2_many_rule_sets", sql(" union all ".join(
    f"select player_id, season, week, '{n}' as rules, {x} as fp from weekly"
    for n, x in (("ppr", ppr_sql()), ("half", ppr_sql("0.5")), ("standard", ppr_sql("0.0")), ("custom", ppr_sql(te="0.5", bonuses=True)))
), "weekly"))
def p2(spark, d):
    sets = {n: S.resolve_rules(n) for n in S.PRESET_CHANGES} | {S.rules_label(CUSTOM): CUSTOM}
    return S.with_points_per_rule_set(A.weekly(spark, d), sets).select(*KEYS, "rules", "fp")


@query("p3_kicker_scoring", sql(f"""
select player_id, season, week,
  {even("fg_made_0_19*3.0::double + fg_made_40_49*4.0::double + fg_made_50_59*5.0::double + pat_made*1.0::double + fg_missed*-1.0::double", 2)} as fp,
  {even("(fg_made_0_19 + fg_made_40_49)*3.0::double + pat_made*1.0::double", 2)} as fp_flat
from weekly where position = 'K'""", "weekly"))
def p3(spark, d):
    k = A.weekly(spark, d).where(F.col("position") == "K")
    ladder = k.withColumn("fp", S.kicker_points(k, S.resolve_rules(custom={"fg_miss": -1})))
    flat = ladder.withColumn("fg_made", F.col("fg_made_0_19") + F.col("fg_made_40_49"))
    bare = flat.select(*KEYS, "fp", "fg_made", "pat_made")
    return bare.select(*KEYS, "fp", S.kicker_points(bare).alias("fp_flat"))


PA_CASE = ("case when pa <= 0 then 10.0 when pa <= 6 then 7.0 when pa <= 13 then 4.0 when pa <= 20 then 1.0 "
           "when pa <= 27 then 0.0 when pa <= 34 then -1.0 else -4.0 end")


@query("p4_defence_scoring", sql(f"""
select game_id, team, points_allowed, {even(f"sacks*1.0::double + ints*2.0::double + ({PA_CASE})::double", 2)} as fp from (
  select game_id, home_team as team, away_score as points_allowed, coalesce(away_score, 0) as pa, home_rest as sacks, div_game as ints from games
  union all
  select game_id, away_team, home_score, coalesce(home_score, 0), away_rest, div_game from games)""", "games"))
def p4(spark, d):
    t = G.team_rows(
        A.games(spark, d),
        {"team": "home_team", "points_allowed": "away_score", "def_sacks": "home_rest", "def_interceptions": "div_game"},
        {"team": "away_team", "points_allowed": "home_score", "def_sacks": "away_rest", "def_interceptions": "div_game"},
        keep=["game_id"],
    )
    return t.select("game_id", "team", "points_allowed", S.defence_points(t).alias("fp"))


@query("p5_predicates", sql("""
select player_id, season, week, position, season_type from weekly
where season in (1997, 1998, 1999) and season_type = 'REG' and position in ('QB', 'RB', 'WR', 'TE') and week between 2 and 9""", "weekly"))
def p5(spark, d):
    return A.weekly(spark, d).where(
        F.col("season").isin(1997, 1998, 1999) & (F.col("season_type") == "REG")
        & F.col("position").isin("QB", "RB", "WR", "TE") & F.col("week").between(2, 9)
    ).select(*KEYS, "position", "season_type")


@query("p6_team_rows", sql("""
select game_id, season, week, home_team as team, home_score as pf, away_score as pa, 1 as is_home from games union all
select game_id, season, week, away_team, away_score, home_score, 0 from games""", "games"))
def p6(spark, d):
    return G.scores_by_team(A.games(spark, d))


cte("implied", """
select game_id, season, week, home_team as team, total_line/2.0 + spread_line/2.0 as team_implied_total,
       total_line/2.0 - spread_line/2.0 as opp_implied_total, spread_line as team_spread, total_line as game_total, 1 as is_home
from games where spread_line is not null and total_line is not null union all
select game_id, season, week, away_team, total_line/2.0 - spread_line/2.0, total_line/2.0 + spread_line/2.0, 0.0 - spread_line, total_line, 0
from games where spread_line is not null and total_line is not null""", ("games",))


@query("p7_implied_totals", sql("select * from implied", "implied"))
def p7(spark, d):
    return G.implied_totals(A.games(spark, d))


cte("weather_rows", """
select game_id, season, week, t.team, cast(roof in ('dome', 'closed') as int) as is_dome,
       case when roof in ('dome', 'closed') then 0.0::double else wind end as wind,
       case when roof in ('dome', 'closed') then 70.0::double else temp end as temp
from games, unnest([home_team, away_team]) as t(team)""", ("games",))


@query("p8_weather", sql("select * from weather_rows", "weather_rows"))
def p8(spark, d):
    return G.weather(A.games(spark, d))


cte("report_flags", """
select player_id, season, week,
  cast(max(case when report_status in ('Out', 'Doubtful', 'Questionable') then 1 else 0 end) as int) as inj_on_report,
  cast(max(case report_status when 'Out' then 3 when 'Doubtful' then 2 when 'Questionable' then 1 else 0 end) as int) as inj_status,
  cast(max(case when practice_status like 'Did Not%' then 1 else 0 end) as int) as practice_dnp,
  cast(max(case when practice_status like 'Limited%' then 1 else 0 end) as int) as practice_limited
from reports group by all""", ("reports",))


@query("p9_report_flags", sql("select * from report_flags", "report_flags"))
def p9(spark, d):
    return R.report_flags(A.reports(spark, d))


@query("p10_order_key", sql("select player_id, season, week, season * 100 + week as k from weekly", "weekly"))
def p10(spark, d):
    return A.weekly(spark, d).select(*KEYS, E.order_key().alias("k"))


@query("p11_one_hot", sql("select player_id, season, week, " + ", ".join(
    f"cast(position = '{p}' as int) as is_{p}" for p in ("QB", "RB", "WR", "TE")) + " from weekly", "weekly"))
def p11(spark, d):
    return E.one_hot(A.weekly(spark, d).select(*KEYS, "position"), "position", ("QB", "RB", "WR", "TE")).drop("position")


@query("p12_null_policies", sql("""
select game_id, coalesce(wind, 0.0) as wind_zero, coalesce(spread_line, total_line) as line_or_total,
       coalesce(spread_line, (select quantile_cont(spread_line, 0.5) from games)) as spread_or_median from games""", "games"))
def p12(spark, d):
    from ..operators.ordered import group_quantiles

    g = A.games(spark, d)
    med = group_quantiles(g, [], "spread_line", [0.5], ["m"])
    return g.select(
        "game_id", F.coalesce("wind", F.lit(0.0)).alias("wind_zero"),
        F.coalesce("spread_line", "total_line").alias("line_or_total"),
        F.coalesce("spread_line", med.scalar()).alias("spread_or_median"),
    )


@query("p13_clip_round_ratio", sql(f"""
select player_id, season, week, case when receiving_epa is not null then least(greatest(receiving_epa, 0.05), 0.3) end as clipped,
  {even("receiving_yards * 0.137::double", 1)} as rounded, receiving_yards / nullif(receiving_tds, 0) as per_td from weekly""", "weekly"))
def p13(spark, d):
    return A.weekly(spark, d).select(
        *KEYS, E.clip("receiving_epa", 0.05, 0.3).alias("clipped"),
        E.round_even(F.col("receiving_yards") * 0.137, 1).alias("rounded"),
        E.safe_ratio("receiving_yards", "receiving_tds").alias("per_td"),
    )


@query("p14_bins_and_tiers", sql("""
select c_custkey as player_id, age,
  case when age is null then -1 when age < 24 then 0 when age < 26 then 1 when age < 28 then 2 when age < 30 then 3 else 4 end as age_bin,
  case when pick between 1 and 40 then 0 when pick between 41 and 120 then 1 else 2 end as pick_tier
from (select c_custkey, cast(nullif(20 + c_custkey % 15, 34) as int) as age, cast(nullif(1 + c_custkey % 200, 200) as int) as pick from customer)"""))
def p14(spark, d):
    from ..plans.rookies import pick_tier
    from ..plans.season import AGE_EDGES

    k = F.col("c_custkey")
    t = A.table(spark, d, "customer").select(
        k.alias("player_id"), F.nullif(20 + k % 15, F.lit(34)).cast("int").alias("age"),
        F.nullif(1 + k % 200, F.lit(200)).cast("int").alias("pick"),
    )
    return t.select("player_id", "age", E.bin_index("age", AGE_EDGES).alias("age_bin"), pick_tier("pick").alias("pick_tier"))


@query("p15_schema_eras", sql("""
select player_id, season, coalesce(case when season < 1998 then cast(recent_team as varchar) end,
  case when season >= 1998 then cast(recent_team + 100 as varchar) end) as team, cast(week as varchar) as first_present from weekly""", "weekly"))
def p15(spark, d):
    w = A.weekly(spark, d)
    old = w.where(F.col("season") < 1998).select("player_id", "season", F.col("recent_team").alias("club_code"), F.col("week").alias("depth_team"))
    new = w.where(F.col("season") >= 1998).select("player_id", "season", (F.col("recent_team") + 100).alias("team"), F.col("week").alias("depth_team"))
    both = old.unionByName(new, allowMissingColumns=True)
    rank = E.first_present(both, ["pos_rank", "depth_team"])
    return both.select("player_id", "season", E.coalesce_present(both, ["team", "club_code", "recent_team"]).alias("team"),
                       F.col(rank).cast("string").alias("first_present"))


@query("p16_code_translation", sql("""
select gsis_id, team as source_team, case team when 'GNB' then 'GB' when 'KAN' then 'KC' when 'SFO' then 'SF' when 'TAM' then 'TB' else team end as team,
  case gsis_id % 3 when 0 then 'on injured reserve' when 1 then 'on PUP' end as status from picks""", "picks"))
def p16(spark, d):
    p = A.draft_picks(spark, d).select("gsis_id", F.col("team").alias("source_team"), "team")
    code = F.when(F.col("gsis_id") % 3 == 0, "RES").when(F.col("gsis_id") % 3 == 1, "PUP").otherwise("ACT")
    return R.map_team_codes(p).withColumn("status", E.translate(code, R.INACTIVE_STATUS, keep_unknown=False))


WORD_KEY_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\b(jr|sr|ii|iii|iv|v)\b\.?', '', 'g'), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"


def word_key_sql(c: str) -> str:
    return WORD_KEY_SQL.format(c)


def letter_key_sql(c: str) -> str:
    text = f"lower(coalesce({c}, ''))"
    for s in ("jr", "sr", "ii", "iii", "iv", "v"):
        text = rf"regexp_replace({text}, ' {s}\.?$', '')"
    return rf"regexp_replace({text}, '[^\p{{L}}]', '', 'g')"


@query("p17_word_key", sql(f"""
select player_id, name_b, {word_key_sql('name_b')} as k, {word_key_sql("name_b || ' of the ' || lower(name_a) || ' IV'")} as k_long from name_variants""", "name_variants"))
def p17(spark, d):
    n = A.name_variants(spark, d)
    return n.select("player_id", "name_b", N.word_key("name_b").alias("k"),
                    N.word_key(F.concat("name_b", F.lit(" of the "), F.lower("name_a"), F.lit(" IV"))).alias("k_long"))


@query("p18_letter_key", sql(f"""
select player_id, name_b, {letter_key_sql('name_b')} as k, {letter_key_sql("case when player_id % 5 > 0 then name_b || ' Jr. II' end")} as k_double from name_variants""", "name_variants"))
def p18(spark, d):
    n = A.name_variants(spark, d)
    return n.select("player_id", "name_b", N.letter_key("name_b").alias("k"),
                    N.letter_key(F.when(F.col("player_id") % 5 > 0, F.concat("name_b", F.lit(" Jr. II")))).alias("k_double"))


@query("p19_defence_name", sql("""
select s_suppkey, position, case when position = 'DEF' and not upper(name) like '% DST' then name || ' DST' else name end as name
from (select s_suppkey, case when s_suppkey % 2 = 0 then 'DEF' else 'K' end as position,
      case when s_suppkey % 4 = 0 then s_name || ' dst' else s_name end as name from supplier)"""))
def p19(spark, d):
    k = F.col("s_suppkey")
    s = A.table(spark, d, "supplier").select(
        k, F.when(k % 2 == 0, "DEF").otherwise("K").alias("position"),
        F.when(k % 4 == 0, F.concat("s_name", F.lit(" dst"))).otherwise(F.col("s_name")).alias("name"),
    )
    once = s.withColumn("name", N.defence_name("name", "position"))
    return once.withColumn("name", N.defence_name("name", "position"))


def prob_sql(o: str) -> str:
    return f"(case when {o} < 0 then -({o}) / (-({o}) + 100.0::double) else 100.0::double / ({o} + 100.0::double) end)"


def profit_sql(o: str) -> str:
    return f"(case when {o} > 0 then {o} / 100.0::double else 100.0::double / -({o}) end)"


def fair_sql(a: str, b: str) -> str:
    return f"({prob_sql(a)} / ({prob_sql(a)} + {prob_sql(b)}))"


@query("p20_odds", sql(f"""
select player_id, {prob_sql('over_odds')} as p_over, {prob_sql('under_odds')} as p_under, {profit_sql('over_odds')} as gain,
  case when player_id % 2 = 0 then {profit_sql('under_odds')} else -1.0 end as settled from prop_lines""", "prop_lines"))
def p20(spark, d):
    return A.prop_lines(spark, d).select(
        "player_id", O.implied_probability("over_odds").alias("p_over"), O.implied_probability("under_odds").alias("p_under"),
        O.unit_profit("over_odds").alias("gain"), O.unit_profit("under_odds", F.col("player_id") % 2 == 0).alias("settled"),
    )


@query("p21_fair_probability", sql(f"""
select game_id, {fair_sql('over_odds', 'under_odds')} as fair_over, {fair_sql('home_moneyline', 'away_moneyline')} as fair_home from games""", "games"))
def p21(spark, d):
    return A.games(spark, d).select("game_id", O.fair_probability("over_odds", "under_odds").alias("fair_over"),
                                    O.fair_probability("home_moneyline", "away_moneyline").alias("fair_home"))


@query("p22_better_side", sql(f"""
select player_id, case when ev_over >= ev_under then 'over' else 'under' end as side, greatest(ev_over, ev_under) as ev,
  case when ev_over >= ev_under then over_odds else under_odds end as odds from (
  select *, p * {profit_sql('over_odds')} - (1 - p) as ev_over, (1 - p) * {profit_sql('under_odds')} - p as ev_under
  from (select *, ((player_id % 7) + 1) / 8.0::double as p from prop_lines))""", "prop_lines"))
def p22(spark, d):
    p = ((F.col("player_id") % 7) + 1) / 8.0
    return A.prop_lines(spark, d).select("player_id", O.better_side(p, "over_odds", "under_odds").alias("b")).select("player_id", "b.*")


@query("p24_status_penalty", sql(f"""
select player_id, avail, {even("proj * f", 1)} as proj from (
  select player_id, proj, case when lf < sf then lf else sf end as f,
    case when lf < sf then 'live: ' || live_code when status is not null and status <> 'exempt' then status end as avail from (
    select *, coalesce(case status when 'retired' then 0.0 when 'on injured reserve' then 0.35 when 'suspended' then 0.6 end, 1.0)::double as sf,
      (case live_code when 'IR' then 0.35 when 'Sus' then 0.6 when 'Out' then 0.9 end)::double as lf from (
      select player_id, proj, case player_id % 5 when 0 then 'retired' when 1 then 'on injured reserve' when 2 then 'suspended' when 3 then 'exempt' end as status,
        case player_id % 4 when 0 then 'IR' when 1 then 'Sus' when 2 then 'Out' when 3 then 'Questionable' end as live_code from board)))""", "board"))
def p24(spark, d):
    k = F.col("player_id")
    b = A.board(spark, d).select(
        "player_id", "proj",
        F.when(k % 5 == 0, "retired").when(k % 5 == 1, "on injured reserve").when(k % 5 == 2, "suspended").when(k % 5 == 3, "exempt").alias("status"),
        F.when(k % 4 == 0, "IR").when(k % 4 == 1, "Sus").when(k % 4 == 2, "Out").otherwise("Questionable").alias("live_code"),
    )
    return R.status_penalty(b).select("player_id", "avail", "proj")


@query("p25_hash_jitter", sql(f"""
select player_id, team, (('0x' || substr(md5(player || '|' || cast(team as varchar)), 1, 8))::bigint / 4294967295.0::double - 0.5) * 2 * 24.0::double as jitter from board""", "board"))
def p25(spark, d):
    return A.board(spark, d).select("player_id", "team", E.hash_jitter("player", "team", 24.0).alias("jitter"))


@query("p26_season_label", """
select o_orderkey, cast(case when month(o_orderdate) >= 9 then year(o_orderdate) else year(o_orderdate) - 1 end as int) as season,
  cast(year(o_orderdate) as int) as upcoming from orders""")
def p26(spark, d):
    return A.table(spark, d, "orders").select(
        "o_orderkey", E.season_label("o_orderdate").alias("season"), E.upcoming_season_label("o_orderdate").alias("upcoming"))


@query("p27_season_started", sql("""
select s.season, count(w.season) > 0 as started from (select distinct season + 1 as season from weekly) s
left join weekly w on w.season = s.season and w.season_type = 'REG' group by s.season""", "weekly"))
def p27(spark, d):
    from ..operators.joins import seasons_started

    w = A.weekly(spark, d)
    wanted = w.select((F.col("season") + 1).alias("season")).distinct()
    return seasons_started(w, wanted)


@query("p27_calendar_fallback", """
with c as (select max(case when month(o_orderdate) >= 9 then year(o_orderdate) else year(o_orderdate) - 1 end) as now from orders)
select distinct (year(o_orderdate) + 1)::int as season, year(o_orderdate) + 1 <= (select now from c) as started from orders""")
def p27b(spark, d):
    from ..operators.joins import seasons_started

    day = F.col("o_orderdate")
    orders = A.table(spark, d, "orders")
    wanted = orders.select((F.year(day) + 1).alias("season")).distinct()
    return seasons_started(None, wanted, orders.agg(F.max(E.season_label(day))).scalar())


RHO_SQL = """
case when list_sort([a.recent_team, a.opponent_team]) <> list_sort([b.recent_team, b.opponent_team]) then 0.0
  when a.recent_team = b.recent_team then
    case when (a.position = 'QB' or b.position = 'QB') and (a.position in ('WR','TE') or b.position in ('WR','TE')) then 0.199
         when a.position in ('WR','TE') and b.position in ('WR','TE') then 0.004
         when (a.position = 'RB' or b.position = 'RB') and (a.position in ('WR','TE') or b.position in ('WR','TE')) then -0.011
         when (a.position = 'QB' or b.position = 'QB') and (a.position = 'RB' or b.position = 'RB') then 0.041 else 0.0 end
  when (a.position = 'QB' or b.position = 'QB') and (a.position in ('WR','TE') or b.position in ('WR','TE')) then 0.059
  when a.position in ('WR','TE') and b.position in ('WR','TE') then 0.034 else 0.0 end"""


@query("p28_pair_rho", sql(f"""
select a.player_id, a.season, a.week, b.player_id as next_id, cast({RHO_SQL} as double) as rho
from weekly a join weekly b on b.player_id = a.player_id + 1 and b.season = a.season and b.week = a.week""", "weekly"))
def p28(spark, d):
    cols = ["recent_team", "opponent_team", "position"]
    w = A.weekly(spark, d).select(*KEYS, *cols)
    other = w.select((F.col("player_id") - 1).alias("player_id"), "season", "week", F.col("player_id").alias("next_id"),
                     *[F.col(c).alias(f"b_{c}") for c in cols])
    return w.join(other, KEYS).select(
        *KEYS, "next_id", C.relation_rho(*cols, *[f"b_{c}" for c in cols]).cast("double").alias("rho"))


cte("slate", """
select period, cast(case when i = 0 then 0 else (((i - 1 - period) % (m - 1)) + (m - 1)) % (m - 1) + 1 end as int) as team_a,
  cast((((m - 2 - i - period) % (m - 1)) + (m - 1)) % (m - 1) + 1 as int) as team_b, n
from (select distinct cast((season - 1995) * 12 + week - 1 as int) as period from weekly),
     (select count(*) as n, count(*) + count(*) % 2 as m from supplier), lateral (select unnest(range(m // 2)) as i)""", ("weekly",))


def slate(spark, d):
    """Round-robin pairings of all suppliers over the months of the data."""
    n = A.table(spark, d, "supplier").agg(F.count("*")).scalar()
    months = A.table(spark, d, "lineitem").select(
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("period")
    ).distinct()
    return G.round_robin(months, "period", n)


@query("p29_round_robin", sql("select period, team_a, team_b from slate where team_a < n and team_b < n", "slate"))
def p29(spark, d):
    return slate(spark, d)


@query("p30_market_positions", sql("""
select player_id, week, season, market from weekly, (values ('passing_yards', 'QB'), ('passing_tds', 'QB'), ('receiving_yards', 'WR'),
 ('receiving_yards', 'TE'), ('receiving_yards', 'RB'), ('receptions', 'WR'), ('receptions', 'TE'), ('receptions', 'RB'),
 ('rushing_yards', 'RB'), ('rushing_yards', 'QB'), ('rushing_yards', 'WR')) as m(market, pos) where position = pos""", "weekly"))
def p30(spark, d):
    from ..plans.props import markets_of_position

    return markets_of_position(A.weekly(spark, d)).select(*KEYS, "market")
