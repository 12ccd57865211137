"""Joins (J1-J19)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import names as N
from ..operators import context as X
from ..operators import correlation as C
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import pools as P
from ..operators import reshape as G
from ..operators import rollups as U
from ..operators import trailing as T
from .base import cte, q6, query, r6, sql
from .projections import letter_key_sql, word_key_sql
from .windows import mixed_residuals, residuals, scored, skilled

KEYS = ["player_id", "season", "week"]

cte("team_week", """
select * exclude (rn, game_id) from (select *, row_number() over (partition by season, week, team order by game_id) as rn from implied) where rn = 1""", ("implied",))


def team_week(spark, d):
    """The first game of each team and week, as the market saw it."""
    rows = G.implied_totals(A.games(spark, d))
    return J.first_by(rows, ["season", "week", "team"], [F.col("game_id")]).drop("game_id")


@query("j1_feature_joins", sql(f"""
select w.player_id, w.season, w.week, {q6('def_fp_allowed_r3')} as def_fp_allowed_r3, team_implied_total, is_home, coalesce(inj_status, 0) as inj_status
from scored w left join allowed_form a using (opponent_team, position, season, week)
left join team_week t on t.season = w.season and t.week = w.week and t.team = w.recent_team
left join (select player_id, week, max(inj_status) as inj_status from report_flags group by all) i on i.player_id = w.player_id and i.week = w.week""",
    "scored", "allowed_form", "team_week", "report_flags"))
def j1(spark, d):
    from ..operators.reports import report_flags

    s = scored(spark, d)
    flags = report_flags(A.reports(spark, d)).groupBy("player_id", "week").agg(F.max("inj_status").alias("inj_status"))
    out = J.enrich(
        s, (T.allowed_form(s, (3, 5)), ["opponent_team", "position", "season", "week"]),
        (team_week(spark, d).withColumnRenamed("team", "recent_team"), ["season", "week", "recent_team"]),
        (flags, ["player_id", "week"]), fill={"inj_status": 0})
    return out.select(*KEYS, r6("def_fp_allowed_r3").alias("def_fp_allowed_r3"), "team_implied_total", "is_home", "inj_status")


def foreign_facts(spark, d):
    li = A.table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), F.col("l_partkey").alias("pfr_id"),
        F.col("l_suppkey").alias("gsis_id"), F.col("l_discount").alias("pct"))
    facts = li.groupBy("season", "week", "pfr_id").agg(F.max("pct").alias("snap_pct"))
    bridge = li.where(F.col("gsis_id") % 5 != 0).select("season", "pfr_id", "gsis_id")
    return facts, bridge


@query("j2_crosswalk", """
with li as (select cast(year(l_shipdate) as int) as season, cast(month(l_shipdate) as int) as week, l_partkey as pfr_id, l_suppkey as gsis_id, l_discount as pct from lineitem),
 x as (select season, pfr_id, min(gsis_id) as player_id from li where gsis_id % 5 <> 0 group by all)
select x.player_id, li.season, li.week, max(pct) as snap_pct from li join x using (season, pfr_id) group by all""")
def j2(spark, d):
    facts, bridge = foreign_facts(spark, d)
    return J.crosswalk(facts, bridge, "season", "pfr_id", "gsis_id", ["snap_pct"])


@query("j3_full_outer", sql("""
select player_id, season, week, a.a, n.n, r.r from (select player_id, season, week, passing_yards as a from weekly where passing_yards > 60) a
full join (select player_id, season, week, rushing_yards as n from weekly where rushing_yards > 80) n using (player_id, season, week)
full join (select player_id, season, week, receiving_yards as r from weekly where receiving_yards > 70) r using (player_id, season, week)""", "weekly"))
def j3(spark, d):
    w = A.weekly(spark, d)
    parts = [w.where(F.col(c) > v).select(*KEYS, F.col(c).alias(n)) for c, v, n in
             (("passing_yards", 60, "a"), ("rushing_yards", 80, "n"), ("receiving_yards", 70, "r"))]
    return J.outer_merge(parts, KEYS)


@query("j4_next_season_target", sql("""
select s.player_id, s.season, s.season + 1 as tseason, s.fp as p_fp, t.fp as target_fp from seasons s
left join seasons t on t.player_id = s.player_id and t.season = s.season + 1""", "seasons"))
def j4(spark, d):
    s = A.seasons(spark, d).select("player_id", "season", F.col("fp").alias("p_fp"))
    target = s.select("player_id", F.col("season").alias("tseason"), F.col("p_fp").alias("target_fp"))
    return J.shift_season(s, out="tseason").join(target, ["player_id", "tseason"], "left")


cte("opp_rows", "select season, home_team as team, away_team as opp from games where game_type = 'REG' union all select season, away_team, home_team from games where game_type = 'REG'", ("games",))
cte("allowed", "select opponent_team, position, season, sum(fp) as allowed from skill group by all", ("skill",))
cte("sos", "select team, o.season, position, avg(allowed) as sos from opp_rows o join allowed a on a.season + 1 = o.season and a.opponent_team = o.opp group by all", ("opp_rows", "allowed"))


def regular_opponents(spark, d):
    return G.opponents(A.games(spark, d).where(F.col("game_type") == "REG"), ["season"])


@query("j5_prior_year_schedule", sql(f"select team, season, position, {q6('sos')} as sos from sos", "sos"))
def j5(spark, d):
    s = J.prior_year_strength(U.points_allowed(skilled(spark, d)), regular_opponents(spark, d))
    return s.select("team", "season", "position", r6("sos").alias("sos"))


def rho_sql(n: str, rho: str) -> str:
    return f"select count(*) as n_pairs, {q6('case when count(*) >= 30 then corr(x, y) else 0.0 end', 4)} as rho"


@query("j6_team_pairs", sql(f"""
select 'qb_pc' as relation, * from ({rho_sql('', '')} from (select a.residual as x, b.residual as y from mixed a join mixed b using (season, week, recent_team)
  where a.position = 'QB' and b.position in ('WR', 'TE') and a.player_id <> b.player_id))
union all select 'pc_pc', * from ({rho_sql('', '')} from (select a.residual as x, b.residual as y from mixed a join mixed b using (season, week, recent_team)
  where a.position in ('WR', 'TE') and b.position in ('WR', 'TE') and a.player_id < b.player_id))""", "mixed"))
def j6(spark, d):
    m = C.estimate_relations(mixed_residuals(spark, d))
    return m.where(F.col("relation").isin("qb_pc", "pc_pc")).select("relation", "n_pairs", r6("rho", 4).alias("rho"))


@query("j7_mirrored_pairs", sql(f"""
select 'opp_qb_pc' as relation, * from ({rho_sql('', '')} from (select a.residual as x, b.residual as y from mixed a join mixed b
  on a.season = b.season and a.week = b.week and a.recent_team = b.opponent_team and a.opponent_team = b.recent_team where a.position = 'QB' and b.position in ('WR', 'TE')))
union all select 'opp_pc_pc', * from ({rho_sql('', '')} from (select a.residual as x, b.residual as y from mixed a join mixed b
  on a.season = b.season and a.week = b.week and a.recent_team = b.opponent_team and a.opponent_team = b.recent_team where a.position in ('WR', 'TE') and b.position in ('WR', 'TE')))""", "mixed"))
def j7(spark, d):
    m = C.estimate_relations(mixed_residuals(spark, d))
    return m.where(F.col("relation").isin("opp_qb_pc", "opp_pc_pc")).select("relation", "n_pairs", r6("rho", 4).alias("rho"))


@query("j8_anti_by_name", sql(f"""
select player_id, player from board where {word_key_sql('player')} not in (
  select {word_key_sql("upper(player) || ' Jr.'")} from board where player_id % 3 = 0)""", "board"))
def j8(spark, d):
    b = A.board(spark, d)
    taken = b.where(F.col("player_id") % 3 == 0).select(F.concat(F.upper("player"), F.lit(" Jr.")).alias("player"))
    return J.without_names(b, taken).select("player_id", "player")


@query("j9_active_semi", sql("""
select player_id, season, fp from seasons where player_id in (select player_id from seasons group by 1 having max(season) >= 2000 and min(season) >= 1996)""", "seasons"))
def j9(spark, d):
    s = A.seasons(spark, d).select("player_id", "season", "fp")
    live = s.groupBy("player_id").agg(F.max("season").alias("hi"), F.min("season").alias("lo")).where(
        (F.col("hi") >= 2000) & (F.col("lo") >= 1996))
    return s.join(live, "player_id", "left_semi")


NAME_OF = "replace(translate(c_name, '0123456789', 'abcdefghij'), '#', ' ')"
cte("roster_names", f"""
select player_id, position, {letter_key_sql('full_name')} as name_key, full_name from (
  select c.c_custkey as player_id, case c.c_mktsegment when 'AUTOMOBILE' then 'QB' when 'BUILDING' then 'RB' when 'FURNITURE' then 'WR' when 'HOUSEHOLD' then 'TE' else 'WR' end as position,
    replace(translate(case when c.c_custkey % 40 = 1 then 'Customer#' || lpad(cast(c.c_custkey - 1 as varchar), 9, '0') else c.c_name end, '0123456789', 'abcdefghij'), '#', ' ') as full_name from customer c)""")
cte("live", f"""
select case when c_custkey % 6 = 0 then '  ' || cast(c_custkey as varchar) || ' ' end as gsis_id, {letter_key_sql(NAME_OF + " || ' Sr'")} as name_key,
  case c_mktsegment when 'AUTOMOBILE' then 'QB' when 'BUILDING' then 'RB' when 'FURNITURE' then 'WR' when 'HOUSEHOLD' then 'TE' else 'WR' end as position,
  case c_custkey % 4 when 0 then 'IR' when 1 then 'Sus' when 2 then 'Questionable' end as live_code, 'note ' || cast(c_custkey as varchar) as live_note
from customer where c_custkey % 4 <> 3""")


def roster_names(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 40 == 1, F.concat(F.lit("Customer#"), F.lpad((k - 1).cast("string"), 9, "0"))).otherwise(F.col("c_name"))
    return A.table(spark, d, "customer").select(
        k.cast("string").alias("player_id"), A.code_of("c_mktsegment", A.SEGMENT_POSITION).alias("position"),
        A.letter_name(name).alias("full_name")).withColumn("name_key", N.letter_key("full_name"))


def live_feed(spark, d):
    k = F.col("c_custkey")
    return A.table(spark, d, "customer").where(k % 4 != 3).select(
        F.when(k % 6 == 0, F.concat(F.lit("  "), k.cast("string"), F.lit(" "))).alias("gsis_id"),
        N.letter_key(F.concat(A.letter_name(F.col("c_name")), F.lit(" Sr"))).alias("name_key"),
        A.code_of("c_mktsegment", A.SEGMENT_POSITION).alias("position"),
        F.when(k % 4 == 0, "IR").when(k % 4 == 1, "Sus").when(k % 4 == 2, "Questionable").alias("live_code"),
        F.concat(F.lit("note "), k.cast("string")).alias("live_note"))


@query("j10_entity_resolution", sql("""
, uniq as (select name_key, position, cast(min(player_id) as varchar) as player_id from roster_names group by all having count(*) = 1),
both_ways as (select u.player_id, 0 as how, live_code, live_note from live l join uniq u on trim(l.gsis_id) = u.player_id
  union all select u.player_id, 1, live_code, live_note from live l join uniq u on l.name_key = u.name_key and l.position = u.position)
select player_id, how = 0 as by_id, live_code, live_note from (
  select *, row_number() over (partition by player_id order by how, live_code, live_note) as rn from both_ways) where rn = 1""", "roster_names", "live").replace(")\n, uniq", "),\nuniq"))
def j10(spark, d):
    return J.resolve_entities(live_feed(spark, d), roster_names(spark, d), ["live_code", "live_note"])


cte("line_needs", f"""
select p.player_id, p.position, p.line, {q6('w.a')} as pred, {q6(f"p.line - {q6('w.a')}")} as need from prop_lines p join (select player_id, avg(fp) as a from scored group by 1) w using (player_id)""", ("prop_lines", "scored"))


def line_needs(spark, d):
    m = scored(spark, d).groupBy("player_id").agg(r6(F.avg("fp")).alias("pred"))
    return A.prop_lines(spark, d).join(m, "player_id").withColumn("need", r6(F.col("line") - F.col("pred")))


@query("j11_tail_share", sql(f"""
select n.player_id, n.need, {q6("avg(case when r.residual > need then 1.0::double else 0.0::double end)")} as p_above,
  {q6("avg(case when r.residual < need then 1.0::double else 0.0::double end)")} as p_below from line_needs n join resid r using (position) group by all""", "line_needs", "resid"))
def j11(spark, d):
    t = P.tail_shares(line_needs(spark, d), residuals(spark, d), ["position"], "need")
    return t.select("player_id", "need", r6("p_above").alias("p_above"), r6("p_below").alias("p_below"))


cte("targets", "select distinct season from skill union select max(season) + 1 from skill", ("skill",))
cte("rel", "select opponent_team as def_team, position, season, allowed / greatest(avg(allowed) over (partition by season, position), 1.0) as diff from allowed", ("allowed",))
cte("difficulty", """
select k.def_team, k.position, t.season, coalesce(sum(h.diff * power(0.6, (t.season - h.season)::double)) / sum(power(0.6, (t.season - h.season)::double)), 1.0) as d_diff
from (select distinct def_team, position from rel) k cross join targets t left join rel h on h.def_team = k.def_team and h.position = k.position and h.season < t.season group by all""", ("rel", "targets"))


def difficulty(spark, d):
    s = skilled(spark, d)
    return U.defence_difficulty(s, J.seasons_with_next(s))


@query("j12_strictly_prior", sql(f"select def_team, position, season, {q6('d_diff')} as d_diff from difficulty", "difficulty"))
def j12(spark, d):
    return difficulty(spark, d).select("def_team", "position", "season", r6("d_diff").alias("d_diff"))


cte("team_pd", "select team, season, avg(diff) as pd from (select home_team as team, season, home_score - away_score as diff from games where game_type = 'REG' union all select away_team, season, away_score - home_score from games where game_type = 'REG') group by all", ("games",))
cte("quality", """
select k.team, t.season, coalesce(sum(h.pd * power(0.6, (t.season - h.season)::double)) / sum(power(0.6, (t.season - h.season)::double)), 0.0) as q
from (select distinct team from team_pd) k cross join targets t left join team_pd h on h.team = k.team and h.season < t.season group by all""", ("team_pd", "targets"))


@query("j13_forward_schedule", sql(f"""
select f.team, f.season, f.position, {q6('f.ahead')} as sched_ahead, {q6('sq.sos_q')} as sos_q from (
  select o.team, o.season, f.position, avg(d_diff) as ahead from opp_rows o join difficulty f on f.def_team = o.opp and f.season = o.season group by all) f
join (select o2.team, o2.season, avg(q) as sos_q from opp_rows o2 join quality q on q.team = o2.opp and q.season = o2.season group by all) sq on sq.team = f.team and sq.season = f.season""", "opp_rows", "difficulty", "quality"))
def j13(spark, d):
    g = A.games(spark, d)
    quality = U.opponent_quality(g, J.seasons_with_next(g))
    return U.forward_schedule(g, difficulty(spark, d)).join(quality, ["team", "season"]).select(
        "team", "season", "position", r6("sched_ahead").alias("sched_ahead"), r6("sos_q").alias("sos_q"))


@query("j14_last_known", sql("""
select player_id, opponent_team, recent_team from (select *, row_number() over (partition by player_id order by season desc, week desc) as rn from weekly
 where season * 100 + week < 199907) where rn = 1""", "weekly"))
def j14(spark, d):
    return J.last_known(A.weekly(spark, d), "player_id", ["opponent_team", "recent_team"], cut=199907)


cte("depth", """
select player_id, season, week, position, recent_team as team, case when week % 5 = 0 then 'n/a' else cast(1 + cast(receptions as int) % 5 as varchar) end as depth_team, position as depth_position from weekly""", ("weekly",))


def depth_chart(spark, d):
    return A.weekly(spark, d).select(
        *KEYS, "position", F.col("recent_team").alias("team"),
        F.when(F.col("week") % 5 == 0, "n/a").otherwise((1 + F.col("receptions").cast("int") % 5).cast("string")).alias("depth_team"),
        F.col("position").alias("depth_position"))


@query("j15_dictionary_enrichment", sql("""
select w.player_id, w.season, w.week, r.depth_rank from weekly w left join (
  select player_id, min(try_cast(depth_team as double)) as depth_rank from depth where season = 1999 and try_cast(depth_team as double) is not null group by 1) r using (player_id)""", "weekly", "depth"))
def j15(spark, d):
    ranks = J.best_match(depth_chart(spark, d).where(F.col("season") == 1999), "player_id", "depth_team").withColumnRenamed("depth_team", "depth_rank")
    return A.weekly(spark, d).select(*KEYS).join(ranks, "player_id", "left")


@query("j16_match_names", sql(f"""
select a.asked as asked_player, b.player_id, b.player, b.player_id is not null as matched from (
  select case when c_custkey % 2 = 0 then upper({NAME_OF}) || ' II' else {NAME_OF} || ' nobody' end as asked from customer) a
left join (select *, row_number() over (partition by {word_key_sql('player')} order by proj desc, player_id) as rn from board) b
 on {word_key_sql('b.player')} = {word_key_sql('a.asked')} and rn = 1""", "board"))
def j16(spark, d):
    n = A.letter_name(F.col("c_name"))
    asked = A.table(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper(n), F.lit(" II"))).otherwise(F.concat(n, F.lit(" nobody"))).alias("player"))
    b = A.board(spark, d).select("player_id", "player", "proj")
    return J.match_names(asked, b, board_order=[-F.col("proj"), F.col("player_id")]).select("asked_player", "player_id", "player", "matched")


@query("j17_optional_table", "select n_nationkey, n_name, cast(null as double) as live_code, r_name from nation join region on n_regionkey = r_regionkey")
def j17(spark, d):
    A.table(spark, d, "region").createOrReplaceTempView("leakfree_present")
    present = J.optional_table(spark, "leakfree_present", "r_regionkey int, r_name string")
    absent = J.optional_table(spark, "leakfree_absent_status", "n_nationkey int, live_code double")
    n = A.table(spark, d, "nation")
    return n.join(present, F.col("n_regionkey") == F.col("r_regionkey")).join(absent, "n_nationkey", "left").select(
        "n_nationkey", "n_name", "live_code", "r_name")


cte("runs", """
select fraction, season, slot, cast(1 + g % 12 as int) as place, g % 12 = 0 as won from (
  select case position when 'QB' then 0.0 when 'RB' then 0.25 when 'WR' then 0.5 else 0.75 end::double as fraction, season, cast(player_id % 12 as int) as slot, sum(games) as g
  from seasons group by all)""", ("seasons",))


def runs(spark, d):
    """Run results: one per variant (position), season and slot."""
    p = F.col("position")
    fraction = F.when(p == "QB", 0.0).when(p == "RB", 0.25).when(p == "WR", 0.5).otherwise(0.75)
    g = A.seasons(spark, d).groupBy(fraction.alias("fraction"), "season", (F.col("player_id") % 12).cast("int").alias("slot")).agg(F.sum("games").alias("g"))
    return g.select("fraction", "season", "slot", (1 + F.col("g") % 12).cast("int").alias("place"), (F.col("g") % 12 == 0).alias("won"))


@query("j18_strict_pairs", sql("""
select season, slot, coalesce(max(place) filter (fraction = 0.5), 13) - coalesce(max(place) filter (fraction = 0.25), 13) as place_delta from runs group by season, slot""", "runs"))
def j18(spark, d):
    r, keys = runs(spark, d), ["season", "slot"]
    slots = r.select(*keys).distinct()  # a slot that a variant did not fill comes last, so that both are complete

    def variant(fraction):
        own = r.where(F.col("fraction") == fraction).select(*keys, "place")
        return slots.join(own, keys, "left").withColumn("place", F.coalesce("place", F.lit(13)))

    return J.strict_pairs(variant(0.5), variant(0.25), keys, ["place"])


LINE_POSITION = "case s_suppkey % 5 when 0 then 'LT' when 1 then 'LG' when 2 then 'C' when 3 then 'RG' else 'QB' end"
cte("line_chart", f"""
select s_nationkey::bigint + 25 * (s_suppkey::bigint // 250) as team, s_suppkey as player_id, '1' as depth_team, {LINE_POSITION} as depth_position from supplier""")
cte("nation_chart", f"""
select *, row_number() over (partition by team, depth_position order by player_id)::varchar as depth_team from (
  select s_nationkey::int as team, s_suppkey as player_id, {LINE_POSITION} as depth_position from supplier)""")
cte("line_avail", """
select s_suppkey as player_id, s_suppkey % 3 = 0 as ended_hurt, case when s_suppkey % 4 = 0 then 'on PUP' end as status, case s_suppkey % 7 when 0 then 'IR' when 1 then 'Questionable' end as live_code from supplier""")
LINE_CTX = """
select team, count(*) as ol_out, string_agg(s_name, ', ' order by s_name) as ol_names from {0} c join line_avail a using (player_id) join supplier on s_suppkey = player_id
where depth_team = '1' and depth_position in ('LT', 'LG', 'C', 'RG', 'RT') and (ended_hurt or status is not null or coalesce(live_code in ('Sus', 'DNR', 'IR', 'PUP', 'NA', 'Out'), false)) group by 1 having count(*) >= 2"""
cte("line_ctx", LINE_CTX.format("line_chart"), ("line_chart", "line_avail"))
cte("nation_line_ctx", LINE_CTX.format("nation_chart"), ("nation_chart", "line_avail"))


def line_tables(spark, d, nations=False):
    """A chart of all suppliers, who is unavailable, and their names.

    Teams are the suppliers of a nation among 250 keys that follow each other, about ten, all of them starters. With
    ``nations`` a team is a nation, of whose suppliers at a position the first one starts.
    """
    s, k = A.table(spark, d, "supplier"), F.col("s_suppkey")
    position = F.when(k % 5 == 0, "LT").when(k % 5 == 1, "LG").when(k % 5 == 2, "C").when(k % 5 == 3, "RG").otherwise("QB")
    team = F.col("s_nationkey").cast("int") if nations else F.col("s_nationkey").cast("long") + F.floor(k / 250) * 25
    chart = s.select(team.alias("team"), k.alias("player_id"), position.alias("depth_position"))
    if nations:
        chart = O.row_numbers(chart, ["team", "depth_position"], [F.col("player_id")], "place").withColumn("depth_team", F.col("place").cast("string"))
    else:
        chart = chart.withColumn("depth_team", F.lit("1"))
    avail = s.select(k.alias("player_id"), (k % 3 == 0).alias("ended_hurt"), F.when(k % 4 == 0, "on PUP").alias("status"),
                     F.when(k % 7 == 0, "IR").when(k % 7 == 1, "Questionable").alias("live_code"))
    return chart, avail, s.select(k.alias("player_id"), F.col("s_name").alias("full_name"))


@query("j19_line_context", sql("select * from line_ctx", "line_ctx"))
def j19(spark, d):
    chart, avail, names = line_tables(spark, d)
    return X.line_context(X.line_starters(chart), avail, names)
