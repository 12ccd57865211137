"""Sources, sinks and streams (S1-S19, ST1-ST2)."""

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import scoring as SC
from ..operators import ranking as R
from ..session import scratch_path
from ..sources import contracts as C
from ..sources import provenance as PV
from ..sources import scans as S
from ..sources.registry import DATASETS, Dataset
from ..sources.versions import VersionedParts
from ..streaming import refresh as ST
from .base import cte, even, query, sql
from .projections import letter_key_sql

KEYS = ["player_id", "season", "week"]


def season_parts(spark, d):
    """Season totals written as two eras: renamed, retyped and missing columns."""
    s = A.seasons(spark, d)
    old = s.where(F.col("season") < 1998).select("player_id", "season", "fp", F.col("games").cast("string").alias("games"))
    new = s.where(F.col("season") >= 1998).select("player_id", "season", "games", "position")
    paths = []
    for name, part in (("old", old), ("new", new)):
        paths.append(scratch_path(spark, f"era-{name}"))
        part.write.parquet(paths[-1])
    return paths


@query("s1_union_by_name", sql("""
select player_id, season, case when season < 1998 then fp end as fp, games, case when season >= 1998 then position end as position from seasons""", "seasons"))
def s1(spark, d):
    df = S.read_dataset(spark, season_parts(spark, d), {"games": "bigint"})
    S.attach(spark, "leakfree_seasons", df)
    return spark.table("leakfree_seasons")


def seasons_text(t: str) -> str:
    return f"(select string_agg(s::varchar, ',' order by s) from (select distinct season as s from {t}))"


@query("s2_dataset_registry", sql(f"""
select 'weekly' as dataset, count(*) as rows, {seasons_text('weekly')} as seasons, '' as problems, true as seasonal from weekly
union all select 'schedules', count(*), {seasons_text('games')}, '', false from games
union all select 'draft_picks', count(*), {seasons_text('picks')}, '', false from picks""", "weekly", "games", "picks"))
def s2(spark, d):
    frames = {"weekly": A.weekly(spark, d), "schedules": A.games(spark, d), "draft_picks": A.draft_picks(spark, d)}
    out = None
    for name, df in frames.items():
        r = C.contract_report(df, DATASETS[name]).withColumn("seasonal", F.lit(DATASETS[name].seasonal))
        out = r if out is None else out.unionByName(r)
    return out


@query("s3_csv_source", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def s3(spark, d):
    path = scratch_path(spark, "csv")
    A.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.csv(path, header=True)
    return S.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("s4_line_text", """
select c_name as player, 'receptions' as market, c_custkey + 0.5::double as line, -110.0::double as over_odds, cast(case when c_custkey % 4 = 3 then '105' else '-115' end as double) as under_odds
from customer where c_custkey % 4 in (2, 3)""")
def s4(spark, d):
    k = F.col("c_custkey")
    text = (F.when(k % 4 == 0, F.concat_ws(",", "c_name", F.lit("receptions"), F.lit("n/a"), F.lit("-110"), F.lit("-110")))
            .when(k % 4 == 1, F.concat_ws(",", "c_name", F.lit("receptions"), F.lit("5.5")))
            .otherwise(F.concat_ws(" , ", "c_name", F.lit("receptions"), (k + 0.5).cast("string"), F.lit("-110"), F.when(k % 4 == 3, "105").otherwise("-115"), F.lit("extra"))))
    return S.parse_line_text(A.table(spark, d, "customer").select(text.alias("value")))


@query("s5_name_lists", """
select c_custkey, cast(i as int) as place, case i when 1 then c_name else 'Second ' || c_mktsegment end as player from customer, (values (1), (3)) as v(i)
union all select c_custkey, 0, 'First' from customer where c_custkey % 2 = 1""")
def s5(spark, d):
    head = F.when(F.col("c_custkey") % 2 == 0, F.lit("Player")).otherwise(F.lit(" First ,x"))
    text = F.concat(head, F.lit('\n"'), "c_name", F.lit('",QB\n  \nSecond '), "c_mktsegment", F.lit(",1,2\n"))
    return S.parse_name_lists(A.table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


LIVE_NAME = "replace(translate(c_name, '0123456789', 'abcdefghij'), '#', ' ') || ' Jr.'"


@query("s6_live_json", f"""
select case when c_custkey % 6 = 0 then cast(c_custkey as varchar) end as gsis_id, {letter_key_sql(LIVE_NAME)} as name_key, 'QB' as position, 'T' || cast(c_nationkey as varchar) as team,
  case when c_custkey % 4 <> 1 then 'IR' end as live_code, cast(null as varchar) as live_body, cast(null as varchar) as live_note,
  cast(case when c_custkey % 3 = 0 then make_timestamp((1700000000000 + c_custkey * 86400000) * 1000) end as date) as news_date
from customer where c_custkey % 5 not in (1, 2) and c_custkey % 10 <> 3""")
def s6(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 10 == 3, "Duplicate Player").otherwise(F.concat(A.letter_name(F.col("c_name")), F.lit(" Jr.")))
    player = F.to_json(F.struct(
        F.when(k % 6 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).otherwise("").alias("gsis_id"), name.alias("full_name"),
        F.lit("QB").alias("position"), F.when(k % 5 == 1, F.lit("")).otherwise(F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("team"),
        F.when(k % 4 != 1, "IR").alias("injury_status"), F.lit("").alias("injury_body_part"),
        F.when(k % 3 == 0, 1700000000000 + k * 86400000).alias("news_updated")))
    entry = F.concat(F.lit('"'), k.cast("string"), F.lit('":'), F.when(k % 5 == 2, F.lit('"gone"')).otherwise(player))
    blobs = A.table(spark, d, "customer").select(F.concat(F.lit("{"), entry, F.lit(', "x1": null, "x2": 3}')).alias("value"))
    return S.live_rows(blobs)


def leagues(spark, d):
    """League objects, one per order, whose rosters are other customers' keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ids = F.to_json(F.array(*[((k * 7 + i * 13) % 100).cast("string") for i in range(3)]))
    others = F.to_json(F.array(*[((k * 11 + i * 17) % 100).cast("string") for i in range(2)]))
    rosters = F.concat(F.lit('[{"owner_id":"'), c.cast("string"), F.lit('","roster_id":1,"players":'), ids,
                       F.lit('},{"owner_id":null,"roster_id":2,"players":'), others, F.lit("}]"))
    flex = F.when(k % 3 == 0, F.lit('"FLEX","SUPER_FLEX"')).when(k % 3 == 1, F.lit('"REC_FLEX","flex","OP"')).otherwise(F.lit('"WRRB_FLEX"'))
    positions = F.concat(F.lit('["QB","RB","RB","WR","WR","TE",'), flex, F.lit(',"K","DST","BN","BN"]'))
    picks = F.concat(F.lit('[{"player_id":"'), (k % 100).cast("string"), F.lit('"},{"player_id":"none"}]'))
    settings = F.when(k % 4 == 0, F.lit("{}")).when(k % 4 == 1, F.lit('{"rec":0.5}')).when(k % 4 == 2, F.lit('{"rec":0}')).otherwise(
        F.concat(F.lit('{"rec":0.75,"bonus_rec_te":0.5,"pass_td":'), (k % 7).cast("string"), F.lit(',"other":"x"}')))
    league = F.concat(F.lit('{"name":"L'), k.cast("string"), F.lit('","total_rosters":'), (8 + k % 7).cast("string"),
                      F.lit(',"settings":{"type":'), (k % 3).cast("string"), F.lit('},"scoring_settings":'), settings, F.lit("}"))
    return A.table(spark, d, "orders").select(
        k.alias("league_id"), c.cast("string").alias("user_id"), rosters.alias("rosters"), positions.alias("positions"),
        picks.alias("picks"), settings.alias("settings"), league.alias("league"))


def player_table(spark, d):
    k = F.col("s_suppkey")
    return A.suppliers(spark, d).select(
        k.cast("string").alias("player_id"), F.when(k % 9 != 0, F.col("s_name")).alias("full_name"),
        F.when(F.col("position") == "K", "DEF").otherwise(F.col("position")).alias("position"),
        F.when(k % 2 == 0, F.concat(F.lit("T"), F.col("s_nationkey").cast("string"))).alias("team"))


cte("player_table", "select s_suppkey as player_id, case when s_suppkey % 9 <> 0 then s_name end as full_name, case position when 'K' then 'DEF' else position end as position, case when s_suppkey % 2 = 0 then 'T' || s_nationkey end as team from supp", ("supp",))
cte("league_players", """
select o_orderkey as league_id, o_custkey::varchar as owner, true as mine, (o_orderkey * 7 + i * 13) % 100 as pid from orders, range(3) as r(i)
union all select o_orderkey, 'roster 2', false, (o_orderkey * 11 + i * 17) % 100 from orders, range(2) as r(i)""")


@query("s7_league_rosters", sql("""
select league_id, owner, mine, position, case when position = 'DEF' then coalesce(team, player_id::varchar) || ' DST' else full_name end as player
from league_players join player_table on pid = player_id where position = 'DEF' or full_name is not null""", "league_players", "player_table"))
def s7(spark, d):
    return S.league_rosters(leagues(spark, d), "league_id", "rosters", player_table(spark, d), "user_id")


@query("s7_lineup_slots", """
select o_orderkey as league_id, 1::bigint as "QB", 2::bigint as "RB", 2::bigint as "WR", 1::bigint as "TE", 1::bigint as "K", 1::bigint as "DEF", (o_orderkey % 3 <> 2)::bigint as flex,
  (o_orderkey % 3 <> 2)::bigint as superflex, (o_orderkey % 3 = 1)::bigint as wrte, (o_orderkey % 3 = 2)::bigint as rbwr from orders""")
def s7b(spark, d):
    return S.lineup_slots(leagues(spark, d), "league_id", "positions")


@query("s7_picks_and_summary", sql("""
select o_orderkey as league_id, 'L' || o_orderkey as name, cast(8 + o_orderkey % 7 as int) as teams, case o_orderkey % 3 when 0 then 'redraft' when 1 then 'keeper' else 'dynasty' end as type,
  case o_orderkey % 4 when 0 then 'ppr' when 1 then 'half' when 2 then 'standard' else 'custom' end as scoring, p.full_name as picked from orders left join player_table p on p.player_id = o_orderkey % 100""", "player_table"))
def s7c(spark, d):
    l = leagues(spark, d)
    picked = S.picked_names(l, "league_id", "picks", player_table(spark, d)).withColumnRenamed("player", "picked")
    return S.league_summary(l, "league_id", "league").join(picked, "league_id", "left")


@query("s8_league_rules", """
select o_orderkey as league_id, case o_orderkey % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.0 else 0.75 end::double as reception, case when o_orderkey % 4 = 3 then (o_orderkey % 7)::double else 4.0::double end as pass_td,
  case when o_orderkey % 4 = 3 then 0.5::double else 0.0::double end as te_reception_bonus, 0.04::double as pass_yd, 3.0::double as fg_0_39,
  case o_orderkey % 4 when 0 then 'ppr' when 1 then 'half' when 2 then 'standard' else 'custom' end as scoring from orders""")
def s8(spark, d):
    r = S.league_rules(leagues(spark, d), "league_id", "settings")
    return r.select("league_id", "reception", "pass_td", "te_reception_bonus", "pass_yd", "fg_0_39", "scoring")


@query("s8_scored_by_league", sql(f"""
select w.player_id, w.season, w.week, o.league_id, {even("passing_yards*0.04::double + passing_tds*o.ptd + interceptions*-2.0::double + rushing_yards*0.1::double + rushing_tds*6.0::double + receptions*o.rec + receiving_yards*0.1::double + receiving_tds*6.0::double + rushing_fumbles_lost*-2.0::double + case when position = 'TE' then receptions*o.te else 0.0::double end", 2)} as fp
from weekly w join (select o_orderkey as league_id, case o_orderkey % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.0 else 0.75 end::double as rec, case when o_orderkey % 4 = 3 then (o_orderkey % 7)::double else 4.0::double end as ptd,
  case when o_orderkey % 4 = 3 then 0.5::double else 0.0::double end as te from orders) o on o.league_id = w.player_id * 7 + w.week""", "weekly"))
def s8b(spark, d):
    w = A.weekly(spark, d).withColumn("league_id", F.col("player_id") * 7 + F.col("week"))
    rules = S.league_rules(leagues(spark, d), "league_id", "settings")
    j = w.join(rules, "league_id")
    weights = {r: F.col(r) for r in SC.RULE_DEFAULTS}
    return j.select("player_id", "season", "week", "league_id", SC.skill_points(w, weights).alias("fp"))


@query("s9_ranking_text", r"""
with e as (select unnest(regexp_extract_all(t, '(?:QB|RB|WR|TE|K|DST|D/ST)\d?\s+([A-Z][A-Za-z.''\-]+(?:\s+[A-Za-z.''\-]+)*?)\s+\((\d+)\)', 1)) as player,
  unnest(regexp_extract_all(t, '(?:QB|RB|WR|TE|K|DST|D/ST)\d?\s+([A-Z][A-Za-z.''\-]+(?:\s+[A-Za-z.''\-]+)*?)\s+\((\d+)\)', 2)) as rank
  from (select text || chr(10) || 'WR1 Mc' || lang || ' O''Neal Jr. (' || (doc_id % 300 + 2) || ')  D/ST ' || upper(source) || '-x (7) ' || text || ' RB2 Bo (' || doc_id || ')' as t from documents))
select player, min(cast(rank as int)) as adp, 'consensus' as source from e group by 1""")
def s9(spark, d):
    text = F.concat("text", F.lit("\nWR1 Mc"), "lang", F.lit(" O'Neal Jr. ("), (F.col("doc_id") % 300 + 2).cast("string"), F.lit(")  D/ST "),
                    F.upper("source"), F.lit("-x (7) "), "text", F.lit(" RB2 Bo ("), F.col("doc_id").cast("string"), F.lit(")"))
    return S.parse_rankings(A.table(spark, d, "documents").select(text.alias("text")))


@query("s10_contract_report", sql("""
select 'weekly' as dataset, count(*) as rows, string_agg(distinct season::varchar, ',' order by season::varchar) as seasons, '' as problems from weekly
union all select 'injuries', count(*), string_agg(distinct season::varchar, ',' order by season::varchar), 'missing required columns: [''gsis_id'', ''position'']' from reports
union all select 'depth_charts', count(*), string_agg(distinct season::varchar, ',' order by season::varchar), 'expected one of these columns: [''football_name'', ''full_name'', ''player_name'']' from weekly""", "weekly", "reports"))
def s10(spark, d):
    w = A.weekly(spark, d)
    chart = w.select("season", F.col("player_id").alias("gsis_id"), F.col("recent_team").alias("team"), "position")
    out = None
    for name, df in (("weekly", w), ("injuries", A.reports(spark, d)), ("depth_charts", chart)):
        r = C.contract_report(df, DATASETS[name])
        out = r if out is None else out.unionByName(r)
    return out


@query("s11_normalize_weekly", sql("select player_id, season, week, position, recent_team, interceptions from weekly where position in ('QB', 'RB', 'WR', 'TE', 'FB', 'K')", "weekly"))
def s11(spark, d):
    raw = A.weekly(spark, d).withColumnsRenamed({"recent_team": "team", "interceptions": "passing_interceptions"})
    return C.normalize_weekly(raw).select(*KEYS, "position", "recent_team", "interceptions")


cte("snapshots", "select l_suppkey % 25 as team, l_suppkey as gsis_id, strftime(l_shipdate, '%Y-%m-%d') as dt, l_linenumber as pos_rank from lineitem")


@query("s12_latest_snapshot", sql("select team, gsis_id, dt, pos_rank, 2001 as season from snapshots s where dt = (select max(dt) from snapshots x where x.team = s.team)", "snapshots"))
def s12(spark, d):
    li = A.table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 25).alias("team"), F.col("l_suppkey").alias("gsis_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("dt"),
        F.col("l_linenumber").alias("pos_rank"), F.lit(None).cast("int").alias("season"))
    return C.normalize_depth(li, 2001)


@query("s13_publish", sql("select player_id, season, fp, games from seasons", "seasons"))
def s13(spark, d):
    s = A.seasons(spark, d).select("player_id", "season", "fp", "games")
    lake = VersionedParts(spark, scratch_path(spark, "lake"), ["season"])
    lake.replace(s.withColumn("fp", F.lit(0.0)))
    lake.replace(s.where(F.col("season") < 1998))
    lake.replace(s.where(F.col("season") >= 1998))
    return lake.read(s.schema)


def published(spark, d):
    path = scratch_path(spark, "lake")
    PV.publish(A.seasons(spark, d).select("player_id", "season", "fp", "games"), path)
    return path


@query("s14_provenance", sql("""
select 'seasons' as dataset, season, 'orders' as source, count(*) as rows, 'player_id,fp,games,season' as columns, true as hashed, 'download' as provenance, cast(1 as int) as contract_version from seasons group by season""", "seasons"))
def s14(spark, d):
    p = PV.provenance(spark, published(spark, d), "seasons", "orders")
    keys = ["dataset", "season", "source", "columns", "provenance", "contract_version"]
    hashed = F.bool_and((F.length("sha256") == 64) & (F.col("bytes") > 0) & F.col("modified").isNotNull())
    return p.groupBy(*keys).agg(F.sum("rows").alias("rows"), hashed.alias("hashed"))


@query("s14_rows_per_season", sql("select season, count(*) as rows from seasons group by 1", "seasons"))
def s14b(spark, d):
    data = spark.read.parquet(published(spark, d))
    return data.groupBy("season", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).groupBy("season").agg(F.sum("n").alias("rows"))


@query("s15_pending_files", sql("select distinct season from seasons where season in (1997, 2001)", "seasons"))
def s15(spark, d):
    path = published(spark, d)
    manifest = PV.provenance(spark, path, "seasons", "orders").where(F.col("season") != 1997)
    listing = PV.list_files(spark, path).withColumns({
        "path": F.regexp_replace("path", "^file:/+", "file:///"), "season": F.regexp_extract("path", "season=([0-9]+)", 1).cast("int")})
    return PV.pending_files(listing, manifest, "season", 2001).select("season").distinct()


@query("s15_ingest", sql("select player_id, season, fp, games from seasons where season % 4 <> 0", "seasons"))
def s15b(spark, d):
    s, root = A.seasons(spark, d).select("player_id", "season", "fp", "games"), scratch_path(spark, "ingested")
    dataset = Dataset("seasons", True, frozenset({"player_id", "season", "fp"}), (frozenset({"games", "weeks"}),))

    def read(season):
        if season % 8 == 0:
            raise OSError("unreadable")
        return s.where(F.col("season") == season - (season % 4 == 0))  # the wrong season breaks the contract

    seasons = sorted(r.season for r in s.select("season").distinct().collect())
    failures = PV.ingest([(dataset, y, lambda y=y: read(y)) for y in seasons], root)
    if {name for name, _ in failures} != {f"seasons_{y}" for y in seasons if y % 4 == 0}:
        raise RuntimeError(f"unexpected failures: {failures}")
    return spark.read.parquet(f"{root}/seasons").select("player_id", "season", "fp", "games")


@query("s16_backfill", sql("select season, count(*) as rows, 'backfilled_from_file_mtime' as provenance from seasons where season >= 1998 group by season", "seasons"))
def s16(spark, d):
    path = published(spark, d)
    half = PV.provenance(spark, path, "seasons", "orders").where(F.col("season") < 1998)
    new = PV.backfill(spark, path, "seasons", "orders", half)
    return new.groupBy("season", "provenance").agg(F.sum("rows").alias("rows"))


@query("s17_fingerprint", """
with files as (select 'orders/' || year(o_orderdate) as f, sha256(cast(count(*) as varchar) || ' ' || cast(max(o_orderkey) as varchar)) as h from orders group by year(o_orderdate))
select sha256('{' || string_agg('"' || f || '":"' || h || '"', ',' order by f) || '}') as asset_set_sha256, count(*) as asset_count from files""")
def s17(spark, d):
    # one entry per season of orders, as a dataset has one file per season
    digest = F.sha2(F.concat_ws(" ", F.count("*").cast("string"), F.max("o_orderkey").cast("string")), 256)
    files = A.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(digest.alias("sha256")).select(
        F.concat(F.lit("orders/"), F.col("y").cast("string")).alias("path"), "sha256")
    return PV.fingerprint(files)


@query("s18_experiment_records", sql("""
select season, round_even(sum(fp), 0) as total, season % 3 = 0 as superseded, case when season % 3 = 0 then 'rerun' end as reason from seasons where season % 4 <> 1 group by season""", "seasons"))
def s18(spark, d):
    path = scratch_path(spark, "records")
    per = A.seasons(spark, d).groupBy("season").agg(F.rint(F.sum("fp")).alias("total"))
    doc = F.to_json(F.struct(F.concat(F.col("season").cast("string"), F.lit("-01-01")).alias("created_at"), F.lit("season").alias("kind"), "season", "total"))
    text = F.when(F.col("season") % 4 == 1, F.lit('{"created_at": broken')).otherwise(doc)
    per.select(text.alias("value"), "season").repartition("season").write.partitionBy("season").text(path)
    records = PV.read_records(spark, f"{path}/*", "created_at string, kind string, season int, total double").where(F.col("created_at").isNotNull())
    notes = records.where(F.col("season") % 3 == 0).select("file", "season", F.lit("rerun").alias("reason"))
    out = PV.annotate_records(records.withColumn("file", F.concat("file", F.col("season").cast("string"))), notes.select(F.concat("file", F.col("season").cast("string")).alias("file"), "reason"))
    return out.select("season", "total", (F.col("status") == "Superseded").alias("superseded"), "reason")


@query("s19_export_ranking", sql("""
select cast(row_number() over (order by vor desc, player_id) as int) as rank, player, position, proj, vor, auction from ranked_board order by vor desc, player_id limit 40""", "ranked_board"))
def s19(spark, d):
    path = scratch_path(spark, "export")
    PV.export_ranking(R.score_board(A.board(spark, d)), path, 40)
    return S.read_csv(spark, path, "rank int, player string, position string, proj double, vor double, auction int")


@query("st1_refresh_lake", "select user_id as player_id, cast(dayofmonth(ts) as int) as season, value from events")
def st1(spark, d):
    events = A.table(spark, d, "events")
    landing, target, checkpoint = (scratch_path(spark, n) for n in ("landing", "streamed", "checkpoint"))
    dataset = Dataset("events", True, frozenset({"season", "player_id"}))
    # every season is spread over several files, which arrive in batches of their own and in two runs
    for run in range(2):
        events.where(F.pmod("event_id", F.lit(2)) == run).repartition(3, "event_id").write.mode("append").parquet(landing)
        stream = ST.file_stream(spark, landing, events.schema, files_per_batch=1)
        ST.refresh_lake(stream, target, dataset, checkpoint, normalise=lambda b: b.select(
            F.col("user_id").alias("player_id"), F.dayofmonth("ts").alias("season"), "value", ST.FILE))
    return spark.read.parquet(target).select("player_id", "season", "value")


@query("st2_latest_snapshot", """
select user_id, event_type, ts, value from (select *, row_number() over (partition by user_id order by ts desc) as rn from events) where rn = 1""")
def st2(spark, d):
    schema = A.table(spark, d, "events").schema
    stream = ST.file_stream(spark, d, schema, "events.parquet").select("user_id", "ts", "event_type", "value")
    return ST.upsert_latest(stream, scratch_path(spark, "latest"), ["user_id"], ["ts"], scratch_path(spark, "checkpoint")).current().select("user_id", "event_type", "ts", "value")
