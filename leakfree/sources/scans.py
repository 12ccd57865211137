"""Reading the lake and the loose text and JSON inputs around it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import letter_key
from ..functions.scoring import RULE_DEFAULTS, rules_label_column


def union_by_name(frames: Sequence[DataFrame], types: Mapping[str, str] | None = None) -> DataFrame:
    """All rows of all frames by column name; absent columns are null.

    Columns whose type differs between frames are cast to the registered type, or to string.
    """
    seen: dict[str, set[str]] = {}
    for f in frames:
        for field in f.schema.fields:
            seen.setdefault(field.name, set()).add(field.dataType.simpleString())
    casts = {c: (types or {}).get(c, "string") for c, t in seen.items() if len(t) > 1}
    casts |= {c: t for c, t in (types or {}).items() if c in seen and seen[c] != {t}}
    out = None
    for f in frames:
        f = f.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items() if c in f.columns})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def read_dataset(spark: SparkSession, paths: str | Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """A dataset from one directory (schemas merged) or from its season parts (types reconciled)."""
    if isinstance(paths, str):
        return spark.read.option("mergeSchema", "true").parquet(paths)
    return union_by_name([spark.read.parquet(p) for p in paths], types)


def attach(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Make a dataset available to SQL under its name."""
    df.createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass over the data)."""
    return spark.read.csv(path, header=True, schema=schema)


def parse_line_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Prop lines from free text: rows with fewer than five fields or unreadable numbers are dropped."""
    parts = F.transform(F.split(column, ","), lambda p: F.trim(p))
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 5)
    number = {"line": 2, "over_odds": 3, "under_odds": 4}
    out = rows.select(
        F.col("p")[0].alias("player"), F.col("p")[1].alias("market"),
        *[F.col("p")[i].try_cast("double").alias(n) for n, i in number.items()])
    return out.where(F.col("line").isNotNull() & F.col("over_odds").isNotNull() & F.col("under_odds").isNotNull())


# First lines that are a header, not a name.
NAME_HEADERS = ("player", "name", "players", "player_name")


def parse_name_lists(lists: DataFrame, key: str, text: str) -> DataFrame:
    """Names from many lists: the first field of each line, unquoted; blanks and a header line are skipped."""
    lines = lists.select(key, F.posexplode(F.split(text, "\n")).alias("place", "line"))
    name = F.trim(F.regexp_replace(F.trim(F.split_part(F.trim("line"), F.lit(","), F.lit(1))), '^"+|"+$', ""))
    named = lines.select(key, "place", name.alias("player"))
    header = (F.col("place") == 0) & F.lower("player").isin(*NAME_HEADERS)
    return named.where((F.col("player") != "") & ~header)


LIVE_FIELDS = ("gsis_id string, full_name string, position string, team string, injury_status string, "
               "injury_body_part string, injury_notes string, news_updated bigint")


def live_rows(blobs: DataFrame, column: str = "value") -> DataFrame:
    """Availability rows from JSON maps id -> object.

    Values that are no objects, and players without team or position, are dropped; so are placeholder
    duplicates. Ids are trimmed, empty texts become null and milliseconds become a date (UTC).
    """
    entries = blobs.select(F.explode(F.from_json(column, "map<string,string>")).alias("id", "raw"))
    objects = entries.where(F.col("raw").startswith("{")).select(F.from_json("raw", LIVE_FIELDS).alias("p"))

    def text(c: str) -> Column:
        return F.nullif(F.col(f"p.{c}"), F.lit(""))

    usable = text("team").isNotNull() & text("position").isNotNull()
    named = ~F.coalesce(F.col("p.full_name") == "Duplicate Player", F.lit(False))
    return objects.where(usable & named).select(
        F.nullif(F.trim("p.gsis_id"), F.lit("")).alias("gsis_id"), letter_key("p.full_name").alias("name_key"),
        F.col("p.position").alias("position"), F.col("p.team").alias("team"), text("injury_status").alias("live_code"),
        text("injury_body_part").alias("live_body"), text("injury_notes").alias("live_note"),
        F.to_date(F.timestamp_millis(F.nullif(F.col("p.news_updated"), F.lit(0)))).alias("news_date"))


# League JSON keys per scoring rule.
SCORING_KEYS = {
    "pass_yd": "pass_yd", "pass_td": "pass_td", "interception": "pass_int", "rush_yd": "rush_yd", "rush_td": "rush_td",
    "reception": "rec", "rec_yd": "rec_yd", "rec_td": "rec_td", "te_reception_bonus": "bonus_rec_te",
    "fumble_lost": "fum_lost", "two_pt": "rec_2pt", "special_teams_td": "st_td",
    "fg_0_39": "fgm_30_39", "fg_40_49": "fgm_40_49", "fg_50_plus": "fgm_50p", "pat": "xpm", "fg_miss": "fgmiss",
    "dst_sack": "sack", "dst_int": "int", "dst_fumble_rec": "fum_rec", "dst_td": "def_td", "dst_safety": "safe",
    "dst_block": "blk_kick", "bonus_rush_100": "bonus_rush_yd_100", "bonus_rec_100": "bonus_rec_yd_100",
    "bonus_pass_300": "bonus_pass_yd_300",
}


def league_rules(leagues: DataFrame, key: str, settings: str) -> DataFrame:
    """Scoring rules of many leagues as columns, each key with its default, and the preset they equal."""
    parsed = leagues.select(key, F.from_json(settings, "map<string,string>").alias("s"))
    rules = {
        r: F.coalesce(F.col("s")[k].try_cast("double"), F.lit(RULE_DEFAULTS[r])) for r, k in SCORING_KEYS.items()
    }
    return parsed.select(key, *[c.alias(r) for r, c in rules.items()], rules_label_column(rules).alias("scoring"))


ROSTER_POSITIONS = ("QB", "RB", "WR", "TE", "K", "DEF")
# Lineup tokens of the flexible slots.
SUPERFLEX_TOKENS = ("SUPER_FLEX", "SUPERFLEX", "OP")
WRTE_TOKENS = ("REC_FLEX", "WT_FLEX", "WRTE_FLEX")
RBWR_TOKENS = ("WRRB_FLEX", "RBWR_FLEX", "RB_WR")
DEFENCE_TOKENS = ("DST", "D/ST")
LEAGUE_TYPES = {0: "redraft", 1: "keeper", 2: "dynasty"}


def lineup_slots(leagues: DataFrame, key: str, positions: str) -> DataFrame:
    """Lineup slot counts of many leagues from their arrays of tokens; bench and other slots are ignored."""
    token = F.upper("__t")
    t = F.when(token.isin(*DEFENCE_TOKENS), "DEF").otherwise(token)
    kind = (
        F.when(t.isin(*ROSTER_POSITIONS), t).when(t.isin(*SUPERFLEX_TOKENS), "superflex").when(t.isin(*WRTE_TOKENS), "wrte")
        .when(t.isin(*RBWR_TOKENS), "rbwr").when(t.contains("FLEX"), "flex"))
    rows = leagues.select(key, F.explode_outer(F.from_json(positions, "array<string>")).alias("__t")).select(key, kind.alias("__k"))
    names = [*ROSTER_POSITIONS, "flex", "superflex", "wrte", "rbwr"]
    return rows.groupBy(key).agg(*[F.count_if(F.col("__k") == n).alias(n) for n in names])


def _display_name(fallback: Column) -> Column:
    defence = F.concat(F.coalesce(F.nullif(F.col("team"), F.lit("")), fallback), F.lit(" DST"))
    return F.when(F.col("position") == "DEF", defence).otherwise(F.nullif(F.col("full_name"), F.lit("")))


def league_rosters(leagues: DataFrame, key: str, rosters: str, players: DataFrame, user: str | None = None) -> DataFrame:
    """Every rostered player of many leagues by name, with the owner; ``mine`` marks the user's roster.

    ``players`` is a table (player_id, full_name, position, team); defences are named after their team.
    """
    schema = "array<struct<owner_id:string, roster_id:bigint, players:array<string>>>"
    own = [F.col(user).cast("string").alias("__user")] if user else [F.lit(None).cast("string").alias("__user")]
    teams = leagues.select(key, *own, F.inline(F.from_json(rosters, schema)))
    owner = F.coalesce(F.col("owner_id"), F.concat(F.lit("roster "), F.col("roster_id").cast("string")))
    rows = teams.select(key, owner.alias("owner"), F.coalesce(F.col("owner_id") == F.col("__user"), F.lit(False)).alias("mine"),
                        F.explode("players").alias("player_id"))
    named = rows.join(players, "player_id").select(
        key, "owner", "mine", "position", _display_name(F.col("player_id")).alias("player"))
    return named.where(F.col("player").isNotNull())


def picked_names(leagues: DataFrame, key: str, picks: str, players: DataFrame) -> DataFrame:
    """Names already picked in each league."""
    rows = leagues.select(key, F.explode(F.from_json(picks, "array<struct<player_id:string>>")).alias("p")).select(
        key, F.col("p.player_id").alias("player_id"))
    return rows.join(players.where(F.nullif(F.col("full_name"), F.lit("")).isNotNull()), "player_id").select(key, F.col("full_name").alias("player"))


def league_summary(leagues: DataFrame, key: str, league: str) -> DataFrame:
    """Name, number of teams, format and scoring label of each league object."""
    schema = "name string, total_rosters int, settings struct<type:int>, scoring_settings string"
    j = leagues.select(key, F.from_json(league, schema).alias("j"))
    kinds = F.create_map(*[F.lit(x) for kv in LEAGUE_TYPES.items() for x in kv])
    rows = j.select(
        key, F.coalesce(F.nullif(F.col("j.name"), F.lit("")), F.lit("league")).alias("name"),
        F.coalesce("j.total_rosters", F.lit(0)).alias("teams"),
        F.coalesce(F.element_at(kinds, F.coalesce("j.settings.type", F.lit(0))), F.lit("redraft")).alias("type"),
        F.coalesce("j.scoring_settings", F.lit("{}")).alias("__s"))
    return rows.join(league_rules(rows, key, "__s").select(key, "scoring"), key).drop("__s")


# Fixed value: an entry of a ranking text, SLOT Name (rank).
RANKING_ENTRY = r"(?:QB|RB|WR|TE|K|DST|D/ST)\d?\s+([A-Z][A-Za-z.'\-]+(?:\s+[A-Za-z.'\-]+)*?)\s+\((\d+)\)"


def parse_rankings(texts: DataFrame, column: str = "text", source: str = "consensus") -> DataFrame:
    """Best rank per name over all texts; whole texts are searched."""
    names = F.regexp_extract_all(column, F.lit(RANKING_ENTRY), F.lit(1))
    ranks = F.regexp_extract_all(column, F.lit(RANKING_ENTRY), F.lit(2))
    pairs = texts.select(F.inline(F.arrays_zip(names.alias("player"), ranks.alias("rank"))))
    best = pairs.groupBy("player").agg(F.min(F.col("rank").try_cast("int")).alias("adp"))
    return best.withColumn("source", F.lit(source))
