"""Value over replacement, ranked boards and the reports built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, round_even
from ..functions.names import word_key
from ..session import once, stored
from .ordered import competition_rank, group_quantiles, row_numbers, top_per_group, top_values

POSITIONS = ("QB", "RB", "WR", "TE")
# The default league, and how much of a position's surplus survives streaming.
DEFAULT_LEAGUE = {
    "teams": 12, "budget": 200, "roster_spots": 15,
    "starters": {"QB": 1, "RB": 2, "WR": 3, "TE": 1}, "flex": 1,
}
STREAM_DISCOUNT = {"QB": 0.35, "TE": 0.5}
# Flexible slot pools and the positions they deepen, in this order.
FLEX_POOLS = (("flex", ("RB", "WR", "TE")), ("wrte", ("WR", "TE")), ("rbwr", ("RB", "WR")))
# Thresholds of the ceiling / floor flags and the length of a season.
SLEEPER_CEILING_RANK, SLEEPER_PROJ_RANK, SLEEPER_GAP = 24, 20, 10
ANCHOR_FLOOR_RANK, ANCHOR_PROJ_RANK = 12, 24
SEASON_GAMES = 17
OPEN_SHARE = 0.20
EVEN_TRADE = 5


def replacement_ranks(league: Mapping) -> dict[str, int]:
    """Rank at which each position reaches replacement level; flexible pools follow demand."""
    teams, starters = league["teams"], league["starters"]
    depth = {p: teams * starters.get(p, 0) for p in POSITIONS}
    for name, who in FLEX_POOLS:
        pool = teams * league.get(name, 0)
        demand = sum(depth[p] for p in who) or 1
        share = {p: round(pool * depth[p] / demand) for p in who}
        depth.update({p: depth[p] + share[p] for p in who})
    depth["QB"] += teams * league.get("superflex", 0)
    return depth


def replacement_rank_columns(teams: Column, starters: Mapping[str, Column], flex: Column, superflex: Column,
                             wrte: Column | None = None, rbwr: Column | None = None) -> dict[str, Column]:
    """:func:`replacement_ranks` for leagues held one per row."""
    depth = {p: teams * starters[p] for p in POSITIONS}
    pools = {"flex": flex, "wrte": wrte, "rbwr": rbwr}
    for name, who in FLEX_POOLS:
        if pools[name] is None:
            continue
        demand = sum((depth[p] for p in who[1:]), depth[who[0]])
        demand = F.when(demand == 0, 1).otherwise(demand)
        share = {p: F.rint(teams * pools[name] * depth[p] / demand).cast("int") for p in who}
        depth = depth | {p: depth[p] + share[p] for p in who}
    return depth | {"QB": depth["QB"] + teams * superflex}


def score_board(proj: DataFrame, league: Mapping = DEFAULT_LEAGUE, value: str = "proj", ident: str = "player_id") -> DataFrame:
    """Add value over replacement and auction price.

    The replacement row of a position is the one at its replacement rank, or the last one. Only the
    best rows per position are needed for it, so no position is ever sorted whole; the replacement
    values, one per position of the league, come back as a single map instead of a join on position.
    """
    proj, ranks = once(proj, "board"), replacement_ranks(league)
    deepest = max(ranks.values()) + 1
    best = top_per_group(
        proj.where(F.col(value).isNotNull()), ["position"], [F.col(value).desc(), F.col(ident).asc()], deepest, "__rn")
    limit = F.element_at(F.create_map(*[F.lit(x) for p, r in ranks.items() for x in (p, r + 1)]), F.col("position"))
    repl = best.where(F.col("__rn") <= limit).groupBy("position").agg(F.max_by(value, "__rn").alias("v")).where(F.col("position").isin(*ranks))
    by_position = repl.agg(F.map_from_entries(F.collect_list(F.struct("position", "v")))).scalar()
    discount = F.coalesce(F.element_at(
        F.create_map(*[F.lit(x) for kv in STREAM_DISCOUNT.items() for x in kv]), F.col("position")), F.lit(1.0))
    valued = proj.withColumn("__repl", F.element_at(by_position, F.col("position"))).withColumn(
        "vor", round_even((F.col(value) - F.col("__repl")) * discount, 1)).drop("__repl")
    surplus = F.greatest(F.coalesce("vor", F.lit(0.0)), F.lit(0.0))
    cents = F.sum((surplus * 10).cast("decimal(18,0)")).cast("double") / 10
    total = valued.agg(F.when(cents == 0, 1.0).otherwise(cents)).scalar()
    pool = league["teams"] * (league["budget"] - league["roster_spots"])
    return valued.withColumn("auction", F.rint(1 + surplus / total * F.lit(float(pool))).cast("int"))


def upside_flags(board: DataFrame, shape: DataFrame) -> DataFrame:
    """Ceiling, floor and the sleeper / anchor flags.

    The flags only depend on the first ranks of a position, so ranks are looked up in tables of the
    best distinct values; a value beyond them has a rank beyond every threshold.
    """
    base = once(board.join(shape.select("player_id", "u_ceiling", "u_floor"), "player_id", "left"), "shaped")
    b = base
    far = SLEEPER_CEILING_RANK + SLEEPER_GAP
    for c, k, out in (("u_ceiling", SLEEPER_CEILING_RANK, "__ceil"), ("u_floor", ANCHOR_FLOOR_RANK, "__floor"),
                      ("proj", far, "__proj")):
        b = b.join(top_values(base, ["position"], c, k, out), ["position", c], "left")
    proj_rank = F.coalesce("__proj", F.when(F.col("proj").isNotNull(), far + 1))
    ceil_rank = F.col("__ceil")
    sleeper = (ceil_rank <= SLEEPER_CEILING_RANK) & (proj_rank >= SLEEPER_PROJ_RANK) & (proj_rank - ceil_rank >= SLEEPER_GAP)
    anchor = (F.col("__floor") <= ANCHOR_FLOOR_RANK) & (proj_rank <= ANCHOR_PROJ_RANK)
    return b.select(
        *board.columns, round_even("u_ceiling", 1).alias("ceiling"), round_even("u_floor", 1).alias("floor"),
        F.coalesce(sleeper, F.lit(False)).alias("sleeper"), F.coalesce(anchor, F.lit(False)).alias("anchor"))


def upside_bonus(board: DataFrame, ceiling: str, weight: float) -> DataFrame:
    """Raise projections whose ceiling lies above the position's median ceiling."""
    med = stored(group_quantiles(board, ["position"], ceiling, [0.5], ["__med"]))
    bonus = F.coalesce(F.col(ceiling) - F.col("__med"), F.lit(0.0)) * SEASON_GAMES
    lifted = round_even(F.greatest(F.col("proj") + F.lit(weight) * bonus, F.lit(0.0)), 1)
    return board.join(med, "position", "left").withColumn("proj", lifted).drop("__med")


def consensus_delta(board: DataFrame, adp: DataFrame) -> DataFrame:
    """Own overall rank, the market's rank by loose name, and the difference."""
    return market_delta(competition_rank(once(board), [], "vor", "our_rank"), adp)


def market_delta(ranked: DataFrame, adp: DataFrame) -> DataFrame:
    """The market's rank by loose name beside ``our_rank``, and the difference."""
    best = adp.select(word_key("player").alias("__k"), F.col("adp").try_cast("double").alias("adp")).where(
        F.col("adp").isNotNull()).groupBy("__k").agg(F.min("adp").alias("adp"))
    return ranked.withColumn("__k", word_key("player")).join(best, "__k", "left").drop("__k").withColumn(
        "adp_delta", F.rint(F.col("adp") - F.col("our_rank")))


def schedule_ahead(board: DataFrame, team: DataFrame, ahead: DataFrame) -> DataFrame:
    """Difficulty of the road ahead of every row's team and position."""
    return board.drop("team").join(team, "player_id", "left").join(ahead, ["team", "position"], "left").withColumn(
        "sched_ahead", round_even("sched_ahead", 3)).drop("team")


def schedule_rank(board: DataFrame, team: DataFrame, ahead: DataFrame) -> DataFrame:
    """Difficulty of the road ahead and its rank within the position (1 = easiest)."""
    return competition_rank(once(schedule_ahead(board, team, ahead)), ["position"], "sched_ahead", "sched_rank")


def room_leader(room: DataFrame, keys: Sequence[str] = ("team", "position")) -> DataFrame:
    """Who leads each room: market rank first (unknown last), then score, then name."""
    order = F.struct(F.coalesce("adp", F.lit(1e9)), -F.col("score"), F.col("player"))
    return room.groupBy(*keys).agg(F.min_by(F.struct("player", "score"), order).alias("__t")).select(
        *keys, F.col("__t.player").alias("top_player"), F.col("__t.score").alias("top_score"))


def sort_match(df: DataFrame, group: Sequence[str], order: str, value: str, ident: str, only: Column) -> DataFrame:
    """Within a group, give the i-th entity by ``order`` the i-th largest value.

    Entities without an order keep their value, and so do groups with fewer than two ordered members.
    Values and entities are numbered separately and joined on (group, number).
    """
    keyed = df.where(only & F.col(order).isNotNull() & F.col(group[0]).isNotNull()).select(*group, ident, order, value)
    a = row_numbers(keyed, group, [F.col(order).asc(), F.col(value).desc(), F.col(ident).asc()], "__i").select(*group, "__i", ident)
    b = row_numbers(keyed, group, [F.col(value).desc(), F.col(ident).asc()], "__i").select(*group, "__i", F.col(value).alias("__v"))
    big = keyed.groupBy(*group).agg(F.count("*").alias("__n")).where(F.col("__n") >= 2)
    new = a.join(b, [*group, "__i"]).join(big, list(group), "left_semi").select(ident, round_even("__v", 1).alias("__v"))
    return df.join(new, ident, "left").withColumn(value, F.coalesce("__v", value)).drop("__v")


def board_ranks(board: DataFrame, value: str = "vor", ident: str = "player_id") -> DataFrame:
    """Overall and positional place of every row (best first, ties by id)."""
    order = [F.col(value).desc_nulls_last(), F.col(ident).asc()]
    placed = row_numbers(board, [], order, "overall_rank")
    return row_numbers(placed, ["position"], order, "position_rank")


def compare(ranked: DataFrame, asked: DataFrame, group: str) -> DataFrame:
    """Asked players with their ranks; the best value of each comparison is flagged."""
    first = ranked.groupBy(word_key("player").alias("__k")).agg(
        F.min_by(F.struct("player_id", "player", "position", "vor", "auction", "overall_rank", "position_rank"), "overall_rank").alias("b"))
    hit = asked.select(group, word_key("player").alias("__k")).join(first, "__k").select(group, "b.*")
    best = hit.groupBy(group).agg(F.max_by("player_id", F.struct("vor", -F.col("overall_rank"))).alias("__best"))
    return hit.join(best, group).withColumn("best_value", F.col("player_id") == F.col("__best")).drop("__best")


def keeper_surplus(ranked: DataFrame, keepers: DataFrame, teams: int = 12) -> DataFrame:
    """Value minus cost of keeping a player; a round costs what the top of that round is worth."""
    first = ranked.groupBy(word_key("player").alias("__k")).agg(
        F.max_by(F.struct("player", "position", "auction"), "overall_rank").alias("b"))
    prices = ranked.select((F.col("overall_rank") - 1).alias("__rank"), F.col("auction").alias("__price"))
    asked = keepers.select(*keepers.columns, word_key("player").alias("__k"),
                           F.greatest(F.lit(0), (F.col("cost").cast("int") - 1) * teams).alias("__rank"))
    hit = asked.withColumnRenamed("player", "asked").join(first, "__k").join(prices, "__rank", "left")
    cost = F.when(F.col("cost_type") == "auction", F.col("cost").cast("double")).otherwise(
        F.coalesce(F.col("__price").cast("double"), F.lit(1.0)))
    return hit.select(
        *[c if c != "player" else F.col("asked") for c in keepers.columns if c not in ("cost", "cost_type")],
        "b.player", "b.position", F.col("b.auction").alias("value"), F.rint(cost).cast("int").alias("cost"),
        F.rint(F.col("b.auction") - cost).cast("int").alias("surplus"))


def trade_totals(board: DataFrame, sides: DataFrame) -> DataFrame:
    """Totals per side of many trades, the difference and a verdict."""
    first = board.groupBy(word_key("player").alias("__k")).agg(
        F.max_by(F.struct("auction", "vor"), F.struct("vor", "player_id")).alias("b"))
    got = sides.select("trade_id", "side", word_key("player").alias("__k")).join(first, "__k")

    def total(side: str, c: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col(f"b.{c}")).otherwise(0))

    t = got.groupBy("trade_id").agg(
        total("a", "auction").cast("bigint").alias("auction_a"), total("b", "auction").cast("bigint").alias("auction_b"),
        round_even(total("a", "vor"), 1).alias("vor_a"), round_even(total("b", "vor"), 1).alias("vor_b"))
    diff = F.col("auction_a") - F.col("auction_b")
    return t.withColumns({"diff": diff, "verdict": (
        F.when(F.abs(diff) <= EVEN_TRADE, "roughly even")
        .when(diff > 0, F.concat(F.lit("Side A wins by $"), diff.cast("string")))
        .otherwise(F.concat(F.lit("Side B wins by $"), (-diff).cast("string"))))})


def multi_year_value(board: DataFrame, curves: DataFrame, years: int = 4, discount: float = 0.85,
                     ages: tuple[int, int] = (21, 36), default_age: int = 27) -> DataFrame:
    """Discounted value over the coming years, aged along the position's curve."""
    b = board.withColumn("age", F.coalesce(F.col("age"), F.lit(default_age)).cast("int"))
    years_ahead = b.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(years - 1)))).withColumn(
        "__age", F.col("age") + F.col("__t")).withColumn("__base_age", F.least(F.greatest("age", F.lit(ages[0])), F.lit(ages[1])))
    ahead = curves.select("position", F.col("age").alias("__age"), F.col("curve").alias("__c"))
    base = curves.select("position", F.col("age").alias("__base_age"), F.col("curve").alias("__b"))
    j = years_ahead.join(ahead, ["position", "__age"], "left").join(base, ["position", "__base_age"], "left")
    worth = F.greatest(F.col("vor"), F.lit(0.0)) * (F.coalesce("__c", F.lit(0.0)) / F.coalesce("__b", F.lit(1.0))) * F.pow(F.lit(discount), F.col("__t"))
    total = j.groupBy("player_id").agg(round_even(F.sum(worth), 1).alias("dynasty_value"))
    return b.join(total, "player_id")


def open_competition(board: DataFrame, shares: DataFrame) -> DataFrame:
    """Opportunity shares beside the board, flagged where much of the room's volume left."""
    b = board.join(shares.select("player_id", "opp_share", "vac_share"), "player_id", "left")
    return b.withColumns({
        "opp_share": round_even("opp_share", 2), "vac_share": round_even("vac_share", 2),
        "opp_open": flag(round_even("vac_share", 2) >= OPEN_SHARE).cast("boolean")})


def best_available(board: DataFrame, taken: DataFrame, position: str | None = None, n: int = 15) -> DataFrame:
    """The best remaining rows by value, taken names excluded (a sorted limit, not a full sort)."""
    from .joins import without_names

    rest = without_names(board, taken)
    if position:
        rest = rest.where(F.col("position") == position)
    return rest.orderBy(F.col("vor").desc(), F.col("player_id").asc()).limit(n)


def shortlist(df: DataFrame, group: Sequence[str], value: str, ident: str, k: int = 6) -> DataFrame:
    """The first ``k`` per group by value."""
    return top_per_group(df, group, [F.col(value).desc(), F.col(ident).asc()], k)


def top_k_by_table(df: DataFrame, group: str, order: Sequence[Column], sizes: Mapping[str, int], default: int) -> DataFrame:
    """The first k rows per group, k depending on the group."""
    deepest = max([*sizes.values(), default])
    k = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(group)), F.lit(default))
    return top_per_group(df, [group], order, deepest).where(F.col("rn") <= k)


def latest_per_entity(df: DataFrame, entity: str, order: Sequence[Column]) -> DataFrame:
    """The last row per entity under a total order, by aggregation."""
    rest = [c for c in df.columns if c != entity]
    return df.groupBy(entity).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(entity, "__v.*")


