"""The datasets of the lake: granularity, minimum contracts, drifted names.

A contract lists columns that must be present and sets of which at least one column must be present;
further columns are free.
"""

from __future__ import annotations

from dataclasses import dataclass

CONTRACT_VERSION = 1


@dataclass(frozen=True)
class Dataset:
    name: str
    seasonal: bool
    required: frozenset[str] = frozenset()
    any_of: tuple[frozenset[str], ...] = ()

    @property
    def partition(self) -> str | None:
        return "season" if self.seasonal else None


def _dataset(name: str, seasonal: bool, required: set[str], *any_of: set[str]) -> Dataset:
    return Dataset(name, seasonal, frozenset(required), tuple(map(frozenset, any_of)))


# Names, granularity and column contracts of the datasets.
DATASETS: dict[str, Dataset] = {d.name: d for d in (
    _dataset("weekly", True,
             {"player_id", "player_display_name", "position", "season", "week", "season_type", "recent_team",
              "opponent_team", "passing_yards", "passing_tds", "rushing_yards", "rushing_tds", "receptions",
              "receiving_yards", "receiving_tds"}),
    _dataset("pbp", True,
             {"game_id", "season", "week", "play_type", "yardline_100", "epa", "defteam", "pass", "rush", "sack",
              "qb_hit", "receiver_player_id", "rusher_player_id", "passer_player_id"}),
    _dataset("injuries", True,
             {"season", "week", "gsis_id", "position", "report_status", "practice_status"}),
    _dataset("snap_counts", True,
             {"season", "week", "pfr_player_id", "position", "offense_pct"}),
    _dataset("rosters", True,
             {"season", "team", "position", "status", "full_name", "gsis_id", "pfr_id"}),
    _dataset("schedules", False,
             {"game_id", "season", "game_type", "week", "away_team", "home_team", "away_score", "home_score",
              "spread_line", "total_line", "roof", "temp", "wind"}),
    _dataset("draft_picks", False,
             {"season", "round", "pick", "team", "gsis_id", "position"},
             {"pfr_player_name", "full_name", "player_name", "player"}),
    _dataset("depth_charts", True,
             {"season", "gsis_id"},
             {"team", "club_code", "recent_team"},
             {"position", "pos_abb"},
             {"full_name", "player_name", "football_name"}),
    _dataset("ngs_receiving", False,
             {"season", "week", "player_gsis_id", "avg_separation", "avg_cushion",
              "percent_share_of_intended_air_yards", "avg_yac_above_expectation", "catch_percentage"}),
    _dataset("ngs_passing", False,
             {"season", "week", "player_gsis_id", "completion_percentage_above_expectation", "avg_time_to_throw",
              "aggressiveness"}),
    _dataset("ngs_rushing", False,
             {"season", "week", "player_gsis_id", "rush_yards_over_expected_per_att", "efficiency",
              "percent_attempts_gte_eight_defenders"}),
    _dataset("pfr_pass", True,
             {"season", "week", "pfr_player_id", "passing_bad_throw_pct", "times_pressured_pct", "times_sacked"}),
    _dataset("pfr_rec", True,
             {"season", "week", "pfr_player_id", "receiving_broken_tackles", "receiving_drop_pct", "receiving_rat"}),
    _dataset("pfr_rush", True,
             {"season", "week", "pfr_player_id", "rushing_yards_before_contact_avg", "rushing_yards_after_contact_avg",
              "rushing_broken_tackles"}),
)}

# Renamed columns and the positions kept from the weekly source.
WEEKLY_RENAMES = {"team": "recent_team", "passing_interceptions": "interceptions"}
WEEKLY_POSITIONS = ("QB", "RB", "WR", "TE", "FB", "K")
# Columns that may hold a chart's team, in order of preference.
TEAM_COLUMNS = ("team", "club_code", "recent_team")
