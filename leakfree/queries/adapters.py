"""The canonical frames themselves, checked against their SQL texts."""

from .. import adapters as A
from .base import query, sql

for _name, _fn, _cte in (
    ("v1_weekly", A.weekly, "weekly"), ("v2_seasons", A.seasons, "seasons"), ("v3_games", A.games, "games"),
    ("v4_reports", A.reports, "reports"), ("v5_rosters", A.rosters, "rosters"), ("v6_prop_lines", A.prop_lines, "prop_lines"),
    ("v7_name_variants", A.name_variants, "name_variants"), ("v8_draft_picks", A.draft_picks, "picks"), ("v9_board", A.board, "board"),
):
    query(_name, sql(f"select * from {_cte}", _cte))(_fn)
