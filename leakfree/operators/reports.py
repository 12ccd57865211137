"""Pre-game report flags and status based penalties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, round_even, translate

# Severity of a report designation.
SEVERITY = {"Out": 3, "Doubtful": 2, "Questionable": 1}

# Roster codes of players who are not available.
INACTIVE_STATUS = {
    "RET": "retired", "RSR": "retired", "RES": "on injured reserve", "PUP": "on PUP",
    "NFI": "non-football injury", "E14": "exempt", "EXE": "on the exempt list", "CUT": "released",
    "UFA": "an unsigned free agent", "RFA": "an unsigned restricted FA", "SUS": "suspended",
    "RSN": "holding out (did not report)", "NWT": "holding out (not with team)",
}

# Live feed codes, their wording, and the ones that mean a certain absence.
LIVE_STATUS = {
    "Sus": "suspended", "DNR": "not reporting", "IR": "on injured reserve", "PUP": "on PUP",
    "NA": "on non-football injury", "COV": "on the COVID list", "Out": "out",
    "Doubtful": "doubtful", "Questionable": "questionable",
}
LIVE_SEVERE = ("Sus", "DNR", "IR", "PUP", "NA", "Out")

# Share of a projection kept under a roster status and under a live code.
STATUS_FACTOR = {
    "retired": 0.0, "released": 0.05, "an unsigned free agent": 0.4, "on injured reserve": 0.35,
    "on PUP": 0.5, "non-football injury": 0.5, "on the exempt list": 0.5, "suspended": 0.6,
    "holding out (did not report)": 0.65, "holding out (not with team)": 0.65, "an unsigned restricted FA": 0.6,
}
LIVE_FACTOR = {"IR": 0.35, "PUP": 0.5, "NA": 0.5, "Sus": 0.6, "DNR": 0.65, "Out": 0.9}

# Fixed value: team codes of the draft source that differ from the rest of the data.
DRAFT_TEAM_CODES = {
    "GNB": "GB", "KAN": "KC", "LAR": "LA", "LVR": "LV", "NOR": "NO", "NWE": "NE", "SFO": "SF", "TAM": "TB",
}


def report_flags(reports: DataFrame, keys: Sequence[str] = ("player_id", "season", "week")) -> DataFrame:
    """Worst designation and practice flags per entity and period (reports precede the game)."""
    status, practice = F.col("report_status"), F.col("practice_status")
    severity = F.lit(0)
    for code, level in SEVERITY.items():
        severity = F.when(status == code, level).otherwise(severity)
    return (
        reports.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(
            F.max(flag(status.isin(*SEVERITY))).alias("inj_on_report"),
            F.max(severity).alias("inj_status"),
            F.max(flag(practice.like("Did Not%"))).alias("practice_dnp"),
            F.max(flag(practice.like("Limited%"))).alias("practice_limited"),
        )
    )


def status_penalty(board: DataFrame, status: str = "status", live: str = "live_code") -> DataFrame:
    """Scale ``proj`` by the roster status, or by the live code when that is strictly smaller."""
    def factor(codes: dict, c: str):
        return F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col(c))

    by_status, by_live = F.coalesce(factor(STATUS_FACTOR, status), F.lit(1.0)), factor(LIVE_FACTOR, live)
    live_wins = by_live < by_status
    return board.withColumns({
        "avail": F.when(live_wins, F.concat(F.lit("live: "), F.col(live))).when(
            factor(STATUS_FACTOR, status).isNotNull(), F.col(status)
        ),
        "proj": round_even(F.col("proj") * F.when(live_wins, by_live).otherwise(by_status), 1),
    })


def map_team_codes(df: DataFrame, column: str = "team") -> DataFrame:
    return df.withColumn(column, translate(column, DRAFT_TEAM_CODES))
