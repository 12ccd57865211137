"""Contract checks and normalisers applied before a dataset is published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_present
from .registry import TEAM_COLUMNS, WEEKLY_POSITIONS, WEEKLY_RENAMES, Dataset


class ContractError(ValueError):
    """The data does not meet the minimum contract of its dataset."""


def column_problems(columns, dataset: Dataset) -> list[str]:
    """Missing required columns and unmet alternatives, found while planning."""
    have = set(columns)
    out = []
    missing = sorted(dataset.required - have)
    if missing:
        out.append(f"missing required columns: {missing}")
    out += [f"expected one of these columns: {sorted(a)}" for a in dataset.any_of if not have & a]
    return out


def season_report(df: DataFrame) -> DataFrame:
    """Rows and the distinct valid seasons, in one pass; the seasons are bounded by the calendar."""
    season = F.col("season").try_cast("double").cast("int") if "season" in df.columns else F.lit(None).cast("int")
    return df.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(season)).alias("seasons"))


def validate(df: DataFrame, dataset: Dataset, season: int | None = None) -> int:
    """Raise :class:`ContractError` unless the frame meets its contract; returns the row count."""
    problems = column_problems(df.columns, dataset)
    if not problems and season is not None and "season" not in df.columns:
        problems = ["seasonal asset has no season column"]
    if problems:
        raise ContractError(f"{dataset.name}: {'; '.join(problems)}")
    report = season_report(df).first()
    if not report["rows"]:
        raise ContractError(f"{dataset.name}: no rows")
    if season is not None:
        if not report["seasons"]:
            raise ContractError(f"{dataset.name}: no valid season values")
        if list(report["seasons"]) != [season]:
            raise ContractError(f"{dataset.name}: wanted season {season}, found {list(report['seasons'])}")
    return report["rows"]


def contract_report(df: DataFrame, dataset: Dataset) -> DataFrame:
    """One row per frame: the dataset, its rows and seasons, and what its columns lack."""
    problems = column_problems(df.columns, dataset)
    return season_report(df).select(
        F.lit(dataset.name).alias("dataset"), "rows", F.array_join("seasons", ",").alias("seasons"),
        F.lit("; ".join(problems)).alias("problems"))


def normalize_weekly(df: DataFrame, season: int | None = None) -> DataFrame:
    """Undo renames and keep the modelled positions."""
    out = df.withColumnsRenamed({a: b for a, b in WEEKLY_RENAMES.items() if a in df.columns and b not in df.columns})
    return out.where(F.col("position").isin(*WEEKLY_POSITIONS)) if "position" in out.columns else out


def normalize_depth(df: DataFrame, season: int | None = None) -> DataFrame:
    """Stamp a missing season and keep each team's own latest snapshot.

    Teams update on different days, so the latest date is taken per team, by aggregation and a join.
    """
    out = df
    if season is not None:
        if "season" not in out.columns:
            out = out.withColumn("season", F.lit(season))
        else:
            known = out.agg(F.count("season")).scalar()
            out = out.withColumn("season", F.when(known == 0, F.lit(season)).otherwise(F.col("season")))
    if "dt" not in out.columns:
        return out
    team = first_present(out, TEAM_COLUMNS)
    if team is None:
        latest = out.agg(F.max("dt")).scalar()
        return out.where(latest.isNull() | (F.col("dt") == latest))
    newest = out.groupBy(team).agg(F.max("dt").alias("__latest"))
    dated = out.agg(F.count("dt")).scalar()
    return out.join(newest, team, "left").where((dated == 0) | (F.col("dt") == F.col("__latest"))).drop("__latest")


NORMALIZERS = {"weekly": normalize_weekly, "depth_charts": normalize_depth}
