"""Stored results kept up to date for the matches that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from touchline.operators.match_stats import match_goals
from touchline.sources.tables import replace_partitions, write_table

SEASON = ["competitionid", "seasonid"]


def _goals(touches: DataFrame, match_games: DataFrame) -> DataFrame:
    seasons = match_games.select("matchid", *SEASON).distinct()
    return match_goals(touches).join(seasons, "matchid")


def _by_season(goals: DataFrame) -> DataFrame:
    """Each season in one task, so that its folder gets one file; opening files is the work of the write.

    The number of tasks is fixed: by their few bytes all seasons would be put into one.
    """
    tasks = int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return goals.repartition(tasks, *SEASON)


def store_goals(touches: DataFrame, match_games: DataFrame, path: str) -> None:
    """Goals of all matches, one folder per competition and season; older ones are replaced."""
    write_table(_by_season(_goals(touches, match_games)), path, *SEASON)


def refresh_goals(touches: DataFrame, match_games: DataFrame, changed: DataFrame, path: str) -> None:
    """Rebuild the seasons of the changed matches (``matchid``) in what ``store_goals`` wrote.

    Only touches of those seasons are counted; all other folders keep their files. A
    season whose matches have no touches any more keeps its old folder.
    """
    seasons = match_games.join(changed.select("matchid").distinct(), "matchid", "left_semi").select(*SEASON).distinct()
    games = match_games.join(seasons, SEASON, "left_semi")
    recounted = touches.join(games.select("matchid").distinct(), "matchid", "left_semi")
    replace_partitions(_by_season(_goals(recounted, games)), path, *SEASON)
