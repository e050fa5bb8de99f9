"""Opponent pairing and features over each team's previous games."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import schema
from touchline.functions.expressions import guarded_ratio, points
from touchline.operators.match_stats import TEAM
from touchline.operators.ordered import lookback_blocks, ordered, with_position
from touchline.operators.ranges import band_join

_OWN = [
    "passes", "bad_passes", "pass_ratio", "corners", "fouls", "cards", "goals", "shots",
    "is_home", "team_name", "pass_80", "pass_70", "expected_goals", "on_target", "length",
]
_OPPONENT = [name for name in _OWN if name not in ("is_home", "length")]

# history feature -> the column of the paired summary it averages
HISTORY = {
    "avg_points": "points",
    "avg_goals": "goals",
    "op_avg_goals": "op_goals",
    **{
        name: name
        for name in (
            "pass_70", "pass_80", "op_pass_70", "op_pass_80",
            "expected_goals", "op_expected_goals",
            "passes", "bad_passes", "pass_ratio", "corners", "fouls", "cards", "shots",
            "op_passes", "op_bad_passes", "op_corners", "op_fouls", "op_cards", "op_shots",
            "goals_op_ratio", "shots_op_ratio", "pass_op_ratio",
        )
    },
}
GAME_COLUMNS = [
    "matchid", "teamid", "op_teamid", "competitionid", "seasonid", "is_home",
    "team_name", "op_team_name", "timestamp",
]


def games_with_stats(match_games: DataFrame, summary: DataFrame) -> DataFrame:
    """Match rows whose match has statistics."""
    return match_games.join(summary.select("matchid"), "matchid", "left_semi")


def team_game_op_summary(summary: DataFrame) -> DataFrame:
    """Each team's figures beside its opponent's (``op_``), ratios and points.

    The summary has one row for each of the two teams of a match. Reads ``summary`` twice, so pass a stored table.
    """
    cur, opp = summary.alias("cur"), summary.alias("opp")
    paired = cur.join(opp, F.col("cur.matchid") == F.col("opp.matchid")).filter(
        F.col("cur.teamid") != F.col("opp.teamid")
    )

    def ratio(name: str, default: Column) -> Column:
        return guarded_ratio(F.col(f"cur.{name}"), F.col(f"opp.{name}"), default)

    return paired.select(
        *[F.col(f"cur.{name}") for name in (*TEAM, *_OWN)],
        F.col("opp.teamid").alias("op_teamid"),
        *[F.col(f"opp.{name}").alias(f"op_{name}") for name in _OPPONENT],
        "cur.competitionid",
        "cur.seasonid",
        ratio("shots", F.col("cur.shots").cast("double")).alias("shots_op_ratio"),
        ratio("goals", F.col("cur.goals").cast("double")).alias("goals_op_ratio"),
        ratio("pass_ratio", F.lit(1.0)).alias("pass_op_ratio"),
        points(F.col("cur.goals"), F.col("opp.goals")).alias("points"),
        "cur.timestamp",
    )


def match_history(match_games: DataFrame, summary: DataFrame, size: int) -> DataFrame:
    """For each game of a team with ``size`` earlier games: those that have statistics.

    Every game is numbered within its team's order, sent to the ``size`` numbers
    that follow and joined there, so no join key holds more than ``size`` rows.
    """
    order = [F.col("teamid"), F.col("timestamp"), F.col("matchid")]
    numbered = with_position(ordered(match_games.select(*TEAM, "timestamp"), *order))
    first = numbered.groupBy("teamid").agg(F.min("_pos").alias("_first"))
    deep = numbered.join(first, "teamid").filter(F.col("_pos") - F.col("_first") >= size)
    earlier = games_with_stats(numbered, summary).select(
        "teamid",
        F.col("timestamp").alias("previous_timestamp"),
        F.col("matchid").alias("previous_match"),
        F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + size)).alias("_pos"),
    )
    return deep.join(earlier, ["teamid", "_pos"]).select(
        "teamid", "matchid", "timestamp", "previous_timestamp", "previous_match"
    )


def match_history_range(match_games: DataFrame, summary: DataFrame, size: int) -> DataFrame:
    """``match_history`` by times: rated games between the last and the ``size``-th last kick-off.

    This is the form that counts every game with a tied kick-off: where the
    bounds are ties, a game may have more than ``size`` previous games, itself among
    them. Ties are ordered by match id.
    """
    order = [F.col("teamid"), F.col("timestamp"), F.col("matchid")]
    numbered = with_position(ordered(match_games.select(*TEAM, "timestamp"), *order))

    def bound(steps: int, name: str) -> DataFrame:
        return numbered.select("teamid", (F.col("_pos") + steps).alias("_pos"), F.unix_micros("timestamp").alias(name))

    deep = numbered.join(bound(1, "_high"), ["teamid", "_pos"]).join(bound(size, "_low"), ["teamid", "_pos"])
    rated = games_with_stats(match_games, summary).select(
        "teamid", F.col("timestamp").alias("previous_timestamp"), F.col("matchid").alias("previous_match"),
        F.unix_micros("timestamp").alias("_at"),
    )
    asked = deep.select("teamid", "matchid", "timestamp", "_low", "_high")
    return band_join(rated, asked, ["teamid"], "_at", "_low", "_high").select(
        "teamid", "matchid", "timestamp", "previous_timestamp", "previous_match"
    )


def history_features(
    match_games: DataFrame,
    op_summary: DataFrame,
    size: int,
    excluded: Iterable[str] = schema.EXCLUDED_MATCHES,
) -> DataFrame:
    """Averages over the last ``size`` games of each team before each game.

    All games count towards the ``size``; the averages use those with statistics.
    A game is left out if its team has fewer earlier games, or none of them has
    statistics. The window form equals the join of ``match_history`` because a
    team's kick-off times are unique; a tie would be ordered by match id.
    """
    stats = op_summary.select(
        *TEAM, F.lit(True).alias("_rated"), *[F.col(s).alias(f"_{n}") for n, s in HISTORY.items()]
    )
    games = match_games.select(*GAME_COLUMNS).join(stats, TEAM, "left")
    blocks = lookback_blocks(games, ["teamid"], [F.col("timestamp"), F.col("matchid")], size)
    last_games = W.partitionBy("teamid", "_block").orderBy("_pos").rowsBetween(-size, -1)
    averaged = blocks.select(
        *GAME_COLUMNS,
        "_context",
        F.count("*").over(last_games).alias("_games"),
        F.count("_rated").over(last_games).alias("_with_stats"),
        *[F.avg(f"_{name}").over(last_games).alias(name) for name in HISTORY],
    )
    return averaged.filter(
        ~F.col("_context")
        & (F.col("_games") == size)
        & (F.col("_with_stats") > 0)
        & ~F.col("matchid").isin(*excluded)
    ).select(*GAME_COLUMNS, *HISTORY)


def history_features_with_goals(history: DataFrame, goals: DataFrame) -> DataFrame:
    """Add the outcome of the game itself: goals of both sides and points."""
    own = goals.select(*TEAM, "goals")
    other = goals.select(
        "matchid", F.col("teamid").alias("op_teamid"), F.col("goals").alias("op_goals")
    )
    return (
        history.join(own, TEAM)
        .join(other, ["matchid", "op_teamid"])
        .select(
            *GAME_COLUMNS,
            "goals",
            "op_goals",
            points(F.col("goals"), F.col("op_goals")).alias("points"),
            *HISTORY,
        )
    )


def competition_features(history: DataFrame, competition: int = schema.WORLD_CUP) -> DataFrame:
    """History features of one competition, by default the world cup."""
    return history.filter(F.col("competitionid") == competition)


def newest_first(frame: DataFrame) -> DataFrame:
    """The output order of the feature tables; the away row of a match comes first."""
    return frame.orderBy(F.desc("timestamp"), "matchid", "is_home")
