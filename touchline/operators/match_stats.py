"""Statistics per team and match, all from one pass over the touches.

Every figure of ``team_game_summary`` is a conditional aggregate of the same
grouping, so one scan and one exchange of partial sums replace a scan per
figure. Only the match-level rows are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import schema
from touchline.functions.expressions import count_where, has_qualifier, is_qualified

TEAM = ["matchid", "teamid"]


def _is_scored() -> Column:
    return F.col("typeid") == schema.GOAL


def _is_own_goal() -> Column:
    return _is_scored() & has_qualifier(schema.OWN_GOAL)


def _is_raw_goal() -> Column:
    return _is_scored() & (F.col("periodid") != schema.SHOOT_OUT)


def _scores_or_marks() -> Column:
    return F.col("typeid").isin(schema.GOAL, schema.GAME_MARKER)


def _shot_distance() -> Column:
    across, along = 100 - F.col("x"), 50 - F.col("y")
    return F.round(F.sqrt(across * across + along * along))


def _is_chance() -> Column:
    """A shot whose chance can be rated: qualified, and neither blocked, set nor own goal."""
    return (
        F.col("typeid").isin(*schema.SHOTS_WITH_CHANCE)
        & is_qualified()
        & ~has_qualifier(
            schema.BLOCKED, schema.FREE_KICK_SHOT, schema.PENALTY, schema.OWN_GOAL
        )
        & (_shot_distance() < schema.XG_MAX_DISTANCE)
    )


def _goal_chance() -> Column:
    distance = _shot_distance()
    fitted = F.lit(schema.XG_INTERCEPT) + F.lit(schema.XG_LOG_SLOPE) * F.ln(distance)
    return F.when(distance == 1, F.lit(1.0)).otherwise(fitted)


def _pass_beyond(x: int) -> Column:
    return (F.col("typeid") == schema.PASS) & (F.col("x") > x) & (F.col("outcomeid") == 1)


def expected_goals(touches: DataFrame) -> DataFrame:
    """Shots with a rated chance: how many, goals, mean distance, expected goals."""
    return (
        touches.filter(_is_chance())
        .groupBy(*TEAM)
        .agg(
            F.count("eventid").alias("sot"),
            count_where(_is_scored()).alias("goals"),
            F.avg(_shot_distance()).alias("avgdist"),
            F.sum(_goal_chance()).alias("xG"),
        )
    )


def pass_stats(touches: DataFrame) -> DataFrame:
    """Completed passes from the last fifth and the last third of the field."""
    return (
        touches.filter(F.col("typeid") == schema.PASS)
        .groupBy(*TEAM)
        .agg(
            count_where(_pass_beyond(80)).alias("pass_80"),
            count_where(_pass_beyond(70)).alias("pass_70"),
        )
    )


def own_goals_by_team(touches: DataFrame) -> DataFrame:
    """Own goals, counted at the team that scored them."""
    return touches.filter(_is_own_goal()).groupBy(*TEAM).agg(F.count("*").alias("own_goals"))


def own_goal_credit(touches: DataFrame) -> DataFrame:
    """Own goals with the team they are credited to and the team they are taken from."""
    teams = touches.groupBy(*TEAM).agg(count_where(_is_own_goal()).alias("cnt"))
    scorers = teams.select("matchid", F.col("teamid").alias("deduct_team"), "cnt")
    return (
        teams.select("matchid", F.col("teamid").alias("credit_team"))
        .join(scorers.filter(F.col("cnt") > 0), "matchid")
        .filter(F.col("credit_team") != F.col("deduct_team"))
        .select("matchid", "credit_team", "deduct_team", "cnt")
    )


def raw_goals(touches: DataFrame) -> DataFrame:
    """Goals outside shoot-outs; game markers keep teams without a goal."""
    return (
        touches.filter(_scores_or_marks())
        .groupBy(*TEAM)
        .agg(
            count_where(_is_raw_goal()).alias("goals"),
            F.max(F.unix_micros("timestamp")).alias("timestamp"),
        )
    )


def _score_aggregates() -> list[Column]:
    return [
        count_where(_is_raw_goal()).alias("_raw_goals"),
        count_where(_is_own_goal()).alias("_own_goals"),
        F.max(F.when(_scores_or_marks(), F.unix_micros("timestamp"))).alias("_scored_at"),
        count_where(_scores_or_marks()).alias("_score_rows"),
    ]


def _with_final_goals(teams: DataFrame) -> DataFrame:
    """Move own goals to the other side; the window holds the two teams of a match.

    A team without an opponent keeps its own goals, and a team without a scoring
    or marker event has no score.
    """
    match = W.partitionBy("matchid")
    others = F.sum("_own_goals").over(match) - F.col("_own_goals")
    deducted = F.when(F.count("*").over(match) > 1, F.col("_own_goals")).otherwise(0)
    goals = F.when(F.col("_score_rows") > 0, F.col("_raw_goals") + others - deducted)
    return teams.withColumn("goals", goals)


def final_scores(totals: DataFrame) -> DataFrame:
    """Final score per team from aggregated touches, see ``match_goals``."""
    return (
        _with_final_goals(totals)
        .filter(F.col("_score_rows") > 0)
        .select(*TEAM, "goals", F.col("_scored_at").alias("timestamp"))
    )


def match_goals(touches: DataFrame) -> DataFrame:
    """Final score per team, own goals moved to the opponent; time in microseconds."""
    return final_scores(touches.groupBy(*TEAM).agg(*_score_aggregates()))


def team_totals(touches: DataFrame) -> DataFrame:
    """Everything the summary and the score need, counted in one pass over the touches."""
    typeid, done = F.col("typeid"), F.col("outcomeid") == 1
    passing = typeid == schema.PASS
    return touches.groupBy(*TEAM).agg(
        count_where(passing & done).alias("_passes"),
        count_where(passing & (F.col("outcomeid") == 0)).alias("_bad_passes"),
        count_where(passing).alias("_pass_rows"),
        count_where((typeid == schema.CORNER) & done).alias("_corners"),
        count_where((typeid == schema.FOUL) & done).alias("_fouls"),
        count_where(typeid.isin(*schema.SHOTS)).alias("_shots"),
        count_where(typeid == schema.CARD).alias("cards"),
        count_where(_pass_beyond(80)).alias("_pass_80"),
        count_where(_pass_beyond(70)).alias("_pass_70"),
        F.unix_millis(F.max("timestamp")).alias("timestamp"),
        F.max("min").alias("length"),
        F.count(F.when(_is_chance(), F.col("eventid"))).alias("_on_target"),
        F.sum(F.when(_is_chance(), _goal_chance())).alias("_xg"),
        *_score_aggregates(),
    )


def summary_of_totals(
    totals: DataFrame, match_games: DataFrame, goals: DataFrame | None = None
) -> DataFrame:
    """The team summary from ``team_totals``."""
    if goals is None:
        teams = _with_final_goals(totals)
    else:
        teams = totals.join(goals.select(*TEAM, "goals"), TEAM, "left")
    per_minute = {
        name: F.try_divide(f"_{name}", "length").alias(name)
        for name in (
            "passes", "bad_passes", "corners", "fouls", "shots",
            "pass_80", "pass_70", "on_target",
        )
    }
    tried = F.col("_passes") + F.col("_bad_passes") + 1
    games = match_games.select(*TEAM, "is_home", "team_name", "competitionid", "seasonid")
    return (
        teams.filter((F.col("teamid") != 0) & (F.col("_pass_rows") > 0))
        .join(games, TEAM)
        .select(
            *TEAM,
            per_minute["passes"],
            per_minute["bad_passes"],
            F.try_divide("_passes", tried).alias("pass_ratio"),
            per_minute["corners"],
            per_minute["fouls"],
            per_minute["shots"],
            "cards",
            per_minute["pass_80"],
            per_minute["pass_70"],
            "timestamp", "goals", "is_home", "team_name", "competitionid", "seasonid",
            F.coalesce("_xg", F.lit(0.0)).alias("expected_goals"),
            per_minute["on_target"],
            "length",
        )
    )


def team_game_summary(
    touches: DataFrame, match_games: DataFrame, goals: DataFrame | None = None
) -> DataFrame:
    """Per-minute rates, pass ratio, cards, goals and chances per team and match.

    ``goals`` is an optional stored score table (matchid, teamid, goals); by
    default the score comes from the same pass over the touches.
    """
    return summary_of_totals(team_totals(touches), match_games, goals)


def ingestion_multiplicity(touches: DataFrame) -> DataFrame:
    """How often the most repeated event of a match was ingested."""
    return (
        touches.groupBy("matchid", "eventid")
        .agg(F.count("eventid").alias("event_count"))
        .groupBy("matchid")
        .agg(F.max("event_count").alias("event_count"))
    )


def scale_ingested(summary: DataFrame, multiplicity: DataFrame) -> DataFrame:
    """Divide a summary's counts and rates by the multiplicity of its match."""
    scaled = {
        "passes", "bad_passes", "corners", "fouls", "shots", "cards", "pass_80", "pass_70",
        "goals", "expected_goals", "on_target",
    }
    return summary.join(multiplicity, "matchid").select(
        *[
            F.try_divide(name, "event_count").alias(name) if name in scaled else F.col(name)
            for name in summary.columns
        ]
    )


def team_game_summary_corrected(
    touches: DataFrame, match_games: DataFrame, goals: DataFrame | None = None
) -> DataFrame:
    """``team_game_summary`` scaled down where a match was ingested several times."""
    summary = team_game_summary(touches, match_games, goals)
    return scale_ingested(summary, ingestion_multiplicity(touches))


def team_stats(
    match_games: DataFrame,
    touches: DataFrame | None = None,
    stored: DataFrame | None = None,
    goals: DataFrame | None = None,
) -> DataFrame:
    """The team summary: corrected, from raw touches where there are any, else as stored."""
    if touches is not None:
        return team_game_summary_corrected(touches, match_games, goals)
    if stored is None:
        raise ValueError("either raw touches or a stored summary is needed")
    return stored


# Metadata and outcomes: columns a model must not see.
NON_FEATURE_COLUMNS = (
    "teamid", "op_teamid", "matchid", "competitionid", "seasonid",
    "goals", "op_goals", "points", "timestamp", "team_name", "op_team_name",
)


def get_non_feature_columns() -> list[str]:
    """Metadata and outcome columns, not to be used for prediction."""
    return list(NON_FEATURE_COLUMNS)


def get_feature_columns(all_columns: list[str]) -> list[str]:
    """The given columns without metadata and outcomes, in their order."""
    return [name for name in all_columns if name not in NON_FEATURE_COLUMNS]
