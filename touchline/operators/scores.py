"""Aggregates over the final scores of finished matches, and event thresholds."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schema
from touchline.functions.counters import PASS_ATTEMPTS, PASSES, SET_PIECES
from touchline.functions.expressions import count_where

ZONES_X = 6

# transition -> counters of the game summary to add and to subtract
_COUNTED_BY = {
    "foul": ("fouls", None),
    "red_card": ("red_cards", None),
    "yellow_card": ("yellow_cards", None),
    **{name: (name, None) for name in PASSES},
    **{attempt: (attempt, done) for attempt, done in zip(PASS_ATTEMPTS, PASSES)},
    "own_goal": ("own_goals", None),
    **{f"{piece}_goal": (f"{piece}_goals", None) for piece in ("regular", *SET_PIECES)},
    **{f"{piece}_attempt": (f"{piece}_missed", None) for piece in ("regular", *SET_PIECES)},
}


def score_history(goals: DataFrame, match_games: DataFrame) -> DataFrame:
    """One row per match: goals of the home side (0) and of the away side (1)."""
    sides = goals.join(match_games.select("matchid", "teamid", "is_home"), ["matchid", "teamid"])

    def goals_of(home: int) -> Column:
        return F.max(F.when(F.col("is_home") == home, F.col("goals")))

    return sides.groupBy("matchid").agg(
        goals_of(1).alias("goals0"), goals_of(0).alias("goals1")
    )


def _leader() -> Column:
    return (
        F.when(F.col("goals0") > F.col("goals1"), "team0")
        .when(F.col("goals0") == F.col("goals1"), "draw")
        .otherwise("team1")
    )


def outcome_counts(scores: DataFrame) -> DataFrame:
    """Matches per final score, with the leading side."""
    counted = scores.groupBy("goals0", "goals1").agg(F.count("*").alias("matches"))
    return counted.withColumn("leader", _leader())


def goal_distribution(scores: DataFrame) -> DataFrame:
    """Per side, the share of matches with 0, 1, ... goals up to its maximum."""
    sides = F.inline(
        F.array(
            F.struct(F.lit(0).alias("team"), F.col("goals0").cast("bigint").alias("goals")),
            F.struct(F.lit(1).alias("team"), F.col("goals1").cast("bigint").alias("goals")),
        )
    )
    counted = scores.select(sides).groupBy("team", "goals").agg(F.count("*").alias("matches"))
    per_team = counted.groupBy("team").agg(
        F.max("goals").alias("_most"), F.sum("matches").alias("_total")
    )
    every = per_team.withColumn("goals", F.explode(F.sequence(F.lit(0), F.col("_most"))))
    value = F.try_divide(F.coalesce("matches", F.lit(0)), F.col("_total"))
    return every.join(counted, ["team", "goals"], "left").select(
        "team", "goals", value.alias("value")
    )


def win_probability(scores: DataFrame) -> DataFrame:
    """Percent of matches won by side 0, drawn, and won by side 1, to 2 decimals."""

    def percent(test: Column) -> Column:
        return F.round(F.try_divide(100 * count_where(test), F.count("*")), 2)

    own, other = F.col("goals0"), F.col("goals1")
    return scores.agg(
        percent(own > other).alias("team0"),
        percent(own == other).alias("draw"),
        percent(own < other).alias("team1"),
    )


def transition_counts(summary: DataFrame) -> DataFrame:
    """How often each of the 26 transitions happened, per player and x zone.

    The classes are disjoint: a pass attempt is one that failed, a goal belongs to its
    set piece, an attempt at goal is one without a goal. ``summary`` is a game summary
    with the ``shot_outcomes`` counters.
    """
    counts = []
    for name in schema.TRANSITIONS:
        part, without = _COUNTED_BY[name]
        times = F.col(part) if without is None else F.col(part) - F.col(without)
        counts.append(F.sum(times).alias(name))
    # dealt before they are summed: a task that reads has nearly as many of these groups as rows
    rows = summary.withColumn("section", F.col("section_x")).repartition("playerid", "section")
    return rows.groupBy("playerid", "section").agg(*counts)


def _total() -> Column:
    return reduce(add, [F.col(name) for name in schema.TRANSITIONS])


def event_probabilities(summary: DataFrame) -> DataFrame:
    """Share of each of the 26 transitions in a player's counted events per x zone."""
    transitions = F.array(*[F.col(name) for name in schema.TRANSITIONS])
    return transition_counts(summary).select(
        "playerid", "section", _total().alias("_total"), F.posexplode(transitions)
    ).select(
        "playerid",
        "section",
        F.col("pos").alias("transition"),
        F.try_divide("col", "_total").alias("probability"),
    )


def event_cdf(summary: DataFrame) -> DataFrame:
    """Lower-edge thresholds over the ordered transitions per (player, section).

    Entry k is the summed probability of the transitions before k: a draw n
    selects the highest k with n above entry k. Running sums of one row's counts.
    """
    counts = F.array(*[F.col(name) for name in schema.TRANSITIONS])
    counted = transition_counts(summary).select("playerid", "section", _total().alias("_total"), counts.alias("_counts"))

    def below(k: Column) -> Column:
        before = F.aggregate(F.slice("_counts", 1, k), F.lit(0).cast("bigint"), lambda total, n: total + n)
        return F.coalesce(F.try_divide(before, F.col("_total")), F.lit(0.0))

    places = F.sequence(F.lit(0), F.lit(len(schema.TRANSITIONS) - 1))
    return counted.select("playerid", "section", F.transform(places, below).alias("thresholds"))


def player_models(summary: DataFrame, moves: DataFrame, positions: DataFrame) -> DataFrame:
    """One document per player: ``playerid``, ``position``, ``move``, ``probability``.

    ``move`` holds the lower-edge thresholds of the share of touches in each x zone,
    ``probability`` per x zone those of the transitions, empty where nothing was counted.
    A player with several positions has the first of them by name.
    """
    zones = F.sequence(F.lit(0), F.lit(ZONES_X - 1))
    per_zone = moves.groupBy("playerid", F.col("section_x").alias("section")).agg(F.sum("total_x").alias("n"))
    touches = per_zone.groupBy("playerid").agg(
        F.map_from_entries(F.collect_list(F.struct("section", "n"))).alias("_n"), F.sum("n").alias("_total")
    )

    def below(k: Column) -> Column:
        earlier = F.filter(F.map_entries("_n"), lambda e: e["key"] < k)
        before = F.aggregate(earlier, F.lit(0).cast("bigint"), lambda total, e: total + e["value"])
        return F.coalesce(F.try_divide(before, F.col("_total")), F.lit(0.0))

    acts = event_cdf(summary).groupBy("playerid").agg(
        F.map_from_entries(F.collect_list(F.struct("section", "thresholds"))).alias("_acts")
    )
    empty = F.array().cast("array<double>")
    known = positions.groupBy("playerid").agg(F.min("position").alias("position"))
    return touches.join(acts, "playerid").join(known, "playerid").select(
        "playerid", "position", F.transform(zones, below).alias("move"),
        F.transform(zones, lambda k: F.coalesce(F.try_element_at("_acts", k), empty)).alias("probability"),
    )


def model_thresholds(models: DataFrame) -> DataFrame:
    """Player documents as rows: ``kind`` (move or probability), ``section``, ``transition``, ``threshold``.

    A move threshold belongs to its section and has no transition. Missing arrays have no rows.
    """
    moves = models.select(
        "playerid", "position", F.lit("move").alias("kind"), F.posexplode("move").alias("section", "threshold")
    )
    sections = models.select("playerid", "position", F.posexplode("probability").alias("section", "_acts"))
    acts = sections.select(
        "playerid", "position", F.lit("probability").alias("kind"), "section",
        F.posexplode("_acts").alias("transition", "threshold"),
    )
    return moves.withColumn("transition", F.lit(None).cast("int")).unionByName(acts)
