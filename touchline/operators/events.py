"""Event preparation: remapped touches, the unified view, positions, leagues.

Events stay one row per touch with their qualifier array (``touch_events``) for
as long as possible; ``touches_view`` is the flattened form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import schema
from touchline.functions.expressions import has_qualifier

EVENT_COLUMNS = [
    "timestamp", "matchid", "teamid", "playerid", "x", "y", "typeid", "outcomeid", "qualifiers",
]


def remap_touches(touches: DataFrame, roster: DataFrame) -> DataFrame:
    """Copies of the roster players' touches, moved to imaginary teams and games.

    The match id is negated; team and player come from the roster.
    """
    moved = roster.select(
        "playerid", F.col("teamid").alias("_teamid"), F.col("altid").alias("_playerid")
    )
    return touches.join(moved, "playerid").select(
        "timestamp",
        (-F.col("matchid").try_cast("bigint")).cast("string").alias("matchid"),
        F.col("_teamid").alias("teamid"),
        F.col("_playerid").alias("playerid"),
        "x", "y", "typeid", "outcomeid", "qualifiers",
    )


def touch_events(touches: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Touches and extra touches as one table: numeric ids, whole seconds."""
    events = touches.select(*[c for c in ("eventid", *EVENT_COLUMNS) if c in touches.columns])
    if extra is not None:
        events = events.unionByName(extra.select(*EVENT_COLUMNS), allowMissingColumns=True)
    seconds = F.floor(F.unix_millis("timestamp") / 1000).cast("bigint")
    return events.withColumns(
        {
            "timestamp": seconds,
            **{name: F.col(name).try_cast("bigint") for name in ("matchid", "teamid", "playerid")},
        }
    )


def explode_qualifiers(events: DataFrame) -> DataFrame:
    """One row per (event, qualifier); an event without qualifiers keeps one row."""
    kept = [c for c in events.columns if c != "qualifiers"]
    return events.select(*kept, F.inline_outer("qualifiers"))


def touches_view(touches: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """The flattened view over both touch tables."""
    return explode_qualifiers(touch_events(touches, extra)).drop("eventid")


def position_summary(events: DataFrame) -> DataFrame:
    """Positions players took: match, time, team, player, position."""
    placed = events.filter(has_qualifier(schema.POSITION) & (F.col("playerid") != 0))
    return (
        explode_qualifiers(placed)
        .filter(F.col("type") == schema.POSITION)
        .select("matchid", "timestamp", "teamid", "playerid", F.lower("value").alias("position"))
    )


def latest_positions(positions: DataFrame) -> DataFrame:
    """Only the last position of each player in a match."""
    last = F.max_by("position", F.struct("timestamp", "position")).alias("position")
    return positions.groupBy("matchid", "teamid", "playerid").agg(last)


def ingested_leagues(matches: DataFrame) -> DataFrame:
    """Matches per competition and season."""
    return (
        matches.groupBy("competitionid", "competitionname", "seasonid")
        .agg(F.count("*").alias("match_count"))
        .drop("competitionid")
    )
