"""State of a match at a point in time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.counters import STATE_COUNTERS
from touchline.operators.documents import document_lines
from touchline.operators.ranges import asof_join
from touchline.sources.tables import json_text

PLAYER = ["matchid", "teamid", "playerid"]
STATE_COLUMNS = [
    "matchid", "x", "y", "timestamp", "teamid", "position", "playerid", *STATE_COUNTERS,
]
_PLACE = ["position", "x", "y"]


def player_state_asof(state: DataFrame, at: float, matchid: int | None = None) -> DataFrame:
    """The last cumulative row of each player at or before time ``at`` (0 to 1).

    Rows of the same second are told apart by position, x and y (the highest
    wins). The last time of each player is a number, so it is hashed and combined before the
    shuffle; only the rows of that second are ranked. Reads ``state`` twice.
    """
    rows = state.filter(F.col("timestamp") <= at)
    if matchid is not None:
        rows = rows.filter(F.col("matchid") == matchid)
    last = rows.groupBy(*PLAYER).agg(F.max("timestamp").alias("timestamp"))
    order = W.partitionBy(*PLAYER).orderBy(*[F.desc(c) for c in (*_PLACE, *STATE_COUNTERS)])
    ranked = rows.join(last, [*PLAYER, "timestamp"]).withColumn("_rank", F.row_number().over(order))
    return ranked.filter("_rank = 1").select(*STATE_COLUMNS)


def state_requests(state: DataFrame, requests: DataFrame) -> DataFrame:
    """The last cumulative row of each player of a match, for many (matchid, at) at once.

    Returns ``at`` beside the state columns; players without a row by then are left out.
    Repeated requests are answered once. Reads ``state`` twice, so pass a stored table. Runs jobs.
    """
    players = state.select(*PLAYER).distinct()
    asked = requests.select("matchid", F.col("at").cast("double").alias("at")).distinct().join(players, "matchid")
    rows = state.select(*STATE_COLUMNS)
    found = asof_join(asked, rows, PLAYER, "at", "timestamp", [*_PLACE, *STATE_COUNTERS])
    return found.filter("found IS NOT NULL").select("at", "found.*")


def state_summary(state: DataFrame) -> DataFrame:
    """Every cumulative row joined with the rows of the same player and time.

    The join only repeats rows: a row appears once per row of its player, match,
    team and time, and one that lacks any of them joins with none and appears once. ``copies`` holds that
    number in place of the repeated rows. They are counted where the rows of a match are dealt to, without a join.
    """
    moment = ["playerid", "matchid", "timestamp", "teamid"]
    known = reduce(and_, [F.col(name).isNotNull() for name in moment])
    copies = F.when(known, F.count("*").over(W.partitionBy(*moment))).otherwise(1)
    return state.repartition("matchid").select(*STATE_COLUMNS, copies.alias("copies"))


def state_document(state: DataFrame) -> DataFrame:
    """The state summary as one JSON object per match, as ordered text lines.

    Write with ``write_document``, keys ``matchid`` and order ``teamid, timestamp,
    playerid, position, x, y``. Reads ``state`` twice, so pass a stored table.
    """
    order = ["teamid", "timestamp", "playerid", *_PLACE]
    rows = state_summary(state).withColumn("table", F.lit(0))
    places = state.select("matchid", *order, F.lit(0).alias("table"))
    return document_lines(rows, ["matchid"], ["state"], order, json_text(*STATE_COLUMNS, "copies"), places)
