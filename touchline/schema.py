"""Table schemas and the fixed codes of the event feed."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# ---------------------------------------------------------------------------
# The event feed defines them, results depend on them.
# ---------------------------------------------------------------------------

# typeid of an event
PASS = 1
FOUL = 4
OUT = 5
CORNER = 6
TACKLE = 7
INTERCEPTIONS = (8, 74)
SAVE = 10
SHOTS_OFF_TARGET = (13, 14)
SHOTS_ON_TARGET = (15, 16)
SHOTS = (13, 14, 15, 16)
SHOTS_WITH_CHANCE = (14, 15, 16)
GOAL = 16
CARD = 17
GAME_MARKER = 34

# type of a qualifier
PENALTY = 9
FREE_KICK = (24, 16)
CORNER_KICK = 25
FREE_KICK_SHOT = 26
OWN_GOAL = 28
YELLOW = 31
RED = (32, 33)
POSITION = 44
BLOCKED = 82
NOT_A_SAVE = 94
PASS_END_X = 140
THROW_IN = 160
SET_PIECES_AND_OWN_GOALS = (9, 24, 25, 26, 28, 160)

# periodid of a penalty shoot-out
SHOOT_OUT = 5

# field zones: a coordinate belongs to the first edge it does not exceed
X_EDGES = (16.6, 33.2, 49.9, 66.4, 83.0)
Y_EDGES = (33.0, 66.0)

# expected goals: 1 at distance 1, else a + b * ln(distance), below a distance of 40
XG_INTERCEPT = 1.132464
XG_LOG_SLOPE = -0.303866
XG_MAX_DISTANCE = 40

# competition of the world cup, and the match left out of history features
WORLD_CUP = 4
EXCLUDED_MATCHES = ("442291",)

# order of the event transitions in a player's cumulative thresholds
TRANSITIONS = (
    "foul", "red_card", "yellow_card",
    "pass_0", "pass_1", "pass_2", "pass_3", "pass_4", "pass_5",
    "pass_attempt_0", "pass_attempt_1", "pass_attempt_2",
    "pass_attempt_3", "pass_attempt_4", "pass_attempt_5",
    "own_goal", "regular_goal", "regular_attempt",
    "corner_kick_goal", "corner_kick_attempt",
    "penalty_kick_goal", "penalty_kick_attempt",
    "free_kick_goal", "free_kick_attempt",
    "throwin_goal", "throwin_attempt",
)

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

QUALIFIERS = ArrayType(
    StructType([StructField("type", IntegerType()), StructField("value", StringType())])
)

TOUCHES = StructType(
    [
        StructField("eventid", LongType()),
        StructField("matchid", StringType()),
        StructField("teamid", LongType()),
        StructField("playerid", LongType()),
        StructField("timestamp", TimestampType()),
        StructField("min", IntegerType()),
        StructField("periodid", IntegerType()),
        StructField("typeid", IntegerType()),
        StructField("outcomeid", IntegerType()),
        StructField("x", DoubleType()),
        StructField("y", DoubleType()),
        StructField("qualifiers", QUALIFIERS),
    ]
)

ROSTER = StructType(
    [
        StructField("playerid", LongType()),
        StructField("teamid", LongType()),
        StructField("altid", LongType()),
    ]
)

MATCHES = StructType(
    [
        StructField("competitionid", IntegerType()),
        StructField("competitionname", StringType()),
        StructField("seasonid", IntegerType()),
    ]
)

MATCH_GAMES = StructType(
    [
        StructField("matchid", StringType()),
        StructField("teamid", LongType()),
        StructField("op_teamid", LongType()),
        StructField("team_name", StringType()),
        StructField("op_team_name", StringType()),
        StructField("is_home", DoubleType()),
        StructField("competitionid", IntegerType()),
        StructField("seasonid", IntegerType()),
        StructField("timestamp", TimestampType()),
    ]
)

HOME_ADVANTAGE = StructType(
    [
        StructField("Team", StringType()),
        StructField("power_ranking", IntegerType()),
        StructField("teamid", IntegerType()),
        StructField("is_home", DoubleType()),
    ]
)

PLAYER_MODEL = StructType(
    [
        StructField("playerid", LongType()),
        StructField("position", StringType()),
        StructField("move", ArrayType(DoubleType())),
        StructField("probability", ArrayType(ArrayType(DoubleType()))),
    ]
)
