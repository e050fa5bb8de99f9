"""Event tables derived from ``lineitem``, for tests, checks and benchmarks.

Row-wise expressions only: every line item is one touch, and all match data
follow from the match number. Each block of order keys has its own competitions,
teams and matches, so the match tables grow with the line items.

``touches`` and ``match_games`` are the raw tables of the event feed. They are
written once per session to the cluster's shared folder, and the operators scan
them like any stored table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.tables import materialise

MATCHES = 400  # of a block
ORDERS = 15_000  # order keys of a block

_stored: dict[tuple[str, str, str], DataFrame] = {}

_MATCH = f"l_orderkey div {ORDERS} * {MATCHES} + l_orderkey % {MATCHES}"

# block, competition, season, kick-off and the two teams (a at home, b away) of match m
_MATCH_FACTS = {
    "g": f"m div {MATCHES}",
    "c": "m % 4",
    "k": f"m % {MATCHES} div 4",
    "competitionid": "CAST(4 * g + c + 1 AS INT)",
    "seasonid": "CAST(2010 + k div 20 AS INT)",
    "t0": "1262304000 + k * 259200",
    "a": "20 * g + 5 * c + 1 + k % 5",
    "b": "20 * g + 5 * c + 1 + (k % 5 + 1 + (k div 5) % 4) % 5",
}

_TYPE_OF_CODE = """
    CASE WHEN code < 22 THEN 1 WHEN code = 22 THEN 4 WHEN code = 23 THEN 5 WHEN code = 24 THEN 6
         WHEN code <= 26 THEN 7 WHEN code <= 28 THEN 8 WHEN code = 29 THEN 10 WHEN code <= 31 THEN 13
         WHEN code = 32 THEN 14 WHEN code <= 34 THEN 15 WHEN code <= 36 THEN 16 WHEN code = 37 THEN 17
         WHEN code = 38 THEN 74 ELSE 32 END"""

_FIRST_QUALIFIER = """
    CASE WHEN typeid = 1 THEN 140
         WHEN typeid IN (13, 14, 15, 16) THEN CASE qty % 10
              WHEN 0 THEN 9 WHEN 1 THEN 24 WHEN 2 THEN 25 WHEN 3 THEN 26 WHEN 4 THEN 28
              WHEN 5 THEN 82 WHEN 6 THEN 160 ELSE 20 END
         WHEN typeid = 17 THEN 31 + qty % 3
         WHEN typeid = 10 THEN CASE WHEN qty % 4 = 0 THEN 94 ELSE 178 END
         WHEN qty % 4 = 0 THEN NULL ELSE 56 END"""

_TOUCH_FACTS = {
    "teamid": "CAST(CASE WHEN pk % 2 = 0 THEN a ELSE b END AS BIGINT)",
    "playerid": "teamid * 100 + sk % 11",
    "eventid": "ok * 10 + ln",
    "code": "(pk div 2 + sk * 3 + ln) % 40",
    "outcomeid": "CASE WHEN rf = 'R' THEN 0 ELSE 1 END",
    "x": "((sk * 7 + pk * 3 + ln * 11) % 1001) / CAST(10 AS DOUBLE)",
    "y": "((ok * 13 + pk * 5) % 1001) / CAST(10 AS DOUBLE)",
    "min": "CAST(((ok div 400) * 7 + ln * 13) % 95 + 1 AS INT)",
    "timestamp": "timestamp_seconds(t0 + min * 60 + ln)",
    "periodid": "CASE WHEN min > 92 THEN 5 WHEN min > 45 THEN 2 ELSE 1 END",
    "typeid": _TYPE_OF_CODE,
    "q1": _FIRST_QUALIFIER,
    "v1": "CASE WHEN typeid = 1 THEN CAST((qty * 19 + ln * 7) % 101 AS STRING) ELSE 'Center' END",
    "q2": "CASE WHEN typeid IN (4, 7, 8) AND qty % 3 = 0 AND qty % 4 <> 0 THEN 13 END",
    "qualifiers": """filter(array(
        named_struct('type', CAST(q1 AS INT), 'value', v1),
        named_struct('type', CAST(q2 AS INT), 'value', 'x')), q -> q.type IS NOT NULL)""",
    "matchid": "CAST(m AS STRING)",
}

TOUCH_COLUMNS = [
    "eventid", "matchid", "teamid", "playerid", "timestamp", "min", "periodid", "typeid",
    "outcomeid", "x", "y", "qualifiers",
]


def _derive(frame: DataFrame, facts: dict[str, str]) -> DataFrame:
    for name, expression in facts.items():
        frame = frame.withColumn(name, F.expr(expression))
    return frame


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match that occurs in the data."""
    numbers = _lineitem(spark, sf_dir).selectExpr(f"{_MATCH} m")
    return _derive(numbers.distinct(), _MATCH_FACTS)


def played_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The touches without the line-ups."""
    source = _lineitem(spark, sf_dir).selectExpr(
        "l_orderkey ok", "l_partkey pk", "l_suppkey sk", "CAST(l_linenumber AS BIGINT) ln",
        "CAST(l_quantity AS BIGINT) qty", "l_returnflag rf", f"{_MATCH} m",
    )
    return _derive(_derive(source, _MATCH_FACTS), _TOUCH_FACTS).select(*TOUCH_COLUMNS)


def line_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game markers that carry each player's position."""
    sides = games(spark, sf_dir).selectExpr(
        "m", "t0", "inline(array(struct(0 AS side, a AS team), struct(1 AS side, b AS team)))"
    )
    players = sides.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return players.selectExpr(
        "CAST(-(m * 100 + side * 50 + i + 1) AS BIGINT) eventid",
        "CAST(m AS STRING) matchid",
        "CAST(team AS BIGINT) teamid",
        "CAST(team * 100 + i AS BIGINT) playerid",
        "timestamp_seconds(t0) timestamp",
        "0 min", "1 periodid", "34 typeid", "1 outcomeid",
        "CAST(50 AS DOUBLE) x", "CAST(50 AS DOUBLE) y",
        """array(named_struct('type', 44, 'value',
             CASE WHEN i = 0 THEN 'Goalkeeper' WHEN i < 5 THEN 'Defender'
                  WHEN i < 9 THEN 'Midfielder' ELSE 'Forward' END)) qualifiers""",
    )


def _store_once(derive: Callable[[SparkSession, str], DataFrame]):
    """Write the derived table on first use in a session, then read it back."""

    @wraps(derive)
    def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        key = (application, sf_dir, derive.__name__)
        if key not in _stored:
            for ended in [k for k in _stored if k[0] != application]:
                del _stored[ended]
            _stored[key] = materialise(derive(spark, sf_dir))
        return _stored[key]

    return stored


@_store_once
def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw event table."""
    return played_touches(spark, sf_dir).unionByName(line_ups(spark, sf_dir))


@_store_once
def match_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per match: the home team's and the away team's."""
    return games(spark, sf_dir).selectExpr(
        "CAST(m AS STRING) matchid", "competitionid", "seasonid",
        "timestamp_seconds(t0) timestamp",
        """inline(array(
             struct(CAST(a AS BIGINT) AS teamid, CAST(b AS BIGINT) AS op_teamid, 1D AS is_home),
             struct(CAST(b AS BIGINT) AS teamid, CAST(a AS BIGINT) AS op_teamid, 0D AS is_home)))""",
    ).selectExpr(
        "matchid", "teamid", "op_teamid",
        "'Team ' || teamid team_name", "'Team ' || op_teamid op_team_name",
        "is_home", "competitionid", "seasonid", "timestamp",
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games(spark, sf_dir).selectExpr(
        "competitionid", "'League ' || competitionid competitionname", "seasonid"
    )


@_store_once
def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of the first two teams of each block, moved to imaginary teams."""
    players = line_ups(spark, sf_dir).select("playerid", "teamid").distinct()
    return players.filter("(teamid - 1) % 20 < 2").selectExpr(
        "playerid", "-teamid teamid", "-playerid altid"
    )


def home_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional home flags per team."""
    teams = match_games(spark, sf_dir).select("teamid").distinct()
    return teams.selectExpr("teamid", "(teamid % 11) / CAST(10 AS DOUBLE) is_home")
