"""Small hand-made event tables."""

from datetime import datetime, timedelta, timezone

from touchline import schema

START = datetime(2014, 6, 12, 20, 0, 0, tzinfo=timezone.utc)


def touch(
    typeid, outcomeid=1, x=50.0, y=50.0, qualifiers=(), matchid="1", teamid=1, playerid=101,
    second=0, minute=1, periodid=1, eventid=1,
):
    return (
        eventid, matchid, teamid, playerid, START + timedelta(seconds=second), minute, periodid,
        typeid, outcomeid, float(x), float(y),
        None if qualifiers is None else [(kind, value) for kind, value in qualifiers],
    )


def touches(spark, rows):
    return spark.createDataFrame(rows, schema.TOUCHES)


def line_up(*players, matchid="1", position="Forward"):
    """Position rows for (teamid, playerid) pairs."""
    return [
        touch(34, qualifiers=[(44, position)], matchid=matchid, teamid=team, playerid=player,
              eventid=9000 + player)
        for team, player in players
    ]


def match_games(spark, rows):
    """Rows (matchid, teamid, op_teamid, is_home, day) with fixed league data."""
    return spark.createDataFrame(
        [
            (m, t, o, f"Team {t}", f"Team {o}", float(h), 1, 2014, START + timedelta(days=d))
            for m, t, o, h, d in rows
        ],
        schema.MATCH_GAMES,
    )


def by(frame, *keys):
    return {tuple(row[k] for k in keys): row for row in frame.collect()}
