"""The event tables, derived from lineitem in plain SQL."""

_SIDES = "SELECT m, t0, a team, 0 side FROM games UNION ALL SELECT m, t0, b, 1 FROM games"
_EVENT = "eventid, matchid, teamid, playerid, ts, mn, periodid, typeid, outcomeid, x, y"

CTES = {
    "src": """
        SELECT l_orderkey ok, l_partkey pk, l_suppkey sk, CAST(l_linenumber AS BIGINT) ln,
               CAST(l_quantity AS BIGINT) qty, l_returnflag rf,
               CAST(floor(l_orderkey / 15000) AS BIGINT) * 400 + l_orderkey % 400 m
        FROM lineitem""",
    "games": """
        SELECT m, 4 * g + c + 1 competitionid, 2010 + CAST(floor(k / 20) AS BIGINT) seasonid,
               1262304000 + k * 259200 t0, 20 * g + 5 * c + 1 + (k % 5) a,
               20 * g + 5 * c + 1 + ((k % 5) + 1 + (CAST(floor(k / 5) AS BIGINT) % 4)) % 5 b
        FROM (SELECT m, CAST(floor(m / 400) AS BIGINT) g, m % 4 c,
                     CAST(floor(m % 400 / 4) AS BIGINT) k
              FROM (SELECT DISTINCT m FROM src) z) s""",
    "raw_event": """
        SELECT s.m matchid, CASE WHEN pk % 2 = 0 THEN a ELSE b END teamid,
               (CASE WHEN pk % 2 = 0 THEN a ELSE b END) * 100 + sk % 11 playerid,
               ok * 10 + ln eventid, (CAST(floor(pk / 2) AS BIGINT) + sk * 3 + ln) % 40 code,
               CASE WHEN rf = 'R' THEN 0 ELSE 1 END outcomeid,
               ((sk * 7 + pk * 3 + ln * 11) % 1001) / CAST(10 AS DOUBLE) x,
               ((ok * 13 + pk * 5) % 1001) / CAST(10 AS DOUBLE) y,
               (CAST(floor(ok / 400) AS BIGINT) * 7 + ln * 13) % 95 + 1 mn, qty, t0, ln
        FROM src s JOIN games g ON s.m = g.m""",
    "typed_event": """
        SELECT eventid, matchid, teamid, playerid, t0 + mn * 60 + ln ts, mn,
               CASE WHEN mn > 92 THEN 5 WHEN mn > 45 THEN 2 ELSE 1 END periodid,
               CASE WHEN code < 22 THEN 1 WHEN code = 22 THEN 4 WHEN code = 23 THEN 5
                    WHEN code = 24 THEN 6 WHEN code <= 26 THEN 7 WHEN code <= 28 THEN 8
                    WHEN code = 29 THEN 10 WHEN code <= 31 THEN 13 WHEN code = 32 THEN 14
                    WHEN code <= 34 THEN 15 WHEN code <= 36 THEN 16 WHEN code = 37 THEN 17
                    WHEN code = 38 THEN 74 ELSE 32 END typeid,
               outcomeid, x, y, qty, ln FROM raw_event""",
    "qualified_event": """
        SELECT *,
          CASE WHEN typeid = 1 THEN 140
               WHEN typeid IN (13, 14, 15, 16) THEN CASE qty % 10 WHEN 0 THEN 9 WHEN 1 THEN 24
                    WHEN 2 THEN 25 WHEN 3 THEN 26 WHEN 4 THEN 28 WHEN 5 THEN 82 WHEN 6 THEN 160
                    ELSE 20 END
               WHEN typeid = 17 THEN 31 + qty % 3
               WHEN typeid = 10 THEN CASE WHEN qty % 4 = 0 THEN 94 ELSE 178 END
               WHEN qty % 4 = 0 THEN NULL ELSE 56 END q1,
          CASE WHEN typeid = 1 THEN CAST((qty * 19 + ln * 7) % 101 AS VARCHAR) ELSE 'Center' END v1,
          CASE WHEN typeid IN (4, 7, 8) AND qty % 3 = 0 AND qty % 4 <> 0 THEN 13 END q2
        FROM typed_event""",
    "line_up": f"""
        SELECT -(m * 100 + side * 50 + i + 1) eventid, m matchid, team teamid,
               team * 100 + i playerid, t0 ts, 0 mn, 1 periodid, 34 typeid, 1 outcomeid,
               CAST(50 AS DOUBLE) x, CAST(50 AS DOUBLE) y,
               CASE WHEN i = 0 THEN 'Goalkeeper' WHEN i < 5 THEN 'Defender'
                    WHEN i < 9 THEN 'Midfielder' ELSE 'Forward' END spot
        FROM ({_SIDES}) h CROSS JOIN range(11) v(i)""",
    # one row per touch
    "touch": f"""
        SELECT {_EVENT}, q1, CASE WHEN q1 IS NULL THEN NULL ELSE v1 END v1, q2
        FROM qualified_event
        UNION ALL SELECT {_EVENT}, 44, spot, NULL FROM line_up""",
    # one row per (touch, qualifier)
    "touches_long": f"""
        SELECT {_EVENT}, q1 qtype, v1 qvalue FROM touch
        UNION ALL SELECT {_EVENT}, q2, 'x' FROM touch WHERE q2 IS NOT NULL""",
    "roster": """
        SELECT DISTINCT playerid, -teamid teamid, -playerid altid
        FROM line_up WHERE (teamid - 1) % 20 < 2""",
    "match_games": """
        SELECT CAST(m AS VARCHAR) matchid, a teamid, b op_teamid, 'Team ' || a team_name,
               'Team ' || b op_team_name, CAST(1 AS DOUBLE) is_home, competitionid, seasonid,
               t0 kickoff FROM games
        UNION ALL
        SELECT CAST(m AS VARCHAR), b, a, 'Team ' || b, 'Team ' || a, CAST(0 AS DOUBLE),
               competitionid, seasonid, t0 FROM games""",
    "league_match": """
        SELECT competitionid, 'League ' || competitionid competitionname, seasonid FROM games""",
}
