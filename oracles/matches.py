"""Statistics per team and match."""

from oracles.sql import big, rounded, rounded_all

_DISTANCE = "ROUND(SQRT((100 - x) * (100 - x) + (50 - y) * (50 - y)))"
_SCALED = [
    "passes", "bad_passes", "corners", "fouls", "shots", "cards", "pass_80", "pass_70",
    "goals", "expected_goals", "on_target",
]
_RATES = [
    "passes", "bad_passes", "pass_ratio", "corners", "fouls", "shots", "pass_80", "pass_70",
    "expected_goals", "on_target",
]
_META = "is_home, team_name, competitionid, seasonid, CAST(length AS INTEGER) AS length"

CTES = {
    "touch_m": "SELECT * REPLACE (CAST(matchid AS VARCHAR) AS matchid) FROM touch",
    "rated_shot": f"""
        SELECT matchid, teamid, eventid, typeid, {_DISTANCE} AS dist FROM touch_m
        WHERE typeid IN (14, 15, 16) AND (q1 IS NOT NULL OR q2 IS NOT NULL)
          AND COALESCE(q1, 0) NOT IN (82, 26, 9, 28) AND COALESCE(q2, 0) NOT IN (82, 26, 9, 28)""",
    "xg": """
        SELECT matchid, teamid, COUNT(eventid) AS sot,
               SUM(CASE WHEN typeid = 16 THEN 1 ELSE 0 END) AS goals, AVG(dist) AS avgdist,
               SUM(CASE WHEN dist = 1 THEN CAST(1 AS DOUBLE)
                   ELSE CAST(1.132464 AS DOUBLE) - CAST(0.303866 AS DOUBLE) * LN(NULLIF(dist, 0))
                   END) AS xg_sum
        FROM rated_shot WHERE dist < 40 GROUP BY matchid, teamid""",
    "passing": """
        SELECT matchid, teamid,
               SUM(CASE WHEN x > 80 AND outcomeid = 1 THEN 1 ELSE 0 END) AS pass_80,
               SUM(CASE WHEN x > 70 AND outcomeid = 1 THEN 1 ELSE 0 END) AS pass_70
        FROM touch_m WHERE typeid = 1 GROUP BY matchid, teamid""",
    "own_goal_team": """
        SELECT matchid, teamid, COUNT(*) AS own_goals FROM touch_m
        WHERE typeid = 16 AND (q1 = 28 OR q2 = 28) GROUP BY matchid, teamid""",
    "own_goal_moved": """
        SELECT t.matchid, t.teamid AS credit_team, o.teamid AS deduct_team, o.own_goals AS cnt
        FROM own_goal_team o JOIN (SELECT DISTINCT matchid, teamid FROM touch_m) t
          ON o.matchid = t.matchid WHERE t.teamid <> o.teamid""",
    "raw_score": """
        SELECT matchid, teamid,
               SUM(CASE WHEN typeid = 16 AND periodid <> 5 THEN 1 ELSE 0 END) AS goals,
               MAX(ts) * 1000000 AS timestamp
        FROM touch_m WHERE typeid IN (16, 34) GROUP BY matchid, teamid""",
    "score": """
        SELECT r.matchid, r.teamid,
               CAST(r.goals + COALESCE(c.cnt, 0) - COALESCE(d.cnt, 0) AS BIGINT) AS goals,
               r.timestamp
        FROM raw_score r
        LEFT JOIN own_goal_moved c ON r.matchid = c.matchid AND r.teamid = c.credit_team
        LEFT JOIN own_goal_moved d ON r.matchid = d.matchid AND r.teamid = d.deduct_team""",
    "basic_count": """
        SELECT matchid, teamid,
               SUM(CASE WHEN typeid = 1 AND outcomeid = 1 THEN 1 ELSE 0 END) AS passes,
               SUM(CASE WHEN typeid = 1 AND outcomeid = 0 THEN 1 ELSE 0 END) AS bad_passes,
               SUM(CASE WHEN typeid = 6 AND outcomeid = 1 THEN 1 ELSE 0 END) AS corners,
               SUM(CASE WHEN typeid = 4 AND outcomeid = 1 THEN 1 ELSE 0 END) AS fouls,
               SUM(CASE WHEN typeid IN (13, 14, 15, 16) THEN 1 ELSE 0 END) AS shots,
               SUM(CASE WHEN typeid = 17 THEN 1 ELSE 0 END) AS cards,
               MAX(ts) AS last_second, MAX(mn) AS length
        FROM touch_m WHERE teamid <> 0 GROUP BY matchid, teamid""",
    "team_summary": """
        SELECT b.matchid, b.teamid,
               b.passes / NULLIF(CAST(b.length AS DOUBLE), 0) AS passes,
               b.bad_passes / NULLIF(CAST(b.length AS DOUBLE), 0) AS bad_passes,
               b.passes / CAST(b.passes + b.bad_passes + 1 AS DOUBLE) AS pass_ratio,
               b.corners / NULLIF(CAST(b.length AS DOUBLE), 0) AS corners,
               b.fouls / NULLIF(CAST(b.length AS DOUBLE), 0) AS fouls,
               b.shots / NULLIF(CAST(b.length AS DOUBLE), 0) AS shots,
               CAST(b.cards AS BIGINT) AS cards,
               p.pass_80 / NULLIF(CAST(b.length AS DOUBLE), 0) AS pass_80,
               p.pass_70 / NULLIF(CAST(b.length AS DOUBLE), 0) AS pass_70,
               b.last_second * 1000 AS timestamp, s.goals, h.is_home, h.team_name,
               h.competitionid, h.seasonid, COALESCE(x.xg_sum, 0) AS expected_goals,
               COALESCE(x.sot, 0) / NULLIF(CAST(b.length AS DOUBLE), 0) AS on_target, b.length
        FROM basic_count b
        LEFT JOIN score s ON b.matchid = s.matchid AND b.teamid = s.teamid
        JOIN passing p ON b.matchid = p.matchid AND b.teamid = p.teamid
        JOIN match_games h ON b.matchid = h.matchid AND b.teamid = h.teamid
        LEFT JOIN xg x ON b.matchid = x.matchid AND b.teamid = x.teamid""",
    "ingested": """
        SELECT matchid, MAX(times) AS event_count
        FROM (SELECT matchid, COUNT(eventid) AS times FROM touch_m GROUP BY matchid, eventid) e
        GROUP BY matchid""",
    "corrected_summary": "SELECT t.matchid, t.teamid, pass_ratio, "
    + ", ".join(f"{name} / CAST(event_count AS DOUBLE) AS {name}" for name in _SCALED)
    + """, timestamp, is_home, team_name, competitionid, seasonid, length
        FROM team_summary t JOIN ingested i ON t.matchid = i.matchid""",
}

QUERIES = {
    "p8_expected_goals": f"""
        SELECT matchid, teamid, sot, {big("goals", "goals")}, {rounded("avgdist", "avgdist")},
               {rounded("xg_sum", "xG")} FROM xg""",
    "p9_pass_stats": f"""
        SELECT matchid, teamid, {big("pass_80", "pass_80")}, {big("pass_70", "pass_70")}
        FROM passing""",
    "p10a_own_goals_by_team": "SELECT matchid, teamid, own_goals FROM own_goal_team",
    "p10b_own_goal_credit": "SELECT matchid, credit_team, deduct_team, cnt FROM own_goal_moved",
    "p10c_raw_goals": f"""
        SELECT matchid, teamid, {big("goals", "goals")}, timestamp FROM raw_score""",
    "p11_match_goals": "SELECT matchid, teamid, goals, timestamp FROM score",
    "p12_team_game_summary": f"""
        SELECT matchid, teamid, {rounded_all(_RATES)}, cards, goals, timestamp, {_META}
        FROM team_summary""",
    "p13_team_game_summary_corrected": f"""
        SELECT matchid, teamid, {rounded_all(_RATES)}, {rounded_all(["cards", "goals"])},
               timestamp, {_META} FROM corrected_summary""",
}
QUERIES["p14_team_stats_stored"] = QUERIES["p13_team_game_summary_corrected"]
