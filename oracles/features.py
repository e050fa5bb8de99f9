"""Opponent pairing and rolling history, in self-join and range-join form."""

from oracles.sql import rounded_all

HISTORY_SIZE = 10

_OWN = [
    "passes", "bad_passes", "pass_ratio", "corners", "fouls", "cards", "goals", "shots",
    "pass_80", "pass_70", "expected_goals", "on_target",
]
_RATIOS = ["shots_op_ratio", "goals_op_ratio", "pass_op_ratio"]
_PAIR_DOUBLES = [*_OWN, *[f"op_{name}" for name in _OWN], *_RATIOS]

# history feature -> averaged column
HISTORY = {
    "avg_points": "points", "avg_goals": "goals", "op_avg_goals": "op_goals",
    **{
        name: name
        for name in (
            "pass_70", "pass_80", "op_pass_70", "op_pass_80", "expected_goals",
            "op_expected_goals", "passes", "bad_passes", "pass_ratio", "corners", "fouls",
            "cards", "shots", "op_passes", "op_bad_passes", "op_corners", "op_fouls",
            "op_cards", "op_shots", "goals_op_ratio", "shots_op_ratio", "pass_op_ratio",
        )
    },
}
GAME = (
    "matchid, teamid, op_teamid, competitionid, seasonid, is_home, team_name, op_team_name,"
    " timestamp"
)
_PREVIOUS = f"""
    SELECT h.teamid, h.matchid, h.kickoff AS timestamp, m.kickoff AS previous_timestamp,
           m.matchid AS previous_match
    FROM (SELECT teamid, matchid, kickoff,
                 LEAD(kickoff, 1) OVER (PARTITION BY teamid ORDER BY kickoff DESC) AS last_one,
                 LEAD(kickoff, {HISTORY_SIZE}) OVER (PARTITION BY teamid ORDER BY kickoff DESC)
                   AS last_n
          FROM match_games) h
    JOIN rated_game m ON h.teamid = m.teamid
    WHERE m.kickoff >= h.last_n AND m.kickoff <= h.last_one"""

# kick-offs moved to the start of their 30 days, so that many of a team tie
_TIED = "CAST(FLOOR(kickoff / CAST(2592000 AS DOUBLE)) * 2592000 AS BIGINT)"
_TIED_ORDER = "PARTITION BY teamid ORDER BY kickoff DESC, matchid DESC"

CTES = {
    "tied_game": f"SELECT matchid, teamid, {_TIED} AS kickoff FROM match_games",
    "rated_game": """
        SELECT * FROM match_games WHERE matchid IN (SELECT matchid FROM corrected_summary)""",
    "paired": "SELECT c.matchid, c.teamid, "
    + ", ".join(f"c.{name}" for name in _OWN)
    + ", c.is_home, c.team_name, c.length, o.teamid AS op_teamid, o.team_name AS op_team_name, "
    + ", ".join(f"o.{name} AS op_{name}" for name in _OWN)
    + """, c.competitionid, c.seasonid, c.timestamp,
          CASE WHEN o.shots > 0 THEN c.shots / o.shots ELSE c.shots END AS shots_op_ratio,
          CASE WHEN o.goals > 0 THEN c.goals / o.goals ELSE c.goals END AS goals_op_ratio,
          CASE WHEN o.pass_ratio > 0 THEN c.pass_ratio / o.pass_ratio
               ELSE CAST(1 AS DOUBLE) END AS pass_op_ratio,
          CASE WHEN c.goals > o.goals THEN 3 WHEN c.goals = o.goals THEN 1 ELSE 0 END AS points
        FROM corrected_summary c JOIN corrected_summary o ON c.matchid = o.matchid
        WHERE c.teamid <> o.teamid""",
    "previous_game": _PREVIOUS,
    "history_mean": "SELECT p.matchid, p.teamid, "
    + ", ".join(f"AVG(g.{column}) AS {name}" for name, column in HISTORY.items())
    + """ FROM previous_game p
        JOIN paired g ON p.previous_match = g.matchid AND p.teamid = g.teamid
        GROUP BY p.matchid, p.teamid""",
    "history": "SELECT m.matchid, m.teamid, m.op_teamid, m.competitionid, m.seasonid, m.is_home,"
    " m.team_name, m.op_team_name, m.kickoff AS timestamp, "
    + ", ".join(HISTORY)
    + """ FROM history_mean s JOIN match_games m
          ON s.matchid = m.matchid AND s.teamid = m.teamid
        WHERE s.matchid <> '442291'""",
    "features": """
        SELECT h.*, g.goals, o.goals AS op_goals,
               CASE WHEN g.goals > o.goals THEN 3 WHEN g.goals = o.goals THEN 1 ELSE 0 END
                 AS points
        FROM history h
        JOIN score g ON h.matchid = g.matchid AND h.teamid = g.teamid
        JOIN score o ON h.matchid = o.matchid AND h.op_teamid = o.teamid""",
}

FEATURES = f"{GAME}, goals, op_goals, points, {rounded_all(HISTORY)}"
MATCH_GAMES = (
    "matchid, teamid, op_teamid, team_name, op_team_name, is_home, competitionid, seasonid,"
    " kickoff AS timestamp"
)

QUERIES = {
    "p15_feature_columns": f"SELECT is_home, {rounded_all(HISTORY)} FROM features",
    "p16a_games_with_stats": f"SELECT {MATCH_GAMES} FROM rated_game",
    "p16b_match_history": "SELECT * FROM previous_game",
    "p16b_history_range": f"""
        SELECT h.teamid, h.matchid, h.kickoff AS timestamp, m.kickoff AS previous_timestamp,
               m.matchid AS previous_match
        FROM (SELECT teamid, matchid, kickoff, LEAD(kickoff, 1) OVER ({_TIED_ORDER}) AS last_one,
                     LEAD(kickoff, {HISTORY_SIZE}) OVER ({_TIED_ORDER}) AS last_n
              FROM tied_game) h
        JOIN tied_game m ON h.teamid = m.teamid
        WHERE m.matchid IN (SELECT matchid FROM corrected_summary)
          AND m.kickoff >= h.last_n AND m.kickoff <= h.last_one""",
    "p17_team_game_op_summary": f"""
        SELECT matchid, teamid, op_teamid, is_home, team_name, op_team_name, competitionid,
               seasonid, timestamp, points, CAST(length AS INTEGER) AS length,
               {rounded_all(_PAIR_DOUBLES)} FROM paired""",
    "p18a_history_features": f"SELECT {GAME}, {rounded_all(HISTORY)} FROM history",
    "p18b_history_features_with_goals": f"SELECT {FEATURES} FROM features",
    "p18c_wc_history_features": f"""
        SELECT {GAME}, {rounded_all(HISTORY)} FROM history WHERE competitionid = 4""",
    "p18d_get_features": f"SELECT {FEATURES} FROM features",
}
QUERIES["p18d_get_game_summaries"] = QUERIES["p17_team_game_op_summary"]
