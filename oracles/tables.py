"""Tables that were written and read back."""

_MATCH_GAMES = """
        SELECT matchid, teamid, op_teamid, team_name, op_team_name, is_home, competitionid,
               seasonid, kickoff AS timestamp FROM match_games"""

CTES: dict[str, str] = {}

QUERIES = {
    "s3_csv": """
        SELECT DISTINCT team_name AS "Team", CAST(teamid * 7 % 1000 AS INTEGER) AS power_ranking,
               CAST(teamid AS INTEGER) AS teamid, (teamid % 11) / CAST(10 AS DOUBLE) AS is_home
        FROM match_games""",
    "s4_replaced_table": _MATCH_GAMES,
    "s4_replaced_matches": """
        SELECT s.matchid, s.teamid, s.goals, m.competitionid, m.seasonid
        FROM score s JOIN match_games m ON s.matchid = m.matchid AND s.teamid = m.teamid""",
    "s5_view": _MATCH_GAMES,
    "s5_catalog_view": """
        SELECT matchid, teamid, team_name, kickoff AS timestamp FROM match_games WHERE is_home = 1""",
    "s6_dataset": _MATCH_GAMES,
}
