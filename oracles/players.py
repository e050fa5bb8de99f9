"""Probability tables, state and score aggregates."""

from oracles.events import ANY, COUNTERS, GATE, STATE
from oracles.sql import rounded, zone_x

_PASSES = [f"pass_{band}" for band in range(6)]
_PASS_WHOLE = [f"pass_attempt_{band}" for band in range(6)]
_FOUL_WHOLE = [
    "throwin_attempts", "free_kick_attempts", "penalty_kick_attempts", "yellow_cards", "red_cards",
]
_OUT_WHOLE = ["throwin_attempts", "corner_kick_attempts"]
_DEFENSE = {"tackle": "tackles", "intercept": "intercepts", "save": "save"}

# table -> (output column -> counter, counters of the whole, filtered?)
TABLES = {
    "shot": ({"shot_ontarget": "shots_ontarget"}, ["shot_attempts"], True),
    "save": ({"save": "save"}, ["save_attempts"], True),
    "pass": ({name: name for name in _PASSES}, _PASS_WHOLE, True),
    "intercept": ({"intercept": "intercepts"}, ["intercept_attempts"], True),
    "tackle": ({"tackle": "tackles"}, ["tackle_attempts"], True),
    "foul": (
        {
            "red_card": "red_cards", "yellow_card": "yellow_cards",
            "throwin": "throwins_ontarget", "throwin_attempt": "throwin_attempts",
            "free_kick": "free_kicks_ontarget", "free_kick_attempt": "free_kick_attempts",
            "penalty_kick": "penalty_kicks_ontarget",
            "penalty_kick_attempt": "penalty_kick_attempts",
        },
        _FOUL_WHOLE, True,
    ),
    "out": (
        {
            "throwin": "throwins_ontarget", "throwin_attempt": "throwin_attempts",
            "corner_kick": "corner_kicks_ontarget", "corner_kick_attempt": "corner_kick_attempts",
        },
        _OUT_WHOLE, True,
    ),
    "defense": (_DEFENSE, ["defense_event_count"], False),
    "offense": (_DEFENSE, ["defense_event_count"], False),
}
MOVES = {
    "move_x_left": ("direction_x_0", "total_x"), "move_x_stay": ("direction_x_1", "total_x"),
    "move_x_right": ("direction_x_2", "total_x"), "move_y_up": ("direction_y_0", "total_y"),
    "move_y_stay": ("direction_y_1", "total_y"), "move_y_down": ("direction_y_2", "total_y"),
}
_BUNDLE = ["move", "shot", "save", "pass", "intercept", "tackle", "foul", "out", "defense", "offense"]
ZONE = "section_x, section_y"


def _ratio(part: str, whole: str) -> str:
    return f"SUM({part}) / NULLIF(CAST(SUM({whole}) AS DOUBLE), 0)"


def table(name: str, by: str = "teamid, playerid") -> str:
    if name == "move":
        columns = ", ".join(rounded(_ratio(*pair), column) for column, pair in MOVES.items())
        return f"SELECT {by}, {ZONE}, {columns} FROM move_summary GROUP BY {by}, {ZONE}"
    parts, whole, filtered = TABLES[name]
    total = " + ".join(whole)
    columns = ", ".join(rounded(_ratio(part, total), column) for column, part in parts.items())
    where = f"WHERE {total} > 0" if filtered else ""
    return f"SELECT {by}, {ZONE}, {columns} FROM game_summary {where} GROUP BY {by}, {ZONE}"


def _measures(name: str) -> list[str]:
    return list(MOVES if name == "move" else TABLES[name][0])


_BUNDLE_SQL = "\nUNION ALL\n".join(
    f"SELECT teamid, '{name}' AS table_name, playerid, {ZONE}, '{measure}' AS measure,"
    f" {measure} AS value FROM ({table(name)}) t_{name}"
    for name in _BUNDLE
    for measure in _measures(name)
)
_STATE = ", ".join(f'"{name}"' for name in STATE)
_MOMENT = "playerid, matchid, timestamp, teamid"

# Set piece -> qualifier types (fixed values).
_PIECES = {"corner_kick": "25", "penalty_kick": "9", "free_kick": "24, 16", "throwin": "160"}
_GOAL, _MISSED = "typeid = 16 AND outcomeid = 1", "typeid IN (13, 14, 15)"

# transition -> test on a row of the flattened view, in the order of the transitions
TRANSITIONS = {
    "foul": COUNTERS["fouls"], "red_card": COUNTERS["red_cards"],
    "yellow_card": COUNTERS["yellow_cards"],
    **{name: COUNTERS[name] for name in _PASSES},
    **{name: f"{COUNTERS[name]} AND outcomeid <> 1" for name in _PASS_WHOLE},
    "own_goal": COUNTERS["own_goals"],
    "regular_goal": f"{_GOAL} AND type NOT IN (28, 25, 9, 24, 16, 160)",
    "regular_attempt": f"{_MISSED} AND type NOT IN (9, 24, 25, 26, 28, 160, 16)",
    **{
        f"{piece}_{result}": f"{test} AND type IN ({types})"
        for piece, types in _PIECES.items()
        for result, test in (("goal", _GOAL), ("attempt", _MISSED))
    },
}

CTES = {
    "pass_by_player": table("pass", "teamid, playerid, position"),
    "pass_by_position": table("pass", "position"),
    "final_score": """
        SELECT s.matchid, MAX(CASE WHEN is_home = 1 THEN goals END) AS goals0,
               MAX(CASE WHEN is_home = 0 THEN goals END) AS goals1
        FROM score s JOIN match_games m ON s.matchid = m.matchid AND s.teamid = m.teamid
        GROUP BY s.matchid""",
    "side_goals": """
        SELECT 0 AS team, goals0 AS goals FROM final_score
        UNION ALL SELECT 1, goals1 FROM final_score""",
    "transition_row": f"""
        SELECT v.playerid, {zone_x("x")} AS section, typeid, outcomeid, type, value
        FROM flat_view v JOIN positions p
          ON v.matchid = p.matchid AND v.teamid = p.teamid AND v.playerid = p.playerid
        WHERE {GATE} AND {ANY}""",
    "transition_count": "\nUNION ALL\n".join(
        f"SELECT playerid, section, {index} AS transition,"
        f" SUM(CASE WHEN {test} THEN 1 ELSE 0 END) AS times FROM transition_row"
        " GROUP BY playerid, section"
        for index, test in enumerate(TRANSITIONS.values())
    ),
    "transition_share": """
        SELECT playerid, section, transition,
               times / NULLIF(CAST(SUM(times) OVER (PARTITION BY playerid, section) AS DOUBLE), 0)
                 AS probability
        FROM transition_count""",
}

QUERIES = {
    "p19_shot_probability": table("shot"),
    "p20_move_probability": table("move"),
    "p21_pass_probability": table("pass"),
    "p22_save_probability": table("save"),
    "p23_intercept_probability": table("intercept"),
    "p24_tackle_probability": table("tackle"),
    "p25_foul_probability": table("foul"),
    "p26_out_probability": table("out"),
    "p27_defense_probability": table("defense"),
    "p27_offense_probability": table("offense"),
    "p28_probability_bundle": _BUNDLE_SQL,
    "p29_player_state_asof": f"""
        SELECT matchid, x, y, {rounded("timestamp", "timestamp")}, teamid, position, playerid,
               {_STATE}
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY matchid, teamid, playerid
                ORDER BY timestamp DESC, position DESC, x DESC, y DESC) AS rn
              FROM touches_summary WHERE timestamp <= 0.5) s WHERE rn = 1""",
    "p30_state_summary": f"""
        SELECT l.matchid, l.x, l.y, {rounded("l.timestamp", "timestamp")}, l.teamid, l.position,
               l.playerid, {", ".join(f'l."{name}"' for name in STATE)}, COUNT(*) AS copies
        FROM touches_summary l LEFT JOIN (SELECT {_MOMENT} FROM touches_summary) r
          ON l.playerid = r.playerid AND l.matchid = r.matchid AND l.timestamp = r.timestamp
         AND l.teamid = r.teamid
        GROUP BY ALL""",
    "p31_pass_by_position": table("pass", "position"),
    "p31_move_by_position": table("move", "position"),
    "p31_pass_by_player_position": table("pass", "teamid, playerid, position"),
    "p31_pass_with_fallback": "SELECT w.teamid, w.playerid, w.position, p.section_x, p.section_y, "
    + ", ".join(f"COALESCE(o.{name}, p.{name}) AS {name}" for name in _PASSES)
    + """, o.pass_0 IS NULL AS from_position
        FROM (SELECT DISTINCT teamid, playerid, position FROM game_summary) w
        JOIN pass_by_position p ON w.position = p.position
        LEFT JOIN pass_by_player o ON w.teamid = o.teamid AND w.playerid = o.playerid
          AND w.position = o.position AND p.section_x = o.section_x
          AND p.section_y = o.section_y""",
    "h1_outcome_counts": """
        SELECT goals0, goals1, COUNT(*) AS matches,
               CASE WHEN goals0 > goals1 THEN 'team0' WHEN goals0 = goals1 THEN 'draw'
                    ELSE 'team1' END AS leader
        FROM final_score GROUP BY goals0, goals1""",
    "h2_goal_distribution": f"""
        SELECT t.team, CAST(r.g AS BIGINT) AS goals,
               {rounded("(SELECT COUNT(*) FROM side_goals s WHERE s.team = t.team AND s.goals = r.g) / CAST(t.total AS DOUBLE)", "value")}
        FROM (SELECT team, MAX(goals) AS most, COUNT(*) AS total FROM side_goals GROUP BY team) t,
             range(1000) r(g) WHERE r.g <= t.most""",
    "h3_win_probability": """
        SELECT ROUND(100 * SUM(CASE WHEN goals0 > goals1 THEN 1 ELSE 0 END)
                 / CAST(COUNT(*) AS DOUBLE), 2) AS team0,
               ROUND(100 * SUM(CASE WHEN goals0 = goals1 THEN 1 ELSE 0 END)
                 / CAST(COUNT(*) AS DOUBLE), 2) AS draw,
               ROUND(100 * SUM(CASE WHEN goals0 < goals1 THEN 1 ELSE 0 END)
                 / CAST(COUNT(*) AS DOUBLE), 2) AS team1
        FROM final_score""",
    "h4_event_cdf": f"""
        SELECT playerid, section, transition,
               {rounded("COALESCE(SUM(probability) OVER (PARTITION BY playerid, section ORDER BY transition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)", "threshold")}
        FROM transition_share""",
}
QUERIES["s8_documents"] = _BUNDLE_SQL
QUERIES["s9_player_models"] = f"""
        WITH zone_touch AS (
          SELECT playerid, section_x AS section, SUM(total_x) AS n FROM move_summary GROUP BY ALL),
        spot AS (SELECT playerid, MIN(position) AS position FROM positions GROUP BY playerid),
        act AS ({QUERIES["h4_event_cdf"]})
        SELECT playerid, position, 'move' AS kind, CAST(k AS INTEGER) AS section, CAST(NULL AS INTEGER) AS transition,
               {rounded("COALESCE((SELECT SUM(n) FROM zone_touch z WHERE z.playerid = s.playerid AND z.section < k), 0) / (SELECT CAST(SUM(n) AS DOUBLE) FROM zone_touch z WHERE z.playerid = s.playerid)", "threshold")}
        FROM spot s, range(6) r(k)
        WHERE playerid IN (SELECT playerid FROM zone_touch) AND playerid IN (SELECT playerid FROM act)
        UNION ALL
        SELECT playerid, position, 'probability', CAST(section AS INTEGER), CAST(transition AS INTEGER), threshold
        FROM act JOIN spot USING (playerid) WHERE playerid IN (SELECT playerid FROM zone_touch)"""
QUERIES["p29_state_requests"] = f"""
        WITH request AS (
          SELECT DISTINCT m AS matchid, moment
          FROM (SELECT m, unnest([0.25, 0.5, m % 100 / CAST(100 AS DOUBLE)]) AS moment FROM games)
          UNION SELECT (SELECT MIN(m) FROM games), k / CAST(200 AS DOUBLE) FROM range(200) r(k))
        SELECT {rounded("moment", '"at"')}, matchid, x, y, {rounded("timestamp", "timestamp")}, teamid, position,
               playerid, {_STATE}
        FROM touches_summary JOIN request USING (matchid) WHERE timestamp <= moment
        QUALIFY ROW_NUMBER() OVER (PARTITION BY matchid, teamid, playerid, moment
                  ORDER BY timestamp DESC, position DESC, x DESC, y DESC) = 1"""


def _thin(least: int) -> str:
    whole = " + ".join(_PASS_WHOLE)

    def level(by: str, prefix: str) -> str:
        shares = ", ".join(f"{_ratio(name, whole)} AS {prefix}_{name}" for name in _PASSES)
        return f"SELECT {by}, {ZONE}, SUM({whole}) AS {prefix}_n, {shares} FROM game_summary WHERE {whole} > 0 GROUP BY ALL"

    def mixed(name: str) -> str:
        wide = f"(COALESCE(b_{name}, 0) * vb + (1 - vb) * c_{name})"
        return rounded(f"COALESCE(a_{name}, 0) * va + (1 - va) * {wide}", name)

    return f"""
        WITH a AS ({level("teamid, playerid, position", "a")}), b AS ({level("teamid, playerid", "b")}),
             c AS ({level("position", "c")}),
             w AS (SELECT DISTINCT teamid, playerid, position FROM game_summary)
        SELECT teamid, playerid, position, {ZONE}, {", ".join(mixed(name) for name in _PASSES)},
               CAST(COALESCE(a_n, 0) AS BIGINT) AS events, {rounded("va", "weight")}
        FROM (SELECT *, LEAST(COALESCE(a_n, 0) / CAST({least} AS DOUBLE), 1) AS va,
                     LEAST(COALESCE(b_n, 0) / CAST({least} AS DOUBLE), 1) AS vb
              FROM w JOIN c USING (position) LEFT JOIN a USING (teamid, playerid, position, {ZONE})
              LEFT JOIN b USING (teamid, playerid, {ZONE}))"""


QUERIES["p31_pass_thin"] = _thin(37)
_CUTS = "[0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]"
QUERIES["a10_percentiles"] = f"""
        SELECT typeid, CAST(cut AS DOUBLE) AS cut, {rounded("value", "value")}
        FROM (SELECT typeid, unnest({_CUTS}) AS cut, unnest(QUANTILE_CONT(x, {_CUTS})) AS value FROM touch GROUP BY typeid)"""
QUERIES["p30_state_document"] = QUERIES["p30_state_summary"]
