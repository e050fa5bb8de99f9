"""Event preparation, counters, movements and cumulative state."""

from oracles.sql import big, rounded, zone_x, zone_y

# counter -> test on a row of the flattened view
COUNTERS = {
    "fouls": "typeid = 4 AND outcomeid = 1",
    "outs": "typeid = 5 AND outcomeid = 1",
    "yellow_cards": "typeid = 17 AND type = 31",
    "red_cards": "typeid = 17 AND type IN (32, 33)",
}
_END = "TRY_CAST(value AS DOUBLE)"
_BANDS = [
    f"{_END} <= 16.6", f"{_END} > 16.6 AND {_END} <= 33.2", f"{_END} > 33.2 AND {_END} <= 49.9",
    f"{_END} > 49.9 AND {_END} <= 66.4", f"{_END} > 66.4 AND {_END} <= 83", f"{_END} > 83",
]
for band, test in enumerate(_BANDS):
    COUNTERS[f"pass_{band}"] = f"typeid = 1 AND type = 140 AND outcomeid = 1 AND {test}"
for band, test in enumerate(_BANDS):
    COUNTERS[f"pass_attempt_{band}"] = f"typeid = 1 AND type = 140 AND {test}"
COUNTERS |= {
    "save": "typeid = 10 AND type <> 94 AND outcomeid = 1",
    "save_attempts": "typeid = 10 AND type <> 94",
    "corner_kick_attempts": "typeid IN (13, 14, 15, 16) AND type = 25",
    "corner_kicks_ontarget": "typeid IN (15, 16) AND type = 25",
    "penalty_kick_attempts": "typeid IN (13, 14, 15, 16) AND type = 9",
    "penalty_kicks_ontarget": "typeid IN (15, 16) AND type = 9",
    "free_kick_attempts": "typeid IN (13, 14, 15, 16) AND type IN (24, 16)",
    "free_kicks_ontarget": "typeid IN (15, 16) AND type IN (24, 16)",
    "throwin_attempts": "typeid IN (13, 14, 15, 16) AND type = 160",
    "throwins_ontarget": "typeid IN (15, 16) AND type = 160",
    "shot_attempts": "typeid IN (13, 14) AND type NOT IN (9, 24, 25, 26, 28, 160)",
    "shots_ontarget": "typeid IN (15, 16) AND type NOT IN (9, 24, 25, 26, 28, 160)",
    "goals": "typeid = 16 AND type <> 28 AND outcomeid = 1",
    "own_goals": "typeid = 16 AND type = 28 AND outcomeid = 1",
    "intercepts": "typeid IN (8, 74) AND outcomeid = 1",
    "intercept_attempts": "typeid IN (8, 74)",
    "tackles": "typeid = 7 AND outcomeid = 1",
    "tackle_attempts": "typeid = 7",
}
GATE = """(typeid IN (4, 5, 7, 8, 74) OR (typeid = 10 AND type <> 94)
    OR (typeid = 1 AND type = 140) OR (typeid IN (13, 14, 15, 16) AND outcomeid = 1)
    OR (typeid = 17 AND type IN (31, 32, 33)))"""
ANY = "(" + " OR ".join(f"({test})" for test in COUNTERS.values()) + ")"

_ATTEMPTS = [f"pass_attempt_{band}" for band in range(6)]
_OFFENSE = ["fouls", "outs", *_ATTEMPTS, "shot_attempts"]
COMPOSITES = {
    "event_count": [
        "fouls", "outs", "yellow_cards", "red_cards", *_ATTEMPTS, "corner_kick_attempts",
        "penalty_kick_attempts", "free_kick_attempts", "throwin_attempts", "shot_attempts",
        "save_attempts", "intercept_attempts",
    ],
    "offense_event_count": _OFFENSE,
    "defense_event_count": ["fouls", "tackle_attempts", "intercept_attempts", "save_attempts"],
}
PLACE = ["matchid", "timestamp", "teamid", "playerid", "position", "section_x", "section_y", "x", "y"]
SUMMARY_COLUMNS = [*COMPOSITES, *COUNTERS]

# state counter -> counters it sums
STATE = {
    "fouls": ["fouls"], "outs": ["outs"], "red_cards": ["red_cards"],
    "yellow_cards": ["yellow_cards"],
    "pass": [f"pass_{band}" for band in range(6)],
    "pass_attempts": _ATTEMPTS,
    **{
        name: [name]
        for name in (
            "save", "save_attempts", "corner_kicks_ontarget", "corner_kick_attempts",
            "penalty_kicks_ontarget", "penalty_kick_attempts", "free_kicks_ontarget",
            "free_kick_attempts", "throwins_ontarget", "throwin_attempts", "shots_ontarget",
            "shot_attempts", "goals", "own_goals", "intercepts", "intercept_attempts",
            "tackles", "tackle_attempts",
        )
    },
}


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


_FLAGS = ", ".join(f"{_flag(test)} AS {name}" for name, test in COUNTERS.items())
_SUMS = ", ".join(big(f"SUM({name})", name) for name in COUNTERS)
_COMPOSITES = ", ".join(
    big("SUM(" + " + ".join(parts) + ")", name) for name, parts in COMPOSITES.items()
)
_PLACE = ", ".join(PLACE)

# event grain: the test holds for any qualifier of the event
_EVENT_ROW = "eventid, matchid, timestamp, teamid, playerid, position, x, y, copy"
_ANY_FLAGS = ", ".join(f"MAX({name}) AS {name}" for name in COUNTERS)


def _moves(name: str, upper: str) -> dict[str, str]:
    directions = ", ".join(
        f"CAST(SUM(CASE WHEN section_{axis} {sign} from_{axis} THEN 1 ELSE 0 END) AS BIGINT)"
        f" AS direction_{axis}_{turn}"
        for axis in "xy"
        for turn, sign in ((2, "<"), (1, "="), (0, ">"))
    )
    key = "matchid, timestamp, playerid, teamid, position, section_x, section_y"
    return {
        f"{name}_zoned": f"""
            SELECT s.matchid, s.timestamp, s.playerid, s.teamid, p.position,
                   {zone_x("x")} AS section_x, {zone_y("y")} AS section_y,
                   {zone_x("prev_x")} AS from_x,
                   CASE WHEN prev_y <= 33 THEN 0 WHEN {upper} <= 66 THEN 1 ELSE 2 END AS from_y
            FROM stepped s JOIN positions p
              ON s.matchid = p.matchid AND s.teamid = p.teamid AND s.playerid = p.playerid""",
        name: f"""
            SELECT {key}, {directions}, {big("COUNT(section_x)", "total_x")},
                   {big("COUNT(section_y)", "total_y")}
            FROM {name}_zoned GROUP BY {key}""",
    }


_RUNNING = ", ".join(
    f"CAST(SUM({' + '.join(parts)}) OVER (PARTITION BY playerid, matchid ORDER BY timestamp"
    f" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS \"{name}\""
    for name, parts in STATE.items()
)
_STATE = ", ".join(f'"{name}"' for name in STATE)

CTES = {
    "remapped": """
        SELECT t.ts AS timestamp, -t.matchid AS matchid, r.teamid, r.altid AS playerid, x, y,
               typeid, outcomeid, qtype, qvalue
        FROM touches_long t JOIN roster r ON t.playerid = r.playerid""",
    "flat_view": """
        SELECT ts AS timestamp, matchid, teamid, playerid, x, y, typeid, outcomeid,
               qtype AS type, qvalue AS value FROM touches_long
        UNION ALL SELECT timestamp, matchid, teamid, playerid, x, y, typeid, outcomeid, qtype,
               qvalue FROM remapped""",
    "positions": """
        SELECT matchid, timestamp, teamid, playerid, LOWER(value) AS position
        FROM flat_view WHERE type = 44 AND playerid <> 0""",
    "counted_row": f"""
        SELECT v.matchid, v.timestamp, v.teamid, v.playerid, p.position,
               {zone_x("x")} AS section_x, {zone_y("y")} AS section_y, x, y, {_FLAGS}
        FROM flat_view v JOIN positions p
          ON v.matchid = p.matchid AND v.teamid = p.teamid AND v.playerid = p.playerid
        WHERE {GATE} AND {ANY}""",
    "game_summary": f"""
        SELECT {_PLACE}, {_COMPOSITES}, {_SUMS} FROM counted_row GROUP BY {_PLACE}""",
    "view_touch": """
        SELECT eventid, ts, matchid, teamid, playerid, x, y, typeid, outcomeid, q1, v1, q2
        FROM touch
        UNION ALL
        SELECT NULL, ts, -t.matchid, r.teamid, r.altid, x, y, typeid, outcomeid, q1, v1, q2
        FROM touch t JOIN roster r ON t.playerid = r.playerid""",
    "numbered_touch": """
        SELECT *, ROW_NUMBER() OVER () AS copy FROM view_touch""",
    "numbered_long": """
        SELECT copy, eventid, ts AS timestamp, matchid, teamid, playerid, x, y, typeid, outcomeid,
               q1 AS type, v1 AS value FROM numbered_touch
        UNION ALL
        SELECT copy, eventid, ts, matchid, teamid, playerid, x, y, typeid, outcomeid, q2, 'x'
        FROM numbered_touch WHERE q2 IS NOT NULL""",
    "event_flag": f"""
        SELECT {_EVENT_ROW}, {_ANY_FLAGS} FROM (
          SELECT n.eventid, n.matchid, n.timestamp, n.teamid, n.playerid, p.position, x, y, copy,
                 {_FLAGS}
          FROM numbered_long n JOIN positions p
            ON n.matchid = p.matchid AND n.teamid = p.teamid AND n.playerid = p.playerid
          WHERE {GATE} AND {ANY}) f
        GROUP BY {_EVENT_ROW}""",
    "stepped": """
        SELECT *, LAG(x) OVER w AS prev_x, LAG(y) OVER w AS prev_y
        FROM (SELECT DISTINCT timestamp, playerid, matchid, teamid, x, y FROM flat_view
              WHERE playerid <> 0) d
        WINDOW w AS (PARTITION BY playerid, matchid ORDER BY timestamp, teamid, x, y)""",
    **_moves("move_summary", "prev_x"),
    **_moves("move_summary_fixed", "prev_y"),
    "match_span": """
        SELECT matchid, MIN(timestamp) AS first_second, MAX(timestamp) AS last_second
        FROM game_summary GROUP BY matchid""",
    "touches_summary": f"""
        SELECT CAST(s.timestamp - first_second AS DOUBLE)
                 / NULLIF(last_second - first_second, 0) AS timestamp,
               s.matchid, teamid, position, playerid, x, y, {_STATE}
        FROM (SELECT matchid, timestamp, position, playerid, teamid, x, y, {_RUNNING}
              FROM game_summary) s
        JOIN match_span m ON s.matchid = m.matchid""",
}

_MOVE_COLUMNS = ", ".join(
    ["matchid", "timestamp", "playerid", "teamid", "position", "section_x", "section_y"]
    + [f"direction_{axis}_{turn}" for axis in "xy" for turn in (2, 1, 0)]
    + ["total_x", "total_y"]
)

QUERIES = {
    "p1_remap_touches": """
        SELECT timestamp, CAST(matchid AS VARCHAR) AS matchid, teamid, playerid, x, y, typeid,
               outcomeid, qtype AS type, qvalue AS value FROM remapped""",
    "p2_touches_view": """
        SELECT timestamp, matchid, teamid, playerid, x, y, typeid, outcomeid, type, value
        FROM flat_view""",
    "p3_position_summary": "SELECT matchid, timestamp, teamid, playerid, position FROM positions",
    "p4_game_summary": "SELECT * FROM game_summary",
    "p4_game_summary_event_grain": f"""
        SELECT {_PLACE}, {_COMPOSITES}, {_SUMS} FROM (
          SELECT *, {zone_x("x")} AS section_x, {zone_y("y")} AS section_y FROM event_flag) e
        GROUP BY {_PLACE}""",
    "p5_move_summary": f"SELECT {_MOVE_COLUMNS} FROM move_summary",
    "p5_move_summary_fixed": f"SELECT {_MOVE_COLUMNS} FROM move_summary_fixed",
    "p6_touches_summary": f"""
        SELECT {rounded("timestamp", "timestamp")}, matchid, teamid, position, playerid, x, y,
               {_STATE} FROM touches_summary""",
    "p7_ingested_leagues": """
        SELECT competitionname, seasonid, COUNT(*) AS match_count FROM league_match
        GROUP BY competitionid, competitionname, seasonid""",
    "c1_c37_counter_totals": "SELECT matchid, teamid, "
    + ", ".join(big(f"SUM({name})", name) for name in SUMMARY_COLUMNS)
    + " FROM game_summary GROUP BY matchid, teamid",
    "c38_zones": f"""
        SELECT {zone_x("x")} AS section_x, {zone_y("y")} AS section_y, COUNT(*) AS touches
        FROM touch GROUP BY ALL""",
    "c39_c40_countable_rows": f"""
        SELECT matchid, typeid, type, COUNT(*) AS rows_counted FROM flat_view
        WHERE {GATE} AND {ANY} GROUP BY matchid, typeid, type""",
}
