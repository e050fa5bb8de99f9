import json

import pytest
from micro import line_up, touch, touches
from pyspark.sql import functions as F

from touchline import schema
from touchline.functions.counters import COMPOSITES, STATE_COUNTERS, counters, shot_outcomes
from touchline.operators import events, probability, scores, state, summaries
from touchline.operators.documents import write_document

PLACE = dict(matchid=1, timestamp=0, teamid=1, playerid=101, position="forward", section_x=0,
             section_y=0, x=1.0, y=1.0)


def summary(spark, *rows):
    """Game summary rows; counters not given are 0."""
    names = [*COMPOSITES, *[c.name for c in (*counters(), *shot_outcomes())]]
    full = [{**PLACE, **dict.fromkeys(names, 0), **row} for row in rows]
    columns = [*PLACE, *names]
    types = {"position": "string", "x": "double", "y": "double", "section_x": "int", "section_y": "int"}
    ddl = ", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in columns)
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in full], ddl)


def moves(spark, *rows):
    names = [*probability.MOVES]
    directions = sorted({part for part, _ in probability.MOVES.values()})
    columns = ["teamid", "playerid", "position", "section_x", "section_y", *directions, "total_x", "total_y"]
    base = dict(teamid=1, playerid=101, position="forward", section_x=0, section_y=0,
                **dict.fromkeys(directions, 0), total_x=0, total_y=0)
    assert names[0] == "move_x_left"
    ddl = ", ".join(f"{c} {'string' if c == 'position' else 'bigint'}" for c in columns)
    return spark.createDataFrame([tuple({**base, **r}[c] for c in columns) for r in rows], ddl)


def test_shots_divide_counts_that_exclude_each_other(spark):
    table = summary(spark, dict(shot_attempts=4, shots_ontarget=6), dict(shots_ontarget=9))
    row, = probability.probability(table, "shot").collect()
    assert row.shot_ontarget == 1.5  # rows without an attempt drop out first


def test_passes_share_one_whole(spark):
    table = summary(spark, dict(pass_attempt_0=3, pass_0=1, pass_attempt_5=1, pass_5=1))
    row, = probability.probability(table, "pass").collect()
    assert (row.pass_0, row.pass_1, row.pass_5) == (0.25, 0.0, 0.25)


def test_foul_and_out_shares(spark):
    table = summary(spark, dict(throwin_attempts=2, throwins_ontarget=1, red_cards=1, yellow_cards=1,
                                corner_kick_attempts=2))
    foul, = probability.probability(table, "foul").collect()
    out, = probability.probability(table, "out").collect()
    assert (foul.red_card, foul.throwin, foul.throwin_attempt, foul.free_kick) == (0.25, 0.25, 0.5, 0.0)
    assert (out.throwin, out.throwin_attempt, out.corner_kick, out.corner_kick_attempt) == (0.25, 0.5, 0.0, 0.5)


def test_defense_without_events_is_null(spark):
    table = summary(spark, dict(), dict(playerid=102, defense_event_count=4, tackles=1, save=2))
    rows = {r.playerid: r for r in probability.probability(table, "defense").collect()}
    assert rows[101].tackle is None
    assert (rows[102].tackle, rows[102].intercept, rows[102].save) == (0.25, 0.0, 0.5)
    assert rows == {r.playerid: r for r in probability.probability(table, "offense").collect()}


def test_move_shares(spark):
    table = moves(spark, dict(direction_x_0=1, direction_x_1=2, direction_x_2=1, direction_y_2=4, total_x=4, total_y=4))
    row, = probability.move_probability(table).collect()
    assert (row.move_x_left, row.move_x_stay, row.move_x_right) == (0.25, 0.5, 0.25)
    assert (row.move_y_up, row.move_y_stay, row.move_y_down) == (0.0, 0.0, 1.0)


def test_position_fills_in_for_players(spark):
    table = summary(
        spark,
        dict(save_attempts=2, save=1, section_x=1),
        dict(playerid=102, save_attempts=2, save=2, section_x=2),
    )
    rows = {(r.playerid, r.section_x): r for r in probability.with_position_fallback(table, "save").collect()}
    assert rows[(101, 1)].save == 0.5 and not rows[(101, 1)].from_position
    assert rows[(101, 2)].save == 1.0 and rows[(101, 2)].from_position
    assert len(rows) == 4


def read_document(folder):
    parts = sorted(folder.glob("part-*"))
    return json.loads("".join(p.read_text() for p in parts))


def test_bundle_is_one_json_object(spark, tmp_path):
    table = summary(spark, *[dict(playerid=p, save_attempts=2, save=1) for p in range(5)], dict(teamid=2))
    lines = probability.probability_bundle(table, moves(spark, dict(total_x=1, total_y=1)), teamid=1)
    write_document(lines, ["teamid"], ["playerid", "section_x", "section_y"], str(tmp_path / "doc"))
    bundle = read_document(tmp_path / "doc")
    assert list(bundle) == list(probability.BUNDLE)
    assert bundle["shot"] == [] and len(bundle["move"]) == 1
    assert [row["playerid"] for row in bundle["save"]] == list(range(5))
    assert bundle["save"][0] == {"playerid": 0, "section_x": 0, "section_y": 0, "save": 0.5}
    assert bundle["defense"][0]["tackle"] is None


def states(spark, *rows):
    base = dict(timestamp=0.0, matchid=1, teamid=1, position="forward", playerid=101, x=1.0, y=1.0,
                **dict.fromkeys(STATE_COUNTERS, 0))
    types = dict(timestamp="double", position="string", x="double", y="double")
    ddl = ", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in base)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], ddl)


def test_state_asof(spark):
    table = states(
        spark, dict(timestamp=0.2, fouls=1), dict(timestamp=0.5, fouls=2), dict(timestamp=0.6, fouls=3),
        dict(timestamp=0.5, fouls=2, x=9.0), dict(matchid=2, timestamp=0.9),
    )
    row, = state.player_state_asof(table, 0.5).collect()
    assert (row.fouls, row.x, row.timestamp) == (2, 9.0, 0.5)
    assert state.player_state_asof(table, 0.1).count() == 0
    assert state.player_state_asof(table, 1.0, matchid=2).count() == 1


def test_state_summary_counts_repeated_rows(spark, tmp_path):
    table = states(spark, dict(x=1.0), dict(x=2.0), dict(timestamp=0.5), dict(timestamp=None))
    rows = state.state_summary(table).collect()
    assert sorted((r.timestamp is not None, r.copies) for r in rows) == [
        (False, 1), (True, 1), (True, 2), (True, 2),
    ]
    write_document(
        state.state_document(table), ["matchid"],
        ["teamid", "timestamp", "playerid", "position", "x", "y"], str(tmp_path / "doc"),
    )
    document = read_document(tmp_path / "doc")
    assert [r["timestamp"] for r in document["state"]] == [None, 0.0, 0.0, 0.5]


def history(spark, *pairs):
    return spark.createDataFrame(pairs, "goals0 bigint, goals1 bigint")


def test_score_aggregates(spark):
    table = history(spark, (2, 0), (2, 0), (1, 1), (0, 3))
    outcomes = {(r.goals0, r.goals1): (r.matches, r.leader) for r in scores.outcome_counts(table).collect()}
    assert outcomes == {(2, 0): (2, "team0"), (1, 1): (1, "draw"), (0, 3): (1, "team1")}
    shares = {(r.team, r.goals): r.value for r in scores.goal_distribution(table).collect()}
    assert shares == {(0, 0): 0.25, (0, 1): 0.25, (0, 2): 0.5, (1, 0): 0.5, (1, 1): 0.25, (1, 2): 0.0, (1, 3): 0.25}
    assert tuple(scores.win_probability(table).first()) == (50.0, 25.0, 25.0)
    assert tuple(scores.win_probability(history(spark, (1, 0), (0, 1), (0, 0))).first()) == (33.33, 33.33, 33.33)


def test_event_thresholds(spark):
    table = summary(spark, dict(fouls=1, pass_0=2, pass_attempt_0=2, throwin_missed=1), dict(section_x=2))
    cdf = {r.section: r.thresholds for r in scores.event_cdf(table).collect()}
    assert len(cdf[0]) == 26
    assert cdf[0][:5] == [0.0, 0.25, 0.25, 0.25, 0.75] and cdf[0][25] == 0.75
    assert cdf[2] == [0.0] * 26
    assert all(r.thresholds == sorted(r.thresholds) for r in scores.event_cdf(table).collect())
    shares = scores.event_probabilities(table).filter("section = 0").agg(F.sum("probability")).first()[0]
    assert shares == pytest.approx(1.0)


def test_no_event_counts_in_two_transitions(spark):
    rows = [
        touch(4, qualifiers=[(13, "")]),
        touch(1, qualifiers=[(140, "10")]),
        touch(1, outcomeid=0, qualifiers=[(140, "20")]),
        *[touch(16, qualifiers=[(kind, "")]) for kind in (20, 26, 28, 25, 9, 24, 160)],
        *[touch(15, qualifiers=[(kind, "")]) for kind in (20, 25, 9, 24, 160)],
        touch(13, qualifiers=[(20, "")]),
        touch(17, qualifiers=[(31, "")]),
    ]
    raw = events.touch_events(touches(spark, rows + line_up((1, 101))))
    table = summaries.game_summary(raw, events.position_summary(raw), extra=shot_outcomes())
    counts = scores.transition_counts(table).select(*schema.TRANSITIONS).first().asDict()
    expected = dict.fromkeys(schema.TRANSITIONS, 0) | {
        "foul": 1, "yellow_card": 1, "pass_0": 1, "pass_attempt_1": 1, "own_goal": 1, "regular_goal": 2,
        "regular_attempt": 2,
        **{f"{piece}_{kind}": 1 for piece in ("corner_kick", "penalty_kick", "free_kick", "throwin")
           for kind in ("goal", "attempt")},
    }
    assert counts == expected


def test_thin_shares_lean_on_wider_groups(spark):
    """101 as a forward: 1 of 2 shots on target; in all positions 4 of 8; all forwards 13 of 22."""
    table = summary(
        spark, dict(shot_attempts=2, shots_ontarget=1), dict(position="defender", shot_attempts=6, shots_ontarget=3),
        dict(playerid=102, shot_attempts=20, shots_ontarget=12), dict(playerid=103),
    )
    rows = {(r.playerid, r.position): r for r in probability.thin_probability(table, "shot", 10).collect()}
    forwards, own = 13 / 22, 0.5
    assert rows[101, "forward"].shot_ontarget == pytest.approx(0.2 * own + 0.8 * (0.8 * 0.5 + 0.2 * forwards))
    assert rows[101, "defender"].shot_ontarget == pytest.approx(0.6 * 0.5 + 0.4 * (0.8 * 0.5 + 0.2 * 0.5))
    assert rows[102, "forward"].shot_ontarget == pytest.approx(0.6) and rows[102, "forward"].weight == 1
    none = rows[103, "forward"]
    assert (none.shot_ontarget, none.events, none.weight) == (pytest.approx(forwards), 0, 0)
    assert (rows[101, "forward"].events, rows[101, "forward"].weight) == (2, 0.2)
    with pytest.raises(ValueError):
        probability.thin_probability(table, "shot", 0)


def test_player_models_fill_empty_zones(spark):
    table = summary(spark, dict(section_x=2, fouls=1, red_cards=3))
    touched = moves(spark, dict(section_x=2, total_x=3), dict(section_x=4, total_x=1), dict(playerid=9, total_x=1))
    where = spark.createDataFrame([(101, "midfielder"), (101, "forward")], "playerid bigint, position string")
    row, = scores.player_models(table, touched, where).collect()
    assert (row.playerid, row.position, row.move) == (101, "forward", [0, 0, 0, 0.75, 0.75, 1.0])
    assert [len(a) for a in row.probability] == [0, 0, 26, 0, 0, 0] and row.probability[2][:3] == [0, 0.25, 1.0]
