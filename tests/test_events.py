from micro import by, line_up, touch, touches

from touchline import schema
from touchline.operators import events


def test_flattening_keeps_events_without_qualifiers(spark):
    raw = touches(spark, [
        touch(1, qualifiers=[(140, "70"), (56, "Left")], eventid=1),
        touch(4, qualifiers=[], eventid=2),
        touch(4, qualifiers=None, eventid=3),
    ])
    rows = events.explode_qualifiers(raw).collect()
    assert sorted((r.eventid, r.type) for r in rows if r.type) == [(1, 56), (1, 140)]
    assert sorted(r.eventid for r in rows if r.type is None) == [2, 3]


def test_view_floors_time_and_casts_ids(spark):
    raw = touches(spark, [touch(1, matchid="7"), touch(1, matchid="not a number")])
    rows = events.touches_view(raw).collect()
    assert {r.matchid for r in rows} == {7, None}
    assert {r.timestamp for r in rows} == {1402603200}


def test_remap_moves_players_to_negative_matches(spark):
    raw = touches(spark, [touch(1, playerid=101, matchid="7"), touch(1, playerid=999)])
    roster = spark.createDataFrame([(101, 51, 5101), (101, 52, 6101)], schema.ROSTER)
    moved = by(events.remap_touches(raw, roster), "playerid")
    assert set(moved) == {(5101,), (6101,)}
    assert moved[(5101,)].matchid == "-7" and moved[(5101,)].teamid == 51
    both = events.touches_view(raw, events.remap_touches(raw, roster))
    assert both.count() == 4


def test_positions_are_lower_case_and_need_a_player(spark):
    raw = touches(spark, line_up((1, 101), (1, 0), position="GoalKeeper"))
    rows = events.position_summary(events.touch_events(raw)).collect()
    assert [(r.playerid, r.position) for r in rows] == [(101, "goalkeeper")]


def test_latest_position(spark):
    raw = touches(spark, [
        touch(34, qualifiers=[(44, "Defender")], second=0),
        touch(34, qualifiers=[(44, "Forward")], second=60),
    ])
    positions = events.position_summary(events.touch_events(raw))
    assert [r.position for r in events.latest_positions(positions).collect()] == ["forward"]


def test_leagues_group_by_id_but_return_the_name(spark):
    matches = spark.createDataFrame(
        [(1, "Cup", 2014), (1, "Cup", 2014), (2, "Cup", 2014)], schema.MATCHES
    )
    rows = events.ingested_leagues(matches)
    assert rows.columns == ["competitionname", "seasonid", "match_count"]
    assert sorted(r.match_count for r in rows.collect()) == [1, 2]
