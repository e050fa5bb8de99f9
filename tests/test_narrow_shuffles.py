"""What the joins and windows of the player tables shuffle: keys and masks, no wide rows."""

import re

from touchline.functions.counters import STATE_COUNTERS
from touchline.operators import events, summaries
from touchline.sources import fixture
from touchline.sources.tables import materialise

SF_DIR = "/root/testdata/sf0.001"


def exchanges(frame):
    """The input columns of each shuffle of a plan, broadcasts left out."""
    plan = frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    found = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    return [[name.split("#")[0].strip() for name in columns.split(",")] for columns in found]


def shuffle_joins(spark, build):
    """``build()`` planned as on large tables: no join is a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return exchanges(build())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def prepared(spark):
    raw = events.touch_events(fixture.touches(spark, SF_DIR))
    return raw, materialise(events.position_summary(raw))


def test_game_summary_shuffles_masks(spark):
    found = shuffle_joins(spark, lambda: summaries.game_summary(*prepared(spark)))
    assert found and max(map(len, found)) <= 8


def test_state_deals_its_rows_once(spark):
    summary = materialise(summaries.game_summary(*prepared(spark)))
    found = shuffle_joins(spark, lambda: summaries.touches_summary(summary))
    assert len(found) == 2  # the rows, and the span of each match
    assert not {name for columns in found for name in columns} & set(STATE_COUNTERS)


def test_moves_are_dealt_by_second_player_and_position(spark):
    found = shuffle_joins(spark, lambda: summaries.move_summary(*prepared(spark)))
    assert len(found) == 4  # two of them the positions


def test_counts_of_several_kinds_at_one_place(spark):
    """A place with rows of several kinds, one of them repeated, and a mask of more than one long."""
    rows = [
        ("1", 7, 70, 10, 10.0, 10.0, 4, 1, [(56, "x")]),
        ("1", 7, 70, 10, 10.0, 10.0, 4, 1, [(56, "x")]),
        ("1", 7, 70, 10, 10.0, 10.0, 7, 1, [(56, "x")]),
        ("1", 7, 70, 0, 50.0, 50.0, 34, 1, [(44, "Forward")]),
    ]
    names = "matchid string, teamid bigint, playerid bigint, s bigint, x double, y double, typeid int, outcomeid int, qualifiers array<struct<type:int,value:string>>"
    raw = spark.createDataFrame(rows, names).selectExpr("*", "timestamp_seconds(s) timestamp").drop("s")
    raw = events.touch_events(raw)
    positions = events.position_summary(raw)
    one = summaries.game_summary(raw, positions).first()
    assert (one.fouls, one.tackles, one.event_count, one.defense_event_count) == (2, 1, 2, 3)
    width, summaries.MASK_BITS = summaries.MASK_BITS, 5
    try:
        assert summaries.game_summary(raw, positions).first() == one
    finally:
        summaries.MASK_BITS = width


def test_game_summary_deals_its_rows_once(spark):
    found = shuffle_joins(spark, lambda: summaries.game_summary(*prepared(spark)))
    assert len(found) == 2  # the masks, and the positions


def test_no_shuffle_moves_a_time_twice(spark):
    """Moves and state: the time itself is the key, no copy of it beside it."""
    raw, positions = prepared(spark)
    summary = materialise(summaries.game_summary(raw, positions))
    moves = shuffle_joins(spark, lambda: summaries.move_summary(raw, positions))
    found = moves + shuffle_joins(spark, lambda: summaries.touches_summary(summary))
    assert not {name for columns in found for name in columns} & {"_moment"}


def test_moves_of_a_second_are_counted_without_a_hash_table(spark):
    plan = summaries.move_summary(*prepared(spark))._jdf.queryExecution().toString()
    assert "count(CASE" not in plan
