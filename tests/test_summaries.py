import random

import pytest
from micro import line_up, touch, touches
from pyspark.sql import functions as F

from touchline.operators import events, summaries
from touchline.sources.tables import materialise


def prepared(spark, rows, *players):
    raw = events.touch_events(touches(spark, rows + line_up(*(players or [(1, 101)]))))
    return raw, events.position_summary(raw)


def totals(spark, rows, **options):
    summary = summaries.game_summary(*prepared(spark, rows), **options)
    names = summary.columns[9:]
    return summary.agg(*[F.sum(n).alias(n) for n in names]).first().asDict()


def test_plain_counters_count_once_per_qualifier(spark):
    rows = [touch(4, qualifiers=[(13, "a"), (56, "b")]), touch(4, qualifiers=[], x=10)]
    assert totals(spark, rows)["fouls"] == 3
    assert totals(spark, rows, event_grain=True)["fouls"] == 2


@pytest.mark.parametrize(
    "end, band", [("16.6", 0), ("16.7", 1), ("33.2", 1), ("49.9", 2), ("66.4", 3), ("83", 4), ("83.1", 5)]
)
def test_pass_bands(spark, end, band):
    counts = totals(spark, [touch(1, outcomeid=0, qualifiers=[(140, end)])])
    assert counts[f"pass_attempt_{band}"] == 1 and counts[f"pass_{band}"] == 0
    assert sum(counts[f"pass_attempt_{k}"] for k in range(6)) == 1


def test_pass_with_text_for_a_number_is_not_counted(spark):
    assert totals(spark, [touch(1, qualifiers=[(140, "far")])])["event_count"] is None


def test_shots_need_outcome_and_qualifier(spark):
    counts = totals(spark, [
        touch(13, qualifiers=[(20, "")], x=1), touch(13, outcomeid=0, qualifiers=[(20, "")], x=2),
        touch(15, qualifiers=[(25, "")], x=3), touch(14, qualifiers=[], x=4),
        touch(16, qualifiers=[(28, "")], x=5), touch(16, qualifiers=[(26, "")], x=6),
        touch(13, qualifiers=[(26, "")], x=7), touch(15, qualifiers=[(20, "")], x=8),
    ])
    assert counts["shot_attempts"] == 1 and counts["shots_ontarget"] == 1
    assert counts["corner_kick_attempts"] == counts["corner_kicks_ontarget"] == 1
    assert counts["goals"] == 1 and counts["own_goals"] == 1


def test_several_positions_repeat_the_counts(spark):
    rows = [touch(4, qualifiers=[(13, "")])]
    extra = [touch(34, qualifiers=[(44, "Forward")]), touch(34, qualifiers=[(44, "Defender")])]
    summary = summaries.game_summary(*prepared(spark, rows + extra))
    counts = {r.position: r.fouls for r in summary.collect()}
    assert counts == {"forward": 2, "defender": 1}  # the line-up adds a second forward row


def test_players_without_position_are_left_out(spark):
    assert totals(spark, [touch(4, playerid=555, qualifiers=[(13, "")])])["fouls"] is None


def test_first_touch_comes_from_the_last_zone(spark):
    raw, positions = prepared(spark, [])
    row = summaries.move_summary(raw, positions).first()
    assert row.section_x == 3 and row.direction_x_2 == 1 and row.direction_x_1 == 0
    assert row.section_y == 1 and row.direction_y_2 == 1


def test_upper_y_edge_uses_previous_x_unless_fixed(spark):
    rows = [touch(1, x=90, y=50, second=1, playerid=7), touch(1, x=90, y=50, second=2, playerid=7)]
    raw, positions = prepared(spark, rows, (1, 101))
    positions = positions.withColumn("playerid", F.lit(7).cast("bigint"))
    late = F.col("timestamp") == 1402603202
    literal = summaries.move_summary(raw, positions).filter(late).first()
    fixed = summaries.move_summary(raw, positions, fix_prev_y=True).filter(late).first()
    assert literal.direction_y_2 == 1 and literal.direction_y_1 == 0
    assert fixed.direction_y_2 == 0 and fixed.direction_y_1 == 1


def random_touches(seed, count=400):
    """Few players and seconds, so that one player's seconds hold many touches."""
    rng = random.Random(seed)
    return [
        touch(
            rng.choice([1, 4, 7, 15]), outcomeid=rng.choice([0, 1]),
            x=rng.randrange(0, 1001, 50) / 10, y=rng.randrange(0, 1001, 50) / 10,
            qualifiers=rng.choice([[], [(140, "20")], [(9, ""), (13, "")]]),
            playerid=101 if rng.random() < 0.6 else rng.choice([102, 103]),
            second=rng.randrange(12), matchid=rng.choice(["1", "2"]), eventid=i,
        )
        for i in range(count)
    ]


def test_previous_touch_equals_brute_force(spark):
    rows = random_touches(1)
    found = {
        (r.matchid, r.playerid, r.timestamp, r.teamid, r.x, r.y): (r.prev_x, r.prev_y)
        for r in summaries.previous_touches(events.touch_events(touches(spark, rows))).collect()
    }
    groups = {}
    for r in rows:
        groups.setdefault((int(r[1]), r[3]), set()).add((int(r[4].timestamp()), r[2], r[9], r[10]))
    expected = {}
    for (match, player), spots in groups.items():
        before = (None, None)
        for second, team, x, y in sorted(spots):
            expected[(match, player, second, team, x, y)] = before
            before = (x, y)
    assert found == expected


def test_state_equals_brute_force(spark):
    rows = random_touches(2)
    players = [(1, 101), (1, 102), (1, 103)]
    both = rows + line_up(*players, matchid="2")
    summary = materialise(summaries.game_summary(*prepared(spark, both, *players)))
    plain = [r.asDict() for r in summary.collect()]
    span = {}
    for r in plain:
        low, high = span.get(r["matchid"], (r["timestamp"],) * 2)
        span[r["matchid"]] = (min(low, r["timestamp"]), max(high, r["timestamp"]))
    state = summaries.touches_summary(summary).collect()
    assert len(state) == len(plain)
    for r in state:
        low, high = span[r.matchid]
        until = low + r.timestamp * (high - low) + 1e-6
        mine = [p for p in plain if p["matchid"] == r.matchid and p["playerid"] == r.playerid
                and p["timestamp"] <= until]
        assert r.fouls == sum(p["fouls"] for p in mine)
        assert r.pass_attempts == sum(p[f"pass_attempt_{k}"] for p in mine for k in range(6))
        assert r.penalty_kicks_ontarget == sum(p["penalty_kicks_ontarget"] for p in mine)


def test_match_of_one_second_has_no_share_of_time(spark):
    summary = materialise(summaries.game_summary(*prepared(spark, [touch(4, qualifiers=[])])))
    assert [r.timestamp for r in summaries.touches_summary(summary).collect()] == [None]


def test_rows_without_a_time_stay(spark):
    raw, positions = prepared(spark, [touch(4, x=10, second=5), touch(4, x=20, second=9), touch(4, x=30)])
    raw = raw.withColumn("timestamp", F.when(F.col("x") != 30, F.col("timestamp")))
    summary = materialise(summaries.game_summary(raw, positions))
    state = {r.x: (r.timestamp, r.fouls) for r in summaries.touches_summary(summary).collect()}
    assert state == {30.0: (None, 1), 10.0: (0.0, 2), 20.0: (1.0, 3)}
    before = {r.x: r.prev_x for r in summaries.previous_touches(raw).collect()}
    assert before == {30.0: None, 50.0: 30.0, 10.0: 50.0, 20.0: 10.0}
