import math

import pytest
from micro import by, match_games, touch, touches

from touchline.operators import match_stats


def chance(spark, *rows):
    return match_stats.expected_goals(touches(spark, list(rows))).collect()


def test_expected_goals_by_distance(spark):
    row, = chance(
        spark,
        touch(15, x=99, y=50, qualifiers=[(20, "")], eventid=1),
        touch(16, x=90, y=50, qualifiers=[(20, "")], eventid=2),
        touch(15, x=60, y=50, qualifiers=[(20, "")], eventid=3),
    )
    assert (row.sot, row.goals, row.avgdist) == (2, 1, 5.5)
    assert row.xG == pytest.approx(1 + 1.132464 - 0.303866 * math.log(10))


def test_shot_on_the_goal_line_counts_without_a_chance(spark):
    row, = chance(spark, touch(16, x=100, y=50, qualifiers=[(20, "")]))
    assert row.sot == 1 and row.xG is None


@pytest.mark.parametrize("qualifiers", [[], None, [(82, "")], [(20, ""), (26, "")], [(9, "")], [(28, "")]])
def test_unrated_shots(spark, qualifiers):
    assert chance(spark, touch(16, x=90, qualifiers=qualifiers)) == []


def test_shots_off_the_post_only(spark):
    assert chance(spark, touch(13, x=90, qualifiers=[(20, "")])) == []


def test_score_moves_own_goals_and_skips_shoot_outs(spark):
    raw = touches(spark, [
        touch(34, teamid=1), touch(34, teamid=2), touch(34, teamid=3, matchid="2"),
        touch(16, teamid=1, qualifiers=[(20, "")], second=10),
        touch(16, teamid=1, qualifiers=[(28, "")], second=20),
        touch(16, teamid=2, qualifiers=[(20, "")], periodid=5, second=30),
        touch(16, teamid=3, matchid="2", qualifiers=[(28, "")]),
    ])
    assert by(match_stats.own_goals_by_team(raw), "matchid", "teamid")[("1", 1)].own_goals == 1
    credit = match_stats.own_goal_credit(raw).collect()
    assert [tuple(r) for r in credit] == [("1", 2, 1, 1)]
    raw_goals = by(match_stats.raw_goals(raw), "matchid", "teamid")
    assert raw_goals[("1", 1)].goals == 2 and raw_goals[("1", 2)].goals == 0
    final = by(match_stats.match_goals(raw), "matchid", "teamid")
    assert (final[("1", 1)].goals, final[("1", 2)].goals) == (1, 1)
    assert final[("2", 3)].goals == 1  # no opponent: nothing to move
    assert final[("1", 2)].timestamp == 1402603230 * 1_000_000


def passes(team, match="1", **options):
    return [
        touch(1, teamid=team, matchid=match, x=x, outcomeid=o, minute=m, eventid=1000 + i, **options)
        for i, (x, o, m) in enumerate([(85, 1, 10), (75, 1, 20), (75, 0, 40), (10, 1, 30)])
    ]


GAMES = [("1", 1, 2, 1, 0), ("1", 2, 1, 0, 0)]


def test_team_game_summary(spark):
    raw = touches(spark, passes(1) + passes(2) + [touch(17, teamid=1), touch(4, teamid=0)])
    rows = by(match_stats.team_game_summary(raw, match_games(spark, GAMES)), "teamid")
    row = rows[(1,)]
    assert set(rows) == {(1,), (2,)}
    assert (row.length, row.cards, row.goals) == (40, 1, None)
    assert (row.passes, row.bad_passes, row.pass_ratio) == (3 / 40, 1 / 40, 3 / 5)
    assert (row.pass_80, row.pass_70, row.expected_goals, row.on_target) == (1 / 40, 2 / 40, 0.0, 0.0)


def test_teams_without_passes_or_game_are_left_out(spark):
    raw = touches(spark, passes(1) + [touch(17, teamid=2)] + passes(9))
    rows = match_stats.team_game_summary(raw, match_games(spark, GAMES)).collect()
    assert [r.teamid for r in rows] == [1]


def test_stored_scores_are_used(spark):
    raw = touches(spark, passes(1))
    goals = spark.createDataFrame([("1", 1, 7)], "matchid string, teamid bigint, goals bigint")
    row = match_stats.team_game_summary(raw, match_games(spark, GAMES), goals).first()
    assert row.goals == 7


def test_double_ingestion_is_scaled(spark):
    once = passes(1) + [touch(34, teamid=1, eventid=1)]
    games = match_games(spark, GAMES)
    single = match_stats.team_game_summary_corrected(touches(spark, once), games).first()
    double = match_stats.team_game_summary_corrected(touches(spark, once * 2), games).first()
    assert match_stats.ingestion_multiplicity(touches(spark, once * 2)).first().event_count == 2
    assert (single.passes, single.pass_80) == (double.passes, double.pass_80)
    assert double.pass_ratio == 6 / 9 and double.length == single.length


def test_stored_summary_serves_without_touches(spark):
    games, raw = match_games(spark, GAMES), touches(spark, passes(1))
    stored = match_stats.team_game_summary_corrected(raw, games)
    assert match_stats.team_stats(games, stored=stored).collect() == stored.collect()
    assert match_stats.team_stats(games, raw).collect() == stored.collect()
    with pytest.raises(ValueError):
        match_stats.team_stats(games)


def test_feature_columns_keep_their_order():
    columns = ["matchid", "b", "points", "a", "op_team_name"]
    assert match_stats.get_feature_columns(columns) == ["b", "a"]
    assert "timestamp" in match_stats.get_non_feature_columns()
