import random

import pytest
from micro import match_games
from pyspark.sql import functions as F

from touchline.operators import history
from touchline.sources.tables import materialise


def season(games, seed=5, teams=5):
    """Match rows and, for some matches, statistics."""
    rng = random.Random(seed)
    rows = []
    for m in range(games):
        a, b = rng.sample(range(1, teams + 1), 2)
        rows += [(str(m), a, b, 1, m), (str(m), b, a, 0, m)]
    return rows


def summary(spark, games, without=lambda m: False, one_sided=()):
    rows = []
    for m, t, o, home, day in games:
        if without(int(m)) or (m in one_sided and home):
            continue
        v = float(int(m) * 7 % 11 + t)
        rows.append((m, t, v, v / 2, 0.5, v, v, v, float((int(m) + t) % 3), v, float(home), f"Team {t}",
                     v, v, v, v, 90, 1, 2014, day))
    return spark.createDataFrame(
        rows,
        "matchid string, teamid bigint, passes double, bad_passes double, pass_ratio double,"
        " corners double, fouls double, cards double, goals double, shots double, is_home double,"
        " team_name string, pass_80 double, pass_70 double, expected_goals double, on_target double,"
        " length int, competitionid int, seasonid int, timestamp bigint",
    )


def joined(games, paired, size):
    """The range-join form of the history, in pandas."""
    stats = {(r.matchid, r.teamid): r for r in paired.collect()}
    by_team = {}
    for m, t, *_ , day in games:
        by_team.setdefault(t, []).append((day, m))
    result = {}
    for t, played in by_team.items():
        played.sort()
        for i, (_, m) in enumerate(played):
            if i < size:
                continue
            known = [stats[(p, t)] for _, p in played[i - size:i] if (p, t) in stats]
            if known:
                result[(m, t)] = (
                    sum(r.goals for r in known) / len(known),
                    sum(r.op_passes for r in known) / len(known),
                )
    return result


@pytest.mark.parametrize("size", [1, 3])
def test_window_equals_range_join(spark, size):
    games = season(60)
    table = materialise(summary(spark, games, lambda m: m % 9 == 0, one_sided={"4", "5"}))
    paired = history.team_game_op_summary(table)
    found = history.history_features(match_games(spark, games), paired, size, excluded=())
    got = {(r.matchid, r.teamid): (r.avg_goals, r.op_passes) for r in found.collect()}
    expected = joined(games, paired, size)
    assert got.keys() == expected.keys()
    for key, values in expected.items():
        assert got[key] == pytest.approx(values)


def test_previous_games_with_stats(spark):
    games = [(str(m), 1, 2 + m, 1, m) for m in range(4)]
    table = summary(spark, games, lambda m: m == 1)
    rows = history.match_history(match_games(spark, games), table, 2).collect()
    assert sorted((r.matchid, r.previous_match) for r in rows) == [("2", "0"), ("3", "2")]


def test_row_vanishes_if_no_previous_game_has_stats(spark):
    games = season(8, teams=2)
    paired = history.team_game_op_summary(summary(spark, games, lambda m: m in (2, 3)))
    found = history.history_features(match_games(spark, games), paired, 2)
    assert {r.matchid for r in found.collect()} == {"2", "3", "5", "6", "7"}


def test_excluded_matches(spark):
    games = season(8, teams=2)
    paired = history.team_game_op_summary(summary(spark, games))
    found = history.history_features(match_games(spark, games), paired, 2, excluded=["5"])
    assert "5" not in {r.matchid for r in found.collect()}


def test_pairing_and_guarded_ratios(spark):
    games = [("1", 1, 2, 1, 0), ("1", 2, 1, 0, 0), ("2", 1, 3, 1, 1)]
    table = summary(spark, games).withColumn(
        "goals", F.when(F.col("teamid") == 1, 2.0).otherwise(0.0)
    )
    rows = {(r.matchid, r.teamid): r for r in history.team_game_op_summary(table).collect()}
    assert set(rows) == {("1", 1), ("1", 2)}  # a match of one team has no pair
    assert (rows[("1", 1)].points, rows[("1", 2)].points) == (3, 0)
    assert rows[("1", 1)].goals_op_ratio == 2.0 and rows[("1", 2)].goals_op_ratio == 0.0
    assert rows[("1", 1)].op_passes == rows[("1", 2)].passes


def test_outcomes_and_order(spark):
    games = season(12, teams=2)
    paired = history.team_game_op_summary(summary(spark, games))
    features = history.history_features(match_games(spark, games), paired, 2)
    goals = spark.createDataFrame(
        [(m, t, t) for m, t, *_ in games], "matchid string, teamid bigint, goals bigint"
    )
    rows = history.newest_first(history.history_features_with_goals(features, goals)).collect()
    assert [r.matchid for r in rows[:2]] == ["11", "11"]
    assert [r.is_home for r in rows[:2]] == [0.0, 1.0]
    assert all(r.points == (3 if r.teamid == 2 else 0) for r in rows)
    assert history.competition_features(features).count() == 0
