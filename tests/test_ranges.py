"""Joins on time against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from micro import match_games
from pyspark.sql import functions as F

from touchline.operators import history, state
from touchline.operators.ordered import exact_percentiles
from touchline.operators.ranges import asof_join, band_join


def band_rows(seed):
    rng = random.Random(seed)
    points = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(-60, 60), i) for i in range(150)] + [(1, None, 150), (1, 0, 151), (1, 0, 151)]
    intervals = []
    for i in range(60):
        low = rng.randrange(-70, 60)
        intervals.append((rng.choice([1, 1, 2, 3, None]), low, low + rng.choice([-1, 0, 0, 1, 5, 40, 200]), i))
    intervals += [(1, None, 5, 60), (1, 0, None, 61), (2, -(1 << 40), 1 << 40, 62)]
    return points, intervals


@pytest.mark.parametrize("hot", [1_000, 7])
def test_band_join_equals_loops(spark, hot):
    points, intervals = band_rows(1)
    p = spark.createDataFrame(points, "k int, at long, p int")
    i = spark.createDataFrame(intervals, "k int, low long, high long, i int")
    found = Counter(tuple(r) for r in band_join(p, i, ["k"], "at", "low", "high", hot).select("k", "at", "p", "i").collect())
    expected = Counter(
        (k, at, n, m) for k, at, n in points for j, low, high, m in intervals
        if k is not None and k == j and None not in (at, low, high) and low <= at <= high
    )
    assert found == expected and len(expected) > 500


def test_band_join_of_nothing(spark):
    p = spark.createDataFrame([(1, 5)], "k int, at long")
    i = spark.createDataFrame([], "k int, low long, high long")
    assert band_join(p, i, ["k"], "at", "low", "high").count() == 0
    assert band_join(p.limit(0), spark.createDataFrame([(1, 0, 9)], i.schema), ["k"], "at", "low", "high").count() == 0


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_asof_equals_loops(spark, partitions):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(40), rng.randrange(5), n) for n in range(300)] + [("c", None, 1, 300), (None, 3, 1, 301)]
    asked = [(rng.choice("abcd"), rng.randrange(-5, 50), q) for q in range(80)] + [("a", 7, 99), ("a", 7, 99), ("a", None, 98), (None, 9, 97)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = asof_join(
            spark.createDataFrame(asked, "k string, at int, q int"),
            spark.createDataFrame(rows, "k string, t int, x int, n int"), ["k"], "at", "t", ["x", "n"],
        )
        got = Counter((r.k, r.at, r.q, r.found.n if r.found else None) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

    def last(k, at):
        known = [(t, x, n) for j, t, x, n in rows if j == k and t is not None and at is not None and t <= at]
        return max(known)[2] if known else None

    assert got == Counter((k, at, q, last(k, at)) for k, at, q in asked)


def test_state_of_many_requests(spark):
    """One player's hot match, players without a row yet, repeated requests."""
    columns = [c for c in state.STATE_COLUMNS if c not in ("matchid", "teamid", "playerid", "timestamp", "position", "x", "y")]
    types = ", ".join(f"`{c}` bigint" for c in columns)
    rows = [(1, 5.0, 5.0, k / 1000, 1, "forward", 10, *[k] * len(columns)) for k in range(1001)]
    rows += [(1, 1.0, 1.0, 0.6, 2, "defender", 20, *[7] * len(columns)), (2, 1.0, 1.0, 0.0, 1, "forward", 10, *[3] * len(columns))]
    frame = spark.createDataFrame(rows, f"matchid bigint, x double, y double, timestamp double, teamid bigint, position string, playerid bigint, {types}")
    asked = [(1, 0.3005), (1, 0.3005), (1, 0.9), (2, 1.0), (2, -0.1), (3, 0.5)]
    found = state.state_requests(frame, spark.createDataFrame(asked, "matchid bigint, at double"))
    got = {(r["matchid"], r["at"], r["playerid"], r[columns[0]]) for r in found.collect()}
    assert got == {(1, 0.3005, 10, 300), (1, 0.9, 10, 900), (1, 0.9, 20, 7), (2, 1.0, 10, 3)} and found.count() == 4
    one = state.player_state_asof(frame, 0.9, 1).collect()
    assert {(r["playerid"], r[columns[0]]) for r in one} == {(10, 900), (20, 7)}


def test_history_by_times_counts_ties(spark):
    """Days of team 1: 0, 1, 1, 2; with two previous games wanted the ties count each other."""
    rows = []
    for m, (o, day) in enumerate([(2, 0), (3, 1), (4, 1), (5, 2)]):
        rows += [(str(m), 1, o, 1, day), (str(m), o, 1, 0, day)]
    games = match_games(spark, rows)
    summary = spark.createDataFrame([(str(m), 1) for m in range(4)], "matchid string, teamid bigint")
    found = {(r.matchid, r.previous_match) for r in history.match_history_range(games, summary, 2).collect()}
    # the third game (day 1): bounds day 0 and day 1; the fourth: both bounds on day 1
    assert found == {("2", "0"), ("2", "1"), ("2", "2"), ("3", "1"), ("3", "2")}
    plain = {(r.matchid, r.previous_match) for r in history.match_history(games, summary, 2).collect()}
    assert plain == {("2", "0"), ("2", "1"), ("3", "1"), ("3", "2")}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=501), "b": rng.integers(0, 3, 40).astype(float), "c": np.array([2.5])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    cuts = [0.0, 0.1, 0.333, 0.5, 1.0]
    found = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", cuts)
    got = {(r.k, r.cut): r.value for r in found.collect()}
    assert set(got) == {(k, c) for k in values for c in cuts}
    for (k, c), v in got.items():
        assert v == pytest.approx(np.quantile(values[k], c))
    assert exact_percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", cuts).count() == 0
    assert found.filter(F.col("k") == "b").count() == 5
