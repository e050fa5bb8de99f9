import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions.expressions import equals_integer
from touchline.operators import evaluation, pairs


def rows(spark, *values):
    """(matchid, teamid, op_teamid, is_home, points, v)"""
    return spark.createDataFrame(
        values, "matchid string, teamid bigint, op_teamid bigint, is_home double, points int, v double"
    )


def pair(match, a=1, b=2, points=(3, 0), v=(1.0, 2.0)):
    return [(match, a, b, 1.0, points[0], v[0]), (match, b, a, 0.0, points[1], v[1])]


def test_unbalanced_matches_are_dropped(spark):
    data = rows(spark, *pair("1"), *pair("2", v=(None, 1.0)), pair("3")[0], *pair("4"), pair("4")[0])
    assert {r.matchid for r in pairs.drop_unbalanced_matches(data).collect()} == {"1"}


def test_check_and_prepare(spark):
    good, odd = pair("1"), [("2", 1, 2, 1.0, 3, 1.0), ("2", 3, 1, 0.0, 0, 1.0)]
    assert pairs.check_data(rows(spark, *good)).count() == 0
    assert pairs.check_data(rows(spark, *good, *odd)).count() == 2
    assert pairs.prepare_data(rows(spark, *good)).count() == 2
    with pytest.raises(ValueError):
        pairs.prepare_data(rows(spark, *good, *odd))


def test_split_keeps_matches_together(spark):
    data = rows(spark, *[r for m in range(400) for r in pair(str(m))])
    train, test = pairs.split(data, 0.4, seed=1)
    sides = [{r.matchid for r in side.collect()} for side in (train, test)]
    assert not sides[0] & sides[1] and train.count() + test.count() == 800
    assert 180 < len(sides[0]) < 300
    other, _ = pairs.split(data, 0.4, seed=2)
    assert {r.matchid for r in other.collect()} != sides[0]


def test_target_and_dropping(spark):
    target, rest = pairs.extract_target(rows(spark, *pair("1")), "points")
    assert target.columns == ["matchid", "teamid", "op_teamid", "points"]
    assert "points" not in rest.columns
    assert pairs.clone_and_drop(rest, ["v", "not there"]).columns == ["matchid", "teamid", "op_teamid", "is_home"]


def test_standardize(spark):
    data = rows(spark, *pair("1", v=(1.0, 3.0)), *pair("2", v=(1.0, 3.0)))
    out = pairs.standardize(data.withColumn("flat", F.lit(7)), ["v", "flat"]).collect()
    assert {(r.v, r.flat) for r in out} == {(-1.0, 7.0), (1.0, 7.0)}
    train = rows(spark, *pair("9", v=(0.0, 4.0)))
    assert {r.v for r in pairs.standardize(data, ["v"], fit_on=train).collect()} == {-0.5, 0.5}


def test_splice(spark):
    out = {r.teamid: r for r in pairs.splice(rows(spark, *pair("1")), ["is_home", "v"]).collect()}
    assert (out[1].v, out[1].opp_v, out[2].opp_v) == (1.0, 2.0, 1.0)
    assert not hasattr(out[1], "opp_is_home")


def test_games_normalize_and_equality(spark):
    data = rows(spark, *pair("1"), *pair("2", v=(2.0, 5.0)))
    assert sorted((r.matchid, r.teamid) for r in pairs.games(data).collect()) == [("1", 2), ("2", 2)]
    assert sorted(r.v for r in pairs.normalize(data, "v").collect()) == [0.1, 0.2, 0.2, 0.5]
    whole = data.select(equals_integer(1)(F.col("v") + 0.9).alias("one")).collect()
    assert [r.one for r in whole].count(True) == 1


def test_predictions(spark):
    data = rows(spark, *pair("1"), *pair("2", points=(1, 1)), *pair("3", points=(0, 3)))
    data = data.selectExpr(
        "*", "'T' || teamid team_name", "'T' || op_teamid op_team_name", "IF(teamid = 2, 0.4, 0.6) predicted"
    )
    out = {r.matchid: r for r in pairs.extract_predictions(data).collect()}
    assert {m: (r.team_name, r.expected, r.winner) for m, r in out.items()} == {
        "1": ("T2", "T1", "T1"), "2": ("T2", "T1", "draw"), "3": ("T2", "T1", "T2"),
    }
    assert "winner" not in pairs.extract_predictions(data.drop("points")).columns


def test_home_advantage(spark):
    table = spark.createDataFrame([(1, 0.8)], "teamid int, is_home double")
    out = {r.teamid: r.is_home for r in pairs.apply_home_advantage(rows(spark, *pair("1")), table).collect()}
    assert out == {1: 0.8, 2: 0.0}


def judged(spark, values):
    return spark.createDataFrame(
        [(str(i), i, y, p) for i, (y, p) in enumerate(values)],
        "matchid string, teamid bigint, y boolean, p double",
    )


def confusion(values, expect):
    order = sorted(enumerate(values), key=lambda r: (-r[1][1], str(r[0]), r[0]))
    cells = dict.fromkeys(("tp", "tn", "fp", "fn"), 0)
    for place, (_, (y, p)) in enumerate(order):
        guess = False if p == 0 else True if p == 1 else place < expect
        cells[("t" if guess == y else "f") + ("p" if guess else "n")] += 1
    return cells


@pytest.mark.parametrize("baseline", [0.3, 25])
def test_validate_equals_brute_force(spark, baseline):
    rng = random.Random(4)
    values = [(rng.random() < 0.4, rng.choice([0.0, 1.0, round(rng.random(), 1)])) for _ in range(80)]
    row = evaluation.validate("x", judged(spark, values), F.col("y"), "p", baseline).first()
    expect = baseline if baseline > 1 else baseline * len(values)
    cells = confusion(values, expect)
    assert {k: row[k] for k in cells} == cells
    assert row.accuracy == (cells["tp"] + cells["tn"]) / 80
    assert row.baseline == pytest.approx(expect / 80)


def test_validate_without_predictions(spark):
    row = evaluation.validate("x", judged(spark, [(True, 0.0), (False, 0.0)]), F.col("y"), "p").first()
    assert (row.p1_t, row.p0_f, row.lift) == (-1.0, 0.5, -2.0)
    row = evaluation.validate("x", judged(spark, [(False, 0.5)]), F.col("y"), "p", 0.0).first()
    assert row.lift == 0.0


def test_auc_and_roc_with_ties(spark):
    rng = random.Random(5)
    values = [(rng.random() < 0.5, round(rng.random(), 1)) for _ in range(120)]
    ups = [p for y, p in values if y]
    downs = [p for y, p in values if not y]
    wins = sum((u > d) + 0.5 * (u == d) for u in ups for d in downs) / (len(ups) * len(downs))
    frame = judged(spark, values)
    assert math.isclose(evaluation.auc(frame, F.col("y"), "p").first().auc, wins)
    points = evaluation.roc_points(frame, F.col("y"), "p").orderBy(F.desc("threshold")).collect()
    assert len(points) == len({p for _, p in values})
    assert (points[-1].tpr, points[-1].fpr) == (1.0, 1.0)
    for point in points:
        assert point.tp == sum(p >= point.threshold for p in ups)
