import random
from datetime import timedelta

import numpy as np
import pytest
from micro import START
from pyspark.sql import functions as F

from touchline.operators import lasso, models, power


def proximal_gradient(x, y, alpha, steps=20000):
    """Minimise mean log loss + alpha / n * |w|_1."""
    n, w = len(y), np.zeros(x.shape[1])
    rate = 4 * n / np.linalg.norm(x, 2) ** 2
    shrink = rate * alpha / n
    for _ in range(steps):
        w = w - rate * x.T @ (1 / (1 + np.exp(-x @ w)) - y) / n
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    return w


def test_logistic_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -1, 0, 0] + 0.5)))).astype(int)
    frame = spark.createDataFrame(
        [(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y int"
    )
    fitted = models.build_model_logistic(frame, F.col("y"), list("abcd"), alpha=8.0)
    expected = proximal_gradient(np.c_[x, np.ones(300)], y, 8.0)
    found = [value for _, value in models.coefficients(fitted)]
    assert found == pytest.approx(expected, abs=1e-6)
    assert 0.0 in found[2:4]


def test_a_fit_that_is_cut_off_fails(spark):
    frame = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "a double, y int")
    with pytest.raises(lasso.NotConverged):
        lasso.fit_l1(frame, ["a"], "y", lasso.LOGISTIC, 0.1, 1e-8, 1)
    with pytest.raises(ValueError):
        lasso.fit_l1(frame.limit(0), ["a"], "y", lasso.LOGISTIC, 0.1, 1e-8, 9)


def test_a_step_that_goes_too_far_is_halved(spark):
    """Counts that the first Newton step overshoots by far."""
    x = [0.0] * 30 + [1.0] * 3 + [6.0]
    y = [0.0] * 30 + [1.0, 2.0, 3.0, 400.0]
    frame = spark.createDataFrame(list(zip(x, y)), "a double, y double")
    fitted = models.build_model_poisson(frame, F.col("y"), ["a"], alpha=0.5)
    w = np.array(fitted.coefficients)
    design = np.c_[x, np.ones(len(x))]
    slope = design.T @ (np.exp(design @ w) - y)
    assert slope == pytest.approx(-0.5 * np.sign(w), abs=1e-5)


def test_columns_without_a_spread(spark):
    frame = spark.createDataFrame([(0.0, 1.0, i % 3 == 0) for i in range(30)], "a double, b double, y boolean")
    fitted = models.build_model_logistic(frame, F.col("y").cast("int"), ["a", "b"], alpha=1.0)
    named = dict(models.coefficients(fitted))
    assert named["a"] == 0 and -0.85 < named["b"] + named["intercept"] < 0  # log(10 / 20) is -0.69, then shrunk


def poisson_gradient(x, y, alpha, steps=60000):
    """Minimise the mean Poisson loss + alpha / n * |w|_1."""
    n, w = len(y), np.zeros(x.shape[1])
    rate = 0.02
    for _ in range(steps):
        w = w - rate * x.T @ (np.exp(x @ w) - y) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * alpha / n, 0)
    return w


def test_poisson_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = rng.poisson(np.exp(0.3 + x @ [0.5, 0.04, 0.0]))
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, y double")
    fitted = models.build_model_poisson(frame, F.col("y"), list("abc"), alpha=40.0)
    found = [value for _, value in models.coefficients(fitted)]
    assert found == pytest.approx(poisson_gradient(np.c_[x, np.ones(400)], y, 40.0), abs=1e-4)
    assert 0.0 in found
    rates = [r.prediction for r in fitted.transform(frame).collect()]
    assert rates == pytest.approx(np.exp(np.c_[x, np.ones(400)] @ found))


def league(spark, strengths, games, seed=0, competition=1, seasons=2):
    """Mirrored rows of games in which the stronger team tends to win."""
    rng, rows = random.Random(seed), []
    teams = sorted(strengths)
    for g in range(games):
        a, b = rng.sample(teams, 2)
        win = rng.random() < 1 / (1 + np.exp(strengths[b] - strengths[a]))
        when, year = START + timedelta(days=g), 2014 + g * seasons // games
        for t, o, home, pts in ((a, b, 1.0, 3 if win else 0), (b, a, 0.0, 0 if win else 3)):
            rows.append((f"{competition}-{g}", t, o, competition, year, home, f"Team {t}", f"Team {o}",
                         when, pts, float(strengths[t] + rng.gauss(0, 0.3))))
    return rows


COLUMNS = (
    "matchid string, teamid bigint, op_teamid bigint, competitionid int, seasonid int, is_home double,"
    " team_name string, op_team_name string, timestamp timestamp, points int, form double"
)


def test_train_and_predict(spark):
    data = spark.createDataFrame(league(spark, {1: 2.0, 2: 1.0, 3: 0.0, 4: -1.0}, 150), COLUMNS)
    model, test = models.train_model(data, seed=3)
    assert model.features == ["is_home", "form"]
    assert model.columns == ["is_home", "form", "opp_form"]
    assert 0 < test.count() < data.count()
    scored = models.predict_model(model, test)
    assert scored.count() == test.count()
    better = scored.filter("predicted > 0.5").agg(F.avg((F.col("points") == 3).cast("int"))).first()[0]
    assert better > 0.6
    by_training = models.predict_model(model, test, fit_on="train")
    assert by_training.filter("predicted BETWEEN 0 AND 1").count() == test.count()


def test_team_matrix_weights_and_discount(spark):
    rows = []
    for match, year, day in (("a", 2013, 0), ("b", 2014, 1), ("c", 2013, 2)):
        when = START + timedelta(days=day)
        rows += [(match, 1, 2, 1, year, 1.0, "", "", when, 3, 0.0), (match, 2, 1, 1, year, 0.5, "", "", when, 0, 0.0)]
    matrix = power.build_team_matrix(spark.createDataFrame(rows, COLUMNS), "points")
    found = {r.matchid: r for r in matrix.collect()}
    assert (found["c"].first_team, found["c"].second_team, found["c"].result) == (2, 1, -3)
    for match, changes in (("c", 1), ("b", 2), ("a", 3)):  # newest first, every change counts
        assert found[match].first_weight == pytest.approx(1.125 / 0.9**changes)
        assert found[match].second_weight == pytest.approx(-1.25 / 0.9**changes)


def dense(matrix):
    teams = sorted({r.first_team for r in matrix} | {r.second_team for r in matrix})
    x = np.zeros((len(matrix), len(teams) + 1))
    for i, r in enumerate(matrix):
        x[i, teams.index(r.first_team)] = r.first_weight
        x[i, teams.index(r.second_team)] = r.second_weight
    x[:, -1] = 1
    return teams, x, np.array([float(r.result > 0) for r in matrix])


@pytest.mark.parametrize("competitions", [1, 2, 3])
def test_joint_fit_equals_separate_fits(spark, competitions):
    strengths = {1: {1: 1.0, 2: 0.0, 3: -1.0}, 2: {1: 0.0, 7: 1.0, 8: -0.5}, 3: {4: 0.5, 5: 0.0}}
    rows = []
    for c in range(1, competitions + 1):
        rows += league(spark, strengths[c], 70 - 20 * c, seed=c, competition=c)
    matrix = power.build_team_matrix(spark.createDataFrame(rows, COLUMNS), "points")
    found = {
        (r.competitionid, r.teamid): r.coef
        for r in power.team_coefficients(matrix, lambda c: c > 0, 0.5, tol=1e-9).collect()
    }
    for competition in range(1, competitions + 1):
        teams, x, y = dense([r for r in matrix.collect() if r.competitionid == competition])
        expected = proximal_gradient(x, y, 0.5)
        for team, value in zip(teams, expected):
            assert found[(competition, team)] == pytest.approx(value, abs=1e-3)


def test_power_scale_and_snap(spark):
    strengths = np.array([0.5, 1.0, 2.0, 3.0, 4.0, 5.0])
    coefs = [(1, i, float(np.log(s))) for i, s in enumerate(strengths)]
    coefs += [(2, 9, 0.7), (2, 10, 0.7), (3, 11, 0.0)]
    frame = spark.createDataFrame(coefs, "competitionid int, teamid bigint, coef double")
    plain = {r.teamid: r.power for r in power.build_power(frame, snap=False).collect()}
    used = strengths[strengths != 1.0]  # a coefficient of 0 carries no information
    scaled = (used - used.min()) / (used.max() - used.min())
    assert sorted(plain.values()) == pytest.approx(sorted(scaled)) and set(plain) == {0, 2, 3, 4, 5}
    cuts = np.percentile(scaled, [20, 40, 60, 80])
    snapped = sorted(next((k * 0.25 for k in range(4) if cuts[k] > v), 1.0) for v in scaled)
    assert sorted(r.power for r in power.build_power(frame).collect()) == snapped


def test_add_power_prefers_the_last_competition(spark):
    rankings = spark.createDataFrame(
        [(1, 5, 0.25), (2, 5, 0.75)], "competitionid int, teamid bigint, power double"
    )
    rows = [("a", 5, 6, 1, 2014, 1.0, "", "", START, 3, 0.0), ("a", 6, 5, 1, 2014, 0.0, "", "", START, 0, 0.0)]
    late = START + timedelta(days=1)
    rows += [("b", 5, 7, 2, 2014, 1.0, "", "", late, 3, 0.0), ("b", 7, 5, 2, 2014, 0.0, "", "", late, 0, 0.0)]
    out = power.with_power(spark.createDataFrame(rows, COLUMNS), rankings, "x").collect()
    assert {(r.teamid, r.power_x) for r in out} == {(5, 0.25), (6, 0.5), (7, 0.5)}


def test_power_of_a_single_competition(spark):
    rows = league(spark, {1: 2.0, 2: 0.5, 3: -0.5, 4: -2.0}, 120, seed=6)
    data = spark.createDataFrame(rows, COLUMNS)
    out = power.add_power(data, data, [("points", lambda c: c > 0, "points")])
    known = {r.teamid: r.power_points for r in out.select("teamid", "power_points").distinct().collect()}
    assert known[1] == 1.0 and known[4] == 0.0 and out.columns[-1] == "power_points"


def test_competitions_without_a_range_have_no_ranking(spark):
    rows = league(spark, {1: 0.0, 2: 0.0}, 2, seed=1)
    matrix = power.build_team_matrix(spark.createDataFrame(rows, COLUMNS), "points")
    assert power.power_map(matrix.withColumn("result", F.lit(1)), lambda c: c > 5).count() == 0


def test_a_failing_competition_does_not_stop_the_others(spark):
    """Competition 2 needs more steps than it is given at any penalty; 1 is balanced and quick."""
    rows = league(spark, {1: 1.0, 2: 0.0, 3: -1.0}, 60, seed=3, competition=1)
    rows += league(spark, {4: 6.0, 5: 0.0, 6: -6.0}, 60, seed=4, competition=2)
    matrix = power.build_team_matrix(spark.createDataFrame(rows, COLUMNS), "points")
    won = lambda c: c > 0
    needed = {}
    for c in (1, 2):
        _, x, y = dense([r for r in matrix.collect() if r.competitionid == c])
        state, needed[c] = lasso.Descent.at([0.0] * x.shape[1]), 0
        while not state.done:
            p = 1 / (1 + np.exp(-x @ state.candidate))
            loss = -np.log(np.where(y > 0, p, 1 - p)).sum()
            state = state.advance((x.T * p * (1 - p)) @ x, x.T @ (y - p), loss, 0.5, 1e-6)
            needed[c] += 1
    assert needed[1] < needed[2]
    cut = power.power_map(matrix, won, steps=needed[1])
    whole = power.power_map(matrix, won)
    one = lambda frame: sorted(tuple(r) for r in frame.filter("competitionid = 1").collect())
    assert one(cut) == one(whole) and one(whole)
    assert whole.filter("competitionid = 2").count() > 0 and cut.filter("competitionid = 2").count() == 0
