"""Power rankings: team strengths from who beat whom, per competition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.lasso import Descent
from touchline.operators.models import LOGISTIC_STEPS
from touchline.operators.ordered import ordered, running_totals, with_position, with_previous
from touchline.sources.tables import materialise

# Fixed values of the ranking.
HOME_WEIGHT = 0.25
SEASON_DISCOUNT = 0.9
FIRST_ALPHA, LAST_ALPHA = 0.5, 0.1
MIN_RANGE = 0.0001
CUTS = (0.2, 0.4, 0.6, 0.8)
STEPS = (0.0, 0.25, 0.5, 0.75, 1.0)
UNKNOWN_POWER = 0.5

PowerColumn = tuple[str, Callable[[Column], Column], str]


def build_team_matrix(data: DataFrame, target: str) -> DataFrame:
    """One design row per game: weights of both teams and the target difference.

    The first team of a match is the one with the lower (is_home, teamid). Games
    are taken newest first; each change of season in that order within a
    competition multiplies the discount by 0.9, and the weights are divided by it.
    """
    match = W.partitionBy("competitionid", "matchid")
    row = F.struct("is_home", "teamid", "seasonid", "timestamp", F.col(target).alias("target"))
    sides = data.select("competitionid", "matchid", row.alias("a"))
    pairs = (
        sides.withColumns(
            {"b": F.lead("a").over(match.orderBy("a")), "_rows": F.count("*").over(match)}
        )
        .filter((F.col("_rows") == 2) & F.col("b").isNotNull())
        .select("competitionid", "matchid", "a", "b", F.col("a.seasonid").alias("seasonid"))
    )
    placed = ordered(pairs, F.col("competitionid"), F.desc("a.timestamp"), F.col("matchid"))
    columns = {"_last_competition": "competitionid", "_last_season": "seasonid"}
    changed = ~(
        F.col("competitionid").eqNullSafe(F.col("_last_competition"))
        & F.col("seasonid").eqNullSafe(F.col("_last_season"))
    )
    counted = running_totals(
        with_previous(placed, columns).withColumn("_changed", changed.cast("bigint")),
        {"_changes": F.col("_changed")},
    )
    starts = counted.groupBy("competitionid").agg(F.min("_changes").alias("_first"))
    seasons = F.col("_changes") - F.col("_first") + 1
    discount = F.pow(F.lit(SEASON_DISCOUNT), seasons)

    def weight(side: str) -> Column:
        return (1 + F.col(f"{side}.is_home") * HOME_WEIGHT) / discount

    return counted.join(starts, "competitionid").select(
        "competitionid",
        "matchid",
        "seasonid",
        F.col("a.teamid").alias("first_team"),
        F.col("b.teamid").alias("second_team"),
        weight("a").alias("first_weight"),
        (-weight("b")).alias("second_weight"),
        (F.col("a.target") - F.col("b.target")).alias("result"),
    )


def _indexed(games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games with the columns of their teams, and the columns (teamid null: the intercept).

    Columns are numbered from 0 within each competition.
    """
    sides = [games.select("competitionid", F.col(c).alias("teamid")) for c in ("first_team", "second_team")]
    teams = sides[0].union(sides[1]).distinct()
    groups = games.select("competitionid", F.lit(None).cast("bigint").alias("teamid")).distinct()
    placed = with_position(ordered(teams.unionByName(groups), F.col("competitionid"), F.col("teamid")), "_place")
    least = placed.groupBy("competitionid").agg(F.min("_place").alias("_least"))
    index = materialise(
        placed.join(least, "competitionid").select(
            "competitionid", "teamid", (F.col("_place") - F.col("_least")).cast("int").alias("column")
        )
    )

    def columns(name: str) -> DataFrame:
        return index.filter("teamid IS NOT NULL").select(
            "competitionid", F.col("teamid").alias(f"{name}_team"), F.col("column").alias(f"_{name}")
        )

    intercepts = index.filter("teamid IS NULL").select("competitionid", F.col("column").alias("_group"))
    placed_games = (
        games.join(columns("first"), ["competitionid", "first_team"])
        .join(columns("second"), ["competitionid", "second_team"])
        .join(intercepts, "competitionid")
    )
    return placed_games, index


_STATE = "competitionid int, accepted array<double>, candidate array<double>, objective double, done boolean"


def _sums(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Per competition the sums of a Newton step at its candidate, as (i, j, value).

    (i, j) are entries of X'WX, (i, -1) of X'(y - mean), (-1, -1) is the loss. A game adds
    ten of them; they are summed before the shuffle, so a competition is a few rows a task.
    """
    at = rows.join(states, "competitionid")
    eta = F.aggregate("xs", F.lit(0.0), lambda total, x: total + x["v"] * F.col("candidate")[x["c"]])
    mean = 1 / (1 + F.exp(-F.col("_eta")))
    loss = F.greatest("_eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_eta"))) - F.col("_won") * F.col("_eta")
    weight = F.greatest(F.col("_mean") * (1 - F.col("_mean")), F.lit(1e-12))
    at = at.withColumn("_eta", eta).withColumn("_mean", mean)

    def entry(i: Column, j: Column, value: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), value.alias("value"))

    x = [F.col("xs")[k] for k in range(3)]
    none = F.lit(-1)
    entries = [entry(p["c"], q["c"], weight * p["v"] * q["v"]) for p in x for q in x]
    entries += [entry(p["c"], none, (F.col("_won") - F.col("_mean")) * p["v"]) for p in x]
    entries.append(entry(none, none, loss))
    return at.select("competitionid", F.inline(F.array(*entries))).groupBy("competitionid", "i", "j").agg(
        F.sum("value").alias("value")
    ).groupBy("competitionid").agg(F.collect_list(F.struct("i", "j", "value")).alias("sums"))


def _advance(alpha: float, tol: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            moved = []
            for row in batch.itertuples():
                size = len(row.candidate)
                curvature, gradient, loss = np.zeros((size, size)), np.zeros(size), 0.0
                for part in row.sums:
                    i, j, value = part["i"], part["j"], part["value"]
                    if i < 0:
                        loss = value
                    elif j < 0:
                        gradient[i] = value
                    else:
                        curvature[i, j] = value
                state = Descent(np.array(row.accepted, float), np.array(row.candidate, float), row.objective)
                state = state.advance(curvature, gradient, loss, alpha, tol)
                moved.append((row.competitionid, state.accepted, state.candidate, state.objective, state.done))
            yield pd.DataFrame(moved, columns=["competitionid", "accepted", "candidate", "objective", "done"])

    return run


def team_coefficients(
    games: DataFrame, won: Callable[[Column], Column], alpha: float, tol: float = 1e-6, steps: int = LOGISTIC_STEPS
) -> DataFrame:
    """L1 logistic coefficients of the teams of every competition (competitionid, teamid, coef).

    Each competition is a fit of its own, with a column per team and a penalised
    intercept; all take their Newton steps together, one pass over the games each. Only sums
    are grouped, never games: (teams + 1) squared numbers per competition. A competition whose
    fit does not converge in ``steps`` steps has no rows. Runs jobs.
    """
    placed, index = _indexed(games)
    pair = [
        F.struct(F.col("_first").alias("c"), F.col("first_weight").alias("v")),
        F.struct(F.col("_second").alias("c"), F.col("second_weight").alias("v")),
        F.struct(F.col("_group").alias("c"), F.lit(1.0).alias("v")),
    ]
    rows = materialise(
        placed.select("competitionid", F.array(*pair).alias("xs"), won(F.col("result")).cast("int").alias("_won"))
    )
    zeros = F.array_repeat(F.lit(0.0), F.count("*").cast("int"))
    open_fits = materialise(
        index.groupBy("competitionid").agg(zeros.alias("accepted"), zeros.alias("candidate")).select(
            F.col("competitionid").cast("int"), "accepted", "candidate",
            F.lit(float("inf")).alias("objective"), F.lit(False).alias("done"),
        )
    )
    fitted = open_fits.limit(0)
    for _ in range(steps):
        if open_fits.isEmpty():
            break
        sums = _sums(rows, open_fits.select("competitionid", "candidate"))
        moved = materialise(open_fits.join(sums, "competitionid").mapInPandas(_advance(alpha, tol), _STATE))
        fitted = fitted.union(moved.filter("done"))
        open_fits = moved.filter("NOT done")
    coefs = fitted.select("competitionid", F.posexplode("accepted").alias("column", "coef"))
    return index.filter("teamid IS NOT NULL").join(coefs, ["competitionid", "column"]).select(
        "competitionid", "teamid", "coef"
    )


def build_power(coefs: DataFrame, snap: bool = True) -> DataFrame:
    """Rankings from 0 to 1 from the coefficients (competitionid, teamid, coef).

    Teams with coefficient 0 carry no information and drop out; so do
    competitions whose teams hardly differ. ``snap`` rounds to fifths of the field.
    """
    strong = coefs.withColumn("_s", F.exp("coef")).filter(F.col("_s") != 1.0)
    bounds = strong.groupBy("competitionid").agg(
        F.min("_s").alias("_low"), (F.max("_s") - F.min("_s")).alias("_range")
    )
    scaled = (
        strong.join(bounds.filter(F.col("_range") >= MIN_RANGE), "competitionid")
        .withColumn("power", (F.col("_s") - F.col("_low")) / F.col("_range"))
        .select("competitionid", "teamid", "power")
    )
    if not snap:
        return scaled
    cuts = scaled.groupBy("competitionid").agg(
        F.percentile("power", F.array(*[F.lit(c) for c in CUTS])).alias("_cuts")
    )
    step = F.when(F.col("_cuts")[0] > F.col("power"), STEPS[0])
    for i in range(1, len(CUTS)):
        step = step.when(F.col("_cuts")[i] > F.col("power"), STEPS[i])
    return scaled.join(cuts, "competitionid").select(
        "competitionid", "teamid", step.otherwise(STEPS[-1]).alias("power")
    )


def power_map(
    games: DataFrame, won: Callable[[Column], Column], steps: int = LOGISTIC_STEPS
) -> DataFrame:
    """Rankings of all competitions; the penalty is halved where teams hardly differ or the fit fails.

    Competitions without a ranking at the smallest penalty have no rows. The fits of one
    penalty run together; a competition that fails does not stop the others.
    """
    rankings, alpha, remaining = [], FIRST_ALPHA, materialise(games)
    while alpha >= LAST_ALPHA and not remaining.isEmpty():
        ranking = materialise(build_power(team_coefficients(remaining, won, alpha, steps=steps)))
        rankings.append(ranking)
        remaining = remaining.join(ranking.select("competitionid").distinct(), "competitionid", "left_anti")
        alpha /= 2
    if not rankings:
        return games.select("competitionid", F.col("first_team").alias("teamid")).limit(0).withColumn(
            "power", F.lit(None).cast("double")
        )
    result = rankings[0]
    for ranking in rankings[1:]:
        result = result.unionByName(ranking)
    return result


def team_power(rankings: DataFrame, data: DataFrame) -> DataFrame:
    """One ranking per team: that of its competition that appears last in ``data``.

    Competitions appear in the order of their first row, newest games first.
    """
    place = F.struct(-F.col("timestamp").cast("double"), F.col("matchid"), F.col("is_home"))
    appearance = data.groupBy("competitionid").agg(F.min(place).alias("_place"))
    return (
        rankings.join(appearance, "competitionid")
        .groupBy("teamid")
        .agg(F.max_by("power", "_place").alias("power"))
    )


def with_power(data: DataFrame, rankings: DataFrame, name: str) -> DataFrame:
    """Add ``power_<name>``; teams without a ranking get 0.5."""
    known = team_power(rankings, data).withColumnRenamed("power", "_power")
    power = F.coalesce("_power", F.lit(UNKNOWN_POWER)).alias(f"power_{name}")
    return data.join(known, "teamid", "left").select(*data.columns, power)


def add_power(data: DataFrame, train: DataFrame, columns: Sequence[PowerColumn]) -> DataFrame:
    """Add a ranking per entry (target column, test on its difference, name)."""
    trained = train.join(data.select("competitionid").distinct(), "competitionid", "left_semi")
    result = data
    for target, won, name in columns:
        rankings = power_map(build_team_matrix(trained, target), won)
        result = with_power(result, rankings, name)
    return result
