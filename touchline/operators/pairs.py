"""Operators on feature tables with two mirrored rows per match."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["matchid", "teamid", "op_teamid"]

# Results of a match, by points of the team named first (fixed thresholds).
_WON_ABOVE, _LOST_BELOW, _DRAWN_ABOVE = 1.1, 0.9, -0.1


def drop_unbalanced_matches(data: DataFrame) -> DataFrame:
    """Drop rows with a NULL, then matches that do not have exactly two rows."""
    complete = data.dropna()
    rows = complete.groupBy("matchid").agg(F.count("*").alias("_rows"))
    return complete.join(rows.filter(F.col("_rows") == 2), "matchid", "left_semi")


def check_data(data: DataFrame) -> DataFrame:
    """Rows whose match has no row with the two teams swapped; none if all is well."""
    mirrored = data.select(
        "matchid", F.col("op_teamid").alias("teamid"), F.col("teamid").alias("op_teamid")
    )
    return data.select(*KEYS).join(mirrored, KEYS, "left_anti")


def prepare_data(data: DataFrame) -> DataFrame:
    """Balanced matches only; raises if a remaining row has no mirror row."""
    balanced = drop_unbalanced_matches(data)
    if not check_data(balanced).isEmpty():
        raise ValueError("the two rows of a match must mirror each other")
    return balanced


def hash_fraction(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32


def split(
    data: DataFrame, test_proportion: float = 0.4, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; both rows of a match fall on the same side."""
    chosen = hash_fraction(F.col("matchid"), seed) > test_proportion
    return data.filter(chosen), data.filter(~chosen)


def extract_target(data: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The target with the keys of its rows, and the data without the target."""
    keys = [name for name in KEYS if name in data.columns]
    return data.select(*keys, target), data.drop(target)


def clone_and_drop(data: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the columns that are there."""
    return data.drop(*columns)


def coerce(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles."""
    return data.withColumns({name: F.col(name).cast("double") for name in columns})


def column_moments(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of every column, in one row."""
    return data.agg(
        F.struct(
            *[F.avg(name).alias(f"mean_{name}") for name in columns],
            *[F.stddev_pop(name).alias(f"std_{name}") for name in columns],
        ).alias("moments")
    )


def standardize(
    data: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None
) -> DataFrame:
    """Subtract the mean and divide by the standard deviation, unless it is tiny.

    The moments come from the data itself, or from ``fit_on`` (such as the
    training rows); they are one row, computed in one pass for all columns.
    """
    data = coerce(data, columns)
    source = data if fit_on is None else coerce(fit_on, columns)
    moments = column_moments(source, columns).scalar()

    def scaled(name: str) -> Column:
        value, std = F.col(name), F.col("_moments")[f"std_{name}"]
        mean = F.col("_moments")[f"mean_{name}"]
        return F.when(F.abs(std) > 0.001, (value - mean) / std).otherwise(value)

    return (
        data.withColumn("_moments", moments)
        .withColumns({name: scaled(name) for name in columns})
        .drop("_moments")
    )


def splice(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Append the opponent row's columns as ``opp_*`` (its home flag left out)."""
    opponent = data.select(
        "matchid",
        F.col("teamid").alias("op_teamid"),
        *[F.col(name).alias(f"opp_{name}") for name in columns if name != "is_home"],
    )
    return data.join(opponent, ["matchid", "op_teamid"])


def games(data: DataFrame) -> DataFrame:
    """One row per match: the first by (is_home, teamid)."""
    rest = [c for c in data.columns if c not in ("matchid", "is_home", "teamid")]
    order = W.partitionBy("matchid").orderBy("is_home", "teamid", *rest)
    ranked = data.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).select(*data.columns)


def normalize(data: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A column as share of its total."""
    total = data.agg(F.sum(column).cast("double")).scalar()
    return data.withColumn(name or column, F.try_divide(F.col(column), total))


def extract_predictions(data: DataFrame, predicted: str = "predicted") -> DataFrame:
    """One row per match: teams, predicted percent, expected and actual winner."""
    columns = ["matchid", "teamid", "is_home", "team_name", "op_team_name", predicted]
    known = "points" in data.columns
    first = games(data.select(*columns, *(["points"] if known else [])))
    percent = F.col(predicted) * 100
    result = first.select(
        "matchid",
        "team_name",
        "op_team_name",
        percent.alias("predicted"),
        F.when(percent >= 50, F.col("team_name")).otherwise(F.col("op_team_name")).alias("expected"),
        *(["points"] if known else []),
    )
    if not known:
        return result
    winner = (
        F.when(F.col("points") > _WON_ABOVE, F.col("team_name"))
        .when(F.col("points") < _LOST_BELOW, F.col("op_team_name"))
        .when(F.col("points") > _DRAWN_ABOVE, "draw")
        .otherwise("NA")
    )
    return result.withColumn("winner", winner)


def apply_home_advantage(match_games: DataFrame, advantage: DataFrame) -> DataFrame:
    """Replace the 0/1 home flag by the team's fractional one, where there is one."""
    fraction = advantage.select(
        F.col("teamid").cast("bigint").alias("teamid"), F.col("is_home").alias("_is_home")
    )
    return match_games.join(fraction, "teamid", "left").select(
        *[
            F.coalesce("_is_home", name).alias(name) if name == "is_home" else F.col(name)
            for name in match_games.columns
        ]
    )
