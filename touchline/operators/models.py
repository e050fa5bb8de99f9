"""Win and goal models on paired feature rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.expressions import equals_integer
from touchline.operators.lasso import LOGISTIC, POISSON, LinearModel, fit_l1
from touchline.operators.match_stats import get_non_feature_columns
from touchline.operators.pairs import KEYS, prepare_data, splice, split, standardize
from touchline.sources.tables import materialise

# Strengths of the penalty: default, training, goal model (fixed values).
L1_ALPHA = 16.0
TRAINING_ALPHA = 8.0
POISSON_ALPHA = 4.0

# Iteration limits of the fits (fixed values).
LOGISTIC_STEPS, POISSON_STEPS = 1024, 10240


def build_model_logistic(
    data: DataFrame,
    label: Column,
    columns: Sequence[str],
    alpha: float = L1_ALPHA,
    tol: float = 1e-8,
) -> LinearModel:
    """Logistic regression; the summed log loss plus ``alpha`` times the L1 norm, intercept included.

    Runs jobs; raises when the fit does not converge.
    """
    rows = materialise(data.select(*columns, label.cast("double").alias("_label")))
    return fit_l1(rows, columns, "_label", LOGISTIC, alpha, tol, LOGISTIC_STEPS)


def build_model_poisson(
    data: DataFrame,
    label: Column,
    columns: Sequence[str],
    alpha: float = POISSON_ALPHA,
    tol: float = 1e-7,
) -> LinearModel:
    """Poisson regression; the summed loss plus ``alpha`` times the L1 norm, intercept included.

    Runs jobs; raises when the fit does not converge.
    """
    rows = materialise(data.select(*columns, label.cast("double").alias("_label")))
    return fit_l1(rows, columns, "_label", POISSON, alpha, tol, POISSON_STEPS)


def coefficients(model: LinearModel) -> list[tuple[str, float]]:
    """Coefficients by feature, the intercept last."""
    return list(zip([*model.columns, "intercept"], model.coefficients))


@dataclass(frozen=True)
class WinModel:
    """A fitted model, its features, and the rows its moments came from."""

    model: LinearModel
    features: list[str]
    train: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.model.columns


def _feature_columns(data: DataFrame, ignore: Iterable[str]) -> list[str]:
    left_out = {*ignore, *KEYS}
    return [name for name in data.columns if name not in left_out]


def _spliced(data: DataFrame, features: Sequence[str], fit_on: DataFrame | None) -> DataFrame:
    return splice(standardize(data, features, fit_on), features)


def train_model(
    data: DataFrame,
    ignore: Iterable[str] | None = None,
    target: str = "points",
    won: Callable[[Column], Column] = equals_integer(3),
    alpha: float = TRAINING_ALPHA,
    seed: int = 0,
) -> tuple[WinModel, DataFrame]:
    """Fit on a share of the matches; returns the model and the test rows.

    ``ignore`` names the columns that are no features, by default metadata and
    outcomes.
    """
    ignored = [*(get_non_feature_columns() if ignore is None else ignore), target]
    train, test = split(materialise(prepare_data(data)), seed=seed)
    features = _feature_columns(data, ignored)
    columns = [*features, *[f"opp_{name}" for name in features if name != "is_home"]]
    spliced = _spliced(train, features, None)
    model = build_model_logistic(spliced, won(F.col(target)).cast("int"), columns, alpha)
    return WinModel(model, features, train), test


def predict_model(model: WinModel, data: DataFrame, fit_on: str = "self") -> DataFrame:
    """Add ``predicted``, the probability that the row's team wins.

    The features are standardised with the moments of the data itself;
    ``fit_on="train"`` takes those of the training rows.
    """
    moments = model.train if fit_on == "train" else None
    spliced = _spliced(data.select(*KEYS, *model.features), model.features, moments)
    scored = spliced.select(*KEYS, model.model.mean().alias("predicted"))
    return data.join(scored, KEYS)
