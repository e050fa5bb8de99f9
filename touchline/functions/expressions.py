"""Small Column expressions: zones, guarded ratios, qualifier tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import schema


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge that ``value`` does not exceed.

    NULL compares with nothing and so lands in the last bucket.
    """
    first, *rest = enumerate(edges)
    chain = F.when(value <= first[1], first[0])
    for index, edge in rest:
        chain = chain.when(value <= edge, index)
    return chain.otherwise(len(edges))


def zone_x(x: Column) -> Column:
    return bucket(x, schema.X_EDGES)


def zone_y(y: Column) -> Column:
    return bucket(y, schema.Y_EDGES)


def count_where(test: Column) -> Column:
    """Rows that pass a test.

    Not count_if: that one turns each test into a column below the aggregation,
    and with many overlapping tests the planning time explodes.
    """
    return F.count(F.when(test, 1))


def guarded_ratio(top: Column, bottom: Column, default: Column) -> Column:
    """``top / bottom`` where ``bottom`` is positive, else ``default``."""
    return F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(default)


def share(part: Column, whole: Column) -> Column:
    """Ratio of two sums; NULL when the whole is 0."""
    return F.try_divide(F.sum(part), F.sum(whole))


def points(own: Column, other: Column) -> Column:
    """Match points: 3 for a win, 1 for a draw, else 0."""
    return F.when(own > other, 3).when(own == other, 1).otherwise(0)


def equals_integer(number: int) -> Callable[[Column], Column]:
    """Predicate: does a column hold this integer (fractions cut off)?"""
    return lambda column: column.cast("int") == int(number)


def has_qualifier(*types: int) -> Column:
    """Does any qualifier of the event have one of these types?

    Reads only the types out of the qualifier array.
    """
    if len(types) == 1:
        found = F.array_contains(F.col("qualifiers.type"), types[0])
    else:
        found = F.arrays_overlap(F.col("qualifiers.type"), F.array(*[F.lit(t) for t in types]))
    return F.coalesce(found, F.lit(False))


def is_qualified() -> Column:
    """Does the event have any qualifier with a type?"""
    return F.array_max(F.col("qualifiers.type")).isNotNull()
