"""Helpers to write SQL text."""

from __future__ import annotations

from collections.abc import Iterable


def rounded(expression: str, name: str) -> str:
    """A double to 6 decimals; adding 0 turns -0.0 into 0.0."""
    return f"ROUND(CAST({expression} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name}"


def rounded_all(names: Iterable[str], prefix: str = "") -> str:
    return ", ".join(rounded(f"{prefix}{name}", name) for name in names)


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def zone_x(x: str) -> str:
    return (
        f"CASE WHEN {x} <= 16.6 THEN 0 WHEN {x} <= 33.2 THEN 1 WHEN {x} <= 49.9 THEN 2"
        f" WHEN {x} <= 66.4 THEN 3 WHEN {x} <= 83 THEN 4 ELSE 5 END"
    )


def zone_y(y: str) -> str:
    return f"CASE WHEN {y} <= 33 THEN 0 WHEN {y} <= 66 THEN 1 ELSE 2 END"
