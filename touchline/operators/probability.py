"""Probability tables per zone: shares of counters, from one grouping each.

One job covers all teams; a team filter is pushed down to the summary table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.counters import PASS_ATTEMPTS, PASSES, SET_PIECES
from touchline.functions.expressions import count_where, share
from touchline.operators.documents import document_lines
from touchline.sources.tables import materialise

ZONE = ["section_x", "section_y"]
PLAYER = ("teamid", "playerid")
POSITION = ("position",)
PLAYER_POSITION = ("teamid", "playerid", "position")


@dataclass(frozen=True)
class Shares:
    """Output columns as shares ``part / sum(whole)``; rows without a whole drop out."""

    parts: Mapping[str, str]
    whole: Sequence[str]
    needs_whole: bool = True


def _set_piece_parts(*pieces: str) -> dict[str, str]:
    parts = {}
    for piece in pieces:
        _, attempts, hits = SET_PIECES[piece]
        parts |= {piece: hits, f"{piece}_attempt": attempts}
    return parts


_DEFENSE = Shares(
    {"tackle": "tackles", "intercept": "intercepts", "save": "save"},
    ["defense_event_count"],
    needs_whole=False,
)
SHARES = {
    "shot": Shares({"shot_ontarget": "shots_ontarget"}, ["shot_attempts"]),
    "save": Shares({"save": "save"}, ["save_attempts"]),
    "pass": Shares({name: name for name in PASSES}, PASS_ATTEMPTS),
    "intercept": Shares({"intercept": "intercepts"}, ["intercept_attempts"]),
    "tackle": Shares({"tackle": "tackles"}, ["tackle_attempts"]),
    "foul": Shares(
        {
            "red_card": "red_cards",
            "yellow_card": "yellow_cards",
            **_set_piece_parts("throwin", "free_kick", "penalty_kick"),
        },
        ["throwin_attempts", "free_kick_attempts", "penalty_kick_attempts",
         "yellow_cards", "red_cards"],
    ),
    "out": Shares(
        _set_piece_parts("throwin", "corner_kick"), ["throwin_attempts", "corner_kick_attempts"]
    ),
    "defense": _DEFENSE,
    "offense": _DEFENSE,  # by definition the same shares
}

# move column -> (direction counter, total)
MOVES = {
    "move_x_left": ("direction_x_0", "total_x"),
    "move_x_stay": ("direction_x_1", "total_x"),
    "move_x_right": ("direction_x_2", "total_x"),
    "move_y_up": ("direction_y_0", "total_y"),
    "move_y_stay": ("direction_y_1", "total_y"),
    "move_y_down": ("direction_y_2", "total_y"),
}

BUNDLE = ("move", "shot", "save", "pass", "intercept", "tackle", "foul", "out", "defense", "offense")


def _total(names: Sequence[str]) -> Column:
    return reduce(add, [F.col(name) for name in names])


def _dealt(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows at their groups' tasks before they are summed, where the groups are players'.

    These are as many as the rows of a task that reads, so sums taken there would save no row of
    the shuffle and hold a wide buffer for each. Groups of positions are few and are summed before.
    """
    return rows.repartition(*by, *ZONE) if "playerid" in by else rows


def probability(summary: DataFrame, table: str, by: Sequence[str] = PLAYER) -> DataFrame:
    """One of the tables of ``SHARES`` from the game summary, per ``by`` and zone."""
    shares = SHARES[table]
    whole = _total(shares.whole)
    rows = summary.filter(whole > 0) if shares.needs_whole else summary
    return _dealt(rows, by).groupBy(*by, *ZONE).agg(
        *[share(F.col(part), whole).alias(name) for name, part in shares.parts.items()]
    )


def move_probability(moves: DataFrame, by: Sequence[str] = PLAYER) -> DataFrame:
    """Shares of the six directions from the move summary, per ``by`` and zone."""
    return _dealt(moves, by).groupBy(*by, *ZONE).agg(
        *[share(F.col(part), F.col(total)).alias(name) for name, (part, total) in MOVES.items()]
    )


def with_position_fallback(summary: DataFrame, table: str) -> DataFrame:
    """Player shares, filled from the player's position in zones without own data."""
    names = list(SHARES[table].parts)
    players = probability(summary, table, PLAYER_POSITION)
    positions = probability(summary, table, POSITION).select(
        "position", *ZONE, *[F.col(name).alias(f"_{name}") for name in names]
    )
    wanted = summary.select(*PLAYER_POSITION).distinct().join(positions, "position")
    return wanted.join(players, [*PLAYER_POSITION, *ZONE], "left").select(
        *PLAYER_POSITION,
        *ZONE,
        *[F.coalesce(name, f"_{name}").alias(name) for name in names],
        F.col(names[0]).isNull().alias("from_position"),
    )


def thin_probability(summary: DataFrame, table: str, least: int) -> DataFrame:
    """Player shares that lean on wider groups as far as their own data are thin.

    A zone's share of a player in a position counts fully with ``least`` events; below
    that its weight is events / ``least``, and the rest is the share of the player in
    any position, weighted the same way against that of the position. Every zone
    in which the position has data has a row; ``events`` are the player's own in the position, and
    ``weight`` the share that they decide. One pass over ``summary`` (grouping sets), stored.
    """
    if least < 1:
        raise ValueError("a share needs at least one event to count fully")
    shares = SHARES[table]
    whole, names = _total(shares.whole), list(shares.parts)
    rows = (summary.filter(whole > 0) if shares.needs_whole else summary).withColumn("_whole", whole)
    own, player, position = (
        [*by, *ZONE] for by in (PLAYER_POSITION, PLAYER, POSITION)
    )
    sums = [F.sum("_whole").alias("_n"), *[F.sum(part).alias(f"_{n}") for n, part in shares.parts.items()]]
    grouped = materialise(
        rows.groupingSets([own, player, position], *own).agg(F.grouping_id().alias("_set"), *sums)
    )

    def level(bits: int, keys: Sequence[str], prefix: str) -> DataFrame:
        values = [F.try_divide(f"_{n}", "_n").alias(f"{prefix}{n}") for n in names]
        return grouped.filter(F.col("_set") == bits).select(*keys, F.col("_n").alias(f"{prefix}n"), *values)

    wanted = summary.select(*PLAYER_POSITION).distinct().join(level(0b11000, position, "_c_"), "position")
    joined = wanted.join(level(0, own, "_a_"), own, "left").join(level(0b00100, player, "_b_"), player, "left")

    def weight(prefix: str) -> Column:
        return F.least(F.coalesce(F.col(f"{prefix}n") / least, F.lit(0.0)), F.lit(1.0))

    def blended(name: str, *prefixes: str) -> Column:
        here, *wider = prefixes
        if not wider:
            return F.col(f"{here}{name}")
        rest = blended(name, *wider)
        return weight(here) * F.coalesce(f"{here}{name}", F.lit(0.0)) + (1 - weight(here)) * rest

    return joined.select(
        *own, *[blended(n, "_a_", "_b_", "_c_").alias(n) for n in names],
        F.coalesce("_a_n", F.lit(0)).cast("bigint").alias("events"), weight("_a_").alias("weight"),
    )


def _row_text(names: Mapping[str, Column]) -> Column:
    values = [value.alias(name) for name, value in names.items()]
    return F.to_json(F.struct("playerid", *ZONE, *values), {"ignoreNullFields": "false"})


def _share_rows(summary: DataFrame) -> DataFrame:
    """The rows of all share tables as JSON text, from one grouping of the summary."""
    sums, entries = [], []
    for name, shares in SHARES.items():
        whole = _total(shares.whole)
        counts = whole > 0 if shares.needs_whole else F.lit(True)
        sums += [
            count_where(counts).alias(f"{name}_rows"),
            F.sum(F.when(counts, whole)).alias(f"{name}_whole"),
            *[F.sum(F.when(counts, F.col(c))).alias(f"{name}_{p}") for p, c in shares.parts.items()],
        ]
        ratios = {p: F.try_divide(f"{name}_{p}", f"{name}_whole") for p in shares.parts}
        entries.append(
            F.struct(
                F.lit(BUNDLE.index(name)).alias("table"),
                (F.col(f"{name}_rows") > 0).alias("_present"),
                _row_text(ratios).alias("value"),
            )
        )
    grouped = _dealt(summary, PLAYER).groupBy(*PLAYER, *ZONE).agg(*sums)
    return grouped.select(*PLAYER, *ZONE, F.inline(F.array(*entries))).filter("_present")


def _move_rows(moves: DataFrame) -> DataFrame:
    text = _row_text({name: F.col(name) for name in MOVES})
    table = F.lit(BUNDLE.index("move")).alias("table")
    return move_probability(moves).select(*PLAYER, *ZONE, table, text.alias("value"))


def probability_bundle(
    summary: DataFrame, moves: DataFrame, teamid: int | None = None
) -> DataFrame:
    """The ten tables as one JSON object per team, as ordered text lines.

    See ``document_lines``; write with ``write_document``, keys ``teamid`` and
    order ``playerid, section_x, section_y``. The rows are stored, as the lines need them three times. Runs a job.
    """
    if teamid is not None:
        summary = summary.filter(F.col("teamid") == teamid)
        moves = moves.filter(F.col("teamid") == teamid)
    rows = _share_rows(summary).drop("_present").unionByName(_move_rows(moves))
    return document_lines(materialise(rows), ["teamid"], BUNDLE, ["playerid", *ZONE])
