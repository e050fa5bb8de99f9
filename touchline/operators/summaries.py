"""Counters per place and second, movement directions, cumulative state.

All three operators reduce events before they join: the counts of a player's
touches do not depend on the position, so they are summed first and multiplied
by how often the position join would repeat them. The joins then meet
already-unique rows, and no aggregation follows that would pin a hot player to
one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import schema
from touchline.functions.counters import (
    COMPOSITES,
    COUNTED_TYPES,
    STATE_COUNTERS,
    Counter,
    countable,
    counters,
    pass_band,
    pass_end,
)
from touchline.functions.expressions import zone_x, zone_y
from touchline.operators.events import explode_qualifiers

PLAYER = ["matchid", "teamid", "playerid"]
SECOND = ["matchid", "playerid", "timestamp"]
MASK_BITS = 62  # counters that one long tells
DIRECTIONS = [f"direction_{axis}_{turn}" for axis in "xy" for turn in (2, 1, 0)]


def _position_counts(positions: DataFrame) -> DataFrame:
    return positions.groupBy(*PLAYER, "position").agg(F.count("*").alias("_times"))


def _total(names: list[str]) -> Column:
    return reduce(add, [F.col(name) for name in names])


def _row_test(counter: Counter, event_grain: bool) -> Column:
    return counter.on_event_row() if event_grain else counter.on_qualifier_row()


def countable_rows(events: DataFrame, event_grain: bool = False) -> DataFrame:
    """The rows that count in some counter, at qualifier grain or at event grain."""
    rows = events.filter(F.col("typeid").isin(*COUNTED_TYPES))
    if event_grain:
        coded = F.transform(
            "qualifiers",
            lambda q: F.struct(
                q["type"].alias("type"),
                pass_band(pass_end(q["type"], q["value"])).alias("band"),
            ),
        )
        rows = rows.withColumn("qualifiers", coded)
    else:
        rows = (
            explode_qualifiers(rows)
            .withColumn("_end_x", pass_end(F.col("type"), F.col("value")))
            .withColumn("band", pass_band(F.col("_end_x")))
            .drop("value", "_end_x")
        )
    return rows.filter(reduce(or_, [_row_test(test, event_grain) for test in countable()]))


def game_summary(
    events: DataFrame,
    positions: DataFrame,
    event_grain: bool = False,
    extra: Sequence[Counter] = (),
) -> DataFrame:
    """34 counters and 3 composite counts per match, second, player, position and place.

    At qualifier grain (the default) a counter that asks for no qualifier counts
    an event once per qualifier; ``event_grain=True`` counts every event once.
    ``extra`` counters, which count no other rows, become further columns.
    """
    declared = [*counters(), *extra]
    bit = {counter.name: divmod(i, MASK_BITS) for i, counter in enumerate(declared)}
    place = [*PLAYER, "timestamp", "x", "y"]
    masks = [
        reduce(Column.bitwiseOR, [
            F.when(_row_test(c, event_grain), F.lit(1 << i).cast("bigint")).otherwise(0)
            for i, c in enumerate(declared[start : start + MASK_BITS])
        ]).alias(f"_mask_{start // MASK_BITS}")
        for start in range(0, len(declared), MASK_BITS)
    ]
    names = [f"_mask_{i}" for i in range(len(masks))]
    hits = (
        countable_rows(events, event_grain)
        .select(*place, *masks)
        .repartition(*PLAYER)  # serves both groupings and the join; only masks are shuffled
        .groupBy(*place, *names)
        .agg(F.count("*").alias("_n"))
        .groupBy(*place)
        .agg(F.collect_list(F.struct("_n", *names)).alias("_hits"))
    )

    def counted(*parts: str) -> Column:
        wanted = [sum(1 << i for m, i in map(bit.get, parts) if m == k) for k in range(len(masks))]

        def of(hit: Column) -> Column:
            found = [F.bit_count(hit[n].bitwiseAND(F.lit(w).cast("bigint"))) for n, w in zip(names, wanted) if w]
            return hit["_n"] * reduce(add, found)

        # nearly every place has rows of one kind
        several = F.aggregate("_hits", F.lit(0).cast("bigint"), lambda total, hit: total + of(hit))
        return F.when(F.size("_hits") == 1, of(F.col("_hits")[0])).otherwise(several)

    columns = {**COMPOSITES, **{name: [name] for name in bit}}
    return hits.join(_position_counts(positions.repartition(*PLAYER)), PLAYER).select(
        "matchid", "timestamp", "teamid", "playerid", "position",
        zone_x(F.col("x")).alias("section_x"),
        zone_y(F.col("y")).alias("section_y"),
        "x", "y",
        *[(counted(*parts) * F.col("_times")).alias(name) for name, parts in columns.items()],
    )


def _seconds(events: DataFrame) -> DataFrame:
    """One row per player and second of a match, with its distinct touches ordered by team, x and y."""
    return (
        events.filter(F.col("playerid") != 0)
        .select(*SECOND, "teamid", "x", "y")
        .repartition(*SECOND)  # serves the distinct rows and the array
        .distinct()
        .groupBy(*SECOND)
        .agg(F.sort_array(F.collect_list(F.struct("teamid", "x", "y"))).alias("_spots"))
    )


def _with_before(seconds: DataFrame) -> DataFrame:
    """Add the last spot of the player's second before; seconds without a time come first."""
    by_second = W.partitionBy("matchid", "playerid").orderBy(F.asc_nulls_first("timestamp"))
    return seconds.withColumn("_before", F.lag(F.element_at("_spots", -1)).over(by_second))


def previous_touches(events: DataFrame) -> DataFrame:
    """Distinct touches of each player in a match with the place of the touch before.

    Ties in a second are ordered by team, x and y. The look-back has two steps:
    inside a second (an array of no more places than there are on the field), then from
    second to second (one row each). So a player who holds most of the data does
    not end up in one window group.
    """
    touches = _with_before(_seconds(events)).select(
        *SECOND, "_before", "_spots", F.posexplode("_spots").alias("_i", "_spot")
    )
    previous = F.when(F.col("_i") == 0, F.col("_before")).otherwise(F.get("_spots", F.col("_i") - 1))
    return touches.select(
        "matchid", "playerid", F.col("_spot.teamid").alias("teamid"), "timestamp",
        F.col("_spot.x").alias("x"), F.col("_spot.y").alias("y"),
        previous["x"].alias("prev_x"), previous["y"].alias("prev_y"),
    )


def move_summary(
    events: DataFrame, positions: DataFrame, fix_prev_y: bool = False
) -> DataFrame:
    """How often a player came from a lower, the same or a higher zone.

    As defined for this table, the upper y edge is compared with the previous x;
    ``fix_prev_y=True`` compares the previous y. A first touch has no previous
    place and so comes from the last zone on both axes. The look-back is that of ``previous_touches``:
    from second to second a touch is its team and its zones in one number. The moves of a
    second are counted in its array.
    """
    low, high = schema.Y_EDGES

    def zones(spot: Column) -> Column:
        """Bits 4 and up the x zone, 2 and 3 the y zone, 0 and 1 the y zone as the next touch sees it."""
        upper = spot["y"] if fix_prev_y else spot["x"]
        left_y = F.when(spot["y"] <= low, 0).when(upper <= high, 1).otherwise(2)
        return zone_x(spot["x"]) * 16 + zone_y(spot["y"]) * 4 + left_y

    def turns(spot: Column, before: Column) -> dict[str, Column]:
        found = {}
        last = {"x": len(schema.X_EDGES), "y": len(schema.Y_EDGES)}
        now = {"x": F.shiftright(spot["zones"], 4), "y": F.shiftright(spot["zones"], 2).bitwiseAND(F.lit(3))}
        came = {"x": F.shiftright(before["zones"], 4), "y": before["zones"].bitwiseAND(F.lit(3))}
        for axis in "xy":
            come = F.coalesce(came[axis], F.lit(last[axis]))
            found[axis] = F.when(now[axis] < come, 2).when(now[axis] == come, 1).otherwise(0)
        return found

    def place(spot: Column) -> Column:
        return F.struct(spot["teamid"].alias("teamid"), F.shiftright(spot["zones"], 2).alias("zone"))

    def move(spot: Column, before: Column) -> Column:
        return F.struct(place(spot).alias("place"), *[t.alias(a) for a, t in turns(spot, before).items()])

    coded = F.transform("_spots", lambda s: F.struct(s["teamid"].alias("teamid"), zones(s).alias("zones")))
    seconds = _with_before(_seconds(events).withColumn("_spots", coded))
    # by match and player, as the look-back has dealt the seconds
    placed = _position_counts(positions).groupBy("matchid", "playerid").agg(
        F.collect_list(F.struct(F.col("teamid").alias("_team"), "position", "_times")).alias("_placed")
    )
    one, first = F.size("_spots") == 1, F.col("_spots")[0]  # nearly every second has one touch
    earlier = F.concat(F.array("_before"), F.slice("_spots", 1, F.size("_spots") - 1))
    moves = seconds.join(placed, ["matchid", "playerid"]).select(
        *SECOND, "_placed", one.alias("_one"), *[t.alias(f"_{a}") for a, t in turns(first, F.col("_before")).items()],
        F.when(~one, F.zip_with("_spots", earlier, move)).alias("_moves"),
        F.explode(
            F.when(one, F.array(place(first))).otherwise(F.array_distinct(F.transform("_spots", place)))
        ).alias("_place"),
    )

    def counted(test: Column, of: Callable[[Column], Column]) -> Column:
        here = F.filter("_moves", lambda m: m["place"].eqNullSafe(F.col("_place")) & of(m))
        return F.when(F.col("_one"), test.cast("int")).otherwise(F.size(here)).cast("bigint")

    directions = [
        counted(F.col(f"_{axis}") == turn, lambda m, a=axis, t=turn: m[a] == t).alias(f"direction_{axis}_{turn}")
        for axis in "xy" for turn in (2, 1, 0)
    ]
    own = F.filter("_placed", lambda p: p["_team"] == F.col("_place.teamid"))
    zone = F.col("_place.zone")
    counts = moves.select(
        *SECOND, F.col("_place.teamid").alias("teamid"),
        F.shiftright(zone, 2).alias("section_x"), zone.bitwiseAND(F.lit(3)).alias("section_y"), *directions,
        counted(F.lit(True), lambda m: F.lit(True)).alias("_rows"), own.alias("_own"),
    )
    times = F.col("_times")
    return counts.select("*", F.inline("_own")).select(
        "matchid", "timestamp", "playerid", "teamid", "position", "section_x", "section_y",
        *[(F.col(name) * times).alias(name) for name in DIRECTIONS],
        (F.col("_rows") * times).alias("total_x"),
        (F.col("_rows") * times).alias("total_y"),
    )


def touches_summary(summary: DataFrame) -> DataFrame:
    """Cumulative counters per player and match; time as a share of the match.

    The running sums are taken over one row per second, then given to all rows
    of that second (rows that tie share their value). Rows without a time come before
    all others of their player. The rows are dealt once, by match, and sorted with none but their
    counters above 0, each in one number with its place among them (the lower 6 bits); the sums are spread out after that. Reads ``summary`` twice, so pass a stored table.
    """
    above = F.filter(
        F.array(*[_total(parts).cast("bigint") * 64 + i for i, parts in enumerate(STATE_COUNTERS.values())]),
        lambda count: (count < 0) | (count >= 64),
    )
    place = F.struct("teamid", "position", "x", "y")
    span = summary.groupBy("matchid").agg(F.min("timestamp").alias("_start"), F.max("timestamp").alias("_end"))
    per_second = (
        summary.select(*SECOND, place.alias("_place"), above.alias("_above"))
        .repartition("matchid")  # serves the grouping, the join and the window
        .groupBy(*SECOND)
        .agg(F.collect_list("_place").alias("_places"), F.flatten(F.collect_list("_above")).alias("_above"))
        .join(span, "matchid")
        .sortWithinPartitions("matchid", "playerid", "timestamp")
    )

    def counted(i: int) -> Column:
        def of(count: Column) -> Column:
            return F.when(count.bitwiseAND(F.lit(63)) == i, F.shiftright(count, 6)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate("_above", F.lit(0).cast("bigint"), lambda total, count: total + of(count))

    so_far = (
        W.partitionBy("matchid", "playerid")
        .orderBy(F.asc_nulls_first("timestamp"))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    elapsed = F.try_divide(F.col("timestamp") - F.col("_start"), F.col("_end") - F.col("_start"))
    spread = per_second.select(
        *SECOND, elapsed.alias("_elapsed"), "_places", *[counted(i).alias(n) for i, n in enumerate(STATE_COUNTERS)]
    )
    running = spread.select(
        *SECOND, "_elapsed", "_places", *[F.sum(name).over(so_far).alias(name) for name in STATE_COUNTERS]
    )
    return running.select("*", F.inline("_places")).select(
        F.col("_elapsed").alias("timestamp"),
        "matchid", "teamid", "position", "playerid", "x", "y",
        *STATE_COUNTERS,
    )
