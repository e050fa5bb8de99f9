"""Joins on time: points inside intervals, and the last row at or before a time.

Neither holds the rows of a key in one task: intervals meet points in bins of time, and
as-of rows are range-sorted together with the requests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordered import carried_forward, ordered

HOT_BIN = 100_000  # points of a bin that one task joins


def band_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, low: str, high: str, hot: int = HOT_BIN
) -> DataFrame:
    """Every pair of a point and an interval with equal keys and ``low <= at <= high``.

    ``at``, ``low`` and ``high`` are longs; rows in which one of them or a key is null, and
    intervals that end before they begin, join with nothing. Beyond the keys the two
    sides have no column name in common. An interval is put into bins of the next power
    of two above its length, of which it touches at most two; a point is in one bin of every
    width that occurs (64 at most). Points of a bin beyond ``hot`` are dealt to several
    tasks, and its intervals repeated there. Reads both sides twice. Runs a job that finds the widths.
    """
    inside = intervals.filter(F.col(low) <= F.col(high)).withColumn("_width", F.length(F.bin(F.col(high) - F.col(low))))
    widths = [row[0] for row in inside.select("_width").distinct().collect()]
    listed = F.array(*[F.lit(w) for w in widths]).cast("array<int>")

    def bin_of(column: str) -> Column:
        return F.call_function("shiftright", F.col(column), F.col("_width"))

    place = [*keys, "_width", "_bin"]
    placed = points.filter(F.col(at).isNotNull()).withColumn("_width", F.explode(listed)).withColumn("_bin", bin_of(at))
    pieces = placed.groupBy(*place).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(
        *place, F.ceil(F.col("_n") / hot).cast("int").alias("_pieces")
    )
    salt = F.pmod(F.xxhash64(*points.columns), F.coalesce("_pieces", F.lit(1))).cast("int")
    dealt = placed.join(pieces, place, "left").withColumn("_piece", salt).drop("_pieces")
    last = F.coalesce("_pieces", F.lit(1)) - 1
    asked = (
        inside.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
        .join(pieces, place, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
        .drop("_pieces")
    )
    joined = dealt.join(asked, [*place, "_piece"]).filter(F.col(at).between(F.col(low), F.col(high)))
    return joined.drop("_width", "_bin", "_piece")


def asof_join(
    requests: DataFrame, rows: DataFrame, keys: Sequence[str], asked: str, at: str, order_by: Sequence[str] = ()
) -> DataFrame:
    """For each request the last of the rows with its keys at or before its time.

    Returns the requests with ``found``, a struct of the row (null where there is none).
    Rows of one time are told apart by ``order_by``, the highest counts. Requests and rows are
    sorted together by key and time; each request takes the last row before it, which may
    stand in an earlier partition. Repeated requests each have their answer. Runs jobs.
    """
    shared = [F.col(k) for k in keys]
    none = F.lit(None)
    events = rows.select(
        *shared, F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.struct(*rows.columns).alias("_row"),
        none.cast(requests.schema).alias("_request"),
    ).union(
        requests.select(
            *shared, F.col(asked).alias("_at"), F.lit(1).alias("_kind"), none.cast(rows.schema).alias("_row"),
            F.struct(*requests.columns).alias("_request"),
        )
    )
    placed = ordered(events, *shared, F.col("_at"), F.col("_kind"), *[F.col(f"_row.{c}") for c in order_by])
    carried = carried_forward(placed, F.when(F.col("_kind") == 0, F.col("_row")), "_last")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_last.{k}").eqNullSafe(F.col(f"_request.{k}"))
    known = same & F.col(f"_last.{at}").isNotNull() & F.col(f"_request.{asked}").isNotNull()
    return carried.filter("_kind = 1").select("_request.*", F.when(known, F.col("_last")).alias("found"))
