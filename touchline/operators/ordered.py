"""Exact order-dependent results over any key distribution.

A window over a hot key, or over no key at all, ends up in one task. Here the
rows are range-sorted by all their ordering columns, so even one key's rows
spread over many partitions, and only one summary row per partition is carried
from each partition to the next.

``ordered`` stores the sorted rows with their place: range sampling may choose
other bounds when a stage is recomputed, and a stored place cannot change.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from touchline.sources.tables import materialise

PART, SEQ = "_part", "_seq"
_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _in_part() -> WindowSpec:
    return W.partitionBy(PART).orderBy(SEQ)


def ordered(frame: DataFrame, *order_by: Column) -> DataFrame:
    """Store ``frame`` sorted, each row with its partition and place therein.

    The order should be total: rows that tie keep an arbitrary but fixed order.
    """
    stamped = frame.orderBy(*order_by).withColumn(SEQ, F.monotonically_increasing_id())
    return materialise(stamped.withColumn(PART, F.shiftright(SEQ, _BITS)))


def _carried(parts: DataFrame, carry: Mapping[str, Column], *keep: str) -> DataFrame:
    """Carry a value from partition to partition; one row per partition in all."""
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carried = [column.over(earlier).alias(name) for name, column in carry.items()]
    return F.broadcast(parts.select(PART, *keep, *carried))


def running_totals(placed: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums over the whole order of an ``ordered`` frame."""
    valued = placed.select("*", *[column.alias(f"_v_{name}") for name, column in totals.items()])
    parts = valued.groupBy(PART).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in totals])
    offsets = _carried(parts, {f"_o_{n}": F.sum(f"_v_{n}") for n in totals})
    so_far = _in_part().rowsBetween(W.unboundedPreceding, 0)
    inside = valued.select(
        *placed.columns, *[F.sum(f"_v_{n}").over(so_far).alias(f"_s_{n}") for n in totals]
    )
    return inside.join(offsets, PART).select(
        *placed.columns,
        *[(F.col(f"_s_{n}") + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in totals],
    )


def with_position(placed: DataFrame, name: str = "_pos") -> DataFrame:
    """Add the zero-based position in the whole order."""
    parts = placed.groupBy(PART).agg(F.count("*").alias("_rows"), F.min(SEQ).alias("_first"))
    starts = _carried(parts, {"_before": F.sum("_rows")}, "_first")
    place = F.col(SEQ) - F.col("_first") + F.coalesce("_before", F.lit(0))
    return placed.join(starts, PART).select(*placed.columns, place.alias(name))


def with_previous(placed: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns of the previous row in the whole order (``{name: source}``)."""
    row = F.struct(*columns.values())
    parts = placed.groupBy(PART).agg(F.max_by(row, F.col(SEQ)).alias("_last"))
    carried = _carried(parts, {"_before": F.last("_last")})
    inside = placed.withColumn("_inside", F.lag(row).over(_in_part()))
    previous = F.coalesce("_inside", "_before")
    return inside.join(carried, PART).select(
        *placed.columns, *[previous[source].alias(name) for name, source in columns.items()]
    )


def carried_forward(placed: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the last non-null ``value`` at or before each row of an ``ordered`` frame."""
    valued = placed.withColumn("_v", value)
    parts = valued.groupBy(PART).agg(
        F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.col(SEQ))).alias("_last")
    )
    carried = _carried(parts, {"_before": F.last("_last", ignorenulls=True)})
    so_far = _in_part().rowsBetween(W.unboundedPreceding, 0)
    inside = valued.withColumn("_inside", F.last("_v", ignorenulls=True).over(so_far))
    return inside.join(carried, PART).select(*placed.columns, F.coalesce("_inside", "_before").alias(name))


def exact_percentiles(frame: DataFrame, by: Sequence[str], value: str, cuts: Sequence[float]) -> DataFrame:
    """``by``, ``cut``, ``value``: percentiles with linear interpolation, for groups of any size.

    Nulls do not count; a group without values has no rows. The two order statistics of
    a cut are picked by their rank in the whole sorted column, so no group is held in a buffer.
    """
    placed = with_position(ordered(frame.filter(F.col(value).isNotNull()).select(*by, value), *[F.col(k) for k in by], F.col(value)))
    bounds = placed.groupBy(*by).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    rank = F.col("cut") * (F.col("_n") - 1)
    wanted = bounds.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).select(
        *by, "cut", (rank - F.floor(rank)).alias("_part"),
        F.explode(F.array(F.floor(rank), F.ceil(rank))).alias("_rank"), "_first",
    )
    picked = wanted.distinct().withColumn("_pos", F.col("_first") + F.col("_rank")).join(
        placed.select("_pos", F.col(value).cast("double").alias("_value")), "_pos"
    )
    low, high = F.min("_value"), F.max("_value")
    return picked.groupBy(*by, "cut").agg((low + (high - low) * F.first("_part")).alias("value"))


def lookback_blocks(
    frame: DataFrame, keys: Sequence[str], order_by: Sequence[Column], rows: int, size: int = 0
) -> DataFrame:
    """Cut ordered groups into blocks in which every row sees ``rows`` earlier rows.

    Adds ``_pos``, ``_block`` and ``_context``. Each block repeats the last
    ``rows`` rows of the block before it, marked as context: evaluate a
    ``rowsBetween(-rows, -1)`` window over (keys, _block) by _pos, then drop the
    context rows. No window group exceeds ``size + rows`` rows.
    """
    size = size or max(10_000, 100 * rows)
    if size < rows:
        raise ValueError("a block must be at least as long as the look-back")
    placed = with_position(ordered(frame, *[F.col(k) for k in keys], *order_by))
    home = F.floor(F.col("_pos") / size)
    seen_by = F.when(F.col("_pos") % size >= size - rows, F.array(home, home + 1)).otherwise(
        F.array(home)
    )
    return (
        placed.drop(PART, SEQ)
        .withColumn("_block", F.explode(seen_by))
        .withColumn("_context", F.col("_block") != home)
    )
