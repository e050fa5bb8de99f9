import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.operators.ordered import (
    lookback_blocks,
    ordered,
    running_totals,
    with_position,
    with_previous,
)


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    """One key holds most rows."""
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(100)) for i in range(700)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t bigint, v bigint").repartition(7)


def test_position_totals_and_previous(frame, rows):
    placed = ordered(frame, F.col("k"), F.desc("t"))
    assert placed.select("_part").distinct().count() > 1
    placed = with_previous(with_position(placed), {"before": "v"})
    result = running_totals(placed, {"total": F.col("v")}).collect()
    total, before = 0, None
    assert len(result) == len(rows)
    for place, row in enumerate(sorted(result, key=lambda r: (r.k, -r.t))):
        total += row.v
        assert (row._pos, row.before, row.total) == (place, before, total)
        before = row.v


def test_sort_order_is_the_requested_one(frame, rows):
    result = with_position(ordered(frame, F.desc("v"), F.col("t"))).orderBy("_pos").collect()
    assert [(r.v, r.t) for r in result] == sorted([(v, t) for _, t, v in rows], key=lambda r: (-r[0], r[1]))


@pytest.mark.parametrize("look, size", [(3, 5), (5, 5), (1, 4)])
def test_blocks_give_the_plain_window(frame, look, size):
    blocks = lookback_blocks(frame, ["k"], [F.col("t")], look, size=size)
    assert blocks.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= size + look
    last = W.partitionBy("k", "_block").orderBy("_pos").rowsBetween(-look, -1)
    found = blocks.withColumn("s", F.sum("v").over(last)).filter("NOT _context")
    plain = W.partitionBy("k").orderBy("t").rowsBetween(-look, -1)
    expected = frame.withColumn("s", F.sum("v").over(plain))
    assert sorted(found.select("k", "t", "s").collect(), key=str) == sorted(
        expected.select("k", "t", "s").collect(), key=str
    )


def test_block_shorter_than_look_back_is_refused(frame):
    with pytest.raises(ValueError):
        lookback_blocks(frame, ["k"], [F.col("t")], 5, size=4)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k string, t bigint")
    assert with_position(ordered(empty, F.col("t"))).count() == 0
