"""Hard negatives against brute force in whole integers."""

import math

import numpy as np
import pytest

from oracles.compare import connect, differences
from touchline.llm import registry
from touchline.llm.hard_negatives import Settings, angles_to, hard_negatives, reference_directions, score_bounds

SCHEMA = "vec_id long, embedding array<float>, label int, score double, block int, dim string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], SCHEMA)


def brute(rows, anchor, s=Settings()):
    """Rows as (id, vector, label) with distinct ids."""
    ok = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for a, u, y in ok:
        if not anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(u, v)), i, z) for i, v, z in ok if i != a and len(v) == len(u)]
        for ps, p, _ in sorted(r for r in scored if r[2] == y)[: s.positives]:
            fits = sorted(r for r in scored if r[2] != y and s.low * -ps <= 100 * -r[0] <= s.high * -ps)
            out |= {(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits[: s.negatives])}
    return out


def mined(frame, is_anchor, s=Settings()):
    found = hard_negatives(frame, is_anchor, s)
    rows = found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + 0.4 * rng.standard_normal(8))], int(i % 3)) for i in range(400)]
    rows += [(400 + i, rows[5][1], i % 2) for i in range(30)]  # copies: ties everywhere
    return rows


@pytest.mark.parametrize("s", [Settings(), Settings(block=64, pack=5), Settings(references=1, sample=1), Settings(positives=2, negatives=3, low=50, high=110)])
def test_equals_brute_force(spark, vectors, s):
    assert mined(table(spark, vectors), "id % 20 = 0", s) == brute(vectors, lambda i: i % 20 == 0, s)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.1], 2), (3, [0.0, 0.0], 2), (4, [-1.0, 0.0], 2),
        (5, None, 1), (6, [1.0, 0.4], None), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 2),
        (10, [], 1), (None, [1.0, 0.5], 2), (11, [0.5, 0.1, 0.2], 1), (12, [0.5, 0.1, 0.1], 2), (13, [0.2, 0.1, 0.1], 1),
        (14, [0.0, 0.0], 1), (15, [0.0, 0.0], 1),
    ]
    expected = brute(rows, lambda i: True)
    found = mined(table(spark, rows), "id >= 0")
    assert found == expected
    assert any(r[0] == 14 and r[4] == 0 for r in found)
    huge = [*rows, (20, [1e30, 0.0], 1), (21, [1e30, 0.0], 2)]
    assert mined(table(spark, huge), "id >= 0") == expected


def test_repeated_ids_are_one_row(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.6, 0.3], 2)]
    again = [*rows, (1, [1.0, 0.5], 1), (1, [0.1, 0.1], 2), (2, [0.7, 0.3], 2)]
    assert mined(table(spark, again), "id = 0") == brute(rows, lambda i: i == 0) != set()


def test_empty_table(spark):
    assert mined(table(spark, []), "id >= 0") == set()


def test_long_vectors_stay_exact(spark):
    rows = [(i, [float(2**21 + 3 * i), float(i * i)], i % 2) for i in range(12)]
    assert mined(table(spark, rows), "id < 4", Settings(low=0, high=200)) == brute(rows, lambda i: i < 4, Settings(low=0, high=200))


def test_bounds_hold_every_score():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * np.concatenate([rng.standard_normal((300, 6)), np.zeros((1, 6)), rng.standard_normal((50, 6)) * 1e-2]))
    references = reference_directions(list(rows[:40]), 6, 5)
    lengths, angles = angles_to(rows, references)
    for i in range(0, 351, 10):
        low, high = score_bounds(lengths[i], angles[i], lengths, angles)
        scores = rows @ rows[i]
        assert (low <= scores).all() and (scores <= high).all()


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    query = registry.op12_hard_negatives(spark, folder)
    assert differences(query, connect(folder), registry.oracle_sql()["op12_hard_negatives"]) == []
