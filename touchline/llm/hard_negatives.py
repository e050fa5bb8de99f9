"""Hard-negative mining by the triangle inequality of angles.

Every vector stores its angles to a few reference directions. For an anchor and a row
they bound the angle between the two, and so, times both lengths, their score:
only rows whose bounds reach into a wanted window of scores are multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.sources.tables import materialise

_SLACK = 1e-6  # of an angle: far above the rounding of arc cosines
_EXACT = 2.0**53  # integers below are exact in double precision
_LONGEST = 2.0**31  # no score of shorter vectors leaves a 64-bit integer


@dataclass(frozen=True)
class Settings:
    """references: directions, chosen among ``sample`` rows with the smallest hashes.

    positives, negatives: rows returned per anchor and per positive; low, high: the
    window of negative scores in percent of the positive's. block, pack: rows and anchors
    that meet in one task.
    """

    references: int = 12
    sample: int = 2_048
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    block: int = 4_096
    pack: int = 4_096


def reference_directions(vectors: list[np.ndarray], dim: int, count: int) -> np.ndarray:
    """Unit directions far from each other: the mean, then farthest points of the sample.

    Without a sample of this length, fixed random directions.
    """
    own = [v for v in vectors if len(v) == dim and np.any(v)]
    if not own:
        own = list(np.random.default_rng(dim).standard_normal((count, dim)))
    rows = np.array(own, float)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    mean = rows.mean(axis=0)
    length = np.linalg.norm(mean)
    chosen = [mean / length if length > 1e-9 else rows[0]]
    nearest = rows @ chosen[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(rows[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, rows @ chosen[-1])
    return np.array(chosen)


def angles_to(rows: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows and their angles to the references; a zero row has right angles."""
    lengths = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
    cosines = (rows @ references.T) / np.where(lengths > 0, lengths, 1)[:, None]
    return lengths, np.arccos(np.clip(cosines, -1, 1))


def score_bounds(
    length: float, angles: np.ndarray, lengths: np.ndarray, others: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Integers that no score of a vector with the others lies below or above."""
    least = np.clip(np.abs(others - angles).max(axis=1) - _SLACK, 0, np.pi)
    total = others + angles
    most = np.clip(np.minimum(total, 2 * np.pi - total).min(axis=1) + _SLACK, 0, np.pi)
    scale = length * lengths
    rounding = 1 + scale * 1e-9
    return np.floor(scale * np.cos(most) - rounding), np.ceil(scale * np.cos(least) + rounding)


class _Block:
    """Rows of a task as one matrix, with what the bounds need."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.rows = _matrix(table, "vector", "<i8")
        self.lengths = table.column("length").to_numpy()
        self.angles = _matrix(table, "angles", "<f8")
        longest = self.lengths.max(initial=0)
        self.fits = longest * longest < _EXACT
        if self.fits:
            self.rows = self.rows.astype(float)

    def scores(self, other: _Block, i: int, at: np.ndarray) -> np.ndarray:
        """Exact integer scores of the other block's row i with the rows ``at``."""
        if self.fits and other.fits:
            return (self.rows[at] @ other.rows[i]).astype(np.int64)
        return self.rows[at].astype(np.int64) @ other.rows[i].astype(np.int64)


def _matrix(table: pa.Table, column: str, kind: str) -> np.ndarray:
    blobs = table.column(column).to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:count]


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """One row per id with a label and a finite vector, as the operator defines it."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LONGEST / scale))
    whole = rows.filter("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").filter(F.coalesce(finite, F.lit(False)))
    return whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


_STORED = "id long, label long, dim int, vector binary, length double, angles binary"


def _indexed(rows: DataFrame, s: Settings, scale: int) -> DataFrame:
    """Integer vectors with their lengths and angles to the references."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(s.sample).select("v").collect()
    known = [np.floor(np.array(r["v"]) * scale) for r in sample]
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_dim: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.floor(np.array(v, float) * scale) for v in batch.column("v").to_pylist()]
            out = []
            for v in vectors:
                if len(v) not in of_dim:
                    of_dim[len(v)] = reference_directions(shared.value, len(v), s.references)
                lengths, angles = angles_to(v[None], of_dim[len(v)])
                out.append((len(v), v.astype("<i8").tobytes(), float(lengths[0]), angles[0].tobytes()))
            dims, blobs, lengths, angles = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary()),
                 pa.array(lengths, pa.float64()), pa.array(angles, pa.binary())],
                names=["id", "label", "dim", "vector", "length", "angles"],
            )

    return materialise(rows.mapInArrow(run, _STORED)).filter(F.col("length") < _LONGEST)


def _dealt(rows: DataFrame, anchors: DataFrame, group: list[str], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Both sides with the key of every block that they take part in.

    A group's rows are cut into blocks and its anchors into packs of bounded size;
    every block of a group meets every pack of it in a task of its own.
    """
    def parts(frame: DataFrame, size: int, name: str) -> DataFrame:
        return frame.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    sizes = parts(rows, s.block, "blocks").join(parts(anchors, s.pack, "packs"), group)

    def cut(frame: DataFrame, own: str, other: str, name: str, opposite: str) -> DataFrame:
        sized = frame.join(sizes, group)
        return sized.withColumn(name, F.pmod(F.xxhash64("id", F.lit(3)), F.col(own)).cast("int")).withColumn(
            opposite, F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        ).drop("blocks", "packs")

    return cut(rows, "blocks", "packs", "block", "pack"), cut(anchors, "packs", "blocks", "pack", "block")


def _top(found: DataFrame, keys: list[str], count: int, id_col: str) -> DataFrame:
    """The best rows per key; partial ranks before the shuffle keep its groups small."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def _positives(rows: DataFrame, anchors: DataFrame, s: Settings) -> DataFrame:
    """anchor, positive, score: each anchor's best other rows of its label."""

    def search(key, left, right):
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            block, asked = _Block(left), _Block(right)
            for i, anchor in enumerate(asked.ids):
                _, upper = score_bounds(asked.lengths[i], asked.angles[i], block.lengths, block.angles)
                upper[block.ids == anchor] = -np.inf
                order = np.argsort(-upper, kind="stable")
                order = order[: np.count_nonzero(upper > -np.inf)]
                scores, limit, at = np.empty(0, np.int64), -np.inf, 0
                while at < len(order) and upper[order[at]] >= limit:
                    taken = order[at : at + 256]
                    scores = np.concatenate([scores, block.scores(asked, i, taken)])
                    at += 256
                    if len(scores) >= s.positives:
                        limit = -np.partition(-scores, s.positives - 1)[s.positives - 1]
                ids = block.ids[order[: len(scores)]]
                out += [(anchor, ids[k], scores[k]) for k in _best(scores, ids, s.positives)]
        return pa.Table.from_pydict(
            {n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(("anchor", "positive", "score"))}
        )

    dealt = _dealt(rows, anchors, ["dim", "label"], s)
    keys = ["dim", "label", "block", "pack"]
    found = dealt[0].groupBy(*keys).cogroup(dealt[1].groupBy(*keys)).applyInArrow(
        search, "anchor long, positive long, score long"
    )
    return materialise(_top(found, ["anchor"], s.positives, "positive").drop("rank"))


def _negatives(rows: DataFrame, anchors: DataFrame, positives: DataFrame, s: Settings) -> DataFrame:
    """anchor, positive, negative, score, rank: the best rows in each positive's window."""
    windows = positives.filter("score >= 0").groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("positive", "score"))).alias("wanted")
    )
    asked_rows = anchors.join(windows, anchors["id"] == windows["anchor"]).drop("anchor")

    def search(key, left, right):
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            block, asked = _Block(left), _Block(right)
            for i, (anchor, wanted) in enumerate(zip(asked.ids, right.column("wanted").to_pylist())):
                lows = [-(-s.low * w["score"] // 100) for w in wanted]
                highs = [s.high * w["score"] // 100 for w in wanted]
                lower, upper = score_bounds(asked.lengths[i], asked.angles[i], block.lengths, block.angles)
                reached = np.zeros(len(block.ids), bool)
                for low, high in zip(lows, highs):
                    reached |= (upper >= low) & (lower <= high)
                at = np.flatnonzero(reached & (block.labels != asked.labels[i]))
                scores, ids = block.scores(asked, i, at), block.ids[at]
                for w, low, high in zip(wanted, lows, highs):
                    inside = np.flatnonzero((scores >= low) & (scores <= high))
                    best = inside[_best(scores[inside], ids[inside], s.negatives)]
                    out += [(anchor, w["positive"], w["score"], ids[k], scores[k]) for k in best]
        names = ("anchor", "positive", "positive_score", "negative", "score")
        return pa.Table.from_pydict({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})

    dealt = _dealt(rows, asked_rows, ["dim"], s)
    keys = ["dim", "block", "pack"]
    found = dealt[0].groupBy(*keys).cogroup(dealt[1].groupBy(*keys)).applyInArrow(
        search, "anchor long, positive long, positive_score long, negative long, score long"
    )
    return _top(found, ["anchor", "positive"], s.negatives, "negative")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, settings: Settings = Settings(), scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per anchor and positive, rows of other labels that score nearly as high.

    Args:
        is_anchor: test on the column ``id`` (a long) that marks the anchors.
        scale: components become ``floor(scale * x)``, scores are integer products.

    Returns:
        ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
        ``positive_score``, ``negative_score``. A positive is one of the anchor's best other
        rows of its label; its negatives are the best rows of another label with ``low`` to
        ``high`` percent of its score (none where that is negative). Ties go to smaller ids.

    Rows without id, label or vector, with an empty vector, with a null or non-finite
    component, or too long for 64-bit scores (an integer length of 2^31) take no part. Rows
    of one id are one row: the smallest label, then vector. Vectors are compared with those
    of the same number of components. A vector of zeros scores 0. Other columns are not
    read. Runs jobs: rows with angles, anchors and positives are stored.
    """
    rows = _indexed(_quantised(vectors, id_col, vector_col, label_col, scale), settings, scale)
    anchors = materialise(rows.filter(is_anchor))
    positives = _positives(rows, anchors, settings)
    return _negatives(rows, anchors, positives, settings).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int"),
        F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
