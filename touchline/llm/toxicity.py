"""Toxicity by non-negative positive-unlabelled learning.

Logistic classifiers on hashed character n-grams learn from confirmed toxic documents
and unlabelled text only. The risk of calling unlabelled text clean is corrected by
what toxic text, as often as the class prior says, adds to it; where that estimate falls
below zero, the step goes the other way (no fitting below a risk of zero).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20  # characters of a text that are hashed at once


@dataclass(frozen=True)
class Settings:
    """Sizes and strengths of the fit.

    bits: log2 of the number of n-gram buckets; grams: lengths of the n-grams.
    positives, unlabelled: most rows of either kind that a member classifier learns from.
    members: classifiers, each on its own unlabelled rows; their log odds are averaged.
    features: most buckets that a member weighs; contrast: how many standard deviations
    more often than in unlabelled text a bucket must occur in toxic text; support: least
    share of the toxic documents (two at least) that have it.
    prior: share of toxic documents; None takes the share among the known labels.
    """

    bits: int = 22
    grams: tuple[int, ...] = (5, 7)
    positives: int = 2_000
    unlabelled: int = 4_000
    members: int = 3
    features: int = 1 << 14
    contrast: float = 6.0
    support: float = 0.01
    prior: float | None = None
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    """Weighted n-gram buckets; ``bias`` is None where nothing could be learned."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float | None
    bits: int
    grams: tuple[int, ...]


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; everything but letters is 0, runs of 0 are one."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (points >= 0xC0) & (points != 0xD7) & (points != 0xF7) | (points >= 97) & (points <= 122)
    first_gap = np.concatenate([[True], letter[:-1]])
    return (points * letter)[letter | first_gap].astype(np.uint64)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _hashed(points: np.ndarray, grams: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, a piece of the text at a time; pieces overlap."""
    for start in range(0, max(len(points), 1), _CHUNK):
        for n in grams:
            piece = points[start : start + _CHUNK + n - 1]
            size = len(piece) - n + 1
            if size < 1:
                continue
            value = np.full(size, n, np.uint64)
            for i in range(n):
                value *= _MIX
                value += piece[i : i + size]
            value ^= value >> np.uint64(31)
            yield ((value * _MIX) >> np.uint64(64 - bits)).astype(np.uint32)


def grams_of(text: str | None, grams: tuple[int, ...], bits: int) -> np.ndarray:
    """The distinct buckets of a text's n-grams; none for a null or empty text."""
    found = [_distinct(part) for part in _hashed(_letters(text or ""), grams, bits)]
    return _distinct(np.concatenate(found)) if found else np.empty(0, np.uint32)


def one_of_each(documents: list[np.ndarray]) -> list[np.ndarray]:
    """The first of documents that share the four smallest hashes of their buckets.

    Copies of one toxic text must not make its whole wording look toxic.
    """
    first: dict[bytes, np.ndarray] = {}
    for buckets in documents:
        mixed = (buckets.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        first.setdefault(np.sort(mixed)[:4].tobytes(), buckets)
    return list(first.values())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Rows:
    """Documents as rows of selected buckets, for products with weights and their gradients."""

    def __init__(self, documents: list[np.ndarray], selected: np.ndarray):
        at = [np.searchsorted(selected, d[np.isin(d, selected, assume_unique=True)]) for d in documents]
        self.column = np.concatenate(at) if at else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(at)), [len(a) for a in at])
        self.count, self.width = len(at), len(selected)

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.count) + bias

    def gradient(self, slope: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean loss, from its slope in each row's log odds."""
        slope = slope / max(self.count, 1)
        return np.bincount(self.column, slope[self.row], self.width), float(slope.sum())


def contrasting(positive: list[np.ndarray], unlabelled: list[np.ndarray], s: Settings) -> np.ndarray:
    """Buckets that occur in clearly more toxic documents than unlabelled text lets expect."""
    size = 1 << s.bits
    p = np.bincount(np.concatenate(positive), minlength=size)
    u = np.bincount(np.concatenate([*unlabelled, np.empty(0, np.uint32)]).astype(np.int64), minlength=size)
    share = (u + 0.5) / (len(unlabelled) + 1)
    excess = (p - len(positive) * share) / np.sqrt(len(positive) * share * (1 - share) + 1e-9)
    found = np.flatnonzero((excess >= s.contrast) & (p >= max(2, s.support * len(positive))))
    best = np.argsort(-excess[found], kind="stable")[: s.features]
    return np.sort(found[best])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> tuple:
    """Selected buckets, their weights and the bias that minimise the corrected risk.

    Logistic loss, Adam steps over all rows. The risk is prior * E_p[l(f)] + max(0,
    E_u[l(-f)] - prior * E_p[l(-f)]); below zero the second part alone is climbed.
    """
    selected = contrasting(positive, unlabelled, s)
    p, u = _Rows(positive, selected), _Rows(unlabelled, selected)
    weights, bias = np.zeros(len(selected)), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(selected) + 1), np.zeros(len(selected) + 1)
    for step in range(1, s.steps + 1):
        fp, fu = p.logits(weights, bias), u.logits(weights, bias)
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gu, bu = u.gradient(_sigmoid(fu))
        gn, bn = p.gradient(prior * _sigmoid(fp))
        if clean >= 0:
            gp, bp = p.gradient(-prior * _sigmoid(-fp))
            g, b = gp + gu - gn, bp + bu - bn
        else:
            g, b = gn - gu, bn - bu
        g = np.append(g + s.decay * weights, b)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        move = s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return selected, weights, bias


def _labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    return known.filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.filter("id IS NOT NULL AND text IS NOT NULL")


def _member(s: Settings) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(11)), F.lit(s.members)).cast("int")


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit on confirmed toxic documents and on unlabelled text. Runs jobs.

    Label 1 confirms a document; an id with several labels takes the largest. Label 0
    only counts for the prior. Unlabelled text is a sample of all rows of ``docs``. Both
    samples are the rows with the smallest hashes of their id, so their sizes are bounded by the
    settings; a document is hashed to buckets before it is sent to its member's
    task. Repeated ids count once, confirmed copies of one text mostly too; rows without id or text teach nothing. Without a
    confirmed document with text the model has no bias, and every score is 0.
    """
    s, known = settings, _labels(labels, id_col, label_col)
    prior = s.prior if s.prior is not None else known.agg(F.avg("label")).first()[0]
    nothing = Model(np.empty(0, np.int64), np.empty(0), None, s.bits, s.grams)
    if not prior:
        return nothing
    prior = min(max(float(prior), 1e-4), 0.5)
    order = F.xxhash64("id", F.lit(5))
    toxic = known.filter("label = 1").orderBy(order, "id").limit(s.positives).select("id")
    texts = _texts(docs, id_col, text_col)
    sample = texts.select("id").distinct().orderBy(order, "id").limit(s.unlabelled * s.members)
    # a confirmed document teaches every member, an unlabelled one its own
    every = F.explode(F.sequence(F.lit(0), F.lit(s.members - 1)))
    wanted = toxic.select("id", F.lit(1).alias("toxic"), every.alias("member")).union(
        sample.select("id", F.lit(0).alias("toxic"), _member(s).alias("member"))
    )
    per_id = wanted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("member", "toxic"))).alias("uses"))
    rows = texts.join(F.broadcast(per_id), "id").dropDuplicates(["id"])
    schema = "member int, toxic int, id long, grams binary"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blob = grams_of(row["text"], s.grams, s.bits).tobytes()
                uses = row["uses"]
                yield pa.RecordBatch.from_pydict({
                    "member": pa.array([x["member"] for x in uses], pa.int32()),
                    "toxic": pa.array([x["toxic"] for x in uses], pa.int32()),
                    "id": pa.array([row["id"]] * len(uses), pa.int64()),
                    "grams": pa.array([blob] * len(uses), pa.binary()),
                })

    def learned(table):
        kinds: tuple[list, list] = ([], [])
        taken = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "toxic", "grams"))))
        for _, kind, blob in taken:
            kinds[kind].append(np.frombuffer(blob, np.uint32))
        if not kinds[1]:
            return pa.table({c: pa.array([], t) for c, t in (("buckets", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64()))})
        buckets, weights, bias = fit(one_of_each(kinds[1]), kinds[0], prior, s)
        return pa.table({"buckets": [buckets.astype("<i8").tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    fitted = rows.mapInArrow(hashed, schema).groupBy("member").applyInArrow(
        learned, "buckets binary, weights binary, bias double"
    ).collect()
    if not fitted:
        return nothing
    total = np.zeros(1 << s.bits)
    for row in fitted:
        total[np.frombuffer(row["buckets"], "<i8")] += np.frombuffer(row["weights"])
    buckets = np.flatnonzero(total)
    bias = float(np.mean([row["bias"] for row in fitted]))
    return Model(buckets, total[buckets] / len(fitted), bias, s.bits, s.grams)


def log_odds(text: str | None, table: np.ndarray, model: Model) -> float:
    """Of the whole text; ``table`` holds the weight of every bucket."""
    hits = [part[table[part] != 0] for part in _hashed(_letters(text or ""), model.grams, model.bits)]
    return float(table[_distinct(np.concatenate(hits))].sum()) + model.bias if hits else model.bias


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, the probability of toxicity, for every row.

    A null or empty text has the score of no n-grams. Repeated rows, and rows without
    an id, each have their score. No other column of ``docs`` is read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = rows.select(id_col).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = np.zeros(1 << model.bits, np.float32)
        table[model.buckets] = model.weights
        for batch in batches:
            texts = batch.column(1)
            found = [
                0.0 if model.bias is None else float(_sigmoid(log_odds(t.as_py(), table, model))) for t in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

    return rows.mapInArrow(run, schema)
