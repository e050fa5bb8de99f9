"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = re.compile(r"\w+|[^\w\s]+")
REPEAT, CAPITALS = "\x00repeat", "\x00capitals"


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the number of weights; rows: bound of the training sample."""

    bits: int = 18
    rows: int = 8_000
    epochs: int = 8
    alpha: float = 10.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.01


class _Ids(dict):
    """Hash of each token seen, computed once; emptied when it grows too large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        word = CAPITALS if len(token) > 1 and token.isupper() else token.lower()
        if not word[0].isalnum() and word[0] not in ("\x00", "_"):
            word = word[0] * min(len(word), 4)
        value = self[token] = xxhash.xxh64_intdigest(word)
        return value


_IDS = _Ids()
_REPEAT = np.uint64(xxhash.xxh64_intdigest(REPEAT))


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's word unigrams and bigrams, and their weights.

    Weights are 1 + log(count), scaled to length one. A bigram of one word twice and
    a word in capitals are features of their own. No token, no feature.
    """
    tokens = TOKENS.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    one = np.fromiter(map(_IDS.__getitem__, tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
    two[one[:-1] == one[1:]] = _REPEAT
    mixed = np.concatenate([one, two])
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    buckets, counts = np.unique(mixed >> np.uint64(64 - bits), return_counts=True)
    weights = 1 + np.log(counts)
    return buckets.astype(np.int64), weights / np.sqrt((weights * weights).sum())


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of per-coordinate FTRL-proximal updates."""
    size = (1 << s.bits) + 1  # the last one is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        over = np.sign(z[at]) * s.l1 - z[at]
        return np.where(np.abs(z[at]) <= s.l1, 0.0, over / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for buckets, values, label in rows:
            at = np.append(buckets, size - 1)
            x = np.append(values, 1.0)
            w = weights(at)
            g = (_sigmoid(w @ x) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of the labelled documents. Runs a job.

    At most ``settings.rows`` labelled ids take part, those with the smallest
    hashes, so the broadcast side and the training task are bounded. An id with several
    labels takes the smallest; ids or labels that are null, labels other than 0
    and 1, and null texts teach nothing. Without any label every weight is 0.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"))
    ids = ids.filter("_id IS NOT NULL AND _label IN (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    order = F.xxhash64("_id")
    sample = F.broadcast(ids.orderBy(order, "_id").limit(settings.rows))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.filter("_text IS NOT NULL").join(sample, "_id").dropDuplicates(["_id"])

    def fit(key, table):  # the bounded sample as an Arrow table
        known = sorted(zip(*(table.column(c).to_pylist() for c in ("_id", "_text", "_label"))), key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
        w, bias = ftrl([(*features(t, settings.bits), y) for _, t, y in known], settings)
        return pa.table({"weights": [w.astype("<f4").tobytes()], "bias": [bias]})

    fitted = rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fit, "weights binary, bias double")
    model = fitted.first()
    if model is None:
        return np.zeros(1 << settings.bits, "f4"), 0.0
    return np.frombuffer(model["weights"], "<f4"), model["bias"]


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Columns ``keep`` and ``score``: the probability of label 1 of every row.

    A null or empty text gets the score of no features. Rows are scored one by one:
    repeated rows, and rows without an id, each have their score.
    """
    weights, bias = model
    bits = int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    columns = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*columns, F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1):
                at, x = features(text.as_py(), bits)
                found.append(float(_sigmoid(w[at] @ x + b)))
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.float64())], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)
