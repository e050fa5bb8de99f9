"""Language identification: nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed character n-grams. The vectors of each
language are clustered, and a text takes the language of the centroid with the largest
cosine; a text farther from it than its members are is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import only_with_ids
from touchline.sources.tables import materialise

SPACES = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """idf and unit centroids over the n-gram buckets, with language and reach of each."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str] = field(default_factory=list)
    reach: np.ndarray = field(default_factory=lambda: np.empty(0))


def has_letter(text: str | None) -> bool:
    """Whether a character of Unicode category L is there; superscript digits and fractions are none."""
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str, buckets: int) -> np.ndarray:
    """Counts of the hashed n-grams (1 to 3 characters, words set apart by blanks)."""
    chars = SPACES.sub(" ", f" {text} ".lower())
    code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    total = np.zeros(buckets, np.int64)
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        gram = gram[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total += np.bincount((mixed >> np.uint64(40)) % np.uint64(buckets), minlength=buckets)
    return total


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _document_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Number of documents that hold each n-gram bucket, and of all, over every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if has_letter(text):
                    total[:-1] += counts(text, buckets) > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    summed = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets + 1, np.int64)
    for row in summed.collect():  # one row per bucket at most
        found[row["bucket"]] = row["n"]
    return found


def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means; starts far apart, always from the same row."""
    first = [0]
    near = x @ x[0]
    while len(first) < min(k, len(x)):
        first.append(int(near.argmin()))
        near = np.maximum(near, x @ x[first[-1]])
    centroids = x[first]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def train(
    docs: DataFrame, clusters: int = 3, rows: int = 400, buckets: int = 1 << 13,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Fit idf on all rows that have a language, and centroids on a sample.

    Every language gives at most ``rows`` documents, those with the smallest hashes of the
    id: this bounds a training task; the model grows with the number of languages. Rows without a language, a text or a letter teach nothing. Runs jobs.
    """
    known = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    found = _document_counts(known.select("text"), buckets)
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    order = W.partitionBy("lang").orderBy("order", "id")
    ranked = known.select("lang", "id", F.xxhash64("id", F.lit(5)).alias("order"))
    sample = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    sample = materialise(sample.select("lang", "id").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def fit(key, table):  # the sample of one language as an Arrow table
        texts = sorted(t for t in table.column("text").to_pylist() if has_letter(t))
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()), "reach": pa.array([], pa.float64())})
        x = _vectors(np.stack([counts(t, buckets) for t in texts]), shared.value)
        centroids = _cluster(x, clusters)
        cosine = x @ centroids.T
        own = cosine.argmax(1)
        reach = [float(cosine[own == c, c].min(initial=1.0)) for c in range(len(centroids))]
        stored = [c.astype("<f4").tobytes() for c in centroids]
        return pa.table({"lang": [key[0].as_py()] * len(reach), "centroid": stored, "reach": reach})

    chosen = only_with_ids(known, "id", sample).join(sample, ["lang", "id"]).select("lang", "text")
    fitted = chosen.groupBy("lang").applyInArrow(fit, "lang string, centroid binary, reach double").collect()
    fitted.sort(key=lambda r: (r["lang"], r["centroid"]))
    stacked = [np.frombuffer(r["centroid"], "<f4") for r in fitted]
    centroids = np.stack(stacked) if stacked else np.zeros((0, buckets), "f4")
    return Model(idf, centroids, [r["lang"] for r in fitted], np.array([r["reach"] for r in fitted]))


def predict(
    docs: DataFrame, model: Model, slack: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Columns ``keep``, ``lang_pred``, ``score`` (cosine) and ``rejected`` of every row.

    ``rejected``: the cosine is more than ``slack`` below that of the centroid's
    farthest training member; the nearest language is given all the same. A text
    that is null, empty or without a letter is ``und`` with score 0, and so is every one
    if nothing was learned. Repeated rows each have their result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
    schema = rows.drop("_text").schema
    schema = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        buckets = len(m.idf)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            langs, scores, rejected = [], [], []
            for start in range(0, len(texts), 64):
                part = [t.as_py() for t in texts.slice(start, 64)]
                usable = [i for i, t in enumerate(part) if len(m.languages) and has_letter(t)]
                one = [(UNKNOWN, 0.0, True)] * len(part)
                if usable:
                    x = _vectors(np.stack([counts(part[i], buckets) for i in usable]), m.idf)
                    cosine = x @ m.centroids.T
                    best = cosine.argmax(1)
                    for row, (i, c) in enumerate(zip(usable, best)):
                        value = min(max(float(cosine[row, c]), 0.0), 1.0)
                        one[i] = (m.languages[c], value, value < m.reach[c] - slack)
                for lang, value, far in one:
                    langs.append(lang)
                    scores.append(value)
                    rejected.append(far)
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*keep, "lang_pred", "score", "rejected"],
            )

    return rows.mapInArrow(run, schema)
