"""Cross-entropy difference of two matched n-gram models.

A target and a background model share the vocabulary of a public tokenizer, the order
(bigrams backed by unigrams) and the weights of interpolation; bigrams are counted
exactly, in a table of the shared folder. A document's score is the mean over its tokens of target loss minus
background loss: the lower, the more it resembles the target.

Documents go through the job in blocks of bounded size. A block sums its bigrams
before the shuffle, fetches each corpus count that it needs once, and is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.tokens import default_vocabulary, tokenizer
from touchline.sources.tables import materialise


@dataclass(frozen=True)
class Settings:
    """Sizes of the models, the same for both.

    tokens: ids of the vocabulary, plus one for the start of a text; bigram, unigram: weights of
    the interpolation, the rest is uniform; block: tokens of the documents that are
    counted and scored together (a longer document is a block of its own).
    """

    tokens: int = 50_258
    bigram: float = 0.6
    unigram: float = 0.35
    block: int = 1 << 22


BLOCK = "block long, doc_id array<long>, n_tokens array<long>, in_target array<boolean>, ids binary, raw long"
BIGRAM = "block long, pair long, t long, b long, docs int"
RESULT = "doc_id long, n_tokens long, in_target boolean, target_loss double, background_loss double"
_CODEC = "zstd"


def _blocks(marked: DataFrame, s: Settings, path: str) -> DataFrame:
    """Documents as blocks of token ids, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        block = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        size = 0

        def given() -> pa.RecordBatch:
            ids = b"".join(x[3] for x in held)
            values = [[block], *[[[x[i] for x in held]] for i in range(3)], [pa.compress(ids, _CODEC, asbytes=True)], [len(ids)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64()]
            names = ["block", "doc_id", "n_tokens", "in_target", "ids", "raw"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for doc_id, text, inside in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = encode(text.as_py())
                held.append((doc_id, len(ids) // 4, inside, ids))
                size += len(ids) // 4
                if size >= s.block or len(held) >= 10_000:
                    yield given()
                    block, held, size = block + 1, [], 0
        if held:
            yield given()

    return materialise(marked.mapInArrow(run, BLOCK))


def _documents(row: dict) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Place, side and ids of each document of a block."""
    ids = np.frombuffer(pa.decompress(row["ids"], row["raw"], _CODEC, asbytes=True), "<u4").astype(np.int64)
    start = 0
    for i, (size, inside) in enumerate(zip(row["n_tokens"], row["in_target"])):
        yield i, inside, ids[start : start + size]
        start += size


def _pairs(ids: np.ndarray, s: Settings) -> np.ndarray:
    """Every bigram of a text, context * tokens + token; the first token follows the start."""
    return np.concatenate([[s.tokens - 1], ids[:-1]]) * s.tokens + ids if len(ids) else ids


def _counted(blocks: DataFrame, s: Settings) -> DataFrame:
    """The distinct bigrams of each block: occurrences in target (t) and background (b), documents; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides: dict[bool, list[np.ndarray]] = {True: [], False: []}
                distinct = [np.empty(0, np.int64)]
                for _, inside, ids in _documents(row):
                    pairs = np.sort(_pairs(ids, s))
                    sides[inside].append(pairs)
                    distinct.append(pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs)
                pair, docs = np.unique(np.concatenate(distinct), return_counts=True)
                counts = []
                for inside in (True, False):
                    held, n = np.unique(np.concatenate([*sides[inside], np.empty(0, np.int64)]), return_counts=True)
                    count = np.zeros(len(pair), np.int64)
                    count[np.searchsorted(pair, held)] = n
                    counts.append(count)
                block = np.full(len(pair), row["block"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(pair), *map(pa.array, counts), pa.array(docs, pa.int32())],
                    names=["block", "pair", "t", "b", "docs"],
                )

    return materialise(blocks.mapInArrow(run, BIGRAM))


def _by_id(counts: DataFrame, key: str, s: Settings) -> np.ndarray:
    """Target and background counts of every context or token; one row per id of the vocabulary."""
    found = np.zeros((2, s.tokens))
    for i, t, b in counts.groupBy(F.expr(key).alias("i")).agg(F.sum("t"), F.sum("b")).collect():
        found[:, i] = t, b
    return found


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, settings: Settings = Settings(), vocabulary: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Score every document by target loss minus background loss per token.

    Args:
        docs: the corpus. Its documents named in ``target`` make the target model, all
            others the background model; counts cover every row.
        target: ids, in a column of the same name; nulls and repeats do not matter.

    Returns:
        One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``in_target``,
        ``target_loss``, ``background_loss`` (nats per token) and ``score``, their
        difference.

    A document is never scored by its own counts. A text that is null or empty has 0
    tokens and null losses and score. Repeated rows are counted and scored each. Runs jobs:
    token ids, the bigrams of blocks and their counts are stored; the driver holds two counts per
    id of the vocabulary.
    """
    path, s = vocabulary or default_vocabulary(), settings
    named = target.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # texts whose id may be named go through the join, by a hash of bounded size; the others stay in place
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int")
    hit = F.broadcast(named.select(place.alias("_place")).distinct())
    placed = texts.withColumn("_place", place)
    asked = placed.join(hit, "_place", "left_semi").drop("_place").join(named.withColumn("in_target", F.lit(True)), "doc_id", "left")
    others = placed.join(hit, "_place", "left_anti").select("doc_id", "text", F.lit(False).alias("in_target"))
    marked = asked.select("doc_id", "text", F.coalesce("in_target", F.lit(False)).alias("in_target")).union(others)
    blocks = _blocks(marked, s, path)
    counted = _counted(blocks, s)
    counts = materialise(counted.groupBy("pair").agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.sum("docs").alias("docs")))
    heads, ones = (_by_id(counts, key, s) for key in (f"pair div {s.tokens}", f"pair % {s.tokens}"))
    shared = docs.sparkSession.sparkContext.broadcast((heads, ones))
    # a bigram of one document counts nothing once that document is left out
    wanted = counted.select("block", "pair").hint("merge").join(counts.filter("docs > 1").drop("docs"), "pair")

    def run(key, left, right):
        heads, ones = shared.value
        row = left.to_pylist()
        if not row:
            return pa.Table.from_batches([], pa.schema([]))
        right = right.sort_by("pair")
        known = right.column("pair").to_numpy()
        corpus = np.array([right.column("t").to_numpy(), right.column("b").to_numpy()], float).reshape(2, -1)
        out: dict[str, list] = {"target_loss": [], "background_loss": []}
        for _, inside, ids in _documents(row[0]):
            losses = _losses(ids, inside, known, corpus, heads, ones, s)
            for name, loss in zip(out, losses):
                out[name].append(loss)
        names = ["doc_id", "n_tokens", "in_target"]
        kinds = [pa.int64(), pa.int64(), pa.bool_()]
        columns = [pa.array(row[0][n], k) for n, k in zip(names, kinds)]
        return pa.table([*columns, *[pa.array(v, pa.float64()) for v in out.values()]], names=[*names, *out])

    scored = blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, RESULT)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _losses(
    ids: np.ndarray, inside: bool, known: np.ndarray, corpus: np.ndarray, heads: np.ndarray, ones: np.ndarray, s: Settings
) -> list[float | None]:
    """Mean loss per token under target and background; the model that holds the text leaves it out."""
    if not len(ids):
        return [None, None]
    pair, n = np.unique(_pairs(ids, s), return_counts=True)
    context, token = pair // s.tokens, pair % s.tokens
    at = np.searchsorted(known, pair)
    found = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == pair) if len(known) else np.zeros(len(pair), bool)
    own_heads, own_ones = (np.bincount(x, n, s.tokens)[x] for x in (context, token))
    losses = []
    for k, own in enumerate((inside, not inside)):
        counted = np.zeros(len(pair))
        counted[found] = corpus[k][at[found]] - n[found] * own
        head = heads[k][context] - own_heads * own
        one = ones[k][token] - own_ones * own
        total = ones[k].sum() - len(ids) * own
        chance = s.bigram * counted / np.maximum(head, 1) + s.unigram * one / max(total, 1)
        losses.append(float(-(n * np.log(chance + (1 - s.bigram - s.unigram) / s.tokens)).sum() / len(ids)))
    return losses
