"""Lexical retrieval packing: documents fill windows together with their neighbours.

Documents are ordered by their strongest terms over the whole corpus and cut into shards
of a bounded number, each with its own BM25 inverted index. A seed document opens a window; the index returns its
unused neighbours, best first, and they fill the window. What does not fit opens
the next one, so only a shard's last window may have room left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.tokens import default_vocabulary, narrowest, tokenizer
from touchline.sources.tables import materialise

K1, B = 1.2, 0.75
STRONGEST = 8  # terms of a document that may order it
KEYS = 3  # of them, those that do
TASK_SHARDS = 4  # shards of one task, about
STEP, STEP_BYTES = 4_000, 1 << 24  # documents and bytes taken up at once
FREQUENT = 1 / 16  # of a shard's documents: terms of as many have a row of all scores instead of a list
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def _counted(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each document in order, how often each occurs there, and where a document's begin; one sort for all."""
    flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
    bits = int(flat.max(initial=1)).bit_length()
    kind = np.uint32 if bits + len(ids).bit_length() <= 32 else np.uint64
    docs = np.repeat(np.arange(len(ids), dtype=kind), [len(x) for x in ids])
    keys = np.sort((docs << kind(bits)) | flat.astype(kind))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    tf = np.diff(np.append(first, len(keys)))
    keys = keys[first].astype(np.int64)
    return keys & ((1 << bits) - 1), tf, np.searchsorted(keys >> bits, np.arange(len(ids) + 1))


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, ids: list[np.ndarray], query_terms: int | None = None):
        self.query_terms, n = query_terms, len(ids)
        terms, tf, self.bounds = _counted(ids)
        docs = np.repeat(np.arange(n), np.diff(self.bounds))
        length = np.array([len(x) for x in ids], float)
        norm = K1 * (1 - B + B * length / max(length.mean(), 1))
        df = np.bincount(terms)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = idf[terms] * tf * (K1 + 1) / (tf + norm[docs])  # in order of documents
        self.terms = terms
        # nearly all that a query adds up is of frequent terms: their scores are rows
        frequent = np.flatnonzero(df >= max(n * FREQUENT, 2))
        self.row = np.full(len(df), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), n), np.float32)
        dense = self.row[terms] >= 0
        self.rows[self.row[terms[dense]], docs[dense]] = self.weight[dense]
        rest, df[frequent] = ~dense, 0
        order = np.argsort(terms[rest], kind="stable")
        self.docs, self.scores = docs[rest][order], self.weight[rest][order]  # in order of terms
        self.first = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share terms (the strongest ``query_terms``, or any), best first."""
        own = slice(self.bounds[doc], self.bounds[doc + 1])
        terms, weight = self.terms[own], self.weight[own]
        if self.query_terms is not None and len(terms) > self.query_terms:
            terms = terms[np.argpartition(-weight, self.query_terms)[: self.query_terms]]
        row = self.row[terms]
        total = self.rows[row[row >= 0]].sum(axis=0)
        lists = [slice(self.first[t], self.first[t + 1]) for t in terms[row < 0]]
        if lists:
            total = total + np.bincount(
                np.concatenate([self.docs[x] for x in lists]),
                np.concatenate([self.scores[x] for x in lists]),
                len(used),
            )
        found = np.flatnonzero((total > 0) & ~used)
        return found[np.argsort(-total[found], kind="stable")]


def pack(ids: list[np.ndarray], window: int, query_terms: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard."""
    index = Index(ids, query_terms)
    start = np.zeros(len(ids), int)
    size = np.array([len(x) for x in ids])
    used = np.zeros(len(ids), bool)
    sequence, room, next_free, seed = 0, window, 0, -1
    waiting: Iterator[int] = iter(())
    while True:
        if room == window or seed < 0:  # a new window: go on with a cut document, else the next free one
            if seed < 0 or used[seed]:
                while next_free < len(ids) and used[next_free]:
                    next_free += 1
                if next_free == len(ids):
                    return
                seed = next_free
            doc, queried = seed, False
        else:
            doc = next((int(d) for d in waiting if not used[d]), -1)
            if doc < 0 and not queried:
                waiting, queried = iter(index.neighbours(seed, used)), True
                continue
            if doc < 0:  # no neighbour left: the next free document
                while next_free < len(ids) and used[next_free]:
                    next_free += 1
                if next_free == len(ids):
                    return
                doc = next_free
        length = min(room, size[doc] - start[doc])
        yield doc, int(start[doc]), int(length), sequence, window - room
        start[doc] += length
        used[doc] = start[doc] == size[doc]
        room -= length
        if not room:
            sequence, room, waiting = sequence + 1, window, iter(())
            seed = -1 if used[doc] else doc


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``STEP`` rows and, beside the last row, ``STEP_BYTES`` bytes of a column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        end = min(start + STEP, int(np.searchsorted(size, before + STEP_BYTES)) + 1, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(ids.as_buffer(), kind) for ids in column]


def _coded(rows: DataFrame, end_id: int, path: str, kind: str) -> DataFrame:
    """row (a number), doc_id, ids: the token ids of every row and the end, as numbers of a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).batch
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _parts(batch, 1):
                numbers = pa.array(np.arange(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([numbers, part.column(0), encode(part.column(1), end_id, kind)], names=["row", "doc_id", "ids"])

    return materialise(rows.mapInArrow(run, "row long, doc_id long, ids binary"))


def _strongest(ids: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """The strongest terms of each document over the whole corpus, best first; -1 where it has fewer."""
    terms, tf, bounds = _counted(ids)
    weight = idf[terms] * tf * (K1 + 1) / (tf + K1)
    size = np.diff(bounds)
    docs = np.repeat(np.arange(len(ids)), size)
    # in one number each: the document, then how weak (the bits of a float above 0 are ordered as it is), then the place
    weak = (np.uint64(0xFFFFFFFF) - weight.astype(np.float32).view(np.uint32).astype(np.uint64)) << np.uint64(16)
    if len(ids) < 1 << 16 and terms.max(initial=0) < 1 << 16:
        keys = np.sort((docs.astype(np.uint64) << np.uint64(48)) | weak | terms.astype(np.uint64))
        terms = (keys & np.uint64(0xFFFF)).astype(np.int64)
    else:
        terms = terms[np.lexsort((terms, weak, docs))]
    place = np.arange(STRONGEST)
    return np.where(place < size[:, None], terms[np.minimum(bounds[:-1, None] + place, len(terms) - 1)], -1)


def _document_counts(coded: DataFrame, kind: str, terms_of: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Documents that give out each term, -1 not counted; bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                terms = terms_of(_arrays(part.column(0), kind)).ravel()
                counts = np.bincount(terms[terms >= 0])
                total = np.pad(total, (0, max(len(counts) - len(total), 0)))
                total[: len(counts)] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    found = coded.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["term"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["term"]] = r["n"]
    return counts


def _routed(coded: DataFrame, shard_docs: int, kind: str) -> DataFrame:
    """The rows in the order of their strongest terms, dealt by ranges.

    Of a document's ``STRONGEST`` terms, those that most documents have among theirs order it.
    Equal ones are followed by the next, the ids and the row's number, so a frequent term or copies spread over tasks.
    """
    counts, n = _document_counts(coded, kind, lambda ids: _counted(ids)[0]), coded.count()
    idf = np.where(counts > 1, np.log1p((n - counts + 0.5) / (counts + 0.5)), 0.0)
    weights = coded.sparkSession.sparkContext.broadcast(idf)
    liked = _document_counts(coded, kind, lambda ids: _strongest(ids, weights.value))
    popular = coded.sparkSession.sparkContext.broadcast(np.pad(liked, (0, max(len(idf) - len(liked), 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                best = _strongest(_arrays(part.column(2), kind), weights.value)
                # the most popular terms first, equal ones by number, none last
                ranks = np.where(best < 0, np.iinfo(np.int64).max, (-popular.value[best] << 32) + best)
                ranks = np.sort(ranks, axis=1)[:, :KEYS]
                chosen = np.where(ranks == np.iinfo(np.int64).max, -1, ranks & 0xFFFFFFFF).astype(np.int32)
                keys = [pa.array(chosen[:, k]) for k in range(KEYS)]
                yield pa.RecordBatch.from_arrays([*part.columns, *keys], names=["row", "doc_id", "ids", *names])

    names = [f"k{k}" for k in range(KEYS)]
    schema = "row long, doc_id long, ids binary, " + ", ".join(f"{name} int" for name in names)
    order = [*names, F.xxhash64("ids"), F.col("row")]
    parts = max(1, n // (TASK_SHARDS * shard_docs))
    return coded.mapInArrow(run, schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)


def pack_documents(
    docs: DataFrame,
    window: int = 2048,
    end_id: int = 1,
    shard_docs: int = 2048,
    query_terms: int | None = None,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document's token ids, and ``end_id`` after them, into windows.

    Args:
        shard_docs: documents of one inverted index; a task has
            some of them, and memory is bounded by one shard.
        query_terms: strongest BM25 terms of a seed that are looked up; None: all.
        vocabulary: path of the tokenizer's file.

    Returns:
        One row per piece: ``doc_id``, ``start`` (ids of the document before it),
        ``length``, ``ids_crc32`` (of its ids as little-endian unsigned 32-bit
        numbers), ``doc_tokens``, ``sequence_id``, ``offset``. Sequences start at offset
        0 without gaps and hold ``window`` ids, the last one of a shard fewer.

    A null or empty text is packed as ``end_id`` alone. Rows are packed one by one: repeated
    rows and rows with the same or no id are packed as often as they occur. Other
    columns are ignored; an empty input gives no piece. Runs jobs: the token ids are stored,
    and shuffled once, into the order of the documents' strongest terms.
    """
    path = vocabulary or default_vocabulary()
    kind = narrowest(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 33
        names, texts = [], []

        def shard() -> pa.RecordBatch:
            nonlocal place
            ids = [np.frombuffer(t, kind) for t in texts]
            rows = list(pack(ids, window, query_terms))
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
            crc = [zlib.crc32(ids[d][s : s + n].astype("<u4")) for d, s, n, _, _ in rows]
            size = np.array([len(x) for x in ids])
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.int64()).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(size[doc]),
                    pa.array(sequence + place),
                    pa.array(offset),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            place += int(sequence.max()) + 1
            names.clear()
            texts.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                names.append(name.as_py())
                texts.append(text.as_py())
                if len(names) == shard_docs:
                    yield shard()
        if names:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    routed = _routed(_coded(rows, end_id, path, kind), shard_docs, kind)
    return routed.select("doc_id", "ids").mapInArrow(run, PIECES)
