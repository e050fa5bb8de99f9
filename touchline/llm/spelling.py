"""Spelling variants: words one edit apart, found with a bit-sliced position index.

A task holds, per position and letter, the set of its words with that letter there, one
bit per word. Walking along a word keeps four sets: words equal so far, and words with one
letter replaced, added or missing so far. Each step is a few operations on whole sets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.tables import materialise

_LOWER = {c: c + 32 for c in range(65, 91)}


def typed(run: str, doc_id: int | None, every: int) -> str:
    """The lower-cased run, of which every ``every``-th (by hash) lacks one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame, least_letters: int = 7, least_count: int = 2, every: int = 31, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word``, ``n``: words of whole texts with enough letters and occurrences.

    A word is a maximal run of Latin letters, A to Z in lower case, with the deletions that
    ``typed`` makes. Null texts have none. Each task counts before the shuffle.
    """
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % max(least_letters, 1))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64()),
            })
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, n in Counter(pattern.findall(text.as_py() or "")).items():
                    word = typed(found.translate(_LOWER), doc_id, every)
                    if len(word) >= least_letters:
                        counts[word] += n
                if len(counts) >= 200_000:
                    yield full()
        yield full()

    partial = rows.filter("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _sets(member: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words, one bit per column."""
    packed = np.packbits(member, axis=1, bitorder="little")
    short = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, short)))).view(np.uint64)


class BitSlices:
    """Sets of words per position and letter; words as rows of letter codes, -1 past the end."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, letters: int):
        self.codes, self.letters, self.width = codes, letters, codes.shape[1]
        self.none = _sets(np.zeros((1, len(codes)), bool))[0]
        self.all = _sets(np.ones((1, len(codes)), bool))[0]
        self.by_length = {int(n): _sets((lengths == n)[None])[0] for n in np.unique(lengths)}

    def at(self, position: int) -> np.ndarray:
        """The set of every letter at a position; the last row, of no letter, is empty."""
        if not 0 <= position < self.width:
            return np.zeros((self.letters + 1, len(self.none)), np.uint64)
        here = self.codes[:, position]
        return _sets(here[None] == np.arange(self.letters + 1)[:, None])

    def one_edit(self, queries: np.ndarray, length: int) -> np.ndarray:
        """For queries of one length, the set of words exactly one edit away from each."""
        equal = np.repeat(self.all[None], len(queries), axis=0)
        replaced = np.zeros_like(equal)
        added, missing = np.zeros_like(equal), np.zeros_like(equal)
        before, here = self.at(-1), self.at(0)
        for i in range(length):
            after = self.at(i + 1)
            letter = queries[:, i]
            same, shifted, lagging = here[letter], after[letter], before[letter]
            missing = missing & lagging | equal
            added = (added | equal) & shifted
            replaced = replaced & same | equal & ~same
            equal = equal & same
            before, here = here, after
        added |= equal
        found = replaced & self.by_length.get(length, self.none)
        found |= added & self.by_length.get(length + 1, self.none)
        found |= missing & self.by_length.get(length - 1, self.none)
        return found


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Words as rows of letter codes, their lengths, the number of letters."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, codes = np.unique(points, return_inverse=True)
    lengths = np.array([len(w) for w in words])
    table = np.full((len(words), lengths.max()), -1, np.int32)
    table[np.arange(table.shape[1]) < lengths[:, None]] = codes
    return table, lengths, len(letters)


def near_in_class(
    words: list[str], buckets: np.ndarray, front: np.ndarray, least: int, asks: np.ndarray, listed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking word, listed word) one edit apart that belong to this class.

    The class holds words with ``least`` or one more letters; a pair belongs to it if its
    shorter word has ``least``, both share a bucket, and, in a bucket of word ends, their
    beginnings differ (else they meet in the bucket of those). So each pair comes up once.
    """
    codes, lengths, letters = _coded(words)
    index = BitSlices(codes[listed], lengths[listed], letters)
    left, right = [], []
    for length in (least, least + 1):
        asking = np.flatnonzero(asks & (lengths == length))
        for start in range(0, len(asking), 1024):
            part = asking[start : start + 1024]
            found = index.one_edit(codes[part], length)
            bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little", count=int(listed.sum()))
            q, w = np.nonzero(bits)
            left.append(part[q])
            right.append(np.flatnonzero(listed)[w])
    a, b = np.concatenate(left), np.concatenate(right)
    own = (np.minimum(lengths[a], lengths[b]) == least) & (buckets[a] == buckets[b])
    half = least // 2
    same_front = (codes[a, :half] == codes[b, :half]).all(axis=1)
    own &= front[a] | ~same_front
    return a[own], b[own]


def _postings(words: DataFrame, shard: int) -> DataFrame:
    """Each word under the halves that it may share with a word one edit away.

    Of two such words the shorter one has m letters, and they share their first m // 2
    letters or their last. A word enters with m its own length and one less. Buckets are
    put together into shards of about ``shard`` postings; larger buckets are cut, and
    each piece of words asked meets each piece of words listed in a task of its own.
    """
    n = F.length("word")
    halves = F.array(*[
        F.struct(m.alias("least"), F.lit(is_front).alias("front"),
                 (F.left("word", F.floor(m / 2).cast("int")) if is_front else F.right("word", F.floor(m / 2).cast("int"))).alias("half"))
        for m in (n, n - 1) for is_front in (True, False)
    ])
    entries = words.select("word", "n", F.inline(halves)).withColumn("bucket", F.xxhash64("least", "front", "half"))
    entries = materialise(entries.drop("half"))
    shards = max(1, -(-entries.count() // shard))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    placed = entries.join(sizes, "bucket").withColumn("pieces", F.ceil(F.col("size") / shard).cast("int"))
    piece = F.pmod(F.xxhash64("word", F.lit(5)), F.col("pieces")).cast("int")
    common = F.pmod("bucket", F.lit(shards)).cast("string")
    plain = placed.filter("pieces = 1").select(
        common.alias("shard"), "least", "front", "bucket", "word", "n", F.lit(True).alias("asks"), F.lit(True).alias("listed")
    )
    hot = placed.filter("pieces > 1").withColumn("piece", piece).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    )
    roles = F.array(
        F.struct(F.concat_ws("/", "bucket", "piece", "other").alias("shard"), F.lit(True).alias("asks"), F.lit(False).alias("listed")),
        F.struct(F.concat_ws("/", "bucket", "other", "piece").alias("shard"), F.lit(False).alias("asks"), F.lit(True).alias("listed")),
    )
    split = hot.select("least", "front", "bucket", "word", "n", F.inline(roles)).select(plain.columns)
    return plain.union(split)


def near_words(words: DataFrame, shard: int = 8_192) -> DataFrame:
    """``word``, ``near``, ``near_n``: all ordered pairs of words exactly one edit apart.

    ``words`` has distinct words of two or more code points (``word``) and ``n``. No pair
    is lost and none comes twice. Runs jobs: the postings are stored.
    """

    def search(key, table):
        out: list[tuple[list, list, list]] = []
        table = table.sort_by("least")
        least = table.column("least").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        for start, end in zip(starts, [*starts[1:], len(least)]):
            part = table.slice(start, end - start)
            words, counts = part.column("word").to_pylist(), part.column("n").to_numpy()
            columns = [np.asarray(part.column(c)) for c in ("bucket", "front", "asks", "listed")]
            a, b = near_in_class(words, columns[0], columns[1], int(least[start]), columns[2], columns[3])
            out.append(([words[i] for i in a], [words[i] for i in b], counts[b].tolist()))
        names = (("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64()))
        return pa.table({name: pa.array([x for o in out for x in o[k]], t) for k, (name, t) in enumerate(names)})

    return _postings(words, shard).groupBy("shard").applyInArrow(search, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = 10, shard: int = 8_192) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for every word.

    The form is the near word of largest ``n`` (ties: smallest in code-point order) if it is
    at least ``times`` as frequent, else null; the root is where forms lead, the word itself if
    it has none. As ``times`` exceeds 1, forms never lead in a circle. Runs jobs.
    """
    if times <= 1:
        raise ValueError("a form must be more frequent than its variant")
    words = materialise(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    grouped = near_words(words, shard).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(grouped, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.struct(F.col("best.form"), (-F.col("best.less")).alias("form_n"))).alias("f"),
    )
    found = materialise(found.select("word", "n", "n_near", "f.form", "f.form_n"))
    links = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    step = materialise(links)
    # each round doubles the length of the paths followed
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return found.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
