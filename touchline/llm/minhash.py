"""Near-duplicate documents from bottom-k sketches of their word shingles.

One hash function; a document's sketch is its k smallest shingle hashes. Inverted
lists of retained values give candidates, the sketch of the union estimates their
similarity, and the shingle sets of the whole texts decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import components, link_buckets, only_with_ids
from touchline.llm.shingles import shingle_hashes, shingle_set
from touchline.sources.tables import materialise

K, LARGE_K = 64, 1024  # sizes of the sketches: of all documents, and of those with candidates
PAIRED = 256  # shingles of a hub up to which two differences make a key
SKETCH = "doc_id long, n_shingles long, digest string, sketch array<long>"


def _least_share(similarity: float, k: int) -> float:
    """Share of a sketch that two documents at the similarity have in common.

    Five standard deviations below the expected share: a sketch misses about
    one in a million pairs that lie exactly at the similarity.
    """
    return similarity - 5 * math.sqrt(similarity * (1 - similarity) / k)


def sketches(docs: DataFrame, size: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Size, digest and bottom-k sketch of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, kept = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), size)
                counts.append(len(hashes))
                digests.append(xxhash.xxh3_128_hexdigest(hashes.tobytes()))
                kept.append(hashes[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(kept, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SKETCH)


def _postings(classes: DataFrame, similarity: float, k: int) -> DataFrame:
    """key, node, n, size, own: the values that two similar documents cannot both lack.

    Two sketches that share ``need`` values share one among the first
    size - need + 1 of each, in any common order. Values are ordered by how many
    documents hold them, so the values of widespread passages come last and make no
    list unless most of a document consists of them. Values of one document (there are
    ``own`` of them) are dropped. A sketch that is the whole set, as are those of
    all similar documents, needs no allowance for chance.
    """
    values = classes.select("node", "n", "size", F.explode("sketch").alias("key"))
    counts = values.groupBy("key").agg(F.count("*").alias("held_by")).filter("held_by > 1")
    shared = values.join(counts, "key")
    share = F.when(F.col("n") <= similarity * k, similarity).otherwise(_least_share(similarity, k))
    need = F.greatest(F.ceil(F.col("size") * share - 1e-9), F.lit(1))
    ranked = shared.groupBy("node", "n", "size").agg(
        F.sort_array(F.collect_list(F.struct("held_by", "key"))).alias("held")
    )
    ranked = ranked.withColumn("own", F.col("size") - F.size("held"))
    ranked = ranked.withColumn("first", (F.col("size") - need + 1 - F.col("own")).cast("int")).filter("first > 0")
    first = F.explode(F.slice("held", 1, F.col("first"))).alias("v")
    return ranked.select("node", "n", "size", "own", first).select("v.key", "node", "n", "size", "own")


def _near(similarity: float, k: int):
    """What two postings of similar documents meet: neither has too many values of its own.

    Similar sets have at least s / (1 + s) * (m + n) common elements. Whole sets must keep
    that many besides their own ones; sketches the same share, less five deviations.
    """

    def meets(left: str, right: str) -> Column:
        m, n = F.col(f"{left}n"), F.col(f"{right}n")
        common = (m + n) * (similarity / (1 + similarity))
        left_over = [F.col(f"{p}size") - F.col(f"{p}own") for p in (left, right)]
        p = common / F.greatest(m, n)
        sampled = k * p - 5 * F.sqrt(k * p * F.greatest(1 - p, F.lit(0.0)))
        least = F.when((m <= k) & (n <= k), common).otherwise(F.least(sampled, common))
        return (F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9) & (F.least(*left_over) >= least - 1e-9)

    return meets


def difference_keys(n: int, hub_n: int, d: int, held: list[int], similarity: float) -> Iterator[tuple[int, ...]]:
    """Keys of a set by its differences from a hub: two similar sets share one, unless both are similar to the hub.

    Args:
        n, hub_n: sizes of the set and of the hub.
        d: number of values that only one of the two has.
        held: those of them that another set differs in too, rarest first (one order for all sets of the hub).

    Similar sets of n and m values differ in t = (1 - s) / (1 + s) * (n + m) values at most, so two of them with d and e
    differences have (d + e - t) / 2 differences in common, more than none if one of them is not similar
    to the hub. Sets with ``o`` values in common share ``l`` of the first d - o + l of each. The
    other set's e is known up to its class: a key names both classes. Two values (l = 2) make a
    key where the hub is small and the classes prove two common ones.
    """
    c = (1 - similarity) / (1 + similarity)
    width = max(1, math.ceil(c * hub_n / 2))
    own, mine = d - len(held), d // width
    far = c * n * (1 + 1 / similarity) + 1e-6  # differences of a similar set, at most
    for other in range(max(0, math.floor((d - far) / width)), math.floor((d + far) / width) + 1):
        low, high = other * width, (other + 1) * width - 1
        most = c * (n + min(n / similarity, hub_n + high)) + 1e-6
        if high < d - most or low > d + most:
            continue
        common = max(1, math.ceil((d + low - most) / 2))
        if common > min(len(held), high):
            continue
        # the same bound from the classes alone, for both sets alike
        proven = ((mine + other) * width - c * (2 * hub_n + (mine + other + 2) * width) - 1e-6) / 2
        length = 2 if hub_n <= PAIRED and proven >= 2 else 1
        first = held[: max(d - common + length - own, 0)]
        for chosen in combinations(first, length):
            yield (min(mine, other), max(mine, other), *chosen)


def _difference_links(
    large: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], similarity: float, order: Column
) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """Links inside crowded buckets, by what their members do not share with one of them.

    Near copies of one text share most values whether they are similar to each other or not. What
    tells them apart are their differences from a hub, and similar ones have most of these in
    common: they make inverted lists of their own (``difference_keys``). For documents whose sketch is the whole set.
    """
    c = (1 - similarity) / (1 + similarity)
    allowed = lambda n, m: (n + m) * c + 1e-6

    def meets(left: str, right: str) -> Column:
        fits = F.abs(F.col(f"{left}d") - F.col(f"{right}d")) <= allowed(F.col(f"{left}n"), F.col(f"{right}n"))
        return near(left, right) & fits

    def run(crowded: DataFrame, edges: DataFrame | None) -> DataFrame:
        whole = crowded.filter(F.col("n") <= LARGE_K)
        hubs = whole.groupBy("key").agg(F.min_by("node", order).alias("hub"))
        members = whole.join(hubs, "key").select("hub", "node", "n", "size", "own").distinct()
        sets = large.filter(F.col("n_shingles") <= LARGE_K)
        hub_sets = sets.groupBy(F.col("doc_id").alias("hub")).agg(F.min_by("sketch", "n_shingles").alias("hub_set"))
        mine = sets.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch")
        both = members.join(mine, ["node", "n"]).join(hub_sets, "hub")
        apart = F.concat(F.array_except("sketch", "hub_set"), F.array_except("hub_set", "sketch"))
        apart = both.select("hub", "node", "n", "size", "own", F.size("hub_set").alias("hub_n"), apart.alias("apart"))
        apart = materialise(apart.select("*", F.size("apart").alias("d"), F.xxhash64("apart").alias("set")))

        direct = apart.filter(F.col("d") <= allowed(F.col("n"), F.col("hub_n"))).filter("hub <> node")
        direct = direct.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        found = verify(direct).select("a", "b")
        found = materialise(found if edges is None else edges.union(found))

        values = apart.select("hub", "node", "n", "size", "own", "hub_n", "d", "set", F.explode("apart").alias("value"))
        counts = values.groupBy("hub", "value").agg(F.count("*").alias("held_by")).filter("held_by > 1")
        held = F.sort_array(F.collect_list(F.struct("held_by", "value")))
        listed = values.join(counts, ["hub", "value"]).groupBy("hub", "node", "n", "size", "own", "hub_n", "d", "set").agg(
            held["value"].alias("held")
        )
        postings = listed.select("hub", "node", "n", "size", "own", "d", "hub_n", "held").mapInArrow(
            _keyed(similarity), "key long, node long, n long, size int, own int, d int"
        ).distinct()
        postings = materialise(postings)
        shared = postings.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
        return link_buckets(postings.join(shared, "key"), verify, meets, known=found)

    return run


def _keyed(similarity: float):
    """One row per key of a set (hub, node, n, size, own, d, hub_n, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                keys, rows = [], []
                for i, row in enumerate(part.to_pylist()):
                    for key in difference_keys(row["n"], row["hub_n"], row["d"], row["held"], similarity):
                        keys.append(xxhash.xxh3_64_intdigest(np.array([row["hub"], *key], np.int64).tobytes()) >> 1)
                        rows.append(i)
                at = pa.array(rows, pa.int64())
                rest = ["node", "n", "size", "own", "d"]
                columns = [part.column(part.schema.get_field_index(c)).take(at) for c in rest]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *columns], names=["key", *rest])

    return run


def _alike(percent: int, size: int):
    """Keep pairs (a, b, s, t: texts) whose shingle sets meet the percentage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, set()
            for s, t in zip(batch.column(2), batch.column(3)):
                s = s.as_py()
                if s != last:
                    last, left = s, shingle_set(s, size)
                right = shingle_set(t.as_py(), size)
                both = len(left & right)
                keep.append(100 * both >= percent * (len(left) + len(right) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def minhash_groups(
    docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of documents linked by shingle sets at ``percent`` of Jaccard similarity.

    Words lie between ASCII white space, A-Z in lower case; a shingle has ``size`` words (a
    shorter text is one shingle). Pairs are linked when 100 * intersection >=
    percent * union.

    Returns:
        One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the
        smallest id reachable over links, itself included) and ``kept``
        (``doc_id = component_id``).

    A null text, an empty one and one without words has 0 shingles and no link. Rows
    with the same id are one document with several texts, linked by any of them. A row
    without an id has no component and is kept. Other columns are ignored. Runs jobs.
    """
    similarity = percent / 100
    sketched = materialise(sketches(docs, size, K, id_col, text_col))
    usable = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # documents with equal sets share a digest: one of them stands for all
    first = usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    copies = usable.join(first.filter("copies > 1").select("digest", "node"), "digest")
    copies = copies.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    heads = usable.join(first.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    heads = heads.dropDuplicates(["doc_id", "digest"])

    def classes(rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.size("sketch").alias("size"), "sketch"
        )

    # small sketches leave the documents that may have a partner; larger ones find it
    nodes = _postings(classes(heads), similarity, K).select(F.col("node").alias("doc_id")).distinct()
    nodes = materialise(nodes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = only_with_ids(rows, "doc_id", nodes).join(nodes, "doc_id", "left_semi")
    texts = materialise(texts.filter("text IS NOT NULL").dropDuplicates())
    large = materialise(sketches(texts, size, LARGE_K, "doc_id", "text").drop("digest").filter("n_shingles > 0"))
    postings = materialise(_postings(classes(large), similarity, LARGE_K))
    share = _least_share(similarity, LARGE_K)

    def verify(pairs: DataFrame) -> DataFrame:
        def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
            return table.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

        # the k smallest values of both sketches are the sketch of the union
        est = pairs.join(side(large, "a", "n_shingles", "sketch"), "a").join(side(large, "b", "n_shingles", "sketch"), "b")
        whole = F.greatest("a_n_shingles", "b_n_shingles") <= LARGE_K
        both = F.array_intersect("a_sketch", "b_sketch")
        exact = 100 * F.size(both) >= percent * (F.size("a_sketch") + F.size("b_sketch") - F.size(both))
        union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, LARGE_K)
        likely = F.size(F.array_intersect(union, both)) >= F.lit(share) * F.size(union)
        est = est.filter(F.when(whole, exact).otherwise(likely)).select("a", "b").distinct()
        both = est.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
        both = both.select("a", "b", "a_text", "b_text")
        return both.mapInArrow(_alike(percent, size), "a long, b long").distinct()

    # the document with the fewest values of its own is nearest to all others of a bucket
    order = F.col("own") * (1 << 40) + F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    near = _near(similarity, LARGE_K)
    refine = _difference_links(large, verify, near, similarity, order)
    whole = lambda side: F.col(f"{side}n") <= LARGE_K
    links = link_buckets(postings, verify, near, rounds=2, order=order, refine=refine, refined=whole)
    edges = copies.union(links)
    found = components(edges)
    linked = sketched.select("doc_id", "n_shingles").join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    )
    return linked.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"),
    )
