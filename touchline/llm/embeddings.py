"""Near-duplicate vectors: small-world graphs per shard, audited searches, components.

Vectors of one label and length are dealt into shards of bounded size, each with a
graph. Every vector queries the graph of every shard of its label; for two shards, a
pair found from either side counts for both. Beams widen until the links of audited
queries, compared with brute force, are all found. Equal vectors are one node.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from touchline.llm.common import components
from touchline.llm.hnsw import Graph
from touchline.sources.tables import materialise

SLACK = 1e-9  # the search takes in slightly more than the exact cosine lets pass
FIRST_BEAM = 24
TILE = 1_024  # pairs whose cosines are computed at once


def _unit(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    raw = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
    norms = np.sqrt((raw * raw).sum(1))
    return raw, norms


def _build(key, frame):
    """One row per shard: its vectors and their graph."""
    frame = frame.sort_values("node")
    raw, norms = _unit(frame)
    graph = Graph.built(raw / norms[:, None])
    data = pickle.dumps((frame["node"].to_numpy(), frame["copies"].to_numpy(), raw, norms, graph))
    return pd.DataFrame({"label": [key[0]], "size": [key[1]], "shard": [key[2]], "graph": [data]})


def search_both_ways(left: Graph, right: Graph, least: float, audit: int, recall: float, beam: int) -> tuple[np.ndarray, int]:
    """Pairs of two graphs with a cosine of about ``least`` or more, and the beam that found them.

    Each vector queries the other graph (its own, without itself, if both are one).
    Audited are up to ``audit`` queries that have links already, and as many of
    all, from either side: their links by brute force must be found to the share ``recall``, or
    the beam doubles. Beams as wide as a graph compare everything.
    """
    same = left is right
    sides = [(left, right)] if same else [(left, right), (right, left)]
    while True:
        hit = np.zeros((len(left.vectors), len(right.vectors)), bool)
        for k, (asking, asked) in enumerate(sides):
            seen = hit.T if k else hit
            for i, q in enumerate(asking.vectors):
                seen[i, asked.near(q, beam, least - SLACK)] = True
        if same:
            hit |= hit.T
            np.fill_diagonal(hit, False)
        wanted = found = 0
        exact = []
        for k, (asking, asked) in enumerate(sides):
            seen = hit.T if k else hit
            draw = np.random.default_rng(7 + k)
            linked = np.flatnonzero(seen.any(1))
            chosen = np.unique(np.concatenate([draw.permutation(linked)[:audit], draw.permutation(len(seen))[:audit]]))
            near = asking.vectors[chosen] @ asked.vectors.T >= least - SLACK
            if same:
                near[np.arange(len(chosen)), chosen] = False
            wanted += int(near.sum())
            found += int((near & seen[chosen]).sum())
            exact.append((k, chosen, near))
        if found >= recall * wanted or beam >= max(len(left.vectors), len(right.vectors)):
            for k, chosen, near in exact:  # what the audit knows is kept
                (hit.T if k else hit)[chosen] |= near
            return (hit | hit.T if same else hit), beam
        beam *= 2


def _link(least: float, audit: int, recall: float):
    """Links between two shards, or inside one: counts per vector, and a spanning forest."""

    def run(key, graphs):
        loaded = {int(s): pickle.loads(g) for s, g in zip(graphs["shard"], graphs["graph"])}
        one, held, raw, norms, graph = loaded[min(loaded)]
        two, other_held, other_raw, other_norms, other = loaded[max(loaded)]
        hit, _ = search_both_ways(graph, other, least, audit, recall, FIRST_BEAM)
        # the exact cosine decides, by each pair's own products: the order of a sum must not matter
        i, j = np.nonzero(hit)
        for part in range(0, len(i), TILE):
            x, y = i[part : part + TILE], j[part : part + TILE]
            hit[x, y] = (raw[x] * other_raw[y]).sum(1) / (norms[x] * other_norms[y]) >= least
        counts = hit @ other_held.astype(np.float64)
        nodes, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        at, group = (place[: len(one)], place[len(one) :]), np.arange(len(nodes))
        rows: list[tuple[int, int, int | None]] = []
        for k in np.flatnonzero(hit.any(1)):
            own = at[0][k]
            for root in np.unique(group[at[1][hit[k]]]):
                if root != group[own]:
                    rows.append((int(nodes[own]), 0, int(nodes[root])))
                    # a group's number is one of its members
                    group[group == root] = group[own]
        rows += [(int(n), int(c), None) for n, c in zip(one, counts)]
        if graph is not other:
            rows += [(int(n), int(c), None) for n, c in zip(two, held.astype(np.float64) @ hit)]
        out = pd.DataFrame(rows, columns=["node", "n", "other"])
        out["other"] = out["other"].astype("Int64")
        return out

    return run


def embedding_groups(
    vectors: DataFrame, least: float = 0.98, shard_rows: int = 8_192, audit: int = 64, recall: float = 1.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Groups of vectors of one label linked by a cosine of at least ``least``.

    Args:
        shard_rows: vectors of one graph; a task searches two graphs.
        audit: queries per side of two shards, of those with links and of all, whose links are
            compared with brute force; recall: share of their links that the beam must find.

    Returns:
        One row per id: ``vec_id``, ``n_links`` (other vectors linked directly),
        ``component_id`` (the smallest id reachable, itself included), ``kept``
        (``vec_id = component_id``).

    A pair that the search finds is linked if its cosine, in double precision, reaches ``least``; both
    vectors count it. Pairs that no audit sees may be missed. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null label, link with nothing; nor do
    vectors of different lengths. Of rows that share an id the one with the smallest
    label and vector counts. Rows without an id are returned one by one, kept and without links. Runs jobs.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")
    )
    known = rows.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    known = materialise(known.select("vec_id", "r.*"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = known.filter(
        F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    ).withColumn("size", F.size("embedding"))
    alike = usable.groupBy("label", "size", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    sizes = alike.groupBy("label", "size").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    # hashing fills shards unevenly: one part in ten more of them keeps a graph within its bound
    sizes = sizes.withColumn("shards", F.when(F.col("shards") > 1, F.ceil(F.col("shards") * 1.1)).otherwise(1).cast("int"))
    dealt = alike.join(sizes, ["label", "size"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    dealt = materialise(dealt)
    # a fixed number of partitions: small shards are long work, so they should not be merged
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["label", "size", "shard"]
    grouped: GroupedData = dealt.select(*place, "node", "copies", "embedding").repartition(parts, *place).groupBy(*place)
    schema = f"label {dealt.schema['label'].dataType.simpleString()}, size int, shard int, graph binary"
    graphs = materialise(grouped.applyInPandas(_build, schema)).join(sizes, ["label", "size"])
    # each two shards of a label meet once, each shard with itself too
    others = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    meeting = graphs.withColumn("_with", others).select(
        "label", "size", F.least("shard", "_with").alias("low"), F.greatest("shard", "_with").alias("high"), "shard", "graph"
    )
    keys = ["label", "size", "low", "high"]
    found = meeting.repartition(parts, *keys).groupBy(*keys).applyInPandas(
        _link(least, audit, recall), "node long, n long, other long"
    )
    found = materialise(found)

    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    groups = components(edges)
    member = usable.join(alike, ["label", "size", "embedding"]).select("vec_id", "node", "copies")
    member = member.join(links, "node").join(groups, "node", "left").select(
        "vec_id", (F.col("n") + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component")
    )
    result = known.select("vec_id").join(member, "vec_id", "left")
    missing = rows.filter("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("component"))
    result = result.select("vec_id", "n", "component").union(missing)
    return result.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"),
    )
