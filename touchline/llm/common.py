"""Shared steps of the operators: connected components and linking inside large buckets.

Nothing here holds links, components or buckets in the driver or in one task.
Intermediate tables lie in the shared folder of the run (``materialise``), so a
lost executor costs no recomputation and a loop never grows its lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.sources.tables import materialise, stored_alone

LAST_ID = (1 << 63) - 1  # stands for a missing id where ids are compared
CROWDED = 8  # nodes outside a bucket's largest component beyond which a finer key finds its links


def unused(frame: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``frame`` does not have, whatever the case."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a digest of all of them; equal when nothing changed."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """The connected component of every linked node.

    Args:
        edges: long columns ``a`` and ``b``; direction, repeats and loops do not
            matter, rows with a null are ignored.

    Returns:
        ``node``, ``component`` (the smallest node of the component), for every
        node that has a link to another one. Nothing for an empty input.

    The alternation of large and small stars needs a number of rounds that grows
    with the logarithm of the number of nodes; a hub's links are joined, never grouped
    into one row. Runs jobs: each round is stored.
    """
    known = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    known = materialise(known.filter("a <> b").distinct())
    seen = _fingerprint(known)
    while seen[0]:
        known = materialise(_small_star(_large_star(known)))
        now = _fingerprint(known)
        if now == seen:
            break
        seen = now
    leaves = known.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(known.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _placed(postings: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Postings with the component that the links found so far give each node."""
    if edges is None:
        return postings.withColumn("comp", F.col("node"))
    found = components(edges)
    return postings.join(found, "node", "left").withColumn(
        "comp", F.coalesce("component", "node")
    ).drop("component")


def link_buckets(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column] | None = None,
    rounds: int = 1,
    order: Column | None = None,
    known: DataFrame | None = None,
    refine: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
    refined: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Links that connect all similar nodes, without all pairs of a bucket.

    Args:
        postings: ``key`` and ``node`` (longs) and any columns that ``near`` or
            ``order`` read: two nodes are candidates when they share a key.
        verify: keeps the similar pairs of a table of candidates (``a`` < ``b``).
        near: a necessary condition on two postings; takes the prefixes of their columns.
        rounds: passes in which each bucket compares its nodes with one of them.
        order: number whose smallest value in a bucket chooses that one in the first pass;
            in later passes, and by default, a hash of the node does.
        known: links found before; pairs they connect are not compared, and they are returned too.
        refine: finds the links inside crowded buckets by a finer key than theirs. Gets their postings, with ``comp``,
            and the links so far; returns links that connect all similar nodes for which ``refined`` (on a posting,
            by the prefix of its columns) holds.

    Returns:
        ``a``, ``b``: verified links. They have the connected components of all
        verified candidate pairs, but not every pair inside a component.

    A pass costs one comparison per posting. After the passes only nodes outside
    a bucket's largest component are compared with the bucket's other components,
    so every pair of candidates is either compared or already connected. With ``refine`` that
    pass makes at most ``CROWDED`` comparisons per posting for the nodes it covers. Runs jobs.
    """

    def one_pass(turn: int, edges: DataFrame | None) -> DataFrame:
        placed = materialise(_placed(postings, edges))
        compared = F.col("comp") != F.col("hub_comp")
        rest = [c for c in placed.columns if c != "key"]
        if turn < rounds:
            by = order if order is not None and not turn else F.xxhash64("node", F.lit(turn))
            chosen = [F.min_by(c, by).alias(f"hub_{c}") for c in rest]
            hubs = placed.groupBy("key").agg(
                F.min("comp").alias("lo"), F.max("comp").alias("hi"), *chosen
            ).filter("lo <> hi").drop("lo", "hi")
        else:
            sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
            main = sizes.groupBy("key").agg(
                F.max_by("comp", F.col("n")).alias("main"), (F.sum("n") - F.max("n")).alias("others")
            ).filter("others > 0").withColumn("crowded", F.col("others") > CROWDED)
            if refine is not None:
                main = materialise(main)
                crowded = placed.join(main.filter("crowded").select("key"), "key")
                edges = materialise(refine(crowded, edges).select("a", "b"))
                compared = compared & ~(F.col("hub_crowded") & refined("") & refined("hub_"))
            hubs = placed.join(main, "key").filter("comp <> main")
            hubs = hubs.select("key", *[F.col(c).alias(f"hub_{c}") for c in [*rest, "crowded"]])
        pairs = placed.join(hubs, "key").filter(compared)
        if near is not None:
            pairs = pairs.filter(near("", "hub_"))
        pairs = pairs.select(
            F.least("hub_node", "node").alias("a"), F.greatest("hub_node", "node").alias("b")
        ).distinct()
        found = verify(pairs).select("a", "b")
        return found if edges is None else edges.select("a", "b").union(found)

    edges = known
    for turn in range(rounds + 1):
        edges = stored_alone(lambda turn=turn, edges=edges: one_pass(turn, edges))
    return edges


def only_with_ids(frame: DataFrame, column: str, ids: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """Rows of a wide table that may carry one of the ids, without shuffling the table.

    The ids are hashed to a fixed number of buckets; the broadcast side has at
    most ``buckets`` distinct integers, whatever the number of ids. Rows of
    a hit bucket with another id pass too: join by id afterwards.
    """
    place = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
    wanted = ids.select(place.alias("_bucket")).distinct()
    return frame.withColumn("_bucket", place).join(F.broadcast(wanted), "_bucket", "left_semi").drop("_bucket")
