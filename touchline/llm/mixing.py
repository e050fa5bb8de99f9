"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget flows from the root down by the nodes' weights. A node cannot hold
more than its supply times the allowed epochs; what it cannot hold goes to its siblings,
and only what all children lack together was never given to their parent. A leaf
takes whole epochs of its documents and a prefix of one more, in a seeded order.
Everything is grouping and windows over the tree's nodes; texts are never shuffled
unless the table of leaves is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.sources.tables import materialise

LEVELS = ["domain", "lang", "source"]
KEY_BITS, BUCKET_BITS = 60, 12
Weights = Mapping[str, Mapping[str, int]]


def default_domain(source: str = "source") -> Column:
    """Domain of a source: the number at the end of its name modulo 4."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.coalesce((number.try_cast("int") % 4).cast("string"), F.lit("")))


def default_tokens(text: str = "text") -> Column:
    """Tokens of a text: a quarter of its code points, rounded up; 0 of a null text."""
    return F.floor((F.coalesce(F.length(text), F.lit(0)) + 3) / 4).cast("long")


def _weight(level: str, weights: Weights) -> Column:
    chosen = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        chosen = F.when(F.col(level) == name, weight).otherwise(chosen)
    return chosen.cast("long")


def _share(children: DataFrame, parent: list[str], level: str, weights: Weights) -> DataFrame:
    """Add ``quota``: the parent's budget by weight, never above a child's capacity.

    In order of capacity over weight the children that are filled come first.
    A child is filled when its capacity is at most its share of what the ones
    before it leave; the others share the rest.
    """
    weighted = children.withColumn("w", _weight(level, weights)).filter("w > 0")
    before = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("w"), level)
    before = before.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parent)
    rest = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    rest_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    marked = weighted.withColumn("filled", F.col("capacity") * rest_w <= F.col("w") * rest)
    open_w = F.sum(F.when(~F.col("filled"), F.col("w"))).over(whole)
    open_budget = F.col("budget") - F.coalesce(F.sum(F.when(F.col("filled"), F.col("capacity"))).over(whole), F.lit(0))
    shared = F.expr("w * open_budget div open_w")
    marked = marked.withColumn("open_w", open_w).withColumn("open_budget", open_budget)
    return marked.withColumn("quota", F.when(F.col("filled"), F.col("capacity")).otherwise(shared)).drop(
        "w", "filled", "open_w", "open_budget", "budget"
    )


def quotas(leaves: DataFrame, fraction: float, epochs: int, weights: Weights) -> DataFrame:
    """``domain``, ``lang``, ``source``, ``supply``, ``quota`` of every leaf.

    ``leaves``: the levels and ``supply`` (tokens). The budget is ``fraction`` of all
    tokens, at most ``epochs`` times the supply.
    """
    tree = leaves.withColumn("capacity", F.col("supply") * epochs)
    total = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("all"))
    budget = F.least(F.floor(F.col("all") * F.lit(fraction)).cast("long"), F.col("all") * epochs)
    given = total.select(F.lit(0).alias("root"), budget.alias("budget"))
    parent = ["root"]
    for depth, level in enumerate(LEVELS):
        known = LEVELS[: depth + 1]
        nodes = tree.groupBy(*known).agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(0))
        shared = _share(nodes.join(given, parent), parent, level, weights)
        given = shared.select(*known, F.col("quota").alias("budget"))
        parent = known
    return leaves.join(given, LEVELS, "left").select(
        *LEVELS, "supply", F.coalesce("budget", F.lit(0)).alias("quota")
    )


def order_key(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    """60-bit number that orders a leaf's documents in an epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    fraction: float = 0.8,
    epochs: int = 2,
    weights: Weights | None = None,
    seed: int = 7,
    domain: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """Choose how often each document goes into the mixture.

    Args:
        docs: ``doc_id``, ``text``, ``lang``, ``source``.
        fraction: token budget as a share of all tokens.
        epochs: how often a document may be used at most.
        weights: per level, integer weights of named nodes; 1 where none is given,
            0 leaves a node out.
        domain, tokens: expressions for the top level and for a document's tokens.

    Returns:
        All columns of ``docs`` and ``domain``, ``n_tokens``, ``copies`` (0 for those not
        chosen); columns of these names are replaced.

    In the partial epoch of a leaf, in seeded order, documents are taken while
    those before them hold less than the quota's remainder. A null language or
    source is a node named ''. Documents without tokens fill no quota but may lie
    in a prefix. Repeated rows share their place. Runs jobs.
    """
    weights = weights or {}
    named = docs.withColumns(
        {
            "domain": domain if domain is not None else default_domain(),
            "n_tokens": tokens if tokens is not None else default_tokens(),
            "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        }
    )
    rows = named.select(
        "doc_id", "domain", F.col("_lang").alias("lang"), F.col("_source").alias("source"), "n_tokens"
    )
    rows = materialise(rows)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    plan = quotas(leaves, fraction, epochs, weights)
    full = F.when(F.col("supply") > 0, F.expr("quota div supply")).otherwise(0).cast("long")
    plan = materialise(plan.select(*LEVELS, full.alias("full"), (F.col("quota") - full * F.col("supply")).alias("rest")))

    partial = plan.filter("rest > 0")
    keyed = rows.join(partial, LEVELS).withColumn("key", order_key(seed, F.col("full")))
    keyed = keyed.withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS))
    sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    so_far = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).filter("before < rest")
    # the last bucket that begins within the remainder holds the last document
    edge = sums.groupBy(*LEVELS).agg(F.max("bucket").alias("bucket"), F.max("before").alias("before"))
    last = keyed.select(*LEVELS, "rest", "bucket", "key", "n_tokens").join(edge, [*LEVELS, "bucket"])
    inside = W.partitionBy(*LEVELS).orderBy("key").rangeBetween(W.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    cut = last.withColumn("upto", upto).filter("upto < rest").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    table = plan.join(cut, LEVELS, "left").select(
        "domain", F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("full").alias("_full"),
        F.col("cut").alias("_cut"),
    )
    table = materialise(table)
    chosen = named.join(table, ["domain", "_lang", "_source"])
    more = F.coalesce(order_key(seed, F.col("_full")) <= F.col("_cut"), F.lit(False)).cast("long")
    kept = [c for c in docs.columns if c not in ("domain", "n_tokens", "copies")]
    return chosen.select(
        *[F.col(f"`{c}`") for c in kept], "domain", "n_tokens", (F.col("_full") + more).alias("copies")
    )
