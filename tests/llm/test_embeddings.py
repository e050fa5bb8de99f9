"""Links of vectors against all pairs, over many shards."""

import numpy as np

import pytest

from touchline.llm import embeddings
from touchline.llm.embeddings import embedding_groups, search_both_ways
from touchline.llm.hnsw import Graph


def test_links_equal_all_pairs(spark):
    """Chains and dense groups over several shards: every link counts for both its vectors."""
    draw = np.random.default_rng(9)
    base = draw.normal(size=(120, 16))
    near = np.concatenate([base + 0.05 * k * draw.normal(size=base.shape) for k in range(6)])
    vectors = np.concatenate([near, near[:40], draw.normal(size=(200, 16))])
    labels = draw.integers(0, 2, len(vectors))
    rows = [(i, int(label), [float(v) for v in x]) for i, (label, x) in enumerate(zip(labels, vectors))]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r["vec_id"]: r for r in embedding_groups(frame, shard_rows=90).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    assert linked.sum() > 500
    assert [found[i]["n_links"] for i in range(len(rows))] == linked.sum(1).tolist()
    component = np.arange(len(rows))
    while True:
        least = np.minimum(component, np.where(linked, component[None, :], len(rows)).min(1))
        if (least == component).all():
            break
        component = least
    assert [found[i]["component_id"] for i in range(len(rows))] == component.tolist()


def test_links_without_partners(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "a", None), (4, None, [1.0, 0.0]), (None, "a", [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    found = embedding_groups(frame).collect()
    assert len(found) == 5 and all(r["n_links"] == 0 and r["kept"] for r in found)


def clustered(draw, groups, members, noise=0.04, dim=24):
    base = draw.normal(size=(groups, dim))
    rows = np.repeat(base, members, axis=0) + noise * draw.normal(size=(groups * members, dim))
    rows = rows[draw.permutation(len(rows))]
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_audits_widen_the_beam():
    """A beam of one misses links; the audit sees it, from either side, and widens."""
    draw = np.random.default_rng(3)
    one = clustered(draw, 150, 3)
    two = np.concatenate([one[::2] + 0.01, clustered(draw, 100, 3)])
    two /= np.linalg.norm(two, axis=1, keepdims=True)
    left, right = Graph.built(one, beam=4), Graph.built(two, beam=4)
    exact = one @ two.T >= 0.98
    narrow, beam = search_both_ways(left, right, 0.98, 0, 1.0, 1)
    assert beam == 1 and not (narrow & ~exact).any()
    hit, beam = search_both_ways(left, right, 0.98, 1_000, 1.0, 1)
    assert (hit == exact).all()
    same, _ = search_both_ways(left, left, 0.98, 1_000, 1.0, 1)
    own = one @ one.T >= 0.98
    np.fill_diagonal(own, False)
    assert (same == own).all() and (same == same.T).all()


def test_every_node_is_reached():
    draw = np.random.default_rng(5)
    rows = np.concatenate([clustered(draw, 3, 200, noise=0.001), clustered(draw, 40, 2)])
    graph = Graph.built(rows, beam=4)
    seen = np.zeros(len(rows), bool)
    graph._reached(graph.entry, seen)
    assert seen.all()


@pytest.mark.parametrize("shard_rows", [400, 60])
def test_recall_of_production_audits(spark, shard_rows):
    """Links and components with the audits of the query, over one shard and over many."""
    vectors = np.concatenate([clustered(np.random.default_rng(6), 250, 2), clustered(np.random.default_rng(7), 4, 120, noise=0.02)])
    frame = spark.createDataFrame([(i, 1, [float(v) for v in x]) for i, x in enumerate(vectors)], "vec_id long, label int, embedding array<double>")
    rows = {r["vec_id"]: r["n_links"] for r in embedding_groups(frame, shard_rows=shard_rows).collect()}
    exact = (vectors @ vectors.T >= 0.98).sum(1) - 1
    found = np.array([rows[i] for i in range(len(vectors))])
    assert (found <= exact).all() and found.sum() >= 0.99 * exact.sum() > 10_000
    assert embeddings.FIRST_BEAM < shard_rows
