"""Mixing, vectors, the pipeline and the registered queries."""

import random
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracles.compare import connect, differences
from touchline.llm import mixing, registry
from touchline.llm.embeddings import embedding_groups
from touchline.llm.hnsw import Graph
from touchline.llm.minhash import minhash_groups

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    frame = registry.queries()[name](spark, SF_DIR)
    assert differences(frame, connect(SF_DIR), registry.oracle_sql()[name]) == []


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.queries())
    assert numbers == list(range(1, 11))
    assert {*registry.queries(), "pipeline"} <= set(entry.queries())


def brute_share(budget, nodes):
    """Water filling: {name: (weight, capacity)}, one round per filled set."""
    quota, open_nodes = {}, {n: x for n, x in nodes.items() if x[0] > 0}
    while open_nodes:
        total = sum(w for w, _ in open_nodes.values())
        full = {n for n, (w, c) in open_nodes.items() if c * total <= w * budget}
        if not full:
            return quota | {n: w * budget // total for n, (w, _) in open_nodes.items()}
        for n in full:
            quota[n] = open_nodes.pop(n)[1]
        budget -= sum(quota[n] for n in full)
    return quota


def test_quotas_equal_water_filling(spark):
    random.seed(9)
    leaves = [(f"d{i % 3}", f"l{i % 4}", f"s{i}", random.choice([0, 5, 50, 400, 3000])) for i in range(40)]
    weights = {"domain": {"d0": 5, "d1": 0}, "lang": {"l2": 3}, "source": {"s7": 9}}
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, supply long")
    found = {(r[0], r[1], r[2]): r["quota"] for r in mixing.quotas(frame, 0.6, 2, weights).collect()}
    weight = lambda level, n: weights[level].get(n, 1)
    cap = defaultdict(int)
    for d, lang, s, supply in leaves:
        for path in ((d,), (d, lang), (d, lang, s)):
            cap[path] += 2 * supply
    total = sum(x[3] for x in leaves)
    budgets = {(): min(int(total * 0.6), 2 * total)}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in [p for p in budgets if len(p) == depth]:
            children = {p[-1]: (weight(level, p[-1]), c) for p, c in cap.items() if p[:-1] == parent and len(p) == depth + 1}
            for n, quota in brute_share(budgets[parent], children).items():
                budgets[(*parent, n)] = quota
    assert found == {(d, lang, s): budgets.get((d, lang, s), 0) for d, lang, s, _ in leaves}


def test_mixture_meets_its_quotas(spark, documents):
    found = mixing.mix(documents, fraction=0.8, epochs=2).collect()
    taken = sum(r["copies"] * r["n_tokens"] for r in found)
    supply = sum(r["n_tokens"] for r in found)
    assert len(found) == documents.count() and max(r["copies"] for r in found) <= 2
    assert taken >= 0.8 * supply - 200  # rounding loses less than a token per node


def test_mixing_odd_rows(spark):
    rows = [(1, "a" * 40, None, None), (1, "a" * 40, None, None), (2, None, "en", "src1"), (None, "b" * 9, "en", "src1"),
            (3, "", "de", "odd name"), (4, "c" * 400, "en", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = docs.selectExpr("*", "1 AS key", "2 AS copies")
    found = mixing.mix(clash, fraction=1.0, epochs=1)
    assert found.columns == ["doc_id", "text", "lang", "source", "key", "domain", "n_tokens", "copies"]
    kept = found.collect()
    assert len(kept) == 6 and all(r["copies"] == 1 for r in kept if r["n_tokens"])
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_vectors(rows, least=0.98):
    ids = [i for i, *_ in rows]
    links = {i: set() for i in ids}
    for x, (a, v, k) in enumerate(rows):
        for b, w, m in rows[x + 1 :]:
            if k is None or k != m or v is None or w is None or len(v) != len(w):
                continue
            p, q = np.array(v, float), np.array(w, float)
            if not (np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any()):
                continue
            if p @ q / np.sqrt((p @ p) * (q @ q)) >= least:
                links[a].add(b)
                links[b].add(a)
    found = {}
    for i in sorted(ids):
        if i in found:
            continue
        todo = [i]
        while todo:
            n = todo.pop()
            if n not in found:
                found[n] = i
                todo += links[n]
    return {i: (len(links[i]), found[i]) for i in ids}


def test_vectors_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    exact = brute_vectors(rows)
    for size in (8192, 20):  # one shard per label, and several
        found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_groups(table, shard_rows=size).collect()}
        assert found == exact


def test_dense_group_and_copies(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    vectors = [centre + 0.06 * rng.normal(size=16) for _ in range(120)] + [rng.normal(size=16) for _ in range(120)]
    vectors += [vectors[0]] * 15 + [vectors[130]] * 4
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_groups(table).collect()}
    exact = brute_vectors(rows)
    hits = sum(min(found[i][0], exact[i][0]) for i in exact)
    assert hits >= 0.99 * sum(n for n, _ in exact.values()) and all(found[i][0] <= exact[i][0] for i in exact)
    assert {i: c for i, (_, c) in found.items()} == {i: c for i, (_, c) in exact.items()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1),
            (6, [inf, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1),
            (11, [], 1), (None, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(table).collect()}
    assert found.pop(1) == (1, 1, True) and found.pop(2) == (1, 1, False) and found.pop(None) == (0, None, True)
    assert found == {i: (0, i, True) for i in range(3, 12)}
    assert embedding_groups(table.limit(0)).count() == 0


def test_graph_finds_neighbours():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph.built(x)
    hit = total = 0
    for i in range(0, 1500, 30):
        best = set(np.argsort(-(x @ x[i]))[:10].tolist())
        found = [n for _, n in graph._search(x[i], graph._descend(x[i], 0), 64, 0)[:10]]
        hit += len(best & set(found))
        total += 10
    assert hit / total > 0.9


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF_DIR))
        assert docs.columns == columns
        seen[name] = docs
    counts = {name: frame.count() for name, frame in seen.items()}
    assert counts["quality classifier"] < 200 and counts["minhash near-dedup"] <= counts["line dedup"]
    assert seen["minhash near-dedup"].count() == minhash_groups(seen["line dedup"]).filter("kept").count()
    lines = [x.strip().lower() for r in seen["line dedup"].collect() for x in (r["text"] or "").split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in packed)
    by_sequence = defaultdict(int)
    for r in rows:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) == 2048


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (2, "", "en", "src1", 0), (None, "some words here", "en", "src2", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, str(tmp_path)).count() >= 0
