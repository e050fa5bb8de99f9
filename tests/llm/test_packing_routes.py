"""Packing: related documents meet, wherever they stand in the input."""

import random
from collections import defaultdict

import numpy as np

from touchline.llm.packing import Index, pack_documents


def test_related_documents_share_windows(spark):
    """Share of neighbours in a window that are of one topic, against BM25 over the whole corpus."""
    draw = random.Random(41)
    common = [f"word{i}" for i in range(300)]
    topics = [["".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(4)) for _ in range(12)] for _ in range(40)]
    docs = [(t, " ".join(draw.choice(topics[t]) if draw.random() < 0.4 else draw.choice(common) for _ in range(30))) for t in range(40) for _ in range(16)]
    draw.shuffle(docs)
    frame = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(docs)], "doc_id long, text string").coalesce(1)
    windows = defaultdict(list)
    for r in pack_documents(frame, window=512, shard_docs=64).collect():
        windows[r["sequence_id"]].append((r["offset"], r["doc_id"]))
    same = [docs[a[1]][0] == docs[b[1]][0] for w in windows.values() for w in [sorted(w)] for a, b in zip(w, w[1:])]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in docs for w in t.split()}))}
    whole = Index([np.array([vocabulary[w] for w in t.split()]) for _, t in docs])
    best = [docs[int(whole.neighbours(i, np.arange(len(docs)) == i)[0])][0] == docs[i][0] for i in range(len(docs))]
    print(f"same topic: packed {np.mean(same):.2f}, whole corpus {np.mean(best):.2f}")
    assert np.mean(same) > 0.4  # 0.16 when shards are cut from the input as it stands


def test_all_terms_of_a_seed_count():
    ids = [np.arange(1, 60), np.array([59, 58, 70]), np.array([80, 81])]
    assert all(1 in Index([*ids, np.arange(1, k)]).neighbours(0, np.array([True, False, False, False])) for k in (5, 50))
