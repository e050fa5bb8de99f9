"""Toxicity: the risk and its gradient, learning from few labels, odd tables, held-out rows."""

import random
import zlib

import numpy as np

from touchline.llm import registry, toxicity
from touchline.llm.toxicity import Settings, contrasting, fit, grams_of, one_of_each

SF_DIR = "/root/testdata/sf0.01"


def corpus(count, seed, toxic_share=0.2):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "ten", "mu", "sol", "va", "ne"]
    rows = []
    for i in range(count):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < toxic_share
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["Grumfel", "grumfeling", "snackwit!"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_grams_are_those_of_whole_words():
    a, b = (set(grams_of(t, (5,), 22)) for t in ("Grumfel", "xx GRUMFEL, yy"))
    assert a and a <= b and not a & set(grams_of("another text", (5,), 22))
    long = "word " * 300_000 + "grumfel"
    assert a <= set(grams_of(long, (5,), 22))
    assert len(grams_of(None, (5, 7), 22)) == len(grams_of("", (5, 7), 22)) == len(grams_of("1 !", (5, 7), 22)) == 0


def test_copies_teach_once():
    texts = [t for _, t, _ in corpus(30, 8)]
    hashed = [grams_of(t, (5, 7), 22) for t in [*texts, *texts[:10], ""]]
    kept = one_of_each(hashed)
    assert len(kept) == 31 and len(kept[30]) == 0 and all(np.array_equal(a, b) for a, b in zip(kept[:30], hashed))
    near = [grams_of(texts[0] + f" more{'x' * i}", (5, 7), 22) for i in range(20)]
    assert len(one_of_each(near)) < 8


def test_fit_reaches_the_least_corrected_risk():
    """Against a dense numpy search over the same selected buckets."""
    rows = corpus(400, 1)
    s = Settings(contrast=3.0, steps=1500, decay=0.0)
    hashed = [grams_of(t, s.grams, s.bits) for _, t, _ in rows]
    positive = [h for h, r in zip(hashed, rows) if r[2]][:40]
    selected, weights, bias = fit(positive, hashed, 0.2, s)
    assert np.array_equal(selected, contrasting(positive, hashed, s)) and len(selected) > 5

    def risk(w, b):
        dense = [np.array([np.isin(selected, d) for d in part]) @ w + b for part in (positive, hashed)]
        clean = np.logaddexp(0, dense[1]).mean() - 0.2 * np.logaddexp(0, dense[0]).mean()
        return 0.2 * np.logaddexp(0, -dense[0]).mean() + max(0.0, clean), clean

    best, clean = risk(weights, bias)
    assert clean > -0.02  # the correction holds the estimate of the clean risk near or above zero
    rng = np.random.default_rng(2)
    for size in (0.01, 0.1, 1.0):
        for _ in range(30):
            assert risk(weights + size * rng.standard_normal(len(weights)), bias + size * rng.standard_normal())[0] > best - 0.02


def test_unlabelled_toxic_text_is_found(spark):
    """Half the toxic documents stand unlabelled among the clean ones while it learns."""
    rows = corpus(600, 4)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    confirmed = [(i, y) for i, _, y in rows if i < 300]
    labels = spark.createDataFrame(confirmed, "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    hidden = [(found[i] >= 0.7, y) for i, _, y in rows if i >= 300]
    assert np.mean([hit for hit, y in hidden if y]) > 0.95 and np.mean([hit for hit, y in hidden if not y]) < 0.02


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, "x"), (7, 0, "x"), (7, 1, "y"), (None, 1, "x"), (5, None, "x"), (6, 2, "x"), (99, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(odd_documents.withColumn("score", odd_documents["node"]), labels)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1  # none, empty, blank


def test_nothing_to_learn(spark, odd_documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    only_clean = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for labels in (none, only_clean):
        model = toxicity.train(odd_documents, labels)
        assert [r["score"] for r in toxicity.score(odd_documents, model).collect()] == [0.0] * 12
    empty = odd_documents.limit(0)
    model = toxicity.train(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0


def test_held_out_documents(spark):
    rows = registry.op11_toxicity(spark, SF_DIR).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert np.mean([p for p, y in held if not y]) < 0.03
