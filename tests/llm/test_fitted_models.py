"""Classifiers, the field and the language models: held-out results and direct sums."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from touchline.llm import language, lm_score, pii, quality, registry
from touchline.llm.tokens import default_vocabulary, tokenizer

SF_DIR = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    rows = registry.op5_quality_classifier(spark, SF_DIR).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert len(rows) == 1000 and right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (9, 1), (7, 3)], "doc_id long, quality int")
    model = quality.train(odd_documents, labels)
    rows = quality.score(odd_documents, model, keep=("doc_id", "node")).collect()
    assert len(rows) == 12 and len({r["score"] for r in rows if r["node"] in (2, 3, 4)}) == 1
    none = quality.train(odd_documents, labels.limit(0))
    assert {r["score"] for r in quality.score(odd_documents, none).collect()} == {0.5}
    assert quality.score(odd_documents.limit(0), model).count() == 0


def test_ftrl_learns_and_stays_sparse():
    s = quality.Settings(bits=10, epochs=5)
    rows = [(np.array([i % 2, 2 + i % 50]), np.array([0.8, 0.6]), i % 2) for i in range(400)]
    weights, _ = quality.ftrl(rows, s)
    assert weights[0] < -1 < 1 < weights[1] and np.count_nonzero(weights) < 60


def test_language_of_held_out_documents(spark):
    rows = registry.op6_language_id(spark, SF_DIR).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in rows) < 50


def test_letters():
    assert [language.has_letter(t) for t in ("\u00b2", "\u00bd 12", "_", "", None)] == [False] * 5
    assert all(map(language.has_letter, ("1\u00e9", "\u6f22", "\u02b0")))


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 20, f"lang{i}") for i in range(450)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=64)
    assert set(model.languages) == {f"lang{i}" for i in range(450)}


def test_language_odd_rows(spark, odd_documents):
    from pyspark.sql import functions as F

    docs = odd_documents.withColumn("lang", F.when(F.col("node") < 6, "en"))
    model = language.train(docs)
    rows = {r["node"]: r for r in language.predict(odd_documents, model, keep=("node",)).collect()}
    assert {n for n, r in rows.items() if r["lang_pred"] == "und"} == {2, 3, 4}
    assert rows[1]["lang_pred"] == "en" and rows[1]["score"] > 0.5
    untrained = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, untrained).collect()} == {"und"}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) < 256 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns(documents):
    texts = [r["text"] for r in documents.select("text").collect()]
    texts += ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "+1 (2) 3.4-5 67890 4111 1111 1111 1111", "@@a.b c@d.e.",
              "4111-1111-1111-1111 +123456789 1.1.1.1@x.yz", "12 34 56", "++1 234 567 890 12", "x" * 3000 + "@" + "y" * 3000]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii.labelled(spark))


def test_field_learns_its_table(field):
    right = total = 0
    for line in pii.LABELLED.strip().split("\n"):
        shape, tags = pii._example(line)
        opens = np.arange(len(shape)) == 0
        right += int((pii.viterbi(field, shape, opens) == tags).sum())
        total += len(tags)
    assert right / total > 0.98


def test_viterbi_equals_enumeration(field):
    from itertools import product

    _, _, shape, opens = pii.shapes("call (415) 555-2671 now\nfrom 10.0.0.7\n\nto a@b.org,")
    found = pii.viterbi(field, shape, opens)
    first = np.flatnonzero(opens)
    for a, b in zip(first, [*first[1:], len(shape)]):
        def score(tags):
            total = field.start[tags[0]]
            for i, tag in enumerate(tags):
                total += field.word[shape[a + i], 1, tag] + (field.follow[tags[i - 1], tag] if i else 0)
                total += field.word[shape[a + i - 1], 0, tag] if i else 0
                total += field.word[shape[a + i + 1], 2, tag] if a + i + 1 < b else 0
            return total

        best = max(product(range(len(pii.TAGS)), repeat=b - a), key=score)
        assert abs(score(best) - score(tuple(found[a:b]))) < 1e-9


def test_personal_data(spark, field, odd_documents):
    texts = [
        (1, "mail jane@x.org or +1 (212) 555-0143 x", "k"),
        (2, None, "k"),
        (3, "call (415) 555-2671 today", "k"),
        (4, "nothing here but words and 2 numbers, version 3.", "k"),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in pii.personal_data(frame, field).collect()}
    assert (rows[1]["n_email"], rows[1]["n_phone"]) == (1, 1)
    listed = "email:5:15,phone:19:36"
    assert rows[1]["spans"] == listed
    assert rows[1]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert rows[2]["spans"] == rows[4]["spans"] == "" and rows[2]["n_ip"] == 0
    assert rows[3]["spans"] == "phone:5:19" and rows[3]["n_phone"] == 0 and rows[3]["n_added"] == 1
    assert pii.personal_data(odd_documents, field).count() == 12
    assert pii.personal_data(odd_documents.limit(0), field).count() == 0


def test_losses_equal_direct_sums(spark):
    s = lm_score.Settings(block=300)
    texts = {1: "the cat sat on the mat", 2: "the cat sat on the hat", 3: "a dog ran", 4: "a dog ran far away", 5: "", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    target = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    found = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs, target, s).collect()}
    encode = tokenizer(default_vocabulary()).ids
    ids = {d: np.frombuffer(encode(t), "<u4").tolist() for d, t in texts.items()}
    for doc in (1, 3, 4):
        for name, members in (("target_loss", {1, 2}), ("background_loss", {3, 4, 5, 6})):
            tokens, heads, pairs = Counter(), Counter(), Counter()
            for other in members - {doc}:
                before = [s.tokens - 1, *ids[other]]
                tokens.update(ids[other])
                heads.update(before[:-1] if ids[other] else [])
                pairs.update(zip(before, ids[other]))
            loss = 0.0
            for a, b in zip([s.tokens - 1, *ids[doc]], ids[doc]):
                p = s.bigram * pairs[a, b] / max(heads[a], 1) + s.unigram * tokens[b] / max(sum(tokens.values()), 1)
                loss -= math.log(p + (1 - s.bigram - s.unigram) / s.tokens)
            assert abs(found[doc][name] - loss / len(ids[doc])) < 1e-5
    assert found[5]["score"] is None and found[6]["n_tokens"] == 0
    assert found[1]["score"] < 0 < found[3]["score"]


def test_language_model_odd_rows(spark, odd_documents):
    nobody = spark.createDataFrame([], "doc_id long")
    rows = lm_score.cross_entropy_difference(odd_documents, nobody).collect()
    assert len(rows) == 12 and not any(r["in_target"] for r in rows)
    assert lm_score.cross_entropy_difference(odd_documents.limit(0), nobody).count() == 0
