"""Fingerprints: recovered differences against sets of paragraphs."""

import hashlib

from touchline.llm.fingerprints import document_fingerprints


def pieces(text):
    return {p for p in text.replace(". ", ".\n").split("\n") if p}


def wanted(rows):
    ordered = sorted(rows, key=lambda r: r[0])
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = []
        for other in (edited, after):
            a, b = pieces(text), pieces(other)
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        yield doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near


def test_equals_sets(documents):
    found = document_fingerprints(documents, group=23).collect()
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    exact = {x[0]: x[1:] for x in wanted(rows)}
    assert len(found) == len(rows)
    for r in found:
        chars, digest, edited, after = exact[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (chars, digest)
        assert abs(r["near_edited"] - edited) < 1e-12 and abs(r["near_next"] - after) < 1e-12
    texts = {}
    for r in found:
        text = dict(rows)[r["doc_id"]]
        assert texts.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_large_difference_is_retried(spark):
    rows = [(1, "\n".join(f"line {i}" for i in range(700))), (2, "\n".join(f"row {i}" for i in range(900))), (5000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in document_fingerprints(frame).collect()}
    exact = {x[0]: x[1:] for x in wanted(rows)}
    for doc, r in found.items():
        assert (r["edited_sha256"], r["near_edited"], r["near_next"]) == exact[doc][1:]


def test_odd_rows(spark, odd_documents):
    rows = document_fingerprints(odd_documents).collect()
    assert len(rows) == 12
    by_node = {r["doc_id"]: r for r in rows}
    assert by_node[2]["n_chars"] == 0 and by_node[2]["fingerprint"] == "" == by_node[3]["fingerprint"]
    assert by_node[2]["near_edited"] == 1.0
    assert by_node[9]["n_chars"] == len("naïve café — übergröße 漢字 😀\nsecond")
    assert all(0 <= r["near_next"] <= 1 for r in rows)
    assert document_fingerprints(odd_documents.limit(0)).count() == 0
    one = document_fingerprints(odd_documents.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
