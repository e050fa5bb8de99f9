"""Packing: token ids and scores of many documents at once."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer as Encoder

from touchline.llm.packing import STRONGEST, Index, _counted, _strongest
from touchline.llm.tokens import Tokenizer, default_vocabulary

ODD = [
    "", None, " ", "\n\n a  b\n", "tab\there x  y", "don't <|endoftext|> stop", "a\x1cb  \n c", "漢字 😀 é",
    " lead", "trail ", " ", "x", " y", "", None,
]


def test_ids_of_a_batch_are_those_of_each_text():
    encoder = Encoder.from_file(default_vocabulary())
    want = [[*encoder.encode(t or "", add_special_tokens=False).ids, 1] for t in ODD]
    texts, encode = pa.array(ODD), Tokenizer(default_vocabulary()).batch
    for start, end in [(0, len(ODD)), (3, 9), (2, 4), (0, 0), (1, 2), (4, 5)]:
        found = encode(texts[start:end], 1).to_pylist()
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == want[start:end]


def test_distinct_words_are_encoded_in_one_call(monkeypatch):
    """Before, each word that was not in the cache cost a call."""
    encode, calls = Tokenizer(default_vocabulary()), []
    encode["x"], found = b"", encode.ids(" y") and encode._joined
    monkeypatch.setattr(encode, "_joined", lambda text: calls.append(text) or found(text))
    words = [f" w{i}q{i * i}" for i in range(3000)]
    got = np.frombuffer(encode.batch(pa.array(["".join(words)] * 2), 1)[1].as_py(), "<u4")
    assert len(calls) == 1 and len(encode) < 5
    assert got.tolist() == [*Encoder.from_file(default_vocabulary()).encode("".join(words), add_special_tokens=False).ids, 1]


def test_terms_of_many_documents():
    draw = np.random.default_rng(5)
    ids = [draw.integers(0, 90_000 if i % 2 else 40, draw.integers(1, 200)) for i in range(70)]
    terms, tf, bounds = _counted(ids)
    idf = draw.random(90_000).round(1) + 0.1
    best = _strongest(ids, idf)
    for i, x in enumerate(ids):
        own, n = np.unique(x, return_counts=True)
        part = slice(bounds[i], bounds[i + 1])
        assert (terms[part] == own).all() and (tf[part] == n).all()
        weight = (idf[own] * n * 2.2 / (n + 1.2)).astype(np.float32)
        assert best[i][best[i] >= 0].tolist() == own[np.argsort(-weight, kind="stable")[:STRONGEST]].tolist()


def test_scores_are_bm25_for_frequent_and_rare_terms():
    draw = np.random.default_rng(6)
    ids = [np.append(draw.integers(0, 30, 12), draw.integers(30, 3000, 12)) for _ in range(100)]
    index, n, mean = Index(ids), len(ids), 24
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=3000)
    assert 0 < len(index.rows) < np.count_nonzero(df)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    for doc in range(0, n, 10):
        used = np.arange(n) == doc
        score = np.array([sum(idf[t] * (k := np.sum(x == t)) * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in np.unique(ids[doc])) for x in ids])
        found = index.neighbours(doc, used)
        assert set(found) == set(np.flatnonzero((score > 0) & ~used))
        assert (np.diff(score[found]) < 1e-4).all()
