"""Packing: an exact round trip of the token ids, and the windows' shape."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from touchline.llm.packing import Index, pack_documents
from touchline.llm.tokens import default_vocabulary, tokenizer


def reference_ids(text):
    encoder = Tokenizer.from_file(default_vocabulary())
    return encoder.encode(text or "", add_special_tokens=False).ids


def test_pieces_of_text_have_the_ids_of_the_whole(documents):
    texts = [r["text"] for r in documents.select("text").limit(120).collect()]
    texts += ["", " ", "\n\n a  b\n", "tab\there x  y", "don't <|endoftext|> stop", "a\x1cb  \n c", "漢字 😀 é"]
    encode = tokenizer(default_vocabulary()).ids
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference_ids(text)


def checked(rows, ids, window=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        place = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == place and r["length"] > 0 and r["doc_tokens"] == len(ids[doc])
            part = np.array(ids[doc][place : place + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            place += r["length"]
        assert place == len(ids[doc])
    for pieces in by_sequence.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= window
    return {s: sum(r["length"] for r in p) for s, p in by_sequence.items()}


def test_round_trip(documents):
    rows = pack_documents(documents, shard_docs=64).collect()
    ids = {r["doc_id"]: [*reference_ids(r["text"]), 1] for r in documents.collect()}
    sizes = checked(rows, ids)
    assert sum(size < 2048 for size in sizes.values()) <= -(-documents.count() // 64)


def test_neighbours_share_words():
    ids = [np.array(x) for x in ([1, 2, 3, 9], [7, 8, 9, 9], [1, 2, 3, 4], [5, 6, 7, 9], [9])]
    used = np.array([True, False, False, False, False])
    assert Index(ids, 32).neighbours(0, used)[0] == 2


def test_odd_rows(spark, odd_documents):
    rows = pack_documents(odd_documents).collect()
    assert sum(r["length"] for r in rows) == sum(
        len(reference_ids(r["text"])) + 1 for r in odd_documents.collect()
    )
    assert {r["doc_tokens"] for r in rows if r["doc_id"] == 2} == {1}
    assert pack_documents(odd_documents.limit(0)).count() == 0
