"""Spelling variants against plain edit distances."""

import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import registry
from touchline.llm.spelling import BitSlices, _coded, count_words, near_words, typed, variants

SF_DIR = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def expected(n, times=10):
    """Neighbours from a dictionary of texts with one letter taken out or masked."""
    masks = {}
    for w in n:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            near[w] |= masks[w[:i], w[i + 1 :]]
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
        near[w].discard(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def words_frame(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=40, unique=True), st.text("abé", min_size=1, max_size=6))
def test_bit_slices_equal_edit_distance(words, query):
    codes, lengths, letters = _coded([query, *words])
    index = BitSlices(codes[1:], lengths[1:], letters)
    found = index.one_edit(codes[:1], len(query))
    bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little", count=len(words))[0]
    assert [bool(b) for b in bits] == [one_edit(query, w) for w in words]


def test_pairs_come_once_whatever_the_shards(spark):
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("ab"), size=rng.integers(2, 9))) for _ in range(260)}
    words |= {"abcdefgh" + c + "ijk" for c in "abcdefghijklmnop"} | {"x" * 300, "x" * 301, "y" + "x" * 299}
    frame = words_frame(spark, {w: 5 + len(w) for w in words})
    plain = {(a, b, 5 + len(b)) for a in words for b in words if one_edit(a, b)}
    for shard in (10_000, 7):
        rows = [tuple(r) for r in near_words(frame, shard).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == plain


def test_forms_lead_to_roots(spark):
    n = {"aaaaaaa": 20000, "aaaaaab": 1000, "aaaaabb": 60, "aaaabbb": 3, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "zzzzzzw": 49}
    rows = found(variants(words_frame(spark, n)))
    assert rows == expected(n)
    assert ("aaaabbb", "aaaaabb", "aaaaaaa", 3, 1, 60) in rows and ("zzzzzzz", "zzzzzzx", "zzzzzzx", 5, 3, 50) in rows


def test_words_of_odd_documents(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    counts = {r["word"]: r["n"] for r in count_words(odd_documents).collect()}
    assert counts == counted(rows) and "another" in counts
    assert found(variants(count_words(odd_documents))) == expected(counted(rows))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long, word string")
    assert found(variants(count_words(empty))) == set()


def test_letters_and_deletions():
    hit = next(i for i in range(1000) if zlib.crc32(f"{i}:letters".encode()) % 31 == 0)
    assert len(typed("letters", hit, 31)) == 6 and typed("letters", None, 1 << 40) == "letters"
    assert "ÀB÷×ÿa".translate({c: c + 32 for c in range(65, 91)}) == "Àb÷×ÿa"


def test_query_on_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert found(registry.op13_spelling_variants(spark, SF_DIR)) == expected(counted(rows))
