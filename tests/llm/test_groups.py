"""Components, links inside buckets, line dedup and MinHash groups against brute force."""

import random
from itertools import combinations

from touchline.llm.common import components, link_buckets
from touchline.llm.line_dedup import line_dedup
from touchline.llm.minhash import minhash_groups
from touchline.llm.shingles import shingle_set, words


def closure(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(170)]
    links += [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 580)] + [(7, 7)]
    nodes = {n for pair in links for n in pair if pair[0] != pair[1]}
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(nodes)
    assert {r["node"]: r["component"] for r in found} == closure(nodes, [p for p in links if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bucket_links_have_the_components_of_all_pairs(spark):
    random.seed(5)
    postings = [(k, random.randrange(60)) for k in range(12) for _ in range(random.randrange(1, 25))]
    postings = sorted(set(postings))
    close = lambda a, b: abs(a - b) % 7 in (0, 1)
    frame = spark.createDataFrame(postings, "key long, node long")
    found = link_buckets(frame, lambda pairs: pairs.filter("abs(a - b) % 7 IN (0, 1)"))
    by_key = {}
    for key, node in postings:
        by_key.setdefault(key, set()).add(node)
    pairs = [p for held in by_key.values() for p in combinations(sorted(held), 2) if close(*p)]
    links = [(r["a"], r["b"]) for r in found.collect()]
    assert set(links) <= set(pairs)
    nodes = {n for _, n in postings}
    assert closure(nodes, links) == closure(nodes, pairs)


def test_similar_and_repeated_lines(spark):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(900)]
    base = [" ".join(random.choice(vocabulary) for _ in range(90)) for _ in range(12)]
    edited = base[0].split()
    edited[40] = "changed"
    docs = [
        (1, "\n".join([base[0], base[1], "", base[2]])),
        (2, "\n".join([base[3], " " + base[1].upper() + " ", base[4]])),
        (3, "\n".join([" ".join(edited), base[5]])),
        (4, "\n".join([base[6], base[6]])),
        (5, "\n".join(base[7:])),
    ]
    found = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[1]["text"] == docs[0][1] and found[5]["text"] == docs[4][1]
    assert found[2]["text"] == "\n".join([base[3], base[4]])
    assert found[4]["text"] == base[6]
    assert (found[1]["n_lines"], found[2]["n_removed"], found[4]["n_removed"]) == (3, 1, 1)
    assert found[3]["text"] == base[5]  # the edited line goes


def test_simhash_candidates_are_complete(spark):
    """Lines within three bits share a key; unlike lines stay."""
    from pyspark.sql import functions as F

    from touchline.llm.line_dedup import _keys

    random.seed(7)
    rows = []
    for _ in range(300):
        sig = random.getrandbits(64)
        other = sig
        for bit in random.sample(range(64), 3):
            other ^= 1 << bit
        signed = [x - (1 << 64) if x >> 63 else x for x in (sig, other)]
        rows.append(tuple(signed))
    frame = spark.createDataFrame(rows, "s long, t long")
    assert frame.filter(~F.arrays_overlap(_keys(F.col("s")), _keys(F.col("t")))).count() == 0


def test_simhash_is_the_majority(spark):
    from pyspark.sql import functions as F

    from touchline.llm.line_dedup import _lines, _signatures

    text = " ".join(f"token{i}" for i in range(37))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    sig = _signatures(_lines(frame, "doc_id", "text")).first()["sig"]
    hashes = frame.select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).first()["h"]
    wanted = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))
    assert sig & ((1 << 64) - 1) == wanted


def test_line_dedup_odd_rows(spark, odd_documents):
    found = line_dedup(odd_documents)
    assert found.columns[:3] == ["doc_id", "key", "node"]
    rows = found.collect()
    assert len(rows) == 12
    texts = {(r["node"]): r["text"] for r in rows}
    assert texts[1] == "a line that is here\nanother line"
    assert texts[2] is None and texts[3] == "" and texts[4] == " \n\t"
    assert (texts[8], texts[9]) == ("word", "")
    assert line_dedup(odd_documents.limit(0)).count() == 0


def brute_groups(rows, percent, size=5):
    sets = [(i, shingle_set(t, size)) for i, t in rows if i is not None]
    links = []
    for (a, s), (b, t) in combinations(sets, 2):
        both = len(s & t)
        if both and 100 * both >= percent * (len(s) + len(t) - both):
            links.append((a, b))
    return closure({i for i, _ in sets}, links)


def test_minhash_equals_brute_force(spark, documents):
    for percent in (80, 85):
        found = minhash_groups(documents, percent).collect()
        rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
        assert {r["doc_id"]: r["component_id"] for r in found} == brute_groups(rows, percent)
        assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(shingle_set(t, 5)) for i, t in rows}
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_minhash_large_group_and_shared_passage(spark):
    """A group of near copies in a chain, and documents that share only a passage."""
    random.seed(8)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = [random.choice(vocabulary) for _ in range(400)]
    passage = [random.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        for j in random.sample(range(400), 4):
            copy[j] = f"edit{i}_{j}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 120):
        rows.append((i, " ".join([random.choice(vocabulary) for _ in range(60)] + passage)))
    chain = [random.choice(vocabulary) for _ in range(500)]
    for i in range(120, 135):
        rows.append((i, " ".join(chain[(i - 120) * 20 : (i - 120) * 20 + 220])))
    found = minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_groups(rows, 80)


def test_minhash_odd_rows(spark, odd_documents):
    rows = minhash_groups(odd_documents).collect()
    assert len(rows) == 12
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert found[2] == {(0, 2, True)} and found[3] == {(0, 3, True)} and found[4] == {(0, 4, True)}
    assert found[None] == {(1, None, True)}
    assert found[5] == {(2996, 5, True)} and found[6] == {(2997, 5, False)}
    assert found[8] == {(1, 7, False), (2, 7, False)}
    assert minhash_groups(odd_documents.limit(0)).count() == 0


def test_words():
    text = "A\tb\u00a0C\n\u00c9"
    assert words(text) == [b"a", "b\u00a0c".encode(), "\u00c9".encode()]
