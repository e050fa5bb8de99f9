"""Near copies of one text that are similar to few others: links by differences from a hub, against brute force."""

import random
from collections import Counter
from itertools import combinations

from touchline.llm.minhash import difference_keys, minhash_groups
from touchline.llm.shingles import shingle_set


def edited_sets(size, count, seed):
    """A base set and versions of it; some edits are shared by several versions."""
    r = random.Random(seed)
    sets = [set(range(size))]
    for _ in range(count):
        x, k = set(range(size)), r.randint(0, int(size * 0.15) + 2)
        edit = random.Random(r.randrange(12) if r.random() < 0.7 else r.random())
        x.difference_update(edit.sample(range(size), min(k, size // 2)))
        for _ in range(r.randint(0, k)):
            x.add(1000 + edit.randrange(40) if r.random() < 0.6 else r.randrange(10**6, 10**9))
        sets.append(x)
    return sets


def test_similar_sets_share_a_key_of_their_differences():
    compared = 0
    for percent in (80, 85):
        for seed, size in enumerate([20, 60, 145, 300] * 6):
            _, hub, *sets = edited_sets(size, 41, seed)  # versions are similar to each other, not all to the hub
            similar = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
            apart = [x ^ hub for x in sets]
            held = Counter(v for d in apart for v in d)
            keys = []
            for x, d in zip(sets, apart):
                order = [v for _, v in sorted((held[v], v) for v in d if held[v] > 1)]
                keys.append(set(difference_keys(len(x), len(hub), len(d), order, percent / 100)))
            for i, j in combinations(range(len(sets)), 2):
                if similar(sets[i], sets[j]) and not (similar(sets[i], hub) and similar(sets[j], hub)):
                    compared += 1
                    assert keys[i] & keys[j]
    assert compared > 3000


def test_crowded_group_equals_brute_force(spark):
    r = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(130):
        words = list(base)
        shared = random.Random(i % 45).sample(range(150), 3)  # some copies have their edits in common
        for j in shared:
            words[j] = f"edit{i % 45}"
        if i >= 45:
            words[r.randrange(150)] = f"own{i}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[60]), (200, None), (201, "")]
    found = minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    sets = [(i, shingle_set(t, 5)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in combinations(sets, 2):
        if x & y and 100 * len(x & y) >= 85 * len(x | y):
            low, high = sorted((top(i), top(j)))
            root[high] = low
    assert {row["doc_id"]: row["component_id"] for row in found} == {i: top(i) for i in root}
    assert 10 < len({top(i) for i in range(130)}) < 120
