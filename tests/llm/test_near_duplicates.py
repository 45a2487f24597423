import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import near_duplicates as nd


def brute(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def made_corpus(seed):
    """A star whose copies are near their centre but not near each other, chains, exact copies and unrelated texts."""
    rng, docs = random.Random(seed), []
    word = lambda: "w" + str(rng.randrange(5000))
    add = lambda words: docs.append((len(docs) * 3 + 1, " ".join(words)))
    centre = [word() for _ in range(400)]
    for _ in range(40):
        copy = list(centre)
        for _ in range(5):
            copy[rng.randrange(400)] = word()
        add(copy)
    add(centre)
    chain = [word() for _ in range(300)]
    for k in range(12):
        add(chain)
        chain = chain[6:] + [word() for _ in range(6)]
    for k in range(30):
        add([word() for _ in range(rng.randrange(1, 60))])
    for k in range(5):
        add(centre[:4])
    rng.shuffle(docs)
    return [(i, docs[i][1]) for i in range(len(docs))] + [(len(docs), ""), (len(docs) + 1, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    docs = made_corpus(seed)
    found = nd.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    expected, sizes = brute(docs)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[600:2600])
    s = nd.sketches([a, b, np.union1d(a, b), np.empty(0, np.uint64)])
    assert (np.maximum(s[0], s[1]) == s[2]).all()
    assert (s[3] == 0).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(nd.joint_similarity(s[:1], s[1:2], np.array([2000.0]), np.array([2000.0]))[0] - true) < 0.12


def test_parity_maps_never_differ_more_than_sets():
    rng = np.random.default_rng(7)
    for n in (1, 50, 700, 9000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for kept in (0, n // 2, n - n // 20):
            y = np.unique(np.concatenate([x[:kept], rng.integers(0, 2**63, n - kept, dtype=np.uint64)]))
            maps = [np.frombuffer(nd.parity_map(s), np.uint8) for s in (x, y)]
            assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(x, y))
    assert nd.parity_map(np.empty(0, np.uint64)) == bytes(nd.PARITY // 8)


def test_copies_that_nearly_miss_each_other(spark):
    rng = random.Random(3)
    word = lambda: "v" + str(rng.randrange(3000))
    centre, docs = [word() for _ in range(160)], []
    spare = [word() for _ in range(160)]
    for i in range(120):
        copy = list(centre)
        for at in rng.sample(range(160), i % 9):  # edits that copies share, so that no copy's elements are its own
            copy[at] = spare[at]
        docs.append((i, " ".join(copy)))
    found = nd.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(docs)[0]


def test_driver_documents_match_brute_force(spark):
    """Recall on the driver's table: every link of all pairs is there, and no other."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    components, sizes = brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    found = nd.near_duplicates(rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == components
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes


def test_keys_of_other_kinds_several_texts_and_nulls(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    rows = [("b", text(1), 1), ("b", text(2), 1), ("a", text(1) + " more", 1), ("c", text(2) + " more", 1), (None, text(3), 1), ("d", text(3) + " more", 1), (None, text(4), 1)]
    found = nd.near_duplicates(spark.createDataFrame(rows, "key string, text string, size int"), "key").collect()
    assert sorted((str(r["key"]), str(r["component_id"])) for r in found) == [("None", "None"), ("None", "d"), ("a", "a"), ("b", "a"), ("b", "b"), ("c", "b"), ("d", "d")]


def test_large_buckets_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(nd, "PART_ROWS", 7)
    docs = made_corpus(3)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df).collect()} == brute(docs)[0]
