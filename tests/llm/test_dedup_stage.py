"""The stage of near copies against brute force."""

import random

from test_near_duplicates import brute

import corpus_pipeline as p

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(docs):
    return [(i, t, "en", None, None if t is None else len(t)) for i, t in docs]


def test_pairs_between_80_and_85_per_cent(spark):
    rng, docs = random.Random(8), []
    for k in range(40):
        words = [f"p{k}w{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        copy = list(words)
        for at in (20, 60, 100, 140)[: 4 if k % 2 else 2]:
            copy[at] += "x"  # 5 shingles each: 180 of 220 (0.82) or 190 of 210 (0.90) in common
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in p.drop_near_duplicates(spark, spark.createDataFrame(rows_of(docs), SCHEMA), "").collect()}
    components = brute(docs, 80)[0]
    assert kept == {i for i, c in components.items() if i == c} == set(range(0, 80, 2))


def test_odd_rows_stay(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(50))
    docs = [(None, text(1)), (None, text(2)), (1, text(3)), (1, text(4)), (2, text(5)), (3, text(5)), (None, text(5)), (4, ""), (5, None), (None, ""), (6, text(4) + " more")]
    found = p.drop_near_duplicates(spark, spark.createDataFrame(rows_of(docs), SCHEMA), "").collect()
    wanted = [(None, text(1)), (None, text(2)), (1, text(3)), (1, text(4)), (2, text(5)), (4, ""), (5, None), (None, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(wanted, key=str)
