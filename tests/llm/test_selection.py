"""Resampling, the positive-unlabelled classifier and the filter audit, against plain versions."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import filter_audit, pu_quality, resampling
from tidemark.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def plain_resample(docs, target, n, buckets, least, percent, seed):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in runs(t, n)[0]]
    found = [(i, t, of(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in of(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    rows = []
    for i, text, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), runs(text, n)[1] >= least))
    drawn = sorted((k for k, r in enumerate(rows) if r[4]), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: at + 1 for at, k in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(rows)), key=str)


def found_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_op11_against_a_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
    assert found_rows(queries()["op11_importance_resampling"](spark, DATA)) == plain_resample(docs, target, 1, 10_000, 20, 10, 2024)


@pytest.mark.parametrize(("n", "size"), [(1, 40), (3, 25), (2, 7)])
def test_chunks_carry_words_and_own_starts(spark, odd_documents, n, size):
    """Cut anywhere, texts have the runs and weights of whole ones; long rows that are equal stay two rows."""
    again = odd_documents.filter("doc_id = 7")
    docs = odd_documents.unionByName(again).unionByName(spark.createDataFrame([(None, "Ein Wort, zwei  Wörter; drei-vier 5 x" * 9), (12, "w" * 90 + " end")], "doc_id bigint, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("x x one two three",), (None,)], "text string")
    got = resampling.resample(docs, target, n=n, buckets=50, least_words=2, percent=40, seed=3, size=size)
    assert found_rows(got) == plain_resample(rows, ["x x one two three", None], n, 50, 2, 40, 3)


def test_resampling_of_nothing(spark, no_documents, odd_documents):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(no_documents, target).count() == 0
    assert resampling.resample(odd_documents, target).count() == odd_documents.count()


def plain_audit(docs, labels):
    """Every order applied step by step, document by document."""
    texts = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in texts:
        least[t] = min(least.get(t, i), i, key=lambda x: (x is None, x or 0))

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        again = i is not None and least[t] is not None and least[t] < i
        return {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t), again), strict=True) if bad}

    rows, out, total = [(p, fails(i, t), labels.get(i, (0, 0))) for i, t, p in texts], [], Counter()
    for part in {p for p, *_ in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                total[part, f] += len(gone)
                out.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2][0] for r in gone), sum(r[2][1] for r in gone)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_op13_against_a_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = {r["doc_id"]: (int(r["quality"] == 1), int(r["toxic"] == 1)) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    assert sorted(tuple(r) for r in queries()["op13_filter_audit"](spark, "/root/testdata/sf0.001").collect()) == plain_audit(docs, labels)
    assert "op13_filter_audit" in oracle_sql()


def test_audit_of_odd_rows(spark, odd_documents, no_documents):
    extra = [(None, "same text here again and again", "en"), (3, "one", None), (40, "one", "de"), (4, "one", "de"), (41, None, "en"), (42, "A#" * 5, None)]
    docs = odd_documents.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(4, 1, 1), (4, None, 0), (10, 1, None), (None, 1, 1), (41, 0, 1)], "doc_id bigint, quality int, toxic int")
    known = {4: (1, 1), 10: (1, 0), 41: (0, 1)}
    got = filter_audit.audit(filter_audit.cells(docs, labels))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], known)
    assert filter_audit.audit(filter_audit.cells(no_documents, labels)).count() == 0


def test_orders_differ_by_one_swap():
    seen = [(list(o), at) for o, at in filter_audit.adjacent_orders(5)]
    assert len({tuple(o) for o, _ in seen}) == 120
    for (a, _), (b, at) in itertools.pairwise(seen):
        assert [k for k in range(5) if a[k] != b[k]] == [at, at + 1] and a[at] == b[at + 1]


def auc(rows, label):
    good, bad = ([r["score"] for r in rows if r[label] == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_op12_held_out(spark):
    """On held-out labels; a constant answer finds no text of low quality."""
    found = queries()["op12_pu_quality"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad = [r for r in found if r["quality"] == 0]
    assert auc(found, "quality") > 0.98
    assert sum(r["predicted"] == 0 for r in bad) >= 0.7 * len(bad)
    assert sum(r["predicted"] == 1 for r in found if r["quality"] == 1) >= 0.97 * (len(found) - len(bad))


def test_class_prior_and_risk():
    """Two clouds: the prior is found within a few hundredths, and the risk's minimum tells them apart without a negative label."""
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        good = rng.random(4000) < share
        u = rng.normal(np.where(good, 2.0, -2.0)[:, None], 1.0, (4000, 2))
        p = rng.normal(2.0, 1.0, (2000, 2))
        x = np.concatenate([np.concatenate([p, u]), np.ones((6000, 1))], axis=1).astype(np.float32)
        positive = np.arange(6000) < 2000
        prior = pu_quality.class_prior(x, positive)
        assert abs(prior - share) < 0.05
        said = x[2000:] @ pu_quality.risk_fit(x, positive, prior, 300) > 0
        assert (said == good).mean() > 0.97


def test_pu_quality_odd_rows(odd_documents, no_documents, spark):
    texts = [("Some plain words, in a line. And then more of them.", 1)] * 8 + [("### *** %%% ### ***", 0)] * 4 + [("Some other words, in a line.", 0)] * 4
    model = pu_quality.fit(texts)
    found = pu_quality.score_column(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in found)
    same = [r["score"] for r in found if r["doc_id"] == 10]
    assert len(same) == 2 and same[0] == same[1]
    assert pu_quality.score_column(no_documents, model).count() == 0
    assert pu_quality.fit([("a", 0)]).prior == 1e-6 and pu_quality.fit([("a", 1)]).prior == 1 - 1e-6
    assert pu_quality.fit([]).score("", pu_quality.Words()) < 1e-5
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, 0), (4, 0, 1), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    sample = pu_quality.training_sample(odd_documents, labels).collect()
    assert sum(r["_mark"] for r in sample) == 1 and len(sample) == 10
    assert pu_quality.fit_sample(pu_quality.training_sample(no_documents, labels)).prior == 1e-6
