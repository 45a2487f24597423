"""Every operator on odd rows and on an empty table: a defined result for each row, and none for no rows."""

import pytest

from tidemark.llm import licenses, media, near_duplicates, packing, pii, quality, secrets, sentencepiece_fst, toxicity

MODEL = toxicity.fit([("you idiot", 1), ("a fine day for a walk", 0)])
OPERATORS = {
    "media": lambda d: media.digest(media.sniff(media.store_texts(d), "media", "declared_type", ("doc_id", "n_bytes")), ("doc_id", "n_bytes")),
    "toxicity": lambda d: toxicity.score_column(d, MODEL),
    "sentencepiece": lambda d: sentencepiece_fst.digest(d, sentencepiece_fst.model_path()),
    "secrets": secrets.scan,
    "licenses": licenses.scan,
    "pii": pii.scan,
    "quality": quality.judge,
    "near_duplicates": near_duplicates.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd_documents, no_documents):
    found = OPERATORS[name](odd_documents).collect()
    assert len(found) == odd_documents.count()
    last = [r for r in found if r["doc_id"] == 10]
    assert len(last) == 2 and last[0] == last[1]
    assert OPERATORS[name](no_documents).count() == 0


def test_packing_odd_rows(odd_documents, no_documents):
    found = packing.pack_documents(odd_documents).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(range(11))
    assert by_doc[0][0]["length"] == 1
    assert packing.pack_documents(no_documents).count() == 0


def test_stage_functions_keep_columns(odd_documents, no_documents):
    assert quality.keep(odd_documents).columns == odd_documents.columns
    assert secrets.redact_documents(odd_documents).columns == odd_documents.columns
    assert toxicity.keep_clean(odd_documents, MODEL).columns == odd_documents.columns
    assert quality.keep(no_documents).count() == secrets.redact_documents(no_documents).count() == toxicity.keep_clean(no_documents, MODEL).count() == 0


def test_memos_of_other_stages_are_emptied():
    """A worker goes from stage to stage: what one stage remembered goes once a task has added nothing to it, what is in use stays."""
    from tidemark.llm import common

    mine, other = common.Memo(len), common.Memo(len)
    other["abc"]
    common.empty_idle_memos()
    assert (mine["ab"], dict(other)) == (2, {"abc": 3})
    common.empty_idle_memos()
    assert (dict(mine), dict(other)) == ({"ab": 2}, {})
    mine["abcd"], other["a"]
    common.empty_idle_memos()
    assert (dict(mine), dict(other)) == ({"ab": 2, "abcd": 4}, {"a": 1})


def test_memos_go_with_their_stage(monkeypatch):
    """A task of another stage begins with empty memos, also where a memo has just grown."""
    from types import SimpleNamespace

    from tidemark.llm import common

    stage = SimpleNamespace(stageId=lambda: 1)
    monkeypatch.setattr(common.TaskContext, "get", lambda: stage)
    common.empty_idle_memos()
    memo = common.Memo(len)
    memo["abc"]
    common.empty_idle_memos()
    assert dict(memo) == {"abc": 3}
    memo["ab"]
    stage.stageId = lambda: 2
    common.empty_idle_memos()
    assert dict(memo) == {}


def test_the_toxicity_fit_needs_few_bytes_a_word(monkeypatch):
    import random
    import tracemalloc

    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "SOFT_EPOCHS", 1)
    rng, peaks = random.Random(1), []
    for n in (20, 120):
        rows = [(" ".join(f"{rng.getrandbits(80):x}" for _ in range(500)), k % 2) for k in range(n)]
        tracemalloc.start()
        toxicity.fit(iter(rows))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert (peaks[1] - peaks[0]) / (100 * 500) < 1_000  # each word has some 80 subwords
