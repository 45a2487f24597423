"""Every stage of the pipeline against a plain version, on the rows that its predecessor kept; and on odd rows and empty tables."""

import duckdb
import pytest
from test_near_duplicates import brute

import corpus_pipeline as p
from tidemark.llm import packing, quality, secrets, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    clean = p.reject_toxic(spark, docs, DATA).cache()
    sample = toxicity.training_sample(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    model = toxicity.Model.unpacked(toxicity.fit(sorted((r["_text"], r["_label"]) for r in sample)).packed())
    known = toxicity.Memo(model.word_score)
    scores = {i: model.score(t or "", known) for i, t in text_of.items()}
    assert ids(clean) == {i for i, s in scores.items() if s < 0.5}

    good = p.reject_low_quality(spark, clean, DATA).cache()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({quality.OP9_SQL})").fetchall() if k}
    assert ids(good) == ids(clean) & kept

    single = p.drop_near_duplicates(spark, good, DATA).cache()
    components = brute([(i, text_of[i]) for i in sorted(ids(good))], 80)[0]
    assert ids(single) == {i for i, c in components.items() if i == c}

    redacted = {r["doc_id"]: r["text"] for r in p.redact_secrets(spark, single, DATA).collect()}
    assert redacted == {i: secrets.redact(text_of[i], secrets.find_secrets(text_of[i])) if text_of[i] else text_of[i] for i in ids(single)}

    packed = p.pack(spark, p.redact_secrets(spark, single, DATA), DATA).collect()
    encode, room = packing.encoder(packing.vocabulary_path()).encode, {}
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert lengths == {i: len(encode(t or "")) // 4 + 1 for i, t in redacted.items()}
    assert max(room.values()) <= 2048 and len(room) == -(-sum(lengths.values()) // 2048) + packed[0]["over_bound"]


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_stages_on_odd_rows_and_none(spark, odd_documents, no_documents, name, stage):
    found = stage(spark, odd_documents, DATA)
    assert found.count() <= odd_documents.count() or name == "best_fit_packing"
    if name != "best_fit_packing":
        assert found.columns == odd_documents.columns
    assert stage(spark, no_documents, DATA).count() == 0
