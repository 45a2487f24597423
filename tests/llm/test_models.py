import random
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import sentencepiece_fst, toxicity
from tidemark.llm.queries import queries

DATA = "/root/testdata/sf0.01"


def test_transducer_equals_the_library():
    import sentencepiece

    path = sentencepiece_fst.model_path()
    machine, library = sentencepiece_fst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aé b  ▁ñ1234🙂\n\tx_-=()the ing中文\x00") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in [*texts, "", " ", "  a", "if x:\n        return 10000000  # comment", "hahahahaha lalala", "================"]:
        ids = np.frombuffer(machine.encode(text), "<i4")
        assert ids.tolist() == library.encode(text)
        assert machine.decode(ids) == library.decode(ids.tolist())


def test_all_texts_as_the_library_encodes_them(spark):
    import sentencepiece

    path = sentencepiece_fst.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {r["doc_id"]: r["ids"] for r in sentencepiece_fst.encode(docs, path).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert found[r["doc_id"]] == library.encode(r["text"] or "")


def test_pair_acceptor_equals_merging():
    machine = sentencepiece_fst.Transducer(sentencepiece_fst.model_path())
    rng, ids = random.Random(9), list(machine.pieces.ids.values())
    for _ in range(20_000):
        x, y = rng.choice(ids), rng.choice(ids)
        a, b = machine.pieces.text[x], machine.pieces.text[y]
        assert machine.accepts(x, y) == (sentencepiece_fst.merge(a + b, machine.accepts.cost)[0] == [a, b])


def message(*parts):
    """A serialized message of (field, value) pairs: numbers, single-precision numbers, bytes."""

    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    out = b""
    for field, value in parts:
        if isinstance(value, float):
            out += number(field << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += number(field << 3) + number(value)
        else:
            out += number(field << 3 | 2) + number(len(value)) + value
    return out


@pytest.fixture
def scored_model(tmp_path):
    """A small model whose pieces have scores of their own and no merge order: the path of least weight decides."""
    rng, pieces = random.Random(6), {}
    for c in "abcde\u00e9 ":
        pieces[c.replace(" ", "\u2581")] = -rng.uniform(4, 12)
    while len(pieces) < 400:
        piece = rng.choice(["", "\u2581"]) + "".join(rng.choice("abcde\u00e9") for _ in range(rng.randrange(2, 7)))
        pieces[piece] = -rng.uniform(2, 14) - len(piece)
    rows = [message((1, b"<unk>"), (2, 0.0), (3, 2))] + [message((1, f"<0x{k:02X}>".encode()), (2, 0.0), (3, 6)) for k in range(256)]
    rows += [message((1, t.encode()), (2, float(v)), (3, 1)) for t, v in pieces.items()]
    model = b"".join(message((1, r)) for r in rows) + message((2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    (tmp_path / "scored.model").write_bytes(model)
    return str(tmp_path / "scored.model")


def test_least_weight_path_equals_the_library(scored_model):
    import sentencepiece

    machine, library = sentencepiece_fst.Transducer(scored_model), sentencepiece.SentencePieceProcessor(model_file=scored_model)
    assert not machine.pieces.merged
    rng, lengths = random.Random(7), set()
    for _ in range(600):
        text = "".join(rng.choice("abcde\u00e9  abcdez\u6f22\U0001f642") for _ in range(rng.randrange(40)))
        ids = np.frombuffer(machine.encode(text), "<i4")
        assert ids.tolist() == library.encode(text), text
        assert machine.decode(ids) == library.decode(ids.tolist())
        lengths |= {len(machine.pieces.text[k]) for k in ids}
    assert len(lengths) > 5  # pieces of all lengths were met


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_normaliser_is_compiled_from_the_model(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(x for k, x in sentencepiece_fst.fields(library.serialized_model_proto()) if k == 3)
    machine, rng = sentencepiece_fst.Normaliser(spec), random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab c  \u00e9\u00df\ufb01\u2460\u212bA\u030a\uac00\u304b\u3099\uff76\uff9e\t") for _ in range(20))
        assert machine(text) == library.normalize(text)


def test_misspellings_share_subwords():
    rng = random.Random(1)
    plain = "the walk was long and fine with sun over hills near water".split()
    texts, labels = [], []
    for k in range(200):
        words = rng.choices(plain, k=40)
        if k % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron", "idiots", "morons"])
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(zip(texts, labels, strict=True))
    known = toxicity.Memo(model.word_score)
    long = "the walk was long " * 200
    assert model.score(long + "idiots", known) > 0.5 > model.score(long, known)
    # Never seen: words that share n-grams with seen ones lean their way, and a text with one scores far above a clean one.
    for unseen in ("idiotic", "iidiot", "moronic"):
        assert model.word_score(unseen).real > 0 > model.word_score("walk").real
        assert model.score(long + unseen, known) > 20 * model.score(long, known)
    assert 0 <= model.score("", known) < 0.5


def test_single_class_and_no_labels():
    assert toxicity.fit([]).score("x", {"x": 0.0}) < 0.01
    assert toxicity.fit([("a", 0)]).word_score("a") == 0.0


def test_held_out_recall_and_f1(spark):
    """A constant answer has recall 0 here. Every third labelled document with abuse has no word that any other text shares, so recall has a ceiling."""
    found = queries()["op4_toxicity"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    rows = found.filter("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] == 1 for r in rows)
    said, toxic = sum(r["predicted"] for r in rows), sum(r["toxic"] for r in rows)
    assert hit >= 0.6 * toxic and 2 * hit >= 0.7 * (said + toxic)


def test_model_survives_packing():
    model = toxicity.fit([("you idiot", 1), ("a fine day for a walk", 0)])
    again = toxicity.Model.unpacked(model.packed())
    known, known_again = toxicity.Memo(model.word_score), toxicity.Memo(again.word_score)
    assert abs(model.score("you idiot", known) - again.score("you idiot", known_again)) < 1e-2


@pytest.mark.parametrize("name", ["op2_html_extraction", "op9_quality_rules"])
def test_queries_cover_their_tables(spark, name):
    table = "pages" if name == "op2_html_extraction" else "documents"
    assert queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = p.run(spark, DATA)
    assert set(rows.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert 0 < rows.select("doc_id").distinct().count() < docs.count()
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "secret_scans", "best_fit_packing"]


def plain_probability(model, text):
    """The softmax over both bags, vector by vector."""
    words = toxicity.words_of(text)
    logits = model.bias.astype(np.float64).copy()
    if words:
        vectors = [np.mean([model.vectors[k] for k in toxicity.subwords(w)], axis=0, dtype=np.float64) for w in words]
        near, far = model.softmax[: toxicity.WIDTH].astype(np.float64), model.softmax[toxicity.WIDTH :].astype(np.float64)
        n, size = len(words), toxicity.WINDOW
        starts = sorted({*range(0, max(n - size, 0) + 1, toxicity.STRIDE), max(n - size, 0)})
        worst = max((np.mean(vectors[a : a + size], axis=0) @ near for a in starts), key=lambda z: z[1] - z[0])
        logits += worst + np.mean(vectors, axis=0) @ far
    e = np.exp(logits - logits.max())
    return e[1] / e.sum()


def test_op4_scores_equal_a_plain_softmax(spark):
    data = "/root/testdata/sf0.001"
    model = toxicity.fit_on(spark, data)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries()["op4_toxicity"](spark, data).collect():
        plain = plain_probability(model, texts[r["doc_id"]])
        assert r["score"] == pytest.approx(plain, abs=1e-5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_training_descends_on_the_plain_loss():
    """Fewer epochs are worse on the loss that a plain softmax has, and the gradient of a bias vanishes where training ends."""
    rng, rows = random.Random(5), []
    for k in range(120):
        words = rng.choices("walk sun river hill stone leaf road light".split(), k=30)
        if k % 3 == 0:
            words[rng.randrange(30)] = rng.choice(("idiot", "moron"))
        rows.append((" ".join(words), int(k % 3 == 0)))

    def loss(epochs):
        before, toxicity.EPOCHS = toxicity.EPOCHS, epochs
        try:
            model = toxicity.fit(rows)
        finally:
            toxicity.EPOCHS = before
        return -np.mean([np.log(p if y else 1 - p) for t, y in rows for p in [plain_probability(model, t)]])

    few, more, all_of_them = loss(2), loss(15), loss(toxicity.EPOCHS)
    assert few > more > all_of_them and all_of_them < 0.05
