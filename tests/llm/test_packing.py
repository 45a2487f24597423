import itertools
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import packing


def fewest(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        rooms.append(capacity - items[i])
        go(i + 1, rooms)
        rooms.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_small_packings_are_optimal(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1, 31, rng.integers(1, 11)) if seed % 2 else rng.integers(4, 16, rng.integers(1, 11))
    plan = packing.complete_bins(np.bincount(items, minlength=31), 30)
    assert sorted(x for f, n in plan for x in f * n) == sorted(items.tolist())
    assert all(sum(f) <= 30 for f, _ in plan)
    assert sum(n for _, n in plan) == fewest(items.tolist(), 30)


def test_the_search_makes_the_result():
    """Lengths that fill 12 sequences without waste: best fit alone needs more for some, bin completion for none."""
    better = 0
    for seed in range(12):
        items = dealt(seed, 12, 100, 8, 45)
        counts = np.bincount(items, minlength=101)
        plain = sum(n for _, n in packing.best_fit(counts, 100))
        found = sum(n for _, n in packing.complete_bins(counts, 100))
        assert found == 12 <= plain
        better += plain > found
    assert better > 0


def test_large_packing_is_near_its_bound():
    items = np.random.default_rng(1).integers(1, 2049, 20_000)
    counts = np.bincount(items, minlength=2049)
    assert sum(n for _, n in packing.complete_bins(counts)) <= 1.002 * packing.lower_bound(counts, 2048)


def dealt(seed, bins, capacity, low, high):
    """Lengths that fill bins sequences without waste."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(bins):
        left = capacity
        while left:
            out.append(min(left, int(rng.integers(low, high + 1))))
            left -= out[-1]
    return out


@pytest.mark.parametrize("seed", [1, 3])
@pytest.mark.parametrize("bins, capacity, low, high", [(40, 100, 5, 45), (8, 2048, 20, 150), (60, 2048, 100, 900)])
def test_hundreds_of_short_and_mixed_pieces(seed, bins, capacity, low, high):
    items = dealt(seed, bins, capacity, low, high)
    plan = packing.complete_bins(np.bincount(items, minlength=capacity + 1), capacity)
    assert sorted(x for f, n in plan for x in f * n) == sorted(items)
    assert all(sum(f) <= capacity for f, _ in plan)
    assert sum(n for _, n in plan) == bins


@pytest.mark.parametrize("seed", range(20))
def test_fillings_are_all_maximal_ones_best_fit_first(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 12, 9), minlength=21).tolist()
    sizes = [s for s, n in enumerate(counts) if n]
    sets = itertools.product(*(range(counts[s] + 1) for s in sizes))
    room = 20
    wanted = set()
    for ns in sets:
        left = room - sum(s * n for s, n in zip(sizes, ns, strict=True))
        if left >= 0 and not any(n < counts[s] and s <= left for s, n in zip(sizes, ns, strict=True)):
            wanted.add(tuple(s for s, n in reversed(list(zip(sizes, ns, strict=True))) for _ in range(n)))
    found = list(packing.fillings(counts, room))
    assert set(found) == wanted and len(found) == len(wanted)
    assert [sum(f) for f in found] == sorted(map(sum, found), reverse=True)


def test_documents(spark):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["Hello, World! It's 12.5 o'clock", "", None, "word " * 5000, "naïve façade ÜBER straße", "漢字 and 🙂 <|endoftext|> don't", "a\x00b\x85c\xa0d e", "İstanbul é", "½ x² 3¾"]
    found = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    expected = {}
    for i, t in enumerate(texts):
        ids = full.encode(t or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[i, k] = (start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == expected
    assert {r["over_bound"] for r in found} == {0}
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_words_are_computed_once_whatever_marks_they_stand_with(monkeypatch):
    computed = []
    word = packing.Encoder._word
    monkeypatch.setattr(packing.Encoder, "_word", lambda self, w: computed.append(w) or word(self, w))
    encoder = packing.Encoder(packing.vocabulary_path())
    words = [f"{a}{b}{c}ing" for a, b, c in itertools.product(map("".join, itertools.product("abcdefghij", repeat=2)), "klmnopqrstuvwxyz", map("".join, itertools.product("aeiou", "bcdfghklmnprst")))]
    assert len(words) == len(set(words)) == 112_000
    plain = encoder.encode(" ".join(words))
    assert len(encoder.encode(", ".join(words))) == len(plain) + 4 * (len(words) - 1)
    assert sorted(computed) == sorted([*words, ","])


@pytest.mark.parametrize("seed", range(4))
def test_ids_of_odd_texts_are_the_librarys(seed):
    encoder, rng = packing.Encoder(packing.vocabulary_path()), np.random.default_rng(seed)
    parts = [chr(c) for c in range(0x180)] + ["'s", "'T", "'re", "'VE", "'m", "'ll", "'d", "'", "''s", "<|", "|>", " ", "\n", "the", "İs", "ŉ", "...", "$$$", "12", "Ω", "é", "e\u0301", "\u2028", "<|endoftext|>"]
    usual = [p for p in parts if packing.usual(p)]
    for k in range(300):
        text = "".join(rng.choice(usual if k % 3 else parts, rng.integers(1, 40)))
        ids = encoder.full.encode(text, add_special_tokens=False).ids
        assert packing.usual(text) == (not packing.UNUSUAL.search(text))
        assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "same words here", 0, 7, "x")] * 50, "doc_id bigint, text string, _id int, length int, sequence_id string")
    found = packing.pack_documents(df).collect()
    assert len(found) == 50 and len({(r["sequence_id"], r["offset"]) for r in found}) == 50
