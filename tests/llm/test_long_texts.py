"""Texts and pages of a million characters and more end within seconds, and alignments are largest ones at any length."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import html_text, media, packing, secrets

ONE = 1_000_000


@pytest.mark.parametrize(
    "text",
    [
        "<a " + 'key="x" ' * (ONE // 8), "<a " + 'value="y" key=' * (ONE // 14), "<a>x" + " " * ONE, "<a>" * (ONE // 3), "a" * ONE + "=x", ("k" * 300 + ": ") * (ONE // 302), "password =" + " " * ONE + "Zx9!kQ2m4R", "=" * ONE,
        '"' * ONE, "'''" * (ONE // 3), "{" * ONE, "".join(f"n{k} = n{k + 1}\n" for k in range(80_000)), "x: |\n" + "  line\n" * (ONE // 7), "<" + "a-" * (ONE // 2), "token: " * (ONE // 7),
    ],
    ids=range(15),
)
def test_secrets_take_time_in_proportion(text):
    began = time.process_time()
    secrets.find_secrets(text)
    assert time.process_time() - began < 10


def test_no_name_or_blank_is_too_long():
    secret = "Zx9!kQ2m4Rw7"
    found = lambda text: [text[a:b] for k, a, b in secrets.find_secrets(text) if k == "lexed"]
    assert found("a_" * 150 + f"secret = '{secret}'") == [secret]
    assert found("db_password =" + " " * 500 + secret) == [secret]
    assert found("pass: hunter2hunter2") == ["hunter2hunter2"]
    assert found(f'<add value="{secret}" other="1" key="api_token"/>') == [secret]
    assert found(f"<add key='api_token' name=\"x\" value='{secret}'/>") == [secret]
    assert found(f"<db-password>  {secret} </db-password>") == [secret]


def test_sensitivity_reaches_all_names_that_a_name_is_made_of():
    text = "".join(f"n{k} = n{k + 1}\n" for k in range(300)) + "n300 = 'Zx9!kQ2m4Rw7'\nmaster_password = n0\n"
    assert [text[a:b] for a, b, _ in secrets.lexed_spans(text)] == ["Zx9!kQ2m4Rw7"]


def test_marks_of_files_are_looked_for_once():
    began = time.process_time()
    assert media.find_media(b"%PDF-" * (ONE // 5)) == []
    assert time.process_time() - began < 5
    one = b"%PDF-1.4 1 0 obj startxref 0 %%EOF"
    assert [(a, n) for a, n, _ in media.find_media(one + b"...." + one)] == [(0, len(one)), (len(one) + 4, len(one))]


def page(rows, head=""):
    return f"<html><body><h1>t</h1>{head}<table>{rows}</table></body></html>"


def long_page(p, rows, rng):
    return html_text.Tree(html_text.skeleton(html_text.parse(page("".join(f"<tr><td>{p} {k}</td><td>same</td></tr>" for k in range(rows) if rng.random() > 0.0005)))))


def test_long_lists_align_in_time():
    """30,000 like rows with cells, some rows gone and some new."""
    rng = random.Random(1)
    one, two = long_page(0, 30_000, rng), long_page(1, 30_000, rng)
    began = time.process_time()
    found = html_text.match(one, two)
    assert time.process_time() - began < 90
    assert len(found) > 89_000


def test_long_lists_align_in_memory_that_follows_them():
    rng, peaks = random.Random(2), []
    for rows in (700, 2_800):
        one, two = long_page(0, rows, rng), long_page(1, rows, rng)
        tracemalloc.start()
        html_text.match(one, two)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0]  # four times the rows; the full table would take sixteen times as much


def plain_weight(a, b):
    """The weight of a largest matching by the full table, at every pair."""
    memo = {}

    def of(x, y):
        if (x, y) not in memo:
            xs, ys = a.children[x], b.children[y]
            rows = [[0] * (len(ys) + 1)]
            for i in xs:
                row = [0]
                for k, j in enumerate(ys):
                    w = 2 + (a.text[i] == b.text[j] != 0) + of(i, j) if a.label[i] == b.label[j] else 0
                    row.append(max(row[-1], rows[-1][k + 1], rows[-1][k] + w if w else 0))
                rows.append(row)
            memo[x, y] = rows[-1][-1]
        return memo[x, y]

    return of(0, 0)


@pytest.mark.parametrize("seed", range(12))
def test_bands_give_a_largest_matching(seed, monkeypatch):
    """Lists beyond SHORT, of few or many kinds of children, shifted and shuffled; with tables so small that halves are taken."""
    rng = random.Random(seed)
    monkeypatch.setattr(html_text, "SHORT", 400)
    monkeypatch.setattr(html_text, "CELLS", rng.choice((64, 1 << 18)))
    monkeypatch.setattr(html_text, "FIRST_BAND", rng.choice((1, 3, 8)))
    kinds = ["p", "div", "section", "ul", "pre"][: rng.randrange(1, 6)]
    make = lambda n: [f"<{t}>{rng.choice('abcdef') if rng.random() < 0.7 else ''}{'<b>x</b>' * rng.randrange(3)}</{t}>" for t in rng.choices(kinds, k=n)]
    one = make(rng.randrange(30, 70))
    two = one[rng.randrange(20) :] + make(rng.randrange(30))
    if seed % 3 == 0:
        rng.shuffle(two)
    a, b = (html_text.Tree(html_text.skeleton(html_text.parse("<body>" + "".join(x) + "</body>"))) for x in (one, two))
    found = html_text.match(a, b)
    assert sum(2 + (a.text[x] == b.text[y] != 0) for x, y in found) == plain_weight(a, b)
    of = dict(found)
    for x, y in found:
        assert a.label[x] == b.label[y] and of.get(a.parent[x], 0) == b.parent[y]
    assert len(set(of.values())) == len(found)
    for x in {a.parent[x] for x in of}:
        placed = [of[c] for c in a.children[x] if c in of]
        assert placed == sorted(placed)


def test_reader_comments_in_running_text_go():
    said = html_text.extract('<article><p>The text.</p><p class="comment-body">Nice!</p><ul><li class="reply">Yes</li><li>kept</li></ul></article>')
    assert said == "The text.\n\nkept"


def test_bound_tells_lengths_that_cant_share():
    counts = np.zeros(2049, np.int64)
    counts[[1229, 820, 410]] = 50, 51, 3
    assert packing.lower_bound(counts, 2048) == 76
    rng = random.Random(2)
    for _ in range(60):
        capacity, sizes = 12, [rng.randrange(1, 13) for _ in range(rng.randrange(1, 9))]
        need = len(sizes)

        def place(k, rooms):
            nonlocal need
            if len(rooms) >= need:
                return
            if k == len(sizes):
                need = len(rooms)
                return
            for i, r in enumerate(rooms):
                if r >= sizes[k]:
                    place(k + 1, [*rooms[:i], r - sizes[k], *rooms[i + 1 :]])
            place(k + 1, [*rooms, capacity - sizes[k]])

        place(0, [])
        assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= need
