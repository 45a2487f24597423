"""Secrets, licenses, PII, quality, media and HTML against brute-force versions of their base rules, and against cases of their own."""

import hashlib
import io
import random
import re
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest

from tidemark.llm import html_text, licenses, media, pii, quality, secrets
from tidemark.llm.queries import queries

# --- secrets


def plain_secret_spans(text):
    spans = []
    for kind, pattern, fine in (
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        spans += [(kind, *m.span()) for m in re.finditer(pattern, text) if fine(m)]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@pytest.mark.parametrize("seed", range(40))
def test_base_secrets(seed):
    rng = random.Random(seed)
    parts = ["password", "Token", "api_key", "apikey", "secret", "ſecret", " = ", ":", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "zz", " ", "\n", "é", "abc=", "token:token:abcdefghi"]
    text = "".join(rng.choice(parts) for _ in range(80))
    assert secrets.base_spans(text) == plain_secret_spans(text)


def test_lexed_secrets():
    lexed = lambda t: [t[a:b] for k, a, b in secrets.find_secrets(t) if k == "lexed"]
    v = "aB3dE5fG7hJ9kL2m"
    for text in (
        f'client_secret = "{v}"', f'x = "{v}"\ndb_password = x', f'{{"awsSecretKey": "{v}"}}', f'c["client_secret"] = "{v}"', f'secret_key: str = "{v}"', f"<db_password>{v}</db_password>",
        f'<add key="auth_token" value="{v}"/>', f"don't set auth_token='{v}', it isn't safe", f"# api.secret={v}", f"export DB_PASSWD={v}", f"Authorization: Bearer {v}", f"a := {v}\nmy_secret := a",
        f'db_password = x\nx = "{v}"', f'client_secret = a\na = b\nb = c\nc = "{v}"', f'url = "{v}"\nauth_token = "prefix-${{url}}"', f"private_key: |\n  {v}\nother: 3",
    ):
        assert lexed(text) == [v], text
    assert lexed(f'secret_key = "{v[:8]}" + "{v[8:]}"') == lexed(f'secret_key = (\n  "{v[:8]}"\n  "{v[8:]}"\n)') == [v[:8], v[8:]]
    assert lexed('secret = "a\\"B3dE5fG7h"') == ['a\\"B3dE5fG7h']
    assert lexed(f'password = "changeme"\ntitle = "{v}"\na = b\nb = a') == lexed("the secret: he went home and was happy") == lexed("password:\n  - x\n") == []


def test_the_lexer_adds_what_patterns_miss():
    """No base pattern matches any of these: without the lexer there is no span."""
    for text in ("db_pwd = 'Zx9+kQ2w7Lm4'", 'auth = x\nx = "Zx9+kQ2w7Lm4"\nprivate_key = x', "<passphrase>Zx9+kQ2w7Lm4</passphrase>"):
        assert not secrets.base_spans(text) and [k for k, *_ in secrets.find_secrets(text)] == ["lexed"], text


def test_long_texts_are_lexed_in_proportion():
    import time

    for unit in ('a = "', "x: ", "password = '", '"k": "v", ', "<a>", "k: |\n  ", "a['b'] = ", "a = (\n", '\\"'):
        began = time.time()
        secrets.find_secrets(unit * (1_000_000 // len(unit)))
        assert time.time() - began < 60, unit


def test_redaction():
    text = 'a token = "0123456789abcdef0123456789abcdef" b'
    out = secrets.redact(text, secrets.find_secrets(text))
    assert "0123456789" not in out and out.startswith("a ") and out.endswith('" b')


# --- licenses


def plain_license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [i for p in ("cc by", "general public license", "all rights reserved") for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


@pytest.mark.parametrize("seed", range(30))
def test_base_licenses(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["CC", "by", "BY", " ", "-", "\n", "general", "public", "license", "All rights", "reserved", "é", "1", "lesser "]) + rng.choice(["", " "]) for _ in range(100))
    n, places = plain_license_places(text)
    found = licenses.find_licenses(text)
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (n, len(places), min(places, default=None), max(places, default=None))


def test_expressions():
    value = lambda t: licenses.evaluate(licenses.read_expression(t, 0))
    assert value("MIT OR Apache-2.0 AND BSD-3-Clause").labels() == {"apache|bsd|mit"}
    assert value("(MIT OR Apache-2.0) AND BSD-3-Clause").labels() == {"bsd", "apache|mit"}
    assert value("MIT AND GPL-2.0").labels() == {"gpl", "mit"} and value("MIT OR GPL-2.0").labels() == {"gpl|mit"}
    assert value("MIT AND GPL-2.0").sure == 1.0 > value("MIT OR GPL-2.0").sure > value("MIT OR Own-1.0 AND Own-2.0").sure * 0.99
    assert value("GPL-2.0-only WITH Classpath-exception-2.0").labels() == {"gpl-with-classpath-exception-2.0"}
    assert value("MIT AND MIT OR MIT").labels() == {"mit"} and value("MIT OR MIT").sure == 1.0
    assert value("MIT OR").sure < 1 and value("(MIT").sure < 1


def test_the_evaluated_expression_makes_labels_and_score():
    found = lambda t: (licenses.find_licenses(f"// SPDX-License-Identifier: {t}\nThe rest")["labels"], licenses.find_licenses(f"x License-Expression: {t}.")["score"])
    assert found("MIT OR Apache-2.0") == ("apache|mit", 0.9)
    assert found("MIT AND Apache-2.0") == ("apache,mit", 1.0)
    assert found("Apache-2.0 WITH LLVM-exception OR MIT")[0] == "apache-with-llvm-exception|mit"
    assert licenses.find_licenses("SPDX-License-Identifier: MIT. And so on")["labels"] == "mit"


def test_long_license_texts_take_time_in_proportion():
    import time

    for unit in ("cc by ", "spdx-license-identifier: a ", "license-identifier: (", "general public license "):
        began = time.time()
        licenses.find_licenses(unit * (1_000_000 // len(unit)))
        assert time.time() - began < 60, unit


# --- PII


def plain_pii_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    spans = []
    for kind, pattern, fine in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
    ):
        spans += [(kind, *m.span()) for m in re.finditer(pattern, text) if fine(m)]
    return spans


@pytest.mark.parametrize("seed", range(60))
def test_base_pii(seed):
    rng = random.Random(seed)
    parts = ["a@b.co", "@", "x.y", ".", "+", "-", " ", "4111 1111 1111 1111", "+1 (555) 010-9999", "192.168.0.1", "256.1.1.1", "000.0.0.0.", "12", "7", "(", ")", "é", "\n", "٣"]
    text = "".join(rng.choice(parts) for _ in range(60))
    assert pii.base_spans(text) == plain_pii_spans(text)


def test_field():
    sentences, field = pii.labelled_sentences(), pii.trained_field()
    right = [field.decode(x, np.array([0]), np.array([len(x)])).tolist() == y for x, y in sentences]
    assert sum(right) >= 0.98 * len(right)
    text = "Please call (415) 555-2671 today. SSN: 321-45-9876"
    assert [(k, text[a:b]) for k, a, b in pii.find_pii([text])[0]] == [("crf_phone", "(415) 555-2671"), ("crf_ssn", "321-45-9876")]
    assert pii.find_pii([None, "", "In 1984 there were 12 of them"]) == [[], [], []]


def test_the_field_finds_kinds_that_no_pattern_knows():
    """None of these has a base span: without the field there is nothing."""
    cases = {
        "My name is Clara Novak and I live at 99 Birch Street, Dover.": [("crf_name", "Clara Novak"), ("crf_address", "99 Birch Street, Dover")],
        "DOB: 11/12/1983": [("crf_birth", "11/12/1983")], "passport number: K9928371": [("crf_document", "K9928371")], "Dear Mr. Taylor, we met in May.": [("crf_name", "Mr. Taylor")],
        "x\n" * 3000 + "Patient: Nora Quist, room 9": [("crf_name", "Nora Quist")], "The Big House stood on Elm Street since 1900.": [],
    }
    for text, wanted in cases.items():
        assert pii.base_spans(text) == [] and [(k, text[a:b]) for k, a, b in pii.find_pii([text])[0]] == wanted, text[-60:]


def brute_labels(field, shapes):
    """Viterbi by plain loops over one line."""
    e = field.unary[pii.features(pii.padded_lines(shapes, np.array([0]), np.array([len(shapes)])))[0]].sum(1)
    best, back = e[0] + field.steps[0], []
    for row in e[1:]:
        via = [[best[x] + field.steps[x, y] for x in range(len(best))] for y in range(len(best))]
        back.append([int(np.argmax(v)) for v in via])
        best = np.array([max(v) for v in via]) + row
    labels = [int(np.argmax(best))]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def test_decoding_in_batches_equals_line_by_line():
    rng, field = random.Random(7), pii.trained_field()
    text = "\n".join(" ".join(rng.choice(["name", "is", "Anna", "Lee", "12", "Oak", "Street", ":", "dear", "the", "1984"]) for _ in range(rng.randrange(0, 40))) for _ in range(60))
    tokens = pii.Tokens(text)
    labels = field.decode(tokens.shapes, tokens.first, tokens.lengths)
    for first, n in zip(tokens.first, tokens.lengths, strict=True):
        assert labels[first : first + n].tolist() == brute_labels(field, tokens.shapes[first : first + n])


def test_tokens_left_undecoded_are_o_for_any_field():
    """Fields with random weights, strong and weak steps: what the decoder skips is O in the plain version too, and some but not all is skipped."""
    rng = np.random.default_rng(3)
    text = "\n".join(" ".join(rng.choice(["name", "Anna", "12", "Oak", ":", "the", "x"], rng.integers(1, 30))) for _ in range(40))
    tokens = pii.Tokens(text)
    for strength in (0.1, 1.0, 4.0):
        field = pii.Field(rng.normal(0, 1, (pii.FEATURES, len(pii.LABELS))).astype(np.float32), rng.normal(0, strength, (len(pii.LABELS),) * 2).astype(np.float32))
        field.unary[:, 0] += 0.6
        doubt = field.undecided(field.emissions(tokens.shapes, tokens.first, tokens.lengths))
        labels = field.decode(tokens.shapes, tokens.first, tokens.lengths)
        for first, n in zip(tokens.first, tokens.lengths, strict=True):
            assert labels[first : first + n].tolist() == brute_labels(field, tokens.shapes[first : first + n])
        assert strength > 1 or 0 < doubt.sum() < len(doubt)


def test_texts_read_in_groups_equal_texts_read_alone(monkeypatch):
    texts = ["Dear Mr. Taylor, hello.", "", None, "DOB: 11/12/1983\n" * 20, "x@y.org", "lives at 99 Birch Street, Dover now"] * 3
    alone = [pii.find_pii([t])[0] for t in texts]
    for bound in (1, 30, 400):
        monkeypatch.setattr(pii, "CHARACTERS_TOGETHER", bound)
        assert pii.find_pii(texts) == alone


def test_long_texts_are_read_whole():
    import time

    for unit in ("12 ", "word ", "a@", "1\n", "Mr. Lee "):
        began = time.time()
        pii.find_pii([unit * (1_000_000 // len(unit))])
        assert time.time() - began < 120, unit


# --- quality


def plain_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    repeat = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def test_quality_measures(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", "cc", "#", "é", "\u00a0", "\x1c"]) + rng.choice([" ", "\n", "\t", "  ", ""]) for _ in range(n)) for n in (0, 3, 30, 90, 200)]
    texts += ["a b c d e " * 3, "x y z\nx y z\n \n \n", "one two three four five one two three four five six"]
    rows = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_quality(t), t
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_quality_needs_no_python(spark):
    plan = quality.keep(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- media


def test_round_trip():
    for text in ("", "a", "é" * 32, "x" * 1000):
        payload = media.to_payload(text)
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
        stored = media.to_wav(payload)
        assert media.wav_samples(stored) == payload
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert media.find_media(stored)[0] == (0, len(stored), "audio/wav")


def test_carving():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(9) + b"\x02\x02\x4c\x01\x00\x3b"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    gz = zlib.compressobj(wbits=31)
    files = [(png, "image/png"), (gif, "image/gif"), (packed.getvalue(), "application/zip"), (gz.compress(b"abc") + gz.flush(), "application/gzip"), (media.to_wav(b"12345678"), "audio/wav")]
    blob, expected = b"junk BM \x89PNG broken", []
    for data, kind in files:
        expected.append((len(blob), len(data), kind))
        blob += data + b" between "
    assert media.find_media(blob) == expected


def test_sniff_corrects_types(spark):
    df = spark.createDataFrame([(1, bytearray(media.to_wav(b"abcd" * 16)), "image/png"), (2, bytearray(b"nothing"), None), (3, None, "text/plain")], "k int, media binary, said string")
    rows = {r["k"]: r for r in media.sniff(df, "media", "said", ("k",)).collect()}
    assert (rows[1]["media_type"], rows[1]["corrected"]) == ("audio/wav", True)
    assert (rows[2]["media_type"], rows[2]["corrected"]) == (media.UNKNOWN, False)
    assert rows[3]["media_type"] == media.UNKNOWN


def test_op1_digests(spark):
    text = "hello é"
    row = media.digest(media.sniff(media.store_texts(spark.createDataFrame([(7, text)], "doc_id bigint, text string")), "media", "declared_type", ("doc_id", "n_bytes")), ("doc_id", "n_bytes")).first()
    payload = text.encode().ljust(64, b"\0")
    assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (8, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))


def plain_media(text):
    """The whole row but for what is embedded, by the standard library's writer and reader of sounds."""
    payload = (text or "").encode()
    n, payload = len(payload), payload + b"\0" * (-len(payload) % 64 or (64 if not payload else 0))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(media.SAMPLE_RATE)
        w.writeframes(payload)
    with wave.open(io.BytesIO(out.getvalue())) as r:
        assert r.readframes(r.getnframes()) == payload
    feature = f"audio/wav;rate={media.SAMPLE_RATE};bits=8;samples={len(payload)};zeros={payload.count(0)};corrected=1;embedded="
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest(), feature


def test_op1_rows_against_a_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    found = queries()["op1_media_columns"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs)
    for r in found:
        *row, feature = plain_media(docs[r["doc_id"]])
        assert [r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")] == row and r["feature"].startswith(feature)


# --- HTML


def test_extraction():
    page = """<html><head><title>t</title><script>"</p>"</script></head><body><div id="cookie-notice">We use cookies</div><header>Site</header><div class="menu"><a href=x>a</a></div>
    <div class="post-content"><h1>T &amp; U</h1><p>One<br>two &nbsp; three<p>Four <i>five</i>six<ul><li>x<li>y</ul><form>Search <input></form></div><div class="comments"><p>nice!</p></div><footer>f</footer></body></html>"""
    assert html_text.extract(page) == "T & U\n\nOne two three\n\nFour fivesix\n\nx\n\ny"
    assert html_text.extract(None) == html_text.extract("") == ""
    assert html_text.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def brute_match(a, b, x=0, y=0):
    """The weight of a best ordered matching of the children of x and y, by plain recursion."""
    def pair(i, j):
        return None if a.label[i] != b.label[j] else 2 + int(a.text[i] == b.text[j] and a.text[i] != 0) + brute_match(a, b, i, j)

    def best(xs, ys):
        if not xs or not ys:
            return 0
        w = pair(xs[0], ys[0])
        return max(best(xs[1:], ys), best(xs, ys[1:]), -1 if w is None else w + best(xs[1:], ys[1:]))

    return best(a.children[x], b.children[y])


@pytest.mark.parametrize("seed", range(20))
def test_tree_matching(seed):
    rng = random.Random(seed)

    def made(depth=0):
        return "".join(f"<{t}>{rng.choice(['', 'u', 'v'])}{made(depth + 1) if depth < 2 else ''}</{t}>" for t in rng.choices(["div", "section", "b"], k=rng.randrange(4)))

    a, b = (html_text.Tree(html_text.skeleton(html_text.parse(made()))) for _ in range(2))
    pairs = html_text.match(a, b)
    assert sum(2 + int(a.text[x] == b.text[y] and a.text[x] != 0) for x, y in pairs) == brute_match(a, b)


def test_templates(spark):
    body = lambda k: f"<body><div class='top'>Always the same</div><div class='x'><p>{('Story %d ' % k) * 30}</p><p>{('More %d ' % k) * 30}</p><p>Read our paper</p></div></body>"
    rows = [(k, "http://h.example/" + str(k), body(k)) for k in range(5)] + [(9, None, body(9)), (10, "http://other.example/", None), (4, "http://h.example/4", body(4))]
    found = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 8 and texts[10] == ""
    assert texts[2] == ("Story 2 " * 30).strip() + "\n\n" + ("More 2 " * 30).strip()
    assert "Read our paper" in texts[9]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def unmarked_page(rng, k):
    """A page whose elements say nothing by tag or name: the parts differ in what the host's pages have in common only. And its main text."""
    title, paragraphs = prose(rng, 5), [prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(2, 9))]
    links = "".join(f"<div><a href='/{k}{j}'>{prose(rng, 2)}</a></div>" for j in range(rng.randrange(3, 7)))
    advert = prose(rng, 8)
    page = f"<body><div class='k1'>Daily Gazette</div><div class='k2'>{links}</div><div class='k3'>{advert}</div><div class='k4'><h2>{title}</h2>" + "".join(f"<p>{x}</p>" for x in paragraphs[:2])
    page += "<div class='k5'>Read our paper every day</div>" + "".join(f"<p>{x}</p>" for x in paragraphs[2:]) + "</div><div class='k6'>Printed in town by the river</div></body>"
    return page, "\n\n".join([title, *paragraphs])


def test_the_wrapper_makes_the_result(spark):
    rng = random.Random(5)
    made = [unmarked_page(rng, k) for k in range(30)]
    rows = [(k, f"http://h.example/{k}", page) for k, (page, _) in enumerate(made)]
    found = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: text for k, (_, text) in enumerate(made)}
    # Without alignment not one of these pages is read rightly.
    assert all(html_text.extract(page) != text for page, text in made)


def test_every_article_and_running_text_by_any_name():
    page = "<body><nav>a</nav><article><p class='social-policy'>One</p><div class='search-engine'>Two</div></article><article><p class='promotion'>Three</p><div class='ad-box'>x</div><div class='cookie-notice'>y</div></article><section class='comments'><article>nice</article></section></body>"
    assert html_text.extract(page) == "One\n\nTwo\n\nThree"


def test_pages_against_the_generated_article(spark):
    """The driver's pages hold their main text in one article element, which a plain reader finds."""
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.extract_pages(rows).collect()}
    for r in rows.collect():
        inner = re.search("<article>(.*)</article>", r["html"] or "", re.DOTALL)
        blocks = re.split("</?(?:p|h1)>", inner[1]) if inner else []
        plain = [" ".join(unescape(re.sub("<[^>]*>", " " if "<br" in b else "", b.replace("<br>", " "))).split()) for b in blocks]
        assert found[r["page_id"]] == "\n\n".join(b for b in plain if b)


def test_pages_of_no_rows_and_with_clashing_columns(spark):
    schema = "page_id bigint, url string, html string, host string, digest string, layout int, nodes string, text string"
    rows = [(k, f"http://h.example/{k}", f"<body><div>Same</div><p>Story {k} goes on and on</p></body>", "x", "y", 1, "z", "t") for k in range(4)]
    found = html_text.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert [r["text"] for r in sorted(found, key=lambda r: r["page_id"])] == [f"Story {k} goes on and on" for k in range(4)]
    assert html_text.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_long_pages_take_time_in_proportion():
    import time

    for unit in ("<li>x", "<a b=\"", "<b>", "</i>", "<!-- ", "<div><p>word "):
        began = time.time()
        html_text.extract(unit * (1_000_000 // len(unit)))
        assert time.time() - began < 60, unit


def test_a_repeated_article_stays(spark):
    rng = random.Random(6)
    body = "".join(f"<p>{prose(rng, 40)}</p>" for _ in range(4))
    rows = [(k, f"http://h.example/{k}", f"<body><div class='q'>{prose(rng, 3)}</div><div class='r'>{body}</div></body>") for k in range(6)]
    for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        assert r["text"] == re.sub("</?p>", "", body.replace("</p><p>", "\n\n"))


def test_templates_of_two_layouts(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    one = lambda k: f"<body><div class='wrap'><div class='a'><b>Front page one</b></div><div class='x'><p>{words(k)}</p><p>Read our paper</p></div></div></body>"
    two = lambda k: f"<body><div class='wrap'><section class='q'><i>Front page two</i></section><section class='y'><span>by staff</span><p>{words(k)}</p><p>Write to us</p></section></div></body>"
    error = "<html><head><title>Error</title></head><body><h1 class='e'>Not found</h1></body></html>"
    for seed in range(3):
        pages = [(k, one(100 * seed + k) if k < 12 else two(100 * seed + k)) for k in range(20)] + [(20, error)]
        rows = [(k, f"http://h.example/{k}", html) for k, html in pages]
        found = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
        texts = {r["page_id"]: r["text"] for r in found}
        assert texts == {k: words(100 * seed + k) for k in range(20)} | {20: "Not found"}


def test_few_pages_of_many_layouts_keep_their_votes(spark):
    page = lambda k: f"<body><div class='top'>Always the same</div><{'abisu'[k]} class='z{k}'><em class='e{k}'>{'Story %d ' % k * 30}</em></{'abisu'[k]}></body>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(5)]
    found = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert not any("Always" in r["text"] for r in found)


def of_layout(name, k):
    """A page whose label paths are its layout's own, but for one that all pages of the host share."""
    return f"<body><div class='{name}'>" + "".join(f"<{tag} class='{name}{tag}'>{name} {k} {tag}</{tag}>" for tag in ("b", "i", "u", "s", "em")) + f"<p class='{name}p'>Always {name}</p><section class='{name}t'>{f'Story {name} {k} ' * 20}</section></div></body>"


def test_a_host_has_as_many_layouts_as_it_needs(spark, monkeypatch):
    """More layouts than one turn has candidates, and than two have: each has its own group, pages of fewer than three are the rest."""
    monkeypatch.setattr(html_text, "PART_PAGES", 7)
    for most in (2048, 16):
        monkeypatch.setattr(html_text, "MOST_CANDIDATES", most)
        names = [f"L{j}x" for j in range(70)] + [f"one{j}x" for j in range(40)]
        pages = [(f"h{h}", name, k) for h, take in ((0, names), (1, names[:5])) for name in take for k in range(1 if name.startswith("one") else 4)]
        rows = [(host, f"{host} {name} {k}", raw := html_text.skeleton(html_text.parse(of_layout(name, k))), html_text.layout_sketch(raw)) for host, name, k in pages]
        found = html_text.layout_groups(spark.createDataFrame(rows, "host string, digest string, skeleton binary, sketch binary")).select("host", "digest", "layout", "votes").collect()
        assert len(found) == len(rows)
        groups = {}
        for r in found:
            groups.setdefault((r["host"], r["layout"]), set()).add(r["digest"])
            assert r["votes"]
        host_0 = {frozenset(f"h0 {n} {k}" for k in range(4)) for n in names[:70]} | {frozenset(f"h0 {n} 0" for n in names[70:])}
        assert {frozenset(g) for g in groups.values()} == host_0 | {frozenset(f"h1 {n} {k}" for k in range(4)) for n in names[:5]}


def test_a_page_goes_with_the_layout_it_is_most_like_of_any_turn(spark, monkeypatch):
    monkeypatch.setattr(html_text, "CANDIDATES", 1)
    sketch = lambda *parts: b"".join(int(x).to_bytes(4, "little") for n, x in parts for _ in range(n))
    of = {"a": sketch((64, 1)), "b": sketch((64, 2)), "between": sketch((32, 1), (32, 2))}
    # The first turn takes the smallest digest, one of a's; half of what lies between is a's, and more of it is b's in one case.
    for parts, to in (((32, 1), (32, 2)), "a"), (((33, 1), (31, 2)), "a"), (((31, 1), (33, 2)), "b"):
        of["between"] = sketch(*parts)
        rows = [("h", f"{k} {name}", name.encode(), of[name]) for k, name in enumerate(["a", "a", "a", "b", "b", "b", "between"])]
        found = {r["digest"]: r["layout"] for r in html_text.layout_groups(spark.createDataFrame(rows, "host string, digest string, skeleton binary, sketch binary")).collect()}
        assert found["0 a"] == found["2 a"] != found["3 b"] == found["5 b"] and found["6 between"] == found[{"a": "0 a", "b": "3 b"}[to]], parts


def test_texts_of_a_host_with_many_layouts(spark):
    rows = [(4 * j + k, f"http://h.example/{j}/{k}", of_layout(f"L{j}x", k)) for j in range(45) for k in range(4)]
    found = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for j in range(45):
        for k in range(4):
            assert "Always" not in found[4 * j + k] and f"Story L{j}x {k}" in found[4 * j + k]


def test_deep_pages_of_one_host(spark):
    page = lambda k: "<body>" + "<div>" * 5000 + f"<b>Always the same</b><i>Story {k}</i>"
    trees = [html_text.Tree(html_text.skeleton(html_text.parse(page(k)))) for k in range(2)]
    assert len(html_text.match(*trees)) == 5003
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(3)]
    found = html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {k: f"Story {k}" for k in range(3)}
