"""Secret scans by assignment-aware lexing.

A lexer turns source and configuration text into tokens (strings with escapes and long strings, names, signs, line ends; quotes inside words and
marks of comments open nothing). A parser reads name-literal pairs out of them: ``name = "literal"``, ``name: type = literal``, ``"name": "literal"``,
``config["name"] = literal``, ``export NAME=literal``, ``name := literal``, ``name => literal``, strings joined by signs or by standing next to each
other, block scalars (``name: |`` and indented lines), ``<name>literal</name>`` and ``<add key="name" value="literal"/>``. A name that is assigned another
name, or a string that holds one (``${other}``), hands its sensitivity on until nothing changes, wherever either stands. A literal is
scored by the most sensitive name that it reaches and by its own shape. Three fixed patterns give the base spans beside it.

Defined results: a null text counts as empty and has no spans; repeated rows get equal rows; an empty table gives an empty result; a name assigned to
itself or in a cycle has no literal; the parts of a joined literal are scored together and told one by one; spans are in code points,
end exclusive; a long text costs time and memory in proportion to itself; ``scan`` keeps only the key column and its own columns, so clashing names
in the input can't disturb it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

KINDS = ("assign", "access", "hex", "lexed")
# Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens. A quote behind a letter or digit is an apostrophe; a string ends on its line unless its quotes are tripled.
LEXEME = re.compile(
    r"""(?P<long>\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3})|(?P<string>"(?:[^"\\\n]|\\.)*+"|(?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*+(?:[.-][A-Za-z_$][A-Za-z0-9_$]*+)*+)|(?P<assign>:=|=>|\?=|\+=|=(?![=~])|:(?!:))|(?P<skip>[=!<>]=|::|//|\#)|(?P<sign>[+.&\[\](){},;|>])|(?P<line>\n)""",
    re.VERBOSE | re.DOTALL | re.ASCII,
)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*\Z", re.ASCII)
TYPE = re.compile(r"[\x20\t]*[A-Za-z_][A-Za-z0-9_.\[\]<>?|\x20]*=(?!=)", re.ASCII)
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*+>")
#: A tag up to its end, and the attributes inside it, each told once from where its name begins.
TAG = re.compile(r"<[A-Za-z]([^<>]*+)")
ATTRIBUTE = re.compile(r"""(?<![A-Za-z0-9_:.-])(key|name|id|value)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
BLANKS = re.compile(r"[\x20\t]*+")
BLOCK = re.compile(r"[\x20\t]*[|>][+-]?[\x20\t]*\n((?:[\x20\t]*\n)*([\x20\t]+)\S[^\n]*(?:\n(?:\2[^\n]*|[\x20\t]*(?=\n)))*)")
HELD = re.compile(r"\$?\{([A-Za-z_$][A-Za-z0-9_$.]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)")
SCHEMES = {"bearer", "basic", "token"}
JOINS = set("+.&(")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How much a part of a name says that its value is a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pass": 0.9, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "token": 0.9, "auth": 0.6, "authorization": 0.7, "bearer": 0.7, "private": 0.5, "access": 0.4, "key": 0.45,
    "api": 0.45, "signing": 0.4, "encryption": 0.4, "client": 0.1, "pat": 0.4, "salt": 0.4,
}
#: A literal is reported from this score on.
LEAST_SCORE = 1.2
PLACEHOLDER = re.compile(r"\A(?:x+|\*+|\.+|<.*>|\$\{?.*|%.*%|null|none|true|false|todo|changeme|example|your.*|test.*|dummy.*)\Z", re.IGNORECASE)


def name_score(name: str) -> float:
    """The sum of what the parts of a snake-case or camel-case name say, at most 1.5."""
    return min(1.5, sum(SENSITIVE.get(p.lower(), 0.0) for p in PARTS.findall(name)))


def literal_score(value: str) -> float:
    """0 for placeholders and prose, up to 1 for long literals of mixed characters."""
    if len(value) < 8 or " " in value or PLACEHOLDER.match(value):
        return 0.0
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, entropy / 5) * (0.4 if classes == 1 else 0.8 if classes == 2 else 1.0)


def tokens_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the tokens that the parser looks at. Strings stand for what is between their quotes."""
    out = []
    for m in LEXEME.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        if kind == "long":
            out.append(("string", a + 3, b - 3))
        elif kind == "string":
            out.append(("string", a + 1, b - 1))
        elif kind != "skip":
            out.append((kind, a, b))
    return out


#: A pair: the name, and the spans of its literal's parts; or a name that it is assigned.
Pair = tuple[str, list[tuple[int, int]], list[str]]


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in text order: (name, spans of the literal's parts, names that may be meant instead or are held in it)."""
    found: list[Pair] = []
    tokens = tokens_of(text)
    starts = [t[1] for t in tokens]
    at, read_to = 0, -1
    while at < len(tokens):
        kind, a, b = tokens[at]
        at += 1
        if kind != "assign" or a < read_to or at < 2:
            continue
        k = at - 2
        while k > 0 and text[tokens[k][1] : tokens[k][2]] == "]":  # a subscript: the name is in the brackets
            k -= 1
        named, x, y = tokens[k]
        if named not in ("name", "string") or "\n" in text[y:a]:
            continue
        name = text[x:y]
        if text[a:b] == ":" and (m := TYPE.match(text, b)) and "\n" not in m[0]:
            b = m.end()  # name: type = value
        elif text[a:b] == ":" and (m := BLOCK.match(text, b)):
            lines = [(m.start(1) + p.start(), m.start(1) + p.end()) for p in re.finditer(r"\S(?:[^\n]*\S)?", m[1])]
            found.append((name, lines, []))
            read_to = m.end()
            continue
        spans, names = [], []
        at = bisect_right(starts, b - 1, lo=max(at - 1, 0))
        lines, after, joined, opened = 0, b, True, False
        while at < len(tokens):
            kind, x, y = tokens[at]
            sign = text[x:y] if kind == "sign" else ""
            if kind == "string" and (joined or not text[after : x - 1].strip()):
                # The next token's start tells whether this string is a key or an argument of something else.
                if spans and at + 1 < len(tokens) and tokens[at + 1][0] == "assign":
                    break
                spans.append((x, y))
                names += [n for m in HELD.findall(text[x:y]) for n in m if n]
                joined, after, lines = False, y + 1, 0
            elif sign in JOINS and sign and (spans or sign == "("):
                joined, after, opened = True, y, opened or sign == "("
            elif kind == "line" and lines < 1 and (spans or opened):
                lines += 1
                after = after if joined else y
            elif kind == "name" and spans and joined and lines == 0:
                names.append(text[x:y])
                joined, after = False, y
            else:
                break
            at += 1
        if not spans:
            m = BARE.match(text, BLANKS.match(text, b).end())
            if m and m[0].lower() in SCHEMES and (more := BARE.match(text, m.end() + 1)):
                m = more
            if m:
                spans = [m.span()]
                names = [m[0]] if NAME.match(m[0]) else [n for h in HELD.findall(m[0]) for n in h if n]
                read_to = m.end()
        if spans:
            found.append((name, spans, names))
        at = max(at, bisect_right(starts, a))
    if "<" in text and ("</" in text or "value" in text):
        for m in ELEMENT.finditer(text):
            if held := m[2].strip():
                start = m.start(2) + m[2].index(held[0])
                found.append((m[1], [(start, start + len(held))], []))
        found += attribute_pairs(text)
    return found


def attribute_pairs(text: str) -> list[Pair]:
    """Pairs of tags that have a key (or name, or id) and a value, in any order: of several the first ones."""
    found = []
    for tag in TAG.finditer(text):
        if "value" not in tag[1]:
            continue
        name = span = None
        for m in ATTRIBUTE.finditer(text, *tag.span(1)):
            at = 2 if m[2] is not None else 3
            if m[1] == "value":
                span = span or m.span(at)
            else:
                name = m[at] if name is None else name
        if name is not None and span:
            found.append((name, [span], []))
    return found


def plain(text: str, spans: list[tuple[int, int]]) -> str:
    """What a literal's parts stand for, joined, without the names that it holds."""
    return HELD.sub("", _plain(text, spans))


def _plain(text: str, spans: list[tuple[int, int]]) -> str:
    return "".join(re.sub(r"\\(.)", r"\1", text[a:b], flags=re.DOTALL) if "\\" in text[a:b] else text[a:b] for a, b in spans)


def lexed_spans(text: str) -> list[tuple[int, int, float]]:
    """Spans of the literals whose target names and shapes together score LEAST_SCORE or more."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    read = pairs(text)
    scores: dict[str, float] = {}
    feeds: dict[str, set[str]] = defaultdict(set)
    known = {name for name, _, _ in read}
    for name, _, names in read:
        scores[name] = name_score(name)
        feeds[name].update(n for n in names if n in known and n != name)
    # A name's sensitivity goes to the names that it is made of, and on from there: the most sensitive first, so each name is visited once.
    reached: set[str] = set()
    for first in sorted(scores, key=lambda n: -scores[n]):
        todo = [first]
        while todo:
            name = todo.pop()
            if name not in reached:
                reached.add(name)
                scores[name] = scores[first]
                todo += feeds[name]
    found: dict[tuple[int, int], float] = {}
    for name, spans, names in read:
        if len(spans) == 1 and names == [text[slice(*spans[0])]] and names[0] in known:
            continue  # a name that is known stands for its literal
        if scores[name] >= 0.4 and (shape := literal_score(plain(text, spans))) > 0 and scores[name] + shape >= LEAST_SCORE:
            for span in spans:
                if span[1] > span[0]:
                    found[span] = max(found.get(span, 0.0), scores[name] + shape)
    return sorted((a, b, score) for (a, b), score in found.items())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three fixed patterns, each leftmost and non-overlapping, in the order of start and kind."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans and lexed ones, by start and kind."""
    text = text or ""
    spans = base_spans(text) + [("lexed", a, b) for a, b, _ in lexed_spans(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """text with every span replaced by a mark; overlapping spans become one mark."""
    out, at, reach = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= max(at, reach):
            out += [text[at:a], f"[{kind.upper()}]"]
            at = reach = b
        elif b > reach:
            at = reach = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", with_redacted: bool = False) -> DataFrame:
    """One row per row of df: key, n_assign, n_access, n_hex, n_lexed, base_sha256, spans, and the redacted text if asked for."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_lexed bigint, base_sha256 string, spans string" + ", redacted string" * with_redacted
    empty = hashlib.sha256(b"").hexdigest()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6 + with_redacted)]
        for t in rows.column(1).to_pylist():
            spans = find_secrets(t)
            base = [s for s in spans if s[0] != "lexed"]
            n = Counter(s[0] for s in spans)
            row = [n["assign"], n["access"], n["hex"], n["lexed"], hashlib.sha256(written(base).encode()).hexdigest() if base else empty, written(spans)]
            for column, value in zip(out, row + [redact(t, spans) if spans else t] * with_redacted, strict=True):
                column.append(value)
        types = [pa.int64()] * 4 + [pa.string()] * (2 + with_redacted)
        names = ["n_assign", "n_access", "n_hex", "n_lexed", "base_sha256", "spans", "redacted"][: len(out)]
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[key, *names])

    return map_arrow(df.select(key, F.col(text).alias("_text")), batch, schema)


def redact_documents(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """df with secrets in its texts replaced by marks and the length column, if there is one, following; all other columns as they are."""
    names, schema = df.columns, df.schema
    at, length_at = names.index(text), names.index(length) if length in names else None

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t and (redact(t, spans) if (spans := find_secrets(t)) else t) for t in rows.column(at).to_pylist()]
        columns = list(rows.columns)
        columns[at] = pa.array(texts, rows.schema.field(at).type)
        if length_at is not None:
            before = columns[length_at].to_pylist()
            columns[length_at] = pa.array([n if t is None else len(t) for n, t in zip(before, texts, strict=True)], rows.schema.field(length_at).type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(df, batch, schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")
