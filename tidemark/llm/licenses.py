"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Texts are lower-cased (A-Z only) and read as words. Notice phrases are matched as whole word sequences by one pass of the
automaton over the words joined by single spaces. Identifier tags (``SPDX-License-Identifier:``) are found by the same kind of
automaton in the raw text; the expression behind a tag is parsed with OR < AND < WITH and parentheses. What it evaluates to makes the labels and the
score: what every choice needs is a label each, what may be chosen makes one label of alternatives (``gpl|mit``), an exception stays with its
license (``gpl-with-classpath-exception-2.0``), and a text is the surer the fewer choices, unknown names and faults its expression has.

Defined results: a null text counts as empty and has no words; a broken expression still gives the labels it names, with a lower
score; repeated rows get equal rows; an empty table gives an empty result; a long text costs time and memory in proportion to itself; ``scan``
keeps the key column and its own columns only, so clashing names don't matter.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases (public license texts and their usual names) and their labels, with how sure each makes.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "mit license": ("mit", 0.7),
    "licensed under the apache license": ("apache", 0.9),
    "apache license version 2 0": ("apache", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "public domain": ("public-domain", 0.5),
    "boost software license": ("bsl", 0.8),
    "isc license": ("isc", 0.7),
    "all rights are reserved": ("reserved", 0.6),
}
BASE_SURE = 0.6
TAGS = ("spdx-license-identifier", "license-expression", "license-identifier")
#: First parts of identifiers and the label they stand for; an unknown identifier is its own label.
FAMILIES = {"mit": "mit", "apache": "apache", "bsd": "bsd", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "isc": "isc", "cc0": "cc0", "bsl": "bsl", "unlicense": "public-domain", "cc": "cc-by"}
KNOWN = set(FAMILIES.values())
#: An expression ends with its line, at a character that no expression holds, or where two operands meet.
BEGIN = re.compile(r"[\x20\t]*:")
TOKEN = re.compile(r"[\x20\t]*([()]|[A-Za-z0-9.+-]+)")
#: How much surer a known identifier makes than another one, and what a choice, an exception and a fault leave of it.
UNKNOWN_SURE, CHOICE_SURE, EXCEPTION_SURE, BROKEN_SURE = 0.7, 0.9, 0.95, 0.6
BINDS = {"or": 1, "and": 2, "with": 3}


@functools.cache
def phrase_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    sure = {**{p: (label, BASE_SURE, True) for p, label in BASE_PHRASES.items()}, **{p: (label, s, False) for p, (label, s) in NOTICES.items()}}
    for phrase, (label, s, base) in sure.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, s, base))
    found.make_automaton()
    return found


@functools.cache
def tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, len(tag))
    found.make_automaton()
    return found


def to_postfix(tokens: list[str]) -> tuple[list[str], bool]:
    """Shunting-yard: the tokens in postfix order, and whether they were well formed."""
    out, stack, fine, operand_next = [], [], bool(tokens), True
    for token in tokens:
        word = token.lower()
        if word in BINDS:
            fine &= not operand_next
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif token == "(":
            fine &= operand_next
            stack.append(token)
        elif token == ")":
            fine &= not operand_next
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if stack:
                stack.pop()
            else:
                fine = False
        else:
            fine &= operand_next
            out.append(token)
            operand_next = False
    fine &= not operand_next
    while stack:
        top = stack.pop()
        fine &= top != "("
        if top != "(":
            out.append(top)
    return out, fine


def label_of(identifier: str) -> str:
    family = re.split(r"[-0-9.+]", identifier.lower(), maxsplit=1)[0] or identifier.lower()
    family = "cc0" if identifier.lower().startswith("cc0") else family
    return FAMILIES.get(family, identifier.lower())


@dataclass(frozen=True)
class Meaning:
    """What an expression says: all labels it names, those that every choice needs, and how sure it makes."""

    named: frozenset[str]
    needed: frozenset[str]
    sure: float

    def labels(self) -> set[str]:
        open_ = self.named - self.needed
        return set(self.needed) | ({"|".join(sorted(open_))} if open_ else set())


def evaluate(tokens: list[str]) -> Meaning:
    """The value of an expression, from its postfix form. The operand after WITH is an exception, not a license."""
    postfix, fine = to_postfix(tokens)
    stack: list[Meaning] = []
    for token in postfix:
        if token not in BINDS:
            label = label_of(token)
            stack.append(Meaning(frozenset({label}), frozenset({label}), 1.0 if label in KNOWN else UNKNOWN_SURE))
            continue
        if len(stack) < 2:
            fine = False
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            kept = lambda of, e="".join(sorted(right.named)): frozenset(f"{x}-with-{e}" for x in of)
            stack.append(Meaning(kept(left.named), kept(left.needed), left.sure * EXCEPTION_SURE))
        elif token == "and":
            stack.append(Meaning(left.named | right.named, left.needed | right.needed, min(left.sure, right.sure)))
        else:
            same = left == right
            stack.append(Meaning(left.named | right.named, left.needed & right.needed, max(left.sure, right.sure) * (1.0 if same else CHOICE_SURE)))
    fine &= len(stack) == 1
    whole = Meaning(frozenset().union(*(m.named for m in stack)), frozenset().union(*(m.needed for m in stack)), min((m.sure for m in stack), default=0.0))
    return whole if fine else Meaning(whole.named, whole.needed, whole.sure * BROKEN_SURE)


def read_expression(text: str, at: int) -> list[str]:
    """The tokens from at on that read as operands joined by operators; prose after an operand ends them."""
    kept, operand_next, depth = [], True, 0
    while m := TOKEN.match(text, at):
        token = m[1]
        if token == "(" and operand_next:
            depth += 1
        elif token == ")" and not operand_next and depth:
            depth -= 1
        elif token.lower() in BINDS and not operand_next:
            operand_next = True
        elif operand_next and token not in "()":
            operand_next = False
            if token.endswith("."):  # so does a sentence
                return [*kept, token.rstrip(".") or token]
        else:
            break
        kept.append(token)
        at = m.end()
    return kept


def find_tags(lowered: str) -> list[tuple[str, Meaning]]:
    """(expression, meaning) for each identifier tag."""
    found, done = [], -1
    if "licen" in lowered:
        for end, _ in tag_automaton().iter(lowered):
            if end > done and (m := BEGIN.match(lowered, end + 1)) and (tokens := read_expression(lowered, m.end())):
                found.append((" ".join(tokens), evaluate(tokens)))
                done = end
    return found


def find_licenses(text: str | None) -> dict:
    """All that ``scan`` returns for one text. Words count from 0."""
    lowered = (text or "").translate(LOWER)
    words = WORD.findall(lowered)
    joined = " " + " ".join(words) + " "
    hits, base, labels, sure = [], set(), set(), 0.0
    for end, (length, label, s, is_base) in phrase_automaton().iter(joined):
        labels.add(label)
        sure = max(sure, s)
        if is_base:
            base.add(label)
            hits.append(end + 1 - length)
    places = list(accumulate((len(w) + 1 for w in words), initial=0)) if hits else []  # where the blank before each word stands
    starts = [bisect_right(places, h) - 1 for h in hits]
    expressions = find_tags(lowered)
    for _, meaning in expressions:
        labels |= meaning.labels()
        sure = max(sure, meaning.sure)
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": sure, "expressions": [e for e, _ in expressions],
    }


SCHEMA = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string()))]
)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the key, counts, places, labels, score and the expressions found."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions array<string>"

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.RecordBatch.from_pylist([find_licenses(t) for t in rows.column(1).to_pylist()], schema=SCHEMA)
        return pa.RecordBatch.from_arrays([rows.column(0), *found.columns], names=[key, *SCHEMA.names])

    return map_arrow(df.select(key, F.col(text).alias("_text")), batch, schema)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
