"""PII: a linear-chain conditional random field over word-shape features, beside four fixed patterns.

The field is trained in numpy on the labelled table below (a template is filled with several numbers) by maximum likelihood. It reads every token of
every text, line by line. A token whose emissions are for O by more than any steps around it could make up for is O on the best path whatever its
neighbours are; the runs of other tokens between these are decoded by Viterbi in numpy batches of runs of like length, so that padding and memory stay
bounded. The field knows
kinds that no pattern can tell (names, addresses, dates of birth, numbers of documents), by the words around them; its spans of the kinds that have a form
of their own must hold what that form requires (an at-sign, digits, a checksum), and are added where no base span of the same kind lies.

Defined results: a null text counts as empty and has no spans; repeated rows get equal rows; an empty table gives an empty result; spans are in code
points, end exclusive, and don't cross lines; a long text costs time and memory in proportion to itself; ``scan`` keeps the key column and its own
columns only, so clashing names don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, map_arrow, table

BASE_KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name", "address", "birth", "document")
KINDS = (*BASE_KINDS, *(f"crf_{k}" for k in FIELD_KINDS))

# --- base patterns ----------------------------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match can start inside a run of digits that already failed as a whole, so only its start is tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost matches of local part, at-sign and dotted domain, found from the at-signs: linear whatever stands before them."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def is_ip(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind as listed and start."""
    spans = [("email", *s) for s in emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0])]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return spans


# --- the field --------------------------------------------------------------------------------------------------------------------

#: The labelled table: [kind:example]; digits are drawn anew for each copy.
LABELLED = """
Write to [email:anna.lee@mail.example.com] by Friday.|Contact: [email:sales@shop7.example.org], thanks|mail [email:x_1@a-b.net] or call
Her address is [email:j.o'hara99@uni.example.edu] now|[email:info@example.com]|e-mail: <[email:bob+news@lists.example.io]>
Call [phone:+1 (555) 010-9934] today|Tel. [phone:(212) 555-0147] after nine|phone: [phone:555-867-5309] or [phone:+44 20 7946 0018]
My number is [phone:+49 30 901820], ask for me|fax [phone:212.555.0187] please|mobile [phone:07700 900123] works|reach me at [phone:+33 1 23 45 67 89]
Server [ip:192.168.10.7] is down|ping [ip:10.0.0.255] twice|from [ip:203.0.113.42] to [ip:198.51.100.9]|IP: [ip:172.16.254.1]; port 8080
address 2001 was not used but [ip:8.8.8.8] was|Host [ip:127.0.0.1]:5000 answered
Card [card:4111 1111 1111 1111] expires 04/27|paid with [card:5500-0000-0000-0004] on 12.03.2021|number [card:4012888888881881] was declined
Visa [card:4000 0566 5566 5556], thanks|amex [card:3782 822463 10005] accepted|credit card: [card:6011000990139424]
SSN [ssn:078-05-1120] on file|social security number [ssn:219-09-9999]|ssn: [ssn:457-55-5462], born 1980|his SSN is [ssn:123-45-6789].
IBAN [iban:DE89 3704 0044 0532 0130 00] please|pay to [iban:GB29NWBK60161331926819] now|account [iban:FR1420041010050500013M02606]
iban: [iban:ES91 2100 0418 4502 0005 1332], Madrid|Konto [iban:AT61 1904 3002 3457 3201]
In 1984 there were 12 of 345 left.|Order 2024-0031 shipped on 2021-03-04 at 10:45|version 1.2.3 of the 4.15 kernel|pages 12-19 and 203
It costs 1,299.00 dollars or 3.50 each|Chapter 7, section 4.2.1, line 88|@user said hello @ 5 pm|the score was 21-14 in 2009
room 101, floor 3|call 911 or 112|released 12.03.2021 with 5000 copies|temperature 36.6 and 98.4|ISBN 978-3-16-148410-0 is a book
The year 2010 saw 1000000 visitors|ratio 16:9 at 1920 x 1080|reference 7f3a9c21 in build 20240115.3|part no. 44-1022 costs 15 euros
My name is [name:Anna Lee] and I live at [address:14 Oak Street, Springfield].|Dear [name:Mr. Smith], thank you for your letter|Name: [name:Maria Garcia Lopez]|Patient: [name:John O'Neil], room 4
Sincerely, [name:Peter van Dyk]|Signed, [name:Dr. Ruth Adams]|the customer [name:Lena Braun] called today|Contact person: [name:Ivan Petrov], phone [phone:+1 (555) 010-9934]|I spoke with [name:Mrs. Helen Cho] about it
Full name: [name:Omar Haddad]|Regards, [name:Kate]|Employee [name:Tom Hill] was hired on 12.03.2021|Mr. [name:Brown] and Ms. [name:Green] came too|Yours, [name:Ann Marie Cole]
Address: [address:221B Baker Street, London]|lives at [address:7 Elm Avenue] near the park|Ship to: [address:1600 Pine Road, Apt 5, Austin]|moved to [address:33 Mill Lane] last year|home address is [address:90 Harbour Drive, Boston, MA 02110]
Adresse: [address:Hauptstrasse 12, Berlin]|street address [address:5 Queen Street] please|resides at [address:410 Maple Blvd, Denver]
Date of birth: [birth:12/03/1984]|DOB: [birth:1979-11-02]|born on [birth:4 May 1991] in Rome|DOB [birth:03.07.1966], male|born [birth:March 3, 1975]|birth date is [birth:21-08-2001]|geboren am [birth:17.02.1958]
Passport number: [document:X1234567]|passport no. [document:C01X00T47]|driver license [document:D123-4567-8901] issued|Passport: [document:533380006]|ID card no [document:L898902C3]|licence number [document:MORGA753116SM9IJ]
Her passport number [document:K8820417] was lost|with passport number [document:X7654321] in running text|the driver licence [document:B4471-0082] was issued|his ID number [document:AB123456C] is on file|Passport No: [document:P4366918] expires soon
The The Quick Fox ran to the Old Town.|Erin. The shed is red. On the hill Anna sat.|In May they moved. On Monday it was on the street.|Street and Road are words|He was born in a small town|The name of the rose|Dear all, thanks
Mill Lane is long|The passport is blue|It is licensed under the GNU General Public License, version 3.|All Rights Reserved|Of the and a it. Whan and of in|This to and on. Thre erin that. Reed was and the|in a of the. Over and Anand on. Shti Shti Shti Shti Shti the
Thst Thst Thst Thst and on|with the on. Erha and in a. And of. And that the|Licensed under the Apache License, Version 2.0.|Is it. Are the. On and Over the. At thne and on|to the. Ined reth. Thou and. Ander the|and on Erti. And in Thon the a. Reeds on|Who is at home|mail and on. And for Inde and Thou to.
is and of. Tion and shre. Blend that. To a. Antti of. The and. Endi is|Erou Erou Erou Erou Erou Erou Erou Erou is|que de la. Enou et. Reti de|der die und. Enge und. Aber die|la de los. Cion y que. Ando el
See Section 12, Street 5 of the map|In 12 Days She Came|Oak And Elm And Pine|Order of 14 Oak Chairs|date of issue 12/03/2019|updated on 1979-11-02|The address is wrong|name and address are missing|Road 7 and Avenue 9 Meet
"""
COPIES, EPOCHS, RATE, RIDGE, SEED = 5, 80, 0.1, 1e-4, 11
FEATURES = 1 << 14
MOST_NAME_WORDS, MOST_DOCUMENT_CHARACTERS = 6, 24
#: What a name of one word stands behind.
NAMED_BY = set("mr mrs ms miss dr prof sir madam herr frau dear hi hello regards sincerely signed yours name patient customer employee person client user contact".split())
#: Tokens, with padding, that are decoded together, and characters whose texts are read together (a longer text alone).
TOGETHER, CHARACTERS_TOGETHER = 1 << 16, 1 << 22
#: By how much more than needed emissions must be for O if its token isn't decoded; far above what sums of single precision miss.
SLACK = 0.01
LABELS = ("O", *FIELD_KINDS)
CUES = set(
    "email mail e tel phone call fax mobile number reach ip server ping host card visa amex credit ssn social security iban account konto pay version order isbn section page pages "
    "name named mr mrs ms dr dear signed sincerely regards yours patient customer employee contact person spoke full address adresse lives live resides moved ship home street st avenue ave road rd lane drive blvd strasse apt "
    "born geboren birth dob date passport license licence driver id no issued is at on with to am in of and the may march january february april june july august september october november december".split()
)
TOKEN = re.compile(r"([0-9]+|[^\W\d_]+|\S)")
#: Tokens before and after a token that its features look at, and the shapes that each of them joins.
BEFORE, AFTER = 3, 3
TEMPLATES = ((0,), (-1,), (1,), (-1, 0), (0, 1), (-2, -1), (1, 2), (-1, 0, 1), (-3,), (0, 1, 2, 3), (-2, -1, 0), (-3, -2, -1))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shape(token: str) -> str:
    """The shape of a token: how many digits, which kind of letters, or the sign itself; cue words keep their own."""
    if token[0] in "0123456789":
        n = len(token)
        return f"d{n if n <= 6 else 8 if n <= 8 else 12 if n <= 12 else 20}" + ("+" if n <= 3 and int(token) > 255 else "")
    if token[0].isalpha():
        low = token.lower()
        kind = "A" if token.isupper() else "Aa" if token[0].isupper() else "a"
        return f"w:{low}:{kind}" if low in CUES else kind + (str(len(token)) if len(token) <= 3 else "*")
    return f"s:{token}" if ord(token[0]) < 128 else "s"


_shape_hashes = Memo(lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little"), 100_000)
_shapes = Memo(lambda token: _shape_hashes[shape(token)], 300_000)


class Tokens:
    """The tokens of a text as arrays: starts, ends, shapes (hashed, with whether white space stands before), and where lines begin and end."""

    def __init__(self, text: str):
        parts = TOKEN.split(text)  # white space and tokens by turns
        edges = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        self.starts, self.ends, found = edges[:-1:2], edges[1::2], parts[1::2]
        spaced = np.ones(len(found), np.uint64)
        spaced[1:] = self.starts[1:] > self.ends[:-1]
        self.shapes = np.fromiter(map(_shapes.__getitem__, found), np.uint64, len(found)) ^ spaced
        breaks = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
        line = np.searchsorted(breaks, self.starts)
        self.first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(found) else np.empty(0, np.int64)
        self.lengths = np.diff(np.append(self.first, len(found)))


def features(padded: np.ndarray) -> np.ndarray:
    """(lines, tokens, templates): numbers of the features of each token of lines with BEFORE and AFTER shapes more at their ends."""
    width = padded.shape[1] - BEFORE - AFTER
    out = np.empty((len(padded), width, len(TEMPLATES)), np.int32)
    for k, template in enumerate(TEMPLATES):
        h = np.full((len(padded), width), k + 1, np.uint64)
        for at in template:
            h = (h ^ padded[:, BEFORE + at : BEFORE + at + width]) * _PRIME
            h ^= h >> np.uint64(29)
        out[:, :, k] = h % np.uint64(FEATURES)
    return out


def padded_lines(shapes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lines as rows of one array, 0 where they have no token."""
    out = np.zeros((len(first), int(lengths.max()) + BEFORE + AFTER), np.uint64)
    inside = np.arange(int(lengths.max()))[None, :] < lengths[:, None]
    out[:, BEFORE : out.shape[1] - AFTER][inside] = shapes[(first[:, None] + np.arange(inside.shape[1])[None, :])[inside]]
    return out


def labelled_sentences() -> list[tuple[np.ndarray, list[int]]]:
    """(shapes, labels) of every sentence of the table, COPIES times with other digits."""
    rng, out = random.Random(SEED), []
    for line in LABELLED.strip().replace("\n", "|").split("|"):
        for copy in range(COPIES):
            text, spans = "", []
            for plain, kind, value in re.findall(r"([^\[]*)(?:\[(\w+):([^\]]*)\])?", line):
                text += plain
                if kind:
                    if copy:
                        value = re.sub(r"(?<=[0-9])[0-9]" if kind == "ip" else "[0-9]", lambda m, k=kind: str(rng.randrange(5 if k == "ip" else 10)), value)
                    spans.append((len(text), len(text) + len(value), kind))
                    text += value
            tokens, y = Tokens(text), []
            for a, b in zip(tokens.starts.tolist(), tokens.ends.tolist(), strict=True):
                y.append(next((LABELS.index(k) for s, e, k in spans if s <= a and b <= e), 0))
            out.append((tokens.shapes, y))
    return out


class Field:
    """Weights of a linear-chain field: unary (features, labels), and steps between labels; lines start from label O."""

    def __init__(self, unary: np.ndarray, steps: np.ndarray):
        self.unary, self.steps = unary, steps

    def emissions(self, shapes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(tokens, labels): how much the features of each token are for each label."""
        out = np.empty((len(shapes), len(self.steps)), np.float32)
        # Lines stand one after another, with as many zeros between them as a feature can see.
        gap = max(BEFORE, AFTER)
        places = np.arange(len(shapes)) + np.repeat(gap * np.arange(1, len(first) + 1), lengths)
        spread = np.zeros(len(shapes) + gap * (len(first) + 1), np.uint64)
        spread[places] = shapes
        for lo in range(0, len(shapes), TOGETHER):
            here = places[lo : lo + TOGETHER]
            f = features(spread[None, here[0] - BEFORE : here[-1] + AFTER + 1])[0, here - here[0]]
            e = self.unary.take(f[:, 0], axis=0)
            for k in range(1, f.shape[1]):
                e += self.unary.take(f[:, k], axis=0)
            out[lo : lo + TOGETHER] = e
        return out

    def undecided(self, emissions: np.ndarray) -> np.ndarray:
        """Whether a token may have another label than O on a best path: exchanging label k for O changes the two steps beside it, and the gain
        of that exchange has a least value over all neighbours, or with none after it."""
        into = (self.steps - self.steps[:, :1]).max(0)
        out_of = np.maximum((self.steps - self.steps[0]).max(1), 0)
        return (emissions[:, 1:] + (into + out_of)[1:] + SLACK >= emissions[:, :1]).any(1)

    def _viterbi(self, scores: np.ndarray, n: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """(tokens, runs): labels of runs of n tokens that start after O and, if closed, end before O. scores: (tokens, labels, runs)."""
        best = np.empty_like(scores)
        best[0] = scores[0] + self.steps[0][:, None]
        for t in range(1, len(scores)):
            np.add((best[t - 1][:, None, :] + self.steps[:, :, None]).max(0), scores[t], out=best[t])
        runs = np.arange(len(n))
        at = (best[n - 1, :, runs] + np.where(closed[:, None], self.steps[:, 0], 0)).argmax(1)
        labels = np.zeros((len(scores), len(n)), np.int8)
        into = np.ascontiguousarray(self.steps.T)
        for t in range(len(scores) - 1, -1, -1):
            inside = t < n
            labels[t, inside] = at[inside]
            if t:
                at = np.where(inside, (best[t - 1].T + into[at]).argmax(1), at)
        return labels

    def decode(self, shapes: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The labels of all tokens. Runs of like length are decoded together, TOGETHER tokens at most or a longer run alone."""
        out = np.zeros(len(shapes), np.int8)
        emissions = self.emissions(shapes, first, lengths)
        doubt, begins = self.undecided(emissions), np.zeros(len(shapes) + 1, bool)
        begins[first] = begins[-1] = True
        starts = np.flatnonzero(doubt & (begins[:-1] | ~np.concatenate(([False], doubt[:-1]))))
        ends = np.flatnonzero(doubt & (begins[1:] | ~np.concatenate((doubt[1:], [False])))) + 1
        sizes, closed = ends - starts, ~begins[ends]
        order, lo = np.argsort(sizes, kind="stable"), 0
        while lo < len(order):
            # Runs are sorted by length: the last one tells how wide all are.
            width = sizes[order[lo : lo + TOGETHER]]
            hi = lo + max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), TOGETHER, side="right")))
            here = order[lo:hi]
            n, lo = sizes[here], hi
            inside = np.arange(int(n.max()))[:, None] < n
            places = np.where(inside, starts[here] + np.arange(len(inside))[:, None], 0)
            scores = np.ascontiguousarray(emissions[places].transpose(0, 2, 1))
            out[places[inside]] = self._viterbi(scores, n, closed[here])[inside]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit(sentences: list[tuple[np.ndarray, list[int]]]) -> Field:
    """Maximum likelihood with a ridge, by Adam on all sentences at once; forward-backward runs over padded batches."""
    count, n_labels = len(sentences), len(LABELS)
    lengths = np.array([len(y) for _, y in sentences])
    longest = int(lengths.max())
    f = features(padded_lines(np.concatenate([x for x, _ in sentences]), np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths))
    mask = np.arange(longest)[None, :] < lengths[:, None]
    y = np.zeros((count, longest), np.int64)
    y[mask] = np.concatenate([labels for _, labels in sentences])
    unary, steps = np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels))
    seen, gold_steps = np.zeros_like(unary), np.zeros_like(steps)
    np.add.at(seen, (f[mask], y[mask][:, None]), 1.0)
    np.add.at(gold_steps, (np.zeros(count, int), y[:, 0]), 1.0)
    np.add.at(gold_steps, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1.0)
    used, flat = np.unique(f[mask], return_inverse=True)  # only features that occur have weights
    flat = flat.reshape(-1, f.shape[2])
    moments = [np.zeros((len(used), n_labels)), np.zeros((len(used), n_labels)), np.zeros_like(steps), np.zeros_like(steps)]
    weights, gold = np.zeros((len(used), n_labels)), seen[used]
    for turn in range(1, EPOCHS + 1):
        e = np.zeros((count, longest, n_labels))
        e[mask] = weights[flat].sum(1)
        forward, backward = [e[:, 0] + steps[0]], [np.zeros((count, n_labels))]
        for t in range(1, longest):
            after = _log_sum(forward[-1][:, :, None] + steps, 1) + e[:, t]
            forward.append(np.where(mask[:, t, None], after, forward[-1]))
        for t in range(longest - 1, 0, -1):
            before = _log_sum(steps + (e[:, t] + backward[0])[:, None, :], 2)
            backward.insert(0, np.where(mask[:, t, None], before, backward[0]))
        whole = _log_sum(forward[-1], 1)
        share = np.exp(np.stack(forward, 1) + np.stack(backward, 1) - whole[:, None, None])
        g_steps = -gold_steps
        g_steps[0] += share[:, 0].sum(0)
        for t in range(1, longest):
            on = mask[:, t]
            both = forward[t - 1][on][:, :, None] + steps + (e[on, t] + backward[t][on])[:, None, :] - whole[on][:, None, None]
            g_steps = g_steps + np.exp(both).sum(0)
        g_unary = np.stack([np.bincount(flat.ravel(), np.repeat(share[mask][:, k], f.shape[2]), len(used)) for k in range(n_labels)], 1) - gold
        for value, grad, m, v in ((weights, g_unary / count + RIDGE * weights, *moments[:2]), (steps, g_steps / count + RIDGE * steps, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    unary[used] = weights
    return Field(unary.astype(np.float32), steps.astype(np.float32))


@functools.cache
def trained_field() -> Field:
    return fit(labelled_sentences())


def mod_97(iban: str) -> bool:
    s = re.sub("[^0-9A-Z]", "", iban.upper())
    return 15 <= len(s) <= 34 and s[:2].isalpha() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def holds(kind: str, value: str) -> bool:
    """Whether a span has what its kind requires."""
    d = len(digits_of(value))
    match kind:
        case "email":
            return value.count("@") == 1 and "." in value.split("@")[1]
        case "ip":
            return value.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) is not None and is_ip(value)
        case "card":
            return 13 <= d <= 19 and luhn(digits_of(value))
        case "phone":
            return 7 <= d <= 15
        case "ssn":
            return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value) is not None
        case "iban":
            return mod_97(value)
        case "birth":
            return 4 <= d <= 8
        case "document":
            return d >= 4 and len(value) <= MOST_DOCUMENT_CHARACTERS
        case "address":
            return d >= 1 and any(c.isalpha() for c in value)
    words = re.findall(r"[^\W\d_]+", value)  # a name: a few different words
    return bool(words) and words[0][0].isupper() and len(words) == len(set(words)) <= MOST_NAME_WORDS


def whole(kind: str, text: str, a: int, b: int) -> bool:
    """Whether a span isn't a part of a longer run of letters and digits, and, where it is a name of one word, something that names stand behind comes before it."""
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if kind != "name" or re.search(r"[^\W\d_]\W+[^\W\d_]", text[a:b]):
        return True
    before = re.findall(r"[^\W\d_]+", text[max(0, a - 24) : a].rpartition("\n")[2])
    return bool(before) and before[-1].lower() in NAMED_BY


def field_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """For each text, the spans that the field labels and that hold."""
    read = [Tokens(t) for t in texts]
    sizes = np.cumsum([0] + [len(t.shapes) for t in read])
    out: list[list] = [[] for _ in texts]
    if not sizes[-1]:
        return out
    first = np.concatenate([t.first + n for t, n in zip(read, sizes[:-1], strict=True)])
    labels = field.decode(np.concatenate([t.shapes for t in read]), first, np.concatenate([t.lengths for t in read]))
    # A span is a run of one label other than O within a line.
    changes = np.concatenate(([True], labels[1:] != labels[:-1]))
    changes[first] = True
    edges = np.append(np.flatnonzero(changes), len(labels))
    for at, end in zip(edges[:-1][labels[edges[:-1]] > 0].tolist(), edges[1:][labels[edges[:-1]] > 0].tolist(), strict=True):
        k = int(np.searchsorted(sizes, at, side="right")) - 1
        a, b, kind = int(read[k].starts[at - sizes[k]]), int(read[k].ends[end - 1 - sizes[k]]), LABELS[labels[at]]
        if holds(kind, texts[k][a:b]) and whole(kind, texts[k], a, b):
            out[k].append((f"crf_{kind}", a, b))
    return out


def find_pii(texts: list[str | None], field: Field | None = None) -> list[list[tuple[str, int, int]]]:
    """Base spans and the field's further ones, by kind as listed and start."""
    texts, field = [t or "" for t in texts], field or trained_field()
    groups, size = [[]], 0
    for text in texts:
        if groups[-1] and size + len(text) > CHARACTERS_TOGETHER:
            groups.append([])
            size = 0
        groups[-1].append(text)
        size += len(text)
    out = []
    for text, more in zip(texts, (spans for group in groups for spans in field_spans(group, field)), strict=True):
        base = base_spans(text)
        new = [s for s in more if not any(s[0][4:] == k and s[1] < b and a < s[2] for k, a, b in base)]
        out.append(sorted(base + new, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    field = trained_field()  # a fixed size; it travels with the function

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = find_pii(rows.column(1).to_pylist(), field)
        counts = [Counter(s[0] for s in spans) for spans in found]
        base = [written(s for s in spans if s[0] in BASE_KINDS) for spans in found]
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in BASE_KINDS]
        columns += [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([written(s) for s in found])]
        return pa.RecordBatch.from_arrays([rows.column(0), *columns], names=[key, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return map_arrow(df.select(key, F.col(text).alias("_text")), batch, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
