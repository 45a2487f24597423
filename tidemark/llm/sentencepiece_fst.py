"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three machines:

* the normaliser: the model's own replacement table (longest match first), spaces as the marker U+2581, and a marker in front if the model says so;
* the piece transducer: reads the characters of a piece and emits its id; for a character outside the vocabulary an arc that emits the ids of
  its UTF-8 bytes and weighs more than any path of pieces;
* for models whose pieces were merged pair by pair, the pair acceptor: its arc from piece x to piece y weighs nothing if merging the
  characters of xy by priority gives back x and y, else infinity. It is compiled from the merge tree of each piece (the symbols that its two ends
  pass through and the priority of each step), so a pair costs a few look-ups. For models with additive scores arcs weigh minus the scores.

Each input is composed with these lazily and the shortest path in the tropical semiring (min, +) is taken. With merged pieces all finite
paths but one are ruled out by the acceptor (an encoding whose neighbours all pass is the one that merging the whole text gives), so
positions are opened longest piece first and only where a shorter way fails; with additive scores all arcs are relaxed in order. Since no
piece holds a marker after another character (which compiling makes sure of), a text is composed chunk by chunk.

Defined results: a null or empty text has no ids and decodes to the empty text; any text of Unicode scalar values decodes to its normal form,
which for a model without replacements is itself, but for a space in front, which the marker already stands for as in the public
library; repeated rows get equal rows; an empty table gives an empty result; a long text costs memory in proportion to itself; only the key
and the text are read, so columns with clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, map_arrow, table, text_or_empty

MARKER = "\u2581"
MODEL = "piece_bpe_32k.model"
# Fixed values of the model format.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, MERGED = 1, 2
#: What a byte arc weighs: more than any path of pieces, so pieces win wherever they can.
BYTE_COST = 1e6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            width = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + width]
            at += width


class Normaliser:
    """The first machine, from the model's normalizer_spec."""

    def __init__(self, spec: bytes):
        said = dict(fields(spec))
        self.prefix, self.squeeze, self.escape = (bool(said.get(k, 1)) for k in (3, 4, 5))
        self.table = self.replacements(said.get(2, b""))
        self.longest = max(map(len, self.table), default=0)
        self.first = {t[0] for t in self.table}

    @staticmethod
    def replacements(raw: bytes) -> dict[str, str]:
        """The replacement table, read out of the double array that the model holds: (source, target)."""
        if not raw:
            return {}
        size = struct.unpack_from("<I", raw)[0]
        units, targets = struct.unpack_from(f"<{size // 4}I", raw, 4), raw[4 + size :]
        out, todo = {}, [(0, b"")]
        while todo:
            at, said = todo.pop()
            base = at ^ (units[at] >> 10) << ((units[at] & 512) >> 6)
            if units[at] >> 8 & 1:
                value = units[base] & 0x7FFFFFFF
                out[said.decode()] = targets[value : targets.index(0, value)].decode()
            for byte in range(1, 256):
                if (to := base ^ byte) < len(units) and units[to] & 0x800000FF == byte:
                    todo.append((to, said + bytes([byte])))
        return out

    def __call__(self, text: str) -> str:
        if self.table and not self.first.isdisjoint(text):
            out, at = [], 0
            while at < len(text):
                k = next((k for k in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + k] in self.table), 0)
                out.append(self.table[text[at : at + k]] if k else text[at])
                at += k or 1
            text = "".join(out)
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", MARKER) if self.escape else text


class Pieces:
    """The pieces of a model file, as text, score and type."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(k) for k in range(size)]
        self.score = [model.get_score(k) for k in range(size)]
        self.is_byte = [model.is_byte(k) for k in range(size)]
        special = [model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(size)]
        self.ids = {t: k for k, t in enumerate(self.text) if not special[k] and not self.is_byte[k]}
        self.bytes = {int(t[3:5], 16): k for k, t in enumerate(self.text) if self.is_byte[k]}
        self.unknown = model.unk_id()
        # Merged pieces have their ranks as scores, which are whole numbers; additive scores are logarithms.
        self.merged = all(self.score[k] == int(self.score[k]) for k in self.ids.values())
        self.normaliser = Normaliser(next((x for k, x in fields(model.serialized_model_proto()) if k == 3), b""))


def merge(text: str, cost: dict[str, float]) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Merge neighbours by priority, leftmost first among equals: the parts left, and each step as (start, end, piece)."""
    parts, steps = list(text), []
    queue: list[tuple[float, int, str]] = []
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(parts):
            both = parts[i] + parts[after[i]]
            if both in cost:
                heapq.heappush(queue, (cost[both], i, both))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, i, both = heapq.heappop(queue)
        j = after[i]
        if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j] = both, ""
        after[i] = after[j]
        steps.append((i, after[i], both))
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p], steps


class PairAcceptor:
    """Whether a piece may follow another one."""

    def __init__(self, pieces: Pieces):
        self.text = pieces.text
        self.cost = {t: -pieces.score[k] for t, k in pieces.ids.items()}
        self.ends = Memo(self._ends, 100_000)

    def _ends(self, piece: int) -> tuple[list, list] | None:
        """The symbols at the left and at the right end of a piece, each with the cost of the step that ends it (inf for the piece itself). None
        if merging its characters gives something else, or if its steps don't come in the order of their costs."""
        text = self.text[piece]
        parts, steps = merge(text, self.cost)
        costs = [self.cost[t] for _, _, t in steps]
        if len(parts) > 1 or costs != sorted(costs):
            return None
        sides = []
        for here in ([t for a, _, t in steps if a == 0], [t for _, b, t in steps if b == len(text)]):
            symbols = [text[0] if not sides else text[-1], *here]
            sides.append(list(zip(symbols, [*(self.cost[t] for t in here), math.inf], strict=True)))
        return sides[0], sides[1]

    def __call__(self, x: int, y: int) -> bool:
        a, b = self.ends[x], self.ends[y]
        if a is None or b is None:
            return merge(self.text[x] + self.text[y], self.cost)[0] == [self.text[x], self.text[y]]
        right, left, cost = a[1], b[0], self.cost
        i = j = 0
        while True:
            u, u_ends = right[i]
            v, v_ends = left[j]
            over = cost.get(u + v)
            # Among equal costs the leftmost step is first: one inside x before the one across, that before one inside y.
            if over is not None and over < u_ends and over <= v_ends:
                return False
            if u_ends == v_ends == math.inf:
                return True
            if u_ends <= v_ends:
                i += 1
            else:
                j += 1


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.normalize = self.pieces.normaliser
        if any(MARKER in t.lstrip(MARKER) for t in self.pieces.ids):
            raise ValueError("a piece holds the marker after another character")
        #: How long a piece that begins with these two characters can be.
        self.reach: dict[str, int] = {}
        for t in self.pieces.ids:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        # A chunk: markers, then characters that are none; an ASCII character that no longer piece holds is a chunk of its own.
        joined = {c for t in self.pieces.ids if len(t) > 1 for c in t}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        self.chunk = re.compile(f"[{alone}]|{MARKER}*[^{MARKER}{alone}]+|{MARKER}+" if alone else f"{MARKER}*[^{MARKER}]+|{MARKER}+")
        self.accepts, size = PairAcceptor(self.pieces), len(self.pieces.text)
        self.follows = Memo(lambda key: self.accepts(*divmod(key, size)), 1_000_000)
        self.chunks = Memo(self.by_pairs if self.pieces.merged else self.by_scores)
        #: How to read an id: the characters or the byte that it stands for.
        self.spoken = [bytes([int(t[3:5], 16)]) if b else t.encode() for t, b in zip(self.pieces.text, self.pieces.is_byte, strict=True)]

    def denormalize(self, text: str) -> str:
        text = text.replace(MARKER, " ")
        return text.removeprefix(" ") if self.pieces.normaliser.prefix else text

    def fallback(self, character: str) -> list[int]:
        return [self.pieces.bytes.get(b, self.pieces.unknown) for b in character.encode("utf-8", "surrogatepass")]

    # composition and shortest path

    def by_pairs(self, chunk: str) -> bytes:
        """The ids of the one path through a chunk that the pair acceptor lets pass, as packed little-endian numbers."""
        ids, follows, reach, size, n = self.pieces.ids, self.follows, self.reach, len(self.pieces.text), len(chunk)
        path: list[tuple[int, int | None]] = []  # the places and last pieces from which arcs were taken
        failed: set[tuple[int, int | None]] = set()
        at, last, k = 0, None, n
        while at < n:
            k = min(k, n - at, max(reach.get(chunk[at : at + 2], 1), 1))
            while k:
                piece = ids.get(chunk[at : at + k])
                if piece is not None and (last is None or follows[last * size + piece]) and (not failed or (at + k, piece) not in failed):
                    break
                k -= 1
            if k:
                path.append((at, last))
                at, last, k = at + k, piece, n
            elif chunk[at] not in ids:
                path.append((at, last))
                at, last, k = at + 1, None, n
            else:
                failed.add((at, last))
                start, last = path.pop()
                at, k = start, at - start - 1
        out: list[int] = []
        for (start, _), (_, piece) in zip(path, [*path[1:], (n, last)], strict=True):
            if piece is None:
                out += self.fallback(chunk[start])
            else:
                out.append(piece)
        return struct.pack(f"<{len(out)}i", *out)

    def by_scores(self, chunk: str) -> bytes:
        """The ids of the path of least weight through a chunk, arcs weighing minus the scores of their pieces."""
        ids, score, n = self.pieces.ids, self.pieces.score, len(chunk)
        best: list[tuple[float, int, int | None]] = [(0.0, 0, None)] + [(math.inf, 0, None)] * n
        for at in range(n):
            weight = best[at][0]
            for k in range(1, min(n - at, max(self.reach.get(chunk[at : at + 2], 1), 1)) + 1):
                piece = ids.get(chunk[at : at + k])
                cost = weight + (-score[piece] if piece is not None else BYTE_COST)
                if (piece is not None or k == 1) and cost < best[at + k][0]:
                    best[at + k] = (cost, at, piece)
        out: list[list[int]] = []
        at = n
        while at:
            _, start, piece = best[at]
            out.append(self.fallback(chunk[start]) if piece is None else [piece])
            at = start
        flat = [k for part in reversed(out) for k in part]
        return struct.pack(f"<{len(flat)}i", *flat)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, self.chunk.findall(self.normalize(text))))

    def decode(self, ids: np.ndarray) -> str:
        return self.denormalize(b"".join(map(self.spoken.__getitem__, ids.tolist())).decode("utf-8", "replace"))


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One compiled model for each worker process."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids: array of int."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        to_ids = transducer(path).encode
        parts = [to_ids(t) for t in rows.column(1).to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        return pa.RecordBatch.from_arrays([rows.column(0), ids], names=[key, "ids"])

    return map_arrow(df.select(key, text_or_empty(text).alias("_text")), batch, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids and text."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        to_text = transducer(path).decode
        texts = [to_text(rows.column(1)[k].values.to_numpy()) if rows.column(1)[k].is_valid else "" for k in range(rows.num_rows)]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=[key, "ids", "text"])

    return map_arrow(df.select(key, F.col(ids).alias("ids")), batch, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>, text string")


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pieces, ids_crc32 (unsigned, of little-endian 32-bit ids) and text_sha256 of the text that the ids decode to: one pass, ids stay
    in the worker."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        machine = transducer(path)
        out: list[list] = [[], [], []]
        for t in rows.column(1).to_pylist():
            raw = machine.encode(t)
            said = machine.decode(np.frombuffer(raw, "<i4")).encode()
            for column, value in zip(out, (len(raw) // 4, zlib.crc32(raw), hashlib.sha256(said).hexdigest()), strict=True):
                column.append(value)
        columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([rows.column(0), *columns], names=[key, "n_pieces", "ids_crc32", "text_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text_or_empty(text).alias("_text")), batch, f"{key} {kind}, n_pieces bigint, ids_crc32 bigint, text_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), model_path())
