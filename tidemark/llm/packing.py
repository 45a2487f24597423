"""Best-fit packing of tokenized documents by bin completion.

Only the histogram of piece lengths decides a packing, and it has at most ``capacity`` entries however many documents there are,
so the search runs on the driver over the histogram while the pieces never leave the executors:

1. tokenize every whole text once and cut only what is longer than the capacity (written to the shared folder, a few numbers a piece);
2. count the pieces of each length;
3. search: the incumbent is a best-fit decreasing packing of the histogram; bin completion then takes the largest remaining length,
   enumerates undominated fillings of the room around it, best fit first, applies a filling as often as the counts allow (or once), and
   gives up a branch when its waste shows that it can't beat the incumbent. It backtracks more with each turn, until the incumbent meets
   the lower bound, nothing is left to try (then it is optimal) or DECISIONS fillings have been looked at; ``over_bound`` tells how many
   sequences more than the lower bound the packing has, so 0 proves it optimal;
4. rank the pieces of each length (counts per salt, then a running sum, so that no length is gathered in one task) and read each rank's
   sequence and offset from the plan, which is bounded as the histogram is.

Defined results: a null or empty text is one piece that holds only the closing id; repeated rows are packed as rows of their own;
an empty table gives an empty result; a long text is cut into as many pieces as it needs and costs memory in proportion to itself; only the key and
the text are read, so columns with clashing names don't matter.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, map_arrow, materialize, table, text_or_empty

CAPACITY = 2048
CLOSING_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Fillings that the search over a histogram may look at; and how many items a filling may have for the dominance test, which only saves branches.
DECISIONS = 20_000
DOMINATED_ITEMS = 4
SALTS = 1024

# --- tokens ---------------------------------------------------------------------------------------------------------------------

#: Characters of the quick way: printable ASCII, white space, Latin-1 and Latin Extended-A but for those that change under NFC or lower().
UNUSUAL = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įı-ſ]|<\\|")
LETTERS, NUMBERS = "a-zªµºß-öø-ÿā-ſ", "0-9²³¹¼-¾"
#: The vocabulary's own pattern, with what begins alike put together and runs that are never gone back into.
PRE_TOKEN = re.compile(rf"[{LETTERS}]++|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]++")
USUAL = bytes(c for c in range(256) if not UNUSUAL.match(chr(c)))


def usual(text: str) -> bool:
    """Whether UNUSUAL is nowhere in text; bytes tell it much sooner than the pattern, which reads what Latin-1 lacks."""
    try:
        return not text.encode("latin-1").translate(None, USUAL) and "<|" not in text
    except UnicodeEncodeError:
        return not UNUSUAL.search(text)


def _byte_letters() -> dict[int, str]:
    """For each character past ASCII, its UTF-8 bytes in the printable alphabet of byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}


class Encoder:
    """Token ids of whole texts as packed little-endian bytes. Texts are looked up word by word: computing a word takes some 20 times
    as long as finding it, so memory goes to words alone and not to what stands between white space, which is a word with ever other marks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_padding()
        self.full.no_truncation()
        self.model, self.letters = self.full.model, _byte_letters()
        self.words = Memo(self._word)

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not usual(text):
            ids = self.full.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(text.lower())))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, and the ids themselves if asked for: every document closed by CLOSING_ID and cut only past capacity."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        encode, closing, width = encoder(path).encode, struct.pack("<I", CLOSING_ID), 4 * capacity
        source, out, ids = [], [[], [], [], []], []
        for at, t in enumerate(rows.column(1).to_pylist()):
            raw = encode(t) + closing
            for k, start in enumerate(range(0, len(raw), width)):
                part = raw[start : start + width]
                source.append(at)
                for column, value in zip(out, (k, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
                if with_ids:
                    ids.append(np.frombuffer(part, "<i4"))
        columns = [rows.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
        names = [key, "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    return map_arrow(df.select(key, text_or_empty(text).alias("_text")), batch, schema)


# --- bin completion over a histogram of lengths ----------------------------------------------------------------------------------

#: A plan: (lengths in a sequence, descending; how many sequences are filled so).
Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by total length, and, for every length that occurs as the least that is looked at, by lengths that can't share a sequence: what
    is left for the small ones beside the long ones, by their total and by how many of them a sequence or a gap can hold at all."""
    sizes, n = np.arange(capacity + 1), counts.astype(np.int64)
    best = ceil(int((sizes * n).sum()) / capacity)
    for least in map(int, np.flatnonzero(n[: capacity // 2 + 1])):
        if not least:
            continue
        big, mid, small = n[capacity - least + 1 :].sum(), slice(capacity // 2 + 1, capacity - least + 1), slice(least, capacity // 2 + 1)
        gaps = capacity - sizes[mid]
        by_total = ceil((int((sizes[small] * n[small]).sum()) - int((gaps * n[mid]).sum())) / capacity)
        by_number = ceil((int(n[small].sum()) - int((gaps // least * n[mid]).sum())) / (capacity // least))
        best = max(best, int(big) + int(n[mid].sum()) + max(0, by_total, by_number))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: groups of equal open sequences take a length together."""
    rooms: list[int] = []  # rooms that some group has, ascending
    groups: dict[int, list[list]] = {}

    def put(room: int, filled: tuple, times: int) -> None:
        if times:
            if room not in groups:
                rooms.insert(bisect_left(rooms, room), room)
                groups[room] = []
            groups[room].append([filled, times])

    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                put(capacity - each * size, (size,) * each, left // each)
                if left % each:
                    put(capacity - (left % each) * size, (size,) * (left % each), 1)
                break
            room = rooms[at]
            filled, times = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = min(room // size, left)
            take = min(times, left // each)
            put(room - each * size, filled + (size,) * each, take)
            put(room, filled, times - take)
            left -= each * take
    return [(filled, times) for room in rooms for filled, times in groups[room]]


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b can be dealt into disjoint parts, each no larger than an item of a of its own: then a is never worse."""
    if a == b or sum(b) > sum(a) or len(b) > DOMINATED_ITEMS:
        return a == b  # many small items: not looked into, the filling is just kept

    def fits(k: int, rooms: tuple[int, ...]) -> bool:
        return k == len(b) or any(r >= b[k] and fits(k + 1, (*rooms[:i], r - b[k], *rooms[i + 1 :])) for i, r in enumerate(rooms))

    return fits(0, a)


def undominated(fillings: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Best fit first; fillings that an earlier one dominates are left out."""
    kept: list[tuple[int, ...]] = []
    for f in sorted(set(fillings), key=lambda f: (-sum(f), len(f), [-x for x in f])):
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept


def fillings(counts: list[int], room: int) -> Iterator[tuple[int, ...]]:
    """All maximal fillings of room with pieces of the histogram, one by one: best fit first, among equal sums the largest pieces first. Sets of
    sums that the smaller lengths reach (bit sets, multiplicities as counts) lead the way, so that no branch ends without a filling."""
    sizes = [s for s in range(1, min(room, len(counts) - 1) + 1) if counts[s]]
    full = (1 << room + 1) - 1

    def sums(sizes: list[int]) -> list[int]:
        """Entry k: the sums that the k smallest lengths reach."""
        out = [1]
        for s in sizes:
            reached, n, part = out[-1], min(counts[s], room // s), 1
            while n > 0 and reached != full:
                reached = (reached | reached << s * min(part, n)) & full
                n, part = n - part, 2 * part
            out.append(reached)
        return out

    def exactly(sizes: list[int], reach: list[int], k: int, rest: int) -> Iterator[tuple[int, ...]]:
        """Fillings of rest from the k smallest lengths. It calls itself once for each length that is used, of which 64 fill a sequence of 2048."""
        if not rest:
            yield ()
            return
        for j in range(min(k, bisect_right(sizes, rest)), 0, -1):
            if not reach[j] >> rest & 1:
                return
            s = sizes[j - 1]
            for n in range(min(counts[s], rest // s), 0, -1):
                if reach[j - 1] >> rest - n * s & 1:
                    for f in exactly(sizes, reach, j - 1, rest - n * s):
                        yield (s,) * n + f

    reach = sums(sizes)
    for total in range(room, -1, -1):
        if not reach[-1] >> total & 1:
            continue
        # What is no longer than the waste must be in, or the filling isn't maximal.
        small = bisect_right(sizes, room - total)
        forced = tuple(s for s in reversed(sizes[:small]) for _ in range(min(counts[s], room // s + 1)))
        if sum(forced) <= total:
            larger = sizes[small:]
            for f in exactly(larger, sums(larger) if small else reach, len(larger), total - sum(forced)):
                yield f + forced


def _complete(counts: np.ndarray, capacity: int, plan: Plan, bound: int, decisions: int) -> Plan:
    """Bin completion over a histogram with limited backtracking: the first turn takes the first filling everywhere, turn k may pass over k better
    choices on its way. A choice is an undominated filling around the largest piece, as often as the counts allow or (a choice of its own)
    once. Branches end when their waste shows that they can't beat the best plan; decisions bounds the fillings looked at in all turns."""
    counts = counts.tolist()
    total = sum(s * n for s, n in enumerate(counts))
    used, passed_over = sum(n for _, n in plan), 0

    def choices(top: int, most: int) -> list[tuple[tuple[int, ...], int]]:
        nonlocal decisions, cut
        out, kept = [], []
        counts[top] -= 1
        found = fillings(counts, capacity - top)
        while len(out) < most and decisions > 0 and (f := next(found, None)) is not None:
            decisions -= 1
            if not any(dominates(k, f) for k in kept):
                kept.append(f)
                out.append((top, *f))
        counts[top] += 1
        cut |= len(out) == most
        both = []
        for items in out:
            times = min(counts[x] // n for x, n in Counter(items).items())
            both += [(items, times), (items, 1)] if times > 1 else [(items, times)]
        cut |= len(both) > most
        return both[:most]

    cut = True
    while used > bound and decisions > 0 and cut:
        cut = False
        top = max(s for s, n in enumerate(counts) if n)
        # A frame: its choices, how many were tried, its largest piece, what may be passed over and what is left when it begins, waste so far.
        frames, path = [[choices(top, passed_over + 1), 0, top, passed_over, total, 0]], []
        while frames and used > bound:
            frame = frames[-1]
            options, tried, top, spare, left, waste = frame
            if len(path) == len(frames):  # back from a choice
                items, times = path.pop()
                for x in items:
                    counts[x] += times
            if tried == len(options) or decisions <= 0:
                frames.pop()
                continue
            frame[1] += 1
            items, times = options[tried]
            left -= sum(items) * times
            waste += (capacity - sum(items)) * (times - (not left))  # the last sequence may be open
            if waste > (used - 1) * capacity - total:
                continue
            path.append((items, times))
            for x in items:
                counts[x] -= times
            if left:
                while not counts[top]:
                    top -= 1
                frames.append([choices(top, spare - tried + 1), 0, top, spare - tried, left, waste])
            elif (n := sum(n for _, n in path)) < used:
                plan, used = list(path), n
        for items, times in path:  # where the search ended early
            for x in items:
                counts[x] += times
        passed_over += 1
    return plan


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, decisions: int = DECISIONS) -> Plan:
    """A packing of counts[length] pieces of each length into as few sequences as the search finds."""
    counts = counts.astype(np.int64)
    bound, plan = lower_bound(counts, capacity), best_fit(counts, capacity)
    return _complete(counts, capacity, plan, bound, decisions) if sum(n for _, n in plan) > bound else plan


def slots(plan: Plan, capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: arrays of first rank, first sequence, pieces a sequence, first offset; ranks count the pieces of that length."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for items, times in plan:
        offset = 0
        for size in sorted(set(items), reverse=True):
            each = items.count(size)
            rows.setdefault(size, []).append((rank.get(size, 0), sequence, each, offset))
            rank[size] = rank.get(size, 0) + each * times
            offset += each * size
        sequence += times
    return {size: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for size, r in rows.items()}


# --- on Spark ---------------------------------------------------------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (which has a column length, at most capacity) with sequence_id, offset and over_bound."""
    names = cut.columns
    # Rows get a number of their own as they are written, so that repeated rows are dealt out like any others.
    salted = materialize(cut.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    by_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    # At most capacity x SALTS rows, whatever the input.
    starts = by_salt.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most capacity rows
        counts[row["length"]] = row["n"]
    found = complete_bins(counts, capacity)
    over = sum(n for _, n in found) - lower_bound(counts, capacity)
    plan = slots(found, capacity)
    order = Window.partitionBy("length", "_salt").orderBy("_id")
    ranked = salted.withColumn("_row", F.row_number().over(order)).join(starts, ["length", "_salt"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        size, rank = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
        sequence, offset = np.zeros_like(size), np.zeros_like(size)
        for s in np.unique(size):
            first, start, each, place = plan[int(s)]
            here = np.flatnonzero(size == s)
            k = np.searchsorted(first, rank[here], side="right") - 1
            nth = rank[here] - first[k]
            sequence[here], offset[here] = start[k] + nth // each[k], place[k] + nth % each[k] * s
        columns = [rows.column(rows.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked, batch, schema).withColumn("over_bound", F.lit(over).cast("bigint"))


def pack_documents(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place: key, piece, start, length, ids_crc32, sequence_id, offset, over_bound."""
    return pack(pieces(df, path or vocabulary_path(), key, text, capacity), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
