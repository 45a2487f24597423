"""Media columns and signature sniffing.

A payload is stored losslessly as 8-bit mono PCM in a RIFF/WAVE file. ``sniff`` reads only stored bytes: an Aho-Corasick automaton
locates magic bytes, validators walk each candidate's structure and give its length, the declared type is corrected by what
stands at offset 0, and confirmed files inside are carved.

Defined results: a null value counts as empty bytes; bytes without a confirmed file at offset 0 have the type
``application/octet-stream``; equal bytes get equal results, repeated rows equal rows; an empty table gives an empty result; a file that is confirmed inside
another one is reported with its own offset; a long value costs memory in proportion to itself (but each GIF magic in it is walked by itself); only the
named columns are read, so further ones with clashing names don't matter. A PDF's length is that of its first end mark, a FLAC stream's lasts to the end
of the value: neither format tells its length.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, table, text_or_empty

UNIT = 64
SAMPLE_RATE = 8000
UNKNOWN = "application/octet-stream"


def to_payload(text: str) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_wav(samples: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples. Chunks have even lengths, as the format asks."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + bytes(len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(media: bytes) -> bytes:
    """The samples of a stored file: its data chunk."""
    at = 12
    while at + 8 <= len(media):
        length = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + length]
        at += 8 + length + length % 2
    raise ValueError("no data chunk")


# Validators: (bytes, offset) -> (type, length), or None if the structure doesn't hold.


def _riff(b: bytes, at: int):
    if len(b) < at + 12:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[at + 8 : at + 12])
    if not kind or end > len(b):
        return None
    seen, p = set(), at + 12
    while p + 8 <= end:
        length = int.from_bytes(b[p + 4 : p + 8], "little")
        seen.add(b[p : p + 4])
        p += 8 + length + length % 2
        if p > end:
            return None
    if p != end or (kind == "audio/wav" and not {b"fmt ", b"data"} <= seen) or not seen:
        return None
    return kind, end - at


def _png(b: bytes, at: int):
    p, first = at + 8, True
    while p + 12 <= len(b):
        length = int.from_bytes(b[p : p + 4], "big")
        end = p + 12 + length
        if end > len(b) or (first and b[p + 4 : p + 8] != b"IHDR") or zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if b[p + 4 : p + 8] == b"IEND":
            return "image/png", end - at
        p, first = end, False
    return None


def _gif(b: bytes, at: int):
    if len(b) < at + 13:
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int):
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        mark = b[p + 1]
        if mark == 0xD9:
            return "image/jpeg", p + 2 - at
        if mark == 0xFF:
            p += 1
            continue
        if mark == 0xDA:  # coded data: up to the next marker that is neither stuffing nor a restart
            p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if b[p + 1] == 0xD9:
                return "image/jpeg", p + 2 - at
            continue
        length = int.from_bytes(b[p + 2 : p + 4], "big")
        if length < 2:
            return None
        p += 2 + length
    return None


def _bmp(b: bytes, at: int):
    if len(b) < at + 30:
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    if zero or head not in (12, 40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or not 14 + head <= offset <= size or at + size > len(b):
        return None
    return "image/bmp", size


@functools.lru_cache(8)
def _places(b: bytes, mark: bytes) -> list[int]:
    """Where a mark stands: looked for once in a file, however many files may begin in it."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


def _next(b: bytes, mark: bytes, at: int) -> int:
    places = _places(b, mark)
    k = bisect_left(places, at)
    return places[k] if k < len(places) else len(b)


def _pdf(b: bytes, at: int):
    end = _next(b, b"%%EOF", at)
    if end == len(b) or _next(b, b" obj", at) >= end or _next(b, b"startxref", at) >= end:
        return None
    return "application/pdf", end + 5 - at


def _zip(b: bytes, at: int):
    p = at
    while b[p : p + 4] == b"PK\3\4" and p + 30 <= len(b):
        flags, size = struct.unpack_from("<H", b, p + 6)[0], struct.unpack_from("<I", b, p + 18)[0]
        name, extra = struct.unpack_from("<HH", b, p + 26)
        if flags & 8:
            return None  # lengths stand behind the data
        p += 30 + name + extra + size
    start = p
    while b[p : p + 4] == b"PK\1\2" and p + 46 <= len(b):
        p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
    if p == start or b[p : p + 4] != b"PK\5\6" or p + 22 > len(b):
        return None
    return "application/zip", p + 22 + struct.unpack_from("<H", b, p + 20)[0] - at


def _gzip(b: bytes, at: int):
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    stream, p = zlib.decompressobj(31), at
    try:
        while not stream.eof and p < len(b):
            left = b[p : p + 65536]
            p += len(left)
            while left and not stream.eof:
                stream.decompress(left, 1 << 20)
                left = stream.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", p - len(stream.unused_data) - at) if stream.eof else None


def _ogg(b: bytes, at: int):
    p = at
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and not b[p + 4]:
        n, last = b[p + 26], b[p + 5] & 4
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if last:
            return "audio/ogg", p - at
    return None


def _flac(b: bytes, at: int):
    p = at + 4
    if len(b) < p + 38 or b[p] & 0x7F or int.from_bytes(b[p + 1 : p + 4], "big") != 34:
        return None
    while p + 4 <= len(b):
        last, length = b[p] & 0x80, int.from_bytes(b[p + 1 : p + 4], "big")
        p += 4 + length
        if last:
            return ("audio/flac", len(b) - at) if p + 1 < len(b) and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else None
    return None


def _mp4(b: bytes, at: int):
    start = p = at - 4
    if start < 0:
        return None
    seen = set()
    while p + 8 <= len(b):
        length, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"styp", b"sidx", b"uuid", b"meta") or length < 8 or p + length > len(b):
            break
        seen.add(kind)
        p += length
    return ("video/mp4", p - start) if {b"ftyp"} < seen else None


def _midi(b: bytes, at: int):
    if len(b) < at + 14 or int.from_bytes(b[at + 4 : at + 8], "big") != 6:
        return None
    tracks, p = int.from_bytes(b[at + 10 : at + 12], "big"), at + 14
    for _ in range(tracks):
        if b[p : p + 4] != b"MTrk" or p + 8 > len(b):
            return None
        p += 8 + int.from_bytes(b[p + 4 : p + 8], "big")
    return ("audio/midi", p - at) if tracks and p <= len(b) else None


#: Magic bytes, where the file starts relative to them, and the validator.
MAGIC = {
    b"RIFF": (0, _riff), b"\x89PNG\r\n\x1a\n": (0, _png), b"GIF87a": (0, _gif), b"GIF89a": (0, _gif), b"\xff\xd8\xff": (0, _jpeg), b"BM": (0, _bmp),
    b"%PDF-": (0, _pdf), b"PK\3\4": (0, _zip), b"\x1f\x8b\x08": (0, _gzip), b"OggS": (0, _ogg), b"fLaC": (0, _flac), b"ftyp": (-4, _mp4), b"MThd": (0, _midi),
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, (shift, validator) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), shift, validator))
    found.make_automaton()
    return found


def find_media(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed file, by offset. A file whose kind has no length of its own hides nothing else."""
    found, pages_to = [], {}
    for end, (length, shift, validator) in automaton().iter(b.decode("latin-1")):
        magic_at = end + 1 - length
        if magic_at < pages_to.get(validator, 0):
            continue  # a later page or entry of the same confirmed stream
        if hit := validator(b, magic_at):
            found.append((magic_at + shift, hit[1], hit[0]))
            if validator in (_ogg, _zip):
                pages_to[validator] = magic_at + hit[1]
    _places.cache_clear()
    return sorted(found)


def sniff(df: DataFrame, media: str, declared: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """carry's columns, the column media, and declared_type, media_type, corrected, carved: array of (offset, length, media_type, sha256)."""
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = (head + ", " if head else "") + f"`{media}` binary, declared_type string, media_type string, corrected boolean, carved array<struct<offset:bigint,length:bigint,media_type:string,sha256:string>>"
    carved_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("sha256", pa.string())]))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        said = rows.column(len(carry) + 1).to_pylist()
        kinds, corrected, carved = [], [], []
        for value, claim in zip(rows.column(len(carry)), said, strict=True):
            b = value.as_py() or b""
            files = find_media(b)
            kind = next((t for at, _, t in files if at == 0), UNKNOWN)
            kinds.append(kind)
            corrected.append(claim is not None and claim != kind)
            carved.append([{"offset": at, "length": n, "media_type": t, "sha256": hashlib.sha256(b[at : at + n]).hexdigest()} for at, n, t in files if at])
        own = [pa.array(kinds, pa.string()), pa.array(corrected, pa.bool_()), pa.array(carved, carved_type)]
        return pa.RecordBatch.from_arrays([*rows.columns, *own], names=[*carry, media, "declared_type", "media_type", "corrected", "carved"])

    claim = F.col(declared) if declared else F.lit(None).cast("string")
    return map_arrow(df.select(*carry, media, claim.alias("declared_type")), batch, schema)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (unpadded), media: the stored file, declared_type: what a text column would be taken for."""
    kind = df.schema[key].dataType.simpleString()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(1).to_pylist()
        lengths = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(0), lengths, pa.array([to_wav(to_payload(t)) for t in texts], pa.binary()), pa.array(["text/plain"] * len(texts))], names=[key, "n_bytes", "media", "declared_type"])

    return map_arrow(df.select(key, text_or_empty(text).alias("_text")), batch, f"{key} {kind}, n_bytes bigint, media binary, declared_type string")


def digest(df: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """From sniffed files: the payload read back and its digests, and a feature string of type, samples and embedded files."""
    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = head + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = len(carry)
        out: list[list] = [[] for _ in range(6)]
        for value, kind, corrected, carved in zip(rows.column(n), rows.column(n + 1).to_pylist(), rows.column(n + 2).to_pylist(), rows.column(n + 3).to_pylist(), strict=True):
            media = value.as_py()
            if kind != "audio/wav":
                raise ValueError(f"a stored file reads as {kind}")
            payload = wav_samples(media)
            inside = ";".join(f"{c['media_type']}@{c['offset']}+{c['length']}" for c in carved)
            zeros = payload.count(0)
            feature = f"{kind};rate={SAMPLE_RATE};bits=8;samples={len(payload)};zeros={zeros};corrected={int(corrected)};embedded={len(carved)}" + (f";{inside}" if inside else "")
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        return pa.RecordBatch.from_arrays([*rows.columns[:n], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[*carry, *names])

    return map_arrow(df.select(*carry, "media", "media_type", "corrected", "carved"), batch, schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents"))
    return digest(sniff(stored, "media", "declared_type", carry=("doc_id", "n_bytes")), ("doc_id", "n_bytes"))
