"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams (three to six, with word ends marked) and of the word
itself. A text has two bags: the mean of all its words' vectors, and the mean over its worst window of neighbouring words, so that a few abusive
words in a long text are not averaged away. One two-class linear softmax reads both. Vectors and softmax are trained jointly in numpy
on labelled texts: at first all windows of a text share its gradient by their softmax weights, later its worst window takes it. Words
that were never seen share n-grams with seen ones, so inflections and misspellings get their scores.

The fit uses a bounded sample of labelled rows: SAMPLE_TOXIC and SAMPLE_CLEAN of them, taken by a hash of the id, in full whatever their
length. It runs in one task, which reads its texts batch by batch and keeps word numbers only; its weights come back as one row of a fixed
size. Training takes rows with crc32(id as text) mod FOLDS other than 0 only; scoring covers every text in full.

Defined results: a null or empty text has no words and gets the score of the bias alone; labels that are null are no labels; an id
with several labels counts as toxic if any says so; of rows that share a chosen id the one with the smallest text is trained on; with no labels of one class every
score is that class's share (none at all: 0.5 per million); an empty table gives an empty result; a long text costs memory in proportion to itself;
repeated rows get equal scores; other columns, also such with clashing names, are never read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, Memo, empty_idle_memos, map_arrow, table, text_or_empty

FOLDS = 5
SAMPLE_TOXIC, SAMPLE_CLEAN = 1_000, 4_000
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (3, 6)
WINDOW, STRIDE = 4, 2
EPOCHS, SOFT_EPOCHS, RATE, DECAY, SEED = 120, 50, 0.05, 1e-5, 7
#: Subwords that the fit turns to at once.
BLOCK = 1 << 19
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word itself and of its n-grams."""
    marked = f"<{word}>"
    least, most = GRAMS
    grams = [marked[i : i + k] for k in range(least, most + 1) for i in range(len(marked) - k + 1) if k < len(marked)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in (f"={marked}", *grams)]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of n words: every STRIDE words, and one that ends with the text; one window for fewer than WINDOW."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def window_means(scores: np.ndarray) -> np.ndarray:
    """The mean of each window of word scores."""
    starts = window_starts(len(scores))
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    ends = np.minimum(starts + WINDOW, len(scores))
    return (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)


@dataclass
class Model:
    """vectors: (buckets, width); softmax: (2 x width, 2), for the worst window's mean and for the whole text's; bias: (2,)."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    @functools.cached_property
    def by_bucket(self) -> np.ndarray:
        """How far each bucket's vector moves the odds of class 1, in a window (real part) and in the whole text (imaginary part): the softmax is
        linear, so means of these are what it makes of the means of vectors."""
        odds = (self.softmax[:, 1] - self.softmax[:, 0]).astype(np.float64).reshape(2, -1)
        return self.vectors @ odds[0] + 1j * (self.vectors @ odds[1])

    def word_score(self, word: str) -> complex:
        return complex(self.by_bucket[subwords(word, len(self.by_bucket))].mean())

    def score(self, text: str, known) -> float:
        """The probability of class 1. known: word -> word_score."""
        words = words_of(text)
        z = float(self.bias[1] - self.bias[0])
        if words:
            scores = np.fromiter(map(known.__getitem__, words), np.complex128, len(words))
            z += float(window_means(scores.real).max()) + float(scores.imag.mean())
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, z))))

    def packed(self) -> bytes:
        return b"".join(x.astype("<f2" if x is self.vectors else "<f4").tobytes() for x in (self.vectors, self.softmax, self.bias))

    @staticmethod
    def unpacked(raw: bytes) -> Model:
        cut = 2 * BUCKETS * WIDTH
        rest = np.frombuffer(raw, "<f4", offset=cut)
        return Model(np.frombuffer(raw[:cut], "<f2").reshape(BUCKETS, WIDTH).astype(np.float32), rest[:-2].reshape(-1, 2), rest[-2:])


def fit(rows: Iterable[tuple[str, int]]) -> Model:
    """Train vectors and softmax jointly by Adam on the bags of (text, label) rows; deterministic. Texts are read one by one and not kept."""
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (2 * WIDTH, 2)).astype(np.float32)
    index: dict[str, int] = {}
    docs, found, labels = [], [], []
    for text, label in rows:
        labels.append(label)
        numbers = np.fromiter((index.setdefault(w, len(index)) for w in words_of(text)), np.int32)
        if len(numbers):
            docs.append(numbers)
            found.append(label)
    share = min(max(sum(labels) / len(labels) if labels else 0.0, 1e-6), 1 - 1e-6)
    bias = np.array([math.log(1 - share), math.log(share)], np.float32)
    if len(set(labels)) < 2 or not docs:
        return Model(np.zeros_like(vectors), softmax, bias)
    y = np.array(found, np.float64)
    packed, n_subs, n_words = array("i"), np.empty(len(index), np.int64), len(index)  # no lists of Python numbers: there are millions
    for k, w in enumerate(index):
        parts = subwords(w)
        packed.extend(parts)
        n_subs[k] = len(parts)
    index.clear()
    flat_subs, sub_starts = np.frombuffer(packed, np.int32), np.concatenate(([0], np.cumsum(n_subs)[:-1]))
    edges = [*np.unique(np.searchsorted(sub_starts, np.arange(0, len(flat_subs), BLOCK))), n_words]
    blocks = [(i, j, sub_starts[i], sub_starts[j] if j < n_words else len(flat_subs)) for i, j in zip(edges, edges[1:], strict=False)]
    lengths = np.array([len(d) for d in docs])
    tokens = np.concatenate(docs, dtype=np.int64)
    docs.clear()
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    windows = np.array([len(window_starts(n)) for n in lengths])
    window_from = np.concatenate([window_starts(n) + o for n, o in zip(lengths, offsets, strict=False)])
    window_to = np.minimum(window_from + WINDOW, np.repeat(offsets[1:], windows))
    widths = (window_to - window_from).astype(np.int8)
    doc_starts = np.concatenate(([0], np.cumsum(windows)[:-1]))
    doc_of = np.repeat(np.arange(len(lengths)), windows)
    line = np.empty(len(tokens) + 1)  # one number a word, used again and again: there are as many as memory is needed for
    weight = np.where(y == 1, 0.35 / max(y.sum(), 1), 0.65 / max((1 - y).sum(), 1))
    state = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, t: int) -> None:
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    def words(direction: np.ndarray) -> np.ndarray:
        by_bucket, sums = vectors @ direction, np.empty(n_words)
        for i, j, start, end in blocks:
            sums[i:j] = np.add.reduceat(by_bucket[flat_subs[start:end]], sub_starts[i:j] - start)
        return sums / n_subs

    def by_place(by_word: np.ndarray) -> None:
        line[0] = 0
        np.take(by_word, tokens, out=line[1:], mode="clip")

    def buckets(by_token: np.ndarray) -> np.ndarray:
        by_word = (np.bincount(tokens, by_token, n_words) / n_subs).astype(np.float32).astype(np.float64)
        sums = np.zeros(BUCKETS)
        for i, j, start, end in blocks:  # what is summed so far comes first, so all is added in the same order as at once
            sums = np.bincount(np.concatenate((np.arange(BUCKETS), flat_subs[start:end])), np.concatenate((sums, np.repeat(by_word[i:j], n_subs[i:j]))), BUCKETS)
        return sums.astype(np.float32)

    for t in range(1, EPOCHS + 1):
        near, far = (softmax[:, 1] - softmax[:, 0]).reshape(2, -1)
        by_place(words(near))
        np.cumsum(line, out=line)
        z = line[window_to]
        z -= line[window_from]
        z /= widths
        top = np.maximum.reduceat(z, doc_starts)
        z -= top[doc_of]
        share_of = np.exp(np.minimum(z, 0, out=z), out=z) if t <= SOFT_EPOCHS else (z >= 0).astype(np.float64)
        share_of /= np.add.reduceat(share_of, doc_starts)[doc_of]
        by_place(words(far))
        whole = np.add.reduceat(line[1:], offsets[:-1]) / lengths
        odds = top + whole + float(bias[1] - bias[0])
        error = (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y) * weight  # of class 1; class 0 has its negative
        dz = share_of  # in its place
        dz *= error[doc_of]
        dz /= widths
        line[:] = 0
        np.add.at(line, window_from, dz)
        np.subtract.at(line, window_to, dz)
        np.cumsum(line, out=line)
        pulls = [buckets(line[:-1])]
        for start, end, each in zip(offsets, offsets[1:], error / lengths, strict=False):
            line[start:end] = each
        pulls.append(buckets(line[:-1]))
        pull = np.concatenate([vectors.T @ p for p in pulls])
        adam("softmax", softmax, np.stack([-pull, pull], 1), t)
        adam("vectors", vectors, np.outer(pulls[0], near) + np.outer(pulls[1], far) + DECAY * vectors, t)
        total = float(error.sum())
        adam("bias", bias, np.array([-total, total], np.float32), t)
    return Model(vectors, softmax, bias)


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(_label, _text), the bounded sample: per class, the labelled ids with the smallest hashes outside the held-out fold, and their texts. Ids are
    chosen from the narrow table of labels, so texts are neither shuffled nor sorted: at most SAMPLE_TOXIC + SAMPLE_CLEAN ids go out to the scan."""
    marked = labels.filter(F.col(label).isNotNull() & (fold_of(F.col(key)) != 0)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    first = lambda value, most: marked.filter(F.col("_label") == value).orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)
    chosen = first(1, SAMPLE_TOXIC).unionByName(first(0, SAMPLE_CLEAN))
    rows = docs.select(key, text_or_empty(text).alias("_text")).join(F.broadcast(chosen), key)
    return rows.groupBy(key, "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")


def fit_sample(sample: DataFrame) -> Model:
    """fit in one task over the bounded sample; the driver sees one row of a fixed size."""

    def train(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        empty_idle_memos()
        parts = (batch.slice(at, BATCH_ROWS) for batch in batches for at in range(0, batch.num_rows, BATCH_ROWS))
        rows = ((t, y) for part in parts for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).packed()], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions("_label", "_text").mapInArrow(train, "model binary").collect()
    return Model.unpacked(bytes(found[0]["model"])) if found else fit([])


#: A worker's copy of the last model and its word scores, by the digest of the model.
_known: dict[str, tuple[Model, Memo]] = {}


def scorer(model: Model):
    """A function of texts that gives their scores on executors. The model has a fixed size and travels with the function, so it goes when
    the query that uses it does."""
    raw = model.packed()
    name = hashlib.sha256(raw).hexdigest()

    def scores(texts: list[str | None]) -> list[float]:
        if name not in _known:
            _known.clear()
            here = Model.unpacked(raw)
            _known[name] = here, Memo(here.word_score)
        here, known = _known[name]
        return [here.score(t or "", known) for t in texts]

    return scores


def score_column(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    scores = scorer(model)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores(rows.column(1).to_pylist()), pa.float64())], names=[key, "score"])

    return map_arrow(df.select(key, F.col(text).alias("_text")), batch, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def keep_clean(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that score below threshold, whole, without a join: the filter runs on the rows themselves."""
    scores, at = scorer(model), df.columns.index(text)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pa.array([s < threshold for s in scores(rows.column(at).to_pylist())], pa.bool_()))

    return map_arrow(df, batch, df.schema)


def fit_on(spark: SparkSession, sf_dir: str) -> Model:
    return fit_sample(training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_column(table(spark, sf_dir, "documents"), fit_on(spark, sf_dir))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
