"""Quality classifier by positive-unlabelled learning: trusted good texts against unlabelled web text, of which an estimated share is good as well.

A text becomes shares that don't depend on its length (symbols, capitals, digits, words without letters, repeated neighbours, different words in a window,
repeated lines, word length), each put into one of a few bins, and a bag of the shapes of neighbouring words. A linear model over both is trained in numpy
by the non-negative unbiased risk of positive-unlabelled learning: with the class prior p, risk = p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]) under the sigmoid
loss, which is bounded, so that a prior that is slightly off can't outweigh the texts of low quality; where the second part falls below 0, the step goes up it
instead, so that the model can't fit the unlabelled texts by heart. No negative label is ever used.

The class prior is estimated from the same two samples: a plain model tells positives from unlabelled texts on one half, and on the other half
the prior is the least ratio of the shares of unlabelled and of positive texts above a score, over all scores, with an allowance for the sample's size; both halves
take turns.

The fit uses a bounded sample: at most SAMPLE_POSITIVE labelled good texts with crc32(id as text) mod FOLDS other than 0 and SAMPLE_UNLABELLED texts without a label,
taken by a hash of the id, in full whatever their length. It runs in one task and comes back as one row of a fixed size. Scoring covers every text in full, row by
row, without a shuffle.

Defined results: a null or empty text has no words, all its shares are 0, and it is scored by these; an id with several labels is good if any says
so; labels that are null are no labels; of rows that share a chosen id the smallest text is trained on; without any trusted positive every score is 1e-6, without any
unlabelled text it is 1 - 1e-6; an empty table gives an empty result; repeated rows get equal scores; other columns, also such with clashing
names, are never read.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import MEMO_ENTRIES, map_arrow, table, text_or_empty
from tidemark.llm.toxicity import FOLDS, fold_of

SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 4_000, 8_000
SHAPES, WINDOW = 1024, 20
#: Where a statistic's values are cut into bins: finely at both ends, where texts of low quality lie.
CUTS = (0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.94, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995)
BINS = len(CUTS) + 1
EPOCHS, PRIOR_EPOCHS, RATE, DECAY, SEED = 300, 120, 0.05, 1e-4, 12
#: Columns of the table of words: bucket of the shape, characters, capitals, small letters, digits, others, ends with a symbol, has no letter or digit.
COLUMNS = 8
STATISTICS = ("symbols", "capitals", "digits", "no_letters", "symbol_ends", "repeats", "distinct", "same_lines", "length")
RUNS = re.compile(r"(.)\1+")


def word_row(word: str) -> tuple:
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    shape = RUNS.sub(r"\1+", kinds)
    upper, lower, digits = kinds.count("X"), kinds.count("x"), kinds.count("9")
    others = len(kinds) - upper - lower - digits
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES, len(word), upper, lower, digits, others, word[-1] not in ".,;:?'\")" and kinds[-1] not in "Xx9", others == len(kinds)


@dataclass
class Words:
    """Rows of words that were met before; emptied between texts once there are too many."""

    places: dict = field(default_factory=dict)
    n: int = 0
    known: np.ndarray = field(default_factory=lambda: np.zeros((0, COLUMNS), np.float32))

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, rows by place)."""
        if len(self.places) >= MEMO_ENTRIES:
            self.places.clear()
            self.n = 0
        at = np.fromiter((self.places.setdefault(w, len(self.places)) for w in words), np.int64, len(words))
        if len(self.places) > self.n:
            new = [word_row(w) for w in dict.fromkeys(words) if self.places[w] >= self.n]
            if len(self.places) > len(self.known):
                grown = np.zeros((2 * len(self.places), COLUMNS), np.float32)
                grown[: self.n] = self.known[: self.n]
                self.known = grown
            self.known[self.n : len(self.places)] = new
            self.n = len(self.places)
        return at, self.known


def text_features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, bag of shape pairs with sum 1) of a text; zeros without words."""
    found = text.split()
    if not found:
        return np.zeros(len(STATISTICS)), np.zeros(SHAPES, np.float32)
    at, known = words.of(found)
    rows = known[at]
    n = len(at)
    total = rows[:, 1:].sum(axis=0, dtype=np.float64)
    chars, upper, lower, digits, others = total[:5]
    full = n // WINDOW
    if full:
        windows = np.sort(at[: full * WINDOW].reshape(full, WINDOW), axis=1)
        distinct = (1 + (windows[:, 1:] != windows[:, :-1]).sum(axis=1)).mean() / WINDOW
    else:
        distinct = len(set(found)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    same = 1 - len(set(lines)) / len(lines)
    repeats = float((at[1:] == at[:-1]).mean()) if n > 1 else 0.0
    statistics = np.array([others / chars, upper / max(upper + lower, 1), digits / chars, total[6] / n, total[5] / n, repeats, distinct, same, chars / n])
    shapes = rows[:, 0].astype(np.int64)
    pairs = (shapes * 31 + np.append(shapes[1:], 0)) % SHAPES
    return statistics, np.bincount(pairs, minlength=SHAPES).astype(np.float32) / n


@dataclass
class Model:
    """edges: inner bin edges by statistic (padded with infinity); bins: weights by statistic and bin; shapes: weights of the bag; bias; prior."""

    edges: np.ndarray
    bins: np.ndarray
    shapes: np.ndarray
    bias: float
    prior: float

    def score(self, text: str, words: Words) -> float:
        statistics, bag = text_features(text, words)
        z = self.bias + float(bag @ self.shapes) + sum(self.bins[k, np.searchsorted(e, statistics[k], "right")] for k, e in enumerate(self.edges))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, edges=self.edges, bins=self.bins, shapes=self.shapes, rest=np.array([self.bias, self.prior]))
        return out.getvalue()

    @staticmethod
    def unpacked(raw: bytes) -> Model:
        x = np.load(io.BytesIO(raw))
        return Model(x["edges"], x["bins"], x["shapes"], float(x["rest"][0]), float(x["rest"][1]))


def constant(share: float) -> Model:
    k = len(STATISTICS)
    return Model(np.full((k, BINS - 1), np.inf), np.zeros((k, BINS)), np.zeros(SHAPES), float(np.log(share / (1 - share))), share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def descend(x: np.ndarray, pull, epochs: int) -> np.ndarray:
    """Adam from 0; pull(scores) is the risk's gradient by score. The last column of x is the bias."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    decay = np.full(x.shape[1], DECAY)
    decay[-1] = 0
    for t in range(1, epochs + 1):
        g = x.T @ pull(x @ w.astype(np.float32)).astype(np.float32) + decay * w
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def plain_fit(x: np.ndarray, positive: np.ndarray, epochs: int) -> np.ndarray:
    """Logistic regression of positives against unlabelled rows, both sides weighing the same."""
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    return descend(x, lambda z: (sigmoid(z) - positive) * weight, epochs)


def class_prior(x: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, by the least ratio of the shares above a score; mean over both halves."""
    half = np.random.default_rng(SEED).random(len(x)) < 0.5
    found = []
    for train in (half, ~half):
        if not (positive & train).any() or not (~positive & train).any() or not (positive & ~train).any() or not (~positive & ~train).any():
            continue
        z = x[~train] @ plain_fit(x[train], positive[train], PRIOR_EPOCHS)
        p, u = np.sort(z[positive[~train]]), np.sort(z[~positive[~train]])
        above_p = 1 - np.searchsorted(p, p, "left") / len(p)
        above_u = 1 - np.searchsorted(u, p, "left") / len(u)
        slack = np.sqrt(np.log(20) / (2 * len(u))) + np.sqrt(np.log(20) / (2 * len(p)))
        k = int(np.argmin((above_u + slack) / above_p))
        found.append(above_u[k] / above_p[k])
    return float(np.clip(np.mean(found) if found else 0.5, 0.01, 0.99))


def risk_fit(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int) -> np.ndarray:
    """The non-negative risk's minimum."""
    n_p, n_u = positive.sum(), (~positive).sum()

    def pull(z: np.ndarray) -> np.ndarray:
        s = sigmoid(z)
        slope = s * (1 - s)
        negative = s[~positive].mean() - prior * s[positive].mean()
        of_negative = np.where(positive, -prior * slope / n_p, slope / n_u)
        return of_negative - np.where(positive, prior * slope / n_p, 0) if negative >= 0 else -of_negative

    return descend(x, pull, epochs)


def fit(rows: Iterable[tuple[str, int]]) -> Model:
    """Fit to (text, 1 for a trusted positive or 0 for an unlabelled text); deterministic. Texts are read one by one and not kept."""
    words, statistics, bags, marks = Words(), [], [], []
    for text, mark in rows:
        s, bag = text_features(text, words)
        statistics.append(s)
        bags.append(bag)
        marks.append(mark)
    positive = np.array(marks, bool)
    if not positive.any():
        return constant(1e-6)
    if positive.all():
        return constant(1 - 1e-6)
    values = np.stack(statistics)
    edges = np.full((len(STATISTICS), BINS - 1), np.inf)
    parts = []
    for k in range(len(STATISTICS)):
        cuts = np.unique(np.quantile(values[:, k], CUTS))
        edges[k, : len(cuts)] = cuts
        parts.append(np.eye(BINS, dtype=np.float32)[np.searchsorted(edges[k], values[:, k], "right")])
    x = np.concatenate([*parts, np.stack(bags), np.ones((len(values), 1), np.float32)], axis=1).astype(np.float32)
    prior = class_prior(x, positive)
    w = risk_fit(x, positive, prior, EPOCHS)
    cut = len(STATISTICS) * BINS
    return Model(edges, w[:cut].reshape(-1, BINS), w[cut:-1], float(w[-1]), prior)


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(_mark, _text), the bounded sample: labelled positives outside the held-out fold, and texts that no label knows. Ids are chosen from narrow rows by
    their hash, so texts are neither shuffled nor sorted; at most SAMPLE_POSITIVE + SAMPLE_UNLABELLED ids go out to the scan."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    first = lambda df, most: df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)
    good = first(known.filter((F.col("_label") == 1) & (fold_of(F.col(key)) != 0)).select(key), SAMPLE_POSITIVE).withColumn("_mark", F.lit(1))
    rest = docs.filter(F.col(key).isNotNull()).select(key).join(known.select(key), key, "left_anti").distinct()
    chosen = good.unionByName(first(rest, SAMPLE_UNLABELLED).withColumn("_mark", F.lit(0)))
    rows = docs.select(key, text_or_empty(text).alias("_text")).join(F.broadcast(chosen), key)
    return rows.groupBy(key, "_mark").agg(F.min("_text").alias("_text")).select("_mark", "_text")


def fit_sample(sample: DataFrame) -> Model:
    """fit in one task over the bounded sample; the driver sees one row of a fixed size."""

    def train(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = ((b.column(1)[k].as_py(), b.column(0)[k].as_py()) for b in batches for k in range(b.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).packed()], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions("_mark", "_text").mapInArrow(train, "model binary").collect()
    return Model.unpacked(bytes(found[0]["model"])) if found else fit([])


#: A worker's copy of the last model, by its digest.
_known: dict[str, tuple[Model, Words]] = {}


def score_column(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    raw = model.packed()
    name = hashlib.sha256(raw).hexdigest()

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        if name not in _known:
            _known.clear()
            _known[name] = Model.unpacked(raw), Words()
        here, words = _known[name]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([here.score(rows.column(1)[k].as_py() or "", words) for k in range(rows.num_rows)], pa.float64())], names=[key, "score"])

    return map_arrow(df.select(key, F.col(text).alias("_text")), batch, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def fit_on(spark: SparkSession, sf_dir: str) -> Model:
    return fit_sample(training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_column(table(spark, sf_dir, "documents"), fit_on(spark, sf_dir))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
