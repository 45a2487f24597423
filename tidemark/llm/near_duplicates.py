"""Near duplicates by SetSketch registers.

A document's set holds its distinct five-word shingles as 64-bit hashes. Its sketch has M registers of exponentially spaced truncated
minima: mergeable (the register-wise maximum is the union's sketch) and locality sensitive. The steps, all on Spark:

1. one pass over the texts gives each document's set size, the digest of its set and its sketch; equal sets are one node from here on;
2. bands of registers are hashed; nodes that share a band's bucket are candidates;
3. a set's intersection with any other is bounded by its elements that occur in other candidate sets; members and pairs that
   can't reach the threshold by that bound are left out, which is exact and frees large groups of copies with many edits of their own;
   in each bucket that still holds several components, members are compared with a few chosen ones, the most popular first (a member of
   many large buckets is most likely what the others are copies of), so a group of k copies costs k pairs and not their square;
4. a pair is estimated jointly by likelihood from both sketches and their set sizes, and its intersection is bounded by the parity maps of both sets,
   which is exact; the hopeless ones go, the rest are confirmed on full sets;
5. confirmed links join components, chosen members leave their buckets, and the number of chosen ones grows until no bucket is left with
   two components. Every pair that shares a bucket is thereby compared, already connected or out of reach.

With M = 193 registers in 32 bands of 6, a pair at the threshold of 0.85 is missed with probability (1 - 0.85^6)^32 < 4e-7; the estimate's
margin of 0.15 is more than five standard errors.

Defined results: a text with fewer than five words is one shingle as a whole; a null or empty text has an empty set, is linked with nothing and is kept;
repeated rows are copies of each other; texts are told by their sets, so an id with several texts keeps the links of each (its rows may then
have different components); null ids are no smallest id but lose no link; ids of any type that can be ordered; an empty table gives an empty result; a
long text costs memory in proportion to itself; other columns, also such with clashing names, are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import FEW_ENTRIES, Memo, map_arrow, materialize, table, text_or_empty

SHINGLE = 5
#: Per cent of the union that the intersection must have.
LEAST_PERCENT = 85
BANDS, ROWS = 32, 6
#: Registers; a prime, so that steps through them visit all.
M = 193
BASE, RATE, TOP = 1.02, 20.0, 2000
MARGIN = 0.15
#: Bits of a set's parity map. Sets of some thousand elements still leave it far from saturated; larger ones only lose its help.
PARITY = 2048
#: Nodes or pairs up to which a list of ids is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 300_000
#: Members of a bucket that one task compares with the chosen ones.
PART_ROWS = 1_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_word_hashes = Memo(xxhash.xxh3_64_intdigest, FEW_ENTRIES)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes. bytes.lower and bytes.split know ASCII letters and ASCII white space only, as is wanted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    mixed = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        mixed = (mixed + h[k : n - width + 1 + k]) * _PRIME
        mixed ^= mixed >> np.uint64(29)
    return np.unique(_mix(mixed))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, M) registers. An element's values ascend and go to registers in an order of its own; it stops when its next value is beyond
    every register's minimum, so large sets cost little more than one value an element."""
    out = np.zeros((len(sets), M), np.int16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    minima = np.full(len(sets) * M, np.inf)
    element = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    at = (_mix(element ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(M)).astype(np.int64)
    step = 1 + (_mix(element ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(M - 1)).astype(np.int64)
    value = np.zeros(len(element))
    for j in range(M):
        uniform = ((_mix(element + np.uint64((j + 1) * int(_PRIME) % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        value = value - np.log(uniform) / (RATE * (M - j))
        beyond = minima.reshape(-1, M).max(1)
        go = value <= beyond[row]
        element, row, at, step, value = element[go], row[go], at[go], step[go], value[go]
        if not len(element):
            break
        np.minimum.at(minima, row * M + at, value)
        at = (at + step) % M
    with np.errstate(divide="ignore"):
        registers = np.floor(1 - np.log(minima) / math.log(BASE))
    out[:] = np.clip(np.nan_to_num(registers, neginf=0), 0, TOP).reshape(-1, M).astype(np.int16)
    return out


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that a register decides for a side that has the share x of the union to itself."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows of a and b) of sets of known sizes, on a grid of 1/200."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)[None, :]
    p, q = _share(np.maximum(u - v * j, 1e-12)), _share(np.maximum(v - u * j, 1e-12))
    likelihood = above * np.log(p) + below * np.log(q) + (M - above - below) * np.log(np.maximum(1 - p - q, 1e-12))
    return np.take_along_axis(j, likelihood.argmax(1)[:, None], 1)[:, 0]


def parity_map(elements: np.ndarray) -> bytes:
    """For each of PARITY residues, whether an odd number of elements has it. Two maps differ in no more places than the sets differ in elements."""
    residues = (_mix(elements ^ np.uint64(0x3C3C3C3C3C3C3C3C)) % np.uint64(PARITY)).astype(np.int64)
    return np.packbits(np.bincount(residues, minlength=PARITY) & 1).tobytes()


def sketch_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, digest (of the set; null if empty) and sketch (little-endian 16-bit registers; null if empty)."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_shingles bigint, digest string, sketch binary"

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in rows.column(1).to_pylist()]
        registers = sketches(sets).astype("<i2")
        columns = [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(map(set_digest, sets), pa.string()),
            pa.array([r.tobytes() if len(s) else None for r, s in zip(registers, sets, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays([rows.column(0), *columns], names=[key, "n_shingles", "digest", "sketch"])

    return map_arrow(df.select(key, text_or_empty(text).alias("_text")), batch, schema)


def set_digest(elements: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(elements.tobytes()) if len(elements) else None


def full_sets(df: DataFrame, text: str) -> DataFrame:
    """digest, the whole sorted set and its parity map: one row a row."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in rows.column(0).to_pylist()]
        columns = [pa.array(map(set_digest, sets), pa.string()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(map(parity_map, sets), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["digest", "set", "parity"])

    return map_arrow(df.select(text_or_empty(text).alias("_text")), batch, "digest string, set array<bigint>, parity binary")


def band_hashes(sketch: str = "sketch") -> Column:
    """One bucket for each band: a hash of the band's number and its registers."""
    width = 2 * ROWS
    return F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring({sketch}, i * {width} + 1, {width})))")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows (df is a written table, so counting is cheap)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_both(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs (a, b) with of's other columns for a and for b, named with a suffix. pairs is a written table. Few pairs are sent to where of's rows
    are, so that of is not shuffled; many are joined by shuffles."""
    few = pairs.count() <= BROADCAST_ROWS
    near = F.broadcast if few else (lambda df: df)
    side = lambda df, s: df.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in of.columns if c != "id"))
    needed = of.join(near(pairs.select(F.col("b").alias("id")).distinct()), "id", "left_semi") if few else of
    return near(pairs).join(side(of, "a"), "a").join(side(needed, "b"), "b")


def likely_pairs(pairs: DataFrame, nodes: DataFrame, least_percent: int) -> DataFrame:
    """The pairs (a, b) that the parity maps don't rule out and whose estimated similarity is at most MARGIN below the threshold.
    nodes: (id, n, sketch, parity)."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = with_both(pairs, nodes)
    values = lambda column, dtype: np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        n_a, n_b = (rows.column(k).to_numpy() for k in (2, 3))
        differ = np.bitwise_count(values(rows.column(6), "<u8") ^ values(rows.column(7), "<u8")).sum(1, dtype=np.int64)
        # The intersection is at most (n_a + n_b - differ) / 2, the union at least (n_a + n_b + differ) / 2.
        open_ = 100 * (n_a + n_b - differ) >= least_percent * (n_a + n_b + differ)
        rows, n_a, n_b = rows.filter(pa.array(open_)), n_a[open_], n_b[open_]
        if rows.num_rows:
            estimate = joint_similarity(values(rows.column(4), "<i2"), values(rows.column(5), "<i2"), n_a.astype(np.float64), n_b.astype(np.float64))
            rows = rows.filter(pa.array(estimate >= least_percent / 100 - MARGIN))
        return rows.select(["a", "b"])

    return map_arrow(both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", "parity_a", "parity_b"), batch, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. sets: (id, set)."""
    both = with_both(pairs, sets)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b") - common).alias("all")).filter(100 * F.col("common") >= least_percent * F.col("all")).select("a", "b")


def overlap_bounds(sets: DataFrame) -> DataFrame:
    """(id, n, common_most): set sizes, and how many elements of a set any other set here holds as well. No intersection can be larger. An element
    of one set only is known by its count and its owner, so one pre-aggregated shuffle is enough."""
    elements = sets.select("id", F.explode("set").alias("element"))
    alone = elements.groupBy("element").agg(F.count("*").alias("sets"), F.min("id").alias("id")).filter("sets = 1").groupBy("id").agg(F.count("*").alias("alone"))
    return sets.select("id", F.size("set").alias("n")).join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common_most"))


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (id, comp) after links (a, b) between components: smallest labels spread over links, with a jump to the label's label in each turn."""
    on = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias(f"c_{side}"))
    edges = links.join(on("a"), "a").join(on("b"), "b").select("c_a", "c_b").filter("c_a <> c_b").distinct()
    edges = materialize(edges.select(F.col("c_a").alias("x"), F.col("c_b").alias("y")).unionByName(edges.select(F.col("c_b").alias("x"), F.col("c_a").alias("y"))).distinct(), "edges", True)
    low = materialize(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("low")), "low", True)
    while True:
        spread = edges.join(low.select(F.col("x").alias("y"), F.col("low").alias("low_y")), "y").groupBy("x").agg(F.min("low_y").alias("low_y"))
        step = low.join(spread, "x").select("x", "low", F.least("low", "low_y").alias("next"))
        jump = step.join(low.select(F.col("x").alias("next"), F.col("low").alias("of_next")), "next", "left")
        after = materialize(jump.select("x", F.least("next", "of_next").alias("low"), (F.least("next", "of_next") < F.col("low")).alias("moved")), "low", True)
        low = after.select("x", "low")
        if after.filter("moved").isEmpty():
            break
    return labels.join(low.withColumnRenamed("x", "comp"), "comp", "left").select("id", F.coalesce("low", "comp").alias("comp"))


def first_meeting() -> Column:
    """Whether a member and a chosen one (columns with _b) meet in this bucket first of all: they met in no earlier turn, and this is the smallest
    bucket of the member that the other one is chosen in now; where each is chosen in a bucket of the other, the smaller id counts as the member.
    Each has at most BANDS buckets (mine), those it was chosen in before and now among them, so a pair is told once instead of once a bucket."""
    met_before = F.arrays_overlap("mine", "before_b") | F.arrays_overlap("before", "mine_b")
    other_way = (F.col("id") > F.col("id_b")) & F.arrays_overlap("now", "mine_b")
    return ~met_before & ~other_way & (F.col("bucket") == F.array_min(F.array_intersect("mine", "now_b")))


def linked_components(classes: DataFrame, docs: DataFrame, least_percent: int) -> DataFrame | None:
    """(id, comp) of the nodes that share a bucket with another one; None if no two nodes do. classes: (id, digest, key, n, sketch)."""
    nodes = classes.select("id", "n", "sketch")
    exploded = nodes.select("id", F.explode(band_hashes()).alias("bucket"))
    counts = exploded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(exploded.join(counts, "bucket"), "shared")
    popular = materialize(shared.groupBy("id").agg(F.sum("size").alias("popularity"), F.collect_list("bucket").alias("mine")), "popular", True)
    ids = popular.select("id")
    if ids.isEmpty():
        return None
    wanted = materialize(classes.join(_small(ids), "id", "left_semi").select("id", "digest", "key"), "wanted", True)
    # A key may have further texts; their sets go again by their digests.
    texts = docs.join(_small(wanted.select("key")), F.col("_doc").eqNullSafe(F.col("key")), "left_semi")
    found = full_sets(texts, "_body").join(_small(wanted.select("id", "digest")), "digest")
    sets = materialize(found.groupBy("id").agg(F.first("set").alias("set"), F.first("parity").alias("parity")), "sets")
    sketched = materialize(nodes.join(_small(ids), "id", "left_semi").join(sets.select("id", "parity"), "id"), "sketched")
    labels = popular.select("id", F.col("id").alias("comp"))
    bounds = materialize(popular.join(overlap_bounds(sets), "id").filter(100 * F.col("common_most") >= least_percent * F.col("n")), "bounds", True)
    members, history, chosen_in_bucket = shared.select("id", "bucket", "size").join(bounds, "id"), None, 1
    m = F.least("common_most", "common_most_b")
    possible = 100 * m >= least_percent * (F.col("n") + F.col("n_b") - m)
    none = F.array().cast("array<bigint>")
    while True:
        # Buckets of one component need nothing more; the others choose members to compare the rest with.
        placed = members.join(labels, "id")
        open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("n_min")).filter("low < high").select("bucket", "n_min")
        reachable = 100 * F.col("common_most") >= least_percent * (F.col("n") + F.col("n_min") - F.col("common_most"))
        placed = materialize(placed.join(open_buckets, "bucket").filter(reachable).drop("n_min"), "open", True)
        if placed.isEmpty():
            return labels
        part = F.pmod(F.xxhash64("id"), F.lit(chosen_in_bucket))
        best = F.max(F.struct("popularity", (-F.col("id")).alias("minus"), "id")).alias("best")
        chosen = materialize(placed.groupBy("bucket", part.alias("part")).agg(best).select("bucket", "best.id", F.lit(chosen_in_bucket).alias("turn")), "chosen", True)
        history = chosen if history is None else history.unionByName(chosen)
        by_turn = lambda turns: F.collect_list(F.when(turns, F.col("bucket")))
        hands = history.groupBy("id").agg(by_turn(F.col("turn") < chosen_in_bucket).alias("before"), by_turn(F.col("turn") == chosen_in_bucket).alias("now"))
        held = placed.join(hands, "id", "left").withColumns({x: F.coalesce(x, none) for x in ("before", "now")})
        held = materialize(held, "held", True)
        is_chosen = F.array_contains("now", F.col("bucket"))
        # Members of a large bucket are dealt into parts, and its chosen ones go to each part.
        parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
        ones = held.filter(is_chosen).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = held.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        pairs = dealt.join(ones.select("bucket", "part", *(F.col(x).alias(f"{x}_b") for x in held.columns if x not in ("bucket", "size"))), ["bucket", "part"])
        pairs = pairs.filter((F.col("comp") != F.col("comp_b")) & possible & first_meeting())
        pairs = materialize(pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct(), "pairs", True)
        likely = materialize(likely_pairs(pairs, sketched, least_percent), "likely", True)
        links = materialize(confirmed(likely, sets.select("id", "set"), least_percent), "links", True)
        if not links.isEmpty():
            labels = materialize(components(links, labels), "labels", True)
        members = held.filter(~is_chosen).drop("comp", "before", "now")
        chosen_in_bucket *= 4


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least_percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id (smallest key reachable over links), kept (whether that is the row's own)."""
    docs = df.select(F.col(key).alias("_doc"), F.col(text).alias("_body"))
    sketched = materialize(sketch_documents(docs, "_doc", "_body"), "sketches")
    full = sketched.filter("digest IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("_doc").alias("key"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    labels = linked_components(classes, docs, least_percent)
    own = classes.select("digest", "id", "key")
    if labels is not None:
        own = materialize(own.join(labels, "id", "left").select("digest", F.coalesce("comp", "id").alias("id"), "key"), "own")
        lowest = own.groupBy("id").agg(F.min("key").alias("low"))
        own = own.join(lowest, "id").select("digest", F.col("low").alias("key"))
    found = full.join(own.select("digest", F.col("key").alias("component_id")), "digest").select(F.col("_doc").alias(key), "n_shingles", "component_id")
    empty = sketched.filter("digest IS NULL").select(F.col("_doc").alias(key), "n_shingles", F.col("_doc").alias("component_id"))
    return found.unionByName(empty).withColumn("kept", F.col(key) == F.col("component_id"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
