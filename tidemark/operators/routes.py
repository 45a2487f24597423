"""Geometry of routes of any length: distance, ascent, profiles and simplified lines, from points (route_id, seq, lat, lon, ele, at).

Points are dealt to ranges of (route, seq) first and written once. A range is one task's worth, so a long route is many tasks' and many short ones share one. All that
needs a route in order is a scan over its ranges: each range is summed by itself, with the two points on either side of it as a border, and a route's few
ranges are then put together in order. Nothing holds a whole route, neither a window, a group nor a row, but for lines of up to SPAN_POINTS points that are simplified.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import haversine
from tidemark.sources.shared import written

ASCENT_STEP = 3.0
MOST_POINTS, MOST_SAMPLES = 1000, 500
#: Kilometres of a degree of latitude, in the plane that lines are simplified in.
DEGREE_KM = 111.32
#: Points to either side that a speed looks at.
NEAR = 2
SEGMENT = ["route_id", "_range"]
#: Part of a route between two of its points: their places and positions, and the highest rank that a point in between can have.
SPAN = ["route_id", "_a", "_b", "_cap", "a_lat", "a_lon", "b_lat", "b_lon"]
#: Points between which a span is one group's work, and the widest tolerance in km that a line is drawn with.
SPAN_POINTS, WIDEST = 50_000, 1024.0


def ranges(points: DataFrame) -> DataFrame:
    """points with _range, in ranges of (route, seq); written once, so that all readers see the same ranges."""
    if "_range" in points.columns:
        return points
    return written(points.repartitionByRange("route_id", "seq").withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(points: DataFrame) -> DataFrame:
    """points of ranges with _i, their place in the route from 0, and _n, how many it has: places in the range plus the counts of the ranges before."""
    ordered = W.partitionBy("route_id").orderBy("_range")
    counts = points.groupBy(*SEGMENT).agg(F.count("*").alias("_c"))
    starts = counts.select(*SEGMENT, (F.sum("_c").over(ordered) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy("route_id")).alias("_n"))
    placed = points.withColumn("_row", F.row_number().over(W.partitionBy(*SEGMENT).orderBy("seq")) - 1)
    return placed.join(starts, SEGMENT).withColumn("_i", F.col("_before") + F.col("_row")).drop("_before", "_row")


def _bordered(points: DataFrame) -> DataFrame:
    """points of ranges, and the NEAR points of the same route before and after each range as rows of it that are marked _border. A range has a point at least, so
    they lie in the NEAR ranges to either side."""
    at = W.partitionBy(*SEGMENT)
    place = ("seq", "lat", "lon", "at")
    ends = points.select(*SEGMENT, *place, F.row_number().over(at.orderBy("seq")).alias("_up"), F.row_number().over(at.orderBy(F.desc("seq"))).alias("_down")).filter((F.col("_up") <= NEAR) | (F.col("_down") <= NEAR))
    of = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) <= NEAR, F.struct(*place))))
    both = ends.groupBy(*SEGMENT).agg(of("_up").alias("_first"), of("_down").alias("_last"))
    ordered = W.partitionBy("route_id").orderBy("_range")
    before = F.flatten(F.collect_list("_last").over(ordered.rowsBetween(-NEAR, -1)))
    after = F.flatten(F.collect_list("_first").over(ordered.rowsBetween(1, NEAR)))
    near = both.withColumn("_near", F.concat(F.reverse(F.slice(F.reverse(before), 1, NEAR)), F.slice(after, 1, NEAR)))
    borders = near.select(*SEGMENT, F.inline("_near")).withColumn("_border", F.lit(True))
    return points.withColumn("_border", F.lit(False)).unionByName(borders, allowMissingColumns=True)


def _stepped(points: DataFrame) -> DataFrame:
    """Bordered points with step_km, the distance from the point before."""
    order = W.partitionBy(*SEGMENT).orderBy("seq")
    before = lambda n: F.lag(n).over(order)
    return _bordered(points).withColumn("step_km", F.coalesce(haversine(before("lat"), before("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))


def lengths(points: DataFrame) -> DataFrame:
    """(route_id, points, km)."""
    return _stepped(ranges(points)).filter(~F.col("_border")).groupBy("route_id").agg(F.count("*").alias("points"), F.sum("step_km").alias("km"))


def with_distance(points: DataFrame) -> DataFrame:
    """Points with step_km, km so far, and speed over the two points to either side in km/h."""
    stepped = _stepped(ranges(points))
    order = W.partitionBy(*SEGMENT).orderBy("seq")
    so_far, near = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(-NEAR, NEAR)
    own = F.when(~F.col("_border"), F.col("step_km")).otherwise(0.0)
    seconds = F.unix_micros(F.last("at").over(near).cast("timestamp")) / 1e6 - F.unix_micros(F.first("at").over(near).cast("timestamp")) / 1e6
    out = stepped.withColumns({"_own": F.sum(own).over(so_far), "_km": F.sum("step_km").over(so_far)})
    out = out.withColumn("speed", F.when(seconds > 0, (F.last("_km").over(near) - F.first("_km").over(near)) / (seconds / 3600))).filter(~F.col("_border"))
    # What a route's ranges before this one add up to.
    sums = stepped.groupBy(*SEGMENT).agg(F.sum(own).alias("_sum"))
    starts = sums.select(*SEGMENT, (F.sum("_sum").over(W.partitionBy("route_id").orderBy("_range")) - F.col("_sum")).alias("_before"))
    return out.join(starts, SEGMENT).withColumn("km", F.col("_before") + F.col("_own")).drop("_border", "_own", "_km", "_before", "_range")


def left_at(heights: np.ndarray, k: int) -> int | None:
    """The first point after k that is more than ASCENT_STEP from it, looked for in blocks."""
    for a in range(k + 1, len(heights), 4096):
        away = np.flatnonzero(np.abs(heights[a : a + 4096] - heights[k]) > ASCENT_STEP)
        if len(away):
            return a + int(away[0])
    return None


def climb_map(heights: np.ndarray) -> list[tuple[float, float, float, float, float, float]]:
    """What a range does to any height that comes in: (lowest so far, highest so far, and the height that leaves it then, what comes out, ascent and descent from there). A
    climb counts once it is more than ASCENT_STEP metres from where the last one ended, so an incoming height is left at the first point that is, which is a
    new lowest or highest one, and all goes on from that point whatever came in. Once lowest and highest are two steps apart, any height has been left."""
    out, known = [], {}

    def onward(k: int) -> tuple[float, float, float]:
        """What comes out, ascent and descent from point k on; a way ends where an earlier one has been."""
        way, at = [], k
        while at is not None and at not in known:
            way.append(at)
            at = left_at(heights, at)
        for j in reversed(way):
            if at is None:
                known[j] = float(heights[j]), 0.0, 0.0
            else:
                step, (end, up, down) = float(heights[at] - heights[j]), known[at]
                known[j] = end, up + max(step, 0.0), down + max(-step, 0.0)
            at = j
        return known[k]

    low = high = float(heights[0])
    for k in np.flatnonzero((heights <= np.minimum.accumulate(heights)) | (heights >= np.maximum.accumulate(heights))):
        h = float(heights[k])
        low, high = min(low, h), max(high, h)
        if not out or (low, high) != out[-1][:2]:
            out.append((low, high, h, *onward(int(k))))
        if high - low > 2 * ASCENT_STEP:
            break
    return out


def grouped(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of sorted rows that come in batches: a group is held until the next one begins."""
    key, held = None, []
    for frame in frames:
        columns = [frame[k].to_numpy() for k in keys]
        edges = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist(), len(frame)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            here = tuple(c[a] for c in columns)
            if here != key:
                if held:
                    yield key, pd.concat(held) if len(held) > 1 else held[0]
                key, held = here, []
            held.append(frame.iloc[a:b])
    if held:
        yield key, pd.concat(held) if len(held) > 1 else held[0]


def by_key(rows: DataFrame, keys: list[str], order: str, fn: Callable[[tuple, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """fn's rows of each group of keys, its rows in order. Groups follow each other through one function a task, so many small ones cost little."""
    names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, group in grouped(frames, keys):
            out += fn(key, group)
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def ascent(points: DataFrame) -> DataFrame:
    """(route_id, ascent, descent). Each range is turned into what it does to any height that comes in; a route's ranges then follow each other in order, a few rows a
    route, so that a route of any length is climbed by many tasks at once."""

    def of_range(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        rows = climb_map(pdf["ele"].to_numpy(np.float64))
        return [(*key, *rows[0][3:], *map(list, zip(*rows, strict=True)))]

    kind = points.schema["route_id"].dataType.simpleString()
    lists = ("low", "high", "leaves", "out", "up", "down")
    segment = f"route_id {kind}, _range int, at double, ascent double, descent double, " + ", ".join(f"{c} array<double>" for c in lists)
    known = ranges(points).filter(F.col("ele").isNotNull() & ~F.isnan("ele")).select(*SEGMENT, "seq", F.col("ele").cast("double").alias("ele"))
    segments = by_key(known, SEGMENT, "seq", of_range, segment)

    def of_route(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        at, up, down = None, 0.0, 0.0
        for r in pdf.itertuples():
            if at is None:
                at, more_up, more_down = r.at, r.ascent, r.descent
            else:
                left = np.flatnonzero((np.asarray(r.low) - at < -ASCENT_STEP) | (np.asarray(r.high) - at > ASCENT_STEP))
                if not len(left):
                    continue
                k = left[0]
                more_up, more_down = r.up[k] + max(r.leaves[k] - at, 0.0), r.down[k] + max(at - r.leaves[k], 0.0)
                at = r.out[k]
            up, down = up + more_up, down + more_down
        return [(*key, up, down)]

    return by_key(segments, ["route_id"], "_range", of_route, f"route_id {kind}, ascent double, descent double")


def summaries(points: DataFrame) -> DataFrame:
    """(route_id, points, km, min_ele, max_ele, ascent, descent)."""
    points = ranges(points)
    heights = points.groupBy("route_id").agg(F.min("ele").alias("min_ele"), F.max("ele").alias("max_ele"))
    out = lengths(points).join(heights, "route_id").join(ascent(points), "route_id", "left")
    return out.select("route_id", "points", "km", "min_ele", "max_ele", F.coalesce("ascent", F.lit(0.0)).alias("ascent"), F.coalesce("descent", F.lit(0.0)).alias("descent"))


def _every(points: DataFrame, most: int) -> DataFrame:
    """Every so many'th of numbered points, so that most are left of a route and its last one."""
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    return points.filter((F.col("_i") % stride == 0) | (F.col("_i") == F.col("_n") - 1))


def samples(points: DataFrame, most: int = MOST_SAMPLES) -> DataFrame:
    """At most `most` points of each route (and its last), evenly by order, with their distance and speed, which are measured over all points."""
    points = ranges(points)
    kept = _every(numbered(points.select("route_id", "seq", "_range")), most).select("route_id", "seq")
    return with_distance(points).join(kept, ["route_id", "seq"], "left_semi")


def squares(x: np.ndarray) -> np.ndarray:
    """Squares as the C library's pow rounds them, which numpy's and plain products don't always."""
    return np.array([math.pow(v, 2) for v in x.tolist()])


def farthest(lat: np.ndarray, lon: np.ndarray, start: Sequence[float], end: Sequence[float]) -> tuple[float, int]:
    """(distance, place) of the first of the points that are farthest from the line between start and end, in km, in a plane that touches at its start. Points without
    a position are passed over; 0 where no other is left."""
    # In the SQL's order of steps, as what is equally far on paper is told apart by the last bit.
    wide = math.cos(math.radians(start[0]))
    px, py = (lon - start[1]) * wide * DEGREE_KM, (lat - start[0]) * DEGREE_KM
    dx, dy = (end[1] - start[1]) * wide * DEGREE_KM, (end[0] - start[0]) * DEGREE_KM
    length = math.pow(dx, 2) + math.pow(dy, 2)
    t = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(len(px))
    x, y = px - t * dx, py - t * dy
    # Plain products are off by a few last bits at most, so only points as good as farthest are squared by pow.
    rough = x * x + y * y
    near = np.flatnonzero(rough >= np.fmax.reduce(rough) * (1 - 1e-12))
    if not len(near):
        return 0.0, 0
    away = np.sqrt(squares(x[near]) + squares(y[near]))
    k = int(away.argmax())
    return float(away[k]), int(near[k])


def ranks(lat: np.ndarray, lon: np.ndarray, cap: float = math.inf, most: int | None = None) -> np.ndarray:
    """The tolerance below which each point is kept: a line is split at its farthest point, again and again, and a point is kept while all splits on the way down to it are
    farther than the tolerance. Ends are always kept; cap is the least of the splits that led to this line. Highest ranks are found first: with most, no more than that
    many are looked for beside those above WIDEST, and 0 stands for the rest."""
    out = np.zeros(len(lat))
    out[[0, -1]] = np.inf
    # (-rank, -place, first, last) of a split; place 0: of a part whose farthest point isn't known yet, which ranks no higher than the split that made it.
    todo, found = [(-cap, 0, 0, len(lat) - 1)], 0
    while todo and (most is None or found < most or -todo[0][0] > WIDEST):
        least, m, a, b = heapq.heappop(todo)
        if m:
            out[-m], found = -least, found + 1
            heapq.heappush(todo, (least, 0, a, -m))
            heapq.heappush(todo, (least, 0, -m, b))
        elif b - a > 1:
            away, k = farthest(lat[a + 1 : b], lon[a + 1 : b], (lat[a], lon[a]), (lat[b], lon[b]))
            if away > 0:
                heapq.heappush(todo, (max(-away, least), -(a + 1 + k), a, b))
    return out


def tolerance(found: np.ndarray, most: int) -> float:
    """The finest tolerance that keeps at most `most` points, as a bracket from 1 km and twelve halvings find it; from sorted ranks a count is a look-up."""
    order = np.sort(found)
    kept = lambda t: len(order) - np.searchsorted(order, t, "right")
    lo, hi = 0.0, 1.0
    while kept(hi) > most and hi < 1000:
        hi *= 4
    for _ in range(12):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if kept(mid) > most else (lo, mid)
    return hi


def _within(placed: DataFrame, spans: DataFrame, extents: DataFrame) -> DataFrame:
    """Points of placed ranges with each span that they lie in, ends included. Spans meet points range by range, so a long route is many tasks' work; what
    spans there are is written first, as Spark then knows its size and leaves the points where they are beside a few."""
    held = spans.join(extents, "route_id").filter((F.col("_first") <= F.col("_b")) & (F.col("_last") >= F.col("_a"))).drop("_first", "_last")
    return placed.select(*SEGMENT, "_i", "lat", "lon").join(written(held, "held"), SEGMENT).filter(F.col("_i").between(F.col("_a"), F.col("_b")))


def _split(within: DataFrame) -> DataFrame:
    """Spans with their farthest point (_m, m_lat, m_lon) and its rank; those without a point off their line are left out."""
    names = [*SPAN, "_m", "m_lat", "m_lon", "away"]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for _, rows in frame.sort_values("_i").groupby(["route_id", "_a"], sort=False):
                span = [rows[c].iat[0] for c in SPAN]
                away, k = farthest(rows["lat"].to_numpy(np.float64), rows["lon"].to_numpy(np.float64), span[4:6], span[6:])
                if away > 0:
                    out.append((*span, *(rows[c].iat[k] for c in ("_i", "lat", "lon")), away))
            yield pd.DataFrame(out, columns=names)

    inner = within.filter((F.col("_i") > F.col("_a")) & (F.col("_i") < F.col("_b")))
    kinds = [inner.schema[c].dataType.simpleString() for c in SPAN]
    found = inner.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in zip(SPAN, kinds, strict=True)) + ", _m bigint, m_lat double, m_lon double, away double")
    best = found.groupBy(*SPAN).agg(F.max(F.struct("away", (-F.col("_m")).alias("_back"), "m_lat", "m_lon")).alias("_best"))
    return best.select(*SPAN, (-F.col("_best._back")).alias("_m"), "_best.m_lat", "_best.m_lon", F.least("_best.away", "_cap").alias("rank"))


def _highest(nodes: DataFrame, most: int) -> DataFrame:
    """The most - 1 highest ranks of each route, which decide its tolerance, and all above WIDEST; _row counts them."""
    row = F.row_number().over(W.partitionBy("route_id").orderBy(F.desc("rank")))
    return nodes.withColumn("_row", row).filter((F.col("_row") < most) | (F.col("rank") > WIDEST))


def _long_kept(placed: DataFrame, most: int) -> DataFrame | None:
    """(route_id, _i) of the points kept of routes of more than SPAN_POINTS points; None where there are none. All spans that are too long are split at once, each over all
    of its points, until none is left that could rank high enough; what is shorter is a group's work."""
    placed = placed.filter(F.col("_n") > max(SPAN_POINTS, most))
    ends = placed.filter((F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1))
    at = lambda c, last: F.max(F.when((F.col("_i") > 0) == last, F.col(c)))
    of = {"_a": F.min("_i"), "_b": F.max("_i"), "_cap": F.lit(math.inf), "a_lat": at("lat", False), "a_lon": at("lon", False), "b_lat": at("lat", True), "b_lon": at("lon", True)}
    spans = written(ends.groupBy("route_id").agg(*(v.alias(k) for k, v in of.items())), "spans")
    if spans.isEmpty():
        return None
    extents = written(placed.groupBy(*SEGMENT).agg(F.min("_i").alias("_first"), F.max("_i").alias("_last")), "extents")
    nodes, long = None, F.col("_b") - F.col("_a") >= SPAN_POINTS
    while not spans.filter(long).isEmpty():
        found = written(_split(_within(placed, spans.filter(long), extents)), "split")
        here = found.select("route_id", F.col("_m").alias("_i"), "rank")
        nodes = written(_highest(here if nodes is None else nodes.drop("_row").unionByName(here), most), "nodes")
        middle = lambda x: (F.col("m_lat").alias(f"{x}_lat"), F.col("m_lon").alias(f"{x}_lon"))
        before = found.select("route_id", "_a", F.col("_m").alias("_b"), F.col("rank").alias("_cap"), "a_lat", "a_lon", *middle("b"))
        after = found.select("route_id", F.col("_m").alias("_a"), "_b", F.col("rank").alias("_cap"), *middle("a"), "b_lat", "b_lon")
        # A part ranks no higher than the split that made it, so it is done with once enough others are known to rank as high.
        least = nodes.filter(F.col("_row") == most - 1).select("route_id", F.least("rank", F.lit(WIDEST)).alias("_least"))
        open_ = spans.filter(~long).unionByName(before).unionByName(after).filter(F.col("_b") - F.col("_a") > 1).join(least, "route_id", "left")
        spans = written(open_.filter(F.col("_least").isNull() | (F.col("_cap") > F.col("_least"))).select(*SPAN), "spans")

    def of_span(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        found = ranks(pdf["lat"].to_numpy(np.float64), pdf["lon"].to_numpy(np.float64), float(pdf["_cap"].iloc[0]), most - 1)
        return [(key[0], int(i), float(r)) for i, r in zip(pdf["_i"].to_numpy()[1:-1], found[1:-1], strict=True) if r > 0]

    def of_route(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        found = pdf["rank"].to_numpy()
        return [(*key, i) for i in pdf["_i"].to_numpy()[found > tolerance(found, most - 2)].tolist()]

    kind = placed.schema["route_id"].dataType.simpleString()
    inner = by_key(_within(placed, spans, extents).select("route_id", "_a", "_cap", "_i", "lat", "lon"), ["route_id", "_a"], "_i", of_span, f"route_id {kind}, _i bigint, rank double")
    highest = written(_highest(inner.unionByName(nodes.drop("_row")), most), "nodes")
    # Beyond the first most - 1 there are only ranks above WIDEST, the widest tolerance.
    kept = by_key(highest.filter(F.col("_row") < most), ["route_id"], "_i", of_route, f"route_id {kind}, _i bigint").unionByName(highest.filter(F.col("_row") >= most).select("route_id", "_i"))
    return kept.unionByName(ends.select("route_id", "_i"))


def simplify(points: DataFrame, most: int = MOST_POINTS, over: int | None = 8) -> DataFrame:
    """At most `most` points of each route, ends kept: the finest line that fits. Routes of more than over x most points are thinned to that first, which is a drawn line's
    rule; with None every point is looked at, however long the route is. A group has SPAN_POINTS points at the most. most has to be 2 at least."""

    def one(key: tuple, pdf: pd.DataFrame) -> list[tuple]:
        found = ranks(pdf["lat"].to_numpy(np.float64), pdf["lon"].to_numpy(np.float64), most=most - 1)
        return [(*key, i) for i in pdf["_i"].to_numpy()[found > tolerance(found, most)].tolist()]

    if most < 2:
        return points
    points = ranges(points)
    columns = [c for c in points.columns if c != "_range"]
    placed = numbered(points)
    if over:
        stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / (over * most)))
        placed = _every(placed, over * most).withColumns({"_i": F.ceil(F.col("_i") / stride), "_n": F.ceil((F.col("_n") - 1) / stride) + 1})
    placed = written(placed, "placed")
    kind = points.schema["route_id"].dataType.simpleString()
    short = placed.filter((F.col("_n") > most) & (F.col("_n") <= SPAN_POINTS)).select("route_id", "_i", "lat", "lon")
    kept, long = by_key(short, ["route_id"], "_i", one, f"route_id {kind}, _i bigint"), _long_kept(placed, most)
    kept = (kept if long is None else kept.unionByName(long)).withColumn("_kept", F.lit(True))
    return placed.join(kept, ["route_id", "_i"], "left").filter((F.col("_n") <= most) | F.col("_kept")).select(*columns)
