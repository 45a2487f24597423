"""Routes over many ranges, against plain loops over whole routes."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import oracle
from tidemark.operators import routes
from tidemark.sources.shared import written

POINTS = "route_id string, seq int, lat double, lon double, ele double, at timestamp_ntz"


def track(spark, points, route="r"):
    return spark.createDataFrame([(route, k, float(a), float(b), None if e is None else float(e), None) for k, (a, b, e) in enumerate(points)], POINTS)


@pytest.fixture(scope="module")
def long_routes(spark):
    """One route of 3,000 points between two short ones and one of a single point, dealt to 16 ranges."""
    from datetime import datetime, timedelta

    rng, rows = random.Random(5), []
    for name, n in (("a", 40), ("b", 3000), ("c", 1), ("d", 25)):
        lat, lon, ele = 48.0, 2.0, 100.0
        for k in range(n):
            lat, lon, ele = lat + rng.uniform(-1, 2) / 1e3, lon + rng.uniform(-1, 2) / 1e3, ele + rng.choice((-2.5, -0.5, 0, 0.4, 1.1, 2.9, 3.1))
            rows.append((name, 7 * k, lat, lon, None if rng.random() < 0.1 else ele, datetime(2024, 1, 1) + timedelta(seconds=5 * k) if rng.random() < 0.9 else None))
    points = spark.createDataFrame(rows, POINTS).repartitionByRange(16, "route_id", "seq")

    placed = written(points.withColumn("_range", F.spark_partition_id()), "placed")
    assert placed.filter("route_id = 'b'").select("_range").distinct().count() > 8
    return rows, placed


def km(a, b):
    x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(x)))


def plain_climb(heights):
    at, up, down = None, 0.0, 0.0
    for h in heights:
        if at is None:
            at = h
        elif abs(h - at) > 3:
            up, down, at = up + max(h - at, 0), down + max(at - h, 0), h
    return up, down


def of(rows, name):
    return [r for r in rows if r[0] == name]


def test_distance_speed_and_samples_over_ranges(long_routes):
    rows, placed = long_routes
    found = {(r["route_id"], r["seq"]): r for r in routes.with_distance(placed).collect()}
    for name in "abcd":
        own, so_far = of(rows, name), [0.0]
        for x, y in zip(own, own[1:], strict=False):
            so_far.append(so_far[-1] + km(x, y))
        for k, r in enumerate(own):
            got = found[name, r[1]]
            assert got["km"] == pytest.approx(so_far[k], abs=1e-6)
            lo, hi = max(0, k - 2), min(len(own) - 1, k + 2)
            seconds = (own[hi][5] - own[lo][5]).total_seconds() if own[hi][5] and own[lo][5] else 0
            assert got["speed"] == (pytest.approx((so_far[hi] - so_far[lo]) / (seconds / 3600)) if seconds > 0 else None)
    assert len(found) == len(rows)
    kept = {(r["route_id"], r["seq"]) for r in routes.samples(placed, 20).collect()}
    expected = {(n, r[1]) for n in "abcd" for k, r in enumerate(of(rows, n)) if k % max(1, -(-len(of(rows, n)) // 20)) == 0 or k == len(of(rows, n)) - 1}
    assert kept == expected


def test_ascent_over_ranges(long_routes):
    rows, placed = long_routes
    found = {r["route_id"]: (r["ascent"], r["descent"]) for r in routes.ascent(placed).collect()}
    for name in "abd":
        assert found[name] == pytest.approx(plain_climb([r[4] for r in of(rows, name) if r[4] is not None]))
    sums = {r["route_id"]: r for r in routes.summaries(placed).collect()}
    assert sums["b"]["points"] == 3000 and sums["c"]["km"] == 0 and sums["c"]["ascent"] == 0


def test_any_height_climbs_a_range():
    rng = random.Random(3)
    for _ in range(200):
        heights = np.array([rng.uniform(0, rng.choice((4, 9, 30))) for _ in range(rng.randrange(1, 40))])
        found = routes.climb_map(heights)
        for at in [rng.uniform(-5, 35) for _ in range(10)]:
            up, down = plain_climb([at, *heights])
            k = next((r for r in found if r[0] - at < -3 or r[1] - at > 3), None)
            assert (up, down) == (pytest.approx((k[4] + max(k[2] - at, 0), k[5] + max(at - k[2], 0))) if k else (0, 0))


def plain_simplify(points, most):
    """The rule itself: the line is drawn anew for every tolerance that is tried."""
    if len(points) <= most:
        return list(range(len(points)))
    places = list(range(len(points)))
    if len(points) > 8 * most:
        stride = -(-len(points) // (8 * most))
        places = [k for k in places if k % stride == 0 or k == len(points) - 1]

    def away(p, a, b):
        c = math.cos(math.radians(a[0]))
        px, py, bx, by = (p[1] - a[1]) * c * 111.32, (p[0] - a[0]) * 111.32, (b[1] - a[1]) * c * 111.32, (b[0] - a[0]) * 111.32
        t = max(0.0, min(1.0, (px * bx + py * by) / (bx * bx + by * by))) if bx or by else 0.0
        return math.hypot(px - t * bx, py - t * by)

    def drawn(tolerance):
        keep, todo = {places[0], places[-1]}, [(0, len(places) - 1)]
        while todo:
            a, b = todo.pop()
            inner = [(away(points[places[k]], points[places[a]], points[places[b]]), -k) for k in range(a + 1, b)]
            if inner and max(inner)[0] > tolerance:
                k = -max(inner)[1]
                keep.add(places[k])
                todo += [(a, k), (k, b)]
        return sorted(keep)

    lo, hi = 0.0, 1.0
    while len(drawn(hi)) > most and hi < 1000:
        hi *= 4
    best = drawn(hi)
    for _ in range(12):
        mid = (lo + hi) / 2
        got = drawn(mid)
        if len(got) > most:
            lo = mid
        else:
            best, hi = got, mid
    return best


def test_simplify_keeps_what_the_rule_keeps(spark):
    rng, tracks = random.Random(8), {}
    for k in range(30):
        lat, lon, step, points = rng.uniform(-70, 70), rng.uniform(-170, 170), 10 ** rng.uniform(-4, 0.5), []
        for _ in range(rng.choice((3, 12, 60, 200, 500))):
            lat, lon = max(-89, min(89, lat + rng.uniform(-1, 1) * step)), lon + rng.uniform(-1, 1.5) * step
            points.append((lat, lon, None))
        tracks[f"t{k}"] = points + ([points[0]] if k % 5 == 0 else [])
    frames = [track(spark, p, name) for name, p in tracks.items()]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    for most in (2, 10, 25):
        kept = {}
        for r in routes.simplify(every, most).collect():
            kept.setdefault(r["route_id"], []).append(r["seq"])
        for name, points in tracks.items():
            assert sorted(kept[name]) == plain_simplify(points, most), (name, most)


def test_points_equally_far_are_told_apart_as_in_sql(spark):
    """A track of the copies of sf0.1: which of two points is farthest hangs on the last bit."""
    # fmt: off
    ids = np.array([
        2700094, 2700572, 2700921, 2701828, 2702978, 2703481, 2704672, 2705519, 2706302, 2707837, 2709670, 2713868, 2718505, 2722559, 2723730, 2727155,
        2728417, 2728723, 2729171, 2730119, 2730514, 2730953, 2732029, 2732324, 2733342, 2734359, 2742169, 2742851, 2743696, 2743774, 2745267, 2746075,
        2747603, 2749775, 2750777, 2751159, 2751605, 2752583, 2755762, 2755885, 2759941, 2760822, 2761090, 2761707, 2761774, 2764957, 2765753, 2769360,
        2772232, 2775590, 2775626, 2776699, 2777570, 2777921, 2777967, 2778436, 2779270, 2780441, 2780485, 2781454, 2781612, 2781928, 2782017, 2783921,
        2784043, 2784341, 2785910, 2786824, 2787716, 2788123, 2788690, 2788828, 2789002, 2789415, 2789546, 2789621, 2793559, 2795039, 2795643, 2797353,
        2797728, 2798867,
    ])
    # fmt: on
    found = routes.ranks(48 + (ids % 997) / 1000, 2 + (ids % 613) / 1000)
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT unnest($ids) AS event_id, 1 AS user_id, 1.0 AS value, TIMESTAMP '2024-01-01' AS ts", {"ids": ids.tolist()})
    expected = sorted(r[0] for r in con.sql(f"SELECT seq FROM ({oracle.SQL['route_simplify']})").fetchall())
    assert ids[found > routes.tolerance(found, 30)].tolist() == expected


def test_groups_are_bounded_before_they_are_simplified(spark):
    zigzag = track(spark, [(48 + k / 1e4, 2 + (k % 2) / 100, None) for k in range(4000)])
    assert routes._every(routes.numbered(routes.ranges(zigzag)), 8 * 20).count() <= 8 * 20 + 1
    kept = sorted(r["seq"] for r in routes.simplify(zigzag, 20).collect())
    assert len(kept) <= 20 and kept[0] == 0 and kept[-1] == 3999


def whole_rule(lat, lon, most):
    """Places that the rule keeps with no point passed over: every line is drawn in full for every tolerance that is tried."""
    n = len(lat)

    def drawn(tolerance):
        keep, todo = {0, n - 1}, [(0, n - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            c = math.cos(math.radians(lat[a]))
            px, py, bx, by = (lon[a + 1 : b] - lon[a]) * c * 111.32, (lat[a + 1 : b] - lat[a]) * 111.32, (lon[b] - lon[a]) * c * 111.32, (lat[b] - lat[a]) * 111.32
            t = np.clip((px * bx + py * by) / (bx * bx + by * by), 0, 1) if bx or by else 0.0
            away = np.hypot(px - t * bx, py - t * by)
            k = a + 1 + int(away.argmax())
            if away[k - a - 1] > tolerance:
                keep.add(k)
                todo += [(a, k), (k, b)]
        return keep

    if n <= most:
        return list(range(n))
    lo, hi = 0.0, 1.0
    while len(drawn(hi)) > most and hi < 1000:
        hi *= 4
    for _ in range(12):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if len(drawn(mid)) > most else (lo, mid)
    return sorted(drawn(hi))


def test_a_whole_simplification_sees_every_point(spark):
    """A single far point of a long line stands between those that a stride would look at."""
    spike = track(spark, [(48 + k / 1e4, 2 + (0.5 if k == 777 else 0), None) for k in range(2000)])
    assert 777 not in {r["seq"] for r in routes.simplify(spike, 20).collect()}
    assert sorted(r["seq"] for r in routes.simplify(spike, 20, None).collect()) == whole_rule(48 + np.arange(2000) / 1e4, 2 + 0.5 * (np.arange(2000) == 777), 20)
    assert 777 in {r["seq"] for r in routes.simplify(spike, 20, None).collect()}


@pytest.mark.parametrize(("span", "mosts"), [(40, (9,)), (100_000, (2, 9, 25))])
def test_whole_simplification_keeps_what_the_rule_keeps(spark, monkeypatch, span, mosts):
    """Routes of 3 to 700 points, in one group each or split by Spark down to spans of 40 points; some are wider than the widest tolerance."""
    monkeypatch.setattr(routes, "SPAN_POINTS", span)
    rng, tracks, rows = np.random.default_rng(11), {}, []
    for k, n in enumerate((3, 11, 39, 40, 41, 42, 300, 300, 450, 700, 700)):
        step = (1e-3, 0.02, 0.3, 1e-5)[k % 4]
        lat, lon = np.clip(48 + np.cumsum(rng.uniform(-1, 1, n) * step), -85, 85), 2 + np.cumsum(rng.uniform(-1, 1.3, n) * step)
        if k == 8:
            lat, lon = 48.0 + np.arange(n) % 2, np.linspace(2, 3, n)
        tracks[k] = lat, lon
    far = np.arange(120)
    tracks["far"] = np.where(far % 2, 70.0, -60.0) + rng.uniform(-1, 1, 120), far * 1.5 - 90 + rng.uniform(-0.3, 0.3, 120)
    tracks["still"] = np.full(90, 48.0), np.full(90, 2.0)
    for name, (lat, lon) in tracks.items():
        rows += [(str(name), 3 * i, float(a), float(b), None, None) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    points = written(spark.createDataFrame(rows, POINTS).repartitionByRange(6, "route_id", "seq").withColumn("_range", F.spark_partition_id()), "placed")
    for most in mosts:
        kept = {}
        for r in routes.simplify(points, most, None).collect():
            kept.setdefault(r["route_id"], []).append(r["seq"] // 3)
        for name, (lat, lon) in tracks.items():
            assert sorted(kept[str(name)]) == whole_rule(lat, lon, most), (name, most)


@pytest.mark.parametrize("span", [150, 100_000])
def test_long_routes_of_the_query_are_whole(spark, monkeypatch, tmp_path, span):
    """route_simplify on routes of 700 and 200 events against its SQL with every point in (the SQL as it stands thins routes of more than 240)."""
    from tidemark.queries import QUERIES

    monkeypatch.setattr(routes, "SPAN_POINTS", span)
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT k AS event_id, CASE WHEN k % 9 < 7 THEN 1 ELSE 2 END AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, TIMESTAMP '2024-01-01' + k * INTERVAL 1 SECOND AS ts FROM range(900) t(k)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    whole = oracle.SQL["route_simplify"].replace("i0 % greatest(1, CAST(ceil(n / 240.0) AS BIGINT)) = 0 OR i0 = n - 1", "true")
    assert whole != oracle.SQL["route_simplify"]
    expected = sorted(con.sql(f"SELECT * FROM ({whole})").fetchall())
    assert sorted(map(tuple, QUERIES["route_simplify"](spark, str(tmp_path)).collect())) == expected
