"""Co-variation: ranked, optionally lagged correlation of every ordered pair of metrics, and least-squares lines."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import STEPS

LEAST_SHARED, SHARE, LEAST_POINTS = 8, 0.6, 3
MOST_METRICS = 8
#: (bucket, or None for the axis's own; lag in buckets) of the offered comparisons.
LAGS = {"same": (None, 0), "next_day": ("day", 1), "next_week": ("week", 1)}


def shared_threshold(total: int) -> int:
    """How many buckets a pair must share to be ranked, of a grid of total."""
    return min(total, max(LEAST_SHARED, ceil(SHARE * total)))


def pearson(x: Column, y: Column) -> list[Column]:
    """Sums that give the correlation: n, and centred second moments by population (co)variance."""
    return [F.count("*").alias("shared"), F.covar_pop(x, y).alias("sxy"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy")]


def correlation() -> Column:
    """0 where either side is flat."""
    return F.coalesce(F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))), F.lit(0.0))


def aligned(found: DataFrame, bucket: str, lag: int = 0, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """(keys, a, b, bucket, x, y): every ordered pair of different metrics where b has a point lag buckets after a's. A bucket joins only
    the metrics that have points in it."""
    a = found.select(*keys, F.col("metric").alias("a"), "bucket", F.col("value").alias("x"), (F.col("bucket") + F.expr(STEPS[bucket]) * lag).cast("date").alias("at"))
    b = found.select(*keys, F.col("metric").alias("b"), F.col("bucket").alias("at"), F.col("value").alias("y"))
    return a.join(b, [*keys, "at"]).filter("a <> b").drop("at")


def average_rank(value: str, partition: list[str]) -> Column:
    """Ranks from 1; equal values share the mean of their places."""
    return F.rank().over(W.partitionBy(*partition).orderBy(value)) + (F.count("*").over(W.partitionBy(*partition, value)) - 1) / 2


def co_vary(found: DataFrame, bucket: str, total: int, lag: int = 0) -> DataFrame:
    """(account_id, a, b, shared, rho, ranked), in no order. found: points of any nature (imported, derived, sleep). Ranks are taken over each
    pair's own shared buckets. Pairs with fewer than LEAST_POINTS have rho 0 and no rank."""
    pair = ["account_id", "a", "b"]
    ranked = aligned(found, bucket, lag).select(*pair, average_rank("x", pair).alias("rx"), average_rank("y", pair).alias("ry"))
    stats = ranked.groupBy(*pair).agg(*pearson(F.col("rx"), F.col("ry")))
    enough = F.col("shared") >= LEAST_POINTS
    return stats.select(*pair, "shared", F.when(enough, correlation()).otherwise(0.0).alias("rho"), (enough & (F.col("shared") >= shared_threshold(total))).alias("ranked"))


def strongest(pairs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The strongest ranked pair of each account: of equal ones that whose metrics come first, by pin with places (account_id, metric, place), else by name."""
    first, second = F.col("a"), F.col("b")
    if places is not None:
        at = lambda side: places.select("account_id", F.col("metric").alias(side), F.col("place").alias(f"_{side}"))
        pairs = pairs.join(at("a"), ["account_id", "a"]).join(at("b"), ["account_id", "b"])
        first, second = F.col("_a"), F.col("_b")
    least = F.struct((-F.round(F.abs("rho"), 12)).alias("s"), first.alias("first"), second.alias("second"))
    return pairs.filter("ranked").groupBy("account_id").agg(F.min_by(F.struct("a", "b", "rho"), least).alias("p")).select("account_id", "p.a", "p.b", "p.rho")


def undirected(pairs: DataFrame) -> DataFrame:
    """One row for each unlagged pair: a before b."""
    return pairs.filter("a < b")


def fit_lines(dots: DataFrame) -> DataFrame:
    """(account_id, a, b, slope, intercept, x0, y0, x1, y1): the least-squares line at the ends of x; nothing for flat x."""
    out = dots.groupBy("account_id", "a", "b").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    at = lambda x: F.col("intercept") + F.col("slope") * F.col(x)
    return out.filter(F.col("slope").isNotNull()).select("account_id", "a", "b", "slope", "intercept", "x0", at("x0").alias("y0"), "x1", at("x1").alias("y1"))


def slopes(found: DataFrame) -> DataFrame:
    """(account_id, metric, slope per day, points); null for fewer than two points."""
    day = F.datediff(F.col("bucket"), F.lit("2000-01-01").cast("date")).cast("double")
    return found.groupBy("account_id", "metric").agg(F.when(F.count("*") >= 2, F.regr_slope(F.col("value"), day)).alias("slope"), F.count("*").alias("points"))


def inputs(pins: DataFrame, metrics: DataFrame, points: DataFrame) -> DataFrame:
    """Pinned metrics in order, with their place among those that the catalog knows (null for others) and the reason why one is left out, if it is: unknown, past the
    first MOST_METRICS known ones, or without a point in the window. points: what series.route says of the window, so derived metrics and sleep have
    points as well."""
    known = metrics.select(F.col("slug").alias("metric"), F.lit(True).alias("known"))
    has = points.select("account_id", "metric").distinct().withColumn("has", F.lit(True))
    # Unknown pins take no place: the count runs over known ones only.
    place = F.sum(F.col("known").cast("int")).over(W.partitionBy("account_id").orderBy("position", "metric"))
    marked = pins.join(F.broadcast(known), "metric", "left").withColumn("place", F.when(F.col("known"), place)).join(has, ["account_id", "metric"], "left")
    reason = F.when(F.col("known").isNull(), "not in the catalog").when(F.col("place") > MOST_METRICS, f"beyond the {MOST_METRICS} compared").when(F.col("has").isNull(), "no data in this window")
    return marked.select("account_id", "metric", "place", reason.alias("skipped"))


def of_pins(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Points of the pinned metrics that aren't left out, with their place: what co_vary pairs for an account."""
    return found.join(chosen.filter(F.col("skipped").isNull()).select("account_id", "metric", "place"), ["account_id", "metric"])
