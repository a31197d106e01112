"""Relational track operators: segmentation, cleaning, bounds, windows and interpolation, all native columns.

Points are rows (track, seq, t, x, y).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_seq():
    return W.partitionBy("track").orderBy("seq")


def whole():
    return W.partitionBy("track")


def project(points: DataFrame, radius: float = 6_371_000.0) -> DataFrame:
    """Equirectangular metres about the mean of the tracks' centroids; points carry lat and lon."""
    centre = points.groupBy("track").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    return points.crossJoin(F.broadcast(centre)).withColumn("x", radius * F.radians(F.col("lon") - F.col("lon0")) * F.cos(F.radians("lat0"))).withColumn("y", radius * F.radians(F.col("lat") - F.col("lat0"))).drop("lat0", "lon0")


def breaks(points: DataFrame, max_dt: float, max_speed: float) -> DataFrame:
    """brk: a gap over max_dt, a speed over max_speed, or time that does not advance."""
    dt = F.col("t") - F.lag("t").over(by_seq())
    step = F.hypot(F.col("x") - F.lag("x").over(by_seq()), F.col("y") - F.lag("y").over(by_seq()))
    return points.withColumn("brk", F.coalesce((dt > max_dt) | (dt <= 0) | (step > dt * max_speed), F.lit(False)))


def segments(points: DataFrame, max_dt: float, max_speed: float) -> DataFrame:
    """seg numbers from 0 within a track and seg_t, time since the segment's first point."""
    out = breaks(points, max_dt, max_speed).withColumn("seg", F.sum(F.col("brk").cast("long")).over(by_seq().rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("seg_t", F.col("t") - F.min("t").over(W.partitionBy("track", "seg"))).drop("brk")


def islands(points: DataFrame, inside: Column) -> DataFrame:
    """Points inside, with island numbers from 0; an exit ends an island."""
    p = points.withColumn("_in", inside).withColumn("_edge", (F.col("_in") != F.coalesce(F.lag("_in").over(by_seq()), F.lit(False))) & F.col("_in"))
    p = p.withColumn("island", F.sum(F.col("_edge").cast("long")).over(by_seq().rowsBetween(W.unboundedPreceding, 0)) - 1)
    return p.where("_in").drop("_in", "_edge")


def length_filter(points: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    n = F.count("*").over(W.partitionBy(*keys))
    return points.withColumn("_n", n).where(F.col("_n").between(least, most)).drop("_n")


def time_problems(points: DataFrame) -> DataFrame:
    """(track, n, span, min_dt, bad): tracks of over two points need a positive span and time that never falls."""
    d = points.withColumn("dt", F.col("t") - F.lag("t").over(by_seq())).groupBy("track").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.min("dt").alias("min_dt"))
    return d.withColumn("bad", (F.col("n") > 2) & ((F.col("span") <= 0) | (F.col("min_dt") < 0)))


def chord_parameter(points: DataFrame, least: float = 1e-6) -> DataFrame:
    """u in [0, 1] by chord length; steps count at least `least`."""
    step = F.when(F.lag("x").over(by_seq()).isNull(), F.lit(0.0)).otherwise(F.greatest(F.hypot(F.col("x") - F.lag("x").over(by_seq()), F.col("y") - F.lag("y").over(by_seq())), F.lit(least)))
    p = points.withColumn("_s", step).withColumn("_c", F.sum("_s").over(by_seq().rowsBetween(W.unboundedPreceding, 0)))
    return p.withColumn("u", F.when(F.sum("_s").over(whole()) > 0, F.col("_c") / F.sum("_s").over(whole())).otherwise(F.lit(0.0))).drop("_s", "_c")


def gradient(points: DataFrame, value: str, out: str) -> DataFrame:
    """Second-order differences on uneven steps, one-sided at the ends."""
    a, b = F.col("t") - F.lag("t").over(by_seq()), F.lead("t").over(by_seq()) - F.col("t")
    f, f0, f1 = F.col(value), F.lag(value).over(by_seq()), F.lead(value).over(by_seq())
    inner = (a * a * f1 + (b * b - a * a) * f - b * b * f0) / (a * b * (a + b))
    return points.withColumn(out, F.when(a.isNull(), (f1 - f) / b).when(b.isNull(), (f - f0) / a).otherwise(inner))


def quantised(value: Column, scale: float = 100.0, limit: float = 2e9) -> Column:
    """Half-even rounding to an integer grid; not-a-number is 0."""
    return F.bround(F.greatest(F.least(F.nanvl(value, F.lit(0.0)) * scale, F.lit(limit)), F.lit(-limit)), 0).cast("long")


def deltas(points: DataFrame, value: str, out: str) -> DataFrame:
    return points.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(by_seq()), F.lit(0).cast("long")))


def undeltas(points: DataFrame, value: str, out: str) -> DataFrame:
    return points.withColumn(out, F.sum(value).over(by_seq().rowsBetween(W.unboundedPreceding, 0)))


def interpolated(points: DataFrame, kept: Column) -> DataFrame:
    """At every point the kept vertices' linear interpolation (ix, iy) and piecewise velocity (vx, vy)."""
    p = points.withColumn("_k", kept)
    before, after = by_seq().rowsBetween(W.unboundedPreceding, 0), by_seq().rowsBetween(1, W.unboundedFollowing)
    row = F.when(F.col("_k"), F.struct("t", "x", "y"))
    p = p.withColumn("_a", F.last(row, ignorenulls=True).over(before)).withColumn("_b", F.first(row, ignorenulls=True).over(after))
    f = (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    for c in ("x", "y"):
        p = p.withColumn(f"v{c}", (F.col(f"_b.{c}") - F.col(f"_a.{c}")) / (F.col("_b.t") - F.col("_a.t"))).withColumn(f"i{c}", F.when(F.col("_b").isNull(), F.col(f"_a.{c}")).otherwise(F.col(f"_a.{c}") + f * (F.col(f"_b.{c}") - F.col(f"_a.{c}"))))
    return p.drop("_k", "_a", "_b")


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; a degenerate segment is its point."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    f = F.when(n > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.hypot(px - ax - f * dx, py - ay - f * dy)


def chord_measures(points: DataFrame) -> DataFrame:
    """Against the first-last chord: sed (time-synchronised distance), dist (to the segment), back (backward-motion bound so far)."""
    p = points
    for c in ("t", "x", "y"):
        p = p.withColumn(f"{c}0", F.first(c).over(by_seq().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).withColumn(f"{c}1", F.last(c).over(by_seq().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    f = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(F.lit(0.0))
    p = p.withColumn("sed", F.hypot(F.col("x") - F.col("x0") - f * (F.col("x1") - F.col("x0")), F.col("y") - F.col("y0") - f * (F.col("y1") - F.col("y0"))))
    p = p.withColumn("dist", segment_distance(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")]))
    n = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    p = p.withColumn("s", F.when(n > 0, ((F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / n).otherwise(F.lit(0.0)))
    return p.withColumn("back", (F.max("s").over(by_seq().rowsBetween(W.unboundedPreceding, 0)) - F.col("s")) / 2).select("track", "seq", "sed", "dist", "s", "back")


def summary(points: DataFrame) -> DataFrame:
    """One row a track: ends, bounding box, diagonal, path length and time steps."""
    d = points.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(by_seq()), F.col("y") - F.lag("y").over(by_seq()))).withColumn("dt", F.col("t") - F.lag("t").over(by_seq()))
    out = d.groupBy("track").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.min("dt").alias("dt_min"), F.max("dt").alias("dt_max"), F.stddev_pop("dt").alias("dt_std"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.min_by("x", "seq").alias("x0"), F.min_by("y", "seq").alias("y0"), F.max_by("x", "seq").alias("xn"), F.max_by("y", "seq").alias("yn"))
    return out.withColumn("diag", F.hypot(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))


def extents(nested: DataFrame) -> DataFrame:
    """Of nested tracks what bounds need of a summary: ends and bounding box."""
    ends = [f(c).alias(f"{c}{n}") for c in ("x", "y") for f, n in ((lambda c: F.get(c, F.lit(0)), "0"), (lambda c: F.element_at(c, -1), "n"), (F.array_min, "min"), (F.array_max, "max"))]
    return nested.select("track", *ends)


def length(x: Column, y: Column) -> Column:
    """The root of the sum of squares as SQL states it; hypot may round the last bit otherwise, which moves bounds over a radius or a rounding edge."""
    return F.sqrt(x * x + y * y)


def bounds(a: str, b: str) -> tuple[Column, Column]:
    """(endpoint bound, bounding-box gap) between two summaries; both are at most the Frechet distance."""
    c = lambda side, n: F.col(f"{side}.{n}")
    ends = F.greatest(length(c(a, "x0") - c(b, "x0"), c(a, "y0") - c(b, "y0")), length(c(a, "xn") - c(b, "xn"), c(a, "yn") - c(b, "yn")))
    gap = lambda lo, hi: F.greatest(c(a, lo) - c(b, hi), c(b, lo) - c(a, hi), F.lit(0.0))
    return ends, length(gap("xmin", "xmax"), gap("ymin", "ymax"))


def candidate_pairs(queries: DataFrame, corpus: DataFrame, radius: float, many: bool | None = False) -> DataFrame:
    """(q, c, lb) with the cheap bound within radius. A row meets its own number if many is None, or, if it is true, where its column many is.

    Both start and end points are hashed to cells two radii wide, of which a query reaches at most two a dimension. So
    tracks that share a start meet only where their ends are near as well.
    """
    wide, ends = 2 * radius * (1 + 1e-9) + 1e-12, ("x0", "y0", "xn", "yn")
    left, right = queries, corpus
    for c in ends:
        reach = F.array_distinct(F.array(*[F.floor((F.col(c) + d * wide / 2) / wide).cast("long") for d in (-1, 1)]))
        left, right = left.withColumn(f"c{c}", F.explode(reach)), right.withColumn(f"c{c}", F.floor(F.col(c) / wide).cast("long"))
    near, box = bounds("l", "r")
    apart = F.lit(True) if many is None else F.col("l.track") != F.col("r.track")
    if many:
        apart = apart | F.col("l.many")
    met = left.alias("l").join(right.alias("r"), [*[F.col(f"l.c{c}") == F.col(f"r.c{c}") for c in ends], apart])
    return met.select(F.col("l.track").alias("q"), F.col("r.track").alias("c"), F.greatest(near, box).alias("lb")).where(F.col("lb") <= radius)


def inner_samples(points: DataFrame) -> DataFrame:
    """Points but the first and last of each track, where estimates have edge effects."""
    p = points.withColumn("_i", F.row_number().over(by_seq())).withColumn("_n", F.count("*").over(whole()))
    return p.where((F.col("_i") > 1) & (F.col("_i") < F.col("_n"))).drop("_i", "_n")


def load(points: DataFrame, n: int, least: int = 50, most: int = 2000, seed: int = 42) -> DataFrame:
    """A seeded sample of n tracks of least to most points; points carry lat and lon, which are projected about the sample's centre."""
    from curvespark.operators import vectors as V

    sizes = points.groupBy("track").agg(F.count("*").alias("_n")).where(F.col("_n").between(least, most))
    return project(points.join(V.seeded_sample(sizes.select("track"), "track", n, seed), "track", "left_semi"))


def clean(points: DataFrame, max_dt: float, max_speed: float, inside: Column | None = None, least: int = 1, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(points by track, seg, island with time from 0, one row of counters).

    Tracks are cut at gaps and jumps, then at exits from the region; single points and pieces beyond the length limits go. The counters
    are the tracks and points read, segments, segments of one point, pieces dropped by length, and what is left.
    """
    seg = segments(points, max_dt, max_speed)
    sized = seg.withColumn("_n", F.count("*").over(W.partitionBy("track", "seg")))
    runs = sized.where("_n > 1").drop("_n").withColumn("_piece", F.struct("track", "seg"))
    if inside is None:
        pieces = runs.withColumn("island", F.lit(0).cast("long"))
    else:
        w = W.partitionBy("track", "seg").orderBy("seq")
        pieces = runs.withColumn("_in", F.coalesce(inside, F.lit(False)))
        pieces = pieces.withColumn("_edge", F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)))
        pieces = pieces.withColumn("island", F.sum(F.col("_edge").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).where("_in").drop("_in", "_edge")
    keys = ("track", "seg", "island")
    pieces = pieces.drop("_piece").withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    kept = pieces.where(F.col("_n").between(max(least, 2), most)).withColumn("seg_t", F.col("t") - F.min("t").over(W.partitionBy(*keys))).drop("_n")
    count = lambda df, *names: df.groupBy(*names).agg(F.count("*").alias("n"))
    read = count(points, "track").agg(F.count("*").alias("tracks"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))
    cut = count(seg, "track", "seg").agg(F.count("*").alias("segments"), F.count_if(F.col("n") == 1).alias("singletons"))
    short = count(pieces, *keys).agg(F.count_if(~F.col("n").between(max(least, 2), most)).alias("length_drops"))
    left = count(kept, *keys).agg(F.count("*").alias("pieces"), F.coalesce(F.sum("n"), F.lit(0)).alias("points_left"))
    return kept, read.crossJoin(cut).crossJoin(short).crossJoin(left)


def worst(errors: DataFrame, n: int = 5) -> DataFrame:
    """The n tracks of largest error, ties to the smaller track."""
    return errors.orderBy(F.col("error").desc(), "track").limit(n)
