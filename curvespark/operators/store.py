"""Track, vector and curve stores: representations with certificates, certified range and nearest-neighbour
queries, and a space-filling-curve vector index. Kernels run Arrow-batched on rows that cheap native bounds left over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvespark.functions import curves, frechet
from curvespark.operators import tracks as T
from curvespark.operators import vectors as V
from curvespark.sources.tables import cut, nested

CURVE = "track long, n int, kept array<int>, lx array<double>, ly array<double>, eps double"


def xy(x, y) -> np.ndarray:
    return np.column_stack((np.asarray(x, float), np.asarray(y, float)))


def map_rows(df: DataFrame, f, schema: str) -> DataFrame:
    """f(row) -> iterable of tuples, over Arrow batches.

    Rows are small and kernels dear, so rows are dealt by a hash of their keys to all tasks, whatever their bytes come
    to. A hash: dealing by the keys themselves would be dropped behind an aggregation by them, and its shuffle merged to few tasks.
    """
    names = [c.strip().split()[0] for c in schema.split(", ")]
    keys = [c for c in ("track", "q", "c", "query_id", "doc_id", "method", "tol") if c in df.columns]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([out for row in batch.itertuples(index=False) for out in f(row)], columns=names)

    return dealt(df, keys).mapInPandas(run, schema)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def map_batches(df: DataFrame, keys: list[str], f, schema: str, rows: int = 512) -> DataFrame:
    """f(frame of at most rows rows) -> frame, dealt like map_rows."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), rows):
                yield f(batch.iloc[a : a + rows])

    return dealt(df, keys).mapInPandas(run, schema)


def simplified(points: DataFrame, tol: float, method: str = "sed") -> DataFrame:
    return certified(nested(points), tol, method)


def certified(tracks: DataFrame, tol: float, method: str = "sed") -> DataFrame:
    """Kept vertices of each track and a certificate eps, a proven bound of the distance to the original; one point is its own simplification."""

    def one(r):
        p = xy(r.x, r.y)
        kept = np.arange(1) if len(p) == 1 else curves.simplify_sed(np.asarray(r.t), p, tol) if method == "sed" else curves.douglas_peucker(p, tol)
        yield r.track, len(p), kept.astype(int).tolist(), p[kept, 0].tolist(), p[kept, 1].tolist(), curves.certify(p, kept)

    return map_rows(tracks, one, CURVE)


def curves_of(batch: pd.DataFrame, side: str) -> list[np.ndarray]:
    return [xy(x, y) for x, y in zip(batch[f"{side}x"], batch[f"{side}y"])]


#: Curves of a tile's side at most, about; tiles of a side at least; pairs that a kernel has at once.
TILE, TILES, PAIRS = 512, 12, 4096


def tiled(pairs: DataFrame, left: DataFrame, right: DataFrame, f, schema: str) -> DataFrame:
    """f(frame of pairs, left curves, right curves) -> frame, for pairs (q, c, ...) of curves (track, x, y, eps or not).

    Both sides are cut to groups by a hash. A task has the pairs of two groups as numbers alone, and each curve of both
    groups once, so no curve is copied a pair. Frames get columns qe and ce where the curves have eps.
    """
    groups = max(TILES, -(-max(left.count(), right.count() if right is not left else 0) // TILE))
    parts, group = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))

    def side(df, first):
        eps = F.col("eps") if "eps" in df.columns else F.lit(0.0)
        rows = df.select(group("track").alias("_g"), every.alias("_o"), F.lit(first).alias("_left"), "track", "x", "y", eps.alias("eps"))
        at = (F.col("_g"), F.col("_o")) if first else (F.col("_o"), F.col("_g"))
        return rows.select((at[0] * groups + at[1]).alias("_tile"), "_left", "track", "x", "y", "eps")

    names = [c.strip().split()[0] for c in schema.split(", ")]
    numbered = pairs.withColumn("_tile", group("q") * groups + group("c")).repartition(parts, "_tile")
    sides = side(left, True).union(side(right, False)).repartition(parts, "_tile")

    def run(p, both):
        done = []
        if len(p):
            known = [(rows := both[both["_left"] == first])["track"].to_numpy() for first in (True, False)]
            shapes = [[xy(x, y) for x, y in zip(rows["x"], rows["y"])] for rows in (both[both["_left"]], both[~both["_left"]])]
            order = [np.argsort(k) for k in known]
            p = p[np.isin(p["q"], known[0]) & np.isin(p["c"], known[1])]
            at = [o[np.searchsorted(k, p[c], sorter=o)] for k, o, c in zip(known, order, ("q", "c"))]
            for n, first in zip(("qe", "ce"), (True, False)):
                p = p.assign(**{n: both.loc[both["_left"] == first, "eps"].to_numpy()[at[not first]]})
            for a in range(0, len(p), PAIRS):
                i, j = (k[a : a + PAIRS] for k in at)
                done.append(f(p.iloc[a : a + PAIRS], [shapes[0][k] for k in i], [shapes[1][k] for k in j])[names])
        return pd.concat(done) if done else pd.DataFrame(columns=names)

    return numbered.groupBy("_tile").cogroup(sides.groupBy("_tile")).applyInPandas(run, schema)


def compare_many(pairs: DataFrame, left: DataFrame, right: DataFrame, kernel, out: str) -> DataFrame:
    """kernel(ps, qs), a value a pair, for pairs (q, c) of nested tracks (track, x, y), as column out (double)."""
    run = lambda b, ps, qs: b[["q", "c"]].assign(**{out: np.asarray(kernel(ps, qs), float)})
    return tiled(pairs.select("q", "c"), left.select("track", "x", "y"), right.select("track", "x", "y"), run, f"q long, c long, {out} double")


def compare(pairs: DataFrame, left: DataFrame, right: DataFrame, kernel, out: str) -> DataFrame:
    """compare_many for a kernel(p, q) of one pair."""
    return compare_many(pairs, left, right, lambda ps, qs: [float(kernel(p, q)) for p, q in zip(ps, qs)], out)


def shapes(tracks: DataFrame) -> DataFrame:
    """Nested tracks of equal times and points as one row (track: the least, t, x, y, copies: all of them)."""
    return tracks.groupBy("t", "x", "y").agg(F.min("track").alias("track"), F.collect_list("track").alias("copies")).select("track", "t", "x", "y", "copies")


def near_shapes(whole: DataFrame, radius: float) -> DataFrame:
    """Pairs (q, c) of shapes with the cheap bound within radius, q < c, and each shape that has copies with itself."""
    s = T.extents(whole).join(whole.select("track", (F.size("copies") > 1).alias("many")), "track")
    return T.candidate_pairs(s, s, radius, many=True).where("q <= c").select("q", "c")


def spread(told: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Rows (q, c, ...) of shapes for all pairs of their copies (left and right: shapes), no track with itself.

    Without right, rows (q <= c) of one table's shapes for its pairs of tracks, the smaller number first.
    """
    side = lambda whole, n: whole.select(F.col("track").alias(n), F.col("copies").alias(f"_{n}"))
    rest = [n for n in told.columns if n not in ("q", "c")]
    each = told.join(side(left, "q"), "q").join(side(left if right is None else right, "c"), "c")
    each = each.withColumn("_a", F.explode("_q")).select("q", "c", "_a", F.explode("_c").alias("_b"), *rest)
    if right is not None:
        return each.where("_a <> _b").select(F.col("_a").alias("q"), F.col("_b").alias("c"), *rest)
    return each.where("q < c OR _a < _b").select(F.least("_a", "_b").alias("q"), F.greatest("_a", "_b").alias("c"), *rest)


def counted(told: DataFrame, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Rows of shapes with pairs, how many ordered pairs of tracks each stands for; without right, rows (q <= c) stand for their mirror images too."""
    side = lambda whole, n: whole.select(F.col("track").alias(n), F.col("copies").alias(f"_{n}"))
    each = told.join(side(left, "q"), "q").join(side(left if right is None else right, "c"), "c")
    n = F.size("_q").cast("long") * F.size("_c")
    if right is None:
        n = F.when(F.col("q") == F.col("c"), n - F.size("_q")).otherwise(2 * n)
    else:
        n = n - F.size(F.array_intersect("_q", "_c"))
    return each.select(*told.columns, n.alias("pairs")).where("pairs > 0")


def measured_pairs(points: DataFrame, radius: float, f, schema: str) -> DataFrame:
    """f(frame of pairs, curves, curves) -> frame for the pairs q < c of tracks that the cheap bound leaves within radius; tracks of equal points are measured once."""
    whole = cut(shapes(nested(points)))
    curves_ = whole.select("track", "x", "y")
    return spread(tiled(near_shapes(whole, radius), curves_, curves_, f, schema), whole)


def certified_pairs(queries: DataFrame, corpus: DataFrame, r: float, tol: float) -> tuple[DataFrame, list, list]:
    """((q, c, outcome, hit) of pairs of shapes that the cheap bound leaves within r, both sides' shapes, both sides' simplified curves).

    Simplified curves first, the originals for 'refine' only. Tracks are nested and certified once for each shape; where queries
    is corpus, one table serves both, its side of the shapes is there once, and pairs have q <= c.
    """
    def made(points):
        whole = cut(shapes(nested(points)))
        lines = cut(certified(whole, tol)).select("track", F.col("lx").alias("x"), F.col("ly").alias("y"), "eps")
        return whole, lines

    sides = [made(corpus)] if queries is corpus else [made(queries), made(corpus)]
    extents = [T.extents(whole).join(whole.select("track", (F.size("copies") > 1).alias("many")), "track") for whole, _ in sides]
    pairs = T.candidate_pairs(extents[0], extents[-1], r, many=True if len(sides) == 1 else None)
    if len(sides) == 1:
        pairs = pairs.where("q <= c")
    lines = [side[1] for side in sides]
    tell = lambda b, ps, qs: b[["q", "c"]].assign(outcome=curves.outcomes(ps, qs, r, (b["qe"] + b["ce"]).to_numpy(), b["lb"].to_numpy()))
    told = cut(tiled(pairs, lines[0], lines[-1], tell, "q long, c long, outcome string"))
    exact = compare_many(told.where("outcome = 'refine'"), sides[0][0], sides[-1][0], lambda ps, qs: frechet.decide_many(ps, qs, r), "within")
    hit = (F.col("outcome") == "accept") | F.coalesce(F.col("within") == 1, F.lit(False))
    return told.join(exact, ["q", "c"], "left").select("q", "c", "outcome", hit.alias("hit")), [side[0] for side in sides], lines


def certified_range(queries: DataFrame, corpus: DataFrame, r: float, tol: float) -> DataFrame:
    """(q, c, outcome, hit) for pairs of tracks the cheap bound leaves within r: certified_pairs for all copies of the shapes."""
    told, wholes, _ = certified_pairs(queries, corpus, r, tol)
    out = spread(told, *wholes)
    return mirrored(out) if queries is corpus else out


def mirrored(pairs: DataFrame) -> DataFrame:
    """Pairs (q, c, ...) and their mirror images."""
    both = F.explode(F.array(F.struct("q", "c"), F.struct(F.col("c").alias("q"), F.col("q").alias("c")))).alias("_p")
    rest = [c for c in pairs.columns if c not in ("q", "c")]
    return pairs.select(both, *rest).select("_p.q", "_p.c", *rest)


def knn(queries: DataFrame, corpus: DataFrame, k: int, pool: int) -> DataFrame:
    """(q, c, dist, rank) by discrete Frechet distance: the bound's nearest `pool` fix a radius, then every track whose bound is within it is measured."""
    ends, box = T.bounds("l", "r")
    s, t = T.summary(queries), T.summary(corpus)
    whole = lambda df, n: df.select(F.col("track").alias(n), F.struct("*").alias("l" if n == "q" else "r"))
    lb = V.against_all(whole(t, "c"), whole(s, "q"), "c").where("q <> c").select("q", "c", F.greatest(ends, box).alias("lb"))
    measured = lambda pairs: compare_many(pairs, asked, held, curves.discrete_frechet_many, "dist")
    asked, held = cut(nested(queries)), cut(nested(corpus))
    near = V.ranked(lb, "q", "lb", "c", pool, False)
    radius = V.ranked(measured(near), "q", "dist", "c", k, False).groupBy("q").agg(F.max("dist").alias("r"), F.count("*").alias("m"))
    rest = lb.join(radius, "q").where((F.col("lb") <= F.col("r")) | (F.col("m") < k)).select("q", "c")
    return V.ranked(measured(rest), "q", "dist", "c", k, False)


def hilbert_keyed(vectors: DataFrame, bits: int = 10, dims: int = 12) -> DataFrame:
    """vectors (vec_id, v) with hkey, the 16-byte big-endian key of their first dims grid coordinates."""
    lo = V.dimension_ranges(vectors, "v", dims).agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("m"))
    grid = F.transform("m", lambda m: V.to_grid(F.get("v", m["dim"]), m["lo"], m["hi"], bits))
    rows = vectors.crossJoin(F.broadcast(lo)).select("vec_id", "v", grid.alias("g"))

    def run(batches):
        for b in batches:
            keys = curves.hilbert_keys(np.array(b["g"].tolist()), bits) if len(b) else []
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "hkey": [k.to_bytes(16, "big") for k in keys]})

    return rows.mapInPandas(run, "vec_id long, v array<double>, hkey binary")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, pool: int = 100, exact: bool = True) -> DataFrame:
    """Top k by cosine over a space-filling-curve index of every row.

    The pool nearest rows on the curve on either side of a query give its first k. Rows are numbered along the curve by
    range partitions, so no window holds the whole table. If exact, each run of pool rows carries the mean of its unit
    vectors and their largest distance to it, which bounds every similarity in the run; runs whose bound reaches
    the query's k-th similarity are read as well. The result is then the true top k; it costs a scan where
    the bounds rule nothing out (noise) and little where rows that are alike lie together.
    """
    keyed = hilbert_keyed(vectors)
    ordered = keyed.repartitionByRange("hkey").sortWithinPartitions("hkey", "vec_id").withColumn("pos", F.monotonically_increasing_id()).drop("hkey")
    ordered = cut(ordered.withColumn("cell", F.floor(F.col("pos") / pool)).withColumn("u", F.transform("v", lambda x: x / (V.norm(F.col("v")) + 1e-10))))
    q = cut(ordered.join(queries.select("vec_id"), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("u").alias("qu"), "pos", "cell"))
    runs = ordered.select("vec_id", "u", F.col("pos").alias("p"), "cell")
    score = F.round(V.dot(F.col("qu"), F.col("u")), 6).alias("sim")
    near = q.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).join(runs, "cell").where((F.abs(F.col("p") - F.col("pos")) <= pool) & (F.col("vec_id") != F.col("query_id")))
    first = V.ranked(near.select("query_id", "vec_id", score), "query_id", "sim", "vec_id", k)
    if not exact:
        return first
    dims = (ordered.select(F.size("u").alias("n")).first() or [0])[0]
    mean = ordered.groupBy("cell").agg(F.array(*[F.avg(F.get("u", F.lit(i))) for i in range(dims)]).cast("array<double>").alias("mid"))
    spread = ordered.join(mean, "cell").groupBy("cell").agg(F.first("mid").alias("mid"), F.max(V.l2(F.col("u"), F.col("mid"))).alias("radius"))
    least = first.groupBy("query_id").agg(F.min("sim").alias("least"), F.count("*").alias("n"))
    asked = q.select("query_id", "qu").join(least, "query_id", "left")
    reached = (F.coalesce("n", F.lit(0)) < k) | (V.dot(F.col("qu"), F.col("mid")) + F.col("radius") + 1e-6 >= F.col("least"))
    rest = V.against_all(spread, asked, "cell").where(reached).select("query_id", "qu", "cell").join(runs, "cell").where("vec_id <> query_id")
    return V.ranked(rest.select("query_id", "vec_id", score), "query_id", "sim", "vec_id", k)


def principal_scores(rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """Centred principal-component scores, each component signed so that its largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, scores array<double>"
    data = rows.select(array_to_vector(vector).alias("features"))
    if not data.take(1):
        return rows.sparkSession.createDataFrame([], schema)
    mean = data.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    loadings = PCA(k=k, inputCol="features", outputCol="out").fit(data).pc.toArray()
    loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])

    def run(batches):
        # the components travel with the function: as literals they would be printed in every plan that the driver keeps
        for b in batches:
            if len(b):
                yield pd.DataFrame({id_col: b[id_col], "scores": list((np.stack(b[vector].to_numpy()) - mean) @ loadings)})

    return rows.select(id_col, vector).mapInPandas(run, schema)


def outcome_counts(told: DataFrame) -> DataFrame:
    """For each outcome its pairs and hits; rows of shapes count as the pairs of tracks they stand for."""
    n = F.col("pairs") if "pairs" in told.columns else F.lit(1).cast("long")
    return told.groupBy("outcome").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("hit"), n).otherwise(0)).alias("hits"))


def numbered(points: DataFrame, most: int) -> DataFrame:
    """The first `most` points of each track."""
    return points.withColumn("_n", F.row_number().over(W.partitionBy("track").orderBy("seq"))).where(F.col("_n") <= most).drop("_n")
