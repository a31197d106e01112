"""Queries of the kernel operators on event tracks; where a closed form exists they have a SQL twin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from curvespark.functions import curves, frechet
from curvespark.operators import store, tracks
from curvespark.plans.native import PTS, TOP, points, query, r6, vec
from curvespark.sources.tables import cut, nested


def measured_many(kernel, out):
    def run(spark, d):
        tell = lambda b, ps, qs: b[["q", "c"]].assign(**{out: np.asarray(kernel(ps, qs), float)})
        return store.measured_pairs(points(spark, d), 400.0, tell, f"q long, c long, {out} double").select("q", "c", r6(out).alias(out))

    return run


def named(name, f):
    f.__name__ = name
    return query(None)(f)


frechet_discrete = named("frechet_discrete", measured_many(curves.discrete_frechet_many, "dist"))
dtw = named("dtw", measured_many(curves.dtw_many, "cost"))
frechet_decide = named("frechet_decide", measured_many(lambda ps, qs: frechet.decide_many(ps, qs, 200.0), "within"))
frechet_distance = named("frechet_distance", measured_many(lambda ps, qs: frechet.distance_many(ps, qs, 1e-3), "dist"))
frechet_upper = named("frechet_upper", measured_many(lambda ps, qs: frechet.distance_many(ps, qs, 1e-3, 1), "upper"))
hausdorff_lb = named("hausdorff_lb", measured_many(curves.hausdorff_many, "lb"))


@query(None)
def simplify_sed(spark, d):
    return store.simplified(points(spark, d), 20.0).select("track", "n", "kept", r6("eps").alias("eps"))


@query(None)
def simplify_dp(spark, d):
    return store.simplified(points(spark, d), 20.0, "dp").select("track", "n", "kept", r6("eps").alias("eps"))


@query(None)
def certified_range(spark, d):
    p = points(spark, d)
    return store.certified_range(p, p, 200.0, 10.0)


@query(None)
def certified_outcomes(spark, d):
    p = points(spark, d)
    told, wholes, _ = store.certified_pairs(p, p, 200.0, 10.0)
    return store.outcome_counts(store.counted(told, *wholes))


@query(f"WITH {PTS} SELECT DISTINCT track AS q, -track - 1 AS c, 5 * (track % 7 + 1) <= 22 AS hit FROM p WHERE 5 * (track % 7 + 1) <= 22")
def certified_range_translated(spark, d):
    """Each track against its copy moved by 5 * m: the distance is the length of the move."""
    p = points(spark, d)
    m = F.col("track") % 7 + 1
    moved = p.select((-F.col("track") - 1).alias("track"), "seq", "t", (F.col("x") + 3 * m).alias("x"), (F.col("y") + 4 * m).alias("y"))
    return store.certified_range(p, moved, 22.0, 2.0).where("hit AND c = -q - 1").select("q", "c", "hit")


@query(None)
def knn_frechet(spark, d):
    p = points(spark, d)
    return store.knn(p.where("track % 50 = 0"), p, 5, 10).select("q", "c", "rank", r6("dist").alias("dist"))


@query(None)
def hilbert_keys(spark, d):
    return store.hilbert_keyed(vec(spark, d).select("vec_id", "v")).select("vec_id", F.hex("hkey").alias("hkey"))


@query(f"WITH {TOP} SELECT query_id, rank, vec_id, sim FROM top")
def vector_search(spark, d):
    e = vec(spark, d).select("vec_id", "v")
    return store.vector_search(e, e.where("vec_id % 50 = 0"))


@query(None)
def pca_scores(spark, d):
    return store.principal_scores(vec(spark, d).select("vec_id", "v"), "vec_id", "v", 4)


@query(None)
def segment_codec(spark, d):
    def one(r):
        p = store.xy(r.x, r.y)
        blob = curves.encode_track(np.asarray(r.t), p)
        t, back = curves.decode_track(blob)
        yield r.track, len(p), len(blob), float(max(np.abs(back - p).max(), np.abs(t - r.t).max()))

    return store.map_rows(nested(points(spark, d)), one, "track long, n int, bytes int, worst double")


@query(None)
def lsq_spline(spark, d):
    def one(r):
        if len(r.t) > 4:
            u = np.asarray(r.t) / r.t[-1]
            knots, c, worst = curves.fit_spline(u, store.xy(r.x, r.y), 50.0)
            yield r.track, len(r.t), knots.tolist(), c[:, 0].tolist(), c[:, 1].tolist(), worst

    return store.map_rows(nested(points(spark, d)), one, "track long, n int, knots array<double>, cx array<double>, cy array<double>, worst double")


@query(None)
def kalman_rts(spark, d):
    def one(r):
        t = np.asarray(r.t) / 3600
        for axis, z in (("x", r.x), ("y", r.y)):
            for i, (p, v, a) in enumerate(curves.kalman(t, np.asarray(z, float), 5.0, 1.0)):
                yield r.track, i, axis, float(p), float(v), float(a)

    return store.map_rows(nested(points(spark, d)), one, "track long, seq long, axis string, position double, velocity double, acceleration double")


@query(None)
def savgol(spark, d):
    return store.map_rows(nested(points(spark, d)), lambda r: ((r.track, i, float(a), float(b)) for i, (a, b) in enumerate(zip(curves.savgol(np.asarray(r.x)), curves.savgol(np.asarray(r.y))))), "track long, seq long, x double, y double")


@query(None)
def bootstrap_ci(spark, d):
    rows = tracks.interpolated(points(spark, d), F.col("seq") % 5 == 0).groupBy("track").agg(F.collect_list(F.abs(F.col("x") - F.col("ix"))).alias("e"))
    return store.map_rows(rows, lambda r: [(r.track, *curves.bootstrap(np.sort(np.asarray(r.e)), 500, int(r.track)))], "track long, mean double, low double, high double")


@query(None)
def certify_spline(spark, d):
    from curvespark.functions import splines

    def one(r):
        if len(r.t) > 4:
            p, u = store.xy(r.x, r.y), np.asarray(r.t) / r.t[-1]
            knots, c, _ = curves.fit_spline(u, p, 50.0)
            line, eps = splines.certify_spline(p, knots, c, 3, 50.0, 10.0, 5)
            yield r.track, len(p), len(c), len(line), float(eps)

    return store.map_rows(nested(points(spark, d)), one, "track long, n int, control int, vertices int, eps double")


@query(None)
def knot_removal(spark, d):
    from curvespark.functions import splines

    def one(r):
        if len(r.t) > 12:
            p, u = store.xy(r.x, r.y), np.asarray(r.t) / r.t[-1]
            full = curves.spline_knots(u, len(u) // 4)
            yield r.track, len(full), len(splines.remove_knots(u, p, full, 100.0))

    return store.map_rows(nested(points(spark, d)), one, "track long, before int, after int")


@query(None)
def pchip_velocity(spark, d):
    from curvespark.functions import splines

    return store.map_rows(nested(points(spark, d)), lambda r: ((r.track, i, float(v)) for i, v in enumerate(splines.pchip_slopes(np.asarray(r.t), np.asarray(r.x)) if len(r.t) > 1 else [])), "track long, seq long, vx double")


@query(None)
def synthetic_tracks(spark, d):
    from curvespark.sources import synth

    return synth.tracks(spark, 8)


@query(None)
def curve_search(spark, d):
    from curvespark.operators import curve_store
    from curvespark.sources.tables import table

    c = cut(curve_store.text_curves(table(spark, d, "documents")))
    return curve_store.search(c, c.where("doc_id % 50 = 0").select("doc_id")).select("query_id", "doc_id", "rank", r6("dist").alias("dist"))


TOLERANCES = [5.0, 10.0, 20.0, 40.0, 80.0, 160.0]


@query(None)
def param_sweep(spark, d):
    from curvespark.operators import sweeps

    return sweeps.cheapest(sweeps.grid(points(spark, d), TOLERANCES), 50.0).select("track", "method", "tol", "kept", "bytes", r6("eps").alias("eps"))


@query(None)
def sweep_report(spark, d):
    from curvespark.operators import sweeps

    return sweeps.report(sweeps.grid(points(spark, d), TOLERANCES), 50.0).select("method", "tol", "tracks", *[r6(c).alias(c) for c in ("reached", "bytes", "eps_median", "eps_p99", "eps_max")])


@query(None)
def approx_error_rates(spark, d):
    from curvespark.operators import sweeps

    p = points(spark, d)
    told, wholes = sweeps.approximate_shapes(p, p, 200.0, 40.0)
    return sweeps.error_rates(store.counted(told, *wholes))


@query(f"""WITH {PTS}, m(j, distance) AS (VALUES (0, 50.0::DOUBLE), (1, 200.0::DOUBLE)), g AS (SELECT *, radians((track * 7919 + j * 104729) % 360) AS a FROM p, m)
SELECT -(track * 2 + j) - 1 AS track, seq, round(x + distance * cos(a), 6) AS x, round(y + distance * sin(a), 6) AS y, track AS source, distance FROM g""")
def near_duplicates(spark, d):
    from curvespark.sources import synth

    return synth.near_duplicates(points(spark, d), [50.0, 200.0]).select("track", "seq", r6("x").alias("x"), r6("y").alias("y"), "source", "distance")
