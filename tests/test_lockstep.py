"""Kernels of many pairs in lockstep against those of one pair; pairs that meet in tiles."""

import numpy as np

from curvespark.functions import curves, frechet
from curvespark.operators import store


def walks(seed, count, most=40):
    rng = np.random.default_rng(seed)
    return [np.cumsum(rng.normal(0, 10, (rng.integers(1, most), 2)), axis=0) for _ in range(count)]


def test_lower_bound_is_often_the_distance():
    """Bisection starts from a bound that is the distance of most pairs, and few decisions follow."""
    ps, qs = walks(1, 60), walks(2, 60)
    exact = np.array([frechet.distance_many([p], [q], 1e-7)[0] for p, q in zip(ps, qs)])
    low = frechet.lower_many(ps, qs)
    assert (low <= exact + 1e-9).all() and (exact - low < 1e-6).mean() > 0.9
    for margin in (0, 1):
        got = frechet.distance_many(ps, qs, 1e-3, margin)
        assert (got >= exact - 2e-7).all() and (got <= exact + 1e-3).all()
        assert frechet.decide_many(ps, qs, got, margin).all()


def test_lower_bound_of_large_diagrams_and_points(monkeypatch):
    monkeypatch.setattr(frechet, "CELLS", 10)
    ps, qs = walks(3, 10), walks(4, 10)
    assert (frechet.lower_many(ps, qs) <= frechet.distance_many(ps, qs, 1e-6) + 1e-9).all()
    assert np.isclose(frechet.distance_many([np.zeros((1, 2))], [np.array([[3.0, 4.0]])])[0], 5, rtol=1e-11)


def test_programmes_of_pairs(monkeypatch):
    """Bit by bit what one pair gives, whatever pairs share a stack."""
    ps, qs = walks(5, 80), walks(6, 80)
    for cells in (200_000, 500):
        monkeypatch.setattr(frechet, "CELLS", cells)
        assert curves.discrete_frechet_many(ps, qs).tolist() == [curves.discrete_frechet(p, q) for p, q in zip(ps, qs)]
        assert curves.dtw_many(ps, qs).tolist() == [curves.dtw(p, q) for p, q in zip(ps, qs)]
        assert curves.hausdorff_many(ps, qs).tolist() == [curves.hausdorff_bound(p, q) for p, q in zip(ps, qs)]
        for limit in (0.0, 30.0, 80.0):
            got = list(zip(*(x.tolist() for x in curves.frechet_within_many(ps, qs, limit))))
            assert got == [curves.frechet_within(p, q, limit) for p, q in zip(ps, qs)]
    assert len(curves.dtw_many([], [])) == len(curves.hausdorff_many([], [])) == 0


def test_tiles_hold_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(store, "TILES", 3)
    monkeypatch.setattr(store, "PAIRS", 7)
    shapes = walks(7, 30)
    schema = "track long, x array<double>, y array<double>, eps double"
    left, right = (spark.createDataFrame([(i * sign, p[:, 0].tolist(), p[:, 1].tolist(), float(i)) for i, p in enumerate(shapes) if i], schema) for sign in (1, -1))
    pairs = spark.createDataFrame([(a, -b, a + b / 100) for a in range(1, 30) for b in range(1, 30) if (a + b) % 3] + [(1, -99, 0.0)], "q long, c long, lb double")

    def tell(b, ps, qs):
        return b[["q", "c"]].assign(ends=[float(p[-1, 0] - q[-1, 0]) for p, q in zip(ps, qs)], more=b["lb"], slack=b["qe"] + b["ce"])

    got = {(r.q, r.c): (r.ends, r.more, r.slack) for r in store.tiled(pairs, left, right, tell, "q long, c long, ends double, more double, slack double").collect()}
    want = {(a, -b): (float(shapes[a][-1, 0] - shapes[b][-1, 0]), a + b / 100, float(a + b)) for a in range(1, 30) for b in range(1, 30) if (a + b) % 3}
    assert got == want


def test_mirrored_pairs_are_decided_once(spark):
    """Of one table against itself each pair meets its kernel once, and its mirror image has the same answer."""
    rows = [(t, i, float(i), float(x), float(y)) for t, c in enumerate(walks(8, 12, 20)) for i, (x, y) in enumerate(c)]
    points = spark.createDataFrame(rows, "track long, seq long, t double, x double, y double")
    one = {tuple(r) for r in store.certified_range(points, points, 40.0, 5.0).select("q", "c", "hit").collect()}
    two = {tuple(r) for r in store.certified_range(points, points.select("*"), 40.0, 5.0).select("q", "c", "hit").collect()}
    assert one == two and any(h for _, _, h in one) and len(one) == len({r[:2] for r in one})
