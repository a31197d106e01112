"""Tracks of equal points are measured once and stand for all their copies; bounds and walks leave few pairs to sweeps."""

import numpy as np
import pytest

from curvespark.functions import curves, frechet
from curvespark.operators import experiments, store, sweeps


def walks(seed, count, most=40):
    rng = np.random.default_rng(seed)
    return [np.cumsum(rng.normal(0, 10, (rng.integers(1, most), 2)), axis=0) for _ in range(count)]


def frame(spark, tracks):
    return spark.createDataFrame([(t, i, float(i), float(x), float(y)) for t, c in tracks.items() for i, (x, y) in enumerate(c)], "track long, seq long, t double, x double, y double")


@pytest.fixture(scope="module")
def copied(spark):
    """12 shapes: the first three thrice, the next four twice."""
    shapes = walks(8, 12, 20)
    tracks = {t: c for t, c in enumerate(shapes)} | {100 + t: shapes[t] for t in range(7)} | {200 + t: shapes[t] for t in range(3)}
    return tracks, frame(spark, tracks)


def test_few_pairs_are_swept(monkeypatch):
    ps, qs = walks(1, 80), walks(2, 80)
    swept, sweep = [], frechet._swept_pairs
    monkeypatch.setattr(frechet, "_swept_pairs", lambda p, *rest: (swept.append(len(p)), sweep(p, *rest))[1])
    low = frechet.lower_many(ps, qs)
    for margin in (-1, 0, 1):
        for eps in (20.0, 60.0, low * (1 + 1e-9), low * 0.9, low * 1.2):
            swept.clear()
            got = frechet.decide_many(ps, qs, eps, margin)
            assert sum(swept) <= 12
            assert got.tolist() == sweep([np.repeat(p, 2, axis=0) if len(p) == 1 else p for p in ps], [np.repeat(q, 2, axis=0) if len(q) == 1 else q for q in qs], np.broadcast_to(eps, (80,)), margin).tolist()


def test_walks_of_padded_and_folded_curves():
    """Repeated points, curves that turn back, and sides of unlike length give what sweeps give."""
    rng = np.random.default_rng(3)
    fold = lambda n: np.repeat(np.cumsum(rng.choice([-5.0, 0.0, 5.0], (n, 2)), axis=0), rng.integers(1, 3, n), axis=0)
    ps, qs = [fold(n) for n in rng.integers(2, 30, 60)], [fold(n) for n in rng.integers(2, 30, 60)]
    for margin in (-1, 0, 1):
        for eps in (0.0, 5.0, 10.0, 20.0, 40.0):
            assert frechet.decide_many(ps, qs, eps, margin).tolist() == frechet._swept_pairs(ps, qs, np.full(60, eps), margin).tolist()
    assert frechet.distance_many(ps, ps, 1e-3).tolist() == [0.0] * 60


def test_copies_are_measured_once(spark, copied):
    tracks, points = copied

    def tell(b, ps, qs):
        assert (b["c"] < 100).all() and (b["q"] <= b["c"]).all()
        return b[["q", "c"]].assign(cost=curves.dtw_many(ps, qs))

    rows = store.measured_pairs(points, 60.0, tell, "q long, c long, cost double").collect()
    got = {(r.q, r.c): r.cost for r in rows}
    near = lambda p, q: max(*(np.sqrt(((p[i] - q[i]) ** 2).sum()) for i in (0, -1)), np.sqrt((np.maximum(np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)), 0) ** 2).sum())) <= 60
    assert len(rows) == len(got) and got == {(a, b): curves.dtw(tracks[a], tracks[b]) for a in tracks for b in tracks if a < b and near(tracks[a], tracks[b])}


def test_counts_of_shapes_are_counts_of_tracks(spark, copied):
    tracks, points = copied
    for other in (points, points.where("track <> 104")):
        told, wholes, _ = store.certified_pairs(points, other, 40.0, 5.0)
        rows = store.certified_range(points, other, 40.0, 5.0).collect()
        assert len(rows) == len({(r.q, r.c) for r in rows}) and not any(r.q == r.c for r in rows)
        assert {(r.q, r.c) for r in rows if r.hit} == {(a, b) for a in tracks for b in tracks if a != b and (other is points or b != 104) and frechet.decide(tracks[a], tracks[b], 40.0)}
        want = {o: (sum(r.outcome == o for r in rows), sum(r.outcome == o and r.hit for r in rows)) for o in {r.outcome for r in rows}}
        assert {r.outcome: (r.n, r.hits) for r in store.outcome_counts(store.counted(told, *wholes)).collect()} == want


def test_error_rates_of_shapes_are_those_of_tracks(spark, copied):
    tracks, points = copied
    told, wholes = sweeps.approximate_shapes(points, points, 40.0, 15.0)
    hits = sum(frechet.decide(tracks[a], tracks[b], 40.0) for a in tracks for b in tracks if a != b)
    assert sweeps.error_rates(store.counted(told, *wholes)).first()["hits"] == hits


def test_range_report_counts_copies(spark, copied):
    """Shapes that stand for their copies give the report of all tracks."""
    tracks, points = copied
    few = points.where("track IN (0, 3, 100, 207, 8)")
    got = experiments.range_shapes(few, points, 5.0, 5.0, [30.0, 60.0])
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(experiments.outcome_report(got)) == key(experiments.outcome_report(experiments.range_outcomes(few, points, experiments.representations(points, 5.0, 5.0), [30.0, 60.0])))
    assert got.where("q > 11 OR c > 11").count() == 0
