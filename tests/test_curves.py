import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curvespark.functions import curves as c

coordinate = st.floats(-50, 50, allow_nan=False).map(lambda v: round(v, 3))
line = st.lists(st.tuples(coordinate, coordinate), min_size=2, max_size=8).map(lambda x: np.array(x, float))


def dense(p, k=60):
    u = np.linspace(0, len(p) - 1, k * (len(p) - 1) + 1)
    return np.column_stack([np.interp(u, np.arange(len(p)), p[:, i]) for i in range(2)])


@settings(max_examples=60, deadline=None)
@given(line, line)
def test_distance_laws(p, q):
    d = c.frechet(p, q, 1e-6)
    assert abs(d - c.frechet(q, p, 1e-6)) < 1e-4
    assert d <= c.discrete_frechet(p, q) + 1e-6
    assert d <= c.discrete_frechet(dense(p), dense(q)) + 1e-6
    assert d >= c.hausdorff_bound(p, q) - 1e-5
    assert c.frechet_upper(p, q) >= d


@pytest.mark.parametrize("offset", [0, 1e5])
def test_translation(offset):
    p = np.random.default_rng(3).normal(size=(30, 2)).cumsum(axis=0) + offset
    assert abs(c.frechet(p, p + [3, 4]) - 5) < 1e-4
    assert c.decide(p, p, 0)
    with pytest.raises(ValueError):
        c.decide(p, p, -1)


def test_certificates_and_simplification():
    rng = np.random.default_rng(5)
    for n in (2, 3, 40):
        p, t = rng.normal(size=(n, 2)).cumsum(axis=0), np.arange(float(n))
        for kept in (c.simplify_sed(t, p, 1.0), c.douglas_peucker(p, 1.0)):
            assert kept[0] == 0 and kept[-1] == n - 1
            assert c.certify(p, kept) >= c.frechet(p, p[kept]) - 1e-3
    with pytest.raises(ValueError):
        c.simplify_sed(np.zeros(3), p[:3], 1.0)


@pytest.mark.parametrize("bits,n", [(3, 3), (4, 2), (2, 4)])
def test_hilbert(bits, n):
    points = c.hilbert_points(list(range(2 ** (bits * n))), bits, n)
    assert (np.abs(np.diff(points, axis=0)).sum(axis=1) == 1).all()
    assert c.hilbert_keys(points, bits) == list(range(2 ** (bits * n)))


def test_codec_spline_and_smoothers():
    rng = np.random.default_rng(7)
    t, p = np.arange(50.0), rng.normal(size=(50, 2)).cumsum(axis=0)
    back_t, back = c.decode_track(c.encode_track(t, p))
    assert np.abs(back - p).max() <= 0.0051 and (back_t == t).all()
    line = np.column_stack((2 * t, 5 * t))
    knots, _, worst = c.fit_spline(t / 49, line, 1e-6)
    assert len(knots) == 8 and worst < 1e-6
    assert c.fit_spline(t / 49, p, 0.5)[2] <= 0.5
    assert np.allclose(c.savgol(t**2), t**2)
    assert abs(c.kalman(t, 3 * t, 0.1, 1.0)[25, 1] - 3) < 1e-3
    mean, lo, hi = c.bootstrap(t)
    assert lo < mean < hi


def test_discrete_against_scalar():
    rng = np.random.default_rng(11)
    for _ in range(10):
        p, q = rng.normal(size=(7, 2)), rng.normal(size=(5, 2))
        d = c.gaps(p, q)
        f, w = np.full((8, 6), np.inf), np.full((8, 6), np.inf)
        f[0, 0], w[0, 0] = -np.inf, 0
        for i in range(7):
            for j in range(5):
                f[i + 1, j + 1] = max(d[i, j], min(f[i, j], f[i, j + 1], f[i + 1, j]))
                w[i + 1, j + 1] = d[i, j] + min(w[i, j], w[i, j + 1], w[i + 1, j])
        assert np.isclose(c.discrete_frechet(p, q), f[7, 5]) and np.isclose(c.dtw(p, q), w[7, 5])
