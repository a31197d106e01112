"""Continuous Frechet kernels: lockstep against a 60-digit oracle, margins, blocks of rows, chords, one-point curves."""

from decimal import Decimal, localcontext

import numpy as np
import pytest

from curvespark.functions import curves
from curvespark.functions import frechet as F


def exact_decide(p, q, eps):
    """The free-space sweep in 60 digits on the floats as they are, cell by cell."""
    with localcontext() as c:
        c.prec = 60
        p, q, e2 = [[Decimal(float(v)) for v in r] for r in p], [[Decimal(float(v)) for v in r] for r in q], Decimal(float(eps)) ** 2
        square = lambda u, v: sum((a - b) ** 2 for a, b in zip(u, v))

        def free(point, a, b):
            d, rel = [y - x for x, y in zip(a, b)], [x - y for x, y in zip(a, point)]
            qa, qb, qc = sum(x * x for x in d), sum(x * y for x, y in zip(d, rel)), sum(x * x for x in rel) - e2
            if qa == 0:
                return (Decimal(0), Decimal(1)) if qc <= 0 else None
            disc = qb * qb - qa * qc
            if disc < 0:
                return None
            lo, hi = max((-qb - disc.sqrt()) / qa, Decimal(0)), min((-qb + disc.sqrt()) / qa, Decimal(1))
            return (lo, hi) if lo <= hi else None

        if square(p[0], q[0]) > e2 or square(p[-1], q[-1]) > e2:
            return False
        n, m = len(p) - 1, len(q) - 1
        up, right = {}, {}  # smallest reachable parameter at the bottom of cell i, j and at its left
        ok = True
        for j in range(m):
            f = free(p[0], q[j], q[j + 1])
            ok = ok and f is not None and f[0] == 0
            if ok:
                up[0, j] = Decimal(0)
            ok = ok and f[1] == 1
        ok = True
        for i in range(n):
            f = free(q[0], p[i], p[i + 1])
            ok = ok and f is not None and f[0] == 0
            if ok:
                right[i, 0] = Decimal(0)
            ok = ok and f[1] == 1
        for i in range(n):
            for j in range(m):
                for f, own, other, out, at in ((free(p[i + 1], q[j], q[j + 1]), up.get((i, j)), right.get((i, j)), up, (i + 1, j)), (free(q[j + 1], p[i], p[i + 1]), right.get((i, j)), up.get((i, j)), right, (i, j + 1))):
                    if f and (other is not None or own is not None):
                        new = f[0] if other is not None else max(f[0], own)
                        if new <= f[1]:
                            out[at] = new
        return (n, m - 1) in up or (n - 1, m) in right


def walks(rng, n, offset=0.0):
    for _ in range(n):
        p = rng.normal(0, 10, (rng.integers(1, 9), 2)).cumsum(axis=0) + offset
        yield p, p[np.sort(rng.choice(len(p), max(1, len(p) - 2), replace=False))] + rng.normal(0, 4, 2)


@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_decisions_bracket_the_exact_one(offset):
    rng = np.random.default_rng(1)
    ps, qs = zip(*walks(rng, 60, offset))
    d = F.distance_many(ps, qs, 1e-7)
    upper = F.distance_many(ps, qs, 1e-7, 1)
    twice = lambda x: np.repeat(x, 2, axis=0) if len(x) == 1 else x
    for p, q, mid, most in zip(ps, qs, d, upper):
        assert exact_decide(twice(p), twice(q), most), "an upper bound is proven"
        assert not exact_decide(twice(p), twice(q), mid - 1e-5) if mid > 1e-5 else True
        assert abs(most - mid) < 1e-4
        for e in (mid * 0.999999999, mid, mid * 1.000000001):
            told = exact_decide(twice(p), twice(q), e)
            assert told or not F.decide(p, q, e, 1), "a yes with margin is proven"
            assert not told or F.decide(p, q, e, -1), "so is a no with the margin turned"


def test_blocks_batches_and_pads_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    ps, qs = zip(*[(p, rng.permutation(p)) if i % 3 else (p, p + 1) for i, (p, _) in enumerate(walks(rng, 80))])
    one = np.array([F.decide(p, q, 12.0) for p, q in zip(ps, qs)])
    assert 0 < one.sum() < len(one) and (F.decide_many(ps, qs, 12.0) == one).all()
    monkeypatch.setattr(F, "CELLS", 6)
    assert (F.decide_many(ps, qs, 12.0) == one).all()
    with pytest.raises(ValueError):
        F.decide(ps[0], qs[0], -1.0)


def test_memory_follows_the_shorter_side():
    import tracemalloc

    rng = np.random.default_rng(3)
    p = rng.normal(0, 1, (1500, 2)).cumsum(axis=0)
    tracemalloc.start()
    assert F.decide(p, p + 0.5, 0.8) and not F.decide(p, p + 0.5, 0.6)
    assert tracemalloc.get_traced_memory()[1] < 80e6
    tracemalloc.stop()


def test_one_point_is_a_curve():
    p = np.array([[0.0, 0.0]])
    q = np.array([[3.0, 4.0], [0.0, 5.0], [3.0, -4.0]])
    assert F.decide(p, q, 5.0, -1) and not F.decide(p, q, 4.99) and abs(curves.frechet(p, q) - 5) < 1e-5 and F.decide(p, p, 0.0)


def test_chord_is_the_general_distance():
    rng = np.random.default_rng(4)
    for n in (2, 3, 8, 40):
        for _ in range(10):
            p = rng.normal(0, 10, (n, 2)).cumsum(axis=0)
            got, want = F.chord_upper(p, 1e-6), F.upper(p, p[[0, -1]], 1e-6)
            assert (n == 2 and got == 0) or abs(got - want) < 4e-6 and exact_decide(p, p[[0, -1]], got)
    assert F.chord_upper(p, 1e-6, 1e6) == 1e6


def test_threshold_distance():
    rng = np.random.default_rng(5)
    for p, q in walks(rng, 60):
        d = curves.discrete_frechet(p, q)
        for limit in (d * 0.5, d, d * 2):
            value, whole = curves.frechet_within(p, q, limit)
            assert (value == d) if whole else (limit < value <= d)


def test_outcomes_agree_with_the_originals():
    rng = np.random.default_rng(6)
    rows = []
    for p, _ in walks(rng, 40):
        q = p + rng.normal(0, 1, p.shape)
        kept = [curves.douglas_peucker(x, 2.0) if len(x) > 1 else np.arange(1) for x in (p, q)]
        eps = sum(curves.certify(x, k) for x, k in zip((p, q), kept))
        rows.append((p, q, p[kept[0]], q[kept[1]], eps))
    r = 3.0
    told = curves.outcomes([x[2] for x in rows], [x[3] for x in rows], r, np.array([x[4] for x in rows]), np.zeros(len(rows)))
    for (p, q, *_), what in zip(rows, told):
        if what != "refine":
            assert F.decide(p, q, r) == (what == "accept")
    assert {"refine", "accept"} <= set(told) or {"refine", "reject_interval"} <= set(told)
