"""Continuous Frechet kernels for many pairs of curves in lockstep, in blocks of bounded memory.

Curves are float arrays (points, dimensions); one point is the curve that stays there. Shorter curves of a batch are
padded with their last point, which does not change them. The free-space diagram is swept by anti-diagonals, all
pairs of a batch at once; where a diagram has over CELLS cells it is swept in blocks of rows, so memory
follows the shorter side. Most pairs need no sweep: a programme over the borders' nearest points bounds the distance from below, and
one walk along the cells it leaves, with the sweep's own intervals, proves it from above. With margin 1, every comparison allows for the rounding of its own operands, so a yes is
proven whatever the rounding; with margin -1 a no is. Bounds of distances rest on such decisions alone.
"""

from __future__ import annotations

import numpy as np

#: Cells of the free-space diagrams that are held at once.
CELLS = 200_000
#: Cells of the diagrams that are bounded and walked at once.
BATCH = 1_000_000
_SLACK = 64 * np.finfo(float).eps
_NONE = 2.0


def _span(a, b, c, begin, end) -> tuple[np.ndarray, np.ndarray]:
    """Solutions in [0, 1] of a x^2 + 2 b x + c <= 0; lo > hi where there are none. begin, end: whether 0 and 1 are, as decided for the vertices
    themselves, so that neighbouring cells agree."""
    inverse = np.divide(1.0, a, out=np.zeros_like(a), where=a > 0)
    root = b * b
    root -= a * c
    none = root < 0
    np.sqrt(np.maximum(root, 0, out=root), out=root)
    lo, hi = (-b - root) * inverse, (root - b) * inverse
    if (a == 0).any():  # a segment without length is its point
        flat = np.broadcast_to(a == 0, lo.shape)
        lo, hi, none = np.where(flat, 0.0, lo), np.where(flat, 1.0, hi), np.where(flat, ~begin, none)
    np.maximum(lo, np.nextafter(0, 1), out=lo)
    np.minimum(hi, np.nextafter(1, 0), out=hi)
    none |= lo > hi
    lo[none], hi[none] = _NONE, -1.0
    hi[begin] = np.maximum(hi[begin], 0.0)
    lo[end] = np.minimum(lo[end], 1.0)
    lo[begin], hi[end] = 0.0, 1.0
    return lo, hi


def _free(p, q, eps, margin: int):
    """Free intervals (lo, hi) of the segments of q at the points of p (pairs, points of p, segments of q)."""
    e, dims = eps[:, None, None], range(p.shape[2])
    gap = [q[:, None, :, k] - p[:, :, None, k] for k in dims]
    square = sum(g * g for g in gap)
    room = e * e
    near = square + margin * _SLACK * (np.sqrt(square) + e) ** 2 <= room if margin else square <= room
    step = [np.diff(q, axis=1)[:, None, :, k] for k in dims]
    a, c = sum(d * d for d in step), (square - room)[:, :, :-1]
    if margin:
        c = c + margin * _SLACK * (np.sqrt(square[:, :, :-1]) + np.sqrt(a) + e) ** 2
    return _span(a, sum(g[:, :, :-1] * d for g, d in zip(gap, step)), c, near[:, :, :-1], near[:, :, 1:])


def _along(lo: np.ndarray, hi: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which intervals of a border row are reached from its begin, whether its end is) for pairs whose begin is reached."""
    whole = np.logical_and.accumulate((lo == 0) & (hi == 1), axis=1)
    before = np.concatenate((begun[:, None], begun[:, None] & whole[:, :-1]), axis=1)
    return before & (lo == 0) & (hi >= 0), begun & whole[:, -1]


def _sweep(p, q, eps, margin, enter, side, whole):
    """Rows of the diagram between the points of p. enter: smallest reachable parameters of q's segments at p[0]; side: whether q[0] is reached at p[0].

    Returns the same at p's last point, and whether the far corner is reached there. whole: these are all rows, so a point of q that p never comes near ends a pair too.
    """
    left_lo, left_hi = _free(p, q, eps, margin)
    # a point of p that q never comes near ends a pair
    alive = (left_lo <= left_hi).any(axis=2).all(axis=1)
    out = np.full(enter.shape, _NONE), np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
    if not alive.all():
        p, q, eps, left_lo, left_hi, enter, side = (x[alive] for x in (p, q, eps, left_lo, left_hi, enter, side))
    if len(p):
        low_lo, low_hi = (x.transpose(0, 2, 1) for x in _free(q, p, eps, margin))
        near = (low_lo <= low_hi).any(axis=1).all(axis=1) if whole else np.ones(len(p), dtype=bool)
        alive[alive] = near
        if near.any():
            for to, x in zip(out, _swept(*(x[near] for x in (left_lo, left_hi, low_lo, low_hi, enter, side)))):
                to[alive] = x
    return out


def _swept(left_lo, left_hi, low_lo, low_hi, enter, side):
    pairs, n, m = left_lo.shape[0], left_lo.shape[1], low_lo.shape[2]
    reached, side = _along(low_lo[:, :, 0], low_hi[:, :, 0], side)
    up, across = np.full((pairs, n, m - 1), _NONE), np.full((pairs, n - 1, m), _NONE)
    up[:, 0] = enter
    across[:, :, 0] = np.where(reached, 0.0, _NONE)
    for k in range(n + m - 3):
        i = np.arange(max(0, k - m + 2), min(n - 1, k + 1))
        j = k - i
        below, beside = up[:, i, j], across[:, i, j]
        lo = left_lo[:, i + 1, j]
        new = np.where(beside < _NONE, lo, np.maximum(lo, below))
        up[:, i + 1, j] = np.where(new <= left_hi[:, i + 1, j], new, _NONE)
        lo = low_lo[:, i, j + 1]
        new = np.where(below < _NONE, lo, np.maximum(lo, beside))
        across[:, i, j + 1] = np.where(new <= low_hi[:, i, j + 1], new, _NONE)
    end = ((up[:, -1, -1] <= 1) & (left_hi[:, -1, -1] == 1)) | ((across[:, -1, -1] <= 1) & (low_hi[:, -1, -1] == 1))
    return up[:, -1], side, end


def _close(a: np.ndarray, b: np.ndarray, eps: np.ndarray, margin: int) -> np.ndarray:
    square = ((a - b) ** 2).sum(axis=1)
    if margin:
        square = square + margin * _SLACK * (np.sqrt(square) + eps) ** 2
    return square <= eps * eps


def _decided(p: np.ndarray, q: np.ndarray, eps: np.ndarray, margin: int) -> np.ndarray:
    """Of padded stacks p, q (pairs, points, d), recentred: whether each distance is at most eps."""
    if p.shape[1] < q.shape[1]:
        p, q = q, p
    ok = _close(p[:, 0], q[:, 0], eps, margin) & _close(p[:, -1], q[:, -1], eps, margin)
    if not ok.all():
        if ok.any():
            ok[ok] = _decided(p[ok], q[ok], eps[ok], margin)
        return ok
    lo, hi = _free(p[:, :1], q, eps, margin)
    begun, _ = _along(lo[:, 0], hi[:, 0], ok)
    enter, side, end = np.where(begun, 0.0, _NONE), ok, ok
    rows = max(1, CELLS // (len(p) * q.shape[1]))
    for a in range(0, p.shape[1] - 1, rows):
        enter, side, end = _sweep(p[:, a : a + rows + 1], q, eps, margin, enter, side, rows >= p.shape[1] - 1)
        if not (side.any() or (enter < _NONE).any()):
            return np.zeros(len(p), dtype=bool)
    return ok & end


def _curve(x) -> np.ndarray:
    x = np.asarray(x, float)
    return np.repeat(x, 2, axis=0) if len(x) == 1 else x


def _stack(curves: list[np.ndarray], origins: np.ndarray) -> np.ndarray:
    most = max(map(len, curves))
    return np.stack([np.concatenate((c, np.repeat(c[-1:], most - len(c), axis=0))) for c in curves]) - origins[:, None]


def decide_many(ps: list, qs: list, eps, margin: int = 0) -> np.ndarray:
    """Whether the distance of each pair is at most eps (one for all, or one a pair)."""
    eps = np.broadcast_to(np.asarray(eps, float), (len(ps),))
    if (eps < 0).any():
        raise ValueError("eps must not be negative")
    ps, qs = [_curve(p) for p in ps], [_curve(q) for q in qs]
    near = np.flatnonzero(~surely_over(_ends(ps, qs), ps, qs, eps))
    some = lambda rows: ([ps[i] for i in rows], [qs[i] for i in rows])
    low, yes = _bracket(*some(near), eps[near], margin)
    out = np.zeros(len(ps), dtype=bool)
    out[near[yes]] = True
    low, near = low[~yes], near[~yes]
    near = near[~surely_over(low, *some(near), eps[near])]
    out[near] = _swept_pairs(*some(near), eps[near], margin)
    return out


def _swept_pairs(ps: list, qs: list, eps: np.ndarray, margin: int) -> np.ndarray:
    """decide_many by sweeps of whole diagrams alone."""
    out = np.zeros(len(ps), dtype=bool)
    for pick, p, q in _batches(ps, qs):
        out[pick] = _decided(p, q, eps[pick], margin)
    return out


def _ends(ps: list, qs: list) -> np.ndarray:
    """The larger distance of the first points and of the last ones."""
    ends = [np.sqrt(((np.array([p[i] for p in ps]) - np.array([q[i] for q in qs])) ** 2).sum(axis=1)) for i in (0, -1)] if len(ps) else np.zeros((2, 0))
    return np.maximum(*ends)


def surely_over(low: np.ndarray, ps: list, qs: list, eps) -> np.ndarray:
    """Whether lower bounds are over eps by far more than rounding can make of it."""
    return low > np.asarray(eps) * (1 + 1e-9) + 1e-9 * np.maximum(_sizes(ps), _sizes(qs))


def _sizes(curves: list) -> np.ndarray:
    """The largest coordinate of each curve, without its sign."""
    if not curves:
        return np.zeros(0)
    starts = np.cumsum([0, *map(len, curves[:-1])])
    return np.maximum.reduceat(np.abs(np.concatenate(curves)).max(axis=1), starts)


def _batches(ps: list, qs: list):
    """(numbers, padded stacks) of pairs of like size, recentred, whose diagrams hold CELLS cells together; a larger diagram comes alone."""
    order = sorted(range(len(ps)), key=lambda i: (max(len(ps[i]), len(qs[i])), min(len(ps[i]), len(qs[i]))))
    at = 0
    while at < len(order):
        take, n, m = at, 0, 0
        while take < len(order):
            i = order[take]
            a, b = max(n, len(ps[i])), max(m, len(qs[i]))
            if take > at and (take + 1 - at) * a * b > CELLS:
                break
            n, m, take = a, b, take + 1
        pick = order[at:take]
        origins = np.array([ps[i][0] for i in pick])
        yield pick, _stack([ps[i] for i in pick], origins), _stack([qs[i] for i in pick], origins)
        at = take


def _to_segments(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to each segment (pairs, points, segments)."""
    dims = range(points.shape[2])
    along = [np.diff(line[:, None, :, k], axis=2) for k in dims]
    rel = [points[:, :, None, k] - line[:, None, :-1, k] for k in dims]
    n = sum(a * a for a in along)
    f = np.divide(sum(r * a for r, a in zip(rel, along)), n, out=np.zeros(rel[0].shape), where=n > 0)
    np.clip(f, 0, 1, out=f)
    return np.sqrt(sum((r - f * a) ** 2 for r, a in zip(rel, along)))


def _layers(curves: list, origins: np.ndarray) -> np.ndarray:
    """Curves as (points, dimensions, pairs), padded with their last points."""
    sizes = np.array([len(c) for c in curves])
    at = np.cumsum(sizes) - sizes
    rows = at[:, None] + np.minimum(np.arange(sizes.max()), sizes[:, None] - 1)
    return np.ascontiguousarray((np.concatenate(curves)[rows] - origins[:, None]).transpose(1, 2, 0))


def _squares(rel: list, along: list, n: np.ndarray, out: np.ndarray, f: np.ndarray, t: np.ndarray) -> None:
    """Squared distances to segments, of points relative to the segments' begins (overwritten); f and t are scratch."""
    np.multiply(rel[0], along[0], out=f)
    for r, a in zip(rel[1:], along[1:]):
        f += np.multiply(r, a, out=t)
    f /= n
    np.minimum(np.maximum(f, 0, out=f), 1, out=f)
    for k, (r, a) in enumerate(zip(rel, along)):
        r -= np.multiply(f, a, out=t)
        np.multiply(r, r, out=t if k else out)
        if k:
            out += t


class Segments:
    """Squared distances of points to the segments of a stack of lines (points, dimensions, pairs), a point of each pair or a segment of each at a time, which stays in cache."""

    def __init__(self, line: np.ndarray):
        self.dims, self.line = range(line.shape[1]), [np.ascontiguousarray(line[:, k]) for k in range(line.shape[1])]
        self.along = [np.diff(x, axis=0) for x in self.line]
        self.n = sum(a * a for a in self.along)
        self.n[self.n == 0] = 1
        self.rel, self.f, self.t = [np.empty_like(self.n) for _ in self.dims], np.empty_like(self.n), np.empty_like(self.n)

    def of_point(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Of a point a pair (dimensions, pairs), to every segment."""
        for k in self.dims:
            np.subtract(x[k], self.line[k][:-1], out=self.rel[k])
        _squares(self.rel, self.along, self.n, out, self.f, self.t)
        return out

    def of_segment(self, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Of every point but the first, to a segment a pair."""
        along = list(b - a)
        n = sum(d * d for d in along)
        n[n == 0] = 1
        for k in self.dims:
            np.subtract(self.line[k][1:], a[k], out=self.rel[k])
        _squares(self.rel, along, n, out, self.f, self.t)
        return out


def _borders(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances that cells' exits have at least, (segments of p, segments of q, pairs): of p's next point to q's segment, of q's next point to p's."""
    n, m, pairs = len(p) - 1, len(q) - 1, p.shape[2]
    left, low, lines = np.empty((n, m, pairs)), np.empty((n, m, pairs)), Segments(q)
    for i in range(n):
        lines.of_point(p[i + 1], left[i])
        lines.of_segment(p[i], p[i + 1], low[i])
    return left, low


def _togo(left: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest squared distance, at least, on the way from each cell to the last one, (n + 1, m + 1, pairs) with a rim that is infinite."""
    n, m, pairs = left.shape
    out = np.full(((n + 1) * (m + 1), pairs), np.inf)
    left, low = left.reshape(-1, pairs), low.reshape(-1, pairs)
    out[(n - 1) * (m + 1) + m - 1] = 0
    for k in range(n + m - 3, -1, -1):
        first, count = max(0, k - m + 1), min(n, k + 1) - max(0, k - m + 1)
        line = lambda x, width, more=0: x[(a := first * (width - 1) + k + more) : a + (count - 1) * (width - 1) + 1 : max(1, width - 1)]
        up = np.maximum(line(left, m), line(out, m + 1, m + 1))
        np.minimum(up, np.maximum(line(low, m), line(out, m + 1, 1)), out=line(out, m + 1))
    return out.reshape(n + 1, m + 1, pairs)


def _walked(p, q, left, low, togo, eps, margin: int) -> np.ndarray:
    """Whether one way through the diagram, always by an exit from which the end may be in reach and by the nearer of two such, proves each distance at most eps.

    Intervals are those of the sweep, of the exits on the way alone.
    """
    n, m, pairs = left.shape
    ok = _close(p[0].T, q[0].T, eps, margin) & _close(p[-1].T, q[-1].T, eps, margin)
    left, low, togo = left.reshape(-1), low.reshape(-1), togo.reshape(-1)
    room, at = eps * eps, np.arange(pairs)
    limit = room * (1 + 1e-9)
    i, j = np.zeros(pairs, dtype=int), np.zeros(pairs, dtype=int)
    ups, rows, columns = np.zeros((n + m - 2, pairs), dtype=bool), np.empty((n + m - 2, pairs), dtype=int), np.empty((n + m - 2, pairs), dtype=int)
    for k in range(n + m - 2):
        rows[k], columns[k] = i, j
        here, cell = (i * m + j) * pairs + at, (i * (m + 1) + j) * pairs + at
        a, b = left.take(here), low.take(here)
        may_up, may_side = (np.maximum(x, togo.take(cell + more)) <= limit for x, more in ((a, (m + 1) * pairs), (b, pairs)))
        ok &= may_up | may_side
        if not ok.any():
            return ok
        ups[k] = up = (may_up & (~may_side | (a <= b)) | (j == m - 1)) & (i < n - 1)
        i, j = i + up, j + ~up
    dims, take = range(p.shape[1]), lambda c, at_, k: c[:, k].reshape(-1).take(at_)
    i, j, on_p, on_q = rows, columns, rows * pairs + at, columns * pairs + at
    del rows, columns
    gap, far, step = [], [], []
    for k in dims:
        pa, pb, qa, qb = take(p, on_p, k), take(p, on_p + pairs, k), take(q, on_q, k), take(q, on_q + pairs, k)
        begin, end, x = np.where(ups, qa, pa), np.where(ups, qb, pb), np.where(ups, pb, qb)
        gap.append(begin - x)
        far.append(end - x)
        step.append(end - begin)
    square, over, length = (sum(g * g for g in some) for some in (gap, far, step))
    c = square - room
    if margin:
        near, last = (z + margin * _SLACK * (np.sqrt(z) + eps) ** 2 <= room for z in (square, over))
        c = c + margin * _SLACK * (np.sqrt(square) + np.sqrt(length) + eps) ** 2
    else:
        near, last = square <= room, over <= room
    lo, hi = _span(length, sum(g * d for g, d in zip(gap, step)), c, near, last)
    # within a run of exits of one kind the reached parameters rise
    for k in range(1, n + m - 2):
        np.maximum(lo[k], lo[k - 1], out=lo[k], where=ups[k] == ups[k - 1])
    return ok & (lo <= hi).all(axis=0)


def _bracket(ps: list, qs: list, eps, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower bounds of the distances, whether a walk proves eps, or where it is None, the lower bound but for rounding).

    Any match of the curves crosses the borders of a chain of cells, and is as far as each border's nearest point. Pairs whose
    diagram has over BATCH cells have the bound of their end points, and no walk.
    """
    out, yes = _ends(ps, qs), np.zeros(len(ps), dtype=bool)
    size = np.array([(len(p) - 1, len(q) - 1) for p, q in zip(ps, qs)]).reshape(-1, 2)
    swap = size[:, 0] > size[:, 1]
    size = np.sort(size, axis=1)
    order, at = np.lexsort((size[:, 0], size[:, 1])), 0
    while at < len(order):
        take, n, m = at, 0, 0
        while take < len(order):
            a, b = max(n, int(size[order[take], 0])), max(m, int(size[order[take], 1]))
            if take > at and (take + 1 - at) * a * b > BATCH:
                break
            n, m, take = a, b, take + 1
        pick, at = order[at:take], take
        if n * m > BATCH:
            continue
        origins = np.array([ps[i][0] for i in pick])
        p, q = (_layers([(qs if swap[i] == here else ps)[i] for i in pick], origins) for here in (True, False))
        left, low = _borders(p, q)
        togo = _togo(left, low)
        out[pick] = np.maximum(out[pick], np.sqrt(togo[0, 0]))
        if eps is None or (out[pick] <= eps[pick] * (1 + 1e-9)).any():
            yes[pick] = _walked(p, q, left, low, togo, _just_over(out[pick]) if eps is None else eps[pick], margin)
    return out, yes


def _just_over(low: np.ndarray) -> np.ndarray:
    return low * (1 - 1e-12) * (1 + 3e-12)


def lower_many(ps: list, qs: list) -> np.ndarray:
    """At most each pair's distance, and often the distance itself, but for rounding."""
    return _bracket([_curve(p) for p in ps], [_curve(q) for q in qs], np.full(len(ps), -1.0), 0)[0]


def distance_many(ps: list, qs: list, tol: float = 1e-6, margin: int = 0) -> np.ndarray:
    """Distances from above, within tol, all pairs bisected in lockstep from the lower bound on; with margin, proven upper bounds."""
    ps, qs = [_curve(p) for p in ps], [_curve(q) for q in qs]
    low, yes = _bracket(ps, qs, None, int(margin))
    lo, hi = low * (1 - 1e-12), _just_over(low)
    pick = lambda rows, e: decide_many([ps[i] for i in rows], [qs[i] for i in rows], e, int(margin))
    open_ = np.arange(len(ps))
    if not margin and len(ps):
        maybe = np.flatnonzero(lo <= 1e-9 * np.maximum(_sizes(ps), _sizes(qs)))
        zero = np.zeros(len(ps), dtype=bool)
        zero[maybe] = pick(maybe, 0.0)
        hi[zero], lo[zero] = 0.0, 0.0
        open_ = open_[~zero]
    rising, step = open_[~yes[open_]], tol / 16
    while len(rising):
        rising = rising[~pick(rising, hi[rising])]
        step *= 8
        lo[rising], hi[rising] = hi[rising], hi[rising] + step
    while len(open_ := open_[hi[open_] - lo[open_] > tol]):
        mid = (lo[open_] + hi[open_]) / 2
        open_ = open_[(mid > lo[open_]) & (mid < hi[open_])]
        mid = (lo[open_] + hi[open_]) / 2
        yes = pick(open_, mid)
        hi[open_[yes]], lo[open_[~yes]] = mid[yes], mid[~yes]
    return hi


def decide(p, q, eps: float, margin: int = 0) -> bool:
    return bool(decide_many([p], [q], eps, margin)[0])


def upper(p, q, tol: float = 1e-6) -> float:
    """A proven upper bound of the distance: it is decided with margins for rounding."""
    return float(distance_many([p], [q], tol, 1)[0])


def within_chord(piece: np.ndarray, eps: float) -> bool:
    """Whether a piece is proven within eps of the segment of its first and last point, by one pass: a segment's free intervals only have to keep order."""
    piece = piece - piece[0]
    lo, hi = _free(piece[None], piece[None, [0, -1]], np.array([eps]), 1)
    lo, hi = lo[0, :, 0], hi[0, :, 0]
    return bool((lo <= hi).all() and lo[0] == 0 and hi[-1] == 1 and (np.maximum.accumulate(lo) <= hi).all())


def chord_upper(piece: np.ndarray, tol: float = 1e-6, least: float = 0.0) -> float:
    """A proven upper bound of the distance of a piece to the segment of its ends, within tol of it, or least where that holds already."""
    if len(piece) < 3 or within_chord(piece, least):
        return least
    lo, hi = least, max(2 * least, tol)
    while not within_chord(piece, hi):
        lo, hi = hi, 2 * hi
    while hi - lo > tol and lo < (mid := (lo + hi) / 2) < hi:
        lo, hi = (lo, mid) if within_chord(piece, mid) else (mid, hi)
    return hi
