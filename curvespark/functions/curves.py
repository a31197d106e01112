"""Kernels on single curves and pairs of curves; NumPy only. Curves are float arrays (points, dimensions).

The continuous Frechet kernels are in curvespark.functions.frechet.
"""

from __future__ import annotations

import numpy as np

from curvespark.functions import frechet as F


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2))


def _diagonals(p: np.ndarray, q: np.ndarray, step, limit: float = np.inf) -> tuple[float, bool]:
    """Dynamic programme over the gaps of p and q by anti-diagonals, in memory of three of them; step(gap, best predecessor).

    (value, True), or (a lower bound over limit, False): a path meets one of any two neighbouring diagonals.
    """
    n, m = len(p), len(q)
    lines = [np.full(n, np.inf), np.full(n, np.inf)]
    lines[1][0] = float(np.sqrt(((p[0] - q[0]) ** 2).sum()))
    for d in range(1, n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        two, one = lines
        up = np.where(i > 0, one[i - 1], np.inf)
        diagonal = np.where(i > 0, two[i - 1], np.inf)
        now = np.full(n, np.inf)
        now[i] = step(np.sqrt(((p[i] - q[d - i]) ** 2).sum(axis=1)), np.minimum(np.minimum(up, one[i]), diagonal))
        lines = [one, now]
        least = min(one.min(), now.min())
        if least > limit:
            return float(least), False
    return float(lines[1][n - 1]), True


def diagonals_of_pairs(ps: list, qs: list, step, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """_diagonals of each pair, as (values, whether exact), with the same operands in the same order. Pairs of like size go through in lockstep."""
    values, exact = np.zeros(len(ps)), np.ones(len(ps), dtype=bool)
    size = np.array([(len(p) + len(q), len(p)) for p, q in zip(ps, qs)]).reshape(-1, 2)
    order, at = np.lexsort((size[:, 1], size[:, 0])), 0
    while at < len(order):
        # three lines of the longest first curve, for as many pairs as CELLS holds
        take = min(len(order), at + max(1, F.CELLS // (4 * int(size[order[at], 0]))))
        while take > at + 1 and (take - at) * 4 * int(size[order[take - 1], 0]) > F.CELLS:
            take = at + (take - at + 1) // 2
        pick = order[at:take]
        values[pick], exact[pick] = _lockstep([ps[i] for i in pick], [qs[i] for i in pick], step, limit)
        at = take
    return values, exact


def _lockstep(ps: list, qs: list, step, limit: float) -> tuple[np.ndarray, np.ndarray]:
    n, m = (np.array([len(c) for c in some]) for some in (ps, qs))
    # padding is infinitely far from every point and from the other side's padding
    p, q = np.full((ps[0].shape[1], len(ps), n.max()), np.inf), np.full((ps[0].shape[1], len(qs), m.max()), -np.inf)
    for to, some in ((p, ps), (q, qs)):
        for k, c in enumerate(some):
            to[:, k, : len(c)] = c.T
    q = q[:, :, ::-1]
    rows, columns = n.max(), m.max()
    values, exact, last = np.zeros(len(ps)), np.ones(len(ps), dtype=bool), n + m - 2
    open_ = np.arange(len(ps))
    # line[:, i + 1] is the cell (i, d - i); the first column is outside
    two, one = (np.full((len(ps), rows + 1), np.inf) for _ in range(2))
    one[:, 1] = np.sqrt(((p[:, :, 0] - q[:, :, columns - 1]) ** 2).sum(axis=0))
    for d in range(rows + columns - 1):
        if d:
            a, b = max(0, d - columns + 1), min(rows, d + 1)
            cost = np.sqrt(((p[:, :, a:b] - q[:, :, columns - 1 - d + a : columns - 1 - d + b]) ** 2).sum(axis=0))
            now = np.full_like(one, np.inf)
            now[:, a + 1 : b + 1] = step(cost, np.minimum(np.minimum(one[:, a:b], one[:, a + 1 : b + 1]), two[:, a:b]))
            two, one = one, now
        over = np.zeros(len(open_), dtype=bool)
        if d and limit < np.inf:
            least = np.minimum(one.min(axis=1), two.min(axis=1))
            over = (least > limit) & (last[open_] >= 0)
            values[open_[over]], exact[open_[over]] = least[over], False
        done = ~over & (last[open_] == d)
        values[open_[done]] = one[done, n[open_[done]]]
        last[open_[over | done]] = -1
        if (left := last[open_] >= 0).sum() <= len(left) // 2:
            if not left.any():
                break
            p, q, one, two, open_ = p[:, left], q[:, left], one[left], two[left], open_[left]
    return values, exact


def discrete_frechet_many(ps: list, qs: list) -> np.ndarray:
    return diagonals_of_pairs(ps, qs, np.maximum)[0]


def dtw_many(ps: list, qs: list) -> np.ndarray:
    return diagonals_of_pairs(ps, qs, np.add)[0]


def frechet_within_many(ps: list, qs: list, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """frechet_within of each pair."""
    ends = np.array([max(float(np.sqrt(((p[i] - q[i]) ** 2).sum())) for i in (0, -1)) for p, q in zip(ps, qs)])
    values, exact = ends.copy(), np.zeros(len(ends), dtype=bool)
    near = np.flatnonzero(ends <= limit)
    values[near], exact[near] = diagonals_of_pairs([ps[i] for i in near], [qs[i] for i in near], np.maximum, limit)
    return values, exact


def _diagonals_of_many(cost: np.ndarray, step) -> np.ndarray:
    """_diagonals of each matrix of a stack (curves, n, m)."""
    _, n, m = cost.shape
    lines = [np.full(cost.shape[:2], np.inf), np.full(cost.shape[:2], np.inf)]
    lines[1][:, 0] = cost[:, 0, 0]
    for d in range(1, n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        two, one = lines
        best = one[:, i]
        j = i[i > 0]
        best[:, i > 0] = np.minimum(np.minimum(one[:, j - 1], best[:, i > 0]), two[:, j - 1])
        now = np.full(cost.shape[:2], np.inf)
        now[:, i] = step(cost[:, i, d - i], best)
        lines = [one, now]
    return lines[1][:, n - 1]


def of_pairs(ps: np.ndarray, qs: np.ndarray, step) -> np.ndarray:
    """Discrete Frechet (step np.maximum) or DTW (np.add) of each curve of a stack (curves, points, dimensions) to that of another at its place."""
    return _diagonals_of_many(np.sqrt(((ps[:, :, None, :] - qs[:, None]) ** 2).sum(axis=3)), step)


def discrete_frechet(p: np.ndarray, q: np.ndarray) -> float:
    return _diagonals(p, q, np.maximum)[0]


def frechet_within(p: np.ndarray, q: np.ndarray, limit: float) -> tuple[float, bool]:
    """(discrete Frechet distance, True), or (a lower bound over limit, False) where the ends or the programme rule limit out."""
    ends = max(float(np.sqrt(((p[i] - q[i]) ** 2).sum())) for i in (0, -1))
    return (ends, False) if ends > limit else _diagonals(p, q, np.maximum, limit)


def dtw(p: np.ndarray, q: np.ndarray) -> float:
    return _diagonals(p, q, np.add)[0]


decide, frechet_upper = F.decide, F.upper


def frechet(p: np.ndarray, q: np.ndarray, tol: float = 1e-6) -> float:
    """Continuous Frechet distance from above, within tol."""
    return float(F.distance_many([p], [q], tol)[0])


def point_to_line(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to a polyline; a bounded number of points at a time."""
    line = np.repeat(line, 2, axis=0) if len(line) == 1 else line
    a, d = line[:-1], line[1:] - line[:-1]
    n, rows = (d**2).sum(axis=1), max(1, F.CELLS // len(d))
    out = np.empty(len(points))
    for i in range(0, len(points), rows):
        rel = points[i : i + rows, None] - a[None]
        f = np.clip(np.divide((rel * d[None]).sum(axis=2), n[None], out=np.zeros(rel.shape[:2]), where=n[None] > 0), 0, 1)
        out[i : i + rows] = np.sqrt(((rel - f[..., None] * d[None]) ** 2).sum(axis=2)).min(axis=1)
    return out


def hausdorff_bound(p: np.ndarray, q: np.ndarray) -> float:
    return float(max(point_to_line(p, q).max(), point_to_line(q, p).max()))


def hausdorff_many(ps: list, qs: list) -> np.ndarray:
    """hausdorff_bound of each pair, pairs of like size together."""
    size = np.array([(len(p), len(q)) for p, q in zip(ps, qs)]).reshape(-1, 2)
    order, at, out = np.lexsort((size[:, 1], size[:, 0])), 0, np.zeros(len(ps))
    most = 5 * F.CELLS
    while at < len(order):
        take, cells = at, 0
        while take < len(order) and (take == at or (take + 1 - at) * max(cells, int(size[order[take]].prod())) <= most):
            cells, take = max(cells, int(size[order[take]].prod())), take + 1
        pick = order[at:take]
        if cells > most:
            out[pick] = hausdorff_bound(ps[pick[0]], qs[pick[0]])
        else:
            p, q = ([ps[i] for i in pick], [qs[i] for i in pick])
            out[pick] = np.maximum(_farthest(p, q), _farthest(q, p))
        at = take
    return out


def _farthest(ps: list, lines: list) -> np.ndarray:
    """The largest distance of each curve's points to its line."""
    origin = np.zeros((len(ps), ps[0].shape[1]))
    p, line = F._layers(ps, origin), F._layers([np.repeat(c, 2, axis=0) if len(c) == 1 else c for c in lines], origin)
    segments, beyond = F.Segments(line), np.arange(len(line) - 1)[:, None] >= np.maximum(1, [len(c) - 1 for c in lines])
    away, most, padded = np.empty(beyond.shape), np.zeros(len(ps)), beyond.any()
    for x in p:
        segments.of_point(x, away)
        if padded:
            away[beyond] = np.inf
        np.maximum(most, away.min(axis=0), out=most)
    return np.sqrt(most)


def _split(n: int, measure, tol: float) -> np.ndarray:
    """Kept indices: a span splits at its first largest measure while that is over tol."""
    keep, spans = {0, n - 1}, [(0, n - 1)]
    while spans:
        a, b = spans.pop()
        if b - a > 1:
            d = measure(a, b)
            i = int(d.argmax())
            if d[i] > tol:
                keep.add(a + 1 + i)
                spans += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.array(sorted(keep))


def douglas_peucker(xy: np.ndarray, tol: float) -> np.ndarray:
    return _split(len(xy), lambda a, b: point_to_line(xy[a + 1 : b], xy[[a, b]]), tol)


def simplify_sed(t: np.ndarray, xy: np.ndarray, tol: float) -> np.ndarray:
    """Kept indices by time-synchronised distance. Degenerate time raises for more than two points."""
    if len(t) > 2 and (t[-1] <= t[0] or (np.diff(t) < 0).any()):
        raise ValueError("time must advance")

    def measure(a, b):
        f = (t[a + 1 : b] - t[a]) / (t[b] - t[a]) if t[b] > t[a] else np.zeros(b - a - 1)
        return np.sqrt(((xy[a + 1 : b] - xy[a] - f[:, None] * (xy[b] - xy[a])) ** 2).sum(axis=1))

    return _split(len(t), measure, tol)


def certify(xy: np.ndarray, kept: np.ndarray, tol: float = 1e-3) -> float:
    """A proven bound of the Frechet distance between a curve and its simplification: the largest over the pieces."""
    out = 0.0
    for a, b in zip(kept[:-1], kept[1:]):
        out = F.chord_upper(xy[a : b + 1], tol, out)
    return out


def outcomes(qs: list, cs: list, r: float, slack: np.ndarray, bound: np.ndarray) -> list[str]:
    """Range decisions on simplified curves: accept, reject_cheap, reject_interval or refine. What is not refined is proven: yes by
    a decision with margins at r - slack, no by one whose margins favour yes at r + slack."""
    out = np.full(len(qs), "reject_cheap", dtype=object)
    left = np.flatnonzero(bound <= r + slack)
    some = lambda rows, e, margin: F.decide_many([qs[i] for i in rows], [cs[i] for i in rows], e, margin)
    out[left] = "reject_interval"
    left = left[some(left, r + slack[left], -1)]
    out[left] = "refine"
    sure = left[slack[left] <= r]
    out[sure[some(sure, r - slack[sure], 1)]] = "accept"
    return out.tolist()


def hilbert_keys(points: np.ndarray, bits: int) -> list[int]:
    """Keys of integer points (rows) on the Hilbert curve, by Skilling's transform."""
    x = np.array(points, dtype=np.int64).T.copy()
    n = len(x)
    for s in range(bits - 1, 0, -1):
        high, low = 1 << s, (1 << s) - 1
        for i in range(n):
            on = (x[i] & high) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for s in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << s), (1 << s) - 1, 0)
    x ^= t
    keys = np.zeros(x.shape[1], dtype=object)
    for s in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys * 2 + ((x[i] >> s) & 1)
    return [int(k) for k in keys]


def hilbert_points(keys: list[int], bits: int, n: int) -> np.ndarray:
    """The inverse of hilbert_keys."""
    x = np.zeros((n, len(keys)), dtype=np.int64)
    for b in range(bits * n):
        s, i = bits - 1 - b // n, b % n
        x[i] |= np.array([(k >> (bits * n - 1 - b)) & 1 for k in keys], dtype=np.int64) << s
    t = x[n - 1] >> 1
    for i in range(n - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    for s in range(1, bits):
        high, low = 1 << s, (1 << s) - 1
        for i in range(n - 1, -1, -1):
            on = (x[i] & high) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    return x.T


def encode_track(t: np.ndarray, xy: np.ndarray) -> bytes:
    """Points on a 10 ms / 1 cm grid as zlib-packed 64-bit deltas."""
    import zlib

    grid = np.rint(np.nan_to_num(np.column_stack((t, xy))) * 100).astype("<i8")
    return zlib.compress(np.int64(len(t)).tobytes() + np.diff(grid, axis=0, prepend=np.zeros((1, 3), "<i8")).T.tobytes(), 9)


def decode_track(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zlib

    raw = zlib.decompress(blob)
    grid = np.frombuffer(raw[8:], "<i8").reshape(3, -1).cumsum(axis=1) / 100
    return grid[0], grid[1:].T


def basis(knots: np.ndarray, degree: int, u: np.ndarray) -> np.ndarray:
    """B-spline basis functions at u, one column a control point; the last point belongs to the last span."""
    spans = len(knots) - 1
    at = np.clip(np.searchsorted(knots, u, side="right") - 1, degree, spans - degree - 1)
    # of the functions at - d to at, the only ones that are not 0
    near = np.ones((len(u), 1))
    for d in range(1, degree + 1):
        i = at[:, None] + np.arange(-d, 1)
        begin, rise, fall = knots[i], knots[i + d] - knots[i], knots[np.minimum(i + d + 1, spans)] - knots[i + 1]
        a = np.divide(u[:, None] - begin, rise, out=np.zeros(i.shape), where=rise > 0)
        b = np.divide(knots[np.minimum(i + d + 1, spans)] - u[:, None], fall, out=np.zeros(i.shape), where=fall > 0)
        old = np.pad(near, ((0, 0), (1, 1)))
        near = a * old[:, :-1] + b * old[:, 1:]
    out = np.zeros((len(u), spans - degree))
    np.put_along_axis(out, at[:, None] + np.arange(-degree, 1), near, axis=1)
    return out


def spline_knots(u: np.ndarray, inner: int, degree: int = 3) -> np.ndarray:
    """Clamped knots, the inner ones at even ranks of the samples."""
    pick = u[np.linspace(0, len(u) - 1, inner + 2).astype(int)[1:-1]]
    return np.concatenate((np.full(degree + 1, u[0]), np.unique(pick[(pick > u[0]) & (pick < u[-1])]), np.full(degree + 1, u[-1])))


def fit_spline(u: np.ndarray, xy: np.ndarray, tol: float, degree: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(knots, control points, largest error): least squares, knots doubled until tol holds, then as few as hold by bisection."""
    degree = min(degree, len(u) - 1)

    def fitted(inner):
        knots = spline_knots(u, inner, degree)
        b = basis(knots, degree, u)
        c = np.linalg.lstsq(b, xy, rcond=None)[0]
        return knots, c, float(np.sqrt(((b @ c - xy) ** 2).sum(axis=1)).max())

    most = max(0, len(u) - degree - 1)
    lo, inner, got = -1, 0, fitted(0)
    while got[2] > tol and inner < most:
        lo, inner = inner, min(most, max(1, 2 * inner))
        got = fitted(inner)
    while got[2] <= tol and inner - lo > 1:
        mid = (lo + inner) // 2
        new = fitted(mid)
        if new[2] <= tol:
            inner, got = mid, new
        else:
            lo = mid
    return got


def savgol_weights(window: int, order: int, at: int) -> np.ndarray:
    """Weights of a local polynomial's value at position `at` of the window."""
    x = np.arange(window) - at
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def savgol(v: np.ndarray, window: int = 11, order: int = 2) -> np.ndarray:
    """Savitzky-Golay smoothing; the first and last half window use the edge polynomials."""
    window = min(window, len(v) - (len(v) + 1) % 2)
    if window <= order:
        return v.copy()
    half = window // 2
    out = np.convolve(v, savgol_weights(window, order, half)[::-1], mode="same")
    for i in range(half):
        out[i] = savgol_weights(window, order, i) @ v[:window]
        out[-1 - i] = savgol_weights(window, order, window - 1 - i) @ v[-window:]
    return out


def kalman(t: np.ndarray, z: np.ndarray, noise: float, q: float) -> np.ndarray:
    """Constant-acceleration Kalman filter with Rauch-Tung-Striebel smoothing: (position, velocity, acceleration) rows."""
    x, p = np.array([z[0], 0.0, 0.0]), np.diag([noise**2, 1e4, 1e4])
    h = np.array([1.0, 0, 0])
    steps = []
    for i in range(len(t)):
        f, before, pb = np.eye(3), x, p
        if i:
            d = t[i] - t[i - 1]
            f = np.array([[1, d, d * d / 2], [0, 1, d], [0, 0, 1]])
            noise_q = q * np.array([[d**5 / 20, d**4 / 8, d**3 / 6], [d**4 / 8, d**3 / 3, d**2 / 2], [d**3 / 6, d**2 / 2, d]])
            before, pb = f @ x, f @ p @ f.T + noise_q
        gain = pb @ h / (h @ pb @ h + noise**2)
        x, p = before + gain * (z[i] - before[0]), pb - np.outer(gain, h @ pb)
        steps.append((f, before, pb, x, p))
    out = [x]
    for i in range(len(t) - 2, -1, -1):
        f, before, pb = steps[i + 1][:3]
        c = steps[i][4] @ f.T @ np.linalg.pinv(pb)
        x = steps[i][3] + c @ (x - before)
        out.append(x)
    return np.array(out[::-1])


def bootstrap(values: np.ndarray, rounds: int = 2000, seed: int = 0, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high): percentile interval of the resampled mean."""
    rng = np.random.default_rng(seed)
    means = values[rng.integers(0, len(values), (rounds, len(values)))].mean(axis=1)
    lo, hi = np.percentile(means, [50 * (1 - level), 100 - 50 * (1 - level)])
    return float(values.mean()), float(lo), float(hi)
