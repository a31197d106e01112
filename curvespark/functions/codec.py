"""Compact bytes of a track as line and spline segments that share their boundaries.

Fixed values of the format: before zlib (level 9), the number of segments; a segment is its type (0 line, 1 spline), a count
and streams. Counts are little-endian base-128 numbers. A stream is values on a grid of a hundredth, rounded half to
even and held to 2e9, as 32-bit differences. A line has times, x, y of its vertices, but for the
first where an earlier segment has it; a spline (cubic) has its start time (the first segment only), end time, inner
knots and control points, again without a shared first one.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE, BOUND, NEAR = 100.0, 2e9, 1e-6


@dataclass
class Line:
    t: np.ndarray
    xy: np.ndarray


@dataclass
class Spline:
    """Cubic; knots are the inner ones, control has four points more."""

    start: float
    end: float
    knots: np.ndarray
    control: np.ndarray


def number(value: int) -> bytes:
    if value < 0:
        raise ValueError("a count cannot be negative")
    out = []
    while value > 127:
        out.append(value % 128 + 128)
        value //= 128
    return bytes([*out, value])


def stream(values) -> bytes:
    grid = np.clip(np.nan_to_num(np.asarray(values, float) * SCALE, nan=0.0, posinf=BOUND, neginf=-BOUND), -BOUND, BOUND)
    return np.diff(np.rint(grid).astype("<i4"), prepend=np.int32(0)).astype("<i4").tobytes()


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value += byte % 128 << shift
            if byte < 128:
                return value
            shift += 7

    def stream(self, n: int) -> np.ndarray:
        steps = np.frombuffer(self.data, "<i4", n, self.at)
        self.at += 4 * n
        # differences wrap at 32 bits; their running sum, wrapped back, does not
        return steps.astype(np.int64).cumsum().astype(np.int32) / SCALE


def ends(segment: Line | Spline) -> tuple[np.ndarray, np.ndarray]:
    """(time, x, y) of a segment's first and last point."""
    if isinstance(segment, Line):
        return np.r_[segment.t[0], segment.xy[0]], np.r_[segment.t[-1], segment.xy[-1]]
    return np.r_[segment.start, segment.control[0]], np.r_[segment.end, segment.control[-1]]


def encode(segments: list) -> bytes:
    """Raises where there is no segment, a spline has a wrong number of control points, or neighbours do not share their boundary."""
    if not segments:
        raise ValueError("a track needs a segment")
    out, last = [number(len(segments))], None
    for segment in segments:
        if not isinstance(segment, (Line, Spline)):
            raise TypeError(f"not a segment: {type(segment)}")
        if isinstance(segment, Spline) and len(segment.control) != len(segment.knots) + 4:
            raise ValueError("a cubic spline has four control points more than inner knots")
        first, end = ends(segment)
        if last is not None and (abs(first[0] - last[0]) > NEAR or np.hypot(*(first[1:] - last[1:])) > NEAR):
            raise ValueError(f"a segment begins at {first}, the one before ends at {last}")
        skip = int(last is not None)
        if isinstance(segment, Line):
            out += [b"\0", number(len(segment.t) - skip), *map(stream, (segment.t[skip:], segment.xy[skip:, 0], segment.xy[skip:, 1]))]
        else:
            times = [] if skip else [stream([segment.start])]
            out += [b"\1", number(len(segment.knots)), *times, *map(stream, ([segment.end], segment.knots, segment.control[skip:, 0], segment.control[skip:, 1]))]
        last = end
    return zlib.compress(b"".join(out), 9)


def decode(blob: bytes) -> list:
    reader, out, last = Reader(zlib.decompress(blob)), [], None
    for _ in range(reader.number()):
        kind, n = reader.number(), reader.number()
        if kind > 1:
            raise ValueError(f"unknown kind of segment {kind}")
        shared = [] if last is None else [last[1:]]
        if kind == 0:
            t, x, y = (reader.stream(n) for _ in range(3))
            out.append(Line(np.r_[[] if last is None else last[:1], t], np.vstack([*shared, np.column_stack((x, y))])))
        else:
            start = reader.stream(1)[0] if last is None else last[0]
            end, knots = reader.stream(1)[0], reader.stream(n)
            x, y = (reader.stream(n + 4 - len(shared)) for _ in range(2))
            out.append(Spline(float(start), float(end), knots, np.vstack([*shared, np.column_stack((x, y))])))
        last = ends(out[-1])[1]
    return out


def size(t, xy) -> int:
    return len(encode([Line(np.asarray(t, float), np.asarray(xy, float))]))


def grid_size(xy, level: int = 9) -> int:
    """Bytes of the points on the centimetre grid without differences."""
    return len(zlib.compress(np.rint(np.asarray(xy, float) * SCALE).astype("<i4").tobytes(), level))
