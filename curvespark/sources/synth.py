"""Seeded synthetic tracks, made on the executors: motion blocks with known velocity, and roads of lines, arcs and clothoids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "track long, seq long, t double, x double, y double, vx double, vy double"


def kinematic(seed: int, noise: float = 5.0) -> pd.DataFrame:
    """Four to six blocks of acceleration, turn, cruise or stop; times one to five seconds apart."""
    rng = np.random.default_rng(seed)
    t, state, rows = 0.0, np.array([0.0, 0.0, rng.uniform(5, 15), rng.uniform(0, 2 * np.pi)]), []
    for _ in range(rng.integers(4, 7)):
        kind, left = rng.choice(["accelerate", "turn", "cruise", "stop"]), rng.uniform(20, 60)
        a = {"accelerate": rng.uniform(-0.3, 1.0), "stop": -state[2] / left}.get(kind, 0.0)
        turn = rng.uniform(-0.05, 0.05) if kind == "turn" else 0.0
        while left > 0:
            dt = min(rng.uniform(1, 5), left)
            x, y, v, h = state
            rows.append((t, x + rng.normal(0, noise), y + rng.normal(0, noise), v * np.cos(h), v * np.sin(h)))
            mid = h + turn * dt / 2
            chord = (v + a * dt / 2) * dt * np.sinc(turn * dt / 2 / np.pi)
            state = np.array([x + chord * np.cos(mid), y + chord * np.sin(mid), max(0.0, v + a * dt), h + turn * dt])
            t, left = t + dt, left - dt
    return pd.DataFrame(rows, columns=["t", "x", "y", "vx", "vy"])


def road(seed: int, dt: float = 1.0, noise: float = 0.0) -> pd.DataFrame:
    """Lines, arcs and clothoids driven at a speed that varies with the bend; curvature is integrated along the way."""
    rng = np.random.default_rng(seed)
    bend = []
    while sum(map(len, bend)) < rng.uniform(1000, 3000):
        if rng.random() < 0.5:
            bend.append(np.zeros(int(rng.uniform(50, 400))))
        else:
            k, n, ramp = rng.choice([-1, 1]) / rng.uniform(30, 150), int(rng.uniform(30, 150)), int(rng.uniform(10, 40))
            bend.append(np.concatenate((np.linspace(0, k, ramp), np.full(n, k), np.linspace(k, 0, ramp))))
    k = np.concatenate(bend)
    h = np.concatenate(([0], np.cumsum((k[:-1] + k[1:]) / 2)))
    x, y = (np.concatenate(([0], np.cumsum((f(h)[:-1] + f(h)[1:]) / 2))) for f in (np.cos, np.sin))
    speed = np.minimum(20, np.sqrt(3 / np.maximum(np.abs(k), 1e-6)))
    at = np.concatenate(([0], np.cumsum(2 / (speed[:-1] + speed[1:]))))
    t = np.arange(0, at[-1], dt)
    s = np.interp(t, at, np.arange(len(k)))
    pick = lambda v: np.interp(s, np.arange(len(k)), v)
    return pd.DataFrame({"t": t, "x": pick(x) + rng.normal(0, noise, len(t)) * (noise > 0), "y": pick(y) + rng.normal(0, noise, len(t)) * (noise > 0), "vx": pick(speed * np.cos(h)), "vy": pick(speed * np.sin(h))})


def tracks(spark: SparkSession, n: int, maker=kinematic, seed: int = 0, **options) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in batch["id"]:
                d = maker(seed + int(i), **options)
                yield d.assign(track=i, seq=range(len(d)))[["track", "seq", "t", "x", "y", "vx", "vy"]]

    return spark.range(n).mapInPandas(run, SCHEMA)


def near_duplicates(points: DataFrame, distances: list[float], seed: int = 0) -> DataFrame:
    """Copies of every track moved by each distance in a direction that follows from its number: (track, seq, t, x, y, source, distance).

    A moved copy's Frechet distance to its source is the distance itself. Copy j of track i has the number -(i * copies + j) - 1.
    """
    moves = F.posexplode(F.array(*[F.lit(float(d)) for d in distances])).alias("_j", "distance")
    p = points.select("track", "seq", "t", "x", "y", moves)
    turn = F.radians(F.pmod(F.col("track") * 7919 + F.col("_j") * 104729 + seed, F.lit(360)).cast("double"))
    number = (-(F.col("track") * len(distances) + F.col("_j")) - 1).alias("track")
    return p.select(number, "seq", "t", (F.col("x") + F.col("distance") * F.cos(turn)).alias("x"), (F.col("y") + F.col("distance") * F.sin(turn)).alias("y"), F.col("track").alias("source"), "distance")


def covering_duplicates(points: DataFrame, slack: DataFrame, radii: list[float], share: float = 0.1, rounds: int = 4) -> tuple[DataFrame, dict[float, float]]:
    """Near-duplicates of which at least `share` lie in the hard band r +- 2 * eps of each radius, and the shares reached.

    slack has (track, eps). Every round adds distances closer to the radii that lack; the driver sees one number a radius.
    """
    spread, made = [0.7, 1.0, 1.3], [r * f for r in radii for f in (0.7, 1.0, 1.3)]
    for k in range(rounds + 1):
        out = near_duplicates(points, made)
        pairs = out.select("track", "source", "distance").distinct().join(slack.select(F.col("track").alias("source"), "eps"), "source")
        got = pairs.agg(*[F.avg((F.abs(F.col("distance") - r) <= 2 * F.col("eps")).cast("double")).alias(str(i)) for i, r in enumerate(radii)]).first()
        reached = {r: float(got[i] or 0.0) for i, r in enumerate(radii)}
        lacking = [r for r in radii if reached[r] < share]
        if not lacking or k == rounds:
            return out, reached
        made += [r * (1 + (f - 1) / 10 ** (k + 1)) for r in lacking for f in spread]
