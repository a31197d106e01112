"""What the training-data operators share: tables, shared folder, Arrow batches and word kernels.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text with A-Z lowered.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch for tables of whole texts; bounds a Python worker's memory. One value for all operators, as it holds for the whole session.
TEXT_BATCH = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is named and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: lineage ends here and lost executors cost nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, parts: int, column: str) -> DataFrame:
    """cut(df) dealt by a column, in such a way that groupings by it need no further shuffle.

    A checkpoint keeps how its rows are dealt only where its plan is not adaptive; with a stated number of partitions there is nothing to adapt.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.repartition(parts, column))
    finally:
        conf.set(name, was)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so as the driver's garbage is collected.

    What the first collection frees on this side is free on Spark's only in the second; deletion runs beside them.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Keys with more rows than this, and than one in HOT_SHARE of all rows, meet them by a broadcast; there are HOT_SHARE of them at most.
HOT_ROWS, HOT_SHARE = 1000, 64_000


def met(rows: DataFrame, keyed: DataFrame, key: str, count: int) -> DataFrame:
    """rows (count of them, at most) joined with keyed, which has one row a key and n, that key's rows; keyed is checkpointed or written.

    No task gets all rows of a hot key.
    """
    most = max(HOT_ROWS, count // HOT_SHARE)
    hot = keyed.where(F.col("n") > most)
    if hot.isEmpty():
        return rows.join(keyed.drop("n"), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col("n") <= most).drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(hot.drop("n")), key))


def crc_mod(column: str, modulus: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


_MASK = np.zeros(256, dtype=bool)
_MASK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    out[1:] = base
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POW: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


def words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, bounds): words of all texts in order; text i has words bounds[i]:bounds[i + 1]."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    ends_at = np.cumsum(size)
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", dtype=np.uint8)]
    gap = _MASK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n = len(data) + 1
    if len(_POW.get("up", ())) < n:
        size_up = max(n, 1 << 20)
        _POW["up"], _POW["down"] = _powers(size_up, _BASE), _powers(size_up, pow(_BASE, -1, 2**64))
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _POW["up"][: n - 1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _POW["down"][starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends_at)))
    return data, starts, ends, hashes, bounds


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first[i] to first[i] + count[i], of all i in turn."""
    stop = np.cumsum(count)
    return np.repeat(first - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)


def slices(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters; a longer text is a range of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= limit:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def gathered(batches, column: str = "text", limit: int = 2_000_000):
    """Arrow batches put together to about limit characters of a column."""
    import pandas as pd

    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += sum(len(t or "") for t in batch[column])
        if total >= limit:
            yield pd.concat(held, ignore_index=True)
            held, total = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
