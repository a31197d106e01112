"""Exact top-k search: tiled products of query blocks and shards, partial selection per tile, tree merge.

Rows get a number of their own and are gathered into shards once, as a written table. A grid of cells and query
groups deals the work: each shard goes to every group (their number follows the queries' size only), the queries of a
group to every cell. A task holds one group's queries, QUERY_BYTES at most, and streams its cell's shards past them; a tile
is one shard against them. Of each tile only rows that reach a query's running top list are selected, so a cell
gives one list a query, and lists meet in a tree of FAN ways.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without an id; vectors of different
lengths are never compared. Ties go to the smaller id. Rows of one id are rows of their own: each is a
candidate, each asks if the id does, and none is its own candidate. Products are exact: float64 while the sums stay
under 2**53, Python integers beyond; a score past 64 bits counts as the nearest 64-bit integer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARD_BYTES, QUERY_BYTES, FAN = 1 << 18, 64 << 20, 16


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int, asks: F.Column) -> DataFrame:
    d = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(d) > 0) & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"),
                                                           F.transform(d, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def _gathered(batches):
    """Shards: rows of one length with their numbers, ids, whether they ask, and vectors."""
    from pyspark import TaskContext

    base, count, held = TaskContext.get().partitionId() << 33, 0, {}

    def out(dim, rows):
        ids, asks, own, vs = (np.array(x) for x in zip(*rows))
        return pd.DataFrame({"dim": [dim], "shard": [int(own[0])], "own": [own.astype("<i8").tobytes()], "ids": [ids.astype("<i8").tobytes()], "asks": [asks.astype("u1").tobytes()], "n_asks": [int(asks.sum())], "data": [vs.astype("<f8").tobytes()]})

    for batch in batches:
        for i, a, v in zip(batch["id"], batch["asks"], batch["v"]):
            rows = held.setdefault(len(v), [])
            rows.append((i, a, base + count, v))
            count += 1
            if len(rows) * len(v) * 8 >= SHARD_BYTES:
                yield out(len(v), held.pop(len(v)))
    for dim, rows in held.items():
        yield out(dim, rows)


def _asking(batches):
    """The rows of each shard that ask."""
    for batch in batches:
        rows = []
        for dim, shard, own, ids, asks, data in zip(*(batch[c] for c in ("dim", "shard", "own", "ids", "asks", "data"))):
            pick = np.frombuffer(asks, "u1").astype(bool)
            rows.append((dim, shard, np.frombuffer(own, "<i8")[pick].tobytes(), np.frombuffer(ids, "<i8")[pick].tobytes(), np.frombuffer(data, "<f8").reshape(-1, dim)[pick].tobytes()))
        yield pd.DataFrame(rows, columns=["dim", "shard", "own", "ids", "data"])


class Best:
    """Running top lists of a group's queries of one length."""

    def __init__(self, blobs: list, k: int):
        dim = blobs[0][0]
        self.k, self.own, self.ids = k, np.concatenate([np.frombuffer(b[1], "<i8") for b in blobs]), np.concatenate([np.frombuffer(b[2], "<i8") for b in blobs])
        self.data = np.concatenate([np.frombuffer(b[3], "<f8").reshape(-1, dim) for b in blobs])
        self.most = float(np.abs(self.data).max())
        none = np.zeros(0, np.int64)
        self.lists = [(none, none) for _ in self.ids]
        self.least = np.full(len(self.ids), -(2**63), np.int64)  # the worst score of a full list

    def tile(self, own: np.ndarray, ids: np.ndarray, data: np.ndarray) -> None:
        if self.most * float(np.abs(data).max()) * data.shape[1] < 2.0**53:
            products = (self.data @ data.T).astype(np.int64)
        else:
            whole = np.array([[int(x) for x in row] for row in self.data], dtype=object) @ np.array([[int(x) for x in row] for row in data], dtype=object).T
            products = np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)
        for r in np.flatnonzero(products.max(axis=1) >= self.least):
            line = products[r]
            pick = np.flatnonzero((line >= self.least[r]) & (own != self.own[r]))
            if not len(pick):
                continue
            if len(pick) > self.k:
                enough = np.partition(line[pick], len(pick) - self.k)[len(pick) - self.k]
                pick = pick[line[pick] >= enough]
            scores, found = np.concatenate((self.lists[r][0], line[pick])), np.concatenate((self.lists[r][1], ids[pick]))
            # ~score falls as the score rises, without overflow at the ends
            order = np.lexsort((found, ~scores))[: self.k]
            self.lists[r] = scores[order], found[order]
            if len(order) == self.k:
                self.least[r] = self.lists[r][0][-1]

    def frame(self, cell: int) -> pd.DataFrame:
        sizes = [len(x) for x, _ in self.lists]
        both = [np.concatenate(x) for x in zip(*self.lists)]
        return pd.DataFrame({"own": np.repeat(self.own, sizes), "query_id": np.repeat(self.ids, sizes), "vec_id": both[1], "score": both[0], "cell": cell})


def _tiles(k: int):
    """A group's queries come first, then the cell's shards stream past."""

    def run(batches):
        at, waiting, best = None, {}, {}
        for batch in batches:
            for cell, group, kind, dim, own, ids, data in zip(*(batch[c] for c in ("cell", "query_group", "kind", "dim", "own", "ids", "data"))):
                if (cell, group) != at:
                    for b in best.values():
                        yield b.frame(at[0])
                    at, waiting, best = (cell, group), {}, {}
                if kind == 0:
                    waiting.setdefault(dim, []).append((dim, own, ids, data))
                    continue
                if dim in waiting:
                    best[dim] = Best(waiting.pop(dim), k)
                if dim in best:
                    best[dim].tile(np.frombuffer(own, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, dim))
        for b in best.values():
            yield b.frame(at[0])

    return run


def top_k(vectors: DataFrame, asks: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row of vectors where asks holds, by integer inner product of floor(scale * x)."""
    spark = vectors.sparkSession
    common.text_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = common.fresh_path(spark, "shards")
    quantised(vectors, id_col, vector_col, scale, asks).mapInPandas(_gathered, "dim int, shard long, own binary, ids binary, asks binary, n_asks long, data binary").write.parquet(path)
    shards = spark.read.parquet(path)
    size = shards.agg(F.coalesce(F.sum(F.col("n_asks") * F.col("dim") * 8), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / QUERY_BYTES))
    cells = max(1, parts // groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("shard"), F.lit(n)).cast("int")
    columns = ("cell", "query_group", "kind", "dim", "own", "ids", "data")
    queries = shards.where("n_asks > 0").mapInPandas(_asking, "dim int, shard long, own binary, ids binary, data binary")
    queries = queries.withColumn("query_group", dealt(groups)).withColumn("cell", every(cells)).withColumn("kind", F.lit(0)).select(*columns)
    # the stated query set meets all rows by blocks: each pair of a shard and a group meets in one cell
    rows = shards.withColumn("cell", dealt(cells)).withColumn("query_group", every(groups)).withColumn("kind", F.lit(1)).select(*columns)
    both = queries.union(rows).repartition(parts, "cell", "query_group").sortWithinPartitions("cell", "query_group", "kind")
    lists = both.mapInPandas(_tiles(k), "own long, query_id long, vec_id long, score long, cell int")
    entry, width = F.struct(F.bitwise_not("score").alias("neg"), "vec_id", "score"), cells
    while True:  # tree merge: FAN lists of a query meet at a time
        width = math.ceil(width / FAN)
        lists = lists.withColumn("cell", F.pmod("cell", F.lit(width))).groupBy("own", "query_id", "cell").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
        lists = lists.select("own", "query_id", "cell", F.posexplode("best").alias("p", "b")).select("own", "query_id", "cell", (F.col("p") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
        if width == 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e, F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.own <> c.own AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
