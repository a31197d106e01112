"""Vector and key operators: similarities, exact top-k, grids, ordered key-value rows and retrieval metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def doubles(c: str) -> Column:
    return F.col(c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, tiny: float = 1e-10) -> Column:
    """Cosine; 0 where a norm is below tiny."""
    return F.when((norm(a) < tiny) | (norm(b) < tiny), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def cosine_batch(a: Column, b: Column, tiny: float = 1e-10) -> Column:
    return dot(a, b) / ((norm(a) + tiny) * (norm(b) + tiny))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 where a norm is 0."""
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(2.0)).otherwise(1 - dot(a, b) / (norm(a) * norm(b)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine, "cosine_batch": cosine_batch, "cosine_distance": cosine_distance, "l2": l2}


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return METRICS[name]


def ranked(pairs: DataFrame, query: str, score: str, item: str, k: int, descending: bool = True) -> DataFrame:
    """The k best items of each query with their rank; ties go to the smaller item."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(order, item)).cast("long")).where(F.col("rank") <= k)


def against_all(rows: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Each query with every row, block by block: a row falls in one cell by its hash, a query goes to all cells.

    The cells are joined on their number, so neither side has to fit a task and no pair is built outside a cell.
    """
    cells = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = queries.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    return rows.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(cells).cast("long"))).join(spread, "_cell").drop("_cell")


def blobs(df: DataFrame, most: int, groups: int | None = None) -> DataFrame:
    """(blob, ids, marks, pools, counts, data): rows (id, v and, where it has them, mark, pool) in blobs of at most `most` vectors.

    marks are one number a row, pools are the rows' pools one after the other, counts their lengths. Without groups, each partition makes its own blobs and no row moves.
    """
    given = [c for c in ("mark", "pool") if c in df.columns]
    schema = "blob long, ids binary, marks binary, pools binary, counts binary, data binary"

    def gather(batches):
        from pyspark import TaskContext

        base, count, held = TaskContext.get().partitionId() << 32, 0, []

        def out():
            ids, vs, *more = zip(*held)
            more = dict(zip(given, more))
            pools = [np.asarray(p, "<i8") for p in more.get("pool", [])]
            packed = [np.array(ids, "<i8"), np.array(more.get("mark", []), "<f8"), np.concatenate(pools or [np.zeros(0, "<i8")]), np.array([len(p) for p in pools], "<i8"), np.array(vs, "<f8")]
            return pd.DataFrame([[base + count, *(x.tobytes() for x in packed)]], columns=[c.split()[0] for c in schema.split(", ")])

        for b in batches:
            for row in zip(*(b[c] for c in ("id", "v", *given))):
                held.append(row)
                if len(held) == most:
                    yield out()
                    count, held = count + 1, []
        if held:
            yield out()

    return (df.repartition(groups, F.xxhash64("id")) if groups else df).mapInPandas(gather, schema)


def met(shards: DataFrame, blocks: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel(tile) -> frame, for every shard with every block of queries (columns of both, a block's with q_ before them)."""
    named = blocks.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "marks", "pools", "counts", "data")])

    def run(batches):
        for b in batches:
            for tile in b.itertuples(index=False):
                yield kernel(tile)

    return against_all(shards.select("blob", "ids", "marks", "data"), named, "blob").mapInPandas(run, schema)


#: Vectors of a shard, and queries of a block.
SHARD, BLOCK = 4096, 64


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dot of each row of a with that of b: the same sums in the same order."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _similar(k: int, digits: int, tiny: float = 1e-10):
    """Of a shard, what can be among a query's k best by cosine_batch rounded to digits: nearly as good as the k-th, and of equals the k smallest ids."""

    def run(tile):
        (ids, marks, many), (q_ids, q_marks, asked) = ((np.frombuffer(i, "<i8"), np.frombuffer(m, "<f8"), np.frombuffer(x, "<f8").reshape(len(i) // 8, -1)) for i, m, x in ((tile.ids, tile.marks, tile.data), (tile.q_ids, tile.q_marks, tile.q_data)))
        norms, q_norms = (np.sqrt(_dots(x, x)) + tiny for x in (many, asked))
        about = (asked @ many.T) / (q_norms[:, None] * norms)
        about[q_ids[:, None] == ids] = -np.inf
        kth = np.partition(about, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q_ids), -np.inf)
        i, j = np.nonzero((about >= kth[:, None] - 2 * 10.0**-digits) & (about > -np.inf))
        sim = np.concatenate([np.zeros(0), *(_dots(asked[i[a : a + SHARD]], many[j[a : a + SHARD]]) for a in range(0, len(i), SHARD))]) / (q_norms[i] * norms[j])
        order = np.lexsort((ids[j], -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        first = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(sim) != 0)]) if len(i) else np.zeros(0, int)
        keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
        i, j = i[keep], j[keep]
        return pd.DataFrame({"query_id": q_ids[i], "id": ids[j], "sim": sim[keep], "mark": marks[j], "q_mark": q_marks[i]})

    return run


def most_similar(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, id, sim, mark, q_mark, rank): of rows (id, v, mark) the k best for each query (query_id, q, q_mark) but itself, by cosine_batch
    rounded to digits; ties go to the smaller id.

    Tiles of a shard and a block of queries leave over what their product allows, whose similarity is summed as cosine_batch does.
    Vectors that are null, of another length than the longest or hold null or not finite components meet every vector by cosine_batch itself.
    """
    dims = (rows.agg(F.max(F.size("v"))).first() or [0])[0] or 0
    clean = lambda v: F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e100)), F.lit(False))
    rows, queries = rows.where("id IS NOT NULL").withColumn("_ok", clean(F.col("v"))), queries.where("query_id IS NOT NULL").withColumn("_ok", clean(F.col("q")))
    shards = blobs(rows.where("_ok").select("id", "v", F.col("mark").cast("double").alias("mark")), SHARD)
    cells = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blobs(queries.where("_ok").select(F.col("query_id").alias("id"), F.col("q").alias("v"), F.col("q_mark").cast("double").alias("mark")), BLOCK, max(1, cells // 4))
    near = met(shards, blocks, _similar(k, digits), "query_id long, id long, sim double, mark double, q_mark double")
    none = F.lit(None).cast("double")
    near = near.select("query_id", "id", "sim", *[F.when(~F.isnan(c), F.col(c)).otherwise(none).alias(c) for c in ("mark", "q_mark")])
    odd = against_all(rows.where("NOT _ok").drop("_ok"), queries.drop("_ok"), "id").unionByName(against_all(rows.where("_ok").drop("_ok"), queries.where("NOT _ok").drop("_ok"), "id"))
    odd = odd.where("id <> query_id").select("query_id", "id", cosine_batch(F.col("q"), F.col("v")).alias("sim"), F.col("mark").cast("double").alias("mark"), F.col("q_mark").cast("double").alias("q_mark"))
    return ranked(near.union(odd).withColumn("sim", F.round("sim", digits)), "query_id", "sim", "id", k)


def dimension_ranges(vectors: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """Smallest and largest value of the first dims dimensions (all, if None)."""
    return vectors.select(F.posexplode(F.slice(doubles(vector), 1, dims) if dims else doubles(vector)).alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def to_grid(v: Column, lo: Column, hi: Column, bits: int) -> Column:
    """Integer coordinate on a 2**bits grid, truncated; a flat dimension takes the middle."""
    top = float(2**bits - 1)
    return F.when(hi - lo < 1e-10, F.lit(int(top) // 2).cast("long")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(top), (v - lo) / (hi - lo) * top)).cast("long"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def range_scan(rows: DataFrame, key: str, start: int, end: int, limit: int | None = None) -> DataFrame:
    out = rows.where(F.col(key).between(max(0, start), end)).orderBy(key)
    return out.limit(limit) if limit else out


def range_join(queries: DataFrame, rows: DataFrame, radius: int, most: int) -> DataFrame:
    """(query_id, doc_id, qkey, hkey) with |hkey - qkey| <= radius, by buckets of that width."""
    q = queries.withColumn("lo", F.greatest(F.lit(0), F.col("qkey") - radius)).withColumn("hi", F.least(F.lit(most), F.col("qkey") + radius))
    q = q.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / radius), F.floor(F.col("hi") / radius))))
    r = rows.withColumn("bucket", F.floor(F.col("hkey") / radius))
    return q.join(r, "bucket").where(F.col("hkey").between(F.col("lo"), F.col("hi"))).select("query_id", "doc_id", "qkey", "hkey")


def retrieval(got: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr) of ranked rows (query_id, item, rank) against (query_id, item)."""
    size = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = got.where(F.col("rank") <= k).join(relevant, ["query_id", "item"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    return size.join(hits, "query_id", "left").select("query_id", F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best of candidates (query_id, item) by cosine to queries (query_id, q), with vectors (item, v); an item without a vector counts as the zero vector."""
    rows = candidates.join(queries, "query_id").join(vectors, "item", "left")
    score = F.when(F.col("v").isNull(), F.lit(0.0)).otherwise(cosine_batch(F.col("q"), F.coalesce("v", F.col("q"))))
    return ranked(rows.select("query_id", "item", F.round(score, 6).alias("sim")), "query_id", "sim", "item", k)


def key_limit(bits: int, dims: int) -> int:
    """The largest key of a space-filling curve on a grid of 2**bits in dims dimensions."""
    return 2 ** (bits * dims) - 1


def valid_point(point: Column, bits: int, dims: int) -> Column:
    """Whether an array of integers has dims coordinates of a 2**bits grid; a null array or coordinate is not valid."""
    return F.coalesce((F.size(point) == dims) & F.forall(point, lambda v: v.between(0, 2**bits - 1) & v.isNotNull()), F.lit(False))


def pairwise(rows: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    """(i, j, dist) of every two rows by a named metric: those with i < j are computed, their mirror images added.

    A matrix for a stated, small set of rows: it has as many cells as the set has pairs.
    """
    a, b = rows.select(F.col(id_col).alias("i"), F.col(vector).alias("a")), rows.select(F.col(id_col).alias("j"), F.col(vector).alias("b"))
    half = against_all(a, b, "i").where("i < j").select("i", "j", metric(name)(F.col("a"), F.col("b")).alias("dist"))
    return half.union(half.select("j", "i", "dist"))


def batch(queries: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(query_id, item, dist) of queries (query_id, q) against rows (item, v) by a named metric."""
    return against_all(rows, queries, "item").select("query_id", "item", metric(name)(F.col("q"), F.col("v")).alias("dist"))


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the smallest by a digest of id and seed: the same on every engine and at every partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(n)
