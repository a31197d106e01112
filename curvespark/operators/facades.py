"""Stores as classes over Parquet folders: ordered key-value rows, texts by vector or by curve, and tracks.

A folder is a log of batches; a later batch wins over an earlier one and a deleted key is a batch with the
key marked. Nothing is rewritten on a write, so a failed write leaves the earlier batches whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curvespark.operators import curve_store, store
from curvespark.operators import vectors as V
from curvespark.sources.tables import cut


class Log:
    """Keyed rows in batches; the newest batch of a key counts."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        """Nothing is held open."""

    def _folders(self) -> list[tuple[int, str]]:
        """(number, name) of the finished folders that count: the newest base and the batches after it."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # a folder without its _SUCCESS mark belongs to a write that failed
        names = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = sorted((int(p.getName().partition("=")[2]), p.getName()) for p in names if p.getName().startswith(("batch=", "base=")) and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        base = max((i for i, (_, name) in enumerate(done) if name.startswith("base=")), default=0)
        return done[base:]

    def put(self, rows: DataFrame) -> None:
        """Appends a batch; of rows with one key in it, any one counts."""
        self._write(rows.where(F.col(self.key).isNotNull()).withColumn("_gone", F.lit(False)))

    def _write(self, rows: DataFrame, kind: str = "batch") -> None:
        done = self._folders()
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}={(done[-1][0] if done else -1) + 1}")

    def rows(self) -> DataFrame:
        done = self._folders()
        if not done:
            raise ValueError(f"{self.path} holds no rows")
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        if len(done) == 1 and done[0][1].startswith("base="):  # each key once, none gone: no shuffle
            return read(done[0][1]).drop("_gone")
        log = None
        for number, name in done:
            part = read(name).withColumn("batch", F.lit(number))
            log = part if log is None else log.unionByName(part, allowMissingColumns=True)
        names = [c for c in log.columns if c not in ("batch", self.key)]
        last = log.groupBy(self.key).agg(F.max_by(F.struct(*names), "batch").alias("_r"))
        return last.where("NOT _r._gone").select(self.key, *[F.col(f"_r.{c}").alias(c) for c in names if c != "_gone"])

    def compact(self) -> None:
        """Writes the rows that count as one base, ordered by key; later reads of it alone need no aggregation."""
        self._write(self.rows().withColumn("_gone", F.lit(False)).repartitionByRange(self.key).sortWithinPartitions(self.key), "base")

    def get(self, key) -> DataFrame:
        return self.rows().where(F.col(self.key) == F.lit(key))

    def range_query(self, start: int, end: int, limit: int | None = None) -> DataFrame:
        """Rows with start <= key <= end in key order; a negative start counts as 0."""
        return V.range_scan(self.rows(), self.key, start, end, limit)

    def delete(self, keys: DataFrame) -> int:
        """Marks keys as gone; how many there were."""
        gone = self.rows().join(keys.select(self.key), self.key, "left_semi").withColumn("_gone", F.lit(True))
        n = gone.count()
        if n:
            self._write(gone)
        return n

    def count(self) -> int:
        return self.rows().count() if self._folders() else 0

    def stats(self) -> dict:
        return {"rows": self.count(), "batches": len(self._folders()), "path": self.path}


def embedded(docs: DataFrame, dims: int = 64) -> DataFrame:
    """(vec_id, v): the mean of a text's word vectors; a text without words is the zero vector."""

    def run(batches):
        for b in batches:
            means = [p.mean(axis=0) if len(p := curve_store.token_vectors(t or "", dims)) else np.zeros(dims) for t in b["text"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [m.tolist() for m in means]})

    return docs.select(F.col("doc_id").alias("vec_id"), "text").mapInPandas(run, "vec_id long, v array<double>")


class TextVectors(Log):
    """Texts searched by the curve index of their embeddings; embed (DataFrame -> vec_id, v) is the pluggable model."""

    def __init__(self, spark: SparkSession, path: str, embed=embedded):
        super().__init__(spark, path, "doc_id")
        self.embed = embed

    def add_batch(self, docs: DataFrame) -> None:
        self.put(docs.select("doc_id", "text"))

    def search(self, queries: DataFrame, k: int = 10, pool: int = 100, exact: bool = True) -> DataFrame:
        """(query_id, doc_id, sim, rank) for query texts (query_id, text), whose ids are apart from the documents'."""
        asked = queries.select((-F.col("query_id") - 1).alias("doc_id"), "text")
        v = self.embed(self.rows().where("doc_id >= 0").select("doc_id", "text").unionByName(asked))
        # the queries stand among the rows; as many more neighbours are asked for, so that dropping them loses none
        got = store.vector_search(v, v.where("vec_id < 0").select("vec_id"), k + asked.count(), pool, exact).where("vec_id >= 0")
        return V.ranked(got.select((-F.col("query_id") - 1).alias("query_id"), F.col("vec_id").alias("doc_id"), "sim"), "query_id", "sim", "doc_id", k)


class TextCurves(Log):
    """Texts searched as curves: principal scores fix a radius, the curve metric decides on every curve that a bound leaves within it."""

    def __init__(self, spark: SparkSession, path: str, components: int = 8):
        super().__init__(spark, path, "doc_id")
        self.components = components

    def add_documents(self, docs: DataFrame) -> None:
        self.put(curve_store.text_curves(docs))

    def search(self, query_ids: DataFrame, k: int = 10, rerank_factor: int = 10, metric: str = "frechet") -> DataFrame:
        return curve_store.search(self.rows(), query_ids, k, rerank_factor, metric, self.components)


class Tracks(Log):
    """Tracks with certified range and nearest-neighbour queries; a track that is put again replaces the former one."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, "track")

    def ingest(self, points: DataFrame) -> None:
        self.put(points.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("seq", "t", "x", "y"))).alias("p")))

    def points(self) -> DataFrame:
        return self.rows().select("track", F.inline("p"))

    def range(self, queries: DataFrame, r: float, tol: float = 10.0) -> DataFrame:
        return store.certified_range(queries, self.points(), r, tol)

    def knn(self, queries: DataFrame, k: int, pool: int = 50) -> DataFrame:
        return store.knn(queries, self.points(), k, pool)


class Embeddings:
    """Vectors under contiguous numbers from 0, appended in batches; the numbers are the order of arrival."""

    def __init__(self, spark: SparkSession, path: str, dims: int):
        self.log, self.dims = Log(spark, path, "emb_idx"), dims

    def __len__(self) -> int:
        return self.log.count()

    def add_batch(self, vectors: DataFrame) -> tuple[int, int]:
        """Appends rows (v); the first number given and the first after them. Raises on a vector of another length."""
        rows = cut(vectors.select(V.doubles("v").alias("v")).withColumn("_id", F.monotonically_increasing_id()))
        if not rows.where((F.size("v") != self.dims) | F.col("v").isNull()).isEmpty():
            raise ValueError(f"vectors need {self.dims} dimensions")
        part = F.shiftright("_id", 33)
        sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
        start = at = len(self)
        first = []
        for p, n in sizes:
            first += [F.lit(p), F.lit(at)]
            at += n
        if sizes:
            self.log.put(rows.select((F.element_at(F.create_map(*first), part) + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long").alias("emb_idx"), "v"))
        return start, at

    def get(self, index: int) -> list[float]:
        found = self.log.get(index).first() if self.log._folders() else None
        if found is None:
            raise IndexError(f"no vector {index}")
        return found["v"]

    def get_batch(self, indices: DataFrame) -> DataFrame:
        """(emb_idx, v) of the numbers asked for, each as often as asked; a number beyond the last one raises."""
        asked = indices.select("emb_idx").join(self.log.rows().withColumn("_v", F.col("v")).select("emb_idx", "_v"), "emb_idx", "left")
        return asked.select("emb_idx", F.when(F.col("_v").isNull(), F.raise_error(F.lit("no such vector")).cast("array<double>")).otherwise(F.col("_v")).alias("v"))

    def get_all(self) -> DataFrame:
        return self.log.rows()

    def size_bytes(self) -> int:
        return 8 * self.dims * len(self)


class VectorStore(Log):
    """Texts under the keys of a space-filling curve over their first principal scores.

    The model (mean, loadings, ranges; dims x components numbers) is fitted on the first batch, kept as a table, and frozen. A search takes
    the rows whose keys are within a radius of the query's, widened to half of all keys where there are fewer
    than k: the lowest keys ('low_end') or those nearest to the query's ('nearest'), and reranks them by cosine.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 10, components: int = 12, embed=embedded):
        super().__init__(spark, path, "doc_id")
        if bits * components > 126:
            raise ValueError("keys hold 126 bits")
        self.bits, self.components, self.embed = bits, components, embed

    def _model(self) -> dict | None:
        try:
            row = self.spark.read.parquet(f"{self.path}/model").first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return row.asDict()

    @property
    def fitted(self) -> bool:
        return self._model() is not None

    def _fit(self, vectors: DataFrame) -> dict:
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        if (n := vectors.count()) < self.components:
            raise ValueError(f"the first batch needs {self.components} rows, it has {n}")
        pca = PCA(k=self.components, inputCol="f", outputCol="o").fit(vectors.select(array_to_vector("v").alias("f")))
        loadings = pca.pc.toArray()
        loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), range(self.components)])
        scores = vectors.select(_projected(F.col("v"), loadings.T.tolist()).alias("s")).select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
        model = {"loadings": loadings.T.tolist(), "lo": [r["lo"] for r in scores], "hi": [r["hi"] for r in scores], "explained": pca.explainedVariance.toArray().tolist()}
        self.spark.createDataFrame([model], "loadings array<array<double>>, lo array<double>, hi array<double>, explained array<double>").write.parquet(f"{self.path}/model")
        return model

    def explained_variance(self) -> list[float]:
        return self._fitted()["explained"]

    def _fitted(self) -> dict:
        if (model := self._model()) is None:
            raise RuntimeError("the store is empty; add documents first")
        return model

    def _keyed(self, vectors: DataFrame, model: dict) -> DataFrame:
        """vectors with hkey as a whole number."""
        scores = _projected(F.col("v"), model["loadings"])
        grid = [V.to_grid(F.get(scores, F.lit(i)), F.lit(lo), F.lit(hi), self.bits) for i, (lo, hi) in enumerate(zip(model["lo"], model["hi"]))]
        bits = self.bits
        names = vectors.columns

        def run(batches):
            from decimal import Decimal

            from curvespark.functions import curves

            for b in batches:
                keys = curves.hilbert_keys(np.array(b["_g"].tolist()), bits) if len(b) else []
                yield b[names].assign(hkey=[Decimal(k) for k in keys])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
        return vectors.withColumn("_g", F.array(*grid)).mapInPandas(run, f"{schema}, hkey decimal(38,0)")

    def add_batch(self, docs: DataFrame) -> None:
        rows = cut(self.embed(docs).withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "v"))
        keyed = self._keyed(rows, self._model() or self._fit(rows))
        self.put(keyed.repartitionByRange("hkey").sortWithinPartitions("hkey"))

    def search(self, query: str, k: int = 10, radius: int | None = None, rerank: bool = True, candidates: str = "nearest", last_wins: bool = False) -> DataFrame:
        """(doc_id, text, score, rank); score is the cosine, 0 without rerank (then by key). last_wins keeps one row a key, the largest doc_id."""
        if candidates not in ("nearest", "low_end"):
            raise ValueError(f"unknown choice of candidates {candidates}")
        model, top = self._fitted(), V.key_limit(self.bits, self.components)
        asked = self._keyed(self.embed(self.spark.createDataFrame([(0, query)], "doc_id long, text string")).select("v"), model).first()
        rows = self.rows()
        if last_wins:
            rows = rows.groupBy("hkey").agg(F.max_by(F.struct("doc_id", "text", "v"), "doc_id").alias("r")).select("hkey", "r.*")
        key = int(asked["hkey"])
        number = lambda n: F.lit(str(n)).cast("decimal(38,0)")
        limit = 3 * k if rerank else k

        def pool(reach: int) -> DataFrame:
            near = rows.where(F.col("hkey").between(number(max(0, key - reach)), number(min(top, key + reach))))
            away = F.col("hkey") if candidates == "low_end" else F.abs(F.col("hkey") - number(key))
            return cut(near.withColumn("_away", away).orderBy("_away", "doc_id").limit(limit))

        found = pool(max(top // 5, 10_000 * k) if radius is None else radius)
        if found.count() < k:
            found = pool(top // 2)
        q = F.array(*[F.lit(float(x)) for x in asked["v"]])
        scored = found.withColumn("score", F.round(V.cosine_batch(q, F.col("v")), 6) if rerank else F.lit(0.0)).withColumn("_q", F.lit(0))
        order = [F.col("score").desc(), F.col("doc_id")] if rerank else [F.col("_away"), F.col("doc_id")]
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy(*order)))  # 3 k rows at most
        return ranked.where(F.col("rank") <= k).select("doc_id", "text", "score", "rank")

    def stats(self) -> dict:
        return super().stats() | {"bits": self.bits, "components": self.components, "fitted": self.fitted}


def _projected(v, loadings: list):
    return F.array(*[V.dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in loadings])


class CurveStore(Log):
    """Texts as curves with a fitted model of principal scores; searched by free text."""

    def __init__(self, spark: SparkSession, path: str, components: int = 8, metric: str = "frechet"):
        super().__init__(spark, path, "doc_id")
        if metric not in curve_store.METRICS:
            raise ValueError(f"unknown metric {metric}")
        self.components, self.metric = components, metric

    def add_documents(self, docs: DataFrame) -> None:
        """Texts of under two words have no curve and are left out. The model must be fitted again."""
        self.put(curve_store.text_curves(docs).join(docs.select("doc_id", "text"), "doc_id"))

    def fit(self) -> None:
        """Fits mean and loadings on all curves, and writes the model and every row's scores."""
        from pyspark.ml.feature import PCA
        from pyspark.ml.functions import array_to_vector

        rows = cut(self.rows())
        if (n := rows.count()) < self.components:
            raise ValueError(f"the model needs {self.components} curves, there are {n}")
        pca = PCA(k=self.components, inputCol="f", outputCol="o").fit(rows.select(array_to_vector("v").alias("f")))
        loadings = pca.pc.toArray()
        loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), range(self.components)])
        mean = [r["m"] for r in rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]  # as long as a curve
        model = (mean, loadings.T.tolist(), pca.explainedVariance.toArray().tolist())
        rows.select("doc_id", _centred(F.col("v"), mean, model[1]).alias("scores")).write.mode("overwrite").parquet(f"{self.path}/scores")
        self.spark.createDataFrame([model], "mean array<double>, loadings array<array<double>>, explained array<double>").write.mode("overwrite").parquet(f"{self.path}/model")

    def _model(self):
        try:
            return self.spark.read.parquet(f"{self.path}/model").first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise RuntimeError("the store must be fitted first") from None
            raise

    def explained_variance(self) -> list[float]:
        return self._model()["explained"]

    def transform(self, curves_rows: DataFrame) -> DataFrame:
        """(doc_id, scores) of curves (doc_id, v)."""
        m = self._model()
        return curves_rows.select("doc_id", _centred(F.col("v"), m["mean"], m["loadings"]).alias("scores"))

    def inverse(self, scores: list[float]) -> np.ndarray:
        """The curve that has these scores and no other part: samples x dimensions."""
        m = self._model()
        return (np.array(m["mean"]) + np.array(scores) @ np.array(m["loadings"])).reshape(curve_store.SAMPLES, curve_store.DIMS)

    def search(self, query: str, k: int = 10, rerank_factor: int = 10) -> DataFrame:
        """(doc_id, text, dist, rank): the k * rerank_factor nearest by scores, the k nearest of these by the metric.

        A query of under two words has no curve: the mean of its word vectors, padded or cut, stands for its scores, and
        the distance of scores decides. A distance that is not a number falls back to that of the scores as well.
        """
        m, p = self._model(), curve_store.token_vectors(query)
        if len(p) > 1:
            curve = curve_store.sampled(p).ravel()
            scores = np.array(m["loadings"]) @ (curve - np.array(m["mean"]))
        else:
            curve, mean = None, p.mean(axis=0) if len(p) else np.zeros(curve_store.DIMS)
            scores = np.pad(mean, (0, max(0, self.components - len(mean))))[: self.components]
        near = V.l2(F.col("scores"), F.array(*[F.lit(float(x)) for x in scores])).alias("near")
        pool = self.spark.read.parquet(f"{self.path}/scores").select("doc_id", near).orderBy("near", "doc_id").limit(k * rerank_factor).join(self.rows(), "doc_id")
        if curve is None:
            told = pool.select("doc_id", "text", F.col("near").alias("dist"))
        else:
            kernel, shape = curve_store.METRICS[self.metric], (curve_store.SAMPLES, curve_store.DIMS)
            q = curve.reshape(shape)

            def one(r):
                d = float(kernel(q, np.asarray(r.v).reshape(shape)))
                yield r.doc_id, r.text, d if np.isfinite(d) else float(r.near)

            told = store.map_rows(pool, one, "doc_id long, text string, dist double")
        ranked = told.withColumn("_q", F.lit(0)).withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy("dist", "doc_id")))  # k * rerank_factor rows at most
        return ranked.where(F.col("rank") <= k).select("doc_id", "text", "dist", "rank")


def _centred(v, mean: list, loadings: list):
    return _projected(F.zip_with(v, F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m), loadings)
