"""Stores as classes, sweeps, generated near-duplicates and the exact vector index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvespark.operators import facades, store, sweeps
from curvespark.sources import synth


@pytest.fixture(scope="module")
def points(spark):
    return synth.tracks(spark, 6).select("track", "seq", "t", "x", "y").cache()


def test_log(spark, tmp_path):
    with facades.Log(spark, f"{tmp_path}/kv", "hkey") as kv:
        assert kv.count() == 0
        kv.put(spark.createDataFrame([(100, "a"), (200, "b"), (300, "c"), (None, "x")], "hkey long, value string"))
        kv.put(spark.createDataFrame([(200, "B"), (2**62, "z")], "hkey long, value string"))
        assert kv.get(200).first()["value"] == "B" and kv.get(7).count() == 0
        assert [r["hkey"] for r in kv.range_query(-5, 300).collect()] == [100, 200, 300]
        assert [r["hkey"] for r in kv.range_query(0, 2**62, 2).collect()] == [100, 200]
        assert kv.delete(spark.createDataFrame([(100,), (999,)], "hkey long")) == 1
        kv.put(spark.createDataFrame([(100, "again")], "hkey long, value string"))
        assert kv.count() == 4 and kv.stats()["batches"] == 4


def test_texts(spark, tmp_path):
    docs = spark.createDataFrame([(0, "cats and dogs play"), (1, "dogs and cats rest"), (2, "stars and planets shine"), (3, None)], "doc_id long, text string")
    db = facades.TextVectors(spark, f"{tmp_path}/v")
    db.add_batch(docs)
    got = db.search(spark.createDataFrame([(0, "cats and dogs"), (1, "planets shine")], "query_id long, text string"), 2).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got if r["rank"] == 1} == {(0, 0), (1, 2)} and len(got) == 4


def test_tracks(spark, points, tmp_path):
    db = facades.Tracks(spark, f"{tmp_path}/t")
    db.ingest(points)
    key = lambda df: sorted(map(tuple, df.select("q", "c", "hit").collect()))
    assert key(db.range(points, 300.0)) == key(store.certified_range(points, points, 300.0, 10.0))


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)) + 4 * rng.normal(size=(6, 16))[rng.integers(0, 6, 600)]
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    got = {}
    for r in store.vector_search(df, df.where("vec_id % 50 = 0"), 10, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)
    for q in range(0, 600, 50):
        sim = np.round(u @ u[q], 6)
        want = [i for i in np.lexsort((np.arange(600), -sim)) if i != q][:10]
        assert [got[q][k] for k in range(1, 11)] == want


def test_sweeps(points):
    cells = sweeps.grid(points, [2.0, 20.0])
    rows = cells.toPandas()
    best = sweeps.cheapest(cells, 15.0).toPandas()
    for r in best.itertuples():
        ok = rows[(rows.track == r.track) & (rows.method == r.method) & (rows.eps <= 15.0)]
        assert r.bytes == ok.bytes.min()
    assert sweeps.report(cells, 15.0).agg(F.sum("tracks")).first()[0] == len(rows)


def test_near_duplicates(points):
    from curvespark.functions import curves

    out, reached = synth.covering_duplicates(points, store.simplified(points, 10.0), [50.0, 200.0])
    assert min(reached.values()) >= 0.1
    of = lambda df: {k: g.sort_values("seq")[["x", "y"]].to_numpy() for k, g in df.toPandas().groupby("track")}
    base = of(points)
    some = out.where("source = 0")
    source = {r["track"]: r["distance"] for r in some.select("track", "distance").distinct().collect()}
    for track, xy in of(some).items():
        assert abs(curves.discrete_frechet(base[0], xy) - source[track]) < 1e-6


@pytest.mark.parametrize("metric", ["frechet", "dtw", "l2", "cosine"])
def test_curve_search_is_exact(spark, tmp_path, metric):
    from curvespark.operators import curve_store

    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(words, rng.integers(2, 12)))) for i in range(240)]
    db = facades.TextCurves(spark, f"{tmp_path}/c")
    db.add_documents(spark.createDataFrame(texts + [(300, None), (301, texts[40][1])], "doc_id long, text string"))
    asked = [0, 40, 80, 120]
    got = {}
    for r in db.search(spark.createDataFrame([(i,) for i in asked], "doc_id long"), 5, 2, metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], round(r["dist"], 9))
    p = {i: curve_store.sampled(curve_store.token_vectors(t)) for i, t in [*texts, (301, texts[40][1])]}
    for q in asked:
        want = sorted((round(curve_store.METRICS[metric](p[q], p[i]), 9), i) for i in p if i != q)[:5]
        assert got[q] == {k + 1: (i, d) for k, (d, i) in enumerate(want)}


def test_compacted_log(spark, tmp_path):
    kv = facades.Log(spark, f"{tmp_path}/kv", "k")
    kv.put(spark.createDataFrame([(i, "a") for i in range(5)], "k long, v string"))
    kv.put(spark.createDataFrame([(1, "b")], "k long, v string"))
    kv.delete(spark.createDataFrame([(2,)], "k long"))
    before = sorted(map(tuple, kv.rows().collect()))
    kv.compact()
    assert sorted(map(tuple, kv.rows().collect())) == before == [(0, "a"), (1, "b"), (3, "a"), (4, "a")] and kv.stats()["batches"] == 1
    assert "Aggregate" not in kv.rows()._jdf.queryExecution().toString()
    kv.put(spark.createDataFrame([(2, "c")], "k long, v string"))
    assert kv.count() == 5


def test_embeddings(spark, tmp_path):
    e = facades.Embeddings(spark, f"{tmp_path}/e", 3)
    make = lambda a, n: spark.createDataFrame([([float(i), 0.0, 1.0],) for i in range(a, a + n)], "v array<double>").repartition(3)
    assert e.add_batch(make(0, 10)) == (0, 10) and e.add_batch(make(10, 7)) == (10, 17) and len(e) == 17 and e.size_bytes() == 17 * 24
    assert sorted(r["emb_idx"] for r in e.get_all().collect()) == list(range(17))
    assert {r["emb_idx"]: r["v"][0] < 10 for r in e.get_all().collect()} == {i: i < 10 for i in range(17)}
    assert len(e.get_batch(spark.createDataFrame([(3,), (3,), (16,)], "emb_idx long")).collect()) == 3 and e.get(5) is not None
    with pytest.raises(IndexError):
        e.get(17)
    with pytest.raises(Exception, match="no such vector"):
        e.get_batch(spark.createDataFrame([(99,)], "emb_idx long")).collect()
    with pytest.raises(ValueError):
        e.add_batch(spark.createDataFrame([([1.0],)], "v array<double>"))


def test_vector_store(spark, tmp_path):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words[:15] if i % 2 else words[15:], 12)) for i in range(60)]
    docs = lambda a, b: spark.createDataFrame([(i, texts[i]) for i in range(a, b)], "doc_id long, text string")
    db = facades.VectorStore(spark, f"{tmp_path}/v", bits=6, components=3)
    with pytest.raises(RuntimeError):
        db.search("x")
    with pytest.raises(ValueError):
        db.add_batch(docs(0, 2))
    db.add_batch(docs(0, 40))
    db.add_batch(docs(40, 60))
    assert db.count() == 60 and db.fitted and len(db.explained_variance()) == 3
    top = 2**18 - 1
    near = [r["doc_id"] for r in db.search(texts[7], 5, radius=top).collect()]
    whole = db.search(texts[7], 60, radius=top)
    got = whole.orderBy("rank").collect()
    assert got[0]["doc_id"] == 7 and got[0]["score"] > 0.999 and len(got) == 60 and len(near) == 5
    assert [r["rank"] for r in got] == list(range(1, 61)) and all(a["score"] >= b["score"] for a, b in zip(got, got[1:]))
    rows = {r["doc_id"]: int(r["hkey"]) for r in db.rows().collect()}
    low = db.search(texts[7], 4, radius=top, rerank=False, candidates="low_end").orderBy("rank").collect()
    assert [r["doc_id"] for r in low] == sorted(rows, key=lambda i: (rows[i], i))[:4] and {r["score"] for r in low} == {0.0}
    close = db.search(texts[7], 4, radius=top, rerank=False).orderBy("rank").collect()
    assert [r["doc_id"] for r in close] == sorted(rows, key=lambda i: (abs(rows[i] - rows[7]), i))[:4]
    few = db.search(texts[7], 8, radius=0)  # too few in reach: half of all keys are
    assert few.count() == min(8, sum(abs(k - rows[7]) <= top // 2 for k in rows.values()))
    once = db.search(texts[7], 60, radius=top, last_wins=True)
    assert once.count() == len({k for k in rows.values() if abs(k - rows[7]) <= top})
    with pytest.raises(ValueError):
        db.search("x", candidates="far")


def test_curve_store(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(rng.choice(words, 10)) for _ in range(25)]
    db = facades.CurveStore(spark, f"{tmp_path}/c", components=4)
    db.add_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "one")], "doc_id long, text string"))
    with pytest.raises(RuntimeError):
        db.search("a b")
    db.fit()
    assert db.count() == 25 and len(db.explained_variance()) == 4
    got = db.search(texts[3], 3).orderBy("rank").collect()
    assert got[0]["doc_id"] == 3 and got[0]["dist"] < 1e-9 and got[0]["text"] == texts[3] and len(got) == 3
    assert db.search("word", 2).count() == 2 and db.search("", 2).count() == 2
    again = facades.CurveStore(spark, f"{tmp_path}/c", components=4)
    rows = db.rows()
    scores = {r["doc_id"]: r["scores"] for r in again.transform(rows).collect()}
    saved = {r["doc_id"]: r["scores"] for r in spark.read.parquet(f"{tmp_path}/c/scores").collect()}
    assert all(np.allclose(scores[i], saved[i]) for i in scores) and np.abs(np.mean(list(scores.values()), axis=0)).max() < 1e-9
    v = {r["doc_id"]: np.array(r["v"]) for r in rows.collect()}
    mean = np.mean(list(v.values()), axis=0)
    left = [np.sum((again.inverse(scores[i]).ravel() - v[i]) ** 2) for i in v]
    assert np.sum(left) < np.sum([np.sum((mean - x) ** 2) for x in v.values()])
    with pytest.raises(ValueError):
        facades.CurveStore(spark, f"{tmp_path}/d", metric="none")
    few = facades.CurveStore(spark, f"{tmp_path}/e", components=4)
    few.add_documents(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    with pytest.raises(ValueError):
        few.fit()


def test_curve_search_copies_no_vector_a_pair(spark):
    """Pairs of the pool meet as numbers in tiles, and the components are in no plan that the driver keeps."""
    from curvespark.operators import curve_store

    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice([f"w{j}" for j in range(30)], 6))) for i in range(60)], "doc_id long, text string")
    rows = curve_store.cut(curve_store.text_curves(docs))
    asked = rows.where("doc_id % 10 = 0").select("doc_id")
    scores = store.principal_scores(rows, "doc_id", "v", 3)
    assert len(scores._jdf.queryExecution().toString()) < 20_000 and scores.count() == 60
    assert store.principal_scores(rows.limit(0), "doc_id", "v", 3).count() == 0
    plan = curve_store.search(rows, asked, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "qv#" not in plan


@pytest.mark.parametrize("metric", ["frechet", "dtw"])
def test_screens_are_bounds(metric):
    from curvespark.operators import curve_store

    rng = np.random.default_rng(4)
    many = rng.normal(size=(40, curve_store.SAMPLES, curve_store.DIMS))
    many[1] = many[0]
    got = curve_store.distances(metric, np.repeat(many[:1], 40, axis=0), many)
    assert (curve_store.screened(metric, many[0], many) <= got).all() and got[1] == 0
    assert np.allclose(got, [curve_store.METRICS[metric](many[0], p) for p in many], rtol=1e-12, atol=0)
