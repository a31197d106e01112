"""SQL functions, table functions, file readers, streaming ingest, kernel placement, reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvespark.functions import codec, curves, fits, frechet, splines, udf
from curvespark.operators import experiments, store, sweeps, tracks
from curvespark.operators import vectors as V
from curvespark.sources import synth
from curvespark.sources import tables as S


def test_sql_functions(spark):
    names = udf.register(spark)
    rng = np.random.default_rng(1)
    rows, want = [], []
    for i in range(6):
        p = rng.normal(0, 5, (8, 2)).cumsum(axis=0)
        q = p + [3.0, 4.0]
        rows.append((i, list(range(8)), p[:, 0].tolist(), p[:, 1].tolist(), q[:, 0].tolist(), q[:, 1].tolist()))
        kept = curves.simplify_sed(np.arange(8.0), p, 2.0)
        want.append((curves.discrete_frechet(p, q), curves.dtw(p, q), kept.tolist(), curves.certify(p, kept), curves.douglas_peucker(p, 2.0).tolist()))
    spark.createDataFrame(rows, "i int, t array<double>, px array<double>, py array<double>, qx array<double>, qy array<double>".replace("t array<double>", "t array<int>")).withColumn("t", F.col("t").cast("array<double>")).createOrReplaceTempView("pairs")
    pair = "px, py, qx, qy, "
    got = spark.sql(f"SELECT frechet_discrete({pair} 0D) a, dtw({pair} 0D) b, simplify_sed(t, px, py, 2D) c, certify_polyline(t, px, py, 2D) d, simplify_dp(t, px, py, 2D) e, frechet_decide({pair} 5.001D) f, frechet_decide({pair} 4.99D) g, "
                    f"frechet_distance({pair} 1e-6D) h, frechet_upper({pair} 1e-6D) u, hilbert_key(array(cast(i as bigint), 3L), 4) k, encode_segments(t, px, py) z FROM pairs ORDER BY i").collect()
    for i, (r, w) in enumerate(zip(got, want)):
        assert np.isclose(r.a, w[0]) and np.isclose(r.b, w[1]) and r.c == w[2] and np.isclose(r.d, w[3]) and r.e == w[4]
        assert r.f and not r.g and abs(r.h - 5) < 1e-4 and 5 <= r.u < 5.0001
        assert int.from_bytes(r.k, "big") == curves.hilbert_keys(np.array([[i, 3]]), 4)[0]
        assert np.allclose(codec.decode(bytes(r.z))[0].xy, np.column_stack((rows[i][2], rows[i][3])), atol=0.0051)
    assert spark.sql("SELECT i, s.* FROM pairs, LATERAL decode_segments(encode_segments(t, px, py)) s").count() == 6
    knots, control = [0.0, 0, 0, 0, 0.5, 1, 1, 1, 1], np.array([[0.0, 0], [1, 2], [2, -1], [3, 1], [4, 0]])
    got = spark.sql(f"SELECT * FROM bezier_segments(array({', '.join(f'{k}D' for k in knots)}), array({', '.join(f'{x}D' for x in control[:, 0])}), array({', '.join(f'{x}D' for x in control[:, 1])}), 3) ORDER BY piece").collect()
    pieces = splines.bezier_pieces(np.array(knots), control, 3)
    assert len(got) == 2 and all(np.allclose(np.column_stack((r.cx, r.cy)), p) for r, p in zip(got, pieces)) and len(names) == 12


def test_plt_reader(spark, tmp_path):
    folder = tmp_path / "000" / "Trajectory"
    folder.mkdir(parents=True)
    head = "\r\n".join(["header"] * 6)
    body = ["39.9,116.3,0,100,39000.1,2008-10-23,02:53:04", "39.8,116.4,0,100,39000.2,2008-10-23,02:53:04", "bad,116.4,0,100,39000.2,2008-10-23,02:53:05", "39.7,116.2,0", "39.7,116.2,0,1,2,2008-10-23,02:53:10", ""]
    (folder / "20081023.plt").write_text(head + "\r\n" + "\r\n".join(body))
    (folder / "empty.plt").write_text(head)
    got = S.read_plt(spark, f"file://{tmp_path}").orderBy("pos").collect()
    assert [(r["user"], r["stem"], r["lat"]) for r in got] == [("000", "20081023", 39.9), ("000", "20081023", 39.7)]
    assert (got[1]["ts"] - got[0]["ts"]).total_seconds() == 6


def test_tsv_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('1\tfirst "quoted text\nno tab here\n2\tsecond\n3\tthird\n')
    (tmp_path / "q.tsv").write_text("10\tquery one\n11\tquery two\n")
    (tmp_path / "r.tsv").write_text("10\t1\t1\n10\t2\t0\n11\t3\tx\n11\t3\t2\n")
    at = lambda n: f"file://{tmp_path}/{n}"
    assert sorted(map(tuple, S.read_collection(spark, at("c.tsv")).collect())) == [("1", 'first "quoted text'), ("2", "second"), ("3", "third")]
    assert S.read_collection(spark, at("c.tsv"), 2).count() == 2 and S.read_queries(spark, at("q.tsv")).count() == 2
    assert sorted(map(tuple, S.read_qrels(spark, at("r.tsv")).collect())) == [("10", "1", 1), ("11", "3", 2)]
    assert S.read_qrels(spark, at("r.tsv"), only_relevant=False).count() == 3


def test_kernels_run_in_all_tasks(spark):
    points = synth.tracks(spark, 24).select("track", "seq", "t", "x", "y")

    def where(r):
        from pyspark import TaskContext

        yield r.track, TaskContext.get().partitionId()

    got = store.map_rows(S.nested(points), where, "track long, part int").collect()
    assert len(got) == 24 and len({r["part"] for r in got}) > 1


def test_candidate_pairs_are_all_within_the_bound(spark):
    rng = np.random.default_rng(4)
    rows = [(i, j, float(j), float(x), float(y)) for i in range(60) for j, (x, y) in enumerate(rng.integers(-6, 7, (4, 2)) * (0 if i < 20 else 2.5))]
    p = spark.createDataFrame(rows, "track long, seq long, t double, x double, y double")
    s = tracks.summary(p)
    ends, box = tracks.bounds("l", "r")
    want = s.alias("l").crossJoin(s.alias("r")).where((F.col("l.track") != F.col("r.track")) & (F.greatest(ends, box) <= 5.0)).count()
    got = tracks.candidate_pairs(s, s, 5.0)
    assert got.count() == got.select("q", "c").distinct().count() == want > 400


def test_one_point_tracks_take_part(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 2.0, 0.0), (2, 1, 1.0, 2.0, 1.0), (3, 0, 0.0, 50.0, 0.0), (4, 0, 0.0, 0.0, 3.0), (4, 1, 1.0, 0.0, 3.0)]
    p = spark.createDataFrame(rows, "track long, seq long, t double, x double, y double")
    got = {(r["q"], r["c"]) for r in store.certified_range(p, p, 10.0, 1.0).where("hit").collect()}
    assert got == {(a, b) for a in (1, 2, 4) for b in (1, 2, 4) if a != b}


def test_reachability_and_pairs(spark):
    cells = spark.createDataFrame([(t, 1.0, m, ok, b) for t, m, ok, b in [(0, "a", True, 100), (0, "b", True, 50), (1, "a", True, 100), (1, "b", False, None), (2, "a", False, None), (2, "b", True, 70), (3, "a", False, None), (3, "b", False, None), (4, "a", True, 300), (4, "b", True, 300)]],
                                  "track long, sigma double, method string, reached boolean, bytes int")
    got = {r["method"]: (r["share"], r["bytes"]) for r in experiments.reachability(cells, ["sigma"]).collect()}
    assert got == {"a": (0.6, 500 / 3), "b": (0.6, 140.0)}
    r = experiments.pair_report(cells, ["sigma"], "a", "b").first()
    assert (r["both"], r["only_a"], r["only_b"], r["neither"], r["ratio"]) == (2, 1, 1, 1, 175 / 200)


def test_outcome_report(spark):
    rows = [(1, 2, 1.0, "p", o, t, n) for o, t, n in [("accept", True, True), ("reject_cheap", False, False), ("reject_interval", False, True), ("refine", True, False), ("refine", False, True)]]
    r = experiments.outcome_report(spark.createDataFrame(rows, "q long, c long, r double, rep string, outcome string, truth boolean, near boolean")).first()
    assert (r["total"], r["positive"], r["accept"], r["refine"], r["miss"], r["false_positive"]) == (5, 2, 1, 2, 0, 0)
    assert (r["near_miss_rate"], r["near_false_rate"], r["resolved"], r["resolved_after_bound"], r["refine_rate"]) == (0.5, 2 / 3, 0.6, 0.5, 0.4)


def test_error_rates_like_brute_force(spark):
    p = synth.tracks(spark, 8).select("track", "seq", "t", "x", "y").where("seq < 12")
    all_ = {r["track"]: store.xy(r["x"], r["y"]) for r in S.nested(p).collect()}
    near = {r["track"]: store.xy(r["lx"], r["ly"]) for r in store.simplified(p, 60.0).collect()}
    r, hits, claimed, miss, wrong = 250.0, 0, 0, 0, 0
    for a in all_:
        for b in all_:
            if a != b and max(np.hypot(*(all_[a][i] - all_[b][i])) for i in (0, -1)) <= r:
                t, n = frechet.decide(all_[a], all_[b], r), frechet.decide(near[a], near[b], r)
                hits, claimed, miss, wrong = hits + t, claimed + n, miss + (t and not n), wrong + (n and not t)
    got = sweeps.error_rates(sweeps.approximate_range(p, p, r, 60.0)).first()
    assert (got["hits"], got["claimed"]) == (hits, claimed) and hits
    assert np.isclose(got["miss_rate"], miss / hits) and (np.isclose(got["false_rate"], wrong / claimed) if claimed else True)


def test_chosen_and_sections(spark):
    sweep = spark.createDataFrame([(0.1, 0.9, 100, 5.0), (0.2, 0.87, 80, 4.0), (0.3, 0.86, 80, 3.0), (0.4, 0.5, 10, 1.0)], "lam double, share double, bytes int, seconds double")
    assert experiments.chosen(sweep, 0.1).first()["lam"] == 0.3
    text = experiments.with_section("# T\n\n## A\n\nold\n\n## B\n\nkeep\n", "A", "new")
    assert "old" not in text and text.index("new") < text.index("keep") and experiments.with_section(text, "C", "end").rstrip().endswith("end")
    assert experiments.with_section("", "A", "x").startswith("## A")


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "i int, s string")
    experiments.write_report(rows, f"file://{tmp_path}/c")
    experiments.write_report(rows, f"file://{tmp_path}/j", "json")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").first()["s"] == "a" and spark.read.json(f"file://{tmp_path}/j").count() == 1
    with pytest.raises(ValueError):
        experiments.write_report(rows, "x", "xml")


def test_points_and_samples(spark):
    assert V.key_limit(10, 12) == 2**120 - 1
    df = spark.createDataFrame([(1, [0, 1023]), (2, [0, 1024]), (3, [-1, 0]), (4, [1]), (5, None), (6, [None, 1])], "i int, p array<long>")
    assert {r["i"] for r in df.where(V.valid_point(F.col("p"), 10, 2)).collect()} == {1}
    rows = spark.range(100)
    a, b = (sorted(r["id"] for r in V.seeded_sample(d, "id", 10).collect()) for d in (rows, rows.repartition(7)))
    assert a == b and len(a) == 10 and a != sorted(r["id"] for r in V.seeded_sample(rows, "id", 10, 1).collect())
    assert tracks.worst(spark.createDataFrame([(i, float(i % 4)) for i in range(10)], "track long, error double"), 3).select("track").rdd.map(lambda r: r[0]).collect() == [3, 7, 2]


def test_streamed_sessions(spark, tmp_path):
    from curvespark.streaming import ingest

    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [(1, at(0)), (1, at(20)), (1, at(50)), (1, at(81)), (2, at(5)), (1, at(900)), (2, at(900))]
    spark.createDataFrame(rows, "track long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("track long, ts timestamp").parquet(f"{tmp_path}/events")
    q = ingest.gap_sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(100)
    got = sorted((r["track"], r["n"], (r["stop"] - r["start"]).total_seconds()) for r in spark.table("sessions").collect())
    # a gap of just the limit stays within; the last sessions are still open behind the watermark
    assert got == [(1, 1, 0.0), (1, 3, 50.0), (2, 1, 0.0)]


def test_streamed_batches_replace_themselves(spark, tmp_path):
    from curvespark.streaming import ingest

    for i in range(2):
        spark.range(10 * i, 10 * i + 10).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "4").parquet(f"{tmp_path}/in")
    ingest.append_vectors(stream, lambda b: b.select("id", (F.col("id") * 2).alias("key")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(100)
    first = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert first == list(range(20))
    ingest.append_vectors(stream, lambda b: b.select("id", (F.col("id") * 2).alias("key")), f"{tmp_path}/out", f"{tmp_path}/other").awaitTermination(100)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == first


def test_most_similar(spark):
    """Tiles leave the true best of ties and odd vectors, as cosine_batch ranks every pair; no vector is copied a pair."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 6))
    v[100:140], v[200:205] = v[0], v[0] * 2  # more equals than k, and equals but for rounding
    rows = [(i, x.tolist(), None if i == 7 else i % 3) for i, x in enumerate(v)]
    rows += [(300, None, 1), (301, [1.0, None, 0, 0, 0, 0], 1), (302, [float("nan")] * 6, 2), (303, [1.0], 2), (304, [0.0] * 6, 0), (305, v[0].tolist(), 0), (305, v[0].tolist(), 0)]
    df = spark.createDataFrame([(i, x and [None if y is None else float(y) for y in x], m) for i, x, m in rows], "id long, v array<double>, mark int").repartition(3)
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("mark").alias("q_mark"))
    pairs = V.against_all(df, q, "id").where("id <> query_id").withColumn("sim", F.round(V.cosine_batch(F.col("q"), F.col("v")), 6))
    names = ("query_id", "rank", "id", "sim", "mark", "q_mark")
    told = lambda x: sorted(tuple(map(str, r)) for r in x.select(*names[:4], *[F.col(c).cast("int") for c in names[4:]]).collect())
    for k in (4, 400):
        assert told(V.most_similar(df, q, k)) == told(V.ranked(pairs, "query_id", "sim", "id", k))


def test_certificates_of_many(spark):
    """Fits certified in lockstep are as one by one, and copies of a track share one result."""
    rng = np.random.default_rng(5)
    tracks_ = [(np.sort(rng.uniform(0, 9, n)), rng.normal(size=(n, 2)).cumsum(axis=0) * 40) for n in (2, 5, 30, 31, 12)]
    got = experiments.certified_fits(tracks_, 50.0, 10.0, 5.0)
    for (t, p), (status, eps, true, margin, levels) in zip(tracks_, got):
        f = fits.fit(t, p, 50.0)
        assert status == "pass" and eps == splines.certify_spline(p, f.knots, f.control, f.degree, 10.0, 1e-3)[1]
        line = splines.linearise(splines.bezier_pieces(f.knots, f.control, f.degree), 5.0, levels)[0]
        assert true == frechet.distance_many([p], [line], 1e-3)[0] and margin == eps - true
    rows = [(10 * copy + i, j, float(t[j]), float(p[j, 0]), float(p[j, 1])) for copy in range(3) for i, (t, p) in enumerate(tracks_) for j in range(len(t))]
    rows += [(90, 0, 0.0, 1.0, 1.0), (91, 0, 0.0, 0.0, 0.0), (91, 1, 0.0, 1.0, 1.0)]  # one point; time that stands
    table = experiments.certificates(spark.createDataFrame(rows, "track long, seq long, t double, x double, y double"), 50.0, 10.0, 5.0)
    assert {r["track"]: tuple(r)[1:] for r in table.collect()} == {10 * copy + i: x for copy in range(3) for i, x in enumerate(got)}


def test_bounds_round_as_sql_states_them(spark):
    """At a radius' edge the root of the sum of squares decides, as in the SQL; hypot rounds some of these up, over the radius."""
    import math

    rng = np.random.default_rng(11)
    dx = np.round(rng.uniform(50, 190, 200_000), 2)
    dy = np.sqrt(200.0**2 - dx * dx)
    edge = [(float(x), float(y)) for x, y in zip(dx, dy) if math.sqrt(x * x + y * y) <= 200 < math.hypot(x, y)][:50]
    assert len(edge) > 10
    names = ("track", "x0", "y0", "xn", "yn", "xmin", "xmax", "ymin", "ymax")
    frame = lambda rows: spark.createDataFrame([(i, x, y, x, y, x, x, y, y) for i, x, y in rows], ", ".join(f"{n} {'long' if n == 'track' else 'double'}" for n in names))
    got = tracks.candidate_pairs(frame([(-1, 0.0, 0.0)]), frame([(i, *p) for i, p in enumerate(edge)]), 200.0).collect()
    assert {r["c"]: r["lb"] for r in got} == {i: math.sqrt(x * x + y * y) for i, (x, y) in enumerate(edge)}
