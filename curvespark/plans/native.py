"""Queries of the native operators on the test tables, each with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespark.operators import tracks as T
from curvespark.operators import vectors as V
from curvespark.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

PTS = """e AS (SELECT user_id AS track, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, value FROM events),
f AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY us) - 1 AS seq, (us - min(us) OVER (PARTITION BY track)) / 1e6 AS t, k, value FROM e),
p AS (SELECT track, seq, t, sum(k - 49.5) OVER w AS x, sum(value - 20) OVER w AS y FROM f WINDOW w AS (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
GAP, SPEED = 43200.0, 0.02


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, d: str) -> DataFrame:
    return S.walk_tracks(S.table(spark, d, "events"))


def flat(spark: SparkSession, d: str) -> DataFrame:
    return S.event_points(S.table(spark, d, "events"))


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def vec(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "embeddings").select("vec_id", V.doubles("embedding").alias("v"), "label")


def cosine_pairs(spark, d):
    e = vec(spark, d)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_label"))
    return V.against_all(e, q, "vec_id").where("vec_id <> query_id")


E_SQL = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
TOP = f"""{E_SQL}, s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.v, c.v) / ((sqrt(list_inner_product(q.v, q.v)) + 1e-10) * (sqrt(list_inner_product(c.v, c.v)) + 1e-10)), 6) AS sim,
  q.label AS q_label, c.label FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 10)"""


def top10(spark, d):
    e = vec(spark, d)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_mark"))
    best = V.most_similar(e.select(F.col("vec_id").alias("id"), "v", F.col("label").alias("mark")), q, 10)
    return best.select("query_id", F.col("id").alias("vec_id"), F.col("mark").cast("int").alias("label"), F.col("q_mark").cast("int").alias("q_label"), "sim", "rank")


@query(f"WITH {TOP} SELECT query_id, rank, vec_id, sim FROM top")
def cosine_topk(spark, d):
    return top10(spark, d).select("query_id", "rank", "vec_id", "sim")


@query(f"WITH {TOP} SELECT query_id, count(*) FILTER (label = q_label) / 10.0 AS precision, coalesce(1.0 / min(rank) FILTER (label = q_label), 0) AS rr FROM top GROUP BY 1")
def precision_and_rr(spark, d):
    same = F.col("label") == F.col("q_label")
    return top10(spark, d).groupBy("query_id").agg((F.count_if(same) / 10.0).alias("precision"), F.coalesce(1.0 / F.min(F.when(same, F.col("rank"))), F.lit(0.0)).alias("rr"))


REL = "rel AS (SELECT q.vec_id AS query_id, c.vec_id AS item FROM e q JOIN e c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)"


def judged(spark, d):
    e = vec(spark, d)
    rel = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("item"), "label"), "label").where("query_id <> item").select("query_id", "item")
    return V.retrieval(top10(spark, d).withColumnRenamed("vec_id", "item"), rel, 10)


@query(f"WITH {TOP}, {REL} SELECT r.query_id, round(count(t.vec_id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM rel r LEFT JOIN top t ON t.query_id = r.query_id AND t.vec_id = r.item GROUP BY 1")
def recall_at_k(spark, d):
    return judged(spark, d).select("query_id", r6("recall").alias("recall"))


@query(f"WITH {TOP}, {REL} SELECT r.query_id, round(coalesce(1.0 / min(t.rank), 0), 6) AS rr FROM rel r LEFT JOIN top t ON t.query_id = r.query_id AND t.vec_id = r.item GROUP BY 1")
def mrr_at_k(spark, d):
    return judged(spark, d).select("query_id", r6("rr").alias("rr"))


ADJ = f"""{E_SQL}, z AS (SELECT vec_id, v FROM e UNION ALL SELECT -1, list_transform(v, lambda x: 0.0::DOUBLE) FROM e WHERE vec_id = 0),
a AS (SELECT l.vec_id, l.v AS a, r.v AS b FROM z l JOIN z r ON r.vec_id = l.vec_id + 1)"""


def adjacent(spark, d):
    e = vec(spark, d)
    z = e.select("vec_id", "v").unionByName(e.where("vec_id = 0").select(F.lit(-1).cast("long").alias("vec_id"), F.transform("v", lambda x: F.lit(0.0)).alias("v")))
    return z.select("vec_id", F.col("v").alias("a")).join(z.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


@query(f"WITH {ADJ} SELECT vec_id, round(CASE WHEN sqrt(list_inner_product(a, a)) < 1e-10 OR sqrt(list_inner_product(b, b)) < 1e-10 THEN 0 ELSE list_cosine_similarity(a, b) END, 6) AS sim FROM a")
def cosine_sim(spark, d):
    return adjacent(spark, d).select("vec_id", r6(V.cosine(F.col("a"), F.col("b"))).alias("sim"))


@query(f"WITH {ADJ} SELECT vec_id, round(CASE WHEN list_inner_product(a, a) = 0 OR list_inner_product(b, b) = 0 THEN 2 ELSE 1 - list_cosine_similarity(a, b) END, 6) AS dist, round(list_distance(a, b), 6) AS l2 FROM a")
def cosine_distance(spark, d):
    return adjacent(spark, d).select("vec_id", r6(V.cosine_distance(F.col("a"), F.col("b"))).alias("dist"), r6(V.l2(F.col("a"), F.col("b"))).alias("l2"))


@query(f"WITH {E_SQL} SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.v, b.v), 6) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0")
def pairwise_l2(spark, d):
    """Distances of the stated query rows to every other row."""
    return cosine_pairs(spark, d).select(F.col("query_id").alias("i"), F.col("vec_id").alias("j"), r6(V.l2(F.col("q"), F.col("v"))).alias("dist"))


@query(f"WITH {E_SQL} SELECT query_id, rank, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id, round(list_distance(q.v, c.v), 6) AS dist FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 30")
def l2_topk(spark, d):
    return V.ranked(cosine_pairs(spark, d).select("query_id", "vec_id", r6(V.l2(F.col("q"), F.col("v"))).alias("dist")), "query_id", "dist", "vec_id", 30, False).select("query_id", "rank", "vec_id", "dist")


DIM = f"{E_SQL}, u AS (SELECT vec_id, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e), m AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM u GROUP BY 1)"


@query(f"WITH {DIM} SELECT CAST(dim AS INTEGER) AS dim, lo, hi FROM m")
def dim_minmax(spark, d):
    return V.dimension_ranges(vec(spark, d), "v")


@query(f"WITH {DIM} SELECT vec_id, CAST(dim AS INTEGER) AS dim, CAST(trunc(greatest(0, least(1023, (x - lo) / (hi - lo) * 1023))) AS BIGINT) AS g FROM u JOIN m USING (dim)")
def minmax_quantize(spark, d):
    e = vec(spark, d)
    u = e.select("vec_id", F.posexplode("v").alias("dim", "x"))
    return u.join(V.dimension_ranges(e, "v"), "dim").select("vec_id", "dim", V.to_grid(F.col("x"), F.col("lo"), F.col("hi"), 10).alias("g"))


KV = "kv AS (SELECT doc_id, (doc_id * 2654435761) % 65536 AS hkey, lang FROM documents), l AS (SELECT hkey, max(doc_id) AS doc_id FROM kv GROUP BY 1)"


def kv(spark, d):
    return V.last_wins(S.table(spark, d, "documents").select("doc_id", ((F.col("doc_id") * 2654435761) % 65536).alias("hkey")), "hkey", "doc_id").select("hkey", "doc_id")


@query(f"WITH {KV} SELECT hkey, doc_id FROM l")
def kv_upsert(spark, d):
    return kv(spark, d)


@query(f"WITH {KV} SELECT hkey, doc_id FROM l WHERE hkey = (3 * 2654435761) % 65536")
def kv_get(spark, d):
    return kv(spark, d).where(F.col("hkey") == 3 * 2654435761 % 65536)


@query(f"WITH {KV} SELECT hkey, doc_id FROM l WHERE hkey BETWEEN 1000 AND 30000 ORDER BY hkey LIMIT 100")
def kv_range_scan(spark, d):
    return V.range_scan(kv(spark, d), "hkey", 1000, 30000, 100)


@query(f"WITH {KV} SELECT hkey, doc_id FROM l WHERE hkey NOT IN (SELECT hkey FROM l WHERE hkey % 5 = 0)")
def kv_delete(spark, d):
    rows = kv(spark, d)
    return rows.join(rows.where("hkey % 5 = 0").select("hkey"), "hkey", "left_anti")


@query(f"WITH {KV} SELECT count(*) AS n FROM l")
def kv_count(spark, d):
    return kv(spark, d).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality > 0)")
def qrels_semi(spark, d):
    return S.table(spark, d, "documents").join(S.table(spark, d, "labels").where("quality > 0"), "doc_id", "left_semi").select("doc_id")


@query(f"WITH {KV}, q AS (SELECT doc_id AS query_id, hkey AS qkey FROM l WHERE doc_id % 50 = 0) SELECT query_id, l.doc_id, qkey, hkey FROM q JOIN l ON hkey BETWEEN greatest(0, qkey - 500) AND least(65535, qkey + 500)")
def hilbert_range_join(spark, d):
    rows = kv(spark, d)
    return V.range_join(rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("hkey").alias("qkey")), rows, 500, 65535)


@query(f"WITH {KV} SELECT doc_id, greatest(0, hkey - 500) AS lo, least(65535, hkey + 500) AS hi FROM l")
def compute_range(spark, d):
    return kv(spark, d).select("doc_id", F.greatest(F.lit(0), F.col("hkey") - 500).alias("lo"), F.least(F.lit(65535), F.col("hkey") + 500).alias("hi"))


@query(f"""WITH {PTS}, g AS (SELECT track, seq, 39.4 + 2.2 * k / 100 AS lat, 115.7 + 1.8 * value / 600 AS lon FROM f),
c AS (SELECT avg(a) AS lat0, avg(b) AS lon0 FROM (SELECT avg(lat) AS a, avg(lon) AS b FROM g GROUP BY track))
SELECT track, seq, round(6371000 * radians(lon - lon0) * cos(radians(lat0)), 2) AS x, round(6371000 * radians(lat - lat0), 2) AS y FROM g, c""")
def proj_equirect(spark, d):
    g = flat(spark, d).withColumn("lat", 39.4 + 2.2 * F.col("k") / 100).withColumn("lon", 115.7 + 1.8 * F.col("value") / 600)
    return T.project(g).select("track", "seq", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("SELECT user_id, epoch_us(ts) AS us, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedup_first(spark, d):
    e = S.table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return S.first_wins(e.unionByName(e.withColumn("event_id", F.col("event_id") + 1_000_000_000)), ["user_id", "us"], "event_id")


BRK = f"""{PTS}, s AS (SELECT *, t - lag(t) OVER w AS dt, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS st FROM p WINDOW w AS (PARTITION BY track ORDER BY seq)),
b AS (SELECT *, coalesce(dt > {GAP} OR dt <= 0 OR st > dt * {SPEED}, FALSE) AS brk FROM s)"""


@query(f"WITH {BRK} SELECT track, seq, brk FROM b")
def segment_breaks(spark, d):
    return T.breaks(points(spark, d), GAP, SPEED).select("track", "seq", "brk")


SEG = f"{BRK}, g AS (SELECT *, CAST(sum(CAST(brk AS BIGINT)) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM b)"


@query(f"WITH {SEG} SELECT track, seq, seg, round(t - min(t) OVER (PARTITION BY track, seg), 6) AS seg_t FROM g")
def sessionize(spark, d):
    return T.segments(points(spark, d), GAP, SPEED).select("track", "seq", "seg", r6("seg_t").alias("seg_t"))


@query(f"WITH {SEG} SELECT track, seg, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def drop_singletons(spark, d):
    return T.segments(points(spark, d), GAP, SPEED).groupBy("track", "seg").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {SEG} SELECT track, seg, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 20")
def filter_length(spark, d):
    return T.length_filter(T.segments(points(spark, d), GAP, SPEED), ["track", "seg"], 3, 20).groupBy("track", "seg").agg(F.count("*").alias("n"))


@query(f"WITH {SEG}, c AS (SELECT track, seg, count(*) AS n FROM g GROUP BY 1, 2) SELECT count(DISTINCT track) AS tracks, CAST(sum(n) AS BIGINT) AS points, count(*) AS segments, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1 AND n NOT BETWEEN 3 AND 20) AS length_drops FROM c")
def clean_stats(spark, d):
    c = T.segments(points(spark, d), GAP, SPEED).groupBy("track", "seg").agg(F.count("*").alias("n"))
    return c.agg(F.count_distinct("track").alias("tracks"), F.sum("n").alias("points"), F.count("*").alias("segments"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if((F.col("n") > 1) & ~F.col("n").between(3, 20)).alias("length_drops"))


@query(f"""WITH {PTS}, i AS (SELECT track, seq, k BETWEEN 20 AND 80 AND value < 60 AS a FROM f), j AS (SELECT *, a AND NOT coalesce(lag(a) OVER (PARTITION BY track ORDER BY seq), FALSE) AS s FROM i),
k2 AS (SELECT *, sum(CAST(s AS BIGINT)) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS island FROM j) SELECT track, seq, CAST(island AS BIGINT) AS island FROM k2 WHERE a""")
def bbox_split(spark, d):
    return T.islands(flat(spark, d), F.col("k").between(20, 80) & (F.col("value") < 60)).select("track", "seq", "island")


@query(f"WITH {PTS}, s AS (SELECT track, t, t - lag(t) OVER (PARTITION BY track ORDER BY seq) AS dt FROM p) SELECT track, count(*) AS n, round(max(t) - min(t), 6) AS span, round(min(dt), 6) AS min_dt, count(*) > 2 AND (max(t) - min(t) <= 0 OR coalesce(min(dt) < 0, FALSE)) AS bad FROM s GROUP BY 1")
def validate_time(spark, d):
    return T.time_problems(points(spark, d)).select("track", "n", r6("span").alias("span"), r6("min_dt").alias("min_dt"), "bad")


@query(f"""WITH {PTS}, s AS (SELECT *, CASE WHEN seq = 0 THEN 0 ELSE greatest(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 1e-6) END AS st FROM p WINDOW w AS (PARTITION BY track ORDER BY seq))
SELECT track, seq, round(sum(st) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) / sum(st) OVER (PARTITION BY track), 6) AS u FROM s""")
def param_u(spark, d):
    return T.chord_parameter(points(spark, d)).select("track", "seq", r6("u").alias("u"))


@query(f"""WITH {PTS}, s AS (SELECT *, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, lag(x) OVER w AS x0, lead(x) OVER w AS x1 FROM p WINDOW w AS (PARTITION BY track ORDER BY seq))
SELECT track, seq, round(CASE WHEN a IS NULL THEN (x1 - x) / b WHEN b IS NULL THEN (x - x0) / a ELSE (a * a * x1 + (b * b - a * a) * x - b * b * x0) / (a * b * (a + b)) END, 6) AS vx FROM s""")
def gradient(spark, d):
    return T.gradient(points(spark, d), "x", "vx").select("track", "seq", r6("vx").alias("vx"))


@query(f"WITH {PTS}, q AS (SELECT track, seq, CAST(round_even(round(x, 6) * 100, 0) AS BIGINT) AS q FROM p) SELECT track, seq, q, q - coalesce(lag(q) OVER (PARTITION BY track ORDER BY seq), 0) AS dq, q AS back FROM q")
def delta_codec(spark, d):
    q = points(spark, d).withColumn("q", T.quantised(r6("x")))
    return T.undeltas(T.deltas(q, "q", "dq"), "dq", "back").select("track", "seq", "q", "dq", "back")


@query(f"""WITH {PTS}, k2 AS (SELECT * , lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WHERE seq % 5 = 0 WINDOW w AS (PARTITION BY track ORDER BY seq))
SELECT p.track, p.seq, round(CASE WHEN k2.t1 IS NULL THEN k2.x ELSE k2.x + (p.t - k2.t) / (k2.t1 - k2.t) * (k2.x1 - k2.x) END, 6) AS ix, round((k2.x1 - k2.x) / (k2.t1 - k2.t), 6) AS vx
FROM p ASOF JOIN k2 ON p.track = k2.track AND p.t >= k2.t""")
def interp_reconstruct(spark, d):
    return T.interpolated(points(spark, d), F.col("seq") % 5 == 0).select("track", "seq", r6("ix").alias("ix"), r6("vx").alias("vx"))


@query(f"""WITH {PTS}, c AS (SELECT *, first_value(t) OVER w AS t0, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, last_value(t) OVER w AS t1, last_value(x) OVER w AS x1, last_value(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, (t - t0) / (t1 - t0) AS g, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) AS dt2, (x1 - x0) ** 2 + (y1 - y0) ** 2 AS n2 FROM c),
h AS (SELECT *, least(greatest(dt2 / n2, 0), 1) AS fr, dt2 / sqrt(n2) AS s FROM m)
SELECT track, seq, round(sqrt((x - x0 - g * (x1 - x0)) ** 2 + (y - y0 - g * (y1 - y0)) ** 2), 6) AS sed, round(sqrt((x - x0 - fr * (x1 - x0)) ** 2 + (y - y0 - fr * (y1 - y0)) ** 2), 6) AS dist,
round(s, 6) AS s, round((max(s) OVER (PARTITION BY track ORDER BY seq ROWS UNBOUNDED PRECEDING) - s) / 2, 6) AS back FROM h""")
def chord_measures(spark, d):
    return T.chord_measures(points(spark, d)).select("track", "seq", *[r6(c).alias(c) for c in ("sed", "dist", "s", "back")])


STATS = f"""{PTS}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS st, t - lag(t) OVER w AS dt FROM p WINDOW w AS (PARTITION BY track ORDER BY seq)),
u AS (SELECT track, count(*) AS n, sum(st) AS length, min(dt) AS dt_min, max(dt) AS dt_max, stddev_pop(dt) AS dt_std, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax,
arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS xn, arg_max(y, seq) AS yn FROM s GROUP BY 1)"""


@query(f"WITH {STATS} SELECT track, n, round(length, 4) AS length, round(dt_min, 4) AS dt_min, round(dt_max, 4) AS dt_max, round(dt_std, 4) AS dt_std, round(sqrt((xmax - xmin) ** 2 + (ymax - ymin) ** 2), 4) AS diag FROM u")
def track_stats(spark, d):
    return T.summary(points(spark, d)).select("track", "n", *[F.round(c, 4).alias(c) for c in ("length", "dt_min", "dt_max", "dt_std", "diag")])


@query(f"WITH {STATS} SELECT round(corr(log10(1 + sqrt((xmax - xmin) ** 2 + (ymax - ymin) ** 2)), length), 6) AS c_len, round(corr(log10(1 + sqrt((xmax - xmin) ** 2 + (ymax - ymin) ** 2)), n), 6) AS c_n FROM u")
def corr_factors(spark, d):
    s = T.summary(points(spark, d)).withColumn("lg", F.log10(1 + F.col("diag")))
    return s.agg(r6(F.corr("lg", "length")).alias("c_len"), r6(F.corr("lg", F.col("n").cast("double"))).alias("c_n"))


LB = f"""{STATS}, b AS (SELECT q.track AS q, c.track AS c, greatest(sqrt((q.x0 - c.x0) ** 2 + (q.y0 - c.y0) ** 2), sqrt((q.xn - c.xn) ** 2 + (q.yn - c.yn) ** 2)) AS ends,
sqrt(greatest(q.xmin - c.xmax, c.xmin - q.xmax, 0) ** 2 + greatest(q.ymin - c.ymax, c.ymin - q.ymax, 0) ** 2) AS box FROM u q JOIN u c ON q.track <> c.track)"""


@query(f"WITH {LB} SELECT q, c, round(greatest(ends, box), 6) AS lb FROM b WHERE greatest(ends, box) <= 200")
def cheap_lb(spark, d):
    s = T.summary(points(spark, d))
    return T.candidate_pairs(s, s, 200.0).select("q", "c", r6("lb").alias("lb"))


@query(f"WITH {LB} SELECT 200 AS r, count(*) AS pairs, count(*) FILTER (greatest(ends, box) > 200) AS reject_cheap FROM b")
def reject_cheap(spark, d):
    s = T.summary(points(spark, d))
    left = T.candidate_pairs(s, s, 200.0).agg(F.count("*").alias("kept"))
    return s.agg(F.count("*").alias("n")).crossJoin(left).select(F.lit(200).alias("r"), (F.col("n") * (F.col("n") - 1)).alias("pairs"), (F.col("n") * (F.col("n") - 1) - F.col("kept")).alias("reject_cheap"))


@query(f"""WITH {PTS} SELECT track, seq, round(x, 6) AS x, round(y, 6) AS y, FALSE AS copy FROM p UNION ALL SELECT -track - 1, seq, round(x + 3 * (track % 7 + 1), 6), round(y + 4 * (track % 7 + 1), 6), TRUE FROM p""")
def corpus_union(spark, d):
    p = points(spark, d).select("track", "seq", "x", "y")
    m = F.col("track") % 7 + 1
    copy = p.select((-F.col("track") - 1).alias("track"), "seq", (F.col("x") + 3 * m).alias("x"), (F.col("y") + 4 * m).alias("y"), F.lit(True).alias("copy"))
    return p.withColumn("copy", F.lit(False)).unionByName(copy).select("track", "seq", r6("x").alias("x"), r6("y").alias("y"), "copy")


@query(f"WITH {PTS}, s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY track ORDER BY seq)) SELECT track, seq, CAST(i AS INTEGER) AS i, round(x + i / 4.0 * (x1 - x), 6) AS x, round(y + i / 4.0 * (y1 - y), 6) AS y FROM s, range(4) r(i) WHERE x1 IS NOT NULL")
def densify(spark, d):
    p = points(spark, d).withColumn("x1", F.lead("x").over(T.by_seq())).withColumn("y1", F.lead("y").over(T.by_seq())).where("x1 IS NOT NULL")
    return p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("track", "seq", "i", *[r6(F.col(c) + F.col("i") / 4.0 * (F.col(f"{c}1") - F.col(c))).alias(c) for c in ("x", "y")])


@query(f"""WITH {PTS}, k2 AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM p WHERE seq % 5 = 0 WINDOW w AS (PARTITION BY track ORDER BY seq)),
r AS (SELECT p.track, p.x - CASE WHEN k2.t1 IS NULL THEN k2.x ELSE k2.x + (p.t - k2.t) / (k2.t1 - k2.t) * (k2.x1 - k2.x) END AS e FROM p ASOF JOIN k2 ON p.track = k2.track AND p.t >= k2.t)
SELECT track, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS med, round(max(abs(e)), 6) AS worst FROM r GROUP BY 1""")
def rmse_errors(spark, d):
    e = T.interpolated(points(spark, d), F.col("seq") % 5 == 0).withColumn("e", F.col("x") - F.col("ix"))
    return e.groupBy("track").agg(r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), r6(F.percentile(F.abs("e"), 0.5)).alias("med"), r6(F.max(F.abs("e"))).alias("worst"))
