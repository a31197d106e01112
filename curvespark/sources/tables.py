"""Readers: tracks from event rows, PLT point files, and tab-separated collections, queries and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share (spark.checkpoint.dir). A temporary one only where none is named and all runs on one machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def event_points(events: DataFrame) -> DataFrame:
    """Flat points of each user: (track, seq, t seconds since the first event, k, value)."""
    w = W.partitionBy("track").orderBy("us")
    e = events.select(F.col("user_id").alias("track"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"), "value")
    return e.select("track", (F.row_number().over(w) - 1).cast("long").alias("seq"), ((F.col("us") - F.min("us").over(W.partitionBy("track"))) / F.lit(1e6)).alias("t"), "k", "value")


def walk_tracks(events: DataFrame) -> DataFrame:
    """Curve-like tracks: cumulative sums of the centred event values, (track, seq, t, x, y)."""
    w = W.partitionBy("track").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return event_points(events).select("track", "seq", "t", F.sum(F.col("k") - 49.5).over(w).alias("x"), F.sum(F.col("value") - 20).over(w).alias("y"))


def nested(points: DataFrame) -> DataFrame:
    """One row a track: arrays t, x, y in point order."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "t", "x", "y")))
    return points.groupBy("track").agg(rows.alias("p")).select("track", F.col("p.t").alias("t"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def read_plt(spark: SparkSession, root: str, header_lines: int = 6) -> DataFrame:
    """PLT point files root/user/Trajectory/stem.plt; malformed rows go, the first row of a timestamp stays."""
    lines = spark.read.text(f"{root}/*/Trajectory/*.plt", wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    part = F.split("line", ",")
    rows = lines.where((F.col("pos") >= header_lines) & (F.size(part) >= 7)).select(
        F.regexp_extract("path", r"([^/]+)/Trajectory/[^/]+\.plt$", 1).alias("user"), F.regexp_extract("path", r"([^/]+)\.plt$", 1).alias("stem"), "pos",
        F.get(part, 0).try_cast("double").alias("lat"), F.get(part, 1).try_cast("double").alias("lon"), F.concat_ws(" ", F.trim(F.get(part, 5)), F.trim(F.get(part, 6))).alias("stamp"))
    rows = rows.withColumn("ts", F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss"))).where("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL")
    return first_wins(rows, ["user", "stem", "stamp"], "pos").drop("stamp")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def read_collection(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.csv(path, sep="\t", schema="doc_id string, text string", quote="", mode="DROPMALFORMED").where("text IS NOT NULL")
    return df.limit(limit) if limit else df


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="query_id string, text string", quote="", mode="DROPMALFORMED").where("text IS NOT NULL")


def read_qrels(spark: SparkSession, path: str, only_relevant: bool = True) -> DataFrame:
    df = spark.read.csv(path, sep="\t", schema="query_id string, doc_id string, relevance int", mode="DROPMALFORMED").where("relevance IS NOT NULL")
    return df.where("relevance > 0") if only_relevant else df
