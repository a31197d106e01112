"""From documents to packed sequences: language ID, quality rules, near-duplicates, packing.

run() writes each stage's rows as Parquet to the shared folder and reads them back for the next one.

Verdicts go back to rows by id and text, so each text of a repeated id has its own verdict. Rows without an id are
judged as others are and link with nothing, so no near-duplicate stage drops them; of rows of equal id and text one is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvespark.llm import common, language, neardup, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose predicted language is a learned one; 'und' texts go. lang becomes the prediction."""
    common.text_batches(spark)
    langs, log_p = language.train(docs.where(F.coalesce(common.crc_mod("doc_id", 4) != 2, F.lit(False))))
    schema = "doc_id long, text string, source string, n_chars long, lang_pred string, score double, n_langs int"
    got = docs.select("doc_id", "text", "source", "n_chars").mapInPandas(language.predictor(langs, log_p, ["doc_id", "text", "source", "n_chars"]), schema)
    return got.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """docs with row_key: equal for rows of equal id and text (and more), null being a value of its own."""
    text = lambda c: F.coalesce(c, F.lit("-"))
    return docs.withColumn("row_key", F.concat_ws("|", text(F.col("doc_id").cast("string")), text(F.md5("text")), *more))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that pass the base rules and their stratum's certified cutoffs, with or without an id."""
    docs = keyed(docs, "lang")
    verdict = quality.judged(docs, common.table(spark, sf_dir, "labels"), named=("row_key",))
    return docs.join(verdict.where("kept").select("row_key").distinct(), "row_key", "left_semi").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, one of its smallest doc_id; one row of equal id and text where
    there are no words; every row without an id."""
    docs = keyed(docs)
    named = docs.where("doc_id IS NOT NULL")
    told = neardup.linked(named, shingle_words=5, percent=80, named=("row_key",))
    first = told.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "row_key")).alias("k")).select("k.row_key")
    kept = first.union(told.where("comp IS NULL").select("row_key").distinct())
    return named.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 ids; the workers also hold what other stages keep, so the encoders' caches are small."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=100_000)


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
