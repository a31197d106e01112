"""Quality rules with risk-controlled thresholds, native Spark only.

Per text (null: none): words, code points in words, symbols, duplicate lines and repeated 3-word windows.
A stratum is a language. For every stratum and rule a grid of cutoffs is tested on labelled holdouts: the
null hypothesis "this cutoff rejects over alpha of the good documents" falls when the exact binomial tail
P(X <= k | n, alpha) is at most delta / (strata * rules * grid) (Bonferroni). Each rule takes its strictest
certified cutoff; a stratum without one rejects nothing. The guarantee is per rule and stratum; alpha is
split over the rules, so the union of the rules stays under alpha as well.
Repeated documents and labels count once each as they stand; a null label or id takes no part in the fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GAP = r"[\x20\x09-\x0D]+"
#: Rules: share of symbols, of duplicate lines and of repeated words, in hundredths; cutoffs tried.
RULES, GRID = ("symbols", "dup_lines", "repeats", "caps"), (1, 2, 5, 10, 15, 20, 30, 40, 50, 75, 100)
#: A stratum needs so many labelled good documents for any cutoff to pass; this also bounds the cutoff table.
TAIL_TERMS = 20_000


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_caps (long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    out = docs.withColumn("_t", text).withColumn("_w", F.array_remove(F.split("_t", GAP), "")).withColumn("_l", lines)
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.octet_length("_t") - F.octet_length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long"))
    out = out.withColumn("n_caps", (F.octet_length("_t") - F.octet_length(F.regexp_replace("_t", r"[A-Z]", ""))).cast("long"))
    out = out.withColumn("n_lines", F.size("_l").cast("long")).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    window = lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))
    out = out.withColumn("_s", F.when(F.col("n_words") >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), window))))
    same = lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"])
    out = out.withColumn("_r", F.filter("_s", lambda x, i: F.coalesce(same(x, i), F.lit(False))))
    covered = F.array_distinct(F.flatten(F.transform("_r", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return out.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).withColumn(
        "n_repeat_words", F.when(F.col("n_words") >= 3, F.col("n_repeat_words")).otherwise(F.lit(0).cast("long"))).drop("_t", "_w", "_l", "_s", "_r")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _shares() -> Column:
    """The rules' measures in hundredths."""
    part = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return F.array(part("n_symbols", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"), part("n_caps", "word_chars"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x), x > 0: Stirling's series at x + 8 and the recurrence back."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - F.ln(x * (x + 1) * (x + 2) * (x + 3)) - F.ln((x + 4) * (x + 5) * (x + 6) * (x + 7))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed downwards from k; what is left out after TAIL_TERMS is bounded from above."""
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p)))
    terms = F.sequence(F.lit(0), F.least(k, F.lit(float(TAIL_TERMS))).cast("int"))
    step = lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("t"))
    end = F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), first.alias("t")), step)
    rest = F.when(k > TAIL_TERMS, end["t"] * F.greatest(n * p / F.greatest(n * p - k, F.lit(1e-9)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), end["s"] + rest))


def cutoffs(labelled: DataFrame, alpha: float, delta: float, strata: Column | None = None) -> DataFrame:
    """(stratum, cuts array): labelled has stratum, good and shares; a rule rejects where its share is over its cutoff."""
    rows = labelled.where("good").select("stratum", F.posexplode("shares").alias("rule", "share"))
    grid = F.array(*[F.lit(float(g)) for g in GRID])
    counts = rows.groupBy("stratum", "rule").agg(F.count("*").alias("n"), *[F.count_if(F.col("share") > g).alias(f"k{g}") for g in GRID])
    total = counts.agg(F.count_distinct("stratum").alias("strata"))
    tests = counts.join(F.broadcast(total)).select("stratum", "rule", "n", "strata", F.posexplode(F.array(*[F.col(f"k{g}") for g in GRID])).alias("g", "k"))
    level = F.lit(delta) / (F.col("strata") * len(RULES) * len(GRID))
    passed = tests.where(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= level)
    best = passed.groupBy("stratum", "rule").agg(F.min(F.get(grid, F.col("g"))).alias("cut"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))


def judged(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, text_col: str = "text", stratum_col: str = "lang", named: tuple = ()) -> DataFrame:
    """docs' ids and columns named with measures, base_failed and kept. One pass over the texts; the fit reads the measures only."""
    d = measured(docs.select("doc_id", F.coalesce(F.col(stratum_col).cast("string"), F.lit("?")).alias("stratum"), F.col(text_col).alias("text"), *named), "text").drop("text")
    d = common.cut(d.withColumn("base_failed", base_failed()).withColumn("shares", _shares()))
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = d.where(~F.col("base_failed")).join(marks, "doc_id").select("stratum", "shares", (F.col("quality") == 1).alias("good"))
    cuts = cutoffs(labelled, alpha, delta)  # at most a row a stratum; how it is joined is left to its measured size
    over = F.exists(F.map_entries("cuts"), lambda e: F.get("shares", e["key"]) > e["value"])
    return d.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).drop("cuts", "shares")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w WHERE len(w) >= 3),
u AS (SELECT doc_id, unnest(g) AS g, unnest(range(len(g))) AS i FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM u) CROSS JOIN range(3) AS o(j) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_caps, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  [CASE WHEN word_chars > 0 THEN 100.0::DOUBLE * n_symbols / word_chars ELSE 0 END, CASE WHEN n_lines > 0 THEN 100.0::DOUBLE * n_dup_lines / n_lines ELSE 0 END,
   CASE WHEN n_words > 0 THEN 100.0::DOUBLE * n_repeat_words / n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN 100.0::DOUBLE * n_caps / word_chars ELSE 0 END] AS s FROM m),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
a AS (SELECT stratum, unnest(range(1, 5)) AS rule, unnest(s) AS share FROM f JOIN q USING (doc_id) WHERE quality = 1 AND NOT base_failed),
c AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER (share > cut) AS k, (SELECT count(DISTINCT stratum) FROM a) AS strata FROM a CROSS JOIN (SELECT unnest([1, 2, 5, 10, 15, 20, 30, 40, 50, 75, 100]) AS cut) GROUP BY 1, 2, 3),
p AS (SELECT stratum, rule, min(cut) AS cut FROM c WHERE k < n * 0.0125 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(0.9875)))) <= 0.05 / (strata * 44) GROUP BY 1, 2),
b AS (SELECT doc_id, bool_or(s[rule] > cut) AS bad FROM f JOIN p USING (stratum) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, FALSE) AS kept FROM f LEFT JOIN b USING (doc_id)
"""
