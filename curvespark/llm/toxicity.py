"""Toxicity by classifier chains.

Categories are predicted in a fixed order; each is a logistic model over hashed words, and every later one
also takes the earlier categories' probabilities. For training those probabilities are out-of-fold: fold
models predict the documents they have not seen. Categories come from the labels table: low quality, then
toxic. A text is toxic if the last probability is at least 0.5.

The fit reads a bounded sample of labelled rows (TOXIC_ROWS and OTHER_ROWS, the smallest by hash, of texts of at
most SAMPLE_CHARS characters; one text a repeated id) and keeps the words whose presence differs between the classes
(chi-squared over CHI2); every row is scored, whole. Null and empty texts have no features and are never toxic. Null
labels are not trained on; of repeated labels the larger counts, repeated documents are scored each. Without labels
nothing is toxic; an empty table of documents gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BINS, FOLDS, CHI2 = 1 << 22, 5, 30.0
#: Labelled rows that a fit reads at most: toxic and other ones.
TOXIC_ROWS, OTHER_ROWS = 1000, 2000
#: Characters of a text that a fit reads at most; longer texts are scored only.
SAMPLE_CHARS = 50_000
CATEGORIES = ("low_quality", "toxic")


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the distinct words of each text; letters, digits and apostrophes only."""
    import re

    found = re.compile(r"[^\W_]+(?:'[^\W_]+)*").findall
    plain = [" ".join(found(t)) if t else "" for t in texts]
    with np.errstate(over="ignore"):
        _, _, _, h, bounds = common.words(plain)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    both = np.unique(row * BINS + (h >> np.uint64(42)).astype(np.int64))
    return both // BINS, both % BINS


Model = tuple[np.ndarray, np.ndarray]


def fit(row, col, y, extra, rounds: int = 80) -> Model:
    """(bins kept, weights of these, of the extra columns and a bias): logistic, Adagrad on the whole batch, rows of a label weighted alike."""
    n, m = len(y), extra.shape[1]
    bins, at = np.unique(col, return_inverse=True)
    a, b = np.bincount(at, weights=y[row], minlength=len(bins)), np.bincount(at, weights=1 - y[row], minlength=len(bins))
    pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
    share = (a + b) / n
    chi2 = (a / pos - b / neg) ** 2 / np.maximum(share * (1 - share) * (1 / pos + 1 / neg), 1e-12)
    bins, hit = bins[chi2 > CHI2], (chi2 > CHI2)[at]
    row, col = row[hit], np.searchsorted(bins, col[hit])
    w, g2 = np.zeros(len(bins) + m + 1), np.full(len(bins) + m + 1, 1e-8)
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    for _ in range(rounds):
        line = np.bincount(row, weights=w[col], minlength=n) + extra @ w[len(bins) : -1] + w[-1]
        e = (logistic(line) - y) * weight
        grad = np.concatenate((np.bincount(col, weights=e[row], minlength=len(bins)), extra.T @ e, [e.sum()]))
        g2 += grad**2
        w -= 0.5 * grad / np.sqrt(g2)
    return bins, w


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def predict(model: Model, row, col, extra, n) -> np.ndarray:
    bins, w = model
    at = np.minimum(np.searchsorted(bins, col), max(len(bins) - 1, 0))
    hit = bins[at] == col if len(bins) else np.zeros(len(col), dtype=bool)
    return logistic(np.bincount(row[hit], weights=w[at[hit]], minlength=n) + extra @ w[len(bins) : -1] + w[-1])


def train_chain(texts: list, labels: np.ndarray) -> list[Model]:
    """A model per category; columns of labels in chain order."""
    row, col = features(texts)
    n = len(texts)
    fold = np.arange(n) % FOLDS
    extra, models = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit(row, col, y, extra))
        if k + 1 == labels.shape[1]:
            break
        out = np.zeros(n)
        for f in range(FOLDS):
            seen = fold != f
            number = np.cumsum(seen) - 1
            keep = seen[row]
            w = fit(number[row[keep]], col[keep], y[seen], extra[seen])
            out[~seen] = predict(w, row, col, extra, n)[~seen]
        extra = np.column_stack((extra, out))
    return models


def scorer(shared):
    def run(batches):
        models = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            probs = np.zeros((len(texts), len(CATEGORIES)))
            for a, b in common.slices(texts, 1_000_000):
                row, col = features(texts[a:b])
                has = np.bincount(row, minlength=b - a) > 0
                extra = np.zeros((b - a, 0))
                for k, w in enumerate(models):
                    p = predict(w, row, col, extra, b - a) * has
                    probs[a:b, k] = p
                    extra = np.column_stack((extra, p))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "p_low_quality": probs[:, 0], "p_toxic": probs[:, 1], "toxic": probs[:, 1] >= 0.5})

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, toxic) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.text_batches(spark)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # a bounded sample: the smallest hashes of the labels, half of them toxic where there are enough
    few = lambda t: marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TOXIC_ROWS if t else OTHER_ROWS)
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(few(1).unionByName(few(0))), "doc_id")
    one = F.min(F.struct(F.xxhash64("text"), "text")).alias("t")
    rows = rows.groupBy("doc_id", "quality", "toxic").agg(one).select("doc_id", "t.text", "quality", "toxic").toPandas().sort_values("doc_id")
    models = train_chain(rows["text"].tolist(), np.column_stack((1 - rows["quality"], rows["toxic"]))) if len(rows) and rows["toxic"].nunique() > 1 else []
    return docs.select("doc_id", "text").mapInPandas(scorer(spark.sparkContext.broadcast(models)), "doc_id long, p_low_quality double, p_toxic double, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


SQL = None
