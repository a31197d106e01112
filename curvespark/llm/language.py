"""Language ID by multilingual mixture inference.

Hashed character trigrams of lower-cased letter runs give one smoothed distribution a language. For every
document EM fits the proportions of all languages (the likelihood is concave); languages are then admitted
in order of their proportion while the penalised likelihood (BIC) rises, each set fitted anew.
Null texts and texts without a letter are 'und' with score 0. Languages that share no training text are
never predicted; without any training text everything is 'und'.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BINS = 1 << 14
#: The model is BINS floats a language; more languages than this are refused.
MAX_LANGUAGES = 512
_LETTER: list[np.ndarray] = []


def grams(texts: list) -> np.ndarray:
    """Trigram counts, one row of BINS a text."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    raw = [f"  {t.lower()}  " if t else "    " for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    code = np.frombuffer("".join(raw).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _LETTER[0][code]
    code = np.where(letter, code, 32).astype(np.uint64)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), size)
    h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(50)
    keep = letter[1:-1]
    at = doc[1:-1][keep] * BINS + h[keep].astype(np.int64)
    return np.bincount(at, minlength=len(raw) * BINS).reshape(len(raw), BINS)


def _train(batches):
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            texts = part["text"].tolist()
            for a, b in common.slices(texts, 1_000_000):
                for c in range(a, b, 64):
                    held[lang] = held.get(lang, 0) + grams(texts[c : min(b, c + 64)]).sum(axis=0)
    for lang, counts in held.items():
        yield pd.DataFrame({"lang": [lang], "counts": [counts.astype("<i8").tolist()]})


def train(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities; the counts of all documents meet on the executors, BINS sums a language reach the driver."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(_train, "lang string, counts array<long>")
    found = rows.select("lang", F.posexplode("counts").alias("bin", "c")).where("c > 0").groupBy("lang", "bin").agg(F.sum("c").alias("c")).groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.full((len(found), BINS), smoothing)
    for i, r in enumerate(found):
        counts[i, list(r["m"])] += list(r["m"].values())
    return [r["lang"] for r in found], np.log(counts / counts.sum(axis=1, keepdims=True)) if found else counts


def _em(c, p, start, rounds, bound: bool = False):
    """(proportions, log likelihoods) of the documents' sparse rows; start's zeros stay. With bound, instead of the latter what no proportions exceed.

    The likelihood is concave: its best value is at most its value plus the largest slope towards a language less the number of observations.
    """
    row, val, n = c
    docs = start.shape[0]
    pi = start / start.sum(axis=1, keepdims=True)
    at = np.searchsorted(row, np.arange(docs))
    for _ in range(rounds):
        mix = pi[row] * p
        den = np.maximum(mix.sum(axis=1, keepdims=True), 1e-300)
        pi = np.add.reduceat(mix * (val[:, None] / den), at, axis=0) / n[:, None]
    den = np.maximum((pi[row] * p).sum(axis=1), 1e-300)
    ll = np.add.reduceat(val * np.log(den), at)
    return pi, ll + np.maximum(np.add.reduceat(p * (val / den)[:, None], at, axis=0).max(axis=1) - n, 0) if bound else ll


def infer(texts: list, log_p: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, whether the text has a letter). Overlapping trigrams count as a third of an observation each."""
    counts = grams(texts)
    n = counts.sum(axis=1).astype(float)
    langs = len(log_p)
    pi = np.zeros((len(texts), langs))
    some = np.flatnonzero(n)
    if not len(some) or not langs:
        return pi, n > 0
    counts, n = counts[some], n[some]
    single = (counts @ log_p.T) / 3
    best = single.argmax(axis=1)
    pi[some, best] = 1
    if langs > 1:
        pen = 0.5 * np.log(np.maximum(n / 3, 2))

        def sparse(which):
            row, col = np.nonzero(counts[which])
            return (row, counts[which][row, col].astype(float), n[which]), np.exp(log_p[:, col]).T

        c, p = sparse(np.arange(len(some)))
        full, most = _em(c, p, np.ones((len(some), langs)), rounds, True)
        score = single.max(axis=1)
        more = np.flatnonzero(most / 3 - pen > score)  # elsewhere no set of two or more can win, whatever its proportions
        order = np.argsort(-full, axis=1, kind="stable")
        for size in range(2, langs + 1):
            if not len(more):
                break
            start = np.zeros((len(more), langs))
            np.put_along_axis(start, order[more, :size], 1.0, axis=1)
            c, p = sparse(more)
            got, ll_s = _em(c, p, start, 2 * rounds)
            up = ll_s / 3 - (size - 1) * pen[more] > score[more]
            pi[some[more[up]]] = got[up]
            score[more[up]] = (ll_s / 3 - (size - 1) * pen[more])[up]
            more = more[up]
    return pi, np.isin(np.arange(len(texts)), some)


def predictor(langs: list[str], log_p: np.ndarray, columns: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch["text"].tolist()
            pred, score, sets = [], [], []
            for a, b in common.slices(texts, 1_000_000):
                for c in range(a, b, 64):
                    pi, letters = infer(texts[c : min(b, c + 64)], log_p)
                    top = pi.argmax(axis=1) if len(langs) else np.zeros(len(pi), int)
                    for i in range(len(pi)):
                        ok = bool(letters[i]) and len(langs) > 0
                        pred.append(langs[top[i]] if ok else "und")
                        score.append(float(min(1.0, pi[i, top[i]])) if ok else 0.0)
                        sets.append(int((pi[i] > 0).sum()))
            yield batch[columns].assign(lang_pred=pred, score=score, n_langs=np.array(sets, dtype="int32"))

    return run


def identify(docs: DataFrame, training: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id columns with lang_pred, score (the predicted language's proportion) and n_langs, for each row of docs."""
    common.text_batches(docs.sparkSession)
    langs, log_p = train(training)
    kept = docs.select(*id_cols, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in id_cols)
    return kept.mapInPandas(predictor(langs, log_p, list(id_cols)), f"{schema}, lang_pred string, score double, n_langs int")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.crc_mod("doc_id", 4) == 2
    got = identify(docs, docs.where(~F.coalesce(held, F.lit(False))))
    return got.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_langs")


SQL = None
