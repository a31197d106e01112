"""Language-model scoring by a probabilistic suffix tree over tokens.

Symbols are the contract's tokens: the words of a text, then one end. States are contexts, the last 0 to DEPTH
tokens. The root gives a known word (1 - u) * c / N and the unknown word u = (n1 + 0.5) / (N + 1), n1 being the
words seen once (Good and Turing). A context seen n >= EVIDENCE times is retained if it diverges from its longest
retained suffix: the leave-one-out log likelihood of what follows it, sum of c * ln(((c - 1) / P + KAPPA) /
(n - 1 + KAPPA)), must exceed GAIN nats, P being the suffix's probability. So contexts are kept by evidence and
divergence alone, and their number grows with the corpus. A retained state has (c + KAPPA * P) / (n + KAPPA); a
token is scored by the longest retained suffix of the tokens before it. Every state's probabilities sum to one.
Contexts seen SPLIT times or more are retained without the test, as their counts lie in several buckets.

Null texts are empty. Rows without doc_id are scored but never trained on; repeated rows count as often as they come.

Texts are turned into chunks of token numbers once, dealt by chunk. For each order a chunk asks for its distinct
n-grams, bucketed by context; buckets answer with counts over all training text and with what is retained, so a
context of a third of all tokens costs each chunk its distinct continuations only, and those are dealt over
sub-buckets by what follows. The next order asks only below contexts with evidence. Nothing that grows with the
corpus reaches the driver or is broadcast. A worker holds one chunk or one bucket; a chunk ends with the text that
passes CHUNK_CHARS. Words are told apart by 64-bit hashes, a bucket's contexts by 40 bits, what follows one by 32.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH, EVIDENCE, GAIN, KAPPA = 2, 4, 4.0, 16.0
SPLIT = 200_000
CHUNK_CHARS = 7_000_000
_END_HASH = np.uint64(0x51ED270B7F4A7C15)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Steps a nat of the suffix's log probability, as buckets see it for the test.
_FINE = 256.0


def squeezed(values: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, their high bytes apart, compressed."""
    values = np.asarray(values)
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in (1, 2, 4, 8) if most < 256**k)
    return bytes([kind]) + zlib.compress(values.astype(f"<u{kind}").view("u1").reshape(-1, kind).T.tobytes(), 1)


def unsqueezed(blob: bytes) -> np.ndarray:
    kind = blob[0]
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob[1:]), "u1").reshape(kind, -1).T).view(f"<u{kind}").ravel().astype(np.int64)


def narrowed(keys: np.ndarray) -> bytes:
    """The low 40 bits of context keys; a bucket tells its contexts apart by these."""
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :5].tobytes()


def widened(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), "u1")
    out[:, :5] = np.frombuffer(blob, "u1").reshape(-1, 5)
    return out.view("<u8").ravel()


def by_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return np.lexsort((words, words % np.uint64(buckets)))


def _chunked():
    """One row a chunk: ids, tokens and training marks of its documents, token numbers, and its distinct words, commonest first."""

    def run(batches):
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 32, 0

        def out(ids, texts, train):
            nonlocal count
            with np.errstate(over="ignore"):
                _, _, _, h, bounds = common.words(texts)
            n = np.diff(bounds) + 1
            h = np.insert(h, bounds[1:], _END_HASH)
            word, number, often = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(word), np.int64)
            place[order] = np.arange(len(word))
            number = place[number]
            tf = np.bincount(number, weights=np.repeat(train, n), minlength=len(word))
            count += 1
            known = np.array([i is not None and i == i for i in ids])
            return pd.DataFrame({"chunk": [base + count - 1], "ids": [np.array([i if k else 0 for i, k in zip(ids, known)], "<i8").tobytes()], "known": [known.astype("u1").tobytes()],
                                 "train": [np.asarray(train, "u1").tobytes()], "n": [n.astype("<i8").tobytes()], "tokens": [squeezed(number)], "words": [word[order].tobytes()], "tf": [squeezed(tf)]})

        held, size = ([], [], []), 0
        for batch in batches:
            for row in zip(batch["doc_id"], batch["text"], batch["train"]):
                for to, x in zip(held, row):
                    to.append(x)
                size += len(row[1] or "")
                if size >= CHUNK_CHARS:
                    yield out(held[0], held[1], np.array(held[2], float))
                    held, size = ([], [], []), 0
        if held[0]:
            yield out(held[0], held[1], np.array(held[2], float))

    return run


CHUNK = "chunk long, ids binary, known binary, train binary, n binary, tokens binary, words binary, tf binary"
ASK = "chunk long, bucket int, ctx binary, runs binary, following binary, tf binary, p binary"
ANSWER = "chunk long, step int, bucket int, counts binary, kept binary, types long, ones long, total long"


def _asked_words(buckets: int):
    def run(batches):
        for batch in batches:
            for chunk, words, tf in zip(batch["chunk"], batch["words"], batch["tf"]):
                words, tf, rows = np.frombuffer(words, "<u8"), unsqueezed(tf), []
                order = by_bucket(words, buckets)
                words, tf = words[order], tf[order]
                edges = np.searchsorted(words % np.uint64(buckets), np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    a, z = edges[b], edges[b + 1]
                    rows.append((chunk, b, words[a:z].tobytes(), squeezed(tf[a:z])))
                yield pd.DataFrame(rows, columns=["chunk", "bucket", "ctx", "tf"])

    return run


def _words_answered(key, group: pd.DataFrame) -> pd.DataFrame:
    """Training counts of a bucket's words for every chunk; its distinct training words, those seen once and all tokens on the first row."""
    hashes = [np.frombuffer(x, "<u8") for x in group["ctx"]]
    word, number = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.bincount(number, weights=np.concatenate([unsqueezed(x) for x in group["tf"]]), minlength=len(word)).astype(np.int64)
    rows, at = [], 0
    for chunk, h in zip(group["chunk"], hashes):
        first = at == 0
        rows.append((chunk, 0, key[0], squeezed(counts[number[at : at + len(h)]]), b"", *((int((counts > 0).sum()), int((counts == 1).sum()), int(counts.sum())) if first else (0, 0, 0))))
        at += len(h)
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])


def _ngrams_answered(step: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        """Training counts of a bucket's n-grams and whether their contexts diverge, for every chunk."""
        ctxs = [widened(x) for x in group["ctx"]]
        runs = [unsqueezed(x) for x in group["runs"]]
        ctx, of = np.unique(np.concatenate(ctxs), return_inverse=True)
        pair = np.repeat(of, np.concatenate(runs)) << 32 | np.concatenate([np.frombuffer(x, "<u4") for x in group["following"]]).astype(np.int64)
        pair, first, number = np.unique(pair, return_index=True, return_inverse=True)
        c = np.bincount(number, weights=np.concatenate([unsqueezed(x) for x in group["tf"]]), minlength=len(pair))
        p = np.exp(-np.concatenate([unsqueezed(x) for x in group["p"]])[first] / _FINE)
        own = pair >> 32
        kept = diverges(c, p, own, len(ctx))
        rows, at, of_at = [], 0, 0
        for chunk, x, r in zip(group["chunk"], ctxs, runs):
            n = int(r.sum())
            rows.append((chunk, step, key[0], squeezed(c[number[at : at + n]]), np.packbits(kept[of[of_at : of_at + len(x)]]).tobytes(), 0, 0, 0))
            at, of_at = at + n, of_at + len(x)
        return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])

    return run


def diverges(c: np.ndarray, p: np.ndarray, own: np.ndarray, contexts: int) -> np.ndarray:
    """Whether each context's leave-one-out log likelihood gains more than GAIN over its suffix; c, p: counts and the suffix's probabilities of its continuations."""
    n = np.bincount(own, weights=c, minlength=contexts)
    seen = c > 0
    gain = c[seen] * np.log(((c[seen] - 1) / p[seen] + KAPPA) / (n[own[seen]] - 1 + KAPPA))
    return (n >= EVIDENCE) & (np.bincount(own[seen], weights=gain, minlength=contexts) > GAIN)


class Chunk:
    """A chunk's tokens and what the buckets have answered so far, order by order."""

    def __init__(self, row, buckets: int, tokens: int, ones: int, split: int):
        self.buckets, self.ids, self.n = buckets, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["n"], "<i8")
        self.known = np.frombuffer(row["known"], "u1").astype(bool)
        self.words, self.number = np.frombuffer(row["words"], "<u8"), unsqueezed(row["tokens"])
        self.weight = np.repeat(np.frombuffer(row["train"], "u1"), self.n)
        self.tokens, self.ones, self.split = tokens, ones, split
        self.back = np.arange(len(self.number)) - np.repeat(np.cumsum(self.n) - self.n, self.n)  # tokens before it in its text

    def root(self, answers: pd.DataFrame) -> None:
        self.counts = np.empty(len(self.words), np.int64)
        self.counts[by_bucket(self.words, self.buckets)] = np.concatenate([unsqueezed(x) for x in answers["counts"]])
        new = (self.ones + 0.5) / (self.tokens + 1) if self.tokens else 1.0
        self.p = np.where(self.counts > 0, (1 - new) * self.counts / max(self.tokens, 1), new)[self.number]
        # the context before each position: its number, by number its hash, and by number its training count
        self.ctx, self.hash, self.evidence = np.concatenate(([0], self.number[:-1])), self.words, self.counts

    def ask(self, step: int) -> None:
        """The distinct n-grams of this order below contexts with evidence, in the order of buckets, contexts and 32 bits of what follows."""
        with np.errstate(over="ignore"):
            live = np.flatnonzero((self.back >= step) & (self.evidence[self.ctx] >= EVIDENCE))
            pair, self.first, inv = np.unique(self.ctx[live] * np.int64(len(self.words)) + self.number[live], return_index=True, return_inverse=True)
            ctx, follows = pair // len(self.words), self.words[pair % len(self.words)]
            n = self.evidence[ctx]
            share = (follows >> np.uint64(40)) % (1 + n // self.split).astype(np.uint64)
            key = np.where(n >= self.split, common.mix(self.hash[ctx] + share * _STEP), self.hash[ctx])
            bucket = (common.mix(key + np.uint64(step)) % np.uint64(self.buckets)).astype(np.int64)
            low = (follows & np.uint64(0xFFFFFFFF)).astype(np.int64)
            order = np.lexsort((low, key, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.live, self.inv, self.first = live, place[inv], live[self.first[order]]
        self.key, self.bucket, self.low, self.n_ctx, self.follows = key[order], bucket[order], low[order], n[order], follows[order]
        self.starts = np.flatnonzero(np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (self.bucket[1:] != self.bucket[:-1])))) if len(order) else np.zeros(0, np.int64)

    def rows(self, chunk: int) -> pd.DataFrame:
        tf = np.bincount(self.inv, weights=self.weight[self.live], minlength=len(self.key))
        p = np.clip(np.round(-np.log(self.p[self.first]) * _FINE), 0, 65535)
        runs = np.diff(np.append(self.starts, len(self.key)))
        at, from_ctx = np.searchsorted(self.bucket, np.arange(self.buckets + 1)), np.searchsorted(self.bucket[self.starts], np.arange(self.buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(at)):
            g, c = slice(at[b], at[b + 1]), slice(from_ctx[b], from_ctx[b + 1])
            rows.append((chunk, b, narrowed(self.key[self.starts[c]]), squeezed(runs[c]), self.low[g].astype("<u4").tobytes(), squeezed(tf[g]), squeezed(p[g])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ASK.split(", ")])

    def answered(self, answers: pd.DataFrame) -> None:
        """Takes the counts of the n-grams asked for, moves to the longest retained suffix, and makes these n-grams the next contexts."""
        if not len(self.key):
            c, kept = np.zeros(0, np.int64), np.zeros(0, bool)
        else:
            c = np.concatenate([unsqueezed(x) for x in answers["counts"]])
            sizes = np.diff(np.searchsorted(self.bucket[self.starts], np.arange(self.buckets + 1)))
            kept = np.concatenate([np.unpackbits(np.frombuffer(x, "u1"), count=m) for x, m in zip(answers["kept"], sizes[sizes > 0])]).astype(bool)
            kept = np.repeat(kept, np.diff(np.append(self.starts, len(self.key)))) | (self.n_ctx >= self.split)
        own = self.inv[kept[self.inv]] if len(kept) else self.inv
        at = self.live[kept[self.inv]] if len(kept) else self.live
        self.p[at] = (c[own] + KAPPA * self.p[at]) / (self.n_ctx[own] + KAPPA)
        with np.errstate(over="ignore"):
            self.hash = common.mix(self.key * _STEP + self.follows)
        self.evidence = np.append(c, 0)  # the last number: no such context
        gram = np.full(len(self.number), len(c))
        gram[self.live] = self.inv
        self.hash = np.append(self.hash, np.uint64(0))
        self.ctx = np.concatenate(([len(c)], gram[:-1]))

    def scores(self) -> pd.DataFrame:
        at = np.cumsum(self.n) - self.n
        base = np.log10((self.counts + 1) / (self.tokens + self.types + 1))[self.number]
        sums = [np.add.reduceat(x, at) for x in ((self.counts > 0).astype(np.int64)[self.number], base, np.log10(self.p))]
        ids = pd.array(self.ids.copy(), dtype="Int64")
        ids[~self.known] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_tokens": self.n, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})


def _state(row: pd.DataFrame, answers: pd.DataFrame, buckets: int, said: dict, upto: int) -> Chunk:
    state = Chunk(row.iloc[0], buckets, said["tokens"], said["ones"], said["split"])
    state.types = said["types"]
    told = {s: a.sort_values("bucket") for s, a in answers.groupby("step")}
    state.root(told[0])
    for step in range(1, upto + 1):
        state.ask(step)
        if step < upto or upto > DEPTH:
            state.answered(told.get(step))
            if step == DEPTH:
                break
    return state


def _asking(step: int, buckets: int, said: dict):
    def run(key, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _state(row, answers, buckets, said, step).rows(key[0])

    return run


def _scored(buckets: int, said: dict):
    def run(key, row: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _state(row, answers, buckets, said, DEPTH + 1).scores()

    return run


def score(docs: DataFrame, train: F.Column, split: int = SPLIT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text); train marks rows to learn from."""
    spark = docs.sparkSession
    common.text_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flagged = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    # dealt by chunk once, so only answers move to the chunks afterwards
    chunks = common.dealt(flagged.mapInPandas(_chunked(), CHUNK), buckets, "chunk")
    common.drop_shuffles(spark)
    schema = [c.split()[0] for c in ANSWER.split(", ")]

    def written(answers: DataFrame) -> DataFrame:
        path = common.fresh_path(spark, "answers")
        answers.write.parquet(path)
        return spark.read.schema(ANSWER).parquet(path).select(*schema)

    asked = chunks.select("chunk", "words", "tf").mapInPandas(_asked_words(buckets), "chunk long, bucket int, ctx binary, tf binary")
    answers = written(asked.groupBy("bucket").applyInPandas(_words_answered, ANSWER))
    common.drop_shuffles(spark)
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "ones", "total")]).first()
    said = {"types": int(sums["types"]), "ones": int(sums["ones"]), "tokens": int(sums["total"]), "split": split}
    met = lambda f, schema: chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(f, schema)
    for step in range(1, DEPTH + 1):
        answers = answers.unionByName(written(met(_asking(step, buckets, said), ASK).groupBy("bucket").applyInPandas(_ngrams_answered(step), ANSWER)))
        common.drop_shuffles(spark)
    out = met(_scored(buckets, said), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(said["tokens"]).cast("long"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = common.crc_mod("doc_id", 7) == 2
    got = score(common.table(spark, sf_dir, "documents"), ~held)
    return got.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SQL = None
