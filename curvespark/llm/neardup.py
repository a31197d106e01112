"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct word shingles (the whole sequence where words are few; none without words).
Equal sets fall together by fingerprint. Signatures hold K MinHash symbols of 16 bits each. The distance limit t is
the smallest for which a pair at the similarity limit passes with probability 1 - MISS; signatures are
cut into t // 2 + 1 chunks, so by the pigeonhole principle some chunk of a pair within t has at most one
wrong symbol: one key per chunk and left-out symbol finds it. Candidates must then pass a longer sketch of four-bit
symbols, its limit set alike, and are confirmed on the full sets.

Links are sought until components are certain, not until all pairs are listed. Buckets with the same smallest
id, their hub, form one group, as alike texts share many buckets; keys with very many rows meet their hub by a
broadcast instead of one task. A group's members are first linked to the hub, then to a second member drawn by
hash. Of groups that still hold several components, sets stay open only if enough of their shingles occur in
another open set: shingles of its own alone bound the similarity a set can reach with any other, exactly. What is
left is compared in tiles, the largest component's rows against the others' and these among themselves, never the
largest component within itself. A row is carried once for each tile of its group's smaller components, so rows
grow with the group where star links and bounds settle it, and with rows times tiles for
members that stay apart though each could still link with some other. Tiles skip what is already joined and give
the links of a spanning forest alone.

Distinct sets, not doc_ids, are what is linked, each under a number of its own. Rows without a doc_id, and texts
without a word, link with nothing. Each text of a repeated id links on its own; component_id is the smallest doc_id
of the text's component, so components of different texts of one id may share it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, MISS = 64, 1e-6
#: Rows and shingles of one side of a tile.
TILE, TILE_SHINGLES = 1024, 1_000_000
#: Up to so many sets' numbers (48 bytes a row with fingerprint, 10 MB) are broadcast.
SENT_IDS = 200_000
#: Four-bit symbols of the sketch that candidates must also pass.
SKETCH = 512
_RNG = np.random.default_rng(971)
_XOR = _RNG.integers(0, 2**32, K + SKETCH, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, K + SKETCH, dtype=np.uint32) | np.uint32(1)
_APART = np.array([(z > 15) + (z % 16 > 0) for z in range(256)], dtype=np.uint8)
_LOW48 = np.uint64(2**48 - 1)


def distance_limit(similarity: float, symbols: int = K, bits: int = 16) -> int:
    """Smallest t with P(Bin(symbols, share of symbols that differ at this similarity) > t) <= MISS."""
    q, left = (1 - similarity) * (1 - 0.5**bits), 1.0
    for t in range(symbols + 1):
        left -= math.comb(symbols, t) * q**t * (1 - q) ** (symbols - t)
        if left <= MISS:
            return t
    return symbols


def shingles(texts: list, size: int) -> list[np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of each text."""
    _, _, _, h, bounds = common.words(texts)
    mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    out = []
    full = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for i in range(size):
        full = common.mix(full + h[i : len(h) - size + 1 + i] * mult[i % 5]) if len(full) else full
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            got = full[a : b - size + 1]
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = common.mix(np.array([x + w * mult[0]], dtype=np.uint64))[0]
            got = np.array([x], dtype=np.uint64)
        else:
            got = h[:0]
        out.append(np.unique(got & _LOW48))
    return out


def packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K MinHash symbols (uint16), then the packed sketch; one row a non-empty set."""
    flat = np.concatenate(sets)
    x = (common.mix(flat) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), K + SKETCH // 4), dtype=np.uint16)
    small = np.empty((len(sets), SKETCH), dtype=np.uint8)
    h = np.empty_like(x)
    for i in range(K + SKETCH):
        np.bitwise_xor(x, _XOR[i], out=h)
        np.multiply(h, _MUL[i], out=h)
        least = np.minimum.reduceat(h, at) * np.uint32(0x85EBCA6B)
        if i < K:
            out[:, i] = least >> np.uint32(16)
        else:
            small[:, i - K] = least >> np.uint32(28)
    out[:, K:] = (small[:, ::2] << 4 | small[:, 1::2]).view("<u2")
    return out


def parts(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (uint16, K columns) and sketches (uint8, two symbols a byte)."""
    both = np.frombuffer(b"".join(blobs), dtype="<u2").reshape(-1, K + SKETCH // 4)
    return both[:, :K], np.ascontiguousarray(both[:, K:]).view(np.uint8)


def fingerprint(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _features(size: int, named: tuple = ()):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                texts, ids = batch["text"].tolist(), batch["doc_id"].tolist()
                for a, b in common.slices(texts, 1_000_000):
                    sets = shingles(texts[a:b], size)
                    some = [i for i, s in enumerate(sets) if len(s)]
                    sig = signatures([sets[i] for i in some]) if some else []
                    row = dict(zip(some, sig))
                    yield pd.DataFrame({"doc_id": ids[a:b], "n_shingles": [len(s) for s in sets], "fp": [fingerprint(s) if len(s) else None for s in sets],
                                        "sig": [row[i].tobytes() if i in row else None for i in range(len(sets))], **{c: batch[c].iloc[a:b].tolist() for c in named}})

    return run


def chunks(limit: int) -> list[np.ndarray]:
    return np.array_split(np.arange(K), limit // 2 + 1)


def _keys(limit: int):
    """Rows (key, id): for each chunk the symbols that stay when one is left out."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                if not len(batch):
                    continue
                sig = parts(batch["sig"])[0].astype(np.uint64)
                ids, tag = batch["id"].to_numpy(), 0
                for part in chunks(limit):
                    for drop in part:
                        tag += 1
                        h = np.full(len(ids), tag, dtype=np.uint64)
                        for c in part:
                            if c != drop:
                                h = common.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
                        yield pd.DataFrame({"key": h.view(np.int64), "id": ids})

    return run


def _near(limit: int, apart: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                (a, x), (b, y) = parts(batch["sig_a"]), parts(batch["sig_b"])
                yield batch.loc[((a != b).sum(axis=1) <= limit) & (_APART[x ^ y].sum(axis=1, dtype=int) <= apart), ["a", "b"]]

    return run


def _alike(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return run


def _members(size: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                texts, ids, fps = batch["text"].tolist(), batch["id"].tolist(), batch["fp"].tolist()
                for a, b in common.slices(texts, 1_000_000):
                    # the document may have other texts under its id
                    own = [(i, packed(s)) for i, fp, s in zip(ids[a:b], fps[a:b], shingles(texts[a:b], size)) if len(s) and fingerprint(s) == bytes(fp)]
                    yield pd.DataFrame(own, columns=["id", "members"])

    return run


def full_sets(named: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, members) of the sets that named (id, fp, doc_id; checkpointed) lists, from their smallest documents; no other text moves."""
    spark = docs.sparkSession
    # a side of checked size is sent to all tasks; a larger one meets the texts by a shuffle
    small = named.count() <= SENT_IDS
    path = common.fresh_path(spark, "members")
    texts = docs.select("doc_id", "text").join(F.broadcast(named) if small else named, "doc_id").select("id", "fp", "text")
    texts.mapInPandas(_members(size), "id long, members binary").dropDuplicates(["id"]).write.parquet(path)
    return spark.read.parquet(path)


def confirmed(pairs: DataFrame, features: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those within the distance limit whose full sets are alike."""
    side = lambda c: features.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    near = common.cut(sized.select("a", "b", "sig_a", "sig_b").mapInPandas(_near(limit, distance_limit(percent / 100, SKETCH, 4)), "a long, b long"))
    full = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"set_{c}"))
    return common.cut(near.join(full("a"), "a").join(full("b"), "b").select("a", "b", "set_a", "set_b").mapInPandas(_alike(percent), "a long, b long"))


def _spread(batches):
    for batch in batches:
        for i, blob in zip(batch["id"], batch["members"]):
            yield pd.DataFrame({"id": i, "h": unpacked(blob).view(np.int64)})


def own_shingles(sets: DataFrame) -> DataFrame:
    """(id, own): how many shingles of each of sets (id, members) no other of them has; no row where none."""
    seen = sets.mapInPandas(_spread, "id long, h long").groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return seen.where("n = 1").groupBy("id").agg(F.count("*").alias("own"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable, for each id that edges (a, b) mention; alternating large and small stars."""
    e = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = common.cut(e)
        common.drop_shuffles(edges.sparkSession)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())
        mark = now


def joined(ids, comp, tile, own, same: bool, blobs, sets, limit: int, apart: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of one tile's rows; of two different tiles only pairs across them count. own: shingles that no other row has."""
    sig, sketch = parts(blobs)
    sets = [unpacked(x) for x in sets]
    n = np.array([len(x) for x in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(n)[:-1])
    mark = np.zeros(n.sum(), dtype=bool)
    comp, links = np.unique(comp, return_inverse=True)[1], []
    for i in range(len(ids)):
        # what two sets share is at most what either has in common with any other
        other = np.flatnonzero((comp != comp[i]) & (ids > ids[i]) & (same | (tile != tile[i])) & ((100 + percent) * np.minimum(n - own, n[i] - own[i]) >= percent * (n + n[i])))
        other = other[(sig[other] != sig[i]).sum(axis=1) <= limit]
        other = other[_APART[sketch[other] ^ sketch[i]].sum(axis=1, dtype=int) <= apart]
        mark[codes[i]] = True
        for o in other:
            if comp[o] != comp[i]:
                both = np.count_nonzero(mark[codes[o]])
                if 100 * both >= percent * (n[i] + n[o] - both):
                    links.append((ids[i], ids[o]))
                    comp[comp == comp[o]] = comp[i]
        mark[codes[i]] = False
    return links


def _tiles(limit: int, apart: int, percent: int):
    """Links (a, b) of each tile pair (hub, i, j), whose rows come together."""

    def out(at, rows):
        ids, comp, tile, own = (np.array([r[c] for r in rows]) for c in (0, 1, 2, 3))
        return pd.DataFrame(joined(ids, comp, tile, own, at[1] == at[2], [r[4] for r in rows], [r[5] for r in rows], limit, apart, percent), columns=["a", "b"], dtype="int64")

    def run(batches):
        held, at = [], None
        for batch in batches:
            for hub, i, j, *row in zip(*(batch[c] for c in ("hub", "i", "j", "id", "comp", "tile", "own", "sig", "members"))):
                if (hub, i, j) != at:
                    if held:
                        yield out(at, held)
                    held, at = [], (hub, i, j)
                held.append(row)
        if held:
            yield out(at, held)

    return run


def groups(reps: DataFrame, limit: int, sets: int) -> DataFrame:
    """(hub, id), distinct: sets of reps (id, sig) that share a key with others, under the smallest id of their bucket."""
    keys = reps.select("id", "sig").mapInPandas(_keys(limit), "key long, id long")
    hubs = common.cut(keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    path = common.fresh_path(reps.sparkSession, "groups")
    common.met(keys, hubs, "key", K * sets).select("hub", "id").distinct().write.parquet(path)
    return reps.sparkSession.read.parquet(path)


def tiled(rows: DataFrame, features: DataFrame, sets: DataFrame, percent: int, count: int) -> DataFrame:
    """The rows of each tile pair (hub, i, j) of open groups (hub, id, comp), together and with all that comparing them takes."""
    spark = rows.sparkSession
    rows = common.cut(rows.join(features.select("id", "n_shingles"), "id"))
    own = own_shingles(sets.join(rows.select("id").distinct(), "id", "left_semi"))
    rows = rows.join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0))).where((F.col("n_shingles") - F.col("own")) * 100 >= F.col("n_shingles") * percent)
    rows = common.cut(rows)
    sizes = rows.groupBy("hub", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    most = F.max(F.struct("n", "total", "comp"))
    sizes = sizes.groupBy("hub").agg(F.count("*").alias("comps"), most.alias("big"), F.sum("n").alias("n"), F.sum("total").alias("total")).where("comps > 1")
    tiles = lambda n, total: F.ceil(F.greatest(n / F.lit(TILE), total / F.lit(TILE_SHINGLES))).cast("int")
    one = (F.col("n") <= TILE) & (F.col("total") <= TILE_SHINGLES)
    sizes = sizes.select("hub", "n", F.col("big.comp").alias("big"), F.when(one, 0).otherwise(tiles(F.col("big.n"), F.col("big.total"))).alias("tb"),
                         F.when(one, 1).otherwise(tiles(F.col("n") - F.col("big.n"), F.col("total") - F.col("big.total"))).alias("tr"))
    rows = common.met(rows, common.cut(sizes), "hub", K * count)
    # tiles below tb hold the largest component, the others the rest
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    within = (F.col("comp") == F.col("big")) & (F.col("tb") > 0)
    rows = rows.withColumn("tile", F.when(within, deal(F.col("tb"))).otherwise(F.col("tb") + deal(F.col("tr"))))
    others = F.when(within, F.sequence("tb", F.col("tb") + F.col("tr") - 1)).otherwise(F.sequence(F.lit(0), F.col("tb") + F.col("tr") - 1))
    spread = rows.withColumn("o", F.explode(others)).select("hub", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "id", "comp", "tile", "own")
    whole = spread.join(features.select("id", "sig").join(sets, "id"), "id")
    return whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def linked(docs: DataFrame, shingle_words: int = 5, percent: int = 80, named: tuple = ()) -> DataFrame:
    """(doc_id, n_shingles, comp, component and the string columns named) for each row of docs (doc_id, text).

    comp numbers the components, component is their smallest doc_id; both null without an id or a word.
    """
    spark = docs.sparkSession
    common.text_batches(spark)
    limit = distance_limit(percent / 100)
    path = common.fresh_path(spark, "shingles")
    schema = ", ".join(["doc_id long, n_shingles long, fp binary, sig binary", *(f"{c} string" for c in named)])
    docs.select("doc_id", "text", *named).mapInPandas(_features(shingle_words, named), schema).write.parquet(path)
    features = spark.read.parquet(path)
    copies = features.where("fp IS NOT NULL AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    sets = common.fresh_path(spark, "sets")
    # one row a distinct set; its number is made and written once
    own = copies.join(features.where("fp IS NOT NULL").select("fp", F.col("doc_id").alias("least"), "n_shingles", "sig"), ["fp", "least"]).dropDuplicates(["fp", "least"])
    own.withColumn("id", F.monotonically_increasing_id()).write.parquet(sets)
    reps = spark.read.parquet(sets)
    count = reps.count()
    members = groups(reps, limit, count)
    common.drop_shuffles(spark)
    grouped = common.cut(reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "fp", F.col("least").alias("doc_id"), "n_shingles", "sig"))
    full = full_sets(grouped.select("id", "fp", "doc_id"), docs, shingle_words)
    links = confirmed(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")), grouped, full, limit, percent)
    found = connected(links)
    common.drop_shuffles(spark)

    def open_groups():
        """Members of groups that still hold several components, with a member drawn from each."""
        m = members.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        split = m.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", "hub"), "id", "comp")).alias("h")).where("lo <> hi")
        return common.met(m, common.cut(split.select("hub", "h", "n")), "hub", K * count)

    pairs = open_groups().where(F.col("comp") != F.col("h.comp")).select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct()
    links = links.union(confirmed(pairs, grouped, full, limit, percent))
    common.drop_shuffles(spark)
    found = connected(links)
    common.drop_shuffles(spark)
    rest = tiled(open_groups().select("hub", "id", "comp"), grouped.select("id", "n_shingles", "sig"), full, percent, count)
    found = connected(links.union(rest.mapInPandas(_tiles(limit, distance_limit(percent / 100, SKETCH, 4), percent), "a long, b long")))
    common.drop_shuffles(spark)
    of_set = common.cut(reps.select("id", "fp", "least").join(found, "id", "left").select("fp", "least", F.coalesce("comp", "id").alias("comp")))
    whole = of_set.join(of_set.groupBy("comp").agg(F.min("least").alias("component")), "comp")
    some = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return features.select("doc_id", "n_shingles", "fp", *named).join(whole, "fp", "left").select("doc_id", "n_shingles", some("comp"), some("component"), *named)


def components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    out = linked(docs, shingle_words, percent).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


SQL = None
