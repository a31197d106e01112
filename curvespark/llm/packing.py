"""Hierarchical multi-length packing.

Tiers are context sizes, powers of two from LEAST up to the window. A document that fits the window is routed to the smallest
tier that holds it; a longer one is held in reserve. Tiers are packed from the longest, each at its own length: a
sequence begins with the longest document left in its tier, and its gap is filled with whole documents of
shorter tiers, one or two that fill it exactly where there are such, else the longest that fits. What is then
missing is cut from the reserve, so that documents which fit a window stay whole; where the reserve is spent, from
the shortest document that covers it. The rest of the reserve fills windows of its own. What a block
leaves at its end is cut into powers of two, so no sequence is padded. step_group deals a block's sequences, longest
first, each to the step with the least tokens, so steps of unequal sequences carry equal loads.

Every task packs the documents of its own input split, block by block of block_tokens ids: no shuffle, and a
retried task packs alike. sequence_id = split << 32 | count. Null texts are empty and have the end id only.
Repeated ids are packed as they come. The result depends on how the input is split; it is a whole and
gapless packing for every split.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common

WINDOW, LEAST, BLOCK_TOKENS, STEP = 2048, 128, 4_000_000, 8
#: Characters of texts that are encoded together.
SLICE = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Words that an encoder keeps, twice over at most; fewer take less memory and more time.
CACHE = 400_000
#: Marks that form a piece of their own after a word's letters.
TAIL = ".,!?;:|*$#%&"
#: The tokenizer's white space; str.split also takes U+001C to U+001F, which have ids.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")


def letters(word: str) -> bool:
    """Whether the tokenizer takes the word as one piece; U+0130 becomes a letter and a mark when lowered."""
    return word.isalpha() and "\u0130" not in word


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never cross white space: each distinct word is encoded once, for all texts at hand."""

    def __init__(self, path: str, end_id: int = 1, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.cache = cache
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], "<u4")
        suffix, self.ends = getattr(self.tokenizer.model, "end_of_word_suffix", None), None
        if suffix:
            tokens = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(tokens.values()) + 1, bool)
            self.ends[[i for t, i in tokens.items() if t.endswith(suffix)]] = True
        self.kinds = bpe.kinds()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list) -> list[np.ndarray]:
        """Each text's ids and the end id."""
        out, plain, rows = [self.end] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                out[i] = np.concatenate((ids, self.end))
                continue
            low = text.lower()
            # case only differs by single letters, but for these two; the tokenizer composes (NFC) before it lowers,
            # so where either form would still compose, the words are left to it as they are
            if text.isascii() or unicodedata.is_normalized("NFC", low) and unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text:
                plain.append(low)
                rows.append(i)
            else:
                words = [w for w in SPACE.split(text) if w] if ODD.search(text) else text.split()
                known = dict(zip(distinct := list(set(words)), self.learned(distinct)))
                out[i] = np.concatenate((np.frombuffer(b"".join([known[w] for w in words]), "<u4"), self.end))
        if plain:
            coded, counts = self.cut(plain)
            ids, which = self.learned(coded.dictionary.cast(pa.large_string()).to_pylist()), coded.indices.to_numpy()
            size = np.array([len(b) for b in ids], int) // 4
            count = size[which]
            tokens = np.frombuffer(b"".join(ids), "<u4")[common.ragged((np.cumsum(size) - size)[which], count)]
            upto = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            for i, a, b in zip(rows, upto, upto[1:]):
                out[i] = np.concatenate((tokens[a:b], self.end))
        return out

    def cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces that the tokenizer encodes on their own, of lowered texts, and how many each text has: letters, a
        number's digit, other marks, or an apostrophe with what it shortens."""
        code = np.frombuffer("\n".join([*texts, "\n\n"]).encode("utf-32-le"), np.uint32)
        kind = self.kinds[code]
        begins = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == bpe.NUMBER))) & (kind != bpe.SPACE)
        quote = np.flatnonzero(begins & (code == 39))
        one = np.isin(code[quote + 1], [ord(c) for c in "stmd"])
        pair = quote[~one & (code[quote + 1] < 128)]
        pair = pair[np.isin(code[pair + 1] << 8 | code[pair + 2], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]
        for at, n in ((quote[one], 2), (pair, 3)):
            begins[at + 1] = False
            begins[at + n] |= kind[at + n] == bpe.LETTER
        ends = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)
        solid = kind != bpe.SPACE
        code, at = code[solid], np.flatnonzero(begins[solid])
        at = np.append(at, len(code))
        if len(code) and code.max() > 127:
            at = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)))[at]
        data = code.tobytes().decode("utf-32-le").encode()
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        return pieces.dictionary_encode(), counts

    def learned(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > self.cache:
            self.older, self.known = self.known, {}
        known, older, new, split = self.known, self.older, set(), []
        for w in parts:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                elif letters(w):
                    new.add(w)
                else:
                    core = w.rstrip(TAIL)
                    split.append((w, core))
                    tail = w[len(core) :]
                    if core and tail and tail not in self.tails:
                        self.tails[tail] = self.one(tail)
                    if letters(core) and core not in known:
                        new.add(core)
        if new:  # letters are one piece each, so the pieces of a joined text are the words
            words = list(new)
            ids, at = self.pieces(" ".join(words))
            if len(at) == len(words) + 1:
                ids = ids.tobytes()
                known.update((w, ids[4 * a : 4 * b]) for w, a, b in zip(words, at, at[1:]))
            else:
                known.update((w, self.one(w)) for w in words)
        for w, core in split:
            known[w] = known[core] + self.tails[w[len(core) :]] if letters(core) and w != core else self.one(w)
        return [known[w] for w in parts]

    def pieces(self, text: str) -> tuple[np.ndarray, list[int]]:
        """A text's ids and where its pieces begin and end. Where tokens say that they end a piece, the library need not keep track of it."""
        if self.ends is None:
            e = self.tokenizer.encode(text, add_special_tokens=False)
            return np.array(e.ids, "<u4"), np.flatnonzero(np.diff(np.array(e.word_ids, int), prepend=-1, append=-1)).tolist()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return ids, [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]

    def one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


class Pool:
    """Whole documents by length, and the reserve: documents that are cut anyway."""

    def __init__(self, lengths, window: int):
        self.lengths, self.by_length, self.have = lengths, [[] for _ in range(window + 1)], np.zeros(window + 1, dtype=bool)
        self.reserve, self.spare = [], 0  # (document, next start), taken from the end
        for i, n in enumerate(lengths):
            if n > window:
                self.reserve.append((i, 0))
                self.spare += int(n)
            elif n:
                self.by_length[n].append(i)
                self.have[n] = True

    def take(self, n: int) -> tuple[int, int, int]:
        i = self.by_length[n].pop()
        self.have[n] = bool(self.by_length[n])
        return i, 0, n

    def longest(self, most: int, over: int = 0) -> int:
        """Length of the longest document of over < length <= most; 0 if none."""
        found = np.flatnonzero(self.have[over + 1 : most + 1])
        return over + 1 + int(found[-1]) if len(found) else 0

    def pair(self, gap: int) -> int:
        """A length whose documents fill the gap with another one's; 0 if none."""
        both = self.have[1 : gap // 2 + 1] & self.have[gap - 1 : gap - gap // 2 - 1 : -1]
        if gap % 2 == 0 and len(both) and len(self.by_length[gap // 2]) < 2:
            both[-1] = False
        found = np.flatnonzero(both)
        return 1 + int(found[0]) if len(found) else 0

    def fill(self, gap: int) -> list[tuple[int, int, int]]:
        """Whole documents of at most gap tokens together."""
        out = []
        while gap:
            if self.have[gap]:
                return [*out, self.take(gap)]
            if a := self.pair(gap):
                return [*out, self.take(a), self.take(gap - a)]
            if not (n := self.longest(gap)):
                break
            out.append(self.take(n))
            gap -= n
        return out

    def cut(self, gap: int) -> list[tuple[int, int, int]]:
        """Pieces of gap tokens together, or all there are: from the reserve, else from the shortest document that is longer."""
        out = []
        while gap:
            if not self.reserve:
                longer = np.flatnonzero(self.have[gap:])
                n = gap + int(longer[0]) if len(longer) else self.longest(gap)
                if not n:
                    break
                self.reserve.append((self.take(n)[0], 0))
                self.spare += n
            i, start = self.reserve.pop()
            n = min(gap, int(self.lengths[i]) - start)
            out.append((i, start, n))
            gap, self.spare = gap - n, self.spare - n
            if start + n < self.lengths[i]:
                self.reserve.append((i, start + n))
        return out


def plan(lengths: np.ndarray, window: int = WINDOW, least: int = LEAST) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces (document, start, length)) of every sequence, for documents of these lengths."""
    pool, out, tier = Pool(lengths, window), [], window

    def close(size: int, pieces: list) -> None:
        """Pieces of size tokens are a sequence; fewer, at the block's end, are cut into powers of two."""
        left = sum(p[2] for p in pieces)
        while pieces:
            size = min(size, 1 << left.bit_length() - 1)
            part, need = [], size
            while need:
                i, start, n = pieces.pop(0)
                part.append((i, start, min(n, need)))
                if n > need:
                    pieces.insert(0, (i, start + need, n - need))
                need -= part[-1][2]
            out.append((size, part))
            left -= size

    while tier:
        over = tier // 2 if tier > least else 0
        while n := pool.longest(tier, over):
            pieces = [pool.take(n)]
            pieces += pool.fill(tier - n)
            pieces += pool.cut(tier - sum(p[2] for p in pieces))
            close(tier, pieces)
        tier = tier // 2 if tier > least else 0
    while pool.spare:
        close(window, pool.cut(window))
    return out


#: A worker's encoders stay for its next tasks.
_READY: dict[tuple[str, int, int], WordEncoder] = {}


def packer(path: str, window: int = WINDOW, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, cache: int = CACHE):
    def run(batches):
        from pyspark import TaskContext

        if (path, end_id, cache) not in _READY:
            _READY[path, end_id, cache] = WordEncoder(path, end_id, cache)
        encode = _READY[path, end_id, cache]
        base, count = TaskContext.get().partitionId() << 32, 0

        def flush(held):
            nonlocal count
            planned, out = plan(np.array([len(ids) for _, ids in held]), window), []
            loads = [(0, g) for g in range(max(1, sum(len(ids) for _, ids in held) // (window * STEP)))]
            for tier, seq in sorted(planned, key=lambda s: -s[0]):
                load, group = heapq.heappop(loads)
                heapq.heappush(loads, (load + tier, group))
                offset = 0
                for i, start, n in seq:
                    doc, ids = held[i]
                    out.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), base + count, offset, tier, base + group))
                    offset += n
                count += 1
            return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        held, total = [], 0
        for batch in common.gathered(batches, limit=SLICE):
            texts = batch["text"].tolist()
            for a, b in common.slices(texts, SLICE):
                for doc, ids in zip(batch["doc_id"][a:b], encode.many(texts[a:b])):
                    held.append((doc, ids))
                    total += len(ids)
                    if total >= block_tokens:
                        yield flush(held)
                        held, total = [], 0
        if held:
            yield flush(held)

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, cache: int = CACHE) -> DataFrame:
    """One row for each piece of each document (doc_id, text): SCHEMA."""
    common.text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(packer(tokenizer_path, window, end_id, cache=cache), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


SQL = None
