"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a byte trie, held as sorted words with their branch points. The walk
keeps, for each prefix, the last token of its encoding: the longest suffix token that is a valid
neighbour of the last token of the prefix before it. A word's ids are read off by following last tokens
backwards, and a prefix that words share is encoded once. Two neighbours are valid if merging their bytes yields just these two tokens again.
Suffix tokens come from an automaton of the vocabulary. Words of up to LOCKSTEP bytes go down the trie together, level by level,
longer ones depth first.

Texts are split by code points' kinds, many texts at once, as the split pattern would; equal words are encoded once for all of them.
Null and empty texts have no ids. Texts of any length are encoded whole; strings of added tokens become
those tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common

#: The published split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of texts that are encoded together.
SLICE = 8_000_000
#: Words of more bytes are walked one by one.
LOCKSTEP = 64
#: Slots of the table of decided neighbours; a pair takes the place of another one.
SLOTS = 1 << 20
#: Kinds of code points.
SPACE, LETTER, NUMBER, OTHER = range(4)


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary file: printable Latin-1 stands for itself."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def kinds() -> np.ndarray:
    """The kind of each code point by the library's own split, as Unicode versions differ. Beyond plane 3 there are no letters, numbers or white space."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out, every = np.full(0x110000, OTHER, np.uint8), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))
    for _, (a, b) in split(every):
        a += every[a] == " " and b - a > 1  # goes with what follows
        alike = [kind for kind, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(c + every[a])) == 1]
        out[ord(every[a]) : ord(every[b - 1]) + 1] = alike[0] if alike else SPACE
    out[32] = SPACE
    return out


class TrieBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = printable_bytes()
        raw = lambda s: bytes(table[c] for c in s)
        model = spec["model"]
        self.bytes_of = {i: raw(s) for s, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = {}
        self.split = {}
        for rank, (a, b) in enumerate(pairs):
            x, y = self.id_of[raw(a)], self.id_of[raw(b)]
            z = self.id_of[self.bytes_of[x] + self.bytes_of[y]]
            self.merge.setdefault((x, y), (rank, z))
            self.split.setdefault(z, (x, y, rank))
        self.valid: dict[int, bool] = {}
        self.automaton()
        self.unwinding(len(pairs))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kinds = kinds()
        ids = sorted(self.bytes_of)
        self.bytes_at, self.bytes_n = np.zeros(ids[-1] + 1, int), np.zeros(ids[-1] + 1, int)
        self.bytes_n[ids] = [len(self.bytes_of[i]) for i in ids]
        self.bytes_at[ids] = np.cumsum(self.bytes_n[ids]) - self.bytes_n[ids]
        self.all_bytes = np.frombuffer(b"".join([self.bytes_of[i] for i in ids]), np.uint8)
        decimal = [f"{i},".encode() for i in range(ids[-1] + 1)]
        self.decimal_n = np.array([len(d) for d in decimal])
        self.decimal = np.array(decimal).view(np.uint8).reshape(len(decimal), -1)

    def automaton(self) -> None:
        """goes[state, byte]: the state of the longest token prefix that ends there; best[state]: the longest token that ends
        there; shorter[token]: the longest other token at its end, or -1; size[token]: its bytes."""
        tokens = sorted(self.id_of)
        ids, size = np.array([self.id_of[b] for b in tokens]), np.array([len(b) for b in tokens])
        first, data = np.cumsum(size) - size, np.frombuffer(b"".join(tokens), np.uint8)
        at, edges, states = np.zeros(len(tokens), int), [], 1
        for depth in range(size.max()):
            rows = np.flatnonzero(size > depth)
            keys, inverse = np.unique(at[rows] << 8 | data[first[rows] + depth], return_inverse=True)
            at[rows] = states + inverse
            edges.append((states, keys >> 8, keys & 255))
            states += len(keys)
        self.goes, fail, self.best = np.zeros((states, 256), np.int32), np.zeros(states, int), np.full(states, -1)
        self.best[at] = ids
        for a, up, by in edges:
            level = slice(a, a + len(up))
            fail[level] = np.where(up > 0, self.goes[fail[up], by], 0)
            self.goes[up, by] = np.arange(a, a + len(up))
            self.goes[level] = self.goes[fail[level]]
            self.best[level] = np.where(self.best[level] >= 0, self.best[level], self.best[fail[level]])
        self.size, self.shorter = np.zeros(ids.max() + 1, int), np.full(ids.max() + 1, -1)
        self.size[ids], self.shorter[ids] = size, self.best[fail[at]]

    def unwinding(self, n: int) -> None:
        """Tables to test neighbours by undoing merges. That holds where each merge makes a token of its own and every
        token stands alone; regular says whether it is so, else neighbours are merged anew."""
        self.slots, self.says = np.full(SLOTS, -1), np.zeros(SLOTS, bool)
        single = [self.id_of.get(bytes([i])) for i in range(256)]
        self.regular = len(self.split) == len(self.merge) == n and len(self.bytes_of) == len(self.id_of) == n + 256
        if not self.regular or None in single or not self.split.keys().isdisjoint(single):
            self.regular = False
            return
        order = single + sorted(self.split, key=lambda z: self.split[z][2])
        self.place = np.zeros(len(self.size), int)
        self.place[order] = np.arange(n + 256)
        made = self.place[np.array([self.split[z][:2] for z in order[256:]], int).reshape(-1, 2)]
        self.left, self.right = np.concatenate((np.arange(256), made[:, 0])), np.concatenate((np.arange(256), made[:, 1]))
        keys = made[:, 0] << 32 | made[:, 1]
        self.joined = 256 + np.argsort(keys)
        self.keys = np.sort(keys)
        self.regular = n > 0 and bool(self.unwound(made[:, 0], made[:, 1], np.arange(256, n + 256)).all())

    def unwound(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether the tokens at places a and b stay neighbours while merges before limit are made: undoes the later one
        of the two at their border, as long as what meets there was not to be merged before."""
        out, rows = np.zeros(len(a), bool), np.arange(len(a))
        while len(rows):
            keys = a << 32 | b
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            stay = (self.keys[found] != keys) | (self.joined[found] >= limit)
            single = np.maximum(a, b) < 256
            out[rows[stay & single]] = True
            go = stay & ~single
            rows, a, b = rows[go], a[go], b[go]
            last = a > b
            limit = np.where(last, a, b + 1)
            a, b = np.where(last, self.right[a], a), np.where(last, b, self.left[b])
        return out

    def decided(self, keys: np.ndarray) -> np.ndarray:
        """neighbours() of many keys."""
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(int) & SLOTS - 1
        out, miss = self.says[slot], np.flatnonzero(self.slots[slot] != keys)
        if len(miss):
            if self.regular:
                new = keys[miss]
                ok, inner = np.ones(len(new), bool), np.flatnonzero(new >> 32)
                a, b = self.place[(new[inner] >> 32) - 1], self.place[new[inner] & 0xFFFFFFFF]
                ok[inner] = self.unwound(a, b, np.full(len(inner), 1 << 40))
            else:
                ok = np.array([self.neighbours(k) for k in keys[miss].tolist()])
            out[miss] = ok
            slot, keys = slot[miss], keys[miss]
            self.slots[slot] = keys
            mine = self.slots[slot] == keys
            self.says[slot[mine]] = ok[mine]
        return out

    def merges(self, data: bytes) -> list[int]:
        """Merging by rank, for the pair test."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            rank = best[0]
            out, i = [], 0
            while i < len(ids):
                got = self.merge.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if got and got[0] == rank:
                    out.append(got[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def neighbours(self, key: int) -> bool:
        """Whether token key % 2**32 stands alone at a begin (key < 2**32), or may follow token key // 2**32 - 1."""
        a, b = (key >> 32) - 1, key & 0xFFFFFFFF
        if len(self.valid) > 2_000_000:
            self.valid.clear()
        if a < 0:
            ok = self.merges(self.bytes_of[b]) == [b]
        else:
            ok = self.merges(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        self.valid[key] = ok
        return ok

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of distinct words: word i has ids[first[i] : first[i] + count[i]]. In sorted order words are the leaves of their trie from left to right."""
        order = pc.sort_indices(words).to_numpy()
        size = pc.binary_length(words).to_numpy()[order]
        first, count = np.zeros(len(words), int), np.zeros(len(words), int)
        short, long = order[size <= LOCKSTEP], order[size > LOCKSTEP]
        ids, first[short], count[short] = self.together(words.take(pa.array(short)))
        if len(long):
            more = self.depth_first(words.take(pa.array(long)).to_pylist())
            count[long] = [len(m) for m in more]
            first[long] = len(ids) + np.cumsum(count[long]) - count[long]
            ids = np.concatenate((ids, *more))
        return ids, first, count

    def together(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The walk of sorted words level by level; the words below one node lie side by side, the first one leads them."""
        if not len(words):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
        upto, data = (np.frombuffer(b, t) for b, t in zip(words.buffers()[1:], (np.int32, np.uint8)))
        first, size = upto[: len(words)].astype(int), np.diff(upto[: len(words) + 1]).astype(int)
        lasts = np.zeros(upto[len(words)], int)
        rows = np.arange(len(words))
        node, state = np.zeros(len(words), int), np.zeros(len(words), int)
        for depth in range(size.max()):
            on = size[rows] > depth
            rows, node, state = rows[on], node[on], state[on]
            at = first[rows] + depth
            by = data[at]
            leads = np.concatenate(([True], (node[1:] != node[:-1]) | (by[1:] != by[:-1])))
            heads = np.flatnonzero(leads)
            states, ends = self.goes[state[heads], by[heads]], at[heads]
            tokens, open_ = self.best[states], np.arange(len(heads))
            while len(open_):
                token = tokens[open_]
                if token.min() < 0:
                    raise ValueError("a byte without a token")
                n = self.size[token]
                before = np.where(n <= depth, lasts[ends[open_] - n] + 1, 0)
                open_ = open_[~self.decided(before << 32 | token)]
                tokens[open_] = self.shorter[tokens[open_]]
            node = np.cumsum(leads) - 1
            lasts[at], state = tokens[node], states[node]
        read, rows, end = [], np.arange(len(words)), first + size
        while len(rows):
            token = lasts[end[rows] - 1]
            read.append((rows, token))
            end[rows] -= self.size[token]
            rows = rows[end[rows] > first[rows]]
        count = np.bincount(np.concatenate([r for r, _ in read]), minlength=len(words))
        stop = np.cumsum(count)
        ids = np.zeros(stop[-1], int)
        for i, (rows, token) in enumerate(read):
            ids[stop[rows] - 1 - i] = token
        return ids, stop - count, count

    def depth_first(self, words: list[bytes]) -> list[list[int]]:
        """The walk of sorted words one by one: keeps the last tokens of the current path and drops those below the branch to the next word."""
        out, lasts, states, before = [], [], [0], b""
        goes, best, valid, bytes_of = self.goes.item, self.best.item, self.valid.get, self.bytes_of
        for word in words:
            branch, most = 0, min(len(before), len(word))
            while branch < most and before[branch] == word[branch]:
                branch += 1
            del lasts[branch:], states[branch + 1 :]
            for end in range(branch + 1, len(word) + 1):
                states.append(goes(states[-1], word[end - 1]))
                token = best(states[-1])
                while token >= 0:
                    start = end - len(bytes_of[token])
                    key = (lasts[start - 1] + 1 if start else 0) << 32 | token
                    ok = valid(key)
                    if ok if ok is not None else self.neighbours(key):
                        lasts.append(token)
                        break
                    token = self.shorter.item(token)
                else:
                    raise ValueError("a byte without a token")
            ids, end = [], len(word)
            while end:
                ids.append(lasts[end - 1])
                end -= len(bytes_of[lasts[end - 1]])
            out.append(ids[::-1])
            before = word
        return out

    def starts(self, text: str, begins: np.ndarray) -> np.ndarray:
        """Where words begin in texts put together, each beginning at one of begins: the matches of PATTERN in each."""
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kind = self.kinds[code]
        fresh = np.zeros(len(code) + 1, bool)  # a text begins
        fresh[begins] = fresh[-1] = True
        out = fresh[:-1].copy()
        out[1:] |= kind[1:] != kind[:-1]
        solid, begun = kind != SPACE, ~fresh[1:-1]
        out[1:] &= ~(begun & solid[1:] & (code[:-1] == 32))  # a space goes with what follows
        out[:-1] |= begun & solid[1:] & ~solid[:-1]  # white space leaves its last character
        quote = np.flatnonzero(out & (code == 39))
        quote = quote[quote + 1 < len(code)]
        quote = quote[~fresh[quote + 1]]
        one = np.isin(code[quote + 1], [ord(c) for c in "stmd"])
        pair = quote[(quote + 2 < len(code)) & ~one]
        pair = pair[~fresh[pair + 2]]
        pair = pair[np.isin(code[pair + 1] << 8 | code[pair + 2], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]
        for at, n in ((quote[one], 2), (pair, 3)):
            out[at + 1] = False
            out[at[at + n < len(code)] + n] = True
        return np.flatnonzero(out)

    def words(self, texts: list) -> tuple[pa.Array, np.ndarray, list[tuple[int, int]]]:
        """(words, how many each text has, (word, id) of added tokens)."""
        parts, of, added = [], [], []
        for i, text in enumerate(texts):
            for part in self.cut.split(text) if text and any(s in text for s in self.added) else [text]:
                if part:
                    if part in self.added:
                        added.append(len(parts))
                    parts.append(part)
                    of.append(i)
        text = "".join(parts)
        size = np.array([len(p) for p in parts], int)
        begins = np.cumsum(size) - size
        at = self.starts(text, begins) if parts else begins
        for k in added:
            at = at[(at <= begins[k]) | (at >= begins[k] + size[k])]
        owner = np.array(of, int)[np.searchsorted(begins, at, "right") - 1] if parts else at
        marks = [(int(np.searchsorted(at, begins[k])), self.added[parts[k]]) for k in added]
        data, at = text.encode("utf-8", "replace"), np.append(at, len(text))
        if len(data) > len(text):
            code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            at = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)))[at]
        if len(data) >= 1 << 31:
            raise ValueError("texts of 2 GB together")
        words = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        return words, np.bincount(owner, minlength=len(texts)), marks

    def encode_all(self, texts: list) -> Iterator[tuple[str, int, str]]:
        """For each text: decimal ids joined by commas, their number, the text decoded from the ids."""
        words, n_words, added = self.words(texts)
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        ids, first, count = self.encode_words(coded.dictionary)
        if added:
            first, count = np.append(first, len(ids) + np.arange(len(added))), np.append(count, np.ones(len(added), int))
            which = which.copy()
            which[[w for w, _ in added]] = len(coded.dictionary) + np.arange(len(added))
            ids = np.append(ids, [i for _, i in added])
        count = count[which]
        ids = ids[common.ragged(first[which], count)]
        decimal = self.decimal[ids].ravel()
        decimal = decimal[decimal != 0].tobytes().decode("ascii")
        back = self.all_bytes[common.ragged(self.bytes_at[ids], self.bytes_n[ids])].tobytes()
        upto = lambda n, at: np.concatenate(([0], np.cumsum(n)))[at]
        at = upto(count, upto(n_words, np.arange(len(texts) + 1)))
        decimal_at, back_at = upto(self.decimal_n[ids], at).tolist(), upto(self.bytes_n[ids], at).tolist()
        for i, n in enumerate(np.diff(at).tolist()):
            yield decimal[decimal_at[i] : max(decimal_at[i + 1] - 1, decimal_at[i])], n, back[back_at[i] : back_at[i + 1]].decode("utf-8", "replace")


#: A worker's encoders stay for its next tasks.
_READY: dict[str, TrieBPE] = {}


def coder(path: str):
    def run(batches):
        if path not in _READY:
            _READY[path] = TrieBPE(path)
        bpe = _READY[path]
        for batch in common.gathered(batches, limit=SLICE):
            out, texts = [], batch["text"].tolist()
            for a, b in common.slices(texts, SLICE):
                for doc, (ids, n, back) in zip(batch["doc_id"][a:b], bpe.encode_all(texts[a:b])):
                    out.append((doc, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    common.text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(coder(tokenizer_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


SQL = None
