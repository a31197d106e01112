"""Training-data operators against brute force, and on nulls, empties, long texts, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [make(rng.randint(3, 200)) for _ in range(40)]
    near = [" ".join(w if i != 50 else "CHANGED" for i, w in enumerate(make(0).split() or t.split())) for t in base[:20]]
    return base + near + base[:5] + [None, "", " \n\t", "one", "Two words", "ümlaut ß Ünïcode x", "!!! ???", make(30_000), "a b c a b c a b c\nline\nline\n\n", "<|endoftext|> it's \U0001f600"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x" if i % 2 else "y", None, None, 0.0, "k") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [(None, "no id at all", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_force_tree(words: dict, train: list, split: int = 1 << 40):
    """(scores, contexts retained by length) of texts given as token lists: every count in a dictionary."""
    from curvespark.llm import suffix_tree as st

    counts = [Counter() for _ in range(st.DEPTH + 1)]
    for i in train:
        for at in range(len(words[i])):
            for d in range(min(at, st.DEPTH) + 1):
                counts[d][tuple(words[i][at - d : at + 1])] += 1
    n, new = sum(counts[0].values()), (sum(c == 1 for c in counts[0].values()) + 0.5) / (sum(counts[0].values()) + 1)
    states = [{} for _ in range(st.DEPTH + 1)]
    follow = [{} for _ in range(st.DEPTH + 1)]
    for d in range(1, st.DEPTH + 1):
        for gram, c in counts[d].items():
            follow[d].setdefault(gram[:-1], {})[gram[-1]] = c

    def p(context, w):
        if not context:
            return (1 - new) * counts[0][w,] / n if counts[0][w,] else new
        below = p(context[1:], w)
        if context not in states[len(context)]:
            return below
        return (follow[len(context)][context].get(w, 0) + st.KAPPA * below) / (states[len(context)][context] + st.KAPPA)

    for d in range(1, st.DEPTH + 1):
        for context, after in follow[d].items():
            m = sum(after.values())
            gain = sum(c * math.log(((c - 1) / p(context[1:], w) + st.KAPPA) / (m - 1 + st.KAPPA)) for w, c in after.items())
            if m >= split or m >= st.EVIDENCE and gain > st.GAIN:
                states[d][context] = m
    return {i: sum(math.log10(p(tuple(ws[max(0, at - st.DEPTH) : at]), w)) for at, w in enumerate(ws)) for i, ws in words.items()}, [len(s) for s in states]


@pytest.mark.parametrize("split", [1 << 40, 50])
def test_suffix_tree(spark, empty, split):
    from pyspark.sql import functions as F

    from curvespark.llm import common, suffix_tree

    rng = random.Random(12)
    passage = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "pi"], k=30))
    said = [x if x is None or i % 5 else f"{passage} {x}" for i, x in enumerate(texts())] + ["the end of the line " * 20, passage, passage.upper(), passage]
    docs = spark.createDataFrame([(i, x, "x", None, None, 0.0, "k") for i, x in enumerate(said)] + [(None, "no id at all", None, None, None, None, None), (0, said[0], None, None, None, None, None)], SCHEMA)
    held = common.crc_mod("doc_id", 7) == 2
    rows = suffix_tree.score(docs, ~held, split=split).collect()
    got = {r["doc_id"]: r for r in rows}
    words = {i: WORD.findall((t or "").translate(LOW)) + ["<end>"] for i, t in enumerate(said)}
    learned = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    learned += [0] * (0 in learned)  # the repeated row counts twice
    train = Counter(w for i in learned for w in words[i])
    n, v = sum(train.values()), len(train)
    assert len(rows) == len(words) + 2
    want, states = brute_force_tree(words, learned, split)
    assert states[1] >= 5 and states[2] >= 5
    for i, ws in words.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(w in train for w in ws), n)
        assert math.isclose(got[i]["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(got[i]["score"], want[i], rel_tol=1e-9), (i, got[i]["score"], want[i])
    assert sum(got[i]["score"] for i in words) > sum(got[i]["base_score"] for i in words)
    assert suffix_tree.score(empty, F.lit(True)).count() == 0
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in suffix_tree.score(docs.limit(5), F.lit(False)).collect())


def test_suffix_tree_states_sum_to_one():
    from curvespark.llm import suffix_tree as st

    words = {0: "a b a b a b c d".split() * 20, 1: "x y z a b".split()}
    train = [0, 1]
    scores, states = brute_force_tree(words, train)
    known = sorted({w for ws in words.values() for w in ws})
    for before in ([], ["a"], ["a", "b"], ["q"]):  # probabilities of all next tokens after the same beginning, the unknown word among them
        both, _ = brute_force_tree({**words, **{i + 2: before + [w] for i, w in enumerate(known + ["never"])}, 99: before + [], }, train)
        assert math.isclose(sum(10 ** (both[i + 2] - both[99]) for i in range(len(known) + 1)), 1, rel_tol=1e-9)
    assert states[1] and scores[0] < 0 and st.DEPTH == 2


def test_licences(spark, docs, empty):
    from curvespark.llm import licences

    seen = licences.Recogniser()
    one = lambda t: [m[0] for m in seen.matches(t)]
    assert one("x y.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.") == ["MIT", "CC-BY-NC-4.0"]
    apache = ("Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in\n * compliance with the License.\n * You may obtain a copy of the License at\n *\n *   http://x.org/licenses\n *\n"
              " * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an \"AS IS\" BASIS,\n * WITHOUT WARRANTIES")
    assert [(m[0], m[3]) for m in seen.matches("/* Copyright X.\n * " + apache + " */")] == [("Apache-2.0", 4)]
    assert one(None) == one("") == one("we never released under the mit license") == one("x is licensed under the mit license") == []
    # long runs of separators before a sentence
    assert one("x." + " " * 80 + "Licensed under the MIT License.") == one("/" + "*" * 300 + " Released under the MIT License") == one("a\n" + " " * 200 + "Released under the MIT license") == ["MIT"]
    # a rule does not reach over many sentences; its parts then stand alone
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Redistributions of source code must retain the above copyright notice.", "Redistributions in binary form must reproduce the above copyright notice.",
           "This software is provided by the copyright holders and contributors \"as is\"."]
    filler = lambda n: "Nothing here. " * n
    assert one(f" {filler(8)}".join(bsd)) == ["BSD-2-Clause"] and one(f" {filler(9)}".join(bsd)) == []
    assert [(m[2], m[4]) for m in seen.matches("One. Two!\nThree\n\nReleased under the MIT License.")] == [(3, 17)]
    assert licences.scan(docs).count() == 0 and licences.scan(empty).count() == 0
    twice = spark.createDataFrame([(1, "Released under the MIT License.", "x")] * 2 + [(None, "Released under the MIT License.", None)], "doc_id long, text string, licence string")
    assert sorted((r["doc_id"] or 0, r["licence"]) for r in licences.scan(twice).collect()) == [(0, "MIT"), (1, "MIT"), (1, "MIT")]


def test_licences_like_brute_force():
    """Every start of a sentence against every known sentence and rule, words taken one at a time."""
    from curvespark.llm import licences

    rng = random.Random(10)
    known = licences.known_sentences()
    rules = (*licences.RULES, *((n, (f"named:{n}",)) for n in licences.NAMES))
    plain = ["Nothing of note", "the license is here", "licensed under", "You may obtain", "neither of them", "a b c"]
    seen = licences.Recogniser()
    hits = 0
    for _ in range(300):
        said = []  # (words, ends its sentence)
        for _ in range(rng.randrange(1, 12)):
            words = list(rng.choice(list(known))) if rng.random() < 0.6 else rng.choice(plain).split()
            said.append(words + (["extra"] if rng.random() < 0.2 else []))
        if rng.random() < 0.5:
            said += [next(list(w) for w, n in known.items() if n == part) for part in rng.choice(rules)[1]]
        text = "".join(" ".join(w.upper() if rng.random() < 0.2 else w for w in words) + rng.choice([". ", "; ", ".\n", "!  "]) for words in said)
        found = []
        for i, words in enumerate(said):
            low = [w.lower() for w in words]
            fits = [k for k in known if tuple(low[: len(k)]) == k]
            if fits:
                found.append((i, known[max(fits, key=len)]))
        want, at = [], 0
        while at < len(found):
            best = max((r for r in rules if tuple(n for _, n in found[at : at + len(r[1])]) == r[1] and all(b[0] - a[0] <= licences.GAP + 1 for a, b in zip(found[at:], found[at + 1 : at + len(r[1])]))), key=lambda r: len(r[1]), default=None)
            if best:
                want.append((best[0], found[at][0], len(best[1])))
            at += len(best[1]) if best else 1
        got = [(m[0], m[2], m[3]) for m in seen.matches(text)]
        assert got == want, text
        hits += len(got)
    assert hits > 200


def test_language(spark, empty):
    from curvespark.llm import language

    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    say = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(n))
    rows = [(i, say(lang, 80), lang) for i, lang in enumerate(["aa", "bb"] * 10)]
    extra = [(100, None, None), (101, "123 ...", "aa"), (102, say("aa", 100) + " " + say("bb", 60), None), (103, "", None), (103, say("bb", 20000), None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["n_langs"]) for r in language.identify(docs, docs.where("doc_id < 20")).collect()]
    assert all(p == letters_of for (i, p, _, _), letters_of in zip(sorted(got)[:20], ["aa", "bb"] * 10))
    by = {g[0]: g for g in got}
    assert by[100][1:3] == ("und", 0.0) and by[101][1] == "und" and by[102][1] == "aa" and by[102][3] == 2 and 0.5 < by[102][2] < 0.75
    assert sorted(g[1] for g in got if g[0] == 103) == ["bb", "und"]
    assert language.identify(docs, empty).where("lang_pred <> 'und'").count() == 0 and language.identify(empty, docs).count() == 0


def test_language_mixtures_like_brute_force():
    """EM over dictionaries, one document at a time; the set grows in the order of the full fit while the penalised likelihood rises."""
    from curvespark.llm import language

    rng = random.Random(14)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "xyzuvw"}
    say = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(n))
    train = {lang: language.grams([say(lang, 400)])[0] + 0.5 for lang in letters}
    log_p = np.log(np.array([c / c.sum() for c in train.values()]))
    texts = [say("aa", 40), say("aa", 30) + " " + say("cc", 25), say("bb", 3), say("aa", 20) + say("bb", 20) + say("cc", 20), "x", "", None, "12 3", say("cc", 200) + " " + say("bb", 8)]
    got, has = language.infer(texts, log_p)

    def em(counts, which, rounds):
        pi = {k: 1 / len(which) for k in which}
        for _ in range(rounds):
            new = dict.fromkeys(which, 0.0)
            for x, c in counts.items():
                mix = sum(pi[k] * math.exp(log_p[k][x]) for k in which)
                for k in which:
                    new[k] += c * pi[k] * math.exp(log_p[k][x]) / mix
            pi = {k: v / sum(counts.values()) for k, v in new.items()}
        return pi, sum(c * math.log(sum(pi[k] * math.exp(log_p[k][x]) for k in which)) for x, c in counts.items())

    sizes = set()
    for i, text in enumerate(texts):
        counts = {int(x): int(c) for x, c in enumerate(language.grams([text])[0]) if c}
        assert has[i] == bool(counts)
        if not counts:
            assert (got[i] == 0).all()
            continue
        n = sum(counts.values())
        single = [sum(c * log_p[k][x] for x, c in counts.items()) / 3 for k in range(3)]
        best, pi = max(single), {int(np.argmax(single)): 1.0}
        full, _ = em(counts, range(3), 12)
        order = sorted(range(3), key=lambda k: -full[k])
        for size in (2, 3):
            fit, ll = em(counts, order[:size], 24)
            if ll / 3 - (size - 1) * 0.5 * math.log(max(n / 3, 2)) <= best:
                break
            best, pi = ll / 3 - (size - 1) * 0.5 * math.log(max(n / 3, 2)), fit
        assert np.allclose(got[i], [pi.get(k, 0.0) for k in range(3)], atol=1e-9), text
        sizes.add(len(pi))
    assert sizes >= {1, 2}


@pytest.mark.parametrize("size,percent,tight", [(3, 85, False), (5, 80, False), (3, 85, True)])
def test_near_duplicates(spark, docs, empty, monkeypatch, size, percent, tight):
    from curvespark.llm import common, neardup

    if tight:  # keys and hubs are hot at once, groups take several tiles
        for module, name, value in ((common, "HOT_ROWS", 2), (neardup, "TILE", 3), (neardup, "SENT_IDS", 1)):
            monkeypatch.setattr(module, name, value)
    got = {r["doc_id"]: r for r in neardup.components(docs, size, percent).collect()}
    sets, up = {}, {}
    for i, t in enumerate(texts()):
        w = WORD.findall((t or "").translate(LOW))
        sets[i], up[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()), i
    top = lambda i: i if up[i] == i else top(up[i])
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert all((got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), top(i), top(i) == i) for i in sets)
    if not tight:
        assert neardup.components(empty, size, percent).count() == 0


def test_near_duplicates_whose_links_form_chains(spark, monkeypatch):
    """A group of copies at all distances from their source: few link with the hub, some only with each other, some with none."""
    from curvespark.llm import common, neardup

    monkeypatch.setattr(neardup, "TILE", 16)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(13)
    source = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for i in range(90):
        words = list(source)
        for at in rng.sample(range(150), rng.choice((0, 1, 2, 3, 4, 5, 6, 8, 12))):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    up = list(range(90))
    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if u == b else u for u in up]
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert [got[i] for i in range(90)] == up and 2 < len(set(up)) < 60


def test_own_shingles(spark):
    from curvespark.llm import neardup

    sets = [(1, [1, 2, 3, 4]), (2, [3, 4, 5]), (3, [9]), (4, [3])]
    df = spark.createDataFrame([(i, bytearray(neardup.packed(np.array(s, np.uint64)))) for i, s in sets], "id long, members binary")
    assert {r["id"]: r["own"] for r in neardup.own_shingles(df).collect()} == {1: 2, 2: 1, 3: 1}


def test_near_duplicates_of_an_id_with_two_texts(spark):
    from curvespark.llm import neardup

    rng = random.Random(8)
    a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(150)] for c in "ab")
    near = lambda w: " ".join(w[:-1] + ["other"])
    a, near_a, b, near_b = " ".join(a), near(a), " ".join(b), near(b)
    rows = [(1, a), (1, b), (5, a), (6, b), (7, near_a), (8, near_b), (3, near_b), (None, a)]
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (3, 1, False), (5, 1, False), (6, 1, False), (7, 1, False), (8, 1, False)]


def test_pigeonhole():
    from curvespark.llm import neardup

    limit = neardup.distance_limit(0.85)
    rng = np.random.default_rng(2)
    for _ in range(300):
        wrong = set(rng.choice(neardup.K, limit, replace=False).tolist())
        assert min(len(wrong & set(c.tolist())) for c in neardup.chunks(limit)) <= 1


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from curvespark.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs.where("doc_id IS NOT NULL"), path).collect()
    t = Tokenizer.from_file(path)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in enumerate(texts())}
    seen, fill = {i: 0 for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(ids[i]) for i in ids)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(empty, path).count() == 0


def test_packing_encodes_like_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from curvespark.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    t, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    odd = ["abc\x1cdef \x1c x", "\x1d\x1e \x1f", "a\x85b\u3000c\u2003\x1fd", "J\u030c H\u0331 T\u0308 j\u030c", "E\u0301 e\u0301 \u212b", "\u03a3\u0391\u03a3 \u0130x I\u0307", "J\u030c. (J\u030c) 1J\u030c\x1c,", "\u0130$ \u0130."]
    rng = random.Random(7)
    pools = ["abcDEF ghi.,!?;:|*$#%&'\"<>()-_0123 \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0", "".join(map(chr, range(0x20, 0x250))), "".join(map(chr, [*range(0x300, 0x370), *range(0x391, 0x3FF)])) + "\u0130\u03a3aeiou ",
             "".join(map(chr, range(0x1E00, 0x2070))), "".join(chr(rng.randrange(0x110000)) for _ in range(3000)).encode("utf-8", "ignore").decode(), "\u6f22\u5b57 \ud55c\uad6d\U0001f600 \u00e9 e\u0301"]
    any_of = ["".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else rng.choice([" ", "the", "THE ", "won't ", "<|endoftext|>", "1st ", "\u0130", "\u03a3", "\u01c5"]) for _ in range(rng.randrange(1, 25))) for _ in range(20_000)]
    for x in [*odd, "plain Words. " + " | ".join(odd), *any_of]:
        assert encode(x).tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], x


def test_packing_encodes_texts_together(monkeypatch):
    import pandas as pd
    import public_tokenizers
    import pyspark
    from tokenizers import Tokenizer

    from curvespark.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    t, encode, calls = Tokenizer.from_file(path), packing.WordEncoder(path), []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(t, name)

    encode.tokenizer = Counted()
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(5)) + "." for _ in range(300)]
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)})))
    monkeypatch.setitem(packing._READY, (path, 1, packing.CACHE), encode)
    out = pd.concat(packing.packer(path)(iter([pd.DataFrame({"doc_id": range(300), "text": texts})])))
    assert len(calls) < 10
    assert out.groupby("doc_id").length.sum().tolist() == [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts]
    pools = ["abc DEF'.,! 12", "'stmdrevl SLREx' ", "'\u0665\u00b2\u2167x \n\t\x1c\x85\u00e9\u00dc", "".join(map(chr, range(0x20, 0x250))), "\u6f22\ud55c\U0001f600\u0301\u03a3\u0130\u0394", "\ua7ce\U00010940\ua7cb\U00010d50"]
    odd = ["".join(rng.choice(rng.choice(pools)) if rng.random() < 0.95 else rng.choice(["<|endoftext|>", "we'll ", "I'VE"]) for _ in range(rng.randrange(25))) for _ in range(6000)] + [None, "", " ", "'", "'l", "x'r", "'s"]
    for x, ids in zip(odd, packing.WordEncoder(path).many(odd), strict=True):
        assert ids.tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1], x


def test_packing_tiers_gaps_and_steps():
    import pandas as pd
    import public_tokenizers

    from curvespark.llm import packing

    rng = np.random.default_rng(4)
    lengths = np.concatenate((rng.lognormal(6, 1.1, 2000).astype(int) + 1, [2048, 2049, 4096, 40_000, 1]))
    planned, pieces = packing.plan(lengths), {}
    for tier, seq in planned:
        assert sum(n for _, _, n in seq) == tier and tier & (tier - 1) == 0
        for i, start, n in seq:
            pieces.setdefault(i, []).append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, m in sorted(pieces[i]):
            assert start == at and m > 0
            at += m
        assert at == n
    tiers = Counter(t for t, _ in planned)
    assert min(tiers[t] for t in (2048, 1024, 512)) > 20
    for tier, seq in planned:  # a tier's own document comes first, shorter tiers fill its gap
        if tier >= packing.LEAST and seq[0][2] == lengths[seq[0][0]] <= packing.WINDOW:
            assert tier // 2 < seq[0][2] <= tier or tier == packing.LEAST
    cut = [i for i, n in enumerate(lengths) if n <= packing.WINDOW and len(pieces[i]) > 1]
    assert len(cut) <= 0.01 * len(lengths)
    assert packing.plan(np.array([], int)) == [] and sum(n for t, s in packing.plan(np.array([5000])) for _, _, n in s) == 5000
    texts = [" ".join(rng.choice(["red", "green", "blue"], int(n))) for n in lengths[:1500]]
    import pyspark

    before, pyspark.TaskContext.get = pyspark.TaskContext.get, staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))
    try:
        out = pd.concat(packing.packer(public_tokenizers.path("word_bpe_49k.json"))(iter([pd.DataFrame({"doc_id": range(1500), "text": texts})])))
    finally:
        pyspark.TaskContext.get = before
    sizes = out.groupby(["step_group", "sequence_id"]).length.sum()
    loads = sizes.groupby("step_group").sum()
    assert (sizes == out.groupby(["step_group", "sequence_id"]).tier.first()).all()
    assert len(loads) > 3 and loads.max() - loads.min() <= packing.WINDOW and sizes.nunique() > 2


def test_bpe(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from curvespark.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, path).collect()}
    t = Tokenizer.from_file(path)
    for i, x in enumerate(texts()):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_encodes_like_the_library_without_merging_anew(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from curvespark.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, coder, slow = Tokenizer.from_file(path), bpe.TrieBPE(path), bpe.TrieBPE(path)
    slow.regular = False
    rng = random.Random(3)
    pools = ["abc DEF ghi.,!?;:'s 're|*$#%&0123 \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0", " \n\t  ab'", "'stmdrevl S ", "".join(map(chr, range(0x20, 0x250))), "".join(map(chr, range(0x1E00, 0x2070))),
             "".join(chr(rng.randrange(0x110000)) for _ in range(3000)).encode("utf-8", "ignore").decode(), "\u6f22\u5b57 \ud55c\uad6d\U0001f600 \u00e9 e\u0301"]
    any_of = ["".join(rng.choice(rng.choice(pools)) if rng.random() < 0.85 else rng.choice([" ", "the", " THE", "won't ", "<|endoftext|>", "1st ", "   "]) for _ in range(rng.randrange(30))) for _ in range(8000)]
    any_of += ["".join(rng.choice(pools[1]) for _ in range(rng.randrange(9))) for _ in range(4000)]
    any_of += ["".join(rng.choice("abcdeABC") for _ in range(n)) for n in (63, 64, 65, 300, 3000)] + ["ab" * 500, "=" * 3000, "\xc3" * 70, "<|endoftext|>", "<|endoftext|>" * 3 + " x", None, ""]
    want = [want_of(t, x or "") for x in any_of]
    assert list(slow.encode_all(any_of[:500])) == want[:500]
    merged = []
    monkeypatch.setattr(bpe.TrieBPE, "merges", lambda self, data, merges=bpe.TrieBPE.merges: merged.append(data) or merges(self, data))
    short = [(x, w) for x, w in zip(any_of, want) if len((x or "").encode()) <= 64]
    assert list(coder.encode_all([x for x, _ in short])) == [w for _, w in short] and not merged  # 64: words of more bytes are walked one by one
    assert list(coder.encode_all(any_of)) == want
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    begins = np.sort([a for _, (a, _) in t.pre_tokenizer.pre_tokenize_str(every)])
    assert np.array_equal(coder.starts(every, np.array([0])), begins)
    assert list(coder.encode_all(["a" * 100])) == [want_of(t, "a" * 100)] and list(coder.encode_all([None])) == [("", 0, "")] and list(coder.encode_all([])) == []


def want_of(t, text):
    ids = t.encode(text, add_special_tokens=False).ids
    return ",".join(map(str, ids)), len(ids), t.decode(ids, skip_special_tokens=False)


def test_toxicity(spark, empty):
    from curvespark.llm import toxicity

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=4)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=50)) + (" vilest" if i % 4 == 0 else ""), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows[:200]] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, labels).collect()}
    assert sum(got[i] != t for i, _, t in rows) <= 4 and not got[900] and not got[901]
    assert toxicity.score(docs, labels.limit(0)).where("toxic").count() == 0


def test_toxicity_chain_like_brute_force():
    """The chain on dense matrices, a column a word: fold models, out-of-fold probabilities, the next link."""
    from curvespark.llm import toxicity as tx

    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=12) + ["poor"] * (i % 3 == 0) + ["vile"] * (i % 4 == 0)) for i in range(240)]
    labels = np.array([[i % 3 == 0, i % 4 == 0] for i in range(240)], float)
    names = sorted({w for t in texts for w in t.split()})
    x = np.array([[w in t.split() for w in names] for t in texts], float)

    def fitted(x, y, extra):
        pos, neg = max(y.sum(), 1), max((1 - y).sum(), 1)
        a, b, share = x.T @ y, x.T @ (1 - y), x.mean(axis=0)
        keep = (a / pos - b / neg) ** 2 / np.maximum(share * (1 - share) * (1 / pos + 1 / neg), 1e-12) > tx.CHI2
        z = np.column_stack((x[:, keep], extra, np.ones(len(x))))
        w, g2 = np.zeros(z.shape[1]), np.full(z.shape[1], 1e-8)
        for _ in range(80):
            grad = z.T @ ((1 / (1 + np.exp(-np.clip(z @ w, -30, 30))) - y) * np.where(y > 0, 0.5 / pos, 0.5 / neg))
            g2 += grad**2
            w -= 0.5 * grad / np.sqrt(g2)
        return lambda x, extra: 1 / (1 + np.exp(-np.clip(np.column_stack((x[:, keep], extra, np.ones(len(x)))) @ w, -30, 30)))

    none, fold = np.zeros((240, 0)), np.arange(240) % tx.FOLDS
    out = np.zeros(240)
    for f in range(tx.FOLDS):
        out[fold == f] = fitted(x[fold != f], labels[fold != f, 0], none[fold != f])(x[fold == f], none[fold == f])
    first, second = fitted(x, labels[:, 0], none), fitted(x, labels[:, 1], out[:, None])
    models = tx.train_chain(texts, labels)
    row, col = tx.features(texts)
    p = tx.predict(models[0], row, col, none, 240)
    assert np.allclose(p, first(x, none), atol=1e-9)
    assert np.allclose(tx.predict(models[1], row, col, p[:, None], 240), second(x, p[:, None]), atol=1e-9)
    assert ((second(x, p[:, None]) >= 0.5) == (labels[:, 1] > 0)).all()


def test_toxicity_of_repeats_long_texts_and_empty_tables(spark, empty):
    from curvespark.llm import toxicity

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=4)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=50)) + (" vilest" if i % 4 == 0 else ""), 0.5, "x") for i in range(200)]
    long = " ".join(rng.choices(words, k=30_000))
    rows += rows[:3] + [(5, "another text of a repeated id", 0.1, "y"), (300, long, 0.0, ""), (301, long + " vilest", 0.0, ""), (None, "vilest of them", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double, toxic string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "k") for i in range(200)] + [(0, 1, 0, "k"), (300, 1, 0, "k")], "doc_id long, quality int, toxic int, text string")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 0 and r["toxic"] for r in got) == 2
    assert toxicity.score(empty.select("doc_id", "text"), labels).count() == 0


def test_quality(spark, docs, empty):
    from curvespark.llm import quality

    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        repeat = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert got[i]["kept"] == (not want[-1])
    assert quality.judged(empty, labels).count() == 0


def test_quality_verdicts_that_reject(spark):
    """Enough labelled documents that cutoffs are certified: the verdicts, rejections among them, equal the SQL twin's; repeats and empties besides."""
    import duckdb

    from curvespark.llm import common, quality

    rng = random.Random(15)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    make = lambda i, extra: (i, " ".join(rng.choices(words, k=60)) + extra, "xx" if i % 5 else "yy")
    rows = [make(i, "") for i in range(1200)] + [make(2000 + i, " #$%&" * 12) for i in range(30)] + [make(3000 + i, "\nsame line" * 9) for i in range(30)] + [make(4000 + i, " LOUD" * 5 + " " + " ".join(w.upper() for w in rng.choices(words, k=40))) for i in range(30)]
    rows += [(5000, None, "xx"), (5001, "", None), (5002, "few words", "zz")]
    labels = [(i, 1) for i, *_ in rows[:1200]] + [(2000, 0), (2001, 1), (3000, 0), (5000, 1), (7, 0), (None, 1), (8, None)]
    path = common.fresh_path(spark, "quality")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    got = {tuple(r) for r in quality.op8_quality_rules(spark, path).collect()}
    con, local = duckdb.connect(), path.removeprefix("file://").removeprefix("file:")
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{local}/{name}.parquet/*.parquet'")
    want = con.execute(quality.SQL).df()
    kept = want.set_index("doc_id").kept
    assert got == {tuple(x.item() if hasattr(x, "item") else x for x in r) for r in want[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]].itertuples(index=False)}
    rejected = want[~want.base_failed & ~want.kept].doc_id
    assert len(rejected) > 20 and (rejected >= 2000).all() and kept[:1200].all()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    twice = quality.judged(docs.where("doc_id IN (1, 2001)").union(docs.where("doc_id IN (1, 2001)")), spark.read.parquet(f"{path}/labels.parquet"))
    assert twice.count() == 4


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    from curvespark.llm.quality import binomial_tail

    cases = [(0, 50, 0.05), (3, 200, 0.05), (10, 1000, 0.0125), (0, 1, 0.5)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        got = df.where((F.col("k") == k) & (F.col("n") == n)).select(binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(got, want, rel_tol=1e-8)


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_warc(spark, empty, monkeypatch, hot_rows):
    import base64

    from curvespark.llm import common, warc

    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)

    pages = [(1, "a"), (2, "b" * 300_000), (3, "a"), (4, None), (5, ""), (6, "WARC/1.1\r\n\r\nü"), (7, "b" * 300_000), (8, "a"), (2**53 + 1, "a"), (2**53 + 3, "c")]
    df = spark.createDataFrame([(i, h, "x", "y") for i, h in pages], "page_id long, html string, url string, payload_bytes string")
    path = common.fresh_path(spark, "pages")
    df.write.parquet(f"{path}/pages.parquet")
    got = {r["page_id"]: r for r in warc.op9_warc(spark, path).collect()}
    first = {}
    for i, h in pages:
        data = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", first[data]) if data in first else ("response", None))
        first.setdefault(data, i)
    odd = [(None, "a"), (None, "z"), (None, None), (3, "a"), (3, "a"), (3, "q"), (4, "a")]
    path = common.fresh_path(spark, "pages")
    spark.createDataFrame([(i, h, "x", "y") for i, h in odd], "page_id long, html string, url string, sha string").write.parquet(f"{path}/pages.parquet")
    seen = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.op9_warc(spark, path).collect())
    assert seen == [(0, "response", 0), (0, "response", 0), (0, "revisit", 3), (3, "response", 0), (3, "response", 0), (3, "response", 0), (4, "revisit", 3)]
    path = common.fresh_path(spark, "pages")
    spark.createDataFrame([], "page_id long, html string, url string").write.parquet(f"{path}/pages.parquet")
    assert warc.op9_warc(spark, path).count() == 0


def test_top_k(spark, monkeypatch):
    from pyspark.sql import functions as F

    from curvespark.llm import topk

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(300)]
    rows += [(0, [1.0, 0.5, 0.5, 0.25])] * 7 + [(50, [1.0, -1.0, 0.0, 2.0]), (100, [1.0, 2.0]), (7, [3.0, 2.0]), (150, [2.0**60, 2.0**60]), (8, [2.0**55, 1.0])]  # repeated ids, other lengths, scores past 64 bits
    odd = [(400, None), (401, [None, 1.0, 1.0, 1.0]), (402, [float("nan"), 1.0, 1.0, 1.0]), (403, [float("inf")]), (404, []), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows + odd], "vec_id long, embedding array<float>, own string, cell int")
    v = [[math.floor(np.float32(x) * 256) for x in vec] for _, vec in rows]
    want = []
    for q, (i, _) in enumerate(rows):
        if i % 50 == 0:
            held = lambda s: max(-(2**63), min(2**63 - 1, s))
            hits = sorted((-held(sum(a * b for a, b in zip(v[q], v[c]))), j) for c, (j, _) in enumerate(rows) if c != q and len(v[c]) == len(v[q]))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    asks = F.col("vec_id") % 50 == 0
    for query_bytes in (1 << 20, 64):
        monkeypatch.setattr(topk, "QUERY_BYTES", query_bytes)
        assert sorted(map(tuple, topk.top_k(df.repartition(3), asks).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), asks).count() == topk.top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_pipeline(spark):
    """The whole pipeline against plain Python: letters decide the language, rules over word lists, all pairs of shingle sets, the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from curvespark.llm import common

    rng = random.Random(16)
    letters = {"aa": "abcdefgh", "bb": "qrstuvwx"}
    say = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randint(3, 7))) for _ in range(n))
    texts = [say(lang, rng.randint(55, 90)) for lang in ("aa", "bb") for _ in range(20)]
    near = lambda x, n: " ".join(f"{w}x" if i in range(20, 20 + n) else w for i, w in enumerate(x.split()))
    texts += texts[:3] + [near(texts[5], 1), near(texts[6], 12), texts[7].upper()] + [None, "", "12 34 !!", say("aa", 10), "abc def ghk " * 40, say("bb", 4000)]
    rows = [(i, x, ("aa" if i < 20 else "bb") if i < 40 else None, "s", 1) for i, x in enumerate(texts)]
    path = common.fresh_path(spark, "pipeline-in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    kept, words = [], {}
    for i, x in enumerate(texts):
        w = WORD.findall(x or "")
        windows = Counter(zip(w, w[1:], w[2:]))
        repeat = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        if re.search("[a-zA-Z]", x or "") and len(w) >= 50 and 100 * len(repeat) <= 50 * len(w):
            kept.append(i)
            words[i] = WORD.findall(x.translate(LOW))
    sets, up = {i: {tuple(words[i][j : j + 5]) for j in range(len(words[i]) - 4)} for i in kept}, {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    out = corpus_pipeline.run(spark, path).toPandas()
    want = {i for i in kept if up[i] == i}
    assert set(out.doc_id) == want and len(want) < len(kept) < len(texts)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, part in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        assert part.length.sum() == len(ids) and (part.start.to_numpy() == np.cumsum(part.length) - part.length).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length)] == part.ids_crc32.tolist()
    path = common.fresh_path(spark, "pipeline-in")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_pipeline_judges_rows_without_and_with_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(80)) for k in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, "short"), (None, None), (1, c), (1, c), (1, "same " * 80), (1, d), (2, c), (3, d), (4, a), (4, a.upper())]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.001")
    key = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    bad = {"short", None, "same " * 80}
    assert key(good) == sorted((i or 0, t) for i, t in rows if t not in bad)
    out = corpus_pipeline.dedup_stage(spark, good, "")
    got = key(out)
    assert [x for x in got if x[0] < 4] == sorted([(0, a), (0, a), (0, b), (1, c), (1, d)]) and sum(x[0] == 4 for x in got) == 1


def test_tile_joins_components_like_brute_force():
    from curvespark.llm import neardup

    rng = np.random.default_rng(3)
    base = [np.sort(rng.choice(2**40, 120, replace=False).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate((b[rng.permutation(120)[: 120 - k]], rng.choice(2**40, k, replace=False).astype(np.uint64)))) for b in base for k in (0, 2, 5, 9, 14)]
    with np.errstate(over="ignore"):
        blobs = [row.tobytes() for row in neardup.signatures(sets)]
    ids, n = np.arange(len(sets)), len(sets)
    got = neardup.joined(ids, ids.copy(), np.zeros(n, int), np.zeros(n, int), True, blobs, [neardup.packed(s) for s in sets], neardup.distance_limit(0.85), neardup.distance_limit(0.85, neardup.SKETCH, 4), 85)

    def comps(links):
        c = list(range(n))
        for a, b in links:
            c = [min(c[a], c[b]) if x in (c[a], c[b]) else x for x in c]
        return c

    alike = [(a, b) for a in range(n) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert alike and comps(got) == comps(alike) and len(got) == n - len(set(comps(alike)))
