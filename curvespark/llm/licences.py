"""Licence scans by sentence rules.

Texts are split into sentences (at line ends, and after . ! ? ; before a space). A sentence is normalised to its
lower-case words of letters and digits, which drops comment marks, quotes and hyphens. It becomes the identifier of
the longest known sentence that it is or begins with; where it ends with its line, the following lines of the
paragraph, up to the next sentence end, are read on, so wrapped licences are found. Rules are ordered sequences of
identifiers, matched over the document's identifiers with no other licence sentence and at most GAP further
sentences between two of them. Longer rules win over their parts, each sentence belongs to one match, and a
sentence that no longer rule takes matches its own one-sentence rule, if it has one.

One row for every match: doc_id, licence, rule, sentence (number of its first sentence in the text, from 0),
n_sentences (identifiers matched), char_start (characters before it). Null and empty texts match nothing; repeated
documents report each. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

GAP = 8

#: Published licence sentences or their openings, by licence and part.
SENTENCES = {
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl2-later": "either version 2 of the license or at your option any later version",
    "gpl3-later": "either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty",
    "lgpl-copy": "you should have received a copy of the gnu lesser general public license along with this library",
    "agpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
    "agpl-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "neither the name of",
    "bsd-asis": "this software is provided by the copyright holders and contributors as is",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": "the software is provided as is and the author disclaims all warranties",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "epl-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "zlib-altered": "altered source versions must be plainly marked as such",
    "zlib-notice": "this notice may not be removed or altered from any source distribution",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "boost-distributed": "distributed under the boost software license version 1 0",
    "cc0-waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights",
    "wtfpl-terms": "everyone is permitted to copy and distribute verbatim or modified copies of this license document",
    "wtfpl-do": "you just do what the fuck you want to",
    "reserved": "all rights reserved",
}
#: Licences by their published identifiers, and how sentences name them.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "MIT": ("mit license", "mit licence", "expat license"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gpl v2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gpl v3", "gplv3"),
    "GPL": ("gnu general public license", "gnu gpl"),
    "LGPL": ("gnu lesser general public license", "gnu lgpl"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license"),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license", "2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license", "3 clause bsd license"),
    "BSD": ("bsd license", "bsd style license"),
    "ISC": ("isc license",),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0"),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1 0",),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0", "cc0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
}
#: How a sentence says that something is under a licence.
OPENINGS = ("licensed under", "licensed under the", "licensed under a", "released under", "released under the", "released under a", "distributed under the", "available under the",
            "this work is licensed under", "this work is licensed under the", "this work is licensed under a", "this project is licensed under the", "this software is licensed under the",
            "this code is licensed under the", "this file is licensed under the", "this program is licensed under the", "this software is released under the", "spdx license identifier")
#: Rules of several sentences: licence, identifiers in order. Each named licence has one-sentence rules besides.
RULES = (
    ("Apache-2.0", ("named:Apache-2.0", "apache-compliance", "apache-copy", "apache-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant",)),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl2-later", "gpl-warranty", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl3-later", "gpl-warranty", "gpl-copy")),
    ("GPL", ("gpl-redistribute", "gpl-warranty", "gpl-copy")),
    ("GPL", ("gpl-redistribute",)),
    ("LGPL", ("lgpl-redistribute", "lgpl-warranty", "lgpl-copy")),
    ("LGPL", ("lgpl-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl-redistribute", "gpl3-later", "gpl-warranty", "agpl-copy")),
    ("AGPL", ("agpl-redistribute",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-asis")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-terms", "mpl-copy")),
    ("MPL-2.0", ("mpl-terms",)),
    ("EPL", ("epl-terms",)),
    ("Zlib", ("zlib-asis", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("Unlicense", ("unlicense-domain",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-distributed",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("WTFPL", ("wtfpl-terms", "wtfpl-do")),
)


def known_sentences() -> dict[tuple[str, ...], str]:
    """Identifiers by normalised words: SENTENCES, and each opening with each name of a licence and its published identifier."""
    out = {tuple(words.split()): name for name, words in SENTENCES.items()}
    for licence, names in NAMES.items():
        for opening in OPENINGS:
            for name in (*names, " ".join(normalised(licence))):
                out.setdefault((*opening.split(), *name.split()), f"named:{licence}")
    return out


_WORDS = re.compile(r"[^\W_]+").findall
_EDGE = re.compile(r"(?<=[.!?;])[^\S\n]+|[^\S\n]*\n\s*")


def normalised(sentence: str) -> list[str]:
    return _WORDS(sentence.lower())


class Recogniser:
    """Finds sentence identifiers and rule matches in whole texts."""

    def __init__(self, sentences: dict[tuple[str, ...], str] | None = None, rules: tuple | None = None, gap: int = GAP):
        sentences = known_sentences() if sentences is None else sentences
        rules = (*RULES, *((n, (f"named:{n}",)) for n in NAMES)) if rules is None else rules
        self.gap, self.rules, self.known = gap, {}, {}
        for rule in sorted(rules, key=lambda r: (-len(r[1]), r)):
            self.rules.setdefault(rule[1][0], []).append(rule)
        for words, name in sorted(sentences.items(), key=lambda s: (-len(s[0]), s)):
            self.known.setdefault(words[0], []).append((words, name))

    def sentences(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(number, characters before it, identifier) of each sentence that has one."""
        starts, ends, joins = [0], [], []  # joins: whether the sentence goes on in the next line
        for edge in _EDGE.finditer(text):
            ends.append(edge.start())
            starts.append(edge.end())
            joins.append(edge.group().count("\n") == 1 and text[edge.start() - 1 : edge.start()] not in (".", "!", "?", ";"))
        ends.append(len(text))
        joins.append(False)
        said: dict[int, list[str]] = {}
        number = -1
        skip = 0  # sentences up to here are part of one already recognised
        for i, (a, z) in enumerate(zip(starts, ends)):
            if a >= z:
                continue
            number += 1
            words = said[i] if i in said else normalised(text[a:z])
            if i < skip or not words or words[0] not in self.known:
                continue
            for known, name in self.known[words[0]]:
                run, j = words, i
                while len(run) < len(known) and joins[j] and tuple(run) == known[: len(run)]:
                    j += 1
                    if j not in said:
                        said[j] = normalised(text[starts[j] : ends[j]])
                    run = run + said[j]
                if tuple(run[: len(known)]) == known:
                    yield number, a, name
                    skip = j + 1
                    break

    def matches(self, text: str | None) -> Iterator[tuple[str, str, int, int, int]]:
        """(licence, rule, number of its first sentence, sentences matched, characters before)."""
        if not text:
            return
        found, at = list(self.sentences(text)), 0
        while at < len(found):
            taken = 1
            for licence, ids in self.rules.get(found[at][2], ()):
                part = found[at : at + len(ids)]
                if tuple(x[2] for x in part) == ids and all(b[0] - a[0] <= self.gap + 1 for a, b in zip(part, part[1:])):
                    yield licence, "+".join(ids), found[at][0], len(ids), found[at][1]
                    taken = len(ids)
                    break
            at += taken


def scan(docs: DataFrame) -> DataFrame:
    """One row for every match of docs (doc_id, text)."""
    common.text_batches(docs.sparkSession)

    def run(batches):
        seen = Recogniser()
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"]) for m in seen.matches(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "licence", "rule", "sentence", "n_sentences", "char_start"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, licence string, rule string, sentence int, n_sentences int, char_start long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


SQL = None
