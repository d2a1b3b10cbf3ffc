"""License scans by template-markup matching.

A template is a license's wording with two kinds of markup: ``<<optional>> ... <<end>>`` may be left
out, ``<<var:n>>`` stands for up to n words of any kind.  Each template compiles to an automaton over
words; a text is accepted where some run of its words spells the mandatory wording exactly.  A version
number at a template's end has to end there, too: ``version 2`` is not found in ``version 2 1``.

One-line tags (``SPDX-License-Identifier: MIT OR Apache-2.0``) have a grammar of their own, read in the text
itself, where hyphens and line ends still stand: identifiers joined by AND and OR, an exception after WITH,
brackets.  An identifier is known as a whole or not at all, so ``MIT-0`` is not ``MIT``.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import map_texts

#: The phrases of the base scan and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: Words that licence names share, as optional regions.
_A, _THE = "<<optional>> a <<end>>", "<<optional>> the <<end>>"
_UNDER = f"under {_A} {_THE} <<optional>> terms of the <<end>>"
#: What may stand between a licence's name and its version.
_PUBLISHED = "<<optional>> as published by the free software foundation <<end>> <<optional>> either <<end>>"


def _versions(name: str, n: int) -> list[str]:
    """A name with its version, written as number, as version and number, or as one word."""
    return [f"{name} <<optional>> version <<end>> <<optional>> v <<end>> {n} <<optional>> 0 <<end>>", f"{name} <<optional>> version <<end>> v{n} <<optional>> 0 <<end>>"]


_HOLDER = "copyright <<optional>> c <<end>> <<var:12>>"

#: Permission texts and conditions as their authors publish them.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>> the software <<end>>"
    " to deal in the software without restriction"
)
_MIT_REST = (
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the"
    " software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <<end>>"
    " shall be included in all copies or substantial portions of the software"
)
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = " <<optional>> 1 <<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = (
    " <<optional>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the"
    " documentation and or other materials provided with the distribution"
)
_BSD_NAMES = (
    " <<optional>> 3 <<end>> neither the name of <<var:12>> nor the names of <<var:3>> contributors may be used to endorse or promote products derived from this software without"
    " specific prior written permission"
)

#: label: templates. Wording of the licenses' notices and texts.
TEMPLATES = {
    "apache-2.0": [
        *_versions(f"{_UNDER} apache license", 2),
        "you may not use this file except in compliance with the license you may obtain a copy of the license at <<optional>> http <<end>> <<optional>> https <<end>> <<optional>> www <<end>> apache org licenses license 2 0",
        "apache license version 2 0 january 2004 <<optional>> http <<end>> <<optional>> https <<end>> www apache org licenses",
    ],
    "agpl-3.0": [*_versions(f"gnu affero general public license {_PUBLISHED}", 3), *_versions("gnu agpl", 3), f"{_UNDER} agplv3"],
    "gpl-3.0": [*_versions(f"gnu general public license {_PUBLISHED}", 3), *_versions("gnu gpl", 3), f"{_UNDER} gplv3"],
    "gpl-2.0": [*_versions(f"gnu general public license {_PUBLISHED}", 2), *_versions("gnu gpl", 2), f"{_UNDER} gplv2"],
    "lgpl": [
        f"{_UNDER} gnu lesser general public license <<optional>> as published by the free software foundation <<end>>",
        f"{_UNDER} gnu library general public license <<optional>> as published by the free software foundation <<end>>",
        "gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version 3 29 june 2007",
    ],
    "mit": [
        f"released {_UNDER} mit license", f"licensed {_UNDER} mit license", f"distributed {_UNDER} mit license", f"available {_UNDER} mit license",
        f"mit license {_HOLDER} {_MIT_GRANT}", _MIT_GRANT, _MIT_GRANT + _MIT_REST,
    ],
    "bsd": [_BSD_GRANT, f"{_UNDER} bsd license", f"{_UNDER} bsd style license", "bsd <<optional>> 2 <<end>> <<optional>> 3 <<end>> clause license"],
    "bsd-2-clause": [f"{_BSD_GRANT}{_BSD_SOURCE}{_BSD_BINARY} this software is provided by", "bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "bsd-3-clause": [f"{_BSD_GRANT}{_BSD_SOURCE}{_BSD_BINARY}{_BSD_NAMES}", "bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        f"{_UNDER} isc license",
    ],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        f"{_UNDER} zlib license",
    ],
    "bsl-1.0": ["boost software license version 1 0", f"{_UNDER} boost software license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "mpl-2.0": [
        *_versions("mozilla public license", 2),
    ],
    "epl-2.0": [*_versions("eclipse public license", 2)],
    "cc0-1.0": ["cc0 1 0 universal", f"{_UNDER} cc0", "creative commons zero v1 0 universal"],
}
#: The parts of the attribution licences' names, short and in full.
for _label, _short, _long in (
    ("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution sharealike"), ("cc-by-nc", "by nc", "attribution noncommercial"), ("cc-by-nd", "by nd", "attribution noderivatives"),
    ("cc-by-nc-sa", "by nc sa", "attribution noncommercial sharealike"), ("cc-by-nc-nd", "by nc nd", "attribution noncommercial noderivatives"),
):
    TEMPLATES |= {f"{_label}-4.0": [f"{_UNDER} cc {_short} 4 0", f"creative commons {_long} 4 0 international <<optional>> public <<end>> license", f"creativecommons org licenses {_short} 4 0"]}
#: Identifiers of one-line tags and their labels.
IDENTIFIERS = {
    "apache-2.0": "apache-2.0", "mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "bsl-1.0": "bsl-1.0", "mpl-2.0": "mpl-2.0", "epl-2.0": "epl-2.0", "cc0-1.0": "cc0-1.0", "0bsd": "0bsd",
    "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "cc-by-4.0": "cc-by-4.0", "cc-by-sa-4.0": "cc-by-sa-4.0", "cc-by-nc-4.0": "cc-by-nc-4.0", "cc-by-nd-4.0": "cc-by-nd-4.0",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0": "cc-by-nc-nd-4.0", "gpl-2.0": "gpl-2.0", "gpl-3.0": "gpl-3.0", "agpl-3.0": "agpl-3.0", "lgpl-2.0": "lgpl", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl",
}
#: What may follow the identifiers of the licences that come in versions.
_SUFFIX = re.compile(r"(?:-only|-or-later|\+)$")
_TAG = re.compile(r"spdx[-_ \t]license[-_ \t]identifier[ \t]*[:=]?[ \t]*", re.ASCII | re.IGNORECASE)
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)", re.ASCII | re.IGNORECASE)


def tagged(text: str) -> set[str]:
    """The labels that a text's one-line tags name.

    A tag is identifiers with AND or OR between them, brackets around them, and an exception after WITH;
    it ends with its line, or at the first word that fits nowhere.  A full stop at an identifier's end is
    the sentence's.
    """
    out = set()
    for tag in _TAG.finditer(text):
        at, wanted, skip = tag.end(), True, False
        while m := _TOKEN.match(text, at):
            at, token = m.end(), m[1].lower().rstrip(".")
            if token in "()":
                continue
            if token in ("and", "or", "with"):
                if wanted:
                    break
                wanted, skip = True, token == "with"
                continue
            if not wanted:
                break
            wanted = False
            if not skip:
                label = IDENTIFIERS.get(token) or (IDENTIFIERS.get(_SUFFIX.sub("", token)) if re.match(r"a?gpl-|lgpl-", token) else None)
                out |= {label} if label else set()
            skip = False
    return out


#: Every byte of a separator becomes a blank, A-Z their lower case; bytes from 128 on belong to words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A version number, and what goes on with it.
_VERSION = re.compile(rb"v?[0-9]+")
_MORE = re.compile(rb"[0-9]{1,2}")
_MARK = re.compile(r"<<(optional|end|var:(\d+))>>")


class Automaton:
    """States are places in the wording; ``any`` words pass in the states of a replaceable region."""

    def __init__(self, template: str):
        self.words: dict[int, tuple[bytes, int]] = {}  # state: word, next state
        self.free: dict[int, list[int]] = {}  # states that any word leads on from
        self.skips: dict[int, list[int]] = {}  # states reached without a word
        self.mandatory: set[bytes] = set()
        state, open_at = 0, []
        for token in template.split():
            mark = _MARK.fullmatch(token)
            if mark is None:
                self.words[state] = (token.encode(), state + 1)
                if not open_at:
                    self.mandatory.add(token.encode())
                state += 1
            elif mark[1] == "optional":
                open_at.append(state)
                self.skips.setdefault(state, []).append(state + 1)
                state += 1
            elif mark[1] == "end":
                if not open_at:
                    raise ValueError(f"an <<end>> without its <<optional>>: {template}")
                self.skips.setdefault(open_at.pop(), []).append(state)
            else:
                last = state + int(mark[2])
                for s in range(state, last):
                    self.free.setdefault(s, []).append(s + 1)
                    self.skips.setdefault(s, []).append(last)
                state = last
        if open_at:
            raise ValueError(f"an <<optional>> without its <<end>>: {template}")
        if not self.mandatory:
            raise ValueError(f"a template without a mandatory word: {template}")
        self.final = state
        #: Whether the wording can end in a number.
        self.numbered = any(n in self.enders() and _VERSION.fullmatch(w) for w, n in self.words.values())
        self.entry = self.close({0})
        firsts = [w for s in self.entry if (w := self.words.get(s))]
        # a template may begin anywhere, so leading replaceable words never need to be consumed
        self.first = {w for w, _ in firsts}

    def close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def enders(self) -> set[int]:
        """The states from which the final one is reached without a word."""
        return {s for s in range(self.final + 1) if self.final in self.close({s})}

    def run(self, words: list[bytes], start: int) -> tuple[bool, float]:
        """Whether the words from start on are accepted, and which share of the way the furthest state lies."""
        states, furthest = self.entry, 0
        for at, word in enumerate(words[start : start + self.final + 1], start):
            after = {n for s in states if (x := self.words.get(s)) and x[0] == word for n in (x[1],)}
            after |= {n for s in states for n in self.free.get(s, ())}
            if not after:
                break
            states = self.close(after)
            furthest = max(furthest, max(after))
            if self.final in states and not (self.numbered and _VERSION.fullmatch(word) and at + 1 < len(words) and _MORE.fullmatch(words[at + 1])):
                return True, 1.0
        return False, min(1.0, furthest / self.final)


class Matcher:
    def __init__(self, templates: dict[str, list[str]]):
        self.automata = [(label, Automaton(t)) for label, each in templates.items() for t in each]
        self.labels = frozenset(templates)
        self.by_first: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            for w in a.first:
                self.by_first.setdefault(w, []).append((label, a))
        self.firsts = frozenset(self.by_first)
        #: Words such that every template has one of them in its mandatory part: a text without any matches none.
        self.anchors: list[bytes] = []
        open_ = [a for _, a in self.automata]
        while open_:
            spread = Counter(w for a in open_ for w in a.mandatory)
            best = max(spread, key=lambda w: (min(len(w), 5), spread[w], w))
            self.anchors.append(best)
            open_ = [a for a in open_ if best not in a.mandatory]

    def match(self, words: list[bytes], normal: bytes) -> tuple[set[str], float]:
        if not any(a in normal for a in self.anchors):
            return set(), 0.0
        held = set(words)
        if held.isdisjoint(self.anchors):
            return set(), 0.0
        labels, best = set(), 0.0
        for i in [i for i, w in enumerate(words) if w in self.firsts]:
            for label, a in self.by_first[words[i]]:
                if label not in labels and a.mandatory <= held:
                    accepted, share = a.run(words, i)
                    best = max(best, share)
                    if accepted:
                        labels.add(label)
        return labels, best


def scan_text(text: str | None, matcher: Matcher) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score of one text."""
    normal = (text or "").encode("utf-8", "replace").translate(_BYTES)
    words = normal.split()
    places, base = [], set()
    if b"license" in normal:
        at = -1
        for _ in range(words.count(b"license")):
            at = words.index(b"license", at + 1)
            for phrase, label in PHRASES.items():
                start = at - len(phrase) + 1
                if start >= 0 and tuple(w.decode("utf-8", "replace") for w in words[start : at + 1]) == phrase:
                    places.append(start)
                    base.add(label)
    own, share = matcher.match(words, normal)
    if b"spdx" in normal:
        own = own | (tagged(text or "") & matcher.labels)
    score = 1.0 if own else max(0.5 if base else 0.0, 0.5 * share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels (empty strings) and score 0.  The score is 1 where a
    template accepts or a tag names a label of the templates, else half for a base phrase, or half the share of a template's way that was gone.
    Null and repeated doc_ids stay rows of their own.
    """
    used = TEMPLATES if templates is None else templates
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def make():
        matcher = Matcher(used)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan_text(t, matcher) for t in batch.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

        return step

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
