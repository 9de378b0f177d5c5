"""Licence scans with a generalised suffix automaton of licence words.

All templates and phrases are one automaton.  A text streams through it; the length of the longest suffix that occurs
in some template (its matching statistics) is known after each word, and the states on its suffix path say at which
places of which templates shorter suffixes end.  A match that can't grow at its place is maximal.  Long maximal matches
of one template are chained: in order in the text and in the template, with small gaps in the text, so that each word
of the template is covered once.  A chain that covers enough of its template is a span and gives the template's label.
Phrases are read off the same stream: one ends at a word if its state is on the suffix path of the current one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words of well-known licence notices, by label (fixed values).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]
#: Words of a match that counts, words between matches of a chain, share of the template that a span must cover.
LEAST, GAP, COVERED = 4, 4, 0.75
#: Bytes that stay: digits, a-z (A-Z become these) and all above 7F; others separate words.
_KEPT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split()


class Automaton:
    """A generalised suffix automaton of word sequences; each state knows where in the sequences its strings end."""

    def __init__(self, sequences: list[list[bytes]]):
        self.word: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        prefixes: list[tuple[int, int, int]] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for end, w in enumerate(sequence, 1):
                last = self._extend(last, self.word.setdefault(w, len(self.word)))
                prefixes.append((last, k, end))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.link]  # of prefixes that are the state's own
        self.children: list[list[int]] = [[] for _ in self.link]
        for at, k, end in prefixes:
            self.ends[at].append((k, end))
        for at in range(1, len(self.link)):
            self.children[self.link[at]].append(at)
        self._reached: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of the state's strings."""
        found, open_ = [], [state]
        while open_:
            at = open_.pop()
            found += self.ends[at]
            open_ += self.children[at]
        return found

    def suffixes(self, state: int, least: int) -> list[tuple[int, int, int]]:
        """(sequence, end, length) of the places at which suffixes of at least so many words of the state's longest
        string end, with the longest such suffix (for the state's own places its length)."""
        if (got := self._reached.get((state, least))) is None:
            longest: dict[tuple[int, int], int] = {}
            at = state
            while at > 0 and self.length[at] >= least:
                for place in self.occurrences(at):
                    longest.setdefault(place, self.length[at])
                at = self.link[at]
            got = self._reached[state, least] = sorted((k, end, n) for (k, end), n in longest.items())
        return got

    def _state(self, next_: dict, link: int, length: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, of: int, to: int, w: int) -> int:
        copy = self._state(dict(self.next[to]), self.link[to], self.length[of] + 1)
        self.link[to] = copy
        while of >= 0 and self.next[of].get(w) == to:
            self.next[of][w] = copy
            of = self.link[of]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (to := self.next[last].get(w)) is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, to, w)
        new, at = self._state({}, 0, self.length[last] + 1), last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][w]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, w)
        return new

    def find(self, sequence: list[bytes]) -> int:
        at = 0
        for w in sequence:
            at = self.next[at][self.word[w]]
        return at

    def stream(self, ids: list[int]):
        """State and length of the longest match that ends at each word; -1 is a word of no sequence."""
        at = n = 0
        for w in ids:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
            else:
                at = n = 0
            yield at, n


class Scanner:
    def __init__(self, templates, phrases):
        self.templates = [(label, words_of(text)) for label, text in templates]
        self.phrases = [(words_of(text), label) for text, label in phrases]
        self.automaton = a = Automaton([w for _, w in self.templates] + [w for w, _ in self.phrases])
        self.ids = [[a.word[w] for w in words] for _, words in self.templates]
        self.shortest = min(LEAST, *(len(w) for w, _ in self.phrases))
        states = [(a.find(w), len(w), label) for w, label in self.phrases]
        self.ending: list[list[tuple[int, str]]] = []  # of a state: phrases that end with its strings, from what length on
        for s in range(len(a.link)):
            path, at = set(), s
            while at > 0:
                path.add(at)
                at = a.link[at]
            self.ending.append([(n, label) for p, n, label in states if p in path])

    def scan(self, words: list[bytes]):
        """Places of phrases as (first word, label), spans as (label, first word, last word, coverage, words covered)."""
        get = self.automaton.word.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        places, matches = [], {}
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.shortest:
                continue
            own = ids[a:b].tolist() + [-1]
            for i, (at, n) in enumerate(self.automaton.stream(own[:-1])):
                for least, label in self.ending[at]:
                    if n >= least:
                        places.append((a + i - least + 1, label))
                if n >= LEAST:
                    for k, end, longest in self.automaton.suffixes(at, LEAST):
                        if k < len(self.ids) and (end == len(self.ids[k]) or self.ids[k][end] != own[i + 1]):
                            size = min(n, longest)
                            matches.setdefault(k, []).append((a + i + 1 - size, a + i + 1, end - size, end))
        return places, resolved([span for k in sorted(matches) for span in self._spans(k, matches[k])])

    def _spans(self, k: int, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float, int]]:
        """Spans of chains of a template's maximal matches (begin and end in the text, then in the template)."""
        label, words = self.templates[k]
        matches, chains = sorted(matches, key=lambda m: (m[1], m[3])), []
        for j, (begin, end, t_begin, t_end) in enumerate(matches):
            best, first = end - begin, begin
            for i in range(j - 1, -1, -1):
                _, to, _, t_to = matches[i]
                if to < begin - GAP:
                    break
                cut = max(0, to - begin, t_to - t_begin)  # words that the match before has already
                if to < end and t_to < t_end and begin + cut - to <= GAP and cut < end - begin:
                    best, first = max((best, first), (chains[i][0] + end - begin - cut, chains[i][1]))
            chains.append((best, first, end))
        spans = []
        for covered, first, end in sorted(chains, key=lambda c: (-c[0], c[2] - c[1], c[1])):
            if covered < COVERED * len(words):
                break
            if all(end <= s or first > e for _, s, e, *_ in spans):
                spans.append((label, first, end - 1, covered / len(words), covered))
        return spans


def resolved(spans: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float, int]]:
    """Spans in order.  Notices of different licences may differ in a word or two: of overlapping spans of different
    labels the one that covers more words stays (then that of the higher coverage, of the lower label)."""
    kept: list[tuple[str, int, int, float, int]] = []
    for span in sorted(spans, key=lambda s: (-s[4], -s[3], s)):
        if all(span[0] == other[0] or span[2] < other[1] or span[1] > other[2] for other in kept):
            kept.append(span)
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(4)
def scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(templates, phrases)


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per input row: the id, n_words, n_base (places of phrases, overlapping ones too), first_word and
    last_word (their smallest and largest first word, null without any), base_labels and labels (distinct, sorted,
    comma-joined; labels has those of spans too), score (greatest coverage of a span, 1 with a phrase, else 0), spans.

    Words are runs of digits, letters a-z after lowering A-Z, and signs beyond ASCII.  Null counts as empty: no words,
    empty labels, score 0.  Further columns are ignored; no shuffle.
    """
    templates, phrases = tuple(templates), tuple(dict(phrases).items())

    def run(batches):
        machine = scanner(templates, phrases)
        for batch in batches:
            cols = [[] for _ in range(8)]
            for text in common.texts(batch.column(1)):
                words = words_of(text)
                places, spans = machine.scan(words)
                base = {label for _, label in places}
                found = base | {s[0] for s in spans}
                firsts = [p for p, _ in places]
                row = (len(words), len(places), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if places else max((s[3] for s in spans), default=0.0), [dict(zip(("label", "first_word", "last_word", "coverage"), s)) for s in spans])
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, last_word: bigint, coverage: double>>"
    return rows.mapInArrow(common.returning(run), schema).withColumnRenamed("id", id_col)
