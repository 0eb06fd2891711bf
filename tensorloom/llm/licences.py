"""License scans with a generalised suffix automaton of licence templates.

The automaton is built over the words of all templates.  A text's words stream
through it and give matching statistics: at each word the longest stretch of
template words that ends there.  Stretches of at least ``LEAST_WORDS`` that
can't be extended are chained, template by template, into collinear spans; the
words that a chain covers against those of the template give its score.

Words are looked up by hash, all words of a slice at once; only runs around a
known four-word stretch walk through the automaton, which loses no match since
every match kept holds such a stretch.

Defined cases: a null or empty text has no words, no labels and score 0.  A very
long text streams through the automaton whole.  Of chains that cover as much the
one that ends first is taken.  Repeated rows get equal results.  An empty table
gives an empty result.  Other columns are kept; clashing ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .common import slices, small_batches, with_fields

#: Base phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices and opening paragraphs of public licences (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: A stretch must have so many words, two stretches of a chain at most so many between them.
LEAST_WORDS, MOST_GAP = 4, 12
#: A label needs a chain that covers so much of its template.
LEAST_COVER = 0.75


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of word numbers.

    Each state holds its longest length, its suffix link, its moves, and for
    each sequence one place (``ends``) and all places where its words end.
    """

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[dict[int, int]] = [{}]
        self.places: list[dict[int, set[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, place)
                self.places[last].setdefault(number, set()).add(place)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for number, place in self.ends[state].items():
                if self.link[state] > 0:
                    self.ends[self.link[state]].setdefault(number, place)
                    self.places[self.link[state]].setdefault(number, set()).update(self.places[state][number])

    def _new(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append({})
        self.places.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for the words that p's extension has."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier sequence has it
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        own = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = own
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return own

    def stretches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(last word, length, state) of the matches that can't be extended; -1 is no template word."""
        out, state, n = [], 0, 0
        for i, word in enumerate(words):
            if word not in self.next[state]:
                if n >= least:
                    out.append((i - 1, n, state))
                while state >= 0 and word not in self.next[state]:
                    state = self.link[state]
                if state < 0:
                    state = n = 0
                    continue
                n = self.length[state]
            state, n = self.next[state][word], n + 1
        if n >= least:
            out.append((len(words) - 1, n, state))
        return out


@dataclass(frozen=True)
class Scanner:
    """Templates and phrases as word numbers, with their automaton."""

    hashes: np.ndarray  # sorted word hashes; a word's number is its place
    labels: tuple[str, ...]
    sizes: tuple[int, ...]
    automaton: SuffixAutomaton
    fours: np.ndarray
    phrases: tuple[tuple[np.ndarray, str], ...]

    @classmethod
    def of(cls, templates=TEMPLATES, phrases=PHRASES) -> Scanner:
        texts = [t for _, t in templates] + [p for p, _ in phrases]
        data, offsets = B.raw_bytes(pa.array(texts))
        data = B.LOWER[data]
        starts, ends, first = B.spans(data, offsets, B.ALNUM_LOWER)
        hashes = B.hashes(data, starts, ends)
        known = np.unique(hashes)
        ids = np.searchsorted(known, hashes)
        each = [ids[first[i] : first[i + 1]] for i in range(len(texts))]
        own = each[: len(templates)]
        fours = np.unique(np.concatenate([_fours(x) for x in own]))
        pairs = tuple((x, label) for x, (_, label) in zip(each[len(templates) :], phrases, strict=True))
        return cls(known, tuple(label for label, _ in templates), tuple(map(len, own)), SuffixAutomaton([x.tolist() for x in own]), fours, pairs)

    def scan(self, column: pa.Array) -> list[dict]:
        """For each text n_words, n_base, first_word, last_word, base_labels, labels, score and spans."""
        data, offsets = B.raw_bytes(column)
        data = B.LOWER[data]
        starts, ends, first = B.spans(data, offsets, B.ALNUM_LOWER)
        hashes = B.hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ids = np.where(self.hashes[at] == hashes, at, -1) if len(hashes) else at
        row_of = np.repeat(np.arange(len(column)), np.diff(first))
        rows = [{"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "found": set(), "score": 0.0, "spans": []} for n in np.diff(first)]
        for phrase, label in self.phrases:
            n = len(phrase)
            if len(ids) < n:
                continue
            same = np.ones(len(ids) - n + 1, dtype=bool)
            for k, word in enumerate(phrase):
                same &= ids[k : k + len(same)] == word
            places = np.flatnonzero(same)
            for p in places[row_of[places] == row_of[places + n - 1]].tolist():
                r, start = rows[row_of[p]], p - int(first[row_of[p]])
                r["n_base"] += 1
                r["first_word"] = start if r["first_word"] is None else min(r["first_word"], start)
                r["last_word"] = start if r["last_word"] is None else max(r["last_word"], start)
                r["base"].add(label)
        fours = _fours(ids)
        near = np.flatnonzero(self.fours[np.minimum(np.searchsorted(self.fours, fours), len(self.fours) - 1)] == fours) if len(fours) else []
        for i in np.unique(row_of[near]).tolist() if len(near) else []:
            self._chains(ids[first[i] : first[i + 1]], rows[i])
        for r in rows:
            if r["base"]:
                r["score"] = 1.0
        return rows

    def _chains(self, ids: np.ndarray, row: dict) -> None:
        """Walk the runs of template words, then chain their stretches."""
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < LEAST_WORDS:
                continue
            for last, n, state in self.automaton.stretches(ids[a:b].tolist(), LEAST_WORDS):
                for template, places in self.automaton.places[state].items():
                    by_template.setdefault(template, []).extend((a + last - n + 1, end - n + 1, n) for end in places)
        for template, found in by_template.items():
            for start, end, covered in _best_chains(sorted(found)):
                cover = min(1.0, covered / self.sizes[template])
                row["score"] = max(row["score"], cover)
                if cover >= LEAST_COVER:
                    row["found"].add(self.labels[template])
                    row["spans"].append((self.labels[template], start, end, cover))


def _best_chains(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first word, next word, words covered) of chains of stretches (first word, template word, length) in order.

    Each stretch follows the one that gives it the most cover among all that
    end within ``MOST_GAP`` before it, in the text and in the template.  The
    chain of most cover is taken first, and no stretch of words twice.
    """
    covered, before, ends = [], [], []
    open_: list[int] = []  # later stretches can still follow these
    for k, (start, place, n) in enumerate(found):
        open_ = [j for j in open_ if start - ends[j][0] <= MOST_GAP]
        fit = [j for j in open_ if ends[j][0] <= start and 0 <= place - ends[j][1] <= MOST_GAP]
        best = max(fit, key=lambda j: (covered[j], j), default=-1)
        covered.append(n + (covered[best] if best >= 0 else 0))
        before.append(best)
        ends.append((start + n, place + n))
        open_.append(k)
    out, used = [], set()
    for k in sorted(range(len(found)), key=lambda k: (-covered[k], k)):
        end, total, first = ends[k][0], 0, None
        while k >= 0 and found[k][0] not in used:
            first = found[k][0]
            used.add(first)
            total += found[k][2]
            k = before[k]
        if first is not None:
            out.append((first, end, total))
    return sorted(out)


def _fours(ids: np.ndarray) -> np.ndarray:
    """Each four successive word numbers as one; -1 where one is unknown."""
    n = len(ids) - 3
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    out, ok = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(4):
        part = ids[k : k + n].astype(np.int64)
        ok &= part >= 0
        out = out * 32768 + np.maximum(part, 0)
    return np.where(ok, out, -1)


_NEW = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "spans": "array<struct<label:string,first:long,end:long,cover:double>>"}
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))


def scan(documents: DataFrame, *, text: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Add word counts, places of base phrases, labels, score and covered spans to every row."""
    kept = [c for c in documents.columns if c not in _NEW]
    small_batches(documents.sparkSession)
    base = documents.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches):
        scanner = Scanner.of(templates, phrases)
        for batch in slices(batches, text, 4 << 20):
            rows = scanner.scan(batch.column(text))
            spans = [[{"label": a, "first": b, "end": c, "cover": d} for a, b, c, d in r["spans"]] for r in rows]
            new = [pa.array([r[k] for r in rows], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
            new += [pa.array([",".join(sorted(r["base"])) for r in rows]), pa.array([",".join(sorted(r["base"] | r["found"])) for r in rows])]
            new += [pa.array([r["score"] for r in rows], pa.float64()), pa.array(spans, _SPAN)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *_NEW])

    return base.mapInArrow(run, with_fields(base, **_NEW))
