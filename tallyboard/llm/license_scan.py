r"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or for wrapped notices a window of words across line ends, `WIDTH` times as many as the template has (the
whole text if it has fewer). A wider spread over several lines is not a block. The words of the templates are in one global
order, by their frequency over all documents, rarest first; other words can't be common. A template of |t| words is contained
to the share c if ceil(c |t|) of them are. Blocks meet templates through an inverted index of the templates' |t| - ceil(c |t|) + 1
rarest words (prefix filter); a block needs ceil(c |t|) template words (length filter); and where both first meet, at place i
of the template's order and j of the block's, the words that follow on either side must suffice (positional filter). What
passes is verified exactly. Windows are looked for in texts that pass as a whole. Templates are a small parameter table and
travel with the tasks; the frequencies are one count per template word. Documents never leave their rows.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.common import ALNUM, Words, chunks, filled, translated

CONTAINMENT = 0.8
#: Words of a window across line ends, as a multiple of the template's.
WIDTH = 2
#: Fixed values of the base: phrase and label.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Templates of the method: label and text. Sentences of the licenses' own notices.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa", "This work is made available under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: As ALNUM, but lines stay apart.
LINES = ALNUM[:10] + b"\n" + ALNUM[11:]


def tokens_of(text: str) -> list[str]:
    return Words(translated(pa.array([text]), ALNUM)).flat.to_pylist()


class Blocks:
    """Words of a chunk of texts: by text and by line."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(translated(texts, LINES), "\n")
        n_lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = Words(pc.list_flatten(lists))
        self.text_of_line = np.repeat(np.arange(len(texts)), n_lines)
        self.line = self.words.owners()
        self.text = self.text_of_line[self.line]
        self.n_words = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.n_words) - self.n_words

    def numbered(self, terms: list[str]) -> np.ndarray:
        """Each word's number in `terms`, or -1."""
        found = pc.fill_null(pc.index_in(self.words.dictionary, value_set=pa.array(terms, self.words.dictionary.type)), -1).to_numpy(zero_copy_only=False)
        return found[self.words.codes] if len(found) else np.zeros(0, np.int64)


def places(blocks: Blocks, phrase: list[str]) -> np.ndarray:
    """Positions in the chunk where the phrase's words stand consecutively inside one text."""
    terms = list(dict.fromkeys(phrase))
    number = blocks.numbered(terms)
    n = len(number) - len(phrase) + 1
    if n <= 0 or not phrase:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[:n] == 0)
    for k, word in enumerate(phrase[1:], 1):
        at = at[number[at + k] == terms.index(word)]
    return at[blocks.text[at] == blocks.text[at + len(phrase) - 1]]


def frequencies(docs: DataFrame, terms: list[str]) -> dict[str, int]:
    """How often each term occurs in all documents; one small row per task reaches the driver."""

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for part in chunks(batches):
            number = Blocks(part.column(0)).numbered(terms)
            total += np.bincount(number[number >= 0], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms)), pa.int32()), pa.array(total)], names=["term", "n"])

    counted = docs.select(filled().alias("text")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {terms[r.term]: r.n for r in counted}


class Index:
    """Lists of entries by term: one array of all entries, and where each term's begin."""

    def __init__(self, lists: list[list[tuple[int, int]]]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.entries = np.array([e for x in lists for e in x], np.int64).reshape(-1, 2)

    def probe(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of `terms`, template, place) of every entry of every term's list."""
        n = self.size[terms]
        which = np.repeat(np.arange(len(terms)), n)
        found = self.entries[np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return which, found[:, 0], found[:, 1]


class Templates:
    def __init__(self, templates: list[tuple[str, str]], counts: dict[str, int], containment: float):
        words = [(label, set(tokens), len(tokens)) for label, text in templates if (tokens := tokens_of(text))]
        self.labels, self.width = [label for label, *_ in words], [WIDTH * n for *_, n in words]
        #: all template words, rarest first; a word's number is its place in this order
        self.terms = sorted({w for _, own, _ in words for w in own}, key=lambda w: (counts.get(w, 0), w))
        place = {w: i for i, w in enumerate(self.terms)}
        self.coded = [np.sort(np.array([place[w] for w in own])) for _, own, _ in words]
        self.length = np.array([len(own) for own in self.coded], np.int64)
        self.need = -(-np.round(containment * self.length * 1e6).astype(np.int64) // 1_000_000)
        prefix, whole = [[] for _ in self.terms], [[] for _ in self.terms]
        for t, own in enumerate(self.coded):
            for i, w in enumerate(own):
                whole[w].append((t, i))
                if i <= self.length[t] - self.need[t]:
                    prefix[w].append((t, i))
        self.prefix, self.whole = Index(prefix), Index(whole)

    def candidates(self, group: np.ndarray, term: np.ndarray):
        """Pairs that meet in the prefix index: (group, template, passes the length filter, passes the positional filter too).

        group and term are the distinct template words of each block, sorted."""
        new = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        size, place = np.bincount(own, minlength=len(begin)), np.arange(len(group)) - (begin[own] if len(group) else 0)
        which, t, i = self.prefix.probe(term)
        _, first = np.unique(group[which] * len(self.length) + t, return_index=True)
        which, t, i = which[first], t[first], i[first]
        n, j, need = size[own[which]], place[which], self.need[t]
        long = n >= need
        return group[which], t, long, long & (1 + np.minimum(self.length[t] - i - 1, n - j - 1) >= need)

    def contained(self, group: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, template, common words) of the blocks that reach a template's threshold; group: each word's block, number: its place in `terms` or -1."""
        at = np.flatnonzero(number >= 0)
        pairs = np.unique(group[at].astype(np.int64) * max(1, len(self.terms)) + number[at])
        group, term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        g, t, _, passes = self.candidates(group, term)
        wanted = np.sort(g[passes] * len(self.length) + t[passes])
        if not len(wanted):
            return (np.zeros(0, np.int64),) * 3
        near = np.isin(group, wanted // len(self.length))
        which, t, _ = self.whole.probe(term[near])
        met = group[near][which] * len(self.length) + t
        found = np.minimum(np.searchsorted(wanted, met), len(wanted) - 1)
        common = np.bincount(found[wanted[found] == met], minlength=len(wanted))
        good = common >= self.need[wanted % len(self.length)]
        return wanted[good] // len(self.length), wanted[good] % len(self.length), common[good]

    def matches(self, blocks: Blocks) -> list[tuple[int, int, float]]:
        """(line, template, containment) of every line that reaches a template's threshold."""
        line, t, common = self.contained(blocks.line, blocks.numbered(self.terms))
        return [(int(x), int(k), float(c) / len(self.coded[k])) for x, k, c in zip(line, t, common)]

    def wrapped(self, blocks: Blocks) -> list[tuple[int, int, int, float]]:
        """(first word, last word, template, containment) of the windows across line ends that reach a template's threshold.

        Of windows that overlap, the fullest is given, cut down to the words that it needs."""
        number = blocks.numbered(self.terms)
        texts, templates, _ = self.contained(blocks.text, number)
        found = []
        for t in np.unique(templates).tolist():
            own, need, width = self.coded[t], int(self.need[t]), self.width[t]
            rank = np.full(len(self.terms), len(own))
            rank[own] = np.arange(len(own))
            at = np.flatnonzero(np.isin(blocks.text, texts[templates == t]) & (number >= 0))
            hits = at[rank[number[at]] < len(own)]
            # texts lie further apart than a window is wide
            place = hits + blocks.text[hits].astype(np.int64) * width
            rare = place[rank[number[hits]] <= len(own) - need]
            close = np.searchsorted(rare, place - width, "right") < np.searchsorted(rare, place + width, "left")
            hits, place = hits[close], place[close]
            n = len(hits)
            if n < need:
                continue
            # a word is new in the windows that begin after its last occurrence and reach it
            term = rank[number[hits]]
            order = np.argsort(term, kind="stable")
            last = np.full(n, -1)
            again = term[order][1:] == term[order][:-1]
            last[order[1:][again]] = order[:-1][again]
            begin = np.maximum(last + 1, np.searchsorted(place, place - width, "right"))
            count = np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(np.arange(1, n + 1), minlength=n + 1))[:n]
            starts = np.flatnonzero(count >= need)
            k = 0
            while k < len(starts):
                to = np.searchsorted(starts, np.searchsorted(place, place[starts[k]] + width, "left"), "left")
                while True:
                    best = starts[k:to][np.argmax(count[starts[k:to]])]
                    inside = np.arange(best, np.searchsorted(place, place[best] + width, "left"))
                    end = inside[last[inside] < best][-1]
                    k, to = np.searchsorted(starts, [best, end], "right")
                    if k == to or count[starts[k:to]].max() <= count[best]:
                        break
                k = to
                # from the last place of each word up to there
                begin_at = min({term[j]: j for j in range(best, end + 1)}.values())
                if blocks.line[hits[begin_at]] != blocks.line[hits[end]]:
                    found.append((int(hits[begin_at]), int(hits[end]), t, float(count[best]) / len(own)))
        return found


def scan_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, label, containment, block (the text of its line or lines), line (the first one's number from 0).

    Every line that reaches a template's threshold, and every wrapped notice that does. Null and empty texts have none; very long
    ones are scanned whole; repeated rows are answered one by one; no rows give none."""
    table = Templates(templates, frequencies(docs, sorted({w for _, t in templates for w in tokens_of(t)})), containment)

    def run(batches):
        for part in chunks(batches):
            blocks = Blocks(part.column(1))
            found = [(x, x, t, c) for x, t, c in table.matches(blocks)] + [(int(blocks.line[a]), int(blocks.line[b]), t, c) for a, b, t, c in table.wrapped(blocks)]
            text = blocks.text_of_line[[x for x, *_ in found]] if found else np.zeros(0, np.int64)
            start = np.searchsorted(blocks.text_of_line, text)
            lines = ["\n".join(part.column(1)[int(i)].as_py().split("\n")[x - s : y - s + 1]) for i, (x, y, _, _), s in zip(text, found, start.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array([table.labels[t] for _, _, t, _ in found], pa.string()), pa.array([c for *_, c in found], pa.float64()), pa.array(lines, pa.string()), pa.array([x - s for (x, *_), s in zip(found, start.tolist())], pa.int32())], names=["doc_id", "label", "containment", "block", "line"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"))
    return rows.mapInArrow(run, "doc_id long, label string, containment double, block string, line int")


def license_labels(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a base phrase stands, else the best containment of a reported block, else 0. Null and empty texts have
    no words and no labels, very long ones are scanned whole; repeated rows get the same answer each; no rows give none."""
    table = Templates(templates, frequencies(docs, sorted({w for _, t in templates for w in tokens_of(t)})), containment)
    wanted = [(tokens_of(p), label) for p, label in phrases]

    def run(batches):
        for part in chunks(batches):
            blocks = Blocks(part.column(1))
            n = part.num_rows
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: dict[int, set[str]] = {}
            for words, label in wanted:
                at = places(blocks, words)
                own = blocks.text[at]
                n_base += np.bincount(own, minlength=n)
                np.minimum.at(first, own, at - blocks.first[own])
                np.maximum.at(last, own, at - blocks.first[own])
                for i in np.unique(own).tolist():
                    base.setdefault(i, set()).add(label)
            more: dict[int, set[str]] = {i: set(x) for i, x in base.items()}
            score = (n_base > 0).astype(float)
            near = [(blocks.text_of_line[x], t, c) for x, t, c in table.matches(blocks)] + [(blocks.text[a], t, c) for a, _, t, c in table.wrapped(blocks)]
            for i, t, c in near:
                i = int(i)
                more.setdefault(i, set()).add(table.labels[t])
                score[i] = max(score[i], c)
            joined = lambda x: pa.array([",".join(sorted(x.get(i, ()))) for i in range(n)], pa.string())
            none = pa.array(n_base == 0)
            null = pa.scalar(None, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blocks.n_words.astype(np.int64)), pa.array(n_base), pc.if_else(none, null, pa.array(first)), pc.if_else(none, null, pa.array(last)), joined(base), joined(more), pa.array(score)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
