"""License scans by templates with optional and replaceable regions.

A template is written as words with regions: ``[may be missing]``, ``(one | of these)`` and
``{1,6}`` for that many words of any kind, such as a name or a year. All templates are
compiled into one automaton over words, which accepts a passage if all mandatory wording
stands there exactly and in order, with nothing between that the template does not allow.
Besides, three short phrases are counted wherever their words stand in a row.

Nulls: a null or empty text has no words, no labels and score 0. Rows that repeat get the
same answer each.
"""

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm.text import per_batch, raw, words

# The phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of common licenses and notices, as templates by label. Fixed values.
TEMPLATES = [
    ("mit", "(released | licensed | distributed | available) under [the terms of] the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files (the software | the materials) to deal in the (software | materials) without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the (software | materials)"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this (file | work | software) except in compliance with the license"),
    ("gpl", "[this (work | program | software | file) is] (licensed | released | distributed) under [the terms of] the gnu "
            "general public license [as published by the free software foundation] [[either] version ( 1 | 2 | 3 ) "
            "[of the license] [or [at your option] any later version]]"),
    ("lgpl", "(licensed | released | distributed) under [the terms of] the gnu (lesser | library) general public license "
             "[version {1,2}]"),
    ("agpl", "(licensed | released | distributed) under [the terms of] the gnu affero general public license [version {1,2}]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("bsd", "(released | licensed | distributed) under [the terms of] the [( 2 | 3 | two | three ) clause] bsd license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under [a | the] (cc | creative commons) (by | attribution) [( 1 | 2 | 3 | 4 ) ( 0 | 5 )]"),
    ("cc-by-nc", "licensed under [a | the] (cc | creative commons) (by | attribution) (nc | noncommercial) [( 1 | 2 | 3 | 4 ) ( 0 | 5 )]"),
    ("cc-by-sa", "licensed under [a | the] (cc | creative commons) (by | attribution) (sa | sharealike) [( 1 | 2 | 3 | 4 ) ( 0 | 5 )]"),
    ("cc-by-nd", "licensed under [a | the] (cc | creative commons) (by | attribution) (nd | noderivatives) [( 1 | 2 | 3 | 4 ) ( 0 | 5 )]"),
    ("cc-by-nc-sa", "licensed under [a | the] (cc | creative commons) (by | attribution) (nc | noncommercial) (sa | sharealike) "
                    "[( 1 | 2 | 3 | 4 ) ( 0 | 5 )]"),
    ("cc0", "licensed under [the] (cc0 | creative commons zero) [( 1 ) ( 0 )]"),
    ("reserved", "copyright [c] {0,8} all rights reserved"),
    ("reserved", "all rights reserved"),
]
ANY = None                                  # a step that takes every word
_TOKEN = re.compile(r"\{(\d+),(\d+)\}|[\[\]()|]|[^\s\[\](){}|]+")

#: A parsed region: a word, ("any", least, most), or ("choice", optional, [sequences]).
Node = str | tuple


def parse(markup: str) -> list[Node]:
    tokens = [(m[0], m) for m in _TOKEN.finditer(markup)]

    def region(at: int, closing: str) -> tuple[list[list[Node]], int]:
        choices: list[list[Node]] = [[]]
        while at < len(tokens):
            token, match = tokens[at]
            at += 1
            if token == closing:
                return choices, at
            if token == "|":
                choices.append([])
            elif token in "[(":
                inner, at = region(at, "]" if token == "[" else ")")
                choices[-1].append(("choice", token == "[", inner))
            elif token in ")]":
                break
            elif match[1]:
                choices[-1].append(("any", int(match[1]), int(match[2])))
            else:
                choices[-1].append(token)
        if closing:
            raise ValueError(f"unbalanced region in {markup!r}")
        return choices, at
    return region(0, "")[0][0]


class Automaton:
    """All templates as one automaton; sets of its states become steps when first met."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.edges: list[list[tuple[str | None, int]]] = []      # word or ANY, next state
        self.free: list[list[int]] = []                          # next states that take no word
        self.labels: dict[int, str] = {}
        start = self.state()
        #: Of each template its longest mandatory word: a text with none of them has no match.
        self.anchors = set()
        for label, markup in templates:
            nodes = parse(markup)
            self.labels[self.add(nodes, self.join(start))] = label
            self.anchors.add(max((n for n in nodes if isinstance(n, str)), key=len).encode())
        self.known: dict[tuple[frozenset, bytes], frozenset] = {}
        self.start = self.closed({start})
        self.words = {w.encode() for edges in self.edges for w, _ in edges if w is not ANY}
        self.first = {w.encode() for s in self.start for w, _ in self.edges[s] if w is not ANY}

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def join(self, before: int, after: int | None = None) -> int:
        after = self.state() if after is None else after
        self.free[before].append(after)
        return after

    def add(self, nodes: list[Node], at: int) -> int:
        for node in nodes:
            if isinstance(node, str):
                after = self.state()
                self.edges[at].append((node, after))
                at = after
            elif node[0] == "any":
                end = self.state()
                for k in range(node[2] + 1):
                    if k >= node[1]:
                        self.join(at, end)
                    if k < node[2]:
                        after = self.state()
                        self.edges[at].append((ANY, after))
                        at = after
                at = end
            else:
                end = self.state()
                for choice in node[2]:
                    self.join(self.add(choice, self.join(at)), end)
                if node[1]:
                    self.join(at, end)
                at = end
        return at

    def closed(self, states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in out:
                    out.add(after)
                    todo.append(after)
        return frozenset(out)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.words else b"")
        if key not in self.known:
            text = key[1].decode()
            self.known[key] = self.closed({after for s in states for w, after in self.edges[s] if w is ANY or w == text})
        return self.known[key]

    def accepted(self, found: list[bytes], at: int) -> dict[str, int]:
        """Labels of the templates that match from a word on, each with the end of its longest match."""
        states, ends = self.start, {}
        for k in range(at, len(found)):
            states = self.step(states, found[k])
            if not states:
                break
            for s in states:
                if s in self.labels:
                    ends[self.labels[s]] = k + 1
        return ends


@functools.cache
def automaton(templates: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(templates)


def matches(found: list[bytes], line: bytes, machine: Automaton) -> list[tuple[str, int, int]]:
    """``label, first word, end word`` of all matches; ``line`` has the words between blanks."""
    if not any(b" " + a + b" " in line for a in machine.anchors):
        return []
    return [(label, k, end) for k, w in enumerate(found) if w in machine.first
            for label, end in machine.accepted(found, k).items()]


def places(line: bytes, phrase: bytes) -> list[int]:
    """The words at which a phrase starts."""
    out, at = [], line.find(phrase)
    while at >= 0:
        out.append(line.count(b" ", 0, at))
        at = line.find(phrase, at + 1)
    return out


def scanned(text: bytes, machine: Automaton) -> dict:
    found = words(text)
    line = b" " + b" ".join(found) + b" "
    base = [(k, phrase, label) for phrase, label in PHRASES.items() for k in places(line, f" {phrase} ".encode())]
    more = matches(found, line, machine)
    covered = {w for k, phrase, _ in base for w in range(k, k + phrase.count(" ") + 1)}
    covered.update(w for _, first, end in more for w in range(first, end))
    base_labels = {label for _, _, label in base}
    starts = [k for k, _, _ in base]
    return {"n_words": len(found), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {label for label, _, _ in more})),
            "score": len(covered) / len(found) if found else 0.0}


SCHEMA = "doc_id long,n_words long,n_base long,first_word long,last_word long,base_labels string,labels string,score double"


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per document: words, places of the phrases, labels, and the share of words that are license wording."""
    fixed = tuple(templates)

    def made(batch: pa.RecordBatch) -> dict:
        rows = [scanned(t, automaton(fixed)) for t in raw(batch)]
        names = [f.split()[0] for f in SCHEMA.split(",")[1:]]
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | {n: [r[n] for r in rows] for n in names}
    return per_batch(docs.select("doc_id", "text"), made, SCHEMA)


def passages(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, label, first_word, end_word`` of every match of a template."""
    fixed = tuple(templates)

    def made(batch: pa.RecordBatch) -> dict:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch)):
            found = words(text)
            rows += [(doc_id, *m) for m in matches(found, b" " + b" ".join(found) + b" ", automaton(fixed))]
        return {n: [r[k] for r in rows] for k, n in enumerate(("doc_id", "label", "first_word", "end_word"))}
    return per_batch(docs.select("doc_id", "text"), made, "doc_id long,label string,first_word long,end_word long")
