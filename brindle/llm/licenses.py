"""License scans by template-markup matching.

A template is wording with ``[[optional]]`` regions and ``{{n}}`` regions replaceable by up to n words.
It compiles into an automaton over words; a text is labelled where the automaton accepts a run of its
words, so all mandatory wording has to match exactly and in order. Besides, three base phrases are
counted everywhere.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Defined results: a null or
empty text has no words, no labels, score 0 and null places; every place counts, repeated or
overlapping; repeated rows are each answered; a null doc_id is passed on."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._tables import pick
from brindle.llm._text import ALNUM, pieces, strings, word_hashes, words

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TEMPLATES = [
    ("gpl-3", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3"),
    ("gpl-2", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2"),
    ("lgpl", "licensed under the [[terms of the]] gnu lesser general public license [[as published by the free software foundation either]] version {{1}}"),
    ("agpl-3", "licensed under the [[terms of the]] gnu affero general public license [[as published by the free software foundation either]] version 3"),
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", "licensed under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the [[terms of the]] apache license version 2 [[0]]"),
    ("cc-by-nc", "licensed under [[a]] cc by nc [[4 0]]"),
    ("cc-by-nc", "licensed under [[a]] creative commons attribution noncommercial [[{{2}} international]] license"),
    ("cc-by-sa", "licensed under [[a]] cc by sa [[4 0]]"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law {{12}} has waived all copyright"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd-3", "[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("spdx", "spdx license identifier {{4}}"),
]

_MARK = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|\S+?(?=\[\[|\]\]|\{\{|\s|$)")


class Automaton:
    """A template compiled: ``step[state]`` lists (word or None for any, next state); 0 is the start."""

    def __init__(self, template: str):
        self.step: list[list[tuple[str | None, int]]] = [[]]
        skip: list[tuple[int, int]] = []
        opened: list[int] = []
        run: list[str] = []
        runs = [run]
        for m in _MARK.findall(template):
            here = len(self.step) - 1
            if m == "[[":
                opened.append(here)
                run = []
                runs.append(run)
            elif m == "]]":
                skip.append((opened.pop(), here))
                run = []
                runs.append(run)
            elif m.startswith("{{"):
                run = []
                runs.append(run)
                for _ in range(int(m[2:-2])):
                    self.step[-1].append((None, len(self.step)))
                    self.step.append([])
                    skip.append((len(self.step) - 2, here + int(m[2:-2])))
            else:
                self.step[-1].append((m, len(self.step)))
                self.step.append([])
                if not opened:
                    run.append(m)
        if opened:
            raise ValueError("a [[ is never closed")
        self.last = len(self.step) - 1
        self.free: list[set[int]] = [{s} for s in range(len(self.step))]
        for s in reversed(range(len(self.step))):
            for a, z in skip:
                if a == s:
                    self.free[s] |= self.free[z]
        self.first = {w for s in self.free[0] for w, _ in self.step[s]}
        if None in self.first or self.last in self.free[0]:
            raise ValueError("a template must start with a word and have mandatory wording")
        #: The longest run of mandatory words: a text without it can't match.
        self.anchor = max(runs, key=lambda r: (min(len(r), 3), sum(map(len, r[:3]))))[:3]
        if not self.anchor:
            raise ValueError("a template must have mandatory wording")

    def end(self, seq: list[str], at: int) -> int | None:
        """Where the longest match from ``at`` ends, or None."""
        live, found = self.free[0], None
        for i in range(at, len(seq) + 1):
            if self.last in live:
                found = i
            if i == len(seq):
                break
            live = {f for s in live for w, z in self.step[s] if w is None or w == seq[i] for f in self.free[z]}
            if not live:
                break
        return found


def compiled(templates=None) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in (TEMPLATES if templates is None else templates)]


def _hash(phrase: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(phrase).encode(), np.uint8)
    a, z, _ = words(raw, np.array([0, len(raw)]), ALNUM)
    return word_hashes(raw, a, z)


_LOW = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _judge(text: str, base, automata):
    """What one text has: places of base phrases, base labels, labels, score."""
    seq = _WORD.findall(text.translate(_LOW))
    at: dict[str, list[int]] = {}
    for i, w in enumerate(seq):
        at.setdefault(w, []).append(i)
    places, first = [], set()
    for phrase, label in base:
        for i in at.get(phrase[0], ()):
            if seq[i : i + len(phrase)] == phrase:
                places.append(i)
                first.add(label)
    more = {label for label, a in automata if any(a.end(seq, i) is not None for w in a.first for i in at.get(w, ()))}
    return places, first, first | more, 1.0 if more else 0.5 if first else 0.0


def scan(docs: DataFrame, templates=None, base: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Words are hashed a batch at a time; only texts that hold a base phrase or some template's longest
    mandatory run (by hash, so none is missed) are read word by word."""
    automata = compiled(templates)
    phrases = [(p.split(), label) for p, label in (BASE if base is None else base).items()]
    needles = [_hash(p) for p, _ in phrases] + [_hash(a.anchor) for _, a in automata]
    heads = np.array([n[0] for n in needles], np.uint64)

    @F.arrow_udf("struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double>")
    def find(col: pa.Array) -> pa.Array:
        out = []
        for b in pieces([pa.RecordBatch.from_arrays([col], ["t"])], "t"):
            buf, offs = strings(b.column(0))
            a, z, row = words(buf, offs, ALNUM)
            h = word_hashes(buf, a, z, lower=True)
            n = np.bincount(row, minlength=b.num_rows)
            hit: set[int] = set()
            at = np.flatnonzero(np.isin(h, heads))
            for needle in needles:
                i = at[h[at] == needle[0]]
                for k in range(1, len(needle)):
                    i = i[i + k < len(h)]
                    i = i[h[i + k] == needle[k]]
                hit.update(row[i].tolist())
            for r in range(b.num_rows):
                places, first, all_, score = _judge(buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace"), phrases, automata) if r in hit else ([], (), (), 0.0)
                out.append((int(n[r]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(first)), ",".join(sorted(all_)), score))
        cols = list(zip(*out)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    d = pick(docs, doc_id="bigint", text="string").withColumn("_r", find(F.col("text")))
    return d.select("doc_id", "_r.*")


def pattern(template: str) -> str:
    """The template as a regular expression over words that each follow one space."""
    out = re.sub(r"\s*\[\[\s*", "(?: ", template)
    out = re.sub(r"\s*\]\]", ")?", out)
    out = re.sub(r"\s*\{\{(\d+)\}\}", r"(?: [^ ]+){0,\1}", out)
    return " " + re.sub(r"\(\?: \(\?:", "(?:(?:", out).strip() + " "


def oracle() -> str:
    """The same rows in DuckDB."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = []
    for p in BASE:
        w = p.split()
        places.append(f"list_filter(range(1, len(w) - {len(w) - 2}), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(w)) + ")")
    label = lambda kinds: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(kinds) + "], lambda x: x is not null))), ',')"
    base = [f"case when len(p{k}) > 0 then '{v}' end" for k, v in enumerate(BASE.values())]
    more = [f"case when regexp_matches(s, '{pattern(t)}') then '{v}' end" for v, t in TEMPLATES]
    ps = [f"p{k}" for k in range(len(BASE))]
    allp = f"list_concat(list_concat({ps[0]}, {ps[1]}), {ps[2]})"
    return f"""
with a as (select doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' s, {", ".join(f"{x} p{k}" for k, x in enumerate(places))} from a),
c as (select doc_id, len(w) n_words, {allp} p, {label(base)} base_labels, {label(base + more)} labels,
  case when len(list_filter([{", ".join(more)}], lambda x: x is not null)) > 0 then 1.0 when len({allp}) > 0 then 0.5 else 0.0 end score from b)
select doc_id, n_words::bigint n_words, len(p)::bigint n_base, (list_min(p) - 1)::bigint first_word, (list_max(p) - 1)::bigint last_word, base_labels, labels, score::double score from c"""
