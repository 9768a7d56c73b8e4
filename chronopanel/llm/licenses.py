"""License scan by template markup: notices with optional and replaceable regions, compiled into token automata.

A template is wording in the markup of license lists: ``<<beginOptional>>`` to ``<<endOptional>>`` may be missing,
``<<var;name=who;words=1-9>>`` stands for that many words of any kind, all else is mandatory. Each template becomes a
position automaton (Glushkov: a state is a word of the template, and follows lead over regions that are left out); all
of them are run together over a text's words, wherever a wording may begin, as one automaton that is made deterministic
as texts ask for it. A template is accepted only where its mandatory words match exactly and in order, with nothing
between them but its regions. Base phrases are templates without regions, so all their places come from the same run.

Words are runs of characters other than ASCII controls, punctuation and space, A-Z lower-cased. Defined results: null and
empty texts have no words, no labels, score 0 and null places; overlapping places count each; texts are read whole, as a
stream of words, in bounded memory besides the text; repeated rows get equal results; no row meets another, so no key is
hot; other columns are carried along, and result columns replace those of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases: wording and label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_SOFTWARE = (
    "this software is provided by the copyright <<beginOptional>>holder<<endOptional>> <<beginOptional>>holders<<endOptional>>"
    " <<var;name=who;words=0-12>> as is and any express or implied warranties including but not limited to the implied warranties of"
    " merchantability and fitness for a particular purpose are disclaimed"
)
_BSD_2 = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
    " conditions are met <<var;name=bullet;words=0-1>> redistributions of source code must retain the above copyright notice this list of"
    " conditions and the following disclaimer <<var;name=bullet;words=0-1>> redistributions in binary form must reproduce the above copyright"
    " notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
#: Public license wordings (fixed values) as templates: label and markup. Several templates may bear one label.
TEMPLATES = (
    ("mit", "<<beginOptional>>this <<var;name=work;words=1-3>> is<<endOptional>> <<beginOptional>>released<<endOptional>>"
            " <<beginOptional>>licensed<<endOptional>> <<beginOptional>>available<<endOptional>> under the"
            " <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"
            " <<beginOptional>>and associated documentation files the software<<endOptional>> to deal in the software without restriction"
            " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
            " software and to permit persons to whom the software is furnished to do so subject to the following conditions the above"
            " copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included"
            " in all copies or substantial portions of the software <<beginOptional>>the software is provided as is without warranty of"
            " any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
            " and noninfringement<<endOptional>>"),
    ("bsd-2-clause", _BSD_2 + _SOFTWARE),
    ("bsd-3-clause", _BSD_2 + "<<var;name=bullet;words=0-1>> neither the name of <<var;name=who;words=1-12>> nor the names of"
                     " <<var;name=who;words=1-3>> contributors may be used to endorse or promote products derived from this software without"
                     " specific prior written permission " + _SOFTWARE),
    ("isc", "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without"
            " fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0 <<beginOptional>>the license<<endOptional>>"
                 " <<beginOptional>>you may not use this file except in compliance with the license<<endOptional>>"),
    ("apache-2", "<<beginOptional>>the<<endOptional>> apache <<beginOptional>>software<<endOptional>> license"
                 " <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2 0"),
    ("gpl-2", "<<beginOptional>>under the terms of the<<endOptional>> gnu general public license"
              " <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 2"
              " <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>"),
    ("gpl-3", "<<beginOptional>>under the terms of the<<endOptional>> gnu general public license"
              " <<beginOptional>>as published by the free software foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 3"
              " <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>"),
    ("lgpl-2.1", "gnu lesser general public license <<beginOptional>>as published by the free software foundation"
                 " <<beginOptional>>either<<endOptional>><<endOptional>> version 2 1"),
    ("agpl-3", "gnu affero general public license <<beginOptional>>as published by the free software foundation"
               " <<beginOptional>>either<<endOptional>><<endOptional>> version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution"
                 " noncommercial <<var;name=terms;words=0-2>> 4 0 <<beginOptional>>international<<endOptional>> license"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution 4 0"
              " <<beginOptional>>international<<endOptional>> license"),
)
#: Words of evidence at which the score is one half.
HALF = 2
#: Deterministic states that a worker keeps; beyond, it starts them anew.
MOST_STATES = 20_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;[^>]*?words=(\d+)-(\d+)>>|[^<]+|<")


def words_of(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw.lower())


def parsed(markup: str) -> list:
    """A template as a list of words (bytes), ("optional", list) and ("any", least, most)."""
    stack: list[list] = [[]]
    for m in _MARK.finditer(markup):
        mark = m.group()
        if mark == "<<beginOptional>>":
            stack.append([])
        elif mark == "<<endOptional>>":
            if len(stack) < 2:
                raise ValueError("an optional region ends that did not begin")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif m.group(1):
            stack[-1].append(("any", int(m.group(1)), int(m.group(2))))
        elif "<" in mark:
            raise ValueError(f"unknown markup at {m.start()}: {markup[m.start() : m.start() + 40]!r}")
        else:
            stack[-1] += words_of(mark.encode())
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return stack[0]


def mandatory(items: list) -> int:
    """Mandatory words of a template: those of no region."""
    return sum(isinstance(x, bytes) for x in items)


class Automaton:
    """Templates' position automata run as one; state 0 is where no wording has begun."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.labels = [label for label, _ in templates]
        self.symbol: list[bytes | None] = []  # of each position; None is any word
        self.follow: list[set[int]] = []
        self.first: set[int] = set()
        self.ends: dict[int, int] = {}  # last positions and their template
        self.evidence, self.length, self.begins = [], [], []
        for k, (label, markup) in enumerate(templates):
            items = parsed(markup)
            first, last, empty = self._add(items)
            if empty or any(self.symbol[p] is None for p in first):
                raise ValueError(f"a wording of {label} may be empty or begin with any word")
            self.first |= first
            self.begins.append(first)
            self.ends |= dict.fromkeys(last, k)
            self.evidence.append(mandatory(items))
            self.length.append(len(items) if mandatory(items) == len(items) else None)  # of a plain phrase
        self.vocabulary = {w for w in self.symbol if w is not None}
        self.openers = {self.symbol[p] for p in self.first}
        self._restart()

    def _position(self, symbol: bytes | None) -> int:
        self.symbol.append(symbol)
        self.follow.append(set())
        return len(self.symbol) - 1

    def _add(self, items: list) -> tuple[set[int], set[int], bool]:
        """First and last positions of a sequence, and whether it may be empty; follows are set on the way."""
        first, last, empty = set(), set(), True
        for x in items:
            if isinstance(x, bytes):
                p = self._position(x)
                parts = [({p}, {p}, False)]
            elif x[0] == "optional":
                parts = [(*self._add(x[1])[:2], True)]
            else:
                parts = [({p}, {p}, j >= x[1]) for j in range(x[2]) for p in [self._position(None)]]
            for f, e, may_lack in parts:
                for p in last:
                    self.follow[p] |= f
                first = first | f if empty else first
                last = last | e if may_lack else e
                empty = empty and may_lack
        return first, last, empty

    def _restart(self) -> None:
        self.sets, self.number, self.moves, self.accepts = [frozenset()], {frozenset(): 0}, [{}], [()]

    def _move(self, state: int, word: bytes | None) -> int:
        """The state after a word (None: one that no template has), made if it is new."""
        reach = set(self.first)
        for p in self.sets[state]:
            reach |= self.follow[p]
        after = frozenset(q for q in reach if self.symbol[q] is None or self.symbol[q] == word)
        if after not in self.number:
            self.number[after] = len(self.sets)
            self.sets.append(after)
            self.moves.append({})
            self.accepts.append(tuple(sorted({self.ends[p] for p in after if p in self.ends})))
        self.moves[state][word] = self.number[after]
        return self.number[after]

    def run(self, raw: bytes) -> tuple[int, list[tuple[int, int]]]:
        """How many words the text has, and (template, word at which a wording of it ends), in order."""
        found, state, at, openers, vocabulary = [], 0, -1, self.openers, self.vocabulary
        if len(self.sets) > MOST_STATES:
            self._restart()
        for at, m in enumerate(_WORD.finditer(raw.lower())):
            word = m.group()
            if not state and word not in openers:
                continue
            if word not in vocabulary:
                word = None
            after = self.moves[state].get(word)
            state = self._move(state, word) if after is None else after
            if self.accepts[state]:
                found += [(k, at) for k in self.accepts[state]]
        return at + 1, found

    def begin(self, words: list[bytes], template: int, end: int) -> int:
        """The earliest word at which a wording of the template begins that ends at ``end``: its automaton run back."""
        here = {p for p, k in self.ends.items() if k == template and self.symbol[p] in (None, words[end])}
        best, at = end, end
        while here:
            if here & self.begins[template]:
                best = at
            at -= 1
            if at < 0:
                break
            here = {p for p in range(max(here)) if self.follow[p] & here and self.symbol[p] in (None, words[at])}
        return best


@lru_cache(maxsize=4)
def automaton(phrases: tuple, templates: tuple) -> Automaton:
    return Automaton((*((label, words) for words, label in phrases), *templates))


def scanned(raw: bytes, machine: Automaton, n_phrases: int) -> tuple:
    """(words, places of base phrases, first and last of them, base labels, labels, score, accepted wordings)."""
    n, found = machine.run(raw)
    places = [at - machine.length[k] + 1 for k, at in found if k < n_phrases]
    base = {machine.labels[k] for k, _ in found if k < n_phrases}
    first_end: dict[int, int] = {}
    for k, at in found:
        first_end.setdefault(k, at)
    most = max((machine.evidence[k] for k in first_end), default=0)
    matches = []
    if first_end:
        words = words_of(raw)
        matches = [(machine.labels[k], k - n_phrases if k >= n_phrases else None, machine.begin(words, k, at), at + 1) for k, at in first_end.items()]
    labels = ",".join(sorted({machine.labels[k] for k in first_end}))
    return (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), labels,
            most / (most + HALF), sorted(matches, key=lambda m: (m[2], m[3], m[0])))


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """Every row with the columns of FIELDS and ``wordings``: each phrase or template that was accepted, where it first was.

    ``score`` grows with the mandatory words of the longest accepted wording, of a phrase or template: m / (m + HALF).
    """
    automaton(phrases, templates)  # markup errors show here, not in a task
    kind = FIELDS + ", wordings array<struct<label:string,template:int,start_word:bigint,end_word:bigint>>"

    @F.pandas_udf(kind)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(phrases, templates)
        names = [f.split()[0] for f in kind.split(", ")]
        for texts in batches:
            rows = [scanned(bytes(t), machine, len(phrases)) for t in texts]
            out = pd.DataFrame(rows, columns=names).astype({"first_word": "Int64", "last_word": "Int64"})
            out["wordings"] = [[dict(zip(("label", "template", "start_word", "end_word"), m, strict=True)) for m in r[-1]] for r in rows]
            yield out

    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit("").cast("binary"))
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["wordings"]
    out = docs.withColumn("__scan", look(raw))
    return out.withColumns({c: F.col(f"__scan.{c}") for c in names}).drop("__scan")


def _pattern(items: list) -> str:
    """A template as a pattern over words that are each followed by a space."""
    out = ""
    for x in items:
        if isinstance(x, bytes):
            out += x.decode() + " "
        elif x[0] == "optional":
            out += f"(?:{_pattern(x[1])})?"
        else:
            out += f"(?:[^ ]+ ){{{x[1]},{x[2]}}}"
    return out


def oracle() -> str:
    base, n = "", " + ".join(f"len(p{k})" for k in range(len(PHRASES)))
    for k, (phrase, _) in enumerate(PHRASES):
        ws = phrase.split()
        fits = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(ws))
        base += f", list_filter(range(0, greatest(len(w) - {len(ws) - 1}, 0)), lambda i: {fits}) AS p{k}"
    says = [f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)]
    size = [f"CASE WHEN len(p{k}) > 0 THEN {len(p.split())} ELSE 0 END" for k, (p, _) in enumerate(PHRASES)]
    test = ""
    for k, (label, markup) in enumerate(TEMPLATES):
        items = parsed(markup)
        test += f", regexp_matches(j, ' {_pattern(items)}') AS t{k}"
        says.append(f"CASE WHEN t{k} THEN '{label}' END")
        size.append(f"CASE WHEN t{k} THEN {mandatory(items)} ELSE 0 END")
    joined = lambda xs: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))), ',')"
    every = "list_concat(" * (len(PHRASES) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(PHRASES)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
             FROM documents),
placed AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j{base} FROM cut),
tested AS (SELECT *{test} FROM placed),
scored AS (SELECT *, {every} AS places, greatest({', '.join(size)}) AS most FROM tested)
SELECT doc_id, len(w) AS n_words, {n} AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       {joined(says[: len(PHRASES)])} AS base_labels, {joined(says)} AS labels, most::DOUBLE / (most + {HALF}) AS score
FROM scored
"""
