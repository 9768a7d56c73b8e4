"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may occur with up to ``n * ERRORS`` words inserted, deleted or replaced. Split into one piece
more than that budget, some piece of it then occurs unchanged. Pieces are found by one automaton over the whole text,
and around each hit the item's least edit distance is computed by Myers' bit-parallel algorithm (1999), words as
symbols. Items are a stated query set: they are taken in blocks of a bounded size. Each block is a pass of its own over
the documents, written, so the driver and each worker hold one block at a time, whatever the benchmark's size.

Words are parted by white space and compared without regard to case. Items of fewer than LEAST_WORDS words are no
evidence, as they occur in texts by chance: they are not searched for, and ``too_short`` lists them. Defined results: a
null or empty text or item matches nothing; items with equal words all match; repeated rows match each by themselves;
an empty benchmark gives empty match lists; ids of items are of any type; other columns are carried along, ``matches``
replaces one of that name in ``find_items`` but not in ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import bare, dropped, sized, written

#: Share of an item's words that may differ, least words of an item, and the characters of items in a block.
ERRORS, LEAST_WORDS = 0.2, 5
BLOCK_CHARS = 8 << 20


def normal(text: str | None) -> list[str]:
    return (text or "").lower().split()


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of the whole pattern to any stretch of the text, and the first place where such one ends."""
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j
    return best, at


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """(place, words) of ``budget`` + 1 pieces of nearly equal length that make up the item."""
    cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Finder:
    def __init__(self, items: list[tuple], errors: float, least: int = LEAST_WORDS):
        import ahocorasick

        same: dict[tuple[str, ...], list] = {}
        for item_id, text in items:
            w = normal(text)
            if len(w) >= max(least, 1):
                same.setdefault(tuple(w), []).append(item_id)
        self.items = [(list(w), ids, int(len(w) * errors)) for w, ids in same.items()]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (w, _, budget) in enumerate(self.items):
            for a, p in pieces(w, budget):
                places.setdefault(f" {' '.join(p)} ", []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in places.items():
            self.automaton.add_word(p, (len(p), where))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[dict]:
        words = normal(text)
        if not words or not self.items:
            return []
        joined = f" {' '.join(words)} "
        # Hits that put an item at nearly the same place are verified once, over all of their windows.
        windows: dict[int, list[tuple[int, int]]] = {}
        counted, at = 0, 0
        for end, (length, where) in self.automaton.iter(joined):
            begin = end - length + 1
            if begin < at:  # hits come by their ends
                counted, at = 0, 0
            counted, at = counted + joined.count(" ", at, begin), begin
            for i, a in where:
                w, _, budget = self.items[i]
                low = max(0, counted - a - budget)
                high = min(len(words), counted - a + len(w) + budget)
                spans = windows.setdefault(i, [])
                if spans and low <= spans[-1][1]:
                    spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
                else:
                    spans.append((low, high))
        out = []
        for i, spans in windows.items():
            w, ids, budget = self.items[i]
            best = min((myers(w, words[a:b]) + (a,) for a, b in spans), default=None)
            if best and best[0] <= budget:
                distance, stop, a = best
                back = myers(w[::-1], words[max(a, a + stop - len(w) - budget) : a + stop][::-1])[1]
                out += [{"item_id": k, "distance": distance, "start_word": a + stop - back, "end_word": a + stop} for k in ids]
        return sorted(out, key=lambda m: (m["item_id"] is None, m["item_id"]))


def blocks(benchmark: DataFrame, item: str, limit: int) -> Iterator[list[tuple]]:
    block, n = [], 0
    for row in bare(benchmark, item, "text").where(F.col("text").isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        n += len(row[1])
        if n >= limit:
            yield block
            block, n = [], 0
    if block:
        yield block


def too_short(benchmark: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The items that are not searched for: their words are counted as the search parts them."""

    @F.pandas_udf("long")
    def n_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(normal(t))).astype("int64")

    return benchmark.where(n_words("text") < max(least, 1))


def _matches(docs: DataFrame, block: list[tuple], errors: float, least: int, kind: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # of bounded size
    held: list[Finder] = []

    @F.pandas_udf(kind)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not held:
            held.append(Finder(shared.value, errors, least))
        for texts in batches:
            yield pd.Series([held[0](t) for t in texts], dtype=object)

    return find.asNondeterministic()("text")  # else filters made from its result would run it once more


def _found(docs: DataFrame, benchmark: DataFrame, name: str, item: str, errors: float, least: int, block_chars: int) -> DataFrame:
    """Every row with its matches as column ``name``."""
    kind = f"array<struct<item_id:{benchmark.schema[item].dataType.simpleString()},distance:bigint,start_word:bigint,end_word:bigint>>"
    rest = blocks(benchmark, item, block_chars)
    ahead = [b for b in (next(rest, None), next(rest, None)) if b]
    if len(ahead) < 2:
        return docs.withColumn(name, _matches(docs, ahead[0], errors, least, kind) if ahead else F.array().cast(kind))
    # Rows get a number that stays, and each block's pass writes the rows in which it found something.
    rows, parts = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), []
    for block in chain(ahead, rest):
        part = rows.select("__row", "text").withColumn("m", _matches(rows, block, errors, least, kind))
        parts.append(written(part.where(F.size("m") > 0).select("__row", "m"), "block-matches"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    every = written(every.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias(name)), "matches")
    dropped(*parts)
    out = rows.drop(name).join(sized(every), "__row", "left").drop("__row")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def find_items(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", errors: float = ERRORS,
               least: int = LEAST_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row with ``matches``: items that occur, the least distance in words, and where."""
    return _found(docs, benchmark, "matches", item, errors, least, block_chars)


def clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", errors: float = ERRORS, least: int = LEAST_WORDS,
          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows in which no item occurs."""
    out = _found(docs, benchmark, "__matches", item, errors, least, block_chars)
    return out.where(F.size("__matches") == 0).select(*docs.columns)
