"""Token counts of a byte-pair vocabulary of pieces, by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie end to end in one array of symbols. In each round every pre-token finds its best
ranked pair and merges it, all pre-tokens at once; what survives when no pair is left is its count. A text's count is
the sum over its pre-tokens, as no piece of the vocabulary reaches over a cut between pre-tokens. Runs of white space,
whose pieces share a rank and so merge strictly from the left, and pre-tokens of thousands of symbols are merged from a
queue by rank and place, with the same result.

Defined results: a null or empty text has no tokens; repeated rows count each by themselves; characters outside the
vocabulary count as their bytes; other columns are carried along, result columns replace those of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.packing import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*")
#: Counts kept by a worker, symbols merged at once, the length beyond which a pre-token is cut further.
KEPT, AT_ONCE, LONG = 300_000, 400_000, 64
#: Symbols of a sequence, and places of one rank whose order matters, beyond which rounds would be too many: such
#: sequences are merged from a queue of their pairs, in n log n, with the same result.
ROUNDS, PLACES = 2048, 4


class Merger:
    """Counts by the vocabulary of one sentencepiece model."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        pieces = sorted(score, key=lambda p: -score[p])
        self.ids = {p: i for i, p in enumerate(pieces)}
        # Equal scores share a rank: the leftmost such pair merges first.
        self.rank = np.unique(-np.array([score[p] for p in pieces]), return_inverse=True)[1].astype(np.int64)
        self.size = len(pieces) + 1
        pairs, self.inner = {}, set()
        unsafe = np.zeros(self.size, dtype=bool)
        for p in pieces:
            self.inner.update(p[i : i + 2] for i in range(len(p) - 1))
            for i in range(1, len(p)):
                a, b = self.ids.get(p[:i]), self.ids.get(p[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = self.ids[p]
                    for side in (a, b):
                        unsafe[side] |= self.rank[self.ids[p]] <= self.rank[side]
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.unsafe, self.pairs, self.ranks = unsafe, pairs, self.rank.tolist()
        self.counts: dict[str, int] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to, or -1."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def merge(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        flat = "".join(tokens)
        ids = np.fromiter((self.ids.get(c, -1) for c in flat), dtype=np.int64, count=len(flat))
        own = np.repeat(np.arange(len(tokens)), lengths)
        # A character outside the vocabulary is as many symbols as it has bytes, and merges with nothing.
        extra = np.zeros(len(tokens), dtype=np.int64)
        for i in np.flatnonzero(ids < 0).tolist():
            extra[own[i]] += len(flat[i].encode()) - 1
        total = np.zeros(len(tokens), dtype=np.int64)
        none = np.int64(self.size)
        to = np.full(len(ids), -1, dtype=np.int64)
        same = own[:-1] == own[1:]
        to[:-1][same] = self.lookup(ids[:-1][same], ids[1:][same])
        while len(ids):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rank = np.where(to >= 0, self.rank[to], none)
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(ids)])
            live = best < none
            if not live.all():
                total[own[first[~live]]] = size[~live]
                keep = np.repeat(live, size)
                ids, own, to, rank = ids[keep], own[keep], to[keep], rank[keep]
                best, size = best[live], size[live]
                if not len(ids):
                    break
                first = np.cumsum(size) - size
            hit = np.flatnonzero(rank == np.repeat(best, size))
            lead = np.flatnonzero(np.r_[True, np.diff(own[hit]) > 0])
            hits = np.diff(np.r_[lead, len(hit)])
            # Equal ranks of different pieces, or pieces that could merge on at once, merge from the left.
            ordered = np.logical_or.reduceat(self.unsafe[to[hit]], lead)
            ordered |= np.minimum.reduceat(to[hit], lead) != np.maximum.reduceat(to[hit], lead)
            queued = ordered & (hits > PLACES) | (size > ROUNDS)
            if queued.any():
                for a, n in zip(first[queued].tolist(), size[queued].tolist(), strict=True):
                    total[own[a]] = self.in_order(ids[a : a + n].tolist())
                keep = ~np.repeat(queued, size)
                ids, own, to = ids[keep], own[keep], to[keep]
                continue
            leading = np.zeros(len(hit), dtype=bool)
            leading[lead] = True
            hit = hit[leading | ~np.repeat(ordered, hits)]
            # Of overlapping places every second one merges, the first of a run among them.
            fresh = np.r_[True, np.diff(hit) > 1]
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(fresh, place, 0))
            hit = hit[(place - run) % 2 == 0]
            ids[hit] = to[hit]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            ids, own, to = ids[keep], own[keep], to[keep]
            now = hit - np.arange(len(hit))
            around = np.union1d(now, now[now > 0] - 1)
            inside = around[around + 1 < len(ids)]
            to[around] = -1
            inside = inside[own[inside] == own[inside + 1]]
            to[inside] = self.lookup(ids[inside], ids[inside + 1])
        return total + extra

    def in_order(self, ids: list[int]) -> int:
        """Symbols left of one sequence whose pairs merge by rank and, of equal ranks, from the left."""
        n, size, pairs, rank = len(ids), self.size, self.pairs, self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [rank[m] * n + i for i in range(n - 1) if (m := pairs.get(ids[i] * size + ids[i + 1])) is not None]
        heapify(queue)
        left = n
        while queue:
            r, i = divmod(heappop(queue), n)
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            m = pairs.get(ids[i] * size + ids[j])
            if m is None or rank[m] != r:  # what the pair was has merged otherwise
                continue
            ids[i], ids[j] = m, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := pairs.get(ids[i] * size + ids[k])) is not None:
                    heappush(queue, rank[m] * n + i)
            h = before[i]
            if h >= 0 and (m := pairs.get(ids[h] * size + ids[i])) is not None:
                heappush(queue, rank[m] * n + h)
        return left

    def cut(self, token: str) -> list[str]:
        """A long pre-token, cut where no piece holds the two characters that meet."""
        cuts = [0, *[i for i in range(1, len(token)) if token[i - 1 : i + 1] not in self.inner], len(token)]
        return [token[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, tokens: set[str]) -> None:
        """Count the pre-tokens not counted yet. A leading line feed stands for itself, else a space goes before."""
        missing = [t for t in tokens if t not in self.counts]
        if len(self.counts) + len(missing) > KEPT:
            self.counts, missing = {}, list(tokens)
        for a in range(0, len(missing), 20_000):
            self._learn(missing[a : a + 20_000])

    def _learn(self, missing: list[str]) -> None:
        parts, owner = [], []
        for i, token in enumerate(missing):
            own = [token[1:], "\n"] if token[:1] == "\n" else [token] if token[:1] == SPACE else [SPACE + token]
            for p in own:
                for q in self.cut(p) if len(p) > LONG else [p] if p else []:
                    parts.append(q)
                    owner.append(i)
        sums = np.zeros(len(missing), dtype=np.int64)
        if parts:
            ends = np.cumsum([len(p) for p in parts])
            cuts = np.unique(np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] + AT_ONCE, AT_ONCE)) + 1)
            a = 0
            for b in cuts.tolist():
                if parts[a:b]:
                    np.add.at(sums, owner[a:b], self.merge(parts[a:b]))
                a = b
        self.counts.update(zip(missing, sums.tolist(), strict=True))

    def pretokens(self, text: str) -> list[str]:
        """Keys of ``counts`` in the text's order."""
        if text[0] == " " or SPACE in text or "  " in text or " \n" in text:  # runs of spaces may be pieces of their own
            return _RUNS.findall(SPACE + text.replace(" ", SPACE))
        return text.replace("\n", " \n").split(" ")

    def count(self, texts: list[str]) -> list[int]:
        out, a = [], 0
        while a < len(texts):
            group, n = [], 0
            while a < len(texts) and n < 1 << 21:
                group.append(self.pretokens(texts[a]) if texts[a] else [])
                n, a = n + len(texts[a]), a + 1
            self.learn(set().union(*group))
            known = self.counts.__getitem__
            out += [sum(map(known, g)) for g in group]
        return out


@lru_cache(maxsize=2)
def merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Every row with ``n_bytes``, ``n_tokens`` and ``over_limit``."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = merger(vocabulary)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()), dtype="int64")

    body = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": tokens(body)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
