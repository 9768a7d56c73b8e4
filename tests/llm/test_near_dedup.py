"""Near-dedup against all pairs, on fixtures with stars, chains, copies and odd rows."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from chronopanel.llm import minhash
from chronopanel.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, size):
    sets = {}
    for key, text in rows:
        w = WORD.findall((text or "").encode().lower().decode())
        sets[key] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 5 * inter >= 4 * (len(sets[a]) + len(sets[b]) - inter):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = [(0, " ".join(base))]
    # A star of copies with few to many changes: some are linked with the hub, some only with each other, some with none.
    for i in range(1, 90):
        words = list(base)
        for _ in range(rng.randint(1, 14)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    # A chain: each is linked with the next, the ends are not.
    words = [rng.choice(vocab) for _ in range(60)]
    for i in range(100, 112):
        words = list(words)
        words[(i - 100) * 5] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "one"), (305, "É é"), (306, "é é"), (307, rows[0][1].upper())]
    rows += [(400 + i, "same text in every row of this group " * 3) for i in range(30)]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_equals_all_pairs(spark, size):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, size=size).collect()}
    want = brute(rows, size)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_odd_rows(spark):
    schema = "doc_id long, text string, n long, cls string, kept string, rep int"
    a = "a b c d e f g h"
    rows = [(1, a, 1, "x", "y", 2), (1, a, 1, "x", "y", 2), (None, a, None, None, None, None), (None, "alone here", 1, "", "", 0), (2, None, 1, "", "", 0)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, schema))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert got == sorted([(1, 7, 1, True), (1, 7, 1, True), (None, 7, 1, False), (None, 1, None, True), (2, 0, 2, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_likelihood_is_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for shared in (100, 400, 800):
        x, y = np.unique(pool[:1000]), np.unique(pool[1000 - shared : 2000 - shared])
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        rx, ry = minhash.registers(x)[None, :], minhash.registers(y)[None, :]
        got = minhash.likeliest(rx, ry, np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(got - j) < 0.12


def test_registers_merge():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    both = np.maximum(minhash.registers(x), minhash.registers(y))
    assert (minhash.registers(np.union1d(x, y)) == both).all()


def incidence(rows):
    """Sets of two-word shingles as a matrix, and the components of all pairs."""
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for _, t in rows)]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(number)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s]] = 1
    n, inter = m.sum(1), m @ m.T
    linked = 5 * inter >= 4 * (n[:, None] + n[None, :] - inter) - 1e-3
    root, todo = np.full(len(rows), -1), []
    for i in range(len(rows)):
        if root[i] < 0:
            todo, root[i] = [i], i
            while todo:
                near = np.flatnonzero(linked[todo.pop()] & (root < 0))
                root[near] = i
                todo += near.tolist()
    return {rows[i][0]: rows[r][0] for i, r in enumerate(root)}, (n, inter)


def clusters(sizes, seed=3):
    """Groups alike within, whose bases are 0.75 alike from group to group."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(280)]
    rows = []
    for g, size in enumerate(sizes):
        own = list(base) if g == 0 else [*base[:240], *(f"g{g}w{i}" for i in range(40))]
        for _ in range(size):
            words = list(own)
            words[rng.randrange(200)] = f"u{len(rows)}"
            words[rng.randrange(200)] = f"v{len(rows) % 50}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("sizes", [(400, 3000), (60, 50, 40, 30, 20, 10)])
def test_groups_that_are_nearly_alike_make_no_pairs_of_all(spark, sizes, monkeypatch):
    rows = clusters(sizes)
    want, _ = incidence(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    counts, write = {}, minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name, **kw: counts.setdefault(f"{name}-{len(counts)}", write(df, name, **kw)) and counts[list(counts)[-1]])
    kept = minhash.dropped
    monkeypatch.setattr(minhash, "dropped", lambda *tables: None)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == want
    made = {k: t.count() for k, t in counts.items()}
    assert all(n < 20 * len(rows) for k, n in made.items() if k.startswith(("links", "compared", "near", "difference-stars"))), made
    kept(*(t for t in counts.values()))


def test_links_beyond_a_hub_are_exact(spark, monkeypatch):
    """Given every class's differences from one hub, components of the links found are those of all pairs."""
    monkeypatch.setattr(minhash, "FEW", 3)
    rng = random.Random(1)
    hub = set(range(200))
    groups = [set(rng.sample(range(200, 400), 50)) for _ in range(3)]
    sets = [(hub - set(rng.sample(range(200), rng.randint(10, 40)))) | set(rng.sample(sorted(g), rng.randint(10, 45))) for g in groups for _ in range(30)]
    rows = [(bytes([i // 256, i % 256]), b"hub", len(s), len(hub), sorted(s ^ hub), 9 * len(s ^ hub) <= len(s) + len(hub)) for i, s in enumerate(sets)]
    compared = spark.createDataFrame(rows, "a binary, b binary, na long, nb long, diff array<long>, linked boolean")
    found, used = minhash.beyond_hubs(minhash.written(compared, "compared"))
    number = lambda c: len(rows) if c == b"hub" else int.from_bytes(c, "big")
    pairs = {(number(r["a"]), number(r["b"])) for r in found.collect()}
    sets.append(hub)
    assert all(9 * len(sets[a] ^ sets[b]) <= len(sets[a]) + len(sets[b]) for a, b in pairs)

    def roots(edges):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(x) for x in range(len(sets))]

    every = [(a, b) for a, b in combinations(range(len(sets)), 2) if 9 * len(sets[a] ^ sets[b]) <= len(sets[a]) + len(sets[b])]
    assert roots(pairs) == roots(every)
    assert len(used) == 2


def test_a_very_long_text(spark):
    word = " ".join(f"w{i}" for i in range(1_000_000))
    docs = spark.createDataFrame([(1, word), (2, word + " end"), (3, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 999_999, 1), (2, 1_000_000, 1), (3, 1, 3)]
