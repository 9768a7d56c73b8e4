"""License templates, fill-in-the-middle and the conversation trie: SQL, brute force and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronopanel.llm import infill, licenses, trie
from chronopanel.llm import queries as llm
from tests.compare import connect, same

NEW = ("op11_license_templates", "op12_rank_select_infill", "op13_patricia_conversations")


@pytest.mark.parametrize("name", NEW)
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf, name, size):
    path = f"{sf.rsplit('/', 1)[0]}/{size}"
    same(llm.queries()[name](spark, path), connect(path), llm.oracle_sql()[name])


# Fill in the middle

TOKEN = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\né <P>", max_size=60))
def test_rank_and_select_are_those_of_a_list(text):
    raw = text.encode()
    starts = [m.start() for m in TOKEN.finditer(raw)]
    b = infill.Boundaries(raw)
    assert b.total == len(starts)
    assert [b.select(k) for k in range(len(starts) + 1)] == [*starts, len(raw)]
    assert [b.rank(i) for i in range(len(raw) + 1)] == [sum(s < i for s in starts) for i in range(len(raw) + 1)]


def test_rank_and_select_over_blocks_and_chunks():
    rng = random.Random(5)
    raw = b"".join(rng.choice([b" ", b"\n", b"x", b"word", b"\xc3\xa9" * 300]) for _ in range(60_000))
    assert len(raw) > 2 * infill.CHUNK
    starts = [m.start() for m in TOKEN.finditer(raw)]
    b = infill.Boundaries(raw)
    assert b.total == len(starts)
    for k in [0, 1, len(starts) - 1, *(rng.randrange(len(starts)) for _ in range(500))]:
        assert b.select(k) == starts[k] and b.rank(starts[k]) == k


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<PSM> aé", max_size=30), st.integers(0, 10**6))
def test_every_text_comes_back(text, key):
    raw = text.encode()
    n, form, prefix, middle, output = infill.rearranged(raw, str(key), rate=100)
    assert infill.rebuilt(output, form) == raw
    units = TOKEN.findall(raw)
    h = [int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if any(s in text for s in infill.SENTINELS) or not text:
        assert form == "plain" and output == raw and prefix is middle is None
        return
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = (b"".join(x) for x in (units[:a], units[a:b], units[b:]))
    assert output == (b"<S>" + s + b"<P>" + p + b"<M>" + m if h[3] % 100 < 80 else b"<P>" + p + b"<S>" + s + b"<M>" + m)
    assert (n, prefix, middle) == (len(units), len(p.decode()), len(m.decode()))


def test_infill_of_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "y", 2), (None, " \t\n ", None, 3), (4, "word " * 1_000_000, "z", 4), (5, "a <S> b", "n", 5), (5, "a <S> b", "n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `a.b` long")
    broken = docs.limit(1).select(F.lit(9).cast("long").alias("doc_id"), F.unhex(F.lit("61FF2062FE")).cast("string").alias("text"), F.lit("").alias("form"), F.lit(9).cast("long").alias("a.b"))
    out = infill.transform(docs.unionByName(broken), rate=100)
    assert out.columns == ["doc_id", "text", "form", "a.b", "n", "prefix_chars", "middle_chars", "output"]
    got = out.select("`a.b`", "n", "form", (F.coalesce(infill.restored().cast("binary"), F.lit(b"?")) == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("back")).collect()
    assert all(r["back"] for r in got) and len(got) == 7
    told = {r["a.b"]: (r["n"], r["form"]) for r in got}
    assert told[1] == told[2] == (0, "plain") and told[3][0] == 1 and told[4][0] == 1_000_001 and told[5][1] == "plain" and told[9][0] == 2
    assert infill.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.transform(docs, sentinels=("<a<", "<b>", "<c>"))


# License templates

def expansions(items, words):
    """All wordings of a parsed template, any words drawn from ``words``: the brute-force form of an automaton."""
    out = [()]
    for x in items:
        if isinstance(x, bytes):
            more = [(x,)]
        elif x[0] == "optional":
            more = [(), *expansions(x[1], words)]
        else:
            more, last = [], [()]
            for k in range(x[2] + 1):
                more += last if k >= x[1] else []
                last = [a + (w,) for a in last for w in words]
        out = [a + b for a in out for b in more]
    return out


PARTS = st.recursive(st.sampled_from(["a", "b", "c"]), lambda inner: st.lists(inner, min_size=1, max_size=3).map(lambda xs: f"<<beginOptional>>{' '.join(xs)}<<endOptional>>"), max_leaves=3)
VARS = st.sampled_from(["<<var;name=x;words=0-1>>", "<<var;name=x;words=1-2>>"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(PARTS, VARS), max_size=4), min_size=1, max_size=3), st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=12))
def test_automata_accept_what_wordings_say(bodies, text):
    templates = tuple((f"t{k}", " ".join(["a", *b, "c"])) for k, b in enumerate(bodies))
    machine = licenses.Automaton(templates)
    raw = [w.encode() for w in text]
    n, found = machine.run(" ".join(text).encode())
    want = {}
    for k, (_, markup) in enumerate(templates):
        for wording in set(expansions(licenses.parsed(markup), [b"a", b"b", b"c", b"d"])):
            for i in range(len(raw)):
                if tuple(raw[max(0, i + 1 - len(wording)) : i + 1]) == wording:
                    want[k, i] = min(want.get((k, i), i), i + 1 - len(wording))
    assert n == len(text) and set(found) == set(want) and len(found) == len(want)
    assert all(machine.begin(raw, k, i) == a for (k, i), a in want.items())


def test_mandatory_wording_must_match(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit, "x"), (2, mit.replace("sublicense", "relicense"), "x"), (3, mit.replace("and associated documentation files (the \"Software\"), ", ""), "x"), (4, "Neither", "x"),
            (5, "This tool is licensed under the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "x"),
            (6, "GNU General Public License, perhaps version 3", "x"), (7, None, "x"), (8, "", "x"), (None, "under the MITé license", "x"), (9, "CC-BY/NC " * 300_000, "x"), (9, "Under THE mit License under the MIT license", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = [(r["doc_id"], r["labels"], r["n_base"], r["first_word"], r["last_word"]) for r in licenses.scan(docs).collect()]
    assert got == [(1, "mit", 0, None, None), (2, "", 0, None, None), (3, "mit", 0, None, None), (4, "", 0, None, None), (5, "gpl-3", 0, None, None), (6, "", 0, None, None),
                   (7, "", 0, None, None), (8, "", 0, None, None), (None, "", 0, None, None), (9, "cc-by-nc", 300_000, 0, 899_997), (9, "mit", 2, 0, 4)]
    spans = licenses.scan(docs).where("doc_id = 5").select(F.inline("wordings")).collect()
    assert [(r["label"], r["start_word"], r["end_word"]) for r in spans] == [("gpl-3", 6, 20)]
    assert licenses.scan(docs.limit(0)).count() == 0
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>", "<<var;name=x;words=1-2>> a", "<<else>> a"):
        with pytest.raises(ValueError):
            licenses.scan(docs, templates=(("x", bad),))


# Conversation trie

def brute(rows):
    """The nodes from their definition, over plain lists."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), d, (role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = [*own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h], *turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        kids = sum(len(x) == len(k) + 1 for x in below)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids, leaves, sum((len(members[x]) - 1) * words(x) for x in below),
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()))
    return sorted(out, key=str)


def tree(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1))
    return sorted(map(tuple, trie.nodes(df, **kw).collect()), key=str)


def test_trie_of_odd_rows(spark):
    rows = [(0, 0, "u", "a b"), (0, 1, "a", None), (0, None, None, "first"), (1, 0, None, None), (2, 0, "u", "a b"), (2, 1, "a", ""), (2, 1, "a", ""), (25, 0, "u", "x"),
            (27, 3, "u", " \t "), (None, 0, "u", "lost"), (None, None, None, None), (40, 0, "u", "word " * 200_000), (41, 0, "u", "word " * 200_000), (-7, 0, "u", "neg")]
    assert tree(spark, rows) == brute(rows)
    assert tree(spark, []) == []
    assert tree(spark, [(5, 0, "u", "x")]) == brute([(5, 0, "u", "x")])


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force_over_many_slices(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(160):
        if seed == 3 and c % 3:  # copies of one conversation
            rows += [(c, d, "u", f"same {d}") for d in range(9)]
        else:
            rows += [(c, d, rng.choice(["u", "a"]), rng.choice(["x", "y y", "z z z"]) if seed else "x") for d in range(rng.randrange(1, 12))]
    rng.shuffle(rows)
    assert tree(spark, rows, run=5, slice_bytes=1 << (8 + 2 * seed)) == brute(rows)


def test_slices_merge_to_one():
    """Points of a sequence list cut anywhere sum to those of the whole."""
    rng = random.Random(1)
    seqs = sorted({tuple(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(120)})
    key = lambda s: b"".join(hashlib.md5(x.encode()).digest() for x in s)
    rows = sorted((key(s), i, [ord(x) for x in s]) for i, s in enumerate(seqs))

    def sums(cuts):
        total = defaultdict(lambda: [0, 0, 0, 0])
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            part = rows[a:b]
            left = trie.common_turns(rows[a - 1][0], rows[a][0]) if a else -1
            right = trie.common_turns(rows[b - 1][0], rows[b][0]) if b < len(rows) else -1
            s = trie.Slice([r[0] for r in part], [r[1] for r in part], [1] * len(part), [r[2] for r in part], left, right)
            for p in range(len(s.depth)):
                for k, x in enumerate((s.n[p], s.children[p], s.leaves[p], s.saved[p])):
                    total[s.prefix(p)][k] += x
        return total

    whole = sums([])
    for _ in range(30):
        cuts = sorted(rng.sample(range(1, len(rows)), rng.randrange(1, 9)))
        got = sums(cuts)
        assert all(got[k] == v for k, v in whole.items())


def test_long_and_equal_keys():
    a = b"".join(hashlib.md5(str(i).encode()).digest() for i in range(5000))
    for k in (0, 1, 17, 4999):
        b = a[: 16 * k] + bytes(16) + a[16 * k + 16 :]
        assert trie.common_turns(a, b) == k
    assert trie.common_turns(a, a[:160]) == 10 and trie.common_turns(a, a) == 5000
