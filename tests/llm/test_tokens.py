"""Packing, shards, counts and benchmark matching."""

from __future__ import annotations

import pathlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from chronopanel.llm import decontam, packing, tokencount, tokenids

ODD = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "word " * 20_000), (4, "word " * 20_000), (None, "é👍\n\n  x"), (6, "<s> ▁x   y\t\n z")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return rows.union(spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id + 1000000", "text")).repartition(6).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_pieces_are_the_librarys_ids_without_gaps(docs, library):
    got = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], library(r["text"]))
    at = 0
    for r in got:
        y = ids[r["doc_id"]]
        part = y[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(y) == r["doc_tokens"]
        assert (np.frombuffer(r["ids"], dtype="<u2") == part).all()
        assert r["sequence_id"] * packing.WINDOW + r["offset"] == at
        at += r["length"]
    assert at == sum(len(ids[r["doc_id"]]) for r in docs.collect())


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, part int")
    assert packing.pack(empty).count() == 0
    assert tokenids.read_shards(spark, tokenids.write_shards(empty)).count() == 0
    assert tokencount.count_tokens(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 4097])
def test_permutation(n):
    p = tokenids.Permutation(n)
    slots = p.slots(range(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (p.sequences(slots) == np.arange(n)).all()
    assert n < 64 or (slots != tokenids.Permutation(n, 9).slots(range(n))).any()


@pytest.mark.parametrize("fan", [tokenids.FAN, 3])
def test_shards_round_trip_and_resume(spark, docs, fan):
    shards = tokenids.write_shards(docs, length=256, shard_bytes=50_000, fan=fan)
    rows = tokenids.read_shards(spark, shards).orderBy("sequence_id").collect()
    assert [r["sequence_id"] for r in rows] == list(range(shards.n_sequences))
    got = np.concatenate([np.frombuffer(r["ids"], dtype="<u2") for r in rows])
    tokens = packing.with_offsets(packing.token_table(docs)).orderBy("at").collect()
    want = np.concatenate([np.frombuffer(r["ids"], dtype="<u2") for r in tokens])
    assert (got[: len(want)] == want).all() and (got[len(want) :] == tokenids.END_ID).all() and len(got) - len(want) < 256
    by_slot = {r["slot"]: r for r in rows}
    for slot in (0, shards.per_shard, shards.n_sequences - 1):
        assert shards.place(slot) == (by_slot[slot]["shard"], by_slot[slot]["byte_at"])
    assert max(r["shard"] for r in rows) > 7
    folder = pathlib.Path(shards.path.removeprefix("file://"))
    for shard in range(5):  # no shard before the slot is opened: they may be gone
        (file,) = (folder / f"region-{shard // fan:05d}").glob(f"part-{shard % fan:05d}-*")
        content = file.read_bytes()
        at = shards.place(shard * shards.per_shard + 2)[1]
        assert content[at : at + 512] == by_slot[shard * shards.per_shard + 2]["ids"]
        file.unlink()
        rest = tokenids.read_shards(spark, shards, from_slot=(shard + 1) * shards.per_shard + 3).collect()
        assert {r["slot"]: r["ids"] for r in rest} == {k: r["ids"] for k, r in by_slot.items() if k >= (shard + 1) * shards.per_shard + 3}
    assert tokenids.read_shards(spark, shards, from_slot=shards.n_sequences + 10**6).count() == 0


def test_counts_equal_the_librarys(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in tokencount.count_tokens(docs).collect():
        text = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(model.encode(text)), len(text.encode()))
        assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_counts_of_random_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng, parts = random.Random(4), ["a", "e", " ", "  ", "\n", "\t", "é", "▁", "<s>", "\0", "日本", "ab", "the", "THE", "##", "\r", "　", "👍", "1", ".", "def ", "   "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, "日本" * 2000, " " * 300, "\n" * 50]
    assert tokencount.merger(tokencount.VOCABULARY).count(texts) == [len(model.encode(t)) for t in texts]


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(pattern, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j - 1] + (w != x), row[j] + 1, now[-1] + 1))
        row = now
    return min(row), row.index(min(row))


def test_myers_equals_the_table():
    rng = random.Random(3)
    for _ in range(800):
        p, t = rng.choices("abc", k=rng.randint(1, 80)), rng.choices("abcd", k=rng.randint(0, 60))
        assert decontam.myers(p, t) == distance(p, t)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_items_equal_brute_force(spark, sf, block):
    rng = random.Random(6)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()] + [(900, None), (901, ""), (902, "one"), (903, "ONE")]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2500").limit(40).collect()]
    rows = [(1, None), (2, ""), (3, "only one here")]
    for i, t in enumerate(texts):
        words = (rng.choice(items[:12])[1]).split()
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choices(["x", "THE", "y z"], k=rng.randint(0, 1))
        rows.append((10 + i, t + "\n" + " ".join(words) + "  " + t[:50]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontam.find_items(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block)
    got = {(r["doc_id"], m["item_id"]): m["distance"] for r in out.collect() for m in r["matches"]}
    want = {}
    for d, t in rows:
        for k, x in items:
            p, w = decontam.normal(x), decontam.normal(t)
            if len(p) >= decontam.LEAST_WORDS and w and (best := distance(p, w)[0]) <= int(len(p) * decontam.ERRORS):
                want[(d, k)] = best
    assert got == want and len(want) > 10
    kept = {r["doc_id"] for r in decontam.clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert decontam.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
    short = {r["item_id"] for r in decontam.too_short(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert short == {k for k, x in items if len(decontam.normal(x)) < decontam.LEAST_WORDS} == {900, 901, 902, 903}


def test_one_block_at_a_time_and_callers_columns(spark):
    items = [(f"item {i}", " ".join(f"i{i}w{j}" for j in range(9))) for i in range(50)]
    rows = [(i, f"x {items[i][1]} y {items[(i * 7) % 50][1]}" if i < 50 else "nothing to find in this text at all", f"m{i}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string, item_id long").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    assert [len(b) for b in decontam.blocks(benchmark, "item_id", 10)] == [1] * 50
    # Each block's pass is written before the next starts, so no plan, and no worker, has an automaton of two.
    found = decontam.find_items(docs, benchmark, block_chars=10)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()
    got = {r["doc_id"]: sorted(m["item_id"] for m in r["matches"]) for r in found.collect()}
    assert got == {i: sorted({f"item {i}", f"item {i * 7 % 50}"}) if i < 50 else [] for i in range(60)}
    one = decontam.find_items(docs, benchmark)
    assert got == {r["doc_id"]: sorted(m["item_id"] for m in r["matches"]) for r in one.collect()}
    for chars in (400, 1 << 20):
        kept = decontam.clean(docs, benchmark, block_chars=chars)
        assert kept.columns == docs.columns and sorted((r["doc_id"], r["matches"]) for r in kept.collect()) == [(i, f"m{i}") for i in range(50, 60)]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000], ids=["spaces", "lines", "letters"])
def test_long_runs(spark, library, text):
    import sentencepiece

    docs = spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs).where("doc_id = 1").orderBy("start").collect()
    want = library(text)
    assert np.array_equal(np.concatenate([np.frombuffer(r["ids"], dtype="<u2") for r in rows]), want)
    got = np.concatenate([np.frombuffer(r["ids"], dtype="<u2") for r in tokenids.read_shards(spark, tokenids.write_shards(docs)).orderBy("sequence_id").collect()])
    assert np.array_equal(got[: len(want)], want)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert tokencount.merger(tokencount.VOCABULARY).count([text]) == [len(model.encode(text))]


def test_short_items_are_counted_as_the_search_parts_them(spark):
    items = spark.createDataFrame([(1, "one\u00a0two\u00a0three\u00a0four\u00a0five"), (2, "one two"), (3, None), (4, "a\u2003b\x1cc d e")], "item_id long, text string")
    assert sorted(r["item_id"] for r in decontam.too_short(items).collect()) == [2, 3]
    docs = spark.createDataFrame([(1, "zero one two three four five six")], "doc_id long, text string")
    assert [m["item_id"] for m in decontam.find_items(docs, items).first()["matches"]] == [1]
