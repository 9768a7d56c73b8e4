"""The pipeline's stages against the operators' brute-force forms, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from chronopanel.llm import decontam, langid, packing
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_text_models import brute as measures


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name == "packing":
            assert out.groupBy("doc_id").count().count() == len(before)
            assert {r["sequence_id"] for r in out.collect()} == set(range(-(-out.groupBy().sum("length").first()[0] // packing.WINDOW)))
            break
        assert out.columns == first
        after = {r["doc_id"]: r for r in out.collect()}
        assert all(before[k] == r for k, r in after.items())
        if name == "language":
            said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
            want = {k for k, (lang, score) in said.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
        elif name == "quality rules":
            failed = {k for k, r in before.items() if (m := measures(r["text"]))[0] < 50 or 100 * m[4] > 50 * m[0]}
            want = set(before) - failed  # no host here fails as a whole
        elif name == "near-dedup":
            want = {k for k, (_, c) in near([(k, r["text"]) for k, r in before.items()], corpus_pipeline.SHINGLE).items() if k == c}
        else:
            items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leak = lambda t: any(decontam.myers(p, decontam.normal(t))[0] <= int(len(p) * decontam.ERRORS) for p in items)
            want = {k for k, r in before.items() if not leak(r["text"])}
        assert set(after) == want, name
        docs = out
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark, sf):
    long = [" ".join(f"w{k}x{j}" for j in range(80)) for k in range(5)]
    rows = [(1, long[0]), (1, long[0]), (1, long[0]), (2, long[0] + " end")]  # repeats with a near copy
    rows += [(-3, long[1]), (7, long[1]), (7, long[2]), (9, long[2])]  # one id with two texts, one of them a copy
    rows += [(None, long[3]), (None, long[3]), (None, long[4]), (10, long[4]), (None, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()]
    want = [(1, long[0]), (-3, long[1]), (7, long[2]), (None, long[3]), (10, long[4]), (None, None), (11, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def odd(spark):
    """Nulls, empty and very long texts, repeats, and columns that operators use inside."""
    good = " ".join(f"word{i % 97} and the of" for i in range(60))
    texts = [None, "", " \n\t ", good, good, good + " end", "short text", "the word and of it " * 100_000, "12 34 ## " * 40]
    rows = [(i if i % 3 else None, t, "en" if i % 2 else None, None if i % 4 == 0 else f"http://h{i % 2}.org/", "a", i, "b", 1.5, "c", "d", "e", True) for i, t in enumerate(texts * 2)]
    names = "doc_id long, text string, lang string, source string, kept string, n_words long, matches string, score double, cls string, `a.b` string, host string, held_out boolean"
    return spark.createDataFrame(rows, names)


def test_stages_take_any_rows(spark, sf):
    given = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (given, given.limit(0)):
            got = stage(spark, docs, sf).collect()
            if docs is not given:
                assert got == [], name
            elif name == "packing":
                assert sum(r["length"] for r in got) > 18 and {r["doc_id"] for r in got} >= {None, 1, 2}
            else:
                left = docs.collect()
                assert all(r in left for r in got), name
                told = [(r["doc_id"], r["text"]) for r in got]
                if name == "decontamination":
                    assert len(told) == 18  # nothing here is an item
                if name == "near-dedup":
                    assert sum(t is not None and t.startswith("word0") for _, t in told) == 1 and sum(t is not None and t.startswith("the word") for _, t in told) == 1
                if name == "quality rules":
                    assert not [t for _, t in told if t is None or len(t.split()) < 50]
