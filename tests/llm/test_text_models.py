"""Language, quality and rules: held-out accuracy, brute force and odd rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronopanel.llm import langid, quality, rules
from chronopanel.llm import queries as llm
from tests.compare import connect, same

DOCS = "doc_id long, text string, lang string, source string, score string, n_words string"


def odd(spark):
    rows = [(1, None, None, None, "", ""), (2, "", "en", "a", "", ""), (3, "12 34 !!", "en", "a", "", ""), (3, "12 34 !!", "en", "a", "", ""),
            (None, "the and of", "en", "a", "", ""), (5, "x" * 300_000, "de", "b", "", ""), (6, "wort " * 40_000, "de", "b", "", "")]
    return spark.createDataFrame(rows, DOCS)


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.identify(docs)
    r = out.where("held_out AND lang IS NOT NULL AND text rlike '\\\\p{L}'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95
    assert 0 <= r[1] <= r[2] <= 1


def test_language_of_odd_rows(spark):
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in langid.identify(odd(spark)).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False)} <= got
    none = langid.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert langid.identify(odd(spark).limit(0)).count() == 0


def test_windows_cover_the_text():
    raw = bytes(range(256)) * 3 + b"end"
    w = langid.windows_of(raw)
    assert w.shape[1] == langid.WINDOW
    assert bytes(w[-1])[-3:] == b"end"
    assert b"".join(bytes(x) for x in w[:-1]) == raw[: len(raw) // langid.WINDOW * langid.WINDOW]


def test_sample_is_stratified_and_whole(spark):
    rows = [(f"text {i} of many", "en") for i in range(3000)] + [(f"selten {i}", "de") for i in range(3)] + [("copied text", "en")] * 500 + [("copied text", "de")] * 2
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string").repartition(5), "text", "lang", 50, 9).collect()
    assert len(got) == 54 and {r["t"] for r in got if r["l"] == "de"} == {"copied text", *(f"selten {i}" for i in range(3))}
    again = langid.sample(spark.createDataFrame(rows[::-1], "text string, lang string").repartition(3), "text", "lang", 50, 9).collect()
    assert sorted(got) == sorted(again)
    raw = b"".join(b"%05d" % i for i in range(40_000))
    parts = np.frombuffer(langid.drawn(raw), dtype=np.uint8).reshape(-1, langid.WINDOW)
    assert len(parts) == langid.FIT_WINDOWS and max(raw.index(bytes(p)) for p in parts) > len(raw) // 2


def small_network(seed):
    rng = np.random.default_rng(seed)
    net = langid.start(["a", "b", "c"], rng)
    net.bias += rng.normal(0, 0.3, len(net.bias)).astype(np.float32)
    return net, rng.integers(0, 256, (9, langid.WINDOW), dtype=np.uint8), rng.integers(0, 3, 9), rng.random(9).astype(np.float32) + 0.5


def test_pooling_equals_a_plain_loop():
    net, x, _, _ = small_network(1)
    pooled, where = net.pool(x)
    for r, window in enumerate(x):
        j = 0
        for width, table in net.tables.items():
            for f in range(langid.FILTERS):
                responses = [sum(float(table[k][window[i + k]][f]) for k in range(width)) for i in range(langid.WINDOW - width + 1)]
                assert abs(max(responses) + net.bias[j] - pooled[r, j]) < 1e-4
                assert abs(responses[where[r, j]] - max(responses)) < 1e-4
                j += 1
    assert np.allclose(net.fast().pool(x), pooled, atol=1e-4)


def test_gradient_of_the_network():
    net, x, y, weight = small_network(2)
    for name in ("bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.tables = {w: t.astype(np.float64) for w, t in net.tables.items()}

    def loss():
        p = net.log_probabilities(net.pool(x)[0])
        return float(-(p[np.arange(len(y)), y] * weight).mean())

    params = [net.bias, net.out, net.out_bias, *net.tables.values()]
    rng = np.random.default_rng(3)
    for p, g in zip(params, langid.gradients(net, x, y, weight), strict=True):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in {*rng.integers(0, len(flat), 15).tolist(), *np.argsort(-np.abs(slope))[:10].tolist()}:
            was, step = flat[i], 1e-4
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            numeric = (up - loss()) / (2 * step)
            flat[i] = was
            assert abs(numeric - slope[i]) < 2e-3 * max(1, abs(slope[i]))


def test_language_keeps_clashing_columns(spark):
    rows = [(i, "der die das und " * 5 if i % 2 else "the and of to " * 5, "de" if i % 2 else "en", "mine", "x", i) for i in range(60)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, l string, h int"))
    assert out.where("l = 'x' AND h = doc_id").count() == 60 and dict(out.dtypes)["held_out"] == "boolean"
    assert out.where("lang = lang_pred").count() == 60


def test_slopes_of_the_ordinal_model():
    rng = np.random.default_rng(5)
    theta, score, y = np.array([-0.7, 1.1]), rng.normal(0, 2, 40), rng.integers(0, 3, 40)

    def log_p(score, theta):  # by the definition: P(grade > k) is logistic(score - threshold k)
        above = [1.0 / (1 + np.exp(t - score)) for t in theta]
        p = np.stack([1 - above[0], above[0] - above[1], above[1]])
        return np.log(p[y, np.arange(len(y))])

    by_score, by_theta = quality.slopes(score, theta, y)
    step = 1e-5
    assert np.allclose(by_score, (log_p(score + step, theta) - log_p(score - step, theta)) / (2 * step), atol=1e-5)
    for k in range(2):
        d = np.eye(2)[k] * step
        assert np.allclose(by_theta[:, k], (log_p(score, theta + d) - log_p(score, theta - d)) / (2 * step), atol=1e-5)
    model = quality.Ordinal(np.zeros(4), theta)
    assert np.allclose(model.tails(score), np.stack([1 / (1 + np.exp(t - score)) for t in theta], 1))


def test_quality_scores_are_sums_of_weights(spark):
    rng = np.random.default_rng(6)
    model = quality.Ordinal(rng.normal(0, 1, quality.WEIGHTS).astype(np.float32), np.array([-1.0, 0.5]))
    rows = [(1, "a b c"), (2, None), (3, "### x"), (4, "word " * 50_000)]
    for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        s = sum(float(model.weights[f]) for f in set(quality.features(dict(rows)[r["doc_id"]]).tolist()))
        tails = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        assert np.allclose([r["score"], r["expected_grade"], r["p_best"]], [s, sum(tails), tails[-1]], atol=1e-4)
        assert r["kept"] == (r["p_best"] >= quality.KEEP)


def test_quality_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} good text", "mine", "s", i) for i in range(9)], "doc_id long, text string, grade string, score string, kept int")
    labels = spark.createDataFrame([(i, i % 2, 0, "l") for i in range(9)], "doc_id long, quality int, toxic int, text string")
    out = quality.select(docs, labels)
    assert out.where("grade = 'mine'").count() == 9 and dict(out.dtypes)["kept"] == "boolean" and dict(out.dtypes)["score"] == "double"


def test_quality_tells_grades(spark, sf):
    path = sf.rsplit("/", 1)[0] + "/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet")
    seen = labels.where("doc_id % 4 <> 0")
    out = quality.select(docs, seen).join(labels.where("doc_id % 4 = 0"), "doc_id")
    r = {(q, t): k for q, t, k in out.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert r[(1, 0)] > 0.95
    assert r[(1, 1)] < 0.25
    assert r[(0, 0)] < 0.35


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out = quality.select(odd(spark), labels)  # one grade alone teaches nothing
    assert {r["kept"] for r in out.collect()} == {True}
    labels = spark.createDataFrame([(2, 1, 0), (6, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.select(odd(spark), labels).where("p_best between 0 and 1 and expected_grade between 0 and 2").count() == 7


WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[(w[i], w[i + 1], w[i + 2])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").union(odd(spark).select("doc_id", "text", "source"))
    for r in rules.measure(docs).collect():
        assert tuple(r[c] for c in rules.MEASURES) == brute(r["text"]), r["doc_id"]


def test_rules_equal_sql(spark, sf):
    same(llm.queries()["op10_host_quality_rules"](spark, sf), connect(sf), llm.oracle_sql()["op10_host_quality_rules"])


def hosts(spark):
    """Eight hosts alike, one with many soft failures, one that fails for the most part, one with a single bad document."""
    good, short = " ".join(f"w{i}" for i in range(80)), "too short"
    noisy = " ".join(f"w{i}###" for i in range(80))
    rows = [(f"h{h}", noisy if i % 20 == 0 else good) for h in range(8) for i in range(200)]
    rows += [("noisy", noisy if i % 2 else good) for i in range(100)] + [("bad", short if i < 95 else good) for i in range(100)]
    rows += [("one", noisy), (None, noisy), (None, good)]
    return [(i, s, t) for i, (s, t) in enumerate(rows)], good, noisy


def test_hosts_decide_documents_with_soft_failures(spark):
    rows, good, noisy = hosts(spark)
    out = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    kept = lambda s, t: {r["kept"] for r in out if r["source"] == s and r["text"] == t}
    assert all(kept(f"h{h}", t) == {True} for h in range(8) for t in (good, noisy))
    assert kept("noisy", good) == {True} and kept("noisy", noisy) == {False}  # decided by their host
    assert kept("bad", good) == {False}  # fails as a whole
    assert kept(None, noisy) == kept(None, good) == {True}
    rate = {r["source"]: r["host_rate"] for r in out}
    assert 0.2 < rate["one"] < 0.8 and rate["h0"] < 0.06  # one document shrinks a long way, two hundred don't
    alike = rules.apply_rules(spark.createDataFrame([r for r in rows if (r[1] or "").startswith("h")], "doc_id long, source string, text string"))
    assert alike.where("kept").count() == 1600 and alike.where("host_strict").isEmpty()


def test_host_rules_equal_sql(spark, tmp_path):
    rows, *_ = hosts(spark)
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(str(tmp_path), ["documents"])
    name = "op10_host_quality_rules"
    same(llm.queries()[name](spark, str(tmp_path)), con, llm.oracle_sql()[name])


def test_rules_keep_clashing_columns_apart(spark):
    rows = [(1, "a", "x " * 60, "mine", "old", 3)]
    out = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, kept string, text string, base_failed string, note string, n_lines int"), host="kept")
    r = out.first()
    assert (r["note"], r["n_lines"], r["base_failed"], r["kept"]) == ("old", 1, True, False) and "__host" not in out.columns


def test_rules_of_odd_rows(spark):
    out = rules.apply_rules(odd(spark)).collect()
    assert len(out) == 7 and all(not r["kept"] for r in out if r["base_failed"])
    assert rules.apply_rules(odd(spark).limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rows = [(f"{lang} text {i}", lang) for lang in ("aa", "bb", "cc", "dd", "ee") for i in range(40)] + [("only one", "ff")]
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string").repartition(3), "text", "lang", 30, 2).groupBy("l").count().collect()
    assert dict(map(tuple, got)) == dict.fromkeys(("aa", "bb", "cc", "dd", "ee"), 10) | {"ff": 1}


def test_very_long_texts_are_read_whole(spark):
    long = [(1, "wort und die der " * 60_000 + "zz", "de"), (2, "the word and of " * 60_000 + "zz", "en"), (4, "der die das und " * 30, "de"), (5, "and of the is " * 30, "en")]
    got = langid.predict(spark.createDataFrame(long, "doc_id long, text string, lang string"), langid.fit(spark.createDataFrame(long, "doc_id long, text string, lang string")))
    assert {(r["doc_id"], r["lang_pred"]) for r in got.collect()} == {(1, "de"), (2, "en"), (4, "de"), (5, "en")}
    graded = quality.select(spark.createDataFrame(long, "doc_id long, text string, lang string"), spark.createDataFrame([(4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"] for r in graded.collect()} == {1, 2, 4, 5}
