"""Language identification by a convolutional network over bytes, trained here with numpy.

Input is a window of bytes as one-hot rows, so a filter of width w is w tables of 256 weights; filters of several
widths are max-pooled over the window, rectified and fed to a softmax. A text is cut into windows that cover it whole;
its probabilities are the mean of its windows' log-probabilities, normalised.

The network is fitted on a bounded sample, stratified by language: of each language the first texts by hash, of each text
windows drawn from all of it. A rare language is learned from what there is of it.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from every text
is ``und`` with score 0; repeated rows get equal predictions; a text of any length is read whole, a group of windows at a
time; columns besides text and language are carried along and
result columns replace those of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import sized, written

UNKNOWN = "und"
#: Bytes in a window, widths of filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: The network is fitted on at most so many labelled documents of each language, the first by a hash of their text, and on
#: so many windows of each, drawn from the whole text. That holds up to so many languages; if there are more, all of them
#: are learned and share that many documents evenly, at least one each. The bounds hold at any size of the corpus.
FIT_DOCUMENTS, FIT_WINDOWS, FIT_LANGUAGES = 1500, 6, 200
EPOCHS, BATCH, RATE = 6, 256, 0.01


@dataclass
class Network:
    """Tables (filters by place in the filter by byte), biases and the softmax layer."""

    langs: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pool(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the window and its place. windows: (n, WINDOW) bytes."""
        by_place = np.ascontiguousarray(windows.T)
        best, where = [], []
        for width, table in self.tables.items():
            top = np.full((windows.shape[0], FILTERS), -np.inf, dtype=np.float32)
            at = np.zeros((windows.shape[0], FILTERS), dtype=np.int16)
            for i in range(windows.shape[1] - width + 1):
                x = table[0][by_place[i]]
                for k in range(1, width):
                    x += table[k][by_place[i + k]]
                higher = x > top
                at[higher] = i
                np.maximum(top, x, out=top)
            best.append(top)
            where.append(at)
        return np.concatenate(best, 1) + self.bias, np.concatenate(where, 1)

    def fast(self) -> FastPool:
        return FastPool(self)

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


class FastPool:
    """The same pooling for prediction: tables of byte pairs halve the look-ups."""

    def __init__(self, net: Network):
        self.bias, self.pairs, self.single = net.bias, {}, {}
        for width, t in net.tables.items():
            self.pairs[width] = [
                (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, width - 1, 2)
            ]
            self.single[width] = t[width - 1] if width % 2 else None

    def pool(self, windows: np.ndarray) -> np.ndarray:
        single = np.ascontiguousarray(windows.T)
        pair = (single[:-1].astype(np.int32) << 8) | single[1:]
        out = []
        for width, tables in self.pairs.items():
            top = np.full((windows.shape[0], FILTERS), -np.inf, dtype=np.float32)
            for i in range(windows.shape[1] - width + 1):
                x = tables[0].take(pair[i], axis=0)
                for j in range(1, len(tables)):
                    x += tables[j].take(pair[i + 2 * j], axis=0)
                if self.single[width] is not None:
                    x += self.single[width].take(single[i + width - 1], axis=0)
                np.maximum(top, x, out=top)
            out.append(top)
        return np.concatenate(out, 1) + self.bias


def windows_of(raw: bytes) -> np.ndarray:
    """The whole text in windows of equal length; the last one ends with the text, a short text is filled with zeros."""
    a = np.frombuffer(raw, dtype=np.uint8)
    if len(a) <= WINDOW:
        return np.pad(a, (0, WINDOW - len(a)))[None, :]
    full = a[: len(a) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return full if len(a) % WINDOW == 0 else np.concatenate([full, a[None, -WINDOW:]])


def drawn(raw: bytes, n: int = FIT_WINDOWS) -> bytes:
    """``n`` windows of a text, or all if it has fewer, drawn at random from all of it but alike for equal texts."""
    w = windows_of(raw)
    if len(w) > n:
        w = w[np.sort(np.random.default_rng([len(raw), *raw[:64]]).choice(len(w), n, replace=False))]
    return w.tobytes()


def start(names: list[str], rng: np.random.Generator) -> Network:
    n_all = FILTERS * len(WIDTHS)
    return Network(
        names,
        {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(n_all, dtype=np.float32),
        rng.normal(0, 0.3, (n_all, len(names))).astype(np.float32),
        np.zeros(len(names), dtype=np.float32),
    )


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted cross entropy, by bias, softmax layer, its bias, and each width's tables. It reaches the tables
    through each filter's best place only."""
    pooled, where = net.pool(x)
    rows = np.arange(len(y))
    d = np.exp(net.log_probabilities(pooled))
    d[rows, y] -= 1
    d *= weight[:, None] / len(y)
    back = (d @ net.out.T) * (pooled > 0)
    out = [back.sum(0), np.maximum(pooled, 0).T @ d, d.sum(0)]
    for j, w in enumerate(WIDTHS):
        g = np.zeros_like(net.tables[w])
        at, part = where[:, j * FILTERS : (j + 1) * FILTERS], back[:, j * FILTERS : (j + 1) * FILTERS]
        for k in range(w):
            np.add.at(g[k], (x[rows[:, None], at + k], np.arange(FILTERS)[None, :]), part)
        out.append(g)
    return out


def train(samples: list[tuple[bytes, str]], seed: int = 7) -> Network | None:
    """Fit by Adam on the cross entropy of windows, each language's of equal weight. ``samples``: windows and language."""
    names = sorted({lang for _, lang in samples})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    number = {n: i for i, n in enumerate(names)}
    x = np.frombuffer(b"".join(w for w, _ in samples), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.repeat([number[lang] for _, lang in samples], [len(w) // WINDOW for w, _ in samples])
    net = start(names, rng)
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y].astype(np.float32)
    params = [net.bias, net.out, net.out_bias, *net.tables.values()]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a : a + BATCH]
            step += 1
            for p, g, mm, vv in zip(params, gradients(net, x[pick], y[pick], weight[pick]), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                rate = RATE * (0.3 if epoch >= EPOCHS - 2 else 1)
                p -= (rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(labelled: DataFrame, text: str, lang: str, n_docs: int, n_langs: int) -> DataFrame:
    """(h, l, t): of each language the first different texts by hash, ``n_docs`` or, beyond ``n_langs`` languages, an even
    share of ``n_docs * n_langs``; a text with several labels may be in the sample of each.

    Hashes are uniform, so a language's share of its hashes that is expected to hold twice the bound is looked at; only
    those are ordered, and no language's rows meet in one task before.
    """
    hashes = labelled.where(F.col(lang).isNotNull() & has_letter(text)).select(F.col(lang).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    langs = written(hashes.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    n_docs = max(min(n_docs, n_docs * n_langs // max(langs.count(), 1)), 1)
    share = langs.select("l", (F.lit(2.0 * n_docs) / F.col("n")).alias("share"))
    first = hashes.join(sized(share, langs), "l").where(F.shiftrightunsigned("h", 11) / F.lit(2.0**53) < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.shiftrightunsigned("h", 1), "h"))
    chosen = written(first.select("h", "l").distinct().withColumn("rank", rank).where(F.col("rank") <= n_docs).select("h", "l"), "language-sample")
    return hashes.join(sized(chosen), ["h", "l"]).groupBy("h", "l").agg(F.min("t").alias("t"))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", n_docs: int = FIT_DOCUMENTS, n_langs: int = FIT_LANGUAGES) -> Network | None:
    """Train on a bounded sample; only its texts' windows come to the driver."""

    @F.pandas_udf("binary")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([drawn(t.encode("utf-8", "replace")) for t in texts], dtype=object)

    rows = sample(labelled, text, lang, n_docs, n_langs).select("h", "l", windows("t").alias("w")).orderBy("h", "l").collect()
    return train([(bytes(r["w"]), r["l"]) for r in rows])


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``score``, its probability."""
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size, whatever the input
    names = np.array(net.langs)

    @F.pandas_udf("lang_pred string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        fast = net.fast()
        for texts in batches:
            log_p = np.zeros((len(texts), len(names)))
            held, owner, n = [], [], 0

            def flush(log_p=log_p, held=held, owner=owner):
                if held:
                    own = np.repeat(owner, [len(w) for w in held])
                    w = np.concatenate(held)
                    for a in range(0, len(w), 4096):
                        lp = net.log_probabilities(fast.pool(w[a : a + 4096]))
                        np.add.at(log_p, own[a : a + 4096], lp)
                    held.clear()
                    owner.clear()

            count = np.ones(len(texts))
            for i, t in enumerate(texts):
                if t:
                    w = windows_of(t.encode("utf-8", "replace"))
                    held.append(w)
                    owner.append(i)
                    count[i] = len(w)
                    n += len(w)
                    if n >= 1 << 15:
                        flush()
                        n = 0
            flush()
            mean = log_p / count[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            yield pd.DataFrame({"lang_pred": names[p.argmax(1)], "score": p.max(1)})

    letters = has_letter(text)
    out = docs.withColumn("__said", classify(F.when(letters, F.col(text))))
    out = out.withColumn("__letters", letters)
    return out.withColumns(
        {
            "lang_pred": F.when(F.col("__letters"), F.col("__said.lang_pred")).otherwise(UNKNOWN),
            "score": F.when(F.col("__letters"), F.col("__said.score")).otherwise(0.0),
        }
    ).drop("__said", "__letters")


def held_out(key: str = "doc_id") -> Column:
    """The rows that training never sees: a third of all keys."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, and predict every row."""
    marked = docs.withColumn("held_out", held_out(key))
    return predict(marked, fit(marked.where(~F.col("held_out")), text, lang), text)
