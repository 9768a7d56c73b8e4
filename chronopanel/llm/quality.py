"""Quality classifier: cumulative-link regression on graded ratings with hashed text features.

One latent score per document, the sum of shared weights of its hashed features, is cut by ordered thresholds: the
probability of a grade above k is logistic(score - threshold k). That gives an expected grade and the probability of
the best grade, by which documents are selected.

Grades: 0 toxic, 1 poor, 2 good. Features: distinct words, their beginnings, and a few bucketed rates of the whole text. Defined results:
a null or empty text has the features of no words; with nothing to learn from, every document has null scores and is
kept; repeated rows get equal scores; a document with several labels counts with its lowest grade; columns of the
documents are carried along, but result columns (score, expected_grade, p_best, kept) replace those of the same names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import bare, sized, written

#: Hashed weights, grades, and the bound on labelled documents that the model is fitted on (the first by hash of key).
WEIGHTS, GRADES, FIT_DOCUMENTS = 1 << 20, 3, 24_000
#: Words in fewer documents of the sample have no weight; passes, step and shrinkage of the fit.
LEAST_DOCUMENTS, EPOCHS, RATE, SHRINK = 12, 12, 0.1, 2e-3
#: Selection: least probability of the best grade.
KEEP = 0.6
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"\w+")


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed features of the whole text."""
    words = _WORD.findall((text or "").lower())
    n, distinct = len(words), set(words)
    found = [zlib.crc32(w.encode("utf-8", "replace")) for w in distinct]
    found += [zlib.crc32(f"^{w}".encode("utf-8", "replace")) for w in {w[:5] for w in distinct if len(w) > 5}]
    symbols = sum(text.count(c) for c in SYMBOLS) if text else 0
    rates = {
        "length": n.bit_length(),
        **{f"symbols{k}": int(20 * symbols / (n + 1) >= 2**k) for k in range(7)},
        "distinct": int(10 * len(distinct) / n) if n > 20 else -1,
        "top": int(10 * max(Counter(words).values()) / n) if n > 20 else -1,
        "letters": int(10 * sum(map(len, words)) / (len(text) + 1)) if text else -1,
    }
    found += [zlib.crc32(f"\0{k}:{v}".encode()) for k, v in rates.items()]
    return np.unique(np.array(found, dtype=np.uint32) % WEIGHTS)


@dataclass
class Ordinal:
    """Shared weights and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Probability of a grade above 0, above 1, ... for each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def slopes(score: np.ndarray, theta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of each document's log P(grade) by its score and by the thresholds.

    P(grade) is the difference of two neighbouring tails, of which the first is 1 and the last 0.
    """
    row, n = np.arange(len(y)), len(theta)
    tail = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))
    full = np.concatenate([np.ones((len(y), 1)), tail, np.zeros((len(y), 1))], 1)
    slope = full * (1 - full)
    p = np.maximum(full[row, y] - full[row, y + 1], 1e-9)
    above, below = slope[row, y] / p, slope[row, y + 1] / p
    by_theta = np.zeros((len(y), n + 2))
    by_theta[row, y] -= above
    by_theta[row, y + 1] += below
    return above - below, by_theta[:, 1:-1]


def train(rows: list[np.ndarray], grades: np.ndarray, seed: int = 3) -> Ordinal | None:
    """Likelihood of the grades, by Adagrad over documents in random order; thresholds stay ordered by their gaps."""
    if not len(rows) or len(set(grades.tolist())) < 2:
        return None
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=WEIGHTS)
    keep = seen[flat] >= LEAST_DOCUMENTS
    flat, owner = flat[keep], owner[keep]
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    share = np.bincount(grades, minlength=GRADES) / len(grades)
    above = np.clip(1 - np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    first, gaps = -np.log(above[0] / (1 - above[0])), np.log(np.maximum(np.diff(-np.log(above / (1 - above))), 0.1))
    w, g2 = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-4)
    rng, batch = np.random.default_rng(seed), 64
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            pick = order[a : a + batch]
            idx = np.concatenate([flat[starts[i] : starts[i + 1]] for i in pick])
            own = np.repeat(np.arange(len(pick)), starts[pick + 1] - starts[pick])
            theta = np.r_[first, first + np.cumsum(np.exp(gaps))]
            up, d_theta = slopes(np.bincount(own, w[idx], len(pick)), theta, grades[pick])
            d_theta = d_theta.mean(0)
            used, at = np.unique(idx, return_inverse=True)
            g = np.bincount(at, up[own], len(used)) / np.sqrt(len(pick)) - SHRINK * w[used] * np.sqrt(len(pick))
            g2[used] += g * g
            w[used] += RATE * g / np.sqrt(g2[used])
            first += 0.1 * d_theta.sum()
            gaps += 0.1 * np.exp(gaps) * d_theta[::-1].cumsum()[::-1][1:]
    return Ordinal(w.astype(np.float32), np.r_[first, first + np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", n_docs: int = FIT_DOCUMENTS) -> Ordinal | None:
    """Fit on a bounded sample of labelled documents; only hashed features come to the driver."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = bare(labels, key, "quality", "toxic").withColumn("grade", grade).where(F.col("grade").isNotNull() & F.col(key).isNotNull())
    graded = graded.groupBy(key).agg(F.min("grade").alias("grade")).orderBy(F.xxhash64(key), key).limit(n_docs)
    graded = written(graded, "graded")

    @F.pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).astype("<u4").tobytes() for t in texts], dtype=object)

    rows = bare(docs, key, "text").join(sized(graded), key).select(hashed("text").alias("f"), "grade").collect()
    return train([np.frombuffer(r["f"], dtype="<u4") for r in rows], np.array([r["grade"] for r in rows], dtype=int))


def score(docs: DataFrame, model: Ordinal | None, keep: float = KEEP) -> DataFrame:
    """Every row with ``score``, ``expected_grade``, ``p_best`` and ``kept``."""
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.withColumns({"score": nothing, "expected_grade": nothing, "p_best": nothing, "kept": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, whatever the input

    @F.pandas_udf("score double, expected_grade double, p_best double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            s = np.array([model.weights[features(t)].sum(dtype=np.float64) for t in texts], dtype=np.float64)
            tails = model.tails(s)
            yield pd.DataFrame({"score": s, "expected_grade": tails.sum(1), "p_best": tails[:, -1]})

    out = docs.withColumn("__said", judge("text"))
    out = out.withColumns({c: F.col(f"__said.{c}") for c in ("score", "expected_grade", "p_best")})
    return out.withColumn("kept", F.col("p_best") >= keep).drop("__said")


def select(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return score(docs, fit(docs, labels, key))
