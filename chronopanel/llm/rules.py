"""Quality rules with host-level verdicts, DataFrame functions only.

``measure`` counts what the rules look at within each text; ``base_rules`` decides single documents by hard rules (too
short, too repetitive) and marks those that fail a soft one (many symbols, many repeated lines), which may be noise or
the genre of a document. ``host_verdicts`` sums failures of any rule by host and shrinks each host's rate towards the
corpus with an empirical beta prior; ``apply_rules`` joins the verdicts back.

The cut comes from the posterior: a host is strict where its rate is above the corpus's with a probability of nine in
ten, and its documents that fail a soft rule go. On other hosts soft failures are let pass. Of a host whose shrunk rate
is above one half all documents go. The prior's spread is what hosts differ by beyond chance: where they don't differ,
it is narrow, rates shrink to its mean and hardly any host is strict. Documents that fail no rule are touched by the
second verdict alone.

Defined results: a null text has no words and fails; an empty text likewise; a document with a null host has no host
verdict and stands on its own; repeated rows are judged each by themselves; columns besides ``text`` and the host are
carried through untouched, but result columns replace those of the same names. A host column named like a result is
read before it is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import sized, words, written

#: Hard rules: least words, and the most percent of words that lie in repeated three-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Soft rules: the most percent of symbols to words, and of repeated lines to lines.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: Shrunk rate above which a host goes; deviations of its posterior by which a strict host is above the corpus (those of
#: a probability of 0.9); the least and most documents that the prior may weigh.
MAX_HOST_RATE = 0.5
STRICT_DEVIATIONS = 1.2816
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "soft_failed", "host_rate", "host_strict", "host_failed", "kept")
_HIDDEN = ("__words", "__grams", "__sorted", "__starts", "__lines")


def _covered(starts: Column) -> Column:
    """Words covered by windows of three that begin at the ascending ``starts``."""
    gaps = F.transform(
        starts, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(starts, i - F.lit(1))))
    )
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """Add the measures of each whole text. Sorting windows keeps this n log n in the text's words."""
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    joined = F.array_join("__words", "")
    out = docs.drop(*MEASURES, "n_lines").withColumn("__words", words("text")).withColumn("__lines", lines)
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.length(F.regexp_replace(joined, "[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__grams": F.transform(
                F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))),
                lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2)),
            ),
        }
    )
    # Only texts with a repeated window sort their windows with places.
    repeats = F.size(F.array_distinct("__grams")) < F.size("__grams")
    placed = F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    out = out.withColumn("__sorted", F.when(repeats, placed))
    twice = F.filter(
        "__sorted",
        lambda x, i: ((i > 0) & (F.get("__sorted", i - F.lit(1))["h"] == x["h"]))
        | F.coalesce(F.get("__sorted", i + F.lit(1))["h"] == x["h"], F.lit(False)),
    )
    out = out.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["at"])))
    out = out.withColumn("n_repeat_words", F.coalesce(_covered(F.col("__starts")), F.lit(0).cast("long")))
    return out.drop(*_HIDDEN)


def base_rules(measured: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``soft_failed``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (
        100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    )
    return measured.withColumns({"base_failed": failed, "soft_failed": soft})


def host_verdicts(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row a host, written: documents, failures, shrunk rate, whether it is strict, whether it fails.

    The prior is fitted by moments: hosts' rates vary by chance as much as binomial counts would, the rest of their
    variance is the prior's. It is one row; hosts are summed before they are shuffled, so a hot host is no hot task.
    """
    hosts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n_docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("n_failed")
    )
    hosts = written(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    failures, docs = F.sum("n_failed").cast("double"), F.sum("n_docs")
    m, v, per_doc, corpus = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_docs")), failures / docs).first()
    m, spread = m or 0.0, (v or 0.0) - (m or 0.0) * (1 - (m or 0.0)) * (per_doc or 0.0)
    weight = m * (1 - m) / spread - 1 if spread > 0 else MOST_WEIGHT
    weight = min(max(weight, LEAST_WEIGHT), MOST_WEIGHT)
    shrunk = (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight))
    out = hosts.withColumn("host_rate", shrunk)
    r = F.col("host_rate")
    deviation = F.sqrt(r * (1 - r) / (F.col("n_docs") + F.lit(weight + 1)))
    out = out.withColumns({"host_strict": r - STRICT_DEVIATIONS * deviation > F.lit(corpus or 0.0), "host_failed": r > MAX_HOST_RATE})
    out._written = hosts._written
    return out


def apply_rules(docs: DataFrame, host: str = "source", with_text: bool = True) -> DataFrame:
    """Every document with its measures, ``base_failed``, ``soft_failed``, ``host_rate``, its host's verdicts and ``kept``.

    What was measured is written once, as both the sums by host and the join back read it; without ``with_text`` the
    texts are left out of that.
    """
    judged = base_rules(measure(docs.withColumn("__host", F.col(f"`{host}`")).drop(*VERDICTS)))
    judged = written(judged if with_text else judged.drop("text"), "judged")
    hosts = host_verdicts(judged, "__host")
    out = judged.join(sized(hosts.select("__host", "host_rate", "host_strict", "host_failed"), hosts), "__host", "left").drop("__host")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("host_strict", "host_failed")})
    kept = ~F.col("base_failed") & ~F.col("host_failed") & ~(F.col("host_strict") & F.col("soft_failed"))
    return out.withColumn("kept", kept)


def oracle() -> str:
    white = "[\\x20\\x09-\\x0D]+"
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines,
                  row_number() OVER () AS rn FROM documents),
grams AS (SELECT rn, pos, words[pos:pos + 2] AS g FROM (SELECT rn, words, unnest(range(1, len(words) - 1)) AS pos FROM w)),
twice AS (SELECT rn, pos FROM grams QUALIFY count(*) OVER (PARTITION BY rn, g) > 1),
covered AS (SELECT rn, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY rn),
m AS (SELECT doc_id, source, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '{white}', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered c USING (rn)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines
             AS soft_failed FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS k
          FROM f WHERE source IS NOT NULL GROUP BY 1),
moments AS (SELECT coalesce(avg(k / n), 0) AS a, coalesce(var_pop(k / n), 0) AS v, coalesce(avg(1 / n), 0) AS c,
                   coalesce(sum(k) / sum(n), 0) AS corpus FROM hosts),
spread AS (SELECT a, corpus, v - a * (1 - a) * c AS s FROM moments),
prior AS (SELECT a, corpus, least(greatest(CASE WHEN s > 0 THEN a * (1 - a) / s - 1 ELSE {MOST_WEIGHT} END,
                                           {LEAST_WEIGHT}), {MOST_WEIGHT}) AS weight FROM spread),
rates AS (SELECT source, corpus, n + weight + 1 AS seen, (k + a * weight) / (n + weight) AS r FROM hosts, prior),
rated AS (SELECT source, r, r - {STRICT_DEVIATIONS} * sqrt(r * (1 - r) / seen) > corpus AS strict FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed,
       NOT base_failed AND NOT coalesce(r > {MAX_HOST_RATE}, FALSE) AND NOT (soft_failed AND coalesce(strict, FALSE)) AS kept
FROM f LEFT JOIN rated USING (source)
"""
