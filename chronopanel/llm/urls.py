"""URL filter: rules by host and path, and for the rest a character language-model ratio. DataFrame functions only.

Two variable-order Markov models of characters (contexts of up to three, each order smoothed by the one below) are
counted from the different whole URLs, query and fragment included, that rules accept and reject. A URL's score is the
mean over its characters of the log-likelihood difference; the cut between the classes is calibrated on labelled URLs
held out from the counts.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; if either class has no
labelled URL the models say nothing, every score is 0 and the verdict is allow; repeated rows get equal verdicts;
``url`` and the key are read, other columns are carried along and result columns replace those of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import BROADCAST_BYTES, dropped, sized, written

#: (verdict, host, path) in the order of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Weight of the shorter context's estimate, pseudo-count of a character, and hexadecimal digits that begin the MD5 of
#: labelled URLs held out for the cut.
BACKOFF = 2.0
PSEUDO = 0.5
HELD_OUT = ("0", "1", "2", "3")
#: Most frequent grams that are scored in the row where the table of grams is too large to broadcast.
HOT = 1000
PAD = "\u0002\u0002\u0002"
END = "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u, parts = F.coalesce(F.col(url), F.lit("")), "^(?s:.*?)://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, parts, 1), _UPPER, _LOWER), F.regexp_extract(u, parts, 2)


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(texts: DataFrame, *keep: str) -> DataFrame:
    """One row a character and its three before it. Rows carry no whole URL, as one may be long."""
    chars = texts.select(*keep, F.split(F.concat(F.lit(PAD), F.col("lm_text"), F.lit(END)), "").alias("c"))
    four = F.transform(F.sequence(F.lit(0), F.size("c") - 4), lambda i: F.concat(*[F.get("c", i + k) for k in range(4)]))
    return chars.select(*keep, F.explode(four).alias("gram"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """From (gram, acc, rej, n) counts, one row a gram: log of its last character's probability ratio after the others."""
    def sums(key: Column, name: str) -> DataFrame:
        return grams.groupBy(key.alias(name)).agg(F.sum("acc").alias(f"{name}_acc"), F.sum("rej").alias(f"{name}_rej"))

    cut = lambda a, n: F.substring("gram", a, n)
    keys = {"g3": cut(2, 3), "g2": cut(3, 2), "g1": cut(4, 1), "x3": cut(1, 3), "x2": cut(2, 2), "x1": cut(3, 1)}
    out = grams
    for name, key in keys.items():
        out = out.withColumn(name, key).join(sums(key, name), name)
    n_acc, n_rej = grams.agg(F.sum("acc"), F.sum("rej")).first()
    n_chars = grams.select(cut(4, 1)).distinct().count()

    def log_p(side: str, total) -> Column:
        p = (F.col(f"g1_{side}") + PSEUDO) / F.lit(float((total or 0) + PSEUDO * (n_chars + 1)))
        for count, context in (("g2", "x1"), ("g3", "x2")):
            p = (F.col(f"{count}_{side}") + BACKOFF * p) / (F.col(f"{context}_{side}") + BACKOFF)
        return F.log((F.col(side) + BACKOFF * p) / (F.col(f"x3_{side}") + BACKOFF))

    known = bool(n_acc and n_rej)
    return out.select("gram", "n", (log_p("acc", n_acc) - log_p("rej", n_rej) if known else F.lit(0.0)).alias("ratio"))


def mean_ratios(texts: DataFrame, ratios: DataFrame, limit: int) -> DataFrame:
    """(id, says, score): the mean ratio of each text's grams.

    Some grams are in every URL. Where the ratios are too large to broadcast, each text's equal grams are counted first,
    the HOT most frequent are looked up in a side of so many rows, and only the others meet the ratios by gram.
    """
    if ratios._written[1] <= limit:
        return _grams(texts, "id", "says").join(F.broadcast(ratios), "gram").groupBy("id", "says").agg(F.avg("ratio").alias("score"))
    counted = _grams(texts, "id", "says").groupBy("id", "says", "gram").agg(F.count("*").alias("c"))
    hot = ratios.orderBy(F.desc("n"), "gram").limit(HOT).select("gram", F.col("ratio").alias("known"))
    looked = written(counted.join(F.broadcast(hot), "gram", "left"), "url-gram-counts")
    rest = looked.where("known IS NULL").drop("known").join(ratios.select("gram", F.col("ratio").alias("known")), "gram")
    both = looked.where("known IS NOT NULL").select("id", "says", "c", "known").union(rest.select("id", "says", "c", "known"))
    return both.groupBy("id", "says").agg((F.sum(F.col("c") * F.col("known")) / F.sum("c")).alias("score"))


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule``, ``score`` (null where a rule decides) and ``verdict``."""
    host, path = host_and_path(url)
    rows = pages.withColumns({"host": host, "path": path})
    rule, says = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "__says": says, "__id": F.md5(F.coalesce(F.col(url), F.lit("")))})
    # Equal URLs are counted and scored once.
    texts = written(
        rows.groupBy(F.col("__id").alias("id")).agg(
            F.min("__says").alias("says"),
            F.min(F.coalesce(F.col(url), F.lit(""))).alias("lm_text"),
            F.substring("__id", 1, 1).isin(*HELD_OUT).alias("held_out"),
        ),
        "url-texts",
    )
    learn = F.when(F.col("held_out"), F.lit(0)).otherwise(F.lit(1))
    counts = _grams(texts, "says", "held_out").groupBy("gram").agg(
        F.sum(F.when(F.col("says") == "allow", learn).otherwise(0)).alias("acc"),
        F.sum(F.when(F.col("says") == "block", learn).otherwise(0)).alias("rej"),
        F.count("*").alias("n"),
    )
    counts = written(counts, "url-grams")
    ratios = written(gram_scores(counts), "url-ratios")
    wanted = texts.where(F.col("says").isNull() | F.col("held_out"))
    scored = written(mean_ratios(wanted, ratios, limit), "url-scores")
    cut = threshold(scored)
    dropped(texts, counts, ratios)
    scores = scored.where(F.col("says").isNull()).select(F.col("id").alias("__id"), "score")
    out = rows.drop("score", "verdict").join(sized(scores, scored), "__id", "left")
    verdict = F.coalesce("__says", F.when(F.col("score") >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block")))
    return out.withColumn("verdict", verdict).drop("__id", "__says")


def threshold(scored: DataFrame) -> float:
    """Where the held-out classes' means lie equally many of their own deviations away; 0 if a class is missing."""
    by = {
        r["says"]: (r["m"], r["s"])
        for r in scored.where(F.col("says").isNotNull())
        .groupBy("says")
        .agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
        .collect()
    }
    if len(by) < 2:
        return 0.0
    (ma, sa), (mr, sr) = by["allow"], by["block"]
    return (ma * sr + mr * sa) / (sa + sr) if sa + sr > 0 else (ma + mr) / 2


def oracle() -> str:
    rule = says = ""
    for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
        rule, says = rule + fits + f"'{h}{p}' ", says + fits + f"'{verdict}' "
    joins = "".join(
        f" JOIN (SELECT substr(gram, {a}, {n}) k, sum(acc) acc, sum(rej) rej FROM counts GROUP BY 1) {t}"
        f" ON {t}.k = substr(c.gram, {a}, {n})"
        for t, a, n in (("g3", 2, 3), ("g2", 3, 2), ("g1", 4, 1), ("x3", 1, 3), ("x2", 2, 2), ("x1", 3, 1))
    )

    def log_p(side: str) -> str:
        p = f"((g1.{side} + {PSEUDO}) / (n_{side} + {PSEUDO} * (n_chars + 1)))"
        for count, context in (("g2", "x1"), ("g3", "x2"), ("c", "x3")):
            p = f"(({count}.{side} + {BACKOFF} * {p}) / ({context}.{side} + {BACKOFF}))"
        return f"ln({p}::DOUBLE)"

    held = ", ".join(f"'{x}'" for x in HELD_OUT)
    gram = "substr(concat(chr(2), chr(2), chr(2), lm_text, chr(3)), pos, 4)"
    return f"""
WITH rest AS (SELECT page_id, coalesce(url, '') AS lm_text, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', ['h', 'p']), {{'h': '', 'p': ''}}) r
              FROM pages),
parts AS (SELECT page_id, lm_text, translate(r.h, '{_UPPER}', '{_LOWER}') AS host, r.p AS path FROM rest),
judged AS (SELECT *, CASE {rule}END AS rule, CASE {says}END AS says FROM parts),
texts AS (SELECT lm_text, min(says) AS says, substr(md5(lm_text), 1, 1) IN ({held}) AS held_out
          FROM judged GROUP BY lm_text),
grams AS (SELECT lm_text, says, held_out, {gram} AS gram
          FROM (SELECT *, unnest(range(1, length(lm_text) + 2)) AS pos FROM texts)),
counts AS (SELECT gram, count(*) FILTER (says = 'allow' AND NOT held_out) AS acc,
                  count(*) FILTER (says = 'block' AND NOT held_out) AS rej FROM grams GROUP BY gram),
totals AS (SELECT sum(acc) AS n_acc, sum(rej) AS n_rej, count(DISTINCT substr(gram, 4, 1)) AS n_chars FROM counts),
ratios AS (SELECT c.gram, CASE WHEN n_acc > 0 AND n_rej > 0 THEN {log_p("acc")} - {log_p("rej")} ELSE 0 END AS ratio
           FROM counts c CROSS JOIN totals{joins}),
scored AS (SELECT lm_text, says, avg(ratio) AS score FROM grams JOIN ratios USING (gram)
           WHERE says IS NULL OR held_out GROUP BY lm_text, says),
by_class AS (SELECT says, avg(score) AS m, stddev_pop(score) AS s FROM scored WHERE says IS NOT NULL GROUP BY says),
cut AS (SELECT coalesce((SELECT CASE WHEN a.s + b.s > 0 THEN (a.m * b.s + b.m * a.s) / (a.s + b.s)
                                ELSE (a.m + b.m) / 2 END
                         FROM by_class a, by_class b WHERE a.says = 'allow' AND b.says = 'block'), 0) AS t)
SELECT page_id, host, path, rule,
       coalesce(j.says, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM judged j LEFT JOIN (SELECT lm_text, score FROM scored WHERE says IS NULL) USING (lm_text) CROSS JOIN cut
"""
