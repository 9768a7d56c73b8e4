"""The corpus pipeline: raw documents to packed sequences.

Each stage calls one operator on all that the stage before kept; its result is written as Parquet and read again as the
next stage's documents. Stages but the last return the columns of ``documents``, whatever their names and number.

Defined results: the language stage drops null and empty texts, as no language tells them; the rules stage drops texts of
fewer than 50 words; near-dedup keeps one row of each group whether doc_ids are unique, repeated, clashing or null, and
texts without words each by themselves; decontamination keeps null and empty texts; packing takes null for empty. Texts
of any length are read whole. A null doc_id is a document like others (only its ties by id come last). An empty table
gives empty tables and no pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm import decontam, langid, minhash, packing, rules
from chronopanel.llm.common import dropped, sized, written

#: Least probability of the predicted language, and words in a shingle of the near-dedup stage.
LEAST_SCORE = 0.5
SHINGLE = 5


def named(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and all others packed into one, so that no name of theirs meets its results."""
    rest = [c for c in docs.columns if c not in needed]
    return docs.select(*named([*needed]), *([F.struct(*named(rest)).alias("__rest")] if rest else []))


def unpacked(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The documents' columns again, as they were."""
    return rows.select(*[F.col(f"`{c}`" if c in needed else f"__rest.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and tells with more than even odds."""
    said = langid.identify(carried(docs, "doc_id", "text", "lang"))
    return unpacked(said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs, "doc_id", "text", "lang")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that do."""
    return unpacked(rules.apply_rules(carried(docs, "doc_id", "text", "source")).where("kept"), docs, "doc_id", "text", "source")


def row_key(docs: DataFrame) -> Column:
    """doc_id and text as one string that sorts by doc_id, null last; rows equal in both have equal keys."""
    key = F.col("doc_id").cast("string")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        key = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.expr("shiftleft(1L, 63)"))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), key), F.lit("1")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id; of rows equal in doc_id and text, one."""
    rows = docs.withColumn("__row", row_key(docs))
    found = minhash.near_duplicates(rows, key="__row", size=SHINGLE)
    marks = found.groupBy("__row").agg(F.bool_and("kept").alias("__kept"), F.count("*").alias("__n")).where("NOT __kept OR __n > 1")
    marks = written(marks.select("__row", "__kept"), "near-copies")
    once = rows.join(sized(marks), "__row", "left_anti").select(*named(docs.columns))
    repeated = marks.where("__kept").select("__row")
    if repeated.isEmpty():
        return once
    again = rows.join(sized(repeated, marks), "__row", "left_semi").groupBy("__row").agg(F.min(F.struct(*named(docs.columns))).alias("__r"))
    return once.unionByName(again.select("__r.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return unpacked(decontam.clean(carried(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of equal length, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The first stage's model isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
