"""Reading sources with declared schemas, writing results, and auditing what is there."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.functions.exprs import as_number
from chronopanel.plans.guards import require_columns, require_unique


def scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None, kind: str = "parquet", **options) -> DataFrame:
    """A pruned scan; CSV and JSON need a schema, so that nothing is inferred from a pass over the data."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind in ("csv", "json"):
        raise ValueError(f"{kind} needs a schema")
    out = reader.format(kind).load(path)
    return out.select(*columns) if columns else out


def optional(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """An absent table, or one without a required column, is an empty typed relation; any other failure is one."""
    try:
        found = spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if any(f.name not in found.columns for f in schema):
        return spark.createDataFrame([], schema)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def present_columns(rows: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that are there, and those that aren't; a schema is read, no data."""
    return [c for c in wanted if c in rows.columns], [c for c in wanted if c not in rows.columns]


def first_column(columns: list[str], candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def first_value(rows: DataFrame, candidates: list[str]) -> Column:
    """The first of the candidates' values in each row that is a number."""
    there = [as_number(c) for c in candidates if c in rows.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def head_entities(rows: DataFrame, entity: str, n: int) -> DataFrame:
    """Rows of the first n entities in order of their ids: a limited scan for trials."""
    return rows.join(rows.select(entity).distinct().orderBy(entity).limit(n), entity, "left_semi")


def predictions(rows: DataFrame, keys: list[str], target: str | None = None) -> DataFrame:
    """Keys, outcome and probability as numbers, nulls dropped; duplicate keys are refused."""
    require_columns(rows, [*keys, "y_true", "y_prob"])
    if target is not None and "target_col" in rows.columns:
        rows = rows.where(F.col("target_col") == target)
    out = rows.select(*keys, as_number("y_true").alias("y_true"), as_number("y_prob").alias("y_prob")).dropna()
    return require_unique(out, keys)


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path) of the files below a folder of any store; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path")


def prediction_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(model, validation, test): folders that hold predictions of both parts, the model named by the path below the root."""
    found = files(spark, root, "*_predictions.csv*")
    part = F.regexp_extract("path", r"/(val|test)_predictions\.csv(\.gz)?$", 1)
    model = F.regexp_extract("path", r"([^/]+/[^/]+)/[^/]+$", 1)
    rows = found.select(model.alias("model"), part.alias("part"), "path").where("part <> ''")
    both = rows.groupBy("model").agg(F.max(F.when(F.col("part") == "val", F.col("path"))).alias("validation"), F.max(F.when(F.col("part") == "test", F.col("path"))).alias("test"))
    return both.where("validation IS NOT NULL AND test IS NOT NULL")


def schema_audit(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> list[dict]:
    """Missing tables and columns by table."""
    return [
        {"table": name, "present": name in tables, "missing": [c for c in cols if name not in tables or c not in tables[name].columns]}
        for name, cols in sorted(required.items())
    ]


def schema_fingerprint(tables: dict[str, DataFrame]) -> str:
    """A digest of all tables' columns and types that doesn't depend on their order."""
    said = {name: sorted(df.dtypes) for name, df in tables.items()}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


def term_counts(rows: DataFrame, column: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """How many rows hold, or with ``prefix`` begin with, each term in a text column, lower-cased and trimmed; one pass."""
    t = F.trim(F.lower(F.col(column)))
    one = rows.agg(*[F.count(F.when(t.startswith(x) if prefix else t.contains(x), 1)).alias(f"c{i}") for i, x in enumerate(terms)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("term"), F.col(f"c{i}").alias("n")) for i, x in enumerate(terms)])))


def label_counts(rows: DataFrame, column: str, most: int) -> DataFrame:
    """Labels, lower-cased and trimmed, with their rows among at most ``most`` rows: a bounded look at a source."""
    return rows.limit(most).groupBy(F.lower(F.trim(F.col(column))).alias("label")).agg(F.count("*").alias("n"))


def feature_manifest(rows: DataFrame, entity: str, features: dict[str, str], labels: list[str]) -> DataFrame:
    """One row a feature or label: what was observed, in how many rows and entities; of labels the positives. One pass.

    ``features`` maps a feature to the column that is 0 where it was observed.
    """
    aggs = [F.count("*").alias("n")]
    for f, missing in features.items():
        seen = F.col(missing) == 0
        aggs += [F.sum(seen.cast("long")).alias(f"o_{f}"), F.countDistinct(F.when(seen, F.col(entity))).alias(f"e_{f}")]
    for y in labels:
        aggs += [F.count(y).alias(f"o_{y}"), F.countDistinct(F.when(F.col(y).isNotNull(), F.col(entity))).alias(f"e_{y}"), F.sum(y).cast("long").alias(f"p_{y}")]
    one, none = rows.agg(*aggs), F.lit(None).cast("long")
    parts = [
        F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(f"o_{name}").alias("observed"), (F.col(f"o_{name}") / F.col("n")).alias("share"), F.col(f"e_{name}").alias("entities"),
                 (F.col(f"p_{name}") if kind == "label" else none).alias("positives"))
        for kind, names in (("feature", features), ("label", labels)) for name in names
    ]
    return one.select(F.inline(F.array(*parts)))


def harvested(tables: dict[str, DataFrame], keys: list[str], metrics: list[str], prefixes: tuple[str, ...] = ("test", "val")) -> DataFrame:
    """Metric tables of different shapes as one: each row's metrics are those of the first part that has the first metric,
    whatever columns a table has; what it lacks is null."""
    out = None
    for family, rows in tables.items():
        def value(name, rows=rows):
            return F.col(name).cast("double") if name in rows.columns else F.lit(None).cast("double")

        part = F.lit(prefixes[-1])
        for p in reversed(prefixes[:-1]):
            part = F.when(value(f"{p}_{metrics[0]}").isNotNull(), F.lit(p)).otherwise(part)
        x = rows.withColumn("part", part)
        picked = []
        for m in metrics:
            c = F.lit(None).cast("double")
            for p in prefixes:
                c = F.when(F.col("part") == p, value(f"{p}_{m}")).otherwise(c)
            picked.append(c.alias(m))
        own = [F.col(k) if k in rows.columns else F.lit(None).cast("string").alias(k) for k in keys]
        x = x.select(F.lit(family).alias("family"), *own, "part", *picked)
        out = x if out is None else out.unionByName(x)
    return out


def append(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    rows.write.mode("append").format(kind).save(path)


def write(rows: DataFrame, path: str, kind: str = "parquet", **options) -> None:
    """Parquet, CSV with a header, or JSON lines; CSV and JSON compressed unless said otherwise."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind {kind}")
    defaults = {} if kind == "parquet" else {"compression": "gzip"} | ({"header": "true"} if kind == "csv" else {})
    rows.write.options(**(defaults | options)).format(kind).save(path)


def text_table(rows: DataFrame, most: int = 200, latex: bool = False) -> str:
    """A small result as a Markdown or LaTeX table; more rows than ``most`` are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no table to print")
    cells = [["" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r] for r in found]
    if latex:
        special = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"})
        lines = [" & ".join(c.translate(special) for c in row) + r" \\" for row in [rows.columns, *cells]]
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])
    head = ["| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    return "\n".join([*head, *["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in cells]])


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, newer_than: list[str] | None = None) -> DataFrame:
    """An extract that is built once: read again if it is there, complete and no older than the files it comes from."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def changed(p: str) -> int:
        at = jvm.org.apache.hadoop.fs.Path(p)
        files = at.getFileSystem(conf)
        return files.getFileStatus(at).getModificationTime() if files.exists(at) else -1

    done = changed(f"{path}/_SUCCESS")
    if force or done < 0 or any(changed(source) > done for source in newer_than or []):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
