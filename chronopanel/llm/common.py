"""Helpers that the operators of this subpackage share: written tables, size-checked joins, stable identities."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that parts words: the space and the controls tab to carriage return.
WHITE = "[\\x20\\x09-\\x0D]+"
#: A side of a join is broadcast only below this many bytes, measured as its table is written.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own if all runs in one process; a cluster has no such folder, so it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="chronopanel-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in a row of a join's build side, at least."""
    if isinstance(kind, T.StringType):
        own = F.octet_length(value) + 16
    elif isinstance(kind, T.BinaryType):
        own = F.length(value) + 16
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        own = F.size(value) * 9 + 32
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        own = F.octet_length(F.to_json(F.struct(value.alias("v")))) * 4 + 32
    else:
        return F.lit(8)
    return F.coalesce(own, F.lit(8))


def row_bytes(df: DataFrame) -> Column:
    each = [_bytes(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields]
    return reduce(lambda a, b: a + b, each, F.lit(16).cast("long"))


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    Its size in bytes is summed while it is written; see ``sized``. ``dropped`` deletes it.
    """
    spark = df.sparkSession
    path, seen = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", Observation()
    measured = df.observe(seen, F.sum(row_bytes(df)).alias("bytes"))
    measured.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path, seen.get.get("bytes") or 0
    return out


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def deleted(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files in a folder of any store that Spark reads."""
    files, at = _folder(spark, path)
    return sorted(f.getPath().toString() for f in files.listStatus(at)) if files.exists(at) else []


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        deleted(table.sparkSession, table._written[0])


def sized(side: DataFrame, of: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a side for broadcast if the written table that it is, or is part of (``of``), is below ``limit`` bytes; else
    leave the join to Catalyst."""
    return F.broadcast(side) if (side if of is None else of)._written[1] <= limit else side


def words(text: str | Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), WHITE), "")


def bare(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the input has."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
