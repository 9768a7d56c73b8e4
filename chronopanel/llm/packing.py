"""Concatenate-and-cut packing: token ids of all documents laid end to end, cut into windows of fixed length.

Pass one encodes each partition once and writes ids with their place in the partition's stream. The partitions' token
totals, one small row each, give every partition its global offset by a prefix sum. Pass two adds that offset and cuts
each document's ids at the window borders; a document that crosses a border yields a record on either side.

Defined results: a null or empty text is the end id alone; repeated rows are packed each by themselves; an empty table
gives no pieces; columns besides the key and the text are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm.common import written

WINDOW = 2048
END_ID = 1
#: The same vocabulary in two files: by its ranks ordinary text is encoded fast, by the other all else.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts are handed on in groups of about so many characters, so that a worker holds little at once.
GROUP_CHARS = 4 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class Encoder:
    """Ids of the vocabulary file; texts that hold a special token's string, or break the fast way, take the slow way."""

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.slow = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.width = 2 if self.slow.get_vocab_size() <= 1 << 16 else 4
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(vocabulary_path(ranks), "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # long runs of white space exhaust its pattern's stack
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    return Encoder(vocabulary, ranks)


def groups(batches: Iterator[pa.RecordBatch], limit: int = GROUP_CHARS) -> Iterator[list[tuple]]:
    """Rows of the batches in order, in groups of about ``limit`` characters of their last column."""
    rows, n = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            rows.append(row)
            n += len(row[-1] or "") + 64
            if n >= limit:
                yield rows
                rows, n = [], 0
    if rows:
        yield rows


def token_table(docs: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY, ranks: str | None = RANKS,
                end_id: int | None = END_ID, level: int = 3) -> DataFrame:
    """Written once: key, n_tokens, part, local (tokens before it in its partition) and ids as little-endian bytes.

    Ids take two bytes each where the vocabulary allows, else four (column ``width``).
    """
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("part", T.LongType()), T.StructField("local", T.LongType()),
         T.StructField("n_tokens", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    )
    end = [] if end_id is None else [end_id]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one, part, local = encoder(vocabulary, ranks), TaskContext.get().partitionId(), 0
        tail = np.array(end, dtype=f"<u{encode_one.width}").tobytes()
        for rows in groups(batches):
            ids = [encode_one(text).astype(f"<u{encode_one.width}").tobytes() + tail if text else tail for _, text in rows]
            counts = np.array([len(x) // encode_one.width for x in ids], dtype=np.int64)
            before = local + np.cumsum(counts) - counts
            local += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], type=batches_type), pa.array(np.full(len(rows), part, dtype=np.int64)),
                 pa.array(before), pa.array(counts), pa.array(np.full(len(rows), encode_one.width, dtype=np.int32)),
                 pa.array(ids, type=pa.binary())],
                names=[f.name for f in schema],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batches_type = to_arrow_type(kind)
    return written(docs.select(key, "text").mapInArrow(encode, schema), "tokens", level)


def with_offsets(tokens: DataFrame) -> DataFrame:
    """Add ``at``, the tokens before each document in the whole stream. One row a partition is summed, no document is."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    sums = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    bases = tokens.sparkSession.createDataFrame(
        [(r["part"], int(b)) for r, b in zip(totals, sums, strict=False)], "part long, base long"
    )
    return tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("local"))


def cut(tokens: DataFrame, key: str = "doc_id", window: int = WINDOW, payload: bool = True) -> DataFrame:
    """Pieces of documents with their place in the windows: one row for each window that a document touches.

    ``ids`` holds the piece's ids as in the token table (null without ``payload``), ``ids_crc32`` their checksum as
    unsigned 32-bit little-endian integers.
    """
    kind = tokens.schema[key].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.LongType()) for n in names], T.StructField("ids", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(kind)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, held = [], [], []
            for i in range(batch.num_rows):
                k, at, width, raw = (batch.column(c)[i].as_py() for c in range(4))
                ids = np.frombuffer(raw, dtype=f"<u{width}")
                borders = [0, *range(window - at % window, len(ids), window), len(ids)]
                wide = memoryview(ids.astype("<u4")).cast("B")
                for a, b in zip(borders, borders[1:], strict=False):
                    keys.append(k)
                    out.append((a, b - a, zlib.crc32(wide[4 * a : 4 * b]), len(ids), (at + a) // window, (at + a) % window))
                    held.append(raw[a * width : b * width] if payload else None)
                if len(keys) >= 4096:
                    yield _batch(keys, key_type, out, held, schema)
                    keys, out, held = [], [], []
            if keys:
                yield _batch(keys, key_type, out, held, schema)

    return with_offsets(tokens).select(key, "at", "width", "ids").mapInArrow(pieces, schema)


def _batch(keys, key_type, numbers, held, schema) -> pa.RecordBatch:
    columns = np.array(numbers, dtype=np.int64).T
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, type=key_type), *[pa.array(c) for c in columns], pa.array(held, type=pa.binary())],
        names=[f.name for f in schema],
    )


def pack(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, vocabulary: str = VOCABULARY,
         ranks: str | None = RANKS, end_id: int | None = END_ID, payload: bool = True) -> DataFrame:
    """Pack every document; see ``token_table`` and ``cut``."""
    return cut(token_table(docs, key, vocabulary, ranks, end_id), key, window, payload)
