"""Token ids as binary shards in training order.

All documents' ids lie end to end and are cut into sequences of equal length. A keyed Feistel network over the next
power of four, with cycle-walking back into the range, gives sequence i the slot p(i): a permutation that needs no
table, no sort of random numbers and no state beyond its key. Sequences are dealt by ranges of slots, one task a shard,
and each shard is one file of records of equal stride: slot s is in shard s // per_shard, at (s % per_shard) * stride.
A reader that stopped at a slot goes on from there, and opens no shard before it.

Ids are encoded once into the written token table of the packing operator, whose partition totals give every id its
place in the stream. Pieces of sequences then go to their shards compressed, in one parcel for each task and shard, and
a shard's task lays them down where they belong in one buffer of the shard's size. Shards lie in regions of FAN. With
more than one region pieces are routed twice, first to their region's written parcels, then region by region to its
shards, so that no map task of an exchange to shards has more than FAN targets. 100 TB of text are some 50 TB of ids: 3
million shards of the default size in 1,500 regions, or with ``shard_bytes`` of 256 MB, where executors have room for
it, 200,000 in 100.

A record is ``length`` ids, little-endian, and one more id's bytes of line feeds, as Spark's text writer, by which
shards are committed, ends records. The last sequence is filled with the end id. Defined results: a null or empty text
is the end id alone; repeated rows are written each; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm.common import bare, deleted, dropped, listed, shared_dir
from chronopanel.llm.packing import END_ID, RANKS, VOCABULARY, encoder, token_table, with_offsets

LENGTH, KEY, ROUNDS = 2048, 0x5EED, 6
#: Bytes of a shard, which one task holds, and of ids that a task gathers before it sends them.
SHARD_BYTES, PARCEL_BYTES = 16 << 20, 16 << 20
#: Shards of a region, and bytes of a file of a region's parcels.
FAN, REGION_BYTES = 2048, 256 << 20


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of range(n)."""

    n: int
    key: int = KEY

    @property
    def half(self) -> int:
        return max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2)

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        z = x + np.uint64((self.key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) & np.uint64((1 << self.half) - 1)

    def _walk(self, values, rounds) -> np.ndarray:
        out = np.array(values, dtype=np.uint64)
        todo, bits = np.ones(len(out), dtype=bool), np.uint64(self.half)
        mask = np.uint64((1 << self.half) - 1)
        while todo.any():
            left, right = out[todo] >> bits, out[todo] & mask
            for r in rounds:
                if rounds[0] == 0:
                    left, right = right, left ^ self._round(right, r)
                else:
                    left, right = right ^ self._round(left, r), left
            out[todo] = left << bits | right
            todo &= out >= np.uint64(self.n)
        return out.astype(np.int64)

    def slots(self, sequences) -> np.ndarray:
        return self._walk(sequences, range(ROUNDS))

    def sequences(self, slots) -> np.ndarray:
        return self._walk(slots, range(ROUNDS - 1, -1, -1))


@dataclass(frozen=True)
class Shards:
    """Where shards are and what is needed to read any slot."""

    path: str
    n_sequences: int
    n_tokens: int
    length: int
    width: int
    per_shard: int
    key: int
    fan: int = FAN

    @property
    def stride(self) -> int:
        return (self.length + 1) * self.width

    @property
    def order(self) -> Permutation:
        return Permutation(self.n_sequences, self.key)

    def place(self, slot: int) -> tuple[int, int]:
        """Number of the shard and byte in it at which a slot begins."""
        return slot // self.per_shard, slot % self.per_shard * self.stride


def _parcels(tokens: DataFrame, shards: Shards, per_target: int) -> DataFrame:
    """(target, parcel): pieces of sequences with their byte in the target, a range of slots, compressed together."""
    order, length, width = shards.order, shards.length, shards.width

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        n = 0
        for batch in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            ats, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            spans = []
            for i, (at, raw) in enumerate(zip(ats, bodies, strict=True)):
                end = at + len(raw) // width
                borders = [at, *range((at // length + 1) * length, end, length), end]
                spans += [(i, a, b) for a, b in zip(borders, borders[1:], strict=False) if b > a]
            slots = order.slots([a // length for _, a, _ in spans]).tolist()
            for slot, (i, a, b) in zip(slots, spans, strict=True):
                places, pieces = held.setdefault(slot // per_target, ([], []))
                places.append((slot % per_target * length + a % length) * width)
                pieces.append(bodies[i][(a - ats[i]) * width : (b - ats[i]) * width])
                n += len(pieces[-1])
            if n >= PARCEL_BYTES:
                yield _parcel(held)
                held, n = {}, 0
        if held:
            yield _parcel(held)

    return tokens.select("at", "ids").mapInArrow(split, "target int, parcel binary")


def _opened(parcel: bytes) -> tuple[list[int], list[int], bytes, int]:
    """Places and sizes of a parcel's pieces, and its bytes with where the first piece begins."""
    raw = zstandard.ZstdDecompressor().decompress(parcel)
    n = int.from_bytes(raw[:8], "little")
    places, sizes = np.frombuffer(raw, dtype="<i8", count=2 * n, offset=8).reshape(2, n).tolist()
    return places, sizes, raw, 8 * (2 * n + 1)


def _split_again(parcels: DataFrame, bytes_a_target: int) -> DataFrame:
    """Parcels of a region as parcels of its shards."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        n = 0
        for batch in batches:
            for parcel in batch.column(0):
                places, sizes, raw, at = _opened(parcel.as_py())
                for place, size in zip(places, sizes, strict=True):
                    to, pieces = held.setdefault(place // bytes_a_target, ([], []))
                    to.append(place % bytes_a_target)
                    pieces.append(raw[at : at + size])
                    at += size
                    n += size
                if n >= PARCEL_BYTES:
                    yield _parcel(held)
                    held, n = {}, 0
        if held:
            yield _parcel(held)

    return parcels.select("parcel").mapInArrow(split, "target int, parcel binary")


def _parcel(held: dict[int, tuple[list[int], list[bytes]]]) -> pa.RecordBatch:
    pack, parcels = zstandard.ZstdCompressor(level=5), []
    for places, pieces in held.values():
        head = np.array([len(places), *places, *map(len, pieces)], dtype="<i8").tobytes()
        parcels.append(pack.compress(head + b"".join(pieces)))
    return pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.int32()), pa.array(parcels, type=pa.binary())], names=["target", "parcel"])


def write_shards(docs: DataFrame, path: str | None = None, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES,
                 vocabulary: str = VOCABULARY, ranks: str | None = RANKS, end_id: int = END_ID, fan: int = FAN) -> Shards:
    """Write all documents' sequences by slot, ``path``/region-R/part-N being shard R * ``fan`` + N.

    A path that holds anything is refused, so that no two runs mix: after a failed run name another, or delete it first.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    keyed = bare(docs, "text").select(F.lit(0).cast("long").alias("key"), "text")
    tokens = token_table(keyed, "key", vocabulary, ranks, end_id, level=5)
    n_tokens = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    width = encoder(vocabulary, ranks).width
    n_sequences = -(-n_tokens // length)
    per_shard = max(1, shard_bytes // ((length + 1) * width))
    shards = Shards(path, n_sequences, n_tokens, length, width, per_shard, key, fan)
    n_shards = max(1, -(-n_sequences // per_shard))
    # Slots are dense, so shards are equal ranges of them: no sampling pass is needed to find their borders.
    if n_shards <= fan:
        _lay(_parcels(with_offsets(tokens), shards, per_shard), shards, 0, n_shards, end_id)
    else:
        n_regions = -(-n_shards // fan)
        files = max(1, fan * per_shard * length * width // REGION_BYTES)
        routed = _parcels(with_offsets(tokens), shards, per_shard * fan).withColumn("salt", F.pmod(F.xxhash64("parcel"), F.lit(files)))
        routed = routed.repartition(n_regions * files, "target", "salt").select("target", "parcel")
        by_region = f"{shared_dir(docs.sparkSession)}/parcels-{uuid.uuid4().hex}"
        routed.write.partitionBy("target").parquet(by_region)
        for region in range(n_regions):
            parcels = docs.sparkSession.read.parquet(f"{by_region}/target={region}")
            n = min(fan, n_shards - region * fan)
            _lay(_split_again(parcels, per_shard * length * width), shards, region, n, end_id)
        deleted(docs.sparkSession, by_region)
    dropped(tokens)
    return shards


def _lay(parcels: DataFrame, shards: Shards, region: int, n_shards: int, end_id: int) -> None:
    """Write the shards of a region from its parcels."""
    length, width, per_shard, record = shards.length, shards.width, shards.per_shard, shards.length * shards.width
    first, n_sequences = region * shards.fan, shards.n_sequences

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, shard = None, None
        for batch in batches:
            for number, parcel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if buffer is None:
                    shard, n = number, min(per_shard, n_sequences - (first + number) * per_shard)
                    buffer = np.full(n * length, end_id, dtype=f"<u{width}").view(np.uint8)
                if number != shard:
                    raise RuntimeError(f"shards {shard} and {number} met in one task")
                places, sizes, raw, at = _opened(parcel)
                body = np.frombuffer(raw, dtype=np.uint8)
                for place, size in zip(places, sizes, strict=True):
                    buffer[place : place + size] = body[at : at + size]
                    at += size
        for a in range(0, 0 if buffer is None else len(buffer), 256 * record):
            part = buffer[a : a + 256 * record].tobytes()
            yield pa.RecordBatch.from_pydict({"record": pa.array([part[i : i + record] for i in range(0, len(part), record)], type=pa.binary())})

    records = parcels.repartitionById(n_shards, F.col("target")).mapInArrow(lay, "record binary")
    out = f"{shards.path}/region-{region:05d}"
    records.select(F.col("record").cast("string")).write.option("lineSep", "\n" * width).text(out)


def _from(spark: SparkSession, shards: Shards, shard: int) -> list[str]:
    """Paths of the shards from one on: its region's files, and the later regions as folders."""
    region, part = divmod(shard, shards.fan)
    n_regions = max(1, -(-shards.n_sequences // (shards.per_shard * shards.fan)))
    files = [f for f in listed(spark, f"{shards.path}/region-{region:05d}") if re.search(r"/part-\d+[^/]*$", f)] if region < n_regions else []
    later = [f"{shards.path}/region-{r:05d}" for r in range(region + 1, n_regions)]
    return [f for f in files if int(re.search(r"/part-(\d+)[^/]*$", f)[1]) >= part] + later


def read_shards(spark: SparkSession, shards: Shards, from_slot: int = 0, digest: bool = False) -> DataFrame:
    """(slot, sequence_id, shard, byte_at, ids) from a slot on; shards before it aren't opened. With ``digest``, instead of
    ``ids`` their number and the checksum of them as unsigned 32-bit little-endian integers."""
    order, per_shard, stride, width = shards.order, shards.per_shard, shards.stride, shards.width

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                n = len(raw) // stride
                for a in range(max(0, from_slot - shard * per_shard), n, 256):
                    at = np.arange(a, min(a + 256, n))
                    slots = shard * per_shard + at
                    ids = [raw[i * stride : (i + 1) * stride - width] for i in at.tolist()]
                    columns = [pa.array(slots), pa.array(order.sequences(slots)), pa.array(np.full(len(at), shard, dtype=np.int64)), pa.array(at * stride)]
                    if digest:
                        sums = [zlib.crc32(np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes()) for x in ids]
                        columns += [pa.array([len(x) // width for x in ids], type=pa.int64()), pa.array(sums, type=pa.int64())]
                    else:
                        columns.append(pa.array([bytes(x) for x in ids], type=pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "slot long, sequence_id long, shard long, byte_at long, " + ("n_ids long, ids_crc32 long" if digest else "ids binary")
    names = [f.split()[0] for f in schema.split(", ")]
    paths = _from(spark, shards, from_slot // per_shard)
    if not paths:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths)
    place = [F.regexp_extract("path", "region-(\\d+)/part-(\\d+)", i).cast("long") for i in (1, 2)]
    return files.select((place[0] * shards.fan + place[1]).alias("shard"), "content").mapInArrow(records, schema)
