"""Prefix trie of conversations by Patricia construction over sorted sequences of turns.

A turn is its digest (MD5 of role and text) and its number of words; texts are read once and shuffled nowhere. A rebuilt
conversation is one row: the digests joined to a binary key whose byte order is the order of sequences, 16 bytes a turn.

1. Conversations are sorted by key and id over all partitions; runs of one key become rows of at most RUN ids, so copies
   of a conversation weigh no more than their ids. Sorted by key alone, the runs give the distinct sequences, each with
   its members' number, least id and the SHA-256 of their ids, which is fed run by run.
2. A slice is one partition of that order. Within it a stack makes branch, end and leaf points alone, from the common
   prefixes of neighbours; edges between points stay compressed, as the words of the turns that they skip.
3. Points that a slice shares with its neighbours (the prefix common to both sides of a border, one boundary key a slice)
   are kept explicit at every depth. All aggregates of a subtree are sums or minima over slices, so shared points are
   merged by one aggregation, and all others are whole already.
4. Unary nodes are expanded from the edges: members are those of the point below, saved tokens its sum and the edge's
   suffix sums.

Defined results: rows are ordered by turn, null first, and equal turns by digest; a null role or text is empty; rows
without a conversation id belong to no conversation and are left out; repeated rows are turns of their own; without
conversations there are no nodes, not even the root; other columns are ignored. A conversation's digests (not its texts)
are one row: some 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronopanel.llm.common import dropped, sized, words, written

#: Conversations of one group share the first turns of the group's first, at most SHARED - 1.
GROUP, SHARED = 20, 4
#: Bytes of a digest, ids in a run, and bytes of written sequences in a slice.
WIDTH, RUN, SLICE_BYTES = 16, 4096, 8 << 20


def digests(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and its turns in order, as (d, w): digest and number of words."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where(F.col("`conv_id`").isNotNull()).select(
        F.col("`conv_id`").alias("conv_id"), F.struct(F.col("`turn`").alias("turn"), digest.alias("d"), F.size(words(text)).alias("w")).alias("t")
    )
    ordered = F.sort_array(F.collect_list("t"))  # null turns come first
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def regrouped(convs: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of their group's first conversation, as their ids' checksums say."""
    own = convs.withColumns({
        "h": F.crc32(F.col("conv_id").cast("string")) % SHARED,
        "first": F.col("conv_id") - F.col("conv_id") % GROUP,
    })
    heads = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, SHARED - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    begin = F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int"))
    rest = F.slice("turns", F.col("h").cast("int") + 1, F.size("turns"))
    return own.join(heads, "first", "left").select("conv_id", F.concat(begin, rest).alias("turns"))


def keyed(convs: DataFrame) -> DataFrame:
    """(key, conv_id, words): the turns' digests as one binary key, and their words."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""))
    return convs.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t["w"]).alias("words"))


def _runs(kind: T.DataType, run: int):
    """Sorted (key, conv_id, words) to (key, low, n, words, ids): at most ``run`` ids of one key, joined."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # key, words, ids

        def row():
            key, ws, ids = held
            return key, ids[0], len(ids), ws, ",".join(map(str, ids)).encode()

        for batch in batches:
            out = []
            for key, conv, ws in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and held[0] == key and len(held[2]) < run:
                    held[2].append(conv)
                else:
                    out += [row()] if held else []
                    held = [key, ws, [conv]]
            yield _batch(out, kind)
        if held:
            yield _batch([row()], kind)

    return build


def _batch(rows: list[tuple], kind: T.DataType) -> pa.RecordBatch:
    key, low, n, ws, ids = zip(*rows, strict=True) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(key, type=pa.binary()), pa.array(low, type=to_arrow_type(kind)), pa.array(n, type=pa.int64()),
         pa.array(ws, type=pa.list_(pa.int32())), pa.array(ids, type=pa.binary())],
        names=["key", "low", "n", "words", "ids"],
    )


def _sequences(kind: T.DataType):
    """Sorted runs to distinct sequences (slice, key, low, n, words, ends): ids are hashed as they stream by."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], TaskContext.get().partitionId()

        def out(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.binary(), to_arrow_type(kind), pa.int64(), pa.list_(pa.int32()), pa.string()]
            arrays = [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), type=pa.int32()), *arrays], names=["slice", "key", "low", "n", "words", "ends"])

        def row():
            key, low, n, ws, sha = held
            return key, low, n, ws, sha.hexdigest()

        for batch in batches:
            rows = []
            for key, low, n, ws, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[0] == key:
                    held[2] += n
                    held[4].update(b"," + ids)
                else:
                    rows += [row()] if held else []
                    held = [key, low, n, ws, hashlib.sha256(ids)]
            yield out(rows)
        if held:
            yield out([row()])

    return build


def sequences(convs: DataFrame, run: int = RUN, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Distinct sequences, written, in slices of their order: slice, key, low (least id), n, words and ends."""
    kind = convs.schema["conv_id"].dataType
    array = T.ArrayType(T.IntegerType())
    run_type = T.StructType().add("key", T.BinaryType()).add("low", kind).add("n", T.LongType()).add("words", array).add("ids", T.BinaryType())
    seq_type = T.StructType().add("slice", T.IntegerType()).add("key", T.BinaryType()).add("low", kind).add("n", T.LongType()).add("words", array).add("ends", T.StringType())
    rows = written(keyed(regrouped(convs)), "conversation-keys")
    n = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows._written[1] // slice_bytes + 1)
    runs = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_runs(kind, run), run_type)
    runs = written(runs, "conversation-runs")
    out = runs.repartitionByRange(n, "key").sortWithinPartitions("key", "low").mapInArrow(_sequences(kind), seq_type)
    out = written(out, "sequences")
    dropped(rows, runs)
    return out


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common from the start."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n  # the first ``low`` turns are equal, the first ``high`` are not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid)
    return low


def borders(seqs: DataFrame) -> list[tuple[int, int, int]]:
    """(slice, turns shared with the sequence before its first, with the one after its last); -1 where there is none.

    One pair of boundary keys a slice streams by; only the numbers stay.
    """
    ends = seqs.groupBy("slice").agg(F.min("key").alias("a"), F.max("key").alias("z")).orderBy("slice")
    out, last = [], None
    for r in ends.toLocalIterator():
        shared = -1 if last is None else common_turns(last, bytes(r["a"]))
        if out:
            out[-1] = (*out[-1][:2], shared)
        out.append((r["slice"], shared, -1))
        last = bytes(r["z"])
    return out


class Slice:
    """Patricia points of one slice of the sorted sequences.

    ``left`` and ``right`` are the turns shared with the sequences beyond either border (-1: none); prefixes up to them
    are points at every depth, marked open. A point's sums are over this slice alone: members, leaves, least id,
    children whose first node begins here, and saved tokens of its subtree, a node's own as members times words, less
    words once, where it begins.
    """

    def __init__(self, keys: list[bytes], lows: list, ns: list[int], words: list, left: int, right: int):
        self.keys, self.words = keys, words
        self.depth, self.seq, self.parent, self.open, self.n, self.low = [], [], [], [], [], []
        self.children, self.leaves, self.saved, self.end, self.new = [], [], [], [], []
        stack: list[int] = []
        for d in range(left + 1):
            stack.append(self._point(d, 0, True, False))
        if left < 0:
            stack.append(self._point(0, 0, right >= 0, True))
        for i, key in enumerate(keys):
            size = len(key) // WIDTH
            if i:
                shared = common_turns(keys[i - 1], key)
                self._close(stack, shared)
            if size > self.depth[stack[-1]]:
                stack.append(self._point(size, i, False, True))
            top = stack[-1]
            self.end[top] = i
            self.n[top] += ns[i]
            self.low[top] = lows[i] if self.low[top] is None else min(self.low[top], lows[i])
            after = common_turns(key, keys[i + 1]) if i + 1 < len(keys) else right
            self.leaves[top] += after < size
        # Prefixes shared with the next slice are points at every depth.
        path = {self.depth[p]: p for p in stack}
        for d in range(right + 1):
            if d in path:
                self.open[path[d]] = True
            else:
                path[d] = self._point(d, len(keys) - 1, True, True)
        self._close([path[d] for d in sorted(path)], -1)

    def _point(self, depth: int, seq: int, is_open: bool, new: bool) -> int:
        self.depth.append(depth)
        self.seq.append(seq)
        self.open.append(is_open)
        self.new.append(new)  # the node begins here, not in a slice before
        for column, value in ((self.parent, -1), (self.n, 0), (self.low, None), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.end, -1)):
            column.append(value)
        return len(self.depth) - 1

    def _close(self, stack: list[int], depth: int) -> None:
        """Finish the points deeper than ``depth``, and leave a point at that depth on the stack."""
        while stack and self.depth[stack[-1]] > depth:
            p = stack.pop()
            if depth >= 0 and self.depth[stack[-1]] < depth:
                stack.append(self._point(depth, self.seq[p], False, True))
            d, w = self.depth[p], self.words[self.seq[p]]
            self.saved[p] += (self.n[p] - self.new[p]) * (w[d - 1] if d else 0)
            if not stack:
                return
            q = self.parent[p] = stack[-1]
            self.n[q] += self.n[p]
            self.leaves[q] += self.leaves[p]
            self.low[q] = self.low[p] if self.low[q] is None else min(self.low[q], self.low[p])
            self.children[q] += self.new[p]
            self.saved[q] += self.saved[p] + (self.n[p] - 1) * sum(w[self.depth[q] : d - 1])

    def prefix(self, p: int) -> bytes:
        """Digest of the sequence of turns that a point is."""
        return hashlib.md5(self.keys[self.seq[p]][: self.depth[p] * WIDTH]).digest()


def _points(kind: T.DataType, sides: dict, schema: T.StructType):
    def build(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        order = sorted(range(len(cols["key"])), key=lambda i: cols["key"][i])
        keys, lows, ns, ws, ends = ([cols[c][i] for i in order] for c in ("key", "low", "n", "words", "ends"))
        number = cols["slice"][0]
        s = Slice(keys, lows, ns, ws, *sides[number])
        rows = []
        for p, q in enumerate(s.parent):
            shared = q >= 0 and s.open[q]
            edge = ws[s.seq[p]][s.depth[q] if q >= 0 else 0 : s.depth[p]]
            rows.append((number, s.depth[p], s.open[p], s.prefix(p) if s.open[p] else None, s.prefix(q) if shared else None,
                         None if q < 0 or shared else s.low[q], s.low[p], s.n[p], s.children[p], s.leaves[p], s.saved[p],
                         ends[s.end[p]] if s.end[p] >= 0 else None, edge))
        columns = zip(*rows, strict=True)
        return pa.Table.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names)

    return build


def points(seqs: DataFrame) -> DataFrame:
    """The compressed tree, written: a row a point, open ones a row a slice that has them."""
    kind, sides = seqs.schema["low"].dataType, {s: (a, b) for s, a, b in borders(seqs)}
    schema = T.StructType()
    for name, t in (("slice", T.IntegerType()), ("depth", T.LongType()), ("open", T.BooleanType()), ("prefix", T.BinaryType()),
                    ("parent_prefix", T.BinaryType()), ("parent_low", kind), ("low", kind), ("n", T.LongType()), ("children", T.LongType()),
                    ("leaves", T.LongType()), ("saved", T.LongType()), ("ends", T.StringType()), ("edge", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, t)
    return written(seqs.groupBy("slice").applyInArrow(_points(kind, sides, schema), schema), "points")


def nodes(conversations: DataFrame, run: int = RUN, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = written(digests(conversations), "conversations")
    seqs = sequences(convs, run, slice_bytes)
    tree = points(seqs)
    dropped(convs, seqs)
    shared = tree.where("open")
    merged = written(
        shared.groupBy("prefix").agg(
            F.first("depth").alias("depth"), F.first("parent_prefix").alias("parent_prefix"), F.min("low").alias("low"), F.sum("n").alias("n"),
            F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"),
            F.first("edge").alias("edge"),
        ),
        "open-points",
    )
    # Each slice gets the merged values of its own open points, so that a busy parent's children meet it slice by slice.
    up = merged.select(F.col("prefix").alias("parent_prefix"), F.col("low").alias("up"))
    by_slice = written(shared.select("slice", F.col("prefix").alias("parent_prefix")).join(sized(up, merged), "parent_prefix"), "open-parents")
    names = ["depth", "low", "n", "children", "leaves", "saved", "ends", "edge"]
    closed = tree.where("NOT open")
    whole = closed.join(sized(by_slice), ["slice", "parent_prefix"], "left").select(F.coalesce("up", "parent_low").alias("parent"), *names)
    seams = merged.join(sized(up, merged), "parent_prefix", "left").select(F.col("up").alias("parent"), *names)
    return expanded(whole.unionByName(seams))


def expanded(tree: DataFrame) -> DataFrame:
    """All nodes from points: those that an edge skips have the point's members, one child and no ends."""
    size = F.size("edge")
    at = F.posexplode(F.when(size == 0, F.array(F.lit(0))).otherwise(F.col("edge"))).alias("at", "w")
    rows = tree.select("*", at)
    last = F.col("at") >= size - 1
    above = F.aggregate(F.slice("edge", F.col("at") + 1, F.greatest(size - 1 - F.col("at"), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    ends = F.when(last, F.col("ends"))
    return rows.select(
        F.col("low").alias("conv_id"), (F.col("depth") - F.greatest(size - 1 - F.col("at"), F.lit(0))).alias("depth"),
        F.when(F.col("at") == 0, F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.when(last, F.lit(0)).otherwise((F.col("n") - 1) * above)).cast("long").alias("saved_tokens"),
        F.coalesce(ends, F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def oracle() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    n_words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    return f"""
WITH turns AS (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, {n_words} AS w
               FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'d': d, 'w': w}} ORDER BY turn NULLS FIRST, d) AS s FROM turns GROUP BY c),
drawn AS (SELECT c, s, {crc} % {SHARED} AS h FROM own),
built AS (SELECT a.c, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s FROM drawn a LEFT JOIN own b ON b.c = a.c - a.c % {GROUP}),
paths AS (SELECT c, unnest(range(0, len(s) + 1)) AS depth, s FROM built),
prefixes AS (SELECT c, depth, len(s) AS size, array_to_string(list_transform(s[1:depth], lambda x: x.d), '') AS k,
                    array_to_string(list_transform(s[1:depth - 1], lambda x: x.d), '') AS up, CASE WHEN depth > 0 THEN s[depth].w ELSE 0 END AS w
             FROM paths),
tree AS (SELECT k, any_value(CASE WHEN depth > 0 THEN up END) AS up, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
                coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = size), '') AS ends
         FROM prefixes GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM tree WHERE up IS NOT NULL GROUP BY up),
counted AS (SELECT t.*, coalesce(kids.n, 0) AS n_children FROM tree t LEFT JOIN kids USING (k)),
below AS (SELECT substr(k, 1, lvl * 32) AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
          FROM (SELECT *, unnest(range(0, depth + 1)) AS lvl FROM counted) GROUP BY 1)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM counted t JOIN below USING (k) LEFT JOIN tree p ON p.k = t.up
"""
