"""Near-duplicate components by SetSketch registers, exact on every candidate.

A document's distinct shingles of consecutive words are hashed; equal sets form one class. A class's sketch holds, for
each of many hash functions, the least exponential variate over its shingles on a logarithmic scale (SetSketch: Ertl,
2021): mergeable by maximum, equal with a probability that grows with the Jaccard similarity. Bands of registers make
buckets. In each bucket the class that meets most others is the hub and all others meet it in a star, so no pairs
within a bucket are formed. A star's far pairs are left out by the joint likelihood of both sketches, the rest are
compared on full sets. A class that isn't linked with a hub may still be linked with another class of the star: then
both differ from the hub in shared shingles, and a prefix join on those differences finds every such pair, again by
stars where many meet.

Defined results: texts without words have no shingles and are linked with nothing; a null key is a document of its own
class and never the component's id unless no member has one (then the id is null and the row is kept); repeated rows
get equal results; columns besides key and text are ignored; a text of any length is one set, 8 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronopanel.llm.common import bare, dropped, sized, written
from chronopanel.llm.components import components
from chronopanel.llm.packing import groups

#: Similarity of a link as a fraction, registers as bands times rows, base and rate of the registers' scale.
LINK = (4, 5)
BANDS, ROWS = 40, 6
BASE, RATE = 1.01, 20.0
REGISTERS = BANDS * ROWS
#: Buckets of differences with more members meet one of them in a star before any pairs.
FEW = 8
#: Pairs whose likeliest similarity is below this by the sketches alone are far: at 0.8, seven deviations away.
FAR = 0.6
_M64 = (1 << 64) - 1
_rng = np.random.default_rng(20210101)
_MUL = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
_BYTE = _rng.integers(0, _M64, 256, dtype=np.uint64)
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased, in order."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)
    inside = np.r_[False, ~((raw == 32) | ((raw >= 9) & (raw <= 13))), False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    keep = inside[1:-1]
    place = np.arange(len(raw))[keep] - np.repeat(start, end - start)
    value = _BYTE[raw[keep]] * _POWER[place % 4096] + (place // 4096).astype(np.uint64)
    lengths = end - start
    sums = np.add.reduceat(_mix(value), np.cumsum(lengths) - lengths)
    return _mix(sums + lengths.astype(np.uint64))


def shingle_set(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; with fewer words, one for the whole sequence."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = max(len(w) - size + 1, 1)
    out = np.full(n, min(len(w), size), dtype=np.uint64)
    for k in range(min(size, len(w))):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + w[k : k + n])
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers: the least variate of each function on a logarithmic scale, as 16-bit integers."""
    low, least = shingles.astype(np.uint32), np.full((REGISTERS, 1), 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 512):
        h = low[None, a : a + 512] * _MUL
        h += _ADD
        least = np.minimum(least, h.min(axis=1, keepdims=True))
    variate = -np.log1p(-(least[:, 0] + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)) + 1000, 0, 65535).astype("<u2")


def likeliest(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Similarity of greatest joint likelihood, from how many registers are larger, smaller and equal (pairs as rows)."""
    u, v = (nx / (nx + ny))[:, None], (ny / (nx + ny))[:, None]
    grid = np.minimum(u / v, v / u) * np.linspace(0.005, 1, 200)[None, :]

    def p(z):
        return -np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = (x > y).sum(1)[:, None], (x < y).sum(1)[:, None]
    pm, pl = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    like = more * np.log(pm + tiny) + less * np.log(pl + tiny)
    like += (x.shape[1] - more - less) * np.log(np.maximum(1 - pm - pl, 0) + tiny)
    return np.take_along_axis(grid, like.argmax(1)[:, None], 1)[:, 0]


def _sets(docs: DataFrame, key: str, size: int, sketches: bool) -> DataFrame:
    """Per row: key, class (hash of the whole set), number of shingles, and the sketch or the set itself."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)
    last = T.StructField("sketch", T.BinaryType()) if sketches else T.StructField("shingles", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField(key, kind), T.StructField("cls", T.BinaryType()), T.StructField("n", T.LongType()), last])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1 << 21):
            found = [shingle_set(t, size) for _, t in group]
            cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            if sketches:
                body = pa.array([registers(s).tobytes() if len(s) else None for s in found], type=pa.binary())
            else:
                flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                body = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in group], type=key_type), pa.array(cls, type=pa.binary()),
                 pa.array([len(s) for s in found], type=pa.int64()), body],
                names=[f.name for f in schema],
            )

    return docs.select(key, "text").mapInArrow(rows, schema)


def _estimated(pairs: DataFrame) -> Column:
    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        out = []
        for a in range(0, len(x), 2048):
            s = slice(a, a + 2048)
            xs, ys = (np.frombuffer(b"".join(c[s]), dtype="<u2").reshape(-1, REGISTERS) for c in (x, y))
            out.append(likeliest(xs, ys, nx[s].to_numpy(float), ny[s].to_numpy(float)))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    return estimate("sketch_a", "sketch_b", "na", "nb")


def stars(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, hub b) of classes that meet in a bucket whose hub is b, written."""
    key = F.xxhash64(F.col("band"), F.substring(F.col("sketch"), F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    bands = classes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).select(key.alias("bucket"), "cls")
    shared = written(bands.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    members = written(bands.join(sized(shared), "bucket"), "members")
    # A class's degree: how many classes it meets, over all its buckets.
    degree = written(members.groupBy("cls").agg(F.sum("c").alias("degree")), "degrees")
    ranked = members.select("bucket", "cls").join(sized(degree), "cls").groupBy("bucket")
    hubs = written(ranked.agg(F.max(F.struct("degree", "cls"))["cls"].alias("b")), "hubs")
    pairs = members.select("bucket", F.col("cls").alias("a")).join(sized(hubs), "bucket").where("a <> b")
    out = written(pairs.select("a", "b").distinct(), "stars")
    dropped(shared, members, degree, hubs)
    return out


def _linked(inter: Column, na: Column, nb: Column) -> Column:
    num, den = LINK
    return F.lit(den) * inter >= F.lit(num) * (na + nb - inter)


def links(docs: DataFrame, classes: DataFrame, key: str, size: int) -> DataFrame:
    """Links (a, b) between classes, written: enough of them that components are those of all candidate links."""
    pairs = stars(classes)
    info = classes.select("cls", "n", "sketch")
    both = pairs.join(info.toDF("a", "na", "sketch_a"), "a").join(info.toDF("b", "nb", "sketch_b"), "b")
    both = written(both.withColumn("estimate", _estimated(both)).drop("sketch_a", "sketch_b"), "estimates")
    # A far pair matters only if its star has more members, among which the far class may have a partner.
    star = written(both.groupBy("b").agg(F.count("*").alias("in_star")), "star-sizes")
    near = both.join(sized(star), "b").where(f"estimate >= {FAR} OR in_star > 1")
    near = written(near.select("a", "b", "na", "nb"), "near")
    # Full sets, of one document for each class that has a pair.
    wanted = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    reps = written(classes.join(wanted, "cls", "left_semi").select("rep"), "representatives")
    some = docs.where(F.col(key).isNull()).unionByName(docs.join(sized(reps.withColumnRenamed("rep", key), reps), key, "left_semi"))
    sets = written(
        _sets(some, key, size, False).where("n > 0").select("cls", "shingles").dropDuplicates(["cls"]), "sets"
    )
    compared = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    only_a, only_b = F.array_except("sa", "sb"), F.array_except("sb", "sa")
    compared = compared.withColumns({"diff": F.concat(only_a, only_b), "inter": F.col("na") - F.size(only_a)})
    compared = written(
        compared.select("a", "b", "na", "nb", "diff", _linked(F.col("inter"), F.col("na"), F.col("nb")).alias("linked")), "compared"
    )
    dropped(pairs, both, star, near, reps, sets)
    beyond, used = beyond_hubs(compared)
    out = written(beyond, "links")
    dropped(compared, *used)
    return out


def beyond_hubs(compared: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The stars' own links, and links within stars where at least one end isn't linked with the hub: enough of them that
    components are those of all such links. Also the written tables that they read.

    With D(x) the shingles in which x differs from the hub h, |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and x and y
    are linked if 9 |x ^ y| <= |x| + |y| (for 0.8). If x isn't linked with h, any partner y shares more than
    (9 |D(y)| + |h| - |y|) / 18 of its differences with x, and x at least |D(x)| - |x| / 4 of its own with y, whose size
    is 5 / 4 of x's at most. So the two meet within the rarest of their differences: y's half or so, x's longer list.

    Classes of one component need no more links among each other. Of two of different components at least one isn't of the
    hub's, so it isn't linked with it: that one is x. Where more than FEW meet in a difference they are often alike among
    themselves: one of them is a hub of its own and the others meet it in a star. Only what is of different components
    after that is compared pair by pair, if what both have left in their order of differences, from where they meet on,
    can be as much as they must share.
    """
    num, den = LINK
    k = F.lit(den + num)  # |x ^ y| * (den + num) <= (den - num) * (|x| + |y|)
    gap = F.lit(den - num)
    direct = compared.where("linked").select("a", "b")
    stars_now = compared.groupBy("b").agg(F.count("*").alias("m"), F.sum((~F.col("linked")).cast("long")).alias("apart"))
    if stars_now.where("m > 1 AND apart > 0").isEmpty():
        return direct, []
    parts = written(components(direct), "parts")
    roots = [sized(parts.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), parts) for c in "ab"]
    rows = compared.join(roots[0], "a", "left").join(roots[1], "b", "left")
    rows = rows.withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    rows = written(rows.select("b", "a", "na", "nb", "diff", "ra", (F.col("ra") != F.col("rb")).alias("away")), "stars-apart")
    # Stars with members of two components, besides the hub alone.
    torn = rows.groupBy("b").agg(F.count("*").alias("m"), F.max("away").alias("away"), F.min("ra").alias("lo"), F.max("ra").alias("hi"))
    torn = written(torn.where("m > 1 AND away AND lo <> hi").select("b"), "open-stars")
    if not torn._written[1]:
        dropped(parts, rows, torn)
        return direct, []
    open_rows = rows.join(sized(torn), "b", "left_semi")
    nd = F.size("diff")
    least_y = F.greatest(F.floor((k * nd + gap * (F.col("nb") - F.col("na"))) / (2 * k)) + 1, F.lit(1))
    least_x = F.greatest(nd - F.floor(gap * F.col("na") / F.lit(num)), F.lit(1))
    prefixes = {"nd": nd, "prefix_x": F.when(F.col("away"), nd - least_x + 1).otherwise(0), "prefix_y": nd - least_y + 1}
    open_rows = open_rows.withColumns(prefixes).where("prefix_x > 0 OR prefix_y > 0")
    each = open_rows.select("b", "a", F.explode("diff").alias("shingle"))
    rare = written(each.groupBy("b", "shingle").agg(F.count("*").alias("f")).where("f > 1"), "difference-counts")
    # Differences that no one else has can't be met in; they come first in the order, so they shorten the prefix.
    met = each.join(sized(rare), ["b", "shingle"])
    ordered = met.groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("order"))
    ordered = written(ordered.join(open_rows.select("b", "a", "ra", "nd", "na", "prefix_x", "prefix_y"), ["b", "a"]), "ordered")
    # Who meets in which difference, as x and as y, and how much of either's differences is left from there on.
    alone = F.col("nd") - F.size("order")
    depth = {c: F.greatest(F.col(f"prefix_{c}") - alone, F.lit(0)).cast("int") for c in "xy"}
    first = F.posexplode(F.slice("order", F.lit(1), F.greatest(depth["x"], depth["y"]))).alias("at", "o")
    places = ordered.select("b", "a", "ra", "na", "nd", depth["x"].alias("to_x"), depth["y"].alias("to_y"), F.size("order").alias("met"), first)
    places = places.select("b", "a", "ra", "na", "nd", F.col("o.shingle").alias("shingle"), (F.col("met") - F.col("at")).alias("left"),
                           (F.col("at") < F.col("to_x")).alias("as_x"), (F.col("at") < F.col("to_y")).alias("as_y"))
    places = written(places, "difference-places")
    about = ordered.select("b", "a", F.transform("order", lambda o: o["shingle"]).alias("e"), "na", "nd")

    def torn_buckets(members: DataFrame) -> DataFrame:
        found = members.groupBy("b", "shingle").agg(F.count("*").alias("c"), F.max("as_x").alias("any_x"), F.min("ra").alias("lo"), F.max("ra").alias("hi"))
        return written(found.where("any_x AND lo <> hi").select("b", "shingle", "c"), "difference-buckets")

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(about.toDF("b", "x", "ex", "nx", "dx"), ["b", "x"]).join(about.toDF("b", "y", "ey", "ny", "dy"), ["b", "y"])
        apart = F.col("dx") + F.col("dy") - 2 * F.size(F.array_intersect("ex", "ey"))
        return both.where(k * apart <= gap * (F.col("nx") + F.col("ny"))).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()

    buckets = torn_buckets(places)
    many = written(places.join(sized(buckets), ["b", "shingle"]).where(F.col("c") > FEW).select("b", "shingle", "a"), "difference-members")
    degree = written(many.groupBy("b", "a").agg(F.count("*").alias("degree")), "difference-degrees")
    hubs = many.join(sized(degree), ["b", "a"]).groupBy("b", "shingle").agg(F.max(F.struct("degree", "a"))["a"].alias("y"))
    hubs = written(hubs, "difference-hubs")
    pairs = many.join(sized(hubs), ["b", "shingle"]).where("a <> y").select("b", F.col("a").alias("x"), "y").distinct()
    starred = written(linked(pairs), "difference-stars")
    dropped(many, degree, hubs)
    # The members' components are known better now.
    again = written(components(direct.union(starred)), "parts")
    later = sized(again.select(F.col("node").alias("a"), F.col("root").alias("__r")), again)
    members = places.join(sized(buckets.drop("c"), buckets), ["b", "shingle"]).join(later, "a", "left").withColumn("ra", F.coalesce("__r", "ra")).drop("__r")
    still = torn_buckets(members)
    members = members.join(sized(still.drop("c"), still), ["b", "shingle"])
    x, y = (members.where(f"as_{c}").select("b", "shingle", *[F.col(n).alias(f"{c}{n}") for n in ("a", "ra", "na", "nd", "left")]) for c in "xy")
    need = k * (F.col("xnd") + F.col("ynd")) - gap * (F.col("xna") + F.col("yna"))  # of twice the shared differences
    sizes = F.lit(den) * F.least("xna", "yna") >= F.lit(num) * F.greatest("xna", "yna")
    able = (F.col("xra") != F.col("yra")) & sizes & (2 * k * F.least("xleft", "yleft") >= need)
    pairs = x.join(y, ["b", "shingle"]).where(able).select("b", F.col("xa").alias("x"), F.col("ya").alias("y")).distinct()
    found = written(linked(pairs), "links-beyond")
    dropped(parts, rows, torn, rare, ordered, places, buckets, again, still)
    return direct.union(starred).union(found), [starred, found]


def near_duplicates(docs: DataFrame, key: str = "doc_id", size: int = 2) -> DataFrame:
    """One row a document: key, ``n_shingles``, ``component_id`` (least key of its component) and ``kept``."""
    docs = bare(docs, key, "text")
    rows = written(_sets(docs, key, size, True), "sketches")
    classes = written(
        rows.where("n > 0").groupBy("cls").agg(F.min(key).alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch")), "classes"
    )
    edges = links(docs, classes, key, size)
    parts = written(components(edges), "components")
    # The component's id is the least key of all its classes.
    placed = written(classes.select("cls", "rep").join(sized(parts.withColumnRenamed("node", "cls"), parts), "cls"), "placed")
    roots = written(placed.groupBy("root").agg(F.min("rep").alias("id")), "roots")
    ids = written(placed.select("cls", "root").join(sized(roots), "root").select("cls", "id"), "class-ids")
    alone = written(classes.select("cls", "rep").join(sized(ids), "cls", "left").select("cls", F.coalesce("id", "rep").alias("__id")), "ids")
    dropped(edges, parts, placed, roots, ids, classes)
    out = rows.select(key, "cls", F.col("n").alias("n_shingles")).join(alone, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col(key)).otherwise(F.col("__id"))
    out = out.withColumn("component_id", component)
    kept = F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("kept", kept).drop("cls", "__id")
