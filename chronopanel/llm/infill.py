"""Fill-in-the-middle by succinct rank and select: a text's token starts are a packed bitvector over its bytes.

A bit is set where a token begins: at the text's first byte, and at white space that follows other characters. Blocks of
512 bits have a directory of the bits set before them, so the number of tokens is the total popcount, and the byte at
which any token begins is found by select: search the directory, then one block's words, then one word. Two draws by a
hash of the key give the token counts of prefix and middle; two selects give the byte cuts. Nothing is split into a list
of tokens, whatever the text's length, and no row meets another, so there is no shuffle.

Defined results: a null or empty text has no tokens and stays as it is (form plain, output empty); a text that contains a
sentinel stays plain; a text of white space alone is one token; a null key draws like an empty one; repeated rows get
equal results; other columns are carried along, and result columns replace those of the same names. Texts are handled
as bytes, so invalid UTF-8 comes back byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are transformed, per cent of these with the suffix first, and the seed of the draws.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: Bits in a block of the directory, bytes that are unpacked at a time, and bytes of results that are handed on at a time.
BLOCK, CHUNK, SLICE = 512, 1 << 20, 4 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True


class Boundaries:
    """Where tokens begin in a text of bytes: rank and select over a packed bitvector with a block directory."""

    def __init__(self, raw: bytes):
        self.size = len(raw)
        words, data = np.zeros(-(-self.size // BLOCK) * (BLOCK // 64), dtype="<u8"), np.frombuffer(raw, dtype=np.uint8)
        packed, before = words.view(np.uint8), True  # a text begins as if other characters came before
        for a in range(0, self.size, CHUNK):
            white = _WHITE[data[a : a + CHUNK]]
            start = white & np.r_[before, ~white[:-1]]
            if a == 0:
                start[0] = True
            bits = np.packbits(start, bitorder="little")
            packed[a // 8 : a // 8 + len(bits)] = bits
            before = not white[-1]
        self.words = words
        counts = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
        self.directory = np.r_[np.int64(0), np.cumsum(counts)]

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, byte: int) -> int:
        """Tokens that begin before a byte."""
        block, inside = divmod(byte, BLOCK)
        if block >= len(self.directory) - 1:
            return self.total
        words = self.words[block * (BLOCK // 64) : (block + 1) * (BLOCK // 64)].view(np.uint8)
        return int(self.directory[block] + np.unpackbits(words, bitorder="little")[:inside].sum())

    def select(self, k: int) -> int:
        """The byte at which token ``k`` begins, from 0; the text's length if there are only ``k``."""
        if k >= self.total:
            return self.size
        block = int(np.searchsorted(self.directory, k, side="right")) - 1
        words = self.words[block * (BLOCK // 64) : (block + 1) * (BLOCK // 64)]
        left = k - int(self.directory[block])
        upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        word = int(np.searchsorted(upto, left, side="right"))
        left -= int(upto[word - 1]) if word else 0
        bit = np.flatnonzero(np.unpackbits(words[word : word + 1].view(np.uint8), bitorder="little"))[left]
        return block * BLOCK + word * 64 + int(bit)


def draws(key: str | None, seed: int = SEED) -> list[int]:
    """Four draws of 32 bits for a document."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def n_code_points(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80))


def rearranged(raw: bytes, key: str | None, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED,
               sentinels: tuple = SENTINELS) -> tuple:
    """(tokens, form, code points of prefix, of middle, output) of one text."""
    starts = Boundaries(raw)
    n, (h1, h2, h3, h4) = starts.total, draws(key, seed)
    p, s, m = (x.encode() for x in sentinels)
    if not raw or h3 % 100 >= rate or any(x in raw for x in (p, s, m)):
        return n, "plain", None, None, raw
    a, b = (starts.select(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", n_code_points(prefix), n_code_points(middle), s + suffix + p + prefix + m + middle
    return n, "psm", n_code_points(prefix), n_code_points(middle), p + prefix + s + suffix + m + middle


def rebuilt(output: bytes, form: str, sentinels: tuple = SENTINELS) -> bytes:
    """The text, from an output and its form alone."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in sentinels)
    first, second = (s, p) if form == "spm" else (p, s)
    one, two = output.index(second), output.index(m)
    x, y, middle = output[len(first) : one], output[one + len(second) : two], output[two + len(m) :]
    return y + middle + x if form == "spm" else x + middle + y


def slices(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Places from and to of consecutive texts of about SLICE bytes together, so that results are handed on in small parts."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= SLICE:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def checked(sentinels: tuple) -> tuple:
    """Sentinels that no text without them can form together with one: none ends as another, or itself, begins."""
    for x in sentinels:
        for y in sentinels:
            if any(x.endswith(y[:k]) for k in range(1, len(y) + (x != y))):
                raise ValueError(f"sentinels {x!r} and {y!r} overlap")
    return sentinels


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
              seed: int = SEED, sentinels: tuple = SENTINELS) -> DataFrame:
    """Every row with ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    checked(sentinels)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output binary")
    def rearrange(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            for a, b in slices(texts):
                rows = [rearranged(bytes(t), k, rate, suffix_first, seed, sentinels) for t, k in zip(texts[a:b], keys[a:b], strict=True)]
                out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
                yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit("").cast("binary"))
    out = docs.withColumn("__fim", rearrange(raw, F.col(f"`{key}`").cast("string")))
    names = {c: F.col(f"__fim.{c}") for c in ("n", "form", "prefix_chars", "middle_chars")}
    return out.withColumns(names | {"output": F.col("__fim.output").cast("string")}).drop("__fim")


def restored(output: str = "output", form: str = "form", sentinels: tuple = SENTINELS) -> Column:
    """The exact texts, from outputs and forms."""

    @F.pandas_udf("binary")
    def rebuild(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            for a, b in slices(outputs):
                yield pd.Series([rebuilt(bytes(o), f, sentinels) for o, f in zip(outputs[a:b], forms[a:b], strict=True)], dtype=object)

    return rebuild(F.col(output).cast("binary"), F.col(form)).cast("string")


def oracle() -> str:
    token = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    draw = ", ".join(f"('0x' || substr(sha, {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    p, s, m = SENTINELS
    plain = " OR ".join(f"contains(t, '{x}')" for x in SENTINELS)
    return f"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM documents),
cut AS (SELECT doc_id, t, regexp_extract_all(t, '{token}') AS u, {draw} FROM drawn),
sized AS (SELECT *, len(u) AS n, CASE WHEN t = '' OR {plain} OR h3 % 100 >= {RATE} THEN 'plain'
                 WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM cut),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM sized),
parts AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || x || '{s}' || z || '{m}' || y
                        ELSE '{s}' || z || '{p}' || x || '{m}' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
