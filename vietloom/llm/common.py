"""Shared pieces: ragged arrays from Arrow, hashing, fixed-size count sketches and bitmaps."""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO
from ..session import shared_dir

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
BITMAP_BITS = 24


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def ragged(a: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, flat numpy values) of an Arrow list column; a null row counts as empty."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    n = len(a)
    if a.null_count:
        lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(a), 0))
        off = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        return off, a.flatten().to_numpy(zero_copy_only=False)
    off = a.offsets.to_numpy()[: n + 1].astype(np.int64)
    return off - off[0], a.flatten().to_numpy(zero_copy_only=False)


def owners(off: np.ndarray) -> np.ndarray:
    """Row number of each flat value."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def grams(off: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` values inside a row: (row, position in row, hash)."""
    n = len(h) - k + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, U)
    own = owners(off)
    ok = own[:n] == own[k - 1 :]
    u = h.astype(np.int64).view(U)
    g = np.zeros(n, U)
    for j in range(k):
        g = g * MULT + u[j : j + n]
    at = np.nonzero(ok)[0]
    return own[at], at - off[own[at]], mix(g[at])


def lists(off: np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)


def bitmap(df: DataFrame, col: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A presence bitmap of the hashes in ``col``: always ``2**bits`` bits (2 MB at 24 bits).

    A set bit means "perhaps present"; a clear one proves absence. It only thins rows before an exact join.
    """
    slot = F.col(col).bitwiseAND((1 << bits) - 1)
    rows = (
        df.select(F.shiftright(slot, 6).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast({col} & 63 as int))").alias("b"))
        .groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(1 << (bits - 6), U)
    if rows.num_rows:
        out[rows["i"].to_numpy()] = rows["b"].to_numpy().view(U)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    u = h.astype(np.int64).view(U) if h.dtype != U else h
    u = u & U(len(bits) * 64 - 1)
    return ((bits[(u >> U(6)).astype(np.int64)] >> (u & U(63))) & U(1)).astype(bool)


def as_long(u: np.ndarray) -> pa.Array:
    return pa.array(u.view(np.int64))


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, code points) of a batch of texts; null counts as empty."""
    t = ["" if x is None else x for x in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in t])]).astype(np.int64)
    return off, np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32)


#: What a code point is in a word: a gap between words, a mark that is passed over, or its folded letter or digit.
GAP, MARK = 0, 1


@functools.cache
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its folded letter or digit (:data:`GAP`, :data:`MARK`), and whether that is a letter."""
    latin = dict(zip(FOLD_FROM, FOLD_TO, strict=True))
    to, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0)):  # letters that stand for themselves
        to[a:b] = np.arange(a, b)
        letter[a:b] = True
    to[0xE0100:0xE01F0] = MARK
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000)]:
        kind = unicodedata.category(chr(cp))[0]
        if kind == "M":
            to[cp] = MARK
        elif kind in "LN":
            low = chr(cp).lower()[0]
            to[cp] = ord(latin.get(low, low))
            letter[to[cp]] = kind == "L"
    return to, letter


@functools.lru_cache(4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, ``2**bits`` of each."""
    one = np.ones(1, U)
    n = (1 << bits) - 1
    return np.concatenate([one, np.cumprod(np.full(n, MULT, U))]), np.concatenate([one, np.cumprod(np.full(n, U(pow(int(MULT), -1, 1 << 64)), U))])


def word_rows(texts: list[str | None], squeeze: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit hashes) of the words of each text: runs of letters or digits without case and diacritics;
    ``squeeze`` also takes a repeated letter once. Code points stream through a table, no folded text is made.

    The same words as ``fold_words`` gives as strings; null and blank texts have none.
    """
    to, letter = _fold()
    off, cp = codes(texts)
    c = to[cp]
    own = np.repeat(np.arange(len(texts)), np.diff(off))
    if (skip := c == MARK).any():
        c, own = c[~skip], own[~skip]
    if squeeze and len(c):
        again = np.zeros(len(c), bool)
        again[1:] = (c[1:] == c[:-1]) & (own[1:] == own[:-1]) & letter[c[1:]]
        c, own = c[~again], own[~again]
    full = c != GAP
    if not full.any():
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate([[True], own[1:] != own[:-1]])
    start = np.nonzero(full & (edge | np.concatenate([[True], ~full[:-1]])))[0]
    end = np.nonzero(full & np.concatenate([edge[1:] | ~full[1:], [True]]))[0] + 1
    p, q = _powers(max(16, int(len(c)).bit_length()))
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(c) * p[: len(c)], dtype=U)])
    h = mix((total[end] - total[start]) * q[start] + (end - start).astype(U))
    return np.concatenate([[0], np.cumsum(np.bincount(own[start], minlength=len(texts)))]).astype(np.int64), h.view(np.int64)


def in_slices(b: pa.RecordBatch, column: str, chars: int = 1_000_000):
    """Slices of a batch of about so many characters of a text column, with the texts."""
    texts, i, size = b.column(column).to_pylist(), 0, 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or j == len(texts) - 1:
            yield b.slice(i, j + 1 - i), texts[i : j + 1]
            i, size = j + 1, 0


def with_words(df: DataFrame, text: str, name: str = "w", squeeze: bool = False) -> DataFrame:
    """``df`` with the word hashes of ``text`` in its place, as column ``name``."""
    fields = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        for b in batches:
            for part, texts in in_slices(b, text):
                off, h = word_rows(texts, squeeze)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), lists(off, pa.array(h))], names=[*(f.name for f in fields), name])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` array<long>")


def row_hashes(off: np.ndarray, h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of values, in their order."""
    p, q = _powers(max(16, int(len(h)).bit_length()))
    v = mix(h.astype(np.int64).view(U) + U(seed))
    total = np.concatenate([np.zeros(1, U), np.cumsum(v * p[: len(h)], dtype=U)])
    n = np.diff(off)
    return mix((total[off[1:]] - total[off[:-1]]) * q[np.minimum(off[:-1], len(q) - 1)] + n.astype(U) * U(2 * seed + 1))


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Texts longer than this are no training rows (they are judged all the same), so that a sample has a bounded size.
SAMPLE_CHARS = 4_000


def sampled(df: DataFrame, columns: list[str], rows: int) -> list[tuple]:
    """At most ``rows`` rows of text ``columns`` in the order of their hash: the same ones however the table is laid out.

    A bound on the hash, from the number of rows, thins every task's share before the top-n; should it let too few
    through, all rows take part.
    """
    x = df.select(*columns, F.xxhash64(*columns).alias("_h"))
    for c in columns:
        x = x.where(F.length(c) <= SAMPLE_CHARS)
    take = lambda d: [tuple(r)[:-1] for r in d.orderBy("_h", *columns).limit(rows).collect()]
    total = x.count()
    if total > 4 * rows + 1000:
        got = take(x.where(F.col("_h") < int((2 * rows + 200) / total * 2**64) - 2**63))
        if len(got) == rows:
            return got
    return take(x)


_models: dict[str, bytes] = {}


def stored(spark: SparkSession, name: str, key: object, make) -> bytes:
    """What ``make`` gives for ``key``, made once: kept in the shared folder under the key's hash and read from there."""
    digest = hashlib.sha256(repr(key).encode("utf-8", "surrogatepass")).hexdigest()[:40]
    if digest not in _models:
        path = f"{shared_dir(spark)}/vietloom-model-{name}-{digest}"
        try:
            _models[digest] = bytes(spark.read.schema("m binary").parquet(path).first()[0])
        except (AnalysisException, TypeError):  # there is none, or none that was written whole
            _models[digest] = make()
            spark.createDataFrame([(bytearray(_models[digest]),)], "m binary").coalesce(1).write.mode("overwrite").parquet(path)
    return _models[digest]


def spread(df: DataFrame) -> DataFrame:
    """At least a task a core where a small table lies in fewer files than that; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
