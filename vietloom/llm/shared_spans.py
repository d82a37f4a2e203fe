"""Problem 10: long spans that stand verbatim in more than one record.

Broadcast suffix automata would stream every record past every reference shard, work that grows with the square of
the corpus; so spans are found by content instead (README). Every window of ``span`` characters has an anchor, the
least of the rolling hashes of its ``GRAM``-character grams; equal windows have equal anchors. Anchors in one record
only are dropped by one shuffle of hashes, and only windows of anchors that remain are compared, by 128-bit hashes over
all their characters. Equal texts are one class from the start. All groups are min / max aggregates with map-side sums:
no group is collected, no pair emitted.

Cases: null texts and texts under ``span`` characters share nothing; repeats inside one record do not count; ids that
repeat with the same text count as one record; very long texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import MULT, U, as_long, bitmap, codes, in_bitmap, mix, ragged

GRAM = 60


def _powers(n: int, m: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    inv = U(pow(int(m), -1, 1 << 64))
    one = np.ones(1, U)
    return np.concatenate([one, np.cumprod(np.full(n, m, U))]), np.concatenate([one, np.cumprod(np.full(n, inv, U))])


def rolling(cp: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` code points from each position on (over the whole batch)."""
    n = len(cp) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    m = MULT + U(2 * seed)
    p, q = _powers(len(cp), m)
    c = np.concatenate([np.zeros(1, U), np.cumsum(mix(cp.astype(U) + U(seed)) * p[:-1], dtype=U)])
    return mix((c[width:] - c[:n]) * q[:n])


def _extreme(a: np.ndarray, width: int, f) -> np.ndarray:
    """Sliding minimum or maximum by doubling."""
    done = 1
    while done * 2 <= width:
        a = f(a[:-done], a[done:])
        done *= 2
    rest = width - done
    return f(a[:-rest], a[rest:]) if rest else a


def anchors(off: np.ndarray, cp: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, is anchor, window starts that lie in one record, least hash of each window)."""
    g = rolling(cp, GRAM)
    w = span - GRAM + 1
    n = len(cp) - span + 1
    if n <= 0:
        e = np.zeros(0, bool)
        return g, np.zeros(len(g), bool), e, np.zeros(0, U)
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = own[:n] == own[span - 1 :]
    least = np.where(inside, _extreme(g, w, np.minimum), U(0))
    around = np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)])
    return g, _extreme(around, w, np.maximum) == g, inside, least


def _batches(b: pa.RecordBatch, chars: int = 1_000_000):
    """Slices of a batch of about so many characters."""
    texts, i, size = b.column("t").to_pylist(), 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= chars or j == len(texts) - 1:
            yield b.slice(i, j + 1 - i), texts[i : j + 1]
            i, size = j + 1, 0


def _texts(df: DataFrame, id_col: str, text: str, span: int) -> DataFrame:
    return df.where(F.length(text) >= span).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("k2"), F.col(text).alias("t"))


def windows(docs: DataFrame, span: int) -> DataFrame:
    """(w1, w2, k, start): windows of the distinct texts whose anchor also stands in another text."""

    def find(batches):
        for b in batches:
            for part, texts in _batches(b):
                off, cp = codes(texts)
                g, is_anchor, _, _ = anchors(off, cp, span)
                at = np.nonzero(is_anchor)[0]
                row = np.searchsorted(off, at, "right") - 1
                once = np.unique(np.stack([row.astype(U), g[at]], 1), axis=0)  # an anchor once a text
                yield pa.RecordBatch.from_arrays([as_long(np.ascontiguousarray(once[:, 1])), part.column("k").take(pa.array(once[:, 0].astype(np.int64)))], names=["h", "k"])

    seen = docs.select("k", "t").mapInArrow(find, "h long, k long")
    common = seen.groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("h")
    hits = written(seen.join(common, "h").groupBy("k").agg(F.collect_set("h").alias("hits")), "hits")  # a text's own anchors only
    one = docs.groupBy("k").agg(F.min("id").alias("id"))
    bits = bitmap(hits, "k")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits, b.column("k").to_numpy())))

    few = docs.mapInArrow(keep, docs.schema)  # only texts that may have hits travel

    def expand(batches):
        for b in batches:
            for part, texts in _batches(b):
                off, cp = codes(texts)
                _, _, inside, least = anchors(off, cp, span)
                at = np.nonzero(inside & np.isin(least, ragged(part.column("hits"))[1].astype(np.int64).view(U)))[0]
                row = np.searchsorted(off, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [as_long(rolling(cp, span, 1)[at]), as_long(rolling(cp, span, 2)[at]), part.column("k").take(pa.array(row)), pa.array((at - off[row]).astype(np.int32))],
                    names=["w1", "w2", "k", "start"],
                )

    return few.join(hits.join(one, "k"), ["k", "id"]).select("k", "t", "hits").mapInArrow(expand, "w1 long, w2 long, k long, start int")


def shared(df: DataFrame, id_col: str, text: str, span: int = 120) -> DataFrame:
    """(id, n_chars, n_shared): characters of each record that lie in spans shared with another one; all rows with any."""
    docs = _texts(df, id_col, text, span)
    w = written(windows(docs, span), "windows")
    common = w.groupBy("w1", "w2").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("w1", "w2")
    starts = w.join(common, ["w1", "w2"]).select("k", "start")
    before = F.lag("start").over(Window.partitionBy("k").orderBy("start"))
    part = starts.withColumn("add", F.least(F.coalesce(F.col("start") - before, F.lit(span)), F.lit(span))).groupBy("k").agg(F.sum("add").cast("long").alias("n_shared"))
    ids = docs.select("id", "k", "k2", F.length("t").cast("long").alias("n_chars")).distinct()
    twins = ids.groupBy("k", "k2").agg(F.count("*").alias("twins"))  # equal by 128 bits
    found = ids.join(twins, ["k", "k2"]).join(part, "k", "left").where("twins > 1 or n_shared > 0")
    return found.select(F.col("id").alias(id_col), "n_chars", F.when(F.col("twins") > 1, F.col("n_chars")).otherwise(F.col("n_shared")).alias("n_shared"))
