"""Problem 5: evaluation passages inside corpus records, as a prefix-filtered set join.

The items are all windows of ``span`` words of the evaluation texts. Of a window's ``SHINGLE``-word shingles only the
rarest is joined, by its count in the corpus: a record that holds the whole window must hold that shingle, so one
necessary token per window loses nothing, and a window with a shingle the corpus does not hold needs no join. A shingle
that is frequent in the corpus is joined only where all of a window's shingles are. Joined seeds carry the words around
them; bounds on what can lie to the left and right prune first, then the words are compared position by position over
the item-sized window.

Cases: null and blank texts have no words and never match; evaluation texts under ``span`` words have no window;
ids that repeat give one row; very long texts are processed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import U, as_long, bitmap, in_bitmap, lists, ragged, with_words
from .seeds import inside, look_up, run_hashes, sketches

SHINGLE = 5


def rarest_in_windows(row: np.ndarray, pos: np.ndarray, count: np.ndarray, h: np.ndarray, width: int, whole: bool) -> np.ndarray:
    """Indices of grams that are the rarest of some window of ``width`` grams of one row (ties by hash).

    ``whole``: rows with fewer grams than ``width`` have one window of all they have, else none.
    """
    n = len(row)
    if not n:
        return np.zeros(0, np.int64)
    key = (np.minimum(count, (1 << 23) - 1).astype(U) << U(40)) | (h >> U(24))
    starts = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
    size = np.diff(np.concatenate([starts, [n]]))
    last = np.repeat(starts + size - 1, size)
    at = np.arange(n)
    ok = at + width - 1 <= last
    if whole:
        ok |= (pos == 0) | (at == np.repeat(starts, size))
    at = at[ok]
    end = last[ok]
    best = at.copy()
    for j in range(1, width):
        c = np.minimum(at + j, end)
        best = np.where(key[c] <= key[best], c, best)
    return np.unique(best)


def contexts(off: np.ndarray, h: np.ndarray, row: np.ndarray, pos: np.ndarray, left: int, width: int, pad: int) -> np.ndarray:
    """The ``width`` words from ``left`` before each position on; ``pad`` outside of the row."""
    at = (off[row] + pos - left)[:, None] + np.arange(width)
    inside = (at >= off[row][:, None]) & (at < off[row + 1][:, None])
    out = np.full(at.shape, pad, np.int64)
    out[inside] = h[at[inside]]
    return out


def _seeds(df: DataFrame, span: int, choose, pad: int) -> DataFrame:
    """(g, id, l, r, c): chosen shingles of each row with the words around them, and how many of those there are."""
    around = span - SHINGLE

    def run(batches):
        for b in batches:
            off, h = ragged(b.column("w"))
            g = run_hashes(off, h, SHINGLE)
            at = np.nonzero(inside(off, SHINGLE)[: len(g)])[0]
            row = np.searchsorted(off, at, "right") - 1
            pos, g = at - off[row], g[at]
            sel = choose(row, pos, g)
            row, pos, g = row[sel], pos[sel], g[sel]
            n = np.diff(off)[row]
            ctx = contexts(off, h, row, pos, around, 2 * around + SHINGLE, pad)
            yield pa.RecordBatch.from_arrays(
                [as_long(g), b.column("id").take(pa.array(row)), pa.array(np.minimum(pos, around).astype(np.int32)), pa.array(np.minimum(n - pos - SHINGLE, around).astype(np.int32)),
                 lists(np.arange(len(row) + 1) * (2 * around + SHINGLE), pa.array(ctx.ravel()))],
                names=["g", "id", "l", "r", "c"],
            )

    return df.mapInArrow(run, f"g long, id {dict(df.dtypes)['id']}, l int, r int, c array<long>")


def _rarest(sketch: np.ndarray, span: int):
    def choose(row, pos, g):
        count = look_up(sketch, g)
        sel = rarest_in_windows(row, pos, count.astype(np.int64), g, span - SHINGLE + 1, whole=False)
        return sel[count[sel] > 0]

    return choose


def words(df: DataFrame, id_col: str, text: str | Column, span: int) -> DataFrame:
    t = F.col(text) if isinstance(text, str) else text
    return with_words(df.select(F.col(id_col).alias("id"), t.alias("t")).where("id is not null and t is not null"), "t").where(F.size("w") >= span)


def leaks(corpus: DataFrame, corpus_id: str, corpus_text: str, items: DataFrame, item_id: str, item_texts: list[str], span: int = 14) -> DataFrame:
    """(corpus_id, item_id): records with ``span`` consecutive words of an evaluation text in a row.

    Broadcast are a sketch of shingle counts (4 MB) and a bitmap of the seeds (2 MB), both of fixed size whatever the
    data; at most 262,144 words of 64 bits of the bitmap reach the driver. Their filling up costs time, never results.
    """
    around = span - SHINGLE
    c = words(corpus, corpus_id, corpus_text, span)
    i = words(items.select(F.col(item_id), F.explode(F.array(*item_texts)).alias("_text")), item_id, "_text", span)
    sketch = sketches(c.select("w", F.lit(True).alias("on")), "w", ["on"], (SHINGLE,))[0]
    seeds = written(_seeds(i, span, _rarest(sketch, span), 2).dropDuplicates(["g", "id", "l", "r", "c"]), "shingles")
    bits = bitmap(seeds, "g")
    hits = _seeds(c, span, lambda row, pos, g: np.nonzero(in_bitmap(bits, g))[0], 1)
    i = seeds.select("g", F.col("id").alias("item"), F.col("l").alias("l2"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    pairs = hits.hint("merge").join(i, "g").where(F.least("l", "l2") + F.least("r", "r2") >= around)

    def verify(batches):
        for b in batches:
            _, x = ragged(b.column("c"))
            _, y = ragged(b.column("c2"))
            e = (x == y).reshape(b.num_rows, 2 * around + SHINGLE)
            before = np.cumprod(e[:, :around][:, ::-1], axis=1).sum(axis=1)
            after = np.cumprod(e[:, around:], axis=1).sum(axis=1)
            ok = (after >= SHINGLE) & (before + after >= span)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), b.column("item").filter(pa.array(ok))], names=["corpus_id", "item_id"])

    kinds = dict(pairs.dtypes)
    return pairs.select("id", "item", "c", "c2").mapInArrow(verify, f"corpus_id {kinds['id']}, item_id {kinds['item']}").distinct()
