"""Problem 1: records of evaluation splits that also stand, the same or almost, in the training split.

Winnowing: of each record disjoint windows are laid, and each window keeps the rolling hash of least count on the other
side (``seeds.minima``). If two records are within the allowed edits ``k`` of the longer one, at least two of its
``k + 2`` minima stand in the shorter one, since an edit hits one window at most: the longer record brings its minima,
the shorter one its rolling hashes of one to four words, and no pair is lost. Both sides in turn are the longer one.

Seeds of a pair are then chained: only pairs with a collinear chain of two seeds or more, every seed of it at a shift
that the allowed edits can bring about, are extended. The extension aligns the records word by word in a band as wide as
the allowed edits; it gives the edit distance, which decides, and the words of the record that stand aligned.

Cases: texts without letters and digits are no record here, nor are rows without an id; equal texts are one class each,
joined once and expanded at the end; ids that repeat give one row; null splits are neither side.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import U, as_long, bitmap, in_bitmap, in_slices, lists, mix, ragged, row_hashes, word_rows
from .seeds import every, minima, sketches

SIGNATURE = 2
#: Bits of the bitmap of minima: 4 MB.
BITS = 25
#: A match adds so little that it never outweighs an edit, and says at the end how many words stand aligned.
EDIT = np.int64(1) << 32
FAR = np.int64(1) << 60
#: Cells of a band, and points of a chain, that are worked on at a time; more only take longer.
CELLS = 1_000_000


def align(xs: list[np.ndarray], ys: list[np.ndarray], band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edit distance in words, equal words of the best alignment) of each pair, as far as it is within its band.

    Pairs of like length go through the dynamic programme together; beyond the band the distance is some larger number.
    """
    n = len(xs)
    cost = np.zeros(n, np.int64)
    order = np.lexsort((band, [len(x) for x in xs]))
    i = 0
    while i < n:
        j, k = i, int(band[order[i]])
        while j < n and (j == i or (j - i + 1) * (2 * max(k, int(band[order[j]])) + 1) <= CELLS // 8):
            k = max(k, int(band[order[j]]))
            j += 1
        part = order[i:j]
        lx, ly = np.array([len(xs[p]) for p in part]), np.array([len(ys[p]) for p in part])
        wide, width = int(lx.max(initial=0)), 2 * k + 1
        x = np.zeros((len(part), wide), np.int64)
        y = np.full((len(part), wide + width + k + 1), 1, np.int64)
        for r, p in enumerate(part):
            x[r, : lx[r]] = xs[p]
            y[r, k : k + ly[r]] = ys[p][: y.shape[1] - k]
        diag = np.arange(width)
        row = np.where(diag >= k, (diag - k) * EDIT, FAR)[None, :].repeat(len(part), 0)
        at_end = np.clip(ly - lx + k, 0, width - 1)
        got = row[np.arange(len(part)), at_end].copy()
        for s in range(1, wide + 1):
            new = row + np.where(x[:, s - 1 : s] == y[:, s - 1 : s - 1 + width], np.int64(-1), EDIT)
            np.minimum(new[:, :-1], row[:, 1:] + EDIT, out=new[:, :-1])
            if s <= k:
                new[:, k - s] = s * EDIT
                new[:, : k - s] = FAR
            row = np.minimum.accumulate(new - diag * EDIT, axis=1) + diag * EDIT
            end = lx == s
            got[end] = row[end, at_end[end]]
        got[np.abs(ly - lx) > k] = FAR
        cost[part] = got
        i = j
    d = -(-cost // EDIT)
    return d, d * EDIT - cost


def chain(points: list[tuple[int, int]], n: int, m: int, k: int) -> int:
    """Length of the longest collinear chain of seeds (place in a record of n words, place in one of m words).

    Of a seed inside an alignment of at most ``k`` edits, the edits before it make up its shift, those behind it the
    rest of the gap in length.
    """
    tails: list[int] = []
    for _, b in sorted({(a, -b) for a, b in points if abs(a - b) + abs((n - a) - (m - b)) <= k}):
        at = bisect_left(tails, -b)
        tails[at : at + 1] = [-b]
    return len(tails)


def _signature(off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``SIGNATURE`` words of bits, one bit per distinct word."""
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    m = mix(h.astype(np.int64).view(U))
    out = np.zeros((len(off) - 1, SIGNATURE), U)
    np.bitwise_or.at(out, (own, (m & U(SIGNATURE - 1)).astype(np.int64)), U(1) << (m >> U(58)))
    return out


def _rows(b: pa.RecordBatch, off: np.ndarray, h: np.ndarray, row: np.ndarray, pos: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    """One row a gram and record, with all its places in the record."""
    order = np.lexsort((pos, g, row))
    row, pos, g = row[order], pos[order], g[order]
    first = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])]))[0] if len(row) else np.zeros(0, np.int64)
    own, sig = row[first], _signature(off, h)
    places = lists(np.concatenate([first, [len(row)]]), pa.array(pos.astype(np.int32)))
    take = pa.array(own)
    return pa.RecordBatch.from_arrays(
        [as_long(g[first]), b.column("a").take(take), b.column("b").take(take), pa.array(np.diff(off)[own].astype(np.int32)), places, *(as_long(np.ascontiguousarray(sig[own, j])) for j in range(SIGNATURE))],
        names=["g", "a", "b", "n", "p", *(f"s{j}" for j in range(SIGNATURE))],
    )


_SEED = "g long, a long, b long, n int, p array<int>, " + ", ".join(f"s{j} long" for j in range(SIGNATURE))


def need(n: np.ndarray, share: int) -> np.ndarray:
    """Windows of a record of ``n`` words: two more than the edits it allows, or all of its words if that is less; none
    where it allows no edit."""
    return np.where(n >= share, np.minimum(n // share + 2, n), 0)


def _longer(classes: DataFrame, side: str, sketch: np.ndarray, share: int) -> DataFrame:
    """Minima of the records of one side, to be looked for in shorter ones of the other."""

    def run(batches):
        for b in batches:
            off, h = ragged(b.column("w"))
            yield _rows(b, off, h, *minima(off, h, need(np.diff(off), share), sketch))

    return classes.where(side).select("w", "a", "b").mapInArrow(run, _SEED)


def _shorter(classes: DataFrame, side: str, bits: np.ndarray) -> DataFrame:
    """All rolling hashes of the records of one side that may be a minimum of the other."""

    def run(batches):
        for b in batches:
            off, h = ragged(b.column("w"))
            yield _rows(b, off, h, *every(off, h, np.ones(b.num_rows, bool), lambda g: in_bitmap(bits, g)))

    return classes.where(side).select("w", "a", "b").mapInArrow(run, _SEED)


def _candidates(long: DataFrame, short: DataFrame, share: int, ties: bool) -> DataFrame:
    """Pairs (a1, b1 the longer record, a2, b2 the shorter) that share two minima within the bounds, with their places.

    The join key has a band of lengths (doublings) besides the gram, so a gram that very many records hold meets only
    records of like length; the longer record looks in the band below as well if the least length is there.
    """
    band = lambda n: F.length(F.bin(n))
    cols = ["a", "b", "n", "p", *(f"s{j}" for j in range(SIGNATURE))]
    least = F.col("n1") - F.floor(F.col("n1") / share)
    x = long.select("g", *(F.col(c).alias(c + "1") for c in cols)).withColumn("l", F.explode(F.array_distinct(F.array(band(F.col("n1")), band(least)))))
    y = short.select("g", band(F.col("n")).alias("l"), *(F.col(c).alias(c + "2") for c in cols))
    k = F.floor(F.col("n1") / share)

    def missing(i, j):
        return sum(F.bit_count(F.col(f"s{w}{i}").bitwiseAND(F.bitwise_not(F.col(f"s{w}{j}")))) for w in range(SIGNATURE))

    near = (F.array_min("p1") - F.array_max("p2") <= k) & (F.array_min("p2") - F.array_max("p1") <= k)
    long_enough = (F.col("n1") - F.col("n2") <= k) & (F.col("n1") >= F.col("n2") if ties else F.col("n1") > F.col("n2"))
    other = (F.col("a1") != F.col("a2")) | (F.col("b1") != F.col("b2"))
    hits = x.hint("merge").join(y, ["g", "l"]).where(long_enough & other & near & (missing(1, 2) <= k) & (missing(2, 1) <= k))
    pairs = hits.groupBy("a1", "b1", "a2", "b2").agg(F.sum(F.least(F.size("p1"), F.size("p2"))).alias("shared"), F.first("n1").alias("n1"), F.collect_list(F.struct("p1", "p2")).alias("seeds"))
    return pairs.where(F.col("shared") >= F.least(F.lit(2), F.col("n1") - k)).drop("shared", "n1")


def _chained(batches):
    """Rows whose seeds make a chain of two or more; where places are too many to chain, the count of seeds has decided."""
    for t in batches:
        keep = []
        for n, m, k, seeds in zip(*(t.column(c).to_pylist() for c in ("n1", "n2", "k", "seeds")), strict=True):
            size = sum(len(s["p1"]) * len(s["p2"]) for s in seeds)
            keep.append(size > CELLS or chain([(a, b) for s in seeds for a in s["p1"] for b in s["p2"]], n, m, k) >= min(2, n - k))
        t = t.filter(pa.array(keep, pa.bool_()))
        xs, ys = ([f[o[i] : o[i + 1]] for i in range(t.num_rows)] for o, f in (ragged(t.column("w1")), ragged(t.column("w2"))))
        k = t.column("k").to_numpy().astype(np.int64)
        d, same = align(xs, ys, k)
        ok = pa.array(d <= k)
        yield pa.RecordBatch.from_arrays([*(t.column(c).filter(ok) for c in ("a1", "b1", "a2", "b2")), pa.array(d).filter(ok), pa.array(same).filter(ok)], names=["a1", "b1", "a2", "b2", "distance", "n_equal"])


def close_classes(classes: DataFrame, share: int) -> DataFrame:
    """(ea, eb, ta, tb, distance, n_equal): pairs of an evaluation and a training class of different words."""
    in_eval, in_train = sketches(classes, "w", ["eval", "train"], (1, 2, 3, 4))
    w = classes.select("a", "b", F.size("w").alias("n"), "w")
    out = []
    for long, short, sketch in (("eval", "train", in_train), ("train", "eval", in_eval)):
        seeds = written(_longer(classes, long, sketch, share), "minima")
        pairs = _candidates(seeds, _shorter(classes, short, bitmap(seeds, "g", BITS)), share, ties=long == "eval")
        for i in (1, 2):
            pairs = pairs.hint("merge").join(w.select(*(F.col(c).alias(f"{c}{i}") for c in ("a", "b", "n", "w"))), [f"a{i}", f"b{i}"])
        pairs = pairs.withColumn("k", F.floor(F.col("n1") / share).cast("int")).select("a1", "b1", "a2", "b2", "n1", "n2", "k", "seeds", "w1", "w2")
        got = pairs.mapInArrow(_chained, "a1 long, b1 long, a2 long, b2 long, distance long, n_equal long")
        e, t = (1, 2) if long == "eval" else (2, 1)
        out.append(got.select(F.col(f"a{e}").alias("ea"), F.col(f"b{e}").alias("eb"), F.col(f"a{t}").alias("ta"), F.col(f"b{t}").alias("tb"), "distance", "n_equal"))
    return out[0].unionByName(out[1])


def overlaps(df: DataFrame, id_col: str, text: str, split: str, train: str = "train", evals: tuple[str, ...] = ("dev", "test"), share: int = 4) -> DataFrame:
    """(eval_id, train_id, distance, n_words, n_equal): pairs of which at most 1/``share`` of the longer text's words
    differ; ``n_words`` and ``n_equal`` are the evaluation record's words and those that stand aligned in the other."""
    side = F.when(F.col(split) == train, False).when(F.col(split).isin(*evals), True)
    rows = df.select(F.col(id_col).alias("id"), side.alias("e"), F.col(text).alias("t")).where("id is not null and e is not null and t is not null")
    kind = dict(rows.dtypes)["id"]

    def words(batches):
        for b in batches:
            for part, texts in in_slices(b, "t"):
                off, h = word_rows(texts, squeeze=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("e"), lists(off, pa.array(h)), as_long(row_hashes(off, h, 1)), as_long(row_hashes(off, h, 2))], names=["id", "e", "w", "a", "b"])

    rec = written(rows.mapInArrow(words, f"id {kind}, e boolean, w array<long>, a long, b long").where("size(w) > 0"), "records")
    classes = written(rec.groupBy("a", "b").agg(F.first("w").alias("w"), F.max("e").alias("eval"), F.max(~F.col("e")).alias("train")), "classes")
    n = F.size("w").cast("long")
    same = classes.where("eval and train").select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("a").alias("ta"), F.col("b").alias("tb"), F.lit(0).cast("long").alias("distance"), n.alias("n_equal"))
    close = close_classes(classes, share).unionByName(same)
    e = rec.where("e").select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("id").alias("eval_id"), n.alias("n_words")).distinct()
    t = rec.where("not e").select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("id").alias("train_id")).distinct()
    return close.hint("merge").join(e, ["ea", "eb"]).hint("merge").join(t, ["ta", "tb"]).select("eval_id", "train_id", "distance", "n_words", "n_equal")
