"""Selected rolling hashes: fixed-size count sketches of word runs, and disjoint windows of least count.

A record of ``n`` words that differs by at most ``k`` edits from another one keeps at least ``c - k`` of any ``c``
disjoint runs of its words, as an edit hits one of them at most. :func:`minima` chooses the ``c`` disjoint runs (of
one to ``GRAM`` words) whose counts on the other side sum to the least: windows are laid by dynamic programming, and
each keeps one rolling hash. Runs that the other side does not know cost nothing and need no join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MULT, U, mix, ragged

GRAM = 4
BITS = 22
SLOT = 1 << 16
BLOCK = 64


def run_hashes(off: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of the run of ``k`` words from each flat position; runs that leave their row have no meaning."""
    n = len(h) - k + 1
    u = h.astype(np.int64).view(U)
    g = np.zeros(max(n, 0), U)
    for j in range(k):
        g = g * MULT + u[j : j + n]
    return mix(g * U(2 * k + 1) + U(k))


def inside(off: np.ndarray, k: int) -> np.ndarray:
    """Which flat positions have ``k`` words left in their row."""
    n = np.diff(off)
    own = np.repeat(np.arange(len(n)), n)
    return (np.arange(off[-1]) + k <= off[1:][own]) if len(own) else np.zeros(0, bool)


def levels(counts: np.ndarray) -> np.ndarray:
    """A count as one byte, in steps of a fifth of a doubling; 0 only for 0."""
    return np.minimum(np.ceil(5 * np.log2(1.0 + counts)), 255).astype(np.uint8)


COST = np.exp2(np.arange(256) / 5) - 1


def sketches(df: DataFrame, words: str, sides: list[str], sizes: tuple[int, ...], bits: int = BITS) -> list[np.ndarray]:
    """For each boolean column of ``sides``: counts of word runs by hash bucket over its rows, as :func:`levels`.

    A task counts into one array of ``2**bits`` counters; tasks are summed slot by slot as their arrays stream in, and
    the driver gets one byte a counter (4 MB a side at 22 bits) whatever the data.
    """

    def count(batches):
        total = np.zeros((len(sides), 1 << bits), np.uint32)
        for b in batches:
            off, h = ragged(b.column(words))
            own = np.repeat(np.arange(len(off) - 1), np.diff(off))
            on = [np.asarray(b.column(s).to_numpy(zero_copy_only=False), bool)[own] if len(own) else np.zeros(0, bool) for s in sides]
            for k in sizes:
                g = run_hashes(off, h, k)
                at = (g & U((1 << bits) - 1)).astype(np.int64)
                ok = inside(off, k)[: len(g)]
                for i in range(len(sides)):
                    np.add.at(total[i], at[ok & on[i][: len(g)]], 1)
        for i in range(len(sides)):
            for s in np.nonzero(total[i].reshape(-1, SLOT).any(1))[0]:
                part = np.minimum(total[i, s * SLOT : (s + 1) * SLOT], 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([i * 1000 + s], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slot", "c"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, c in zip(b.column("slot").to_pylist(), b.column("c").to_pylist(), strict=True):
                part = np.frombuffer(c, np.uint16).astype(np.uint64)
                total[s] = total[s] + part if s in total else part
        for s, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([levels(c).tobytes()], pa.binary())], names=["slot", "c"])

    parts = max(1, min(len(sides) << max(bits - 16, 0), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = df.select(words, *sides).mapInArrow(count, "slot int, c binary").repartition(parts, "slot").mapInArrow(add, "slot int, c binary").toArrow()
    out = [np.zeros(1 << bits, np.uint8) for _ in sides]
    for s, c in zip(rows["slot"].to_pylist(), rows["c"].to_pylist(), strict=True):
        out[s // 1000][s % 1000 * SLOT : (s % 1000 + 1) * SLOT] = np.frombuffer(c, np.uint8)
    return out


def look_up(sketch: np.ndarray, g: np.ndarray) -> np.ndarray:
    return sketch[(g & U(len(sketch) - 1)).astype(np.int64)]


def minima(off: np.ndarray, h: np.ndarray, need: np.ndarray, sketch: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in row, hash) of ``need`` disjoint runs of each row, of least summed count; unknown ones left out.

    Long rows are cut into blocks of up to ``BLOCK`` words, each with its share of the windows.
    """
    n = np.diff(off)
    rows = np.nonzero((need > 0) & (n > 0))[0]
    e = np.zeros(0, np.int64)
    if not len(rows):
        return e, e, np.zeros(0, U)
    hashes = [run_hashes(off, h, k) for k in range(1, gram + 1)]
    cost = np.full((gram, len(h)), np.inf, np.float32)
    for k in range(1, gram + 1):
        cost[k - 1, : len(hashes[k - 1])] = COST[look_up(sketch, hashes[k - 1])]
    nb = -(-n[rows] // BLOCK)
    own = np.repeat(rows, nb)
    i = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(nb)[:-1]]), nb)
    of = np.repeat(nb, nb)
    start, end = off[own] + n[own] * i // of, off[own] + n[own] * (i + 1) // of
    want = need[own] * (i + 1) // of - need[own] * i // of
    out_at, out_k = [], []
    for a in range(0, len(own), 4096):
        s, w = start[a : a + 4096], want[a : a + 4096]
        size = end[a : a + 4096] - s
        width, top, m = int(size.max()), int(w.max()), len(s)
        best = np.full((width + 1, m, top + 1), np.inf, np.float32)
        best[:, :, 0] = 0
        step = np.zeros((width + 1, m, top + 1), np.int8)
        for j in range(1, width + 1):
            best[j] = best[j - 1]
            for k in range(1, min(gram, j) + 1):
                c = np.where(j <= size, cost[k - 1, np.minimum(s + j - k, len(h) - 1)], np.inf).astype(np.float32)
                # a hair of cost a run keeps runs longer where counts are alike, so windows fill the record
                new = best[j - k, :, :-1] + (c + np.float32(1e-4 / k))[:, None]
                better = new < best[j, :, 1:]
                best[j, :, 1:][better] = new[better]
                step[j, :, 1:][better] = k
        at, left, which = size.copy(), w.copy(), np.arange(m)
        while True:
            live = np.nonzero((at > 0) & (left > 0))[0]
            if not len(live):
                break
            k = step[at[live], which[live], left[live]].astype(np.int64)
            took = live[k > 0]
            kk = k[k > 0]
            at[live[k == 0]] -= 1
            at[took] -= kk
            left[took] -= 1
            out_at.append(s[took] + at[took])
            out_k.append(kk)
    at, k = np.concatenate(out_at), np.concatenate(out_k)
    g = np.zeros(len(at), U)
    for x in range(1, gram + 1):
        g[k == x] = hashes[x - 1][at[k == x]]
    known = look_up(sketch, g) > 0
    at, g = at[known], g[known]
    row = np.searchsorted(off, at, "right") - 1
    return row, at - off[row], g


def every(off: np.ndarray, h: np.ndarray, on: np.ndarray, keep, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in row, hash) of all runs of rows that are ``on`` whose hash ``keep`` lets through."""
    own = np.repeat(np.arange(len(off) - 1), np.diff(off))
    rows, at, hs = [], [], []
    for k in range(1, gram + 1):
        g = run_hashes(off, h, k)
        i = np.nonzero(inside(off, k)[: len(g)] & on[own[: len(g)]])[0]
        i = i[keep(g[i])]
        rows.append(own[i])
        at.append(i - off[own[i]])
        hs.append(g[i])
    return np.concatenate(rows), np.concatenate(at), np.concatenate(hs)

