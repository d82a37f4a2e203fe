"""Problem 9: items of varying length in containers, with as little unused space as possible.

Items longer than the largest container are cut into full pieces and a rest; nothing else is split. What matters for
packing is the histogram of sizes, which has at most ``capacity`` rows however many items there are. Best fit runs on
it, many equal containers at a time: a container opens with the largest size left in the bin size of least cost per
token it can fill, then takes the size that leaves least room, by the table of sums that the sizes left can reach.
At last each container is downsized to the least permitted length that holds its contents. Items find their places by
rank within their size, pre-counted per partition, and a look-up of the rank among the plan's ranges.

Cases: sizes 0 and null take no space and go by hash to the containers of the first kind (container 1 if there are none);
equal sizes are placed by id; ids that repeat are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LENGTHS = (256, 512, 1024, 2048)


def fill(room: int, left: np.ndarray, top: int) -> list[int]:
    """Sizes, largest first, that come as near to ``room`` as a bounded search finds."""
    best: list[int] = []
    gap = room
    sizes = np.nonzero(left[: room + 1])[0]
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return best
    # one item that fits exactly, else two, else the largest that fits and so on downward
    for first in sizes[::-1][:top]:
        rest = room - int(first)
        own = [int(first)]
        if rest:
            left[first] -= 1
            i = int(np.searchsorted(sizes, rest, "right")) - 1
            while rest and i >= 0:
                s = int(sizes[i])
                if s <= rest and left[s] > own[1:].count(s):
                    own.append(s)
                    rest -= s
                    i = min(i, int(np.searchsorted(sizes, rest, "right")) - 1)
                else:
                    i -= 1
            left[first] += 1
        if rest < gap:
            best, gap = own, rest
            if not gap:
                break
    return best


def plan(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int | None = None, top: int = 64) -> list[tuple[tuple[int, ...], int, int]]:
    """[(sizes in a container, its length, number of such containers)] for a histogram of sizes up to the largest length.

    ``overhead`` is what a container costs besides its length, in tokens; by default the largest length, so that
    containers stay few and small ones open only where nothing better is left. The work depends on the number of
    distinct sizes, not on the number of items.
    """
    cap = max(lengths)
    overhead = cap if overhead is None else overhead
    left = np.zeros(cap + 1, np.int64)
    for s, n in counts.items():
        if not 0 < s <= cap:
            raise ValueError(f"size {s} is not within 1..{cap}")
        left[s] += n
    out = []
    while True:
        have = np.nonzero(left)[0]
        if not len(have):
            return out
        big = int(have[-1])
        left[big] -= 1
        best: tuple[float, int, list[int]] | None = None
        for length in sorted(lengths, reverse=True):  # of equal cost the longest, which needs fewest containers
            if length < big:
                break
            inside = fill(length - big, left, top)
            total = big + sum(inside)
            least = min(x for x in lengths if x >= total)
            cost = (least + overhead) / total
            if best is None or cost < best[0] - 1e-12:
                best = (cost, least, inside)
            if total == length:
                break
        left[big] += 1
        _, length, inside = best
        sizes = (big, *inside)
        need = {s: sizes.count(s) for s in sizes}
        times = int(min(left[s] // n for s, n in need.items()))
        for s, n in need.items():
            left[s] -= n * times
        out.append((sizes, length, times))


def outline(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int | None = None) -> dict[str, float]:
    """Containers of a plan, their capacity in tokens, and the share of it left unused."""
    p = plan(counts, lengths, overhead)
    n, capacity, used = sum(t for _, _, t in p), sum(x * t for _, x, t in p), sum(s * c for s, c in counts.items())
    return {"n_containers": n, "capacity": capacity, "unused_share": 1 - used / capacity if capacity else 0.0}


def pieces(df: DataFrame, id_col: str, size: str, cap: int) -> DataFrame:
    """(id, piece, start, size): one piece an item, more only for items beyond ``cap``."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / cap), F.lit(1)) - 1
    p = df.select(F.col(id_col), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    return p.select(id_col, F.col("piece").cast("int").alias("piece"), (F.col("piece") * cap).alias("start"), F.least(F.col("_n") - F.col("piece") * cap, F.lit(cap)).cast("int").alias("size"))


def ranked(df: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """Adds ``rank`` from 0 within ``key``: rows are split by key and a hash, so no key is in one task as a whole."""
    d = df.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    n = d.groupBy(key, "_s").count()
    before = n.withColumn("_b", F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = F.row_number().over(Window.partitionBy(key, "_s").orderBy(*order)) - 1
    return d.withColumn("_r", local).join(before, [key, "_s"]).withColumn("rank", (F.col("_r") + F.col("_b")).cast("long")).drop("_s", "_r", "_b")


def histogram(items: DataFrame) -> dict[int, int]:
    """Pieces by size: at most as many rows as the largest length."""
    return {r["size"]: r["n"] for r in items.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}


def pack(df: DataFrame, id_col: str, size: str, lengths: tuple[int, ...] = LENGTHS, per_task: int = 1_000_000, overhead: int | None = None) -> DataFrame:
    """(id, piece, start, size, container, length): where each piece lies; ``overhead`` as in :func:`plan`."""
    cap = max(lengths)
    items = pieces(df, id_col, size, cap)
    counts = histogram(items)
    parts = max(64, -(-max(counts.values(), default=0) // per_task))  # rows of one size are ranked in so many parts
    rows, first = [], 1
    used = dict.fromkeys(counts, 0)
    for sizes, length, times in plan(counts, lengths, overhead):
        for s in set(sizes):
            n = sizes.count(s)
            rows.append((s, used[s], used[s] + n * times, first, n, length))
            used[s] += n * times
        first += times
    # a plan has some thousand ranges of ranks at most, whatever the number of items: looked up by binary search
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) | table[:, 1]
    kind = dict(items.dtypes)[id_col]

    def place(batches):
        for b in batches:
            size, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("size", "rank"))
            at = np.searchsorted(keys, (size << 44) | rank, "right") - 1
            container = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(container), pa.array(table[at, 5].astype(np.int32))], names=[id_col, "piece", "start", "size", "container", "length"])

    r = ranked(items.where("size > 0"), "size", [id_col, "piece"], parts).select(id_col, "piece", "start", "size", "rank")
    r = r.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, size int, container long, length int")
    n_first, length = (rows[0][2] - rows[0][1]) // rows[0][4] if rows else 1, rows[0][5] if rows else min(lengths)
    none = items.where("size = 0").select(id_col, "piece", "start", "size", (F.pmod(F.xxhash64(id_col), F.lit(n_first)) + 1).cast("long").alias("container"), F.lit(length).alias("length"))
    return r.unionByName(none)
