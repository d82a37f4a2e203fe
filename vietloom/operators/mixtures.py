"""Epoch mixtures of gold and pseudo labels with balanced exposure.

One hash permutation cut into blocks stands for "unseen first": epoch e takes block e, and where a permutation runs
out the next round follows, so usage counts never differ by more than one. Only ids are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranking import hash_order, rank_within


def epochs(ids: DataFrame, id_col: str, per_epoch: int, count: int, seed: int, refill: bool = False) -> DataFrame:
    """(epoch, id): ``count`` epochs of ``per_epoch`` ids each; an id repeats only after all others were used.

    Round r of the permutation holds slots r*n .. r*n + n - 1 of the endless sequence; an epoch that straddles two
    rounds would meet an id twice only if it were longer than the pool, which is refused unless ``refill`` lets epochs
    run through several rounds. An empty pool gives no rows.
    """
    r = rank_within(ids.select(F.col(id_col).alias("id")).distinct().withColumn("_h", hash_order(seed, "id")), [], ["_h", "id"], "rn")
    first = r.select("rn_n").first()
    n = first[0] if first else 0
    if 0 < n < per_epoch and not refill:
        raise ValueError("the pool must hold a full epoch")
    rounds = -(-count * per_epoch // max(n, 1))
    slot = F.col("round") * n + F.col("rn") - 1
    x = r.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")))).withColumn("epoch", F.floor(slot / per_epoch))
    return x.where(F.col("epoch") < count).select("epoch", "id")


def share(ids: DataFrame, id_col: str, parts: int = 2, of: int = 5) -> int:
    """The size of an epoch as a share of the pool, rounded up."""
    return max(1, -(-ids.select(id_col).distinct().count() * parts // of))


def coverage_epochs(ids: DataFrame, id_col: str, per_epoch: int, seed: int) -> DataFrame:
    """As many epochs as cover every id once; only the last tops up with ids used before."""
    n = ids.select(id_col).distinct().count()
    return epochs(ids, id_col, per_epoch, -(-n // per_epoch), seed)


def least_used(usage: DataFrame, count: int, order: Column) -> DataFrame:
    """``count`` ids of the lowest exposure, ``order`` inside a level; by ranks, as ``count`` may grow with the pool."""
    r = rank_within(usage.withColumn("_h", order), [], ["used", "_h", "id"], "_rn")
    return r.where(F.col("_rn") <= count).drop("_h", "_rn", "_rn_n")


def factorial(initial: DataFrame, expanded: DataFrame, id_col: str, per_epoch: int, count: int, seed: int) -> DataFrame:
    """(arm, epoch, id): the small arm draws from the initial pool; the large arm takes the same ids while they are
    fresh to it and replaces repeats by its least used others. State is ids and counts, written after each epoch."""
    pool = expanded.select(F.col(id_col).alias("id")).distinct()
    state = pool.join(initial.select(F.col(id_col).alias("id")).distinct().withColumn("initial", F.lit(True)), "id", "left").select("id", F.coalesce("initial", F.lit(False)).alias("initial"), F.lit(0).alias("small"), F.lit(0).alias("large"))
    state, out = written(state, "usage"), []
    for e in range(count):
        order = F.sha2(F.concat_ws(":", F.lit(f"{seed}:{e}"), F.col("id")), 256)
        small = written(least_used(state.where("initial").withColumn("used", F.col("small")), per_epoch, order).select("id", "large"), "small")
        shared = small.where("large = 0").select("id")
        need = per_epoch - shared.count()
        rest = state.join(shared, "id", "left_anti").withColumn("used", F.col("large"))
        large = written(shared.unionByName(least_used(rest, need, order).select("id")), "large")
        out += [small.select(F.lit("small").alias("arm"), F.lit(e).cast("long").alias("epoch"), "id"), large.select(F.lit("large").alias("arm"), F.lit(e).cast("long").alias("epoch"), "id")]
        mark = lambda d, c: d.select("id", F.lit(1).alias(c))
        state = written(state.join(mark(small, "s"), "id", "left").join(mark(large, "l"), "id", "left").select("id", "initial", (F.col("small") + F.coalesce("s", F.lit(0))).alias("small"), (F.col("large") + F.coalesce("l", F.lit(0))).alias("large")), "usage")
    both = out[0]
    for d in out[1:]:
        both = both.unionByName(d)
    return both


def slots(gold: DataFrame, pseudo_epochs: DataFrame, seed: int) -> DataFrame:
    """(epoch, slot, id, label_source): gold ids and pseudo positions of each epoch shuffled together.

    Pseudo rows are placed by their position, not their id, so arms that share an epoch share its layout.
    """
    numbers = sorted(r[0] for r in pseudo_epochs.select("epoch").distinct().collect())  # a training run's epochs, not its rows
    each = F.array(*[F.lit(e).cast("long") for e in numbers]).cast("array<long>")
    g = gold.select(F.explode(each).alias("epoch"), "id", F.lit("gold").alias("label_source"), F.col("id").alias("place"))
    p = rank_within(pseudo_epochs, ["epoch"], ["id"], "place").select("epoch", "id", F.lit("pseudo").alias("label_source"), F.col("place").cast("string").alias("place"))
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), "label_source", "place"), 256)
    x = rank_within(g.unionByName(p).withColumn("_h", h), ["epoch"], ["_h", "id"], "slot")
    return x.select("epoch", (F.col("slot") - 1).alias("slot"), "id", "label_source")


def exposure(ep: DataFrame, pool: DataFrame, id_col: str) -> DataFrame:
    """How many ids of the pool were used how often, 0 included."""
    used = ep.groupBy("id").agg(F.count("*").alias("times"))
    x = pool.select(F.col(id_col).alias("id")).distinct().join(used, "id", "left")
    return x.groupBy(F.coalesce("times", F.lit(0)).alias("times")).agg(F.count("*").alias("n_ids"))


def validated(ep: DataFrame, pool: DataFrame, id_col: str, per_epoch: int) -> DataFrame:
    """One row of violations: epochs of another size, ids twice in an epoch, ids outside the pool, ids never used."""
    per = ep.groupBy("epoch").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    p = pool.select(F.col(id_col).alias("id")).distinct()
    one = lambda d: d.withColumn("_one", F.lit(1))
    a = one(per.agg(F.count("*").alias("n_epochs"), F.count_if(F.col("n") != per_epoch).alias("wrong_size"), F.count_if(F.col("n") != F.col("d")).alias("with_repeats")))
    b = one(ep.join(p, "id", "left_anti").agg(F.count("*").alias("foreign_ids")))
    c = one(p.join(ep, "id", "left_anti").agg(F.count("*").alias("unused_ids")))
    return a.join(b, "_one").join(c, "_one").drop("_one")


def manifest(ep: DataFrame, seed: int) -> DataFrame:
    """A row per epoch: its seed, pseudo ids and distinct ones, and a digest of the ids that does not hang on their order
    (the sum of the first 32 bits of their MD5, so it is made with map-side sums)."""
    h = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")
    return ep.groupBy("epoch").agg(F.count("*").alias("pseudo_count"), F.countDistinct("id").alias("n_distinct"), F.sum(h).alias("digest")).select("epoch", (F.col("epoch") + seed).alias("epoch_seed"), "pseudo_count", "n_distinct", "digest")


def manifest_faults(m: DataFrame, seed: int, gold_count: int) -> DataFrame:
    """(epoch, fault): epochs with another seed, with ids twice, or not one pseudo id to each gold id."""
    rules = [(F.col("epoch_seed") != F.col("epoch") + seed, "seed"), (F.col("n_distinct") != F.col("pseudo_count"), "repeated_ids"), (F.col("pseudo_count") != gold_count, "not_one_to_one")]
    return m.select("epoch", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))).alias("fault"))


def ordered_digest(df: DataFrame, id_col: str, order: str, block: int = 10_000) -> DataFrame:
    """SHA-256 of the ids in order: of blocks first, then of the block digests, so no task holds all ids."""
    r = rank_within(df.select(F.col(id_col).alias("id"), F.col(order).alias("o")), [], ["o", "id"], "rn")
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]), ",")
    b = r.groupBy(F.floor((F.col("rn") - 1) / block).alias("block")).agg(F.sha2(join(F.struct(F.col("rn").alias("k"), F.col("id").cast("string").alias("v"))), 256).alias("h"), F.count("*").alias("n"))
    return b.agg(F.sum("n").alias("n"), F.sha2(join(F.struct(F.col("block").alias("k"), F.col("h").alias("v"))), 256).alias("digest"))
