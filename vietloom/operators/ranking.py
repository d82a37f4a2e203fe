"""Ranks, quotas and samples that hold at any size: no stratum is ever sorted in one task as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

_LOCAL = (1 << 33) - 1


def rank_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank by ``order`` within ``keys``, and ``<name>_n``, the number of rows of the key.

    Rows are range-partitioned by (keys, order), so even a key with a third of all rows is spread; each partition
    counts its rows per key, and offsets (one row per partition and key) are summed up and joined back. The sorted
    rows are written once, so both passes see the same order whatever executors are lost.
    """
    cols = df.columns
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    s = df.repartitionByRange(*[F.col(k) for k in keys], *o).sortWithinPartitions(*keys, *o) if keys else df.repartitionByRange(*o).sortWithinPartitions(*o)
    s = s.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(_LOCAL))
    s = written(s, "rank")
    c = s.groupBy(*keys, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn(f"{name}_n", F.sum("_c").over(Window.partitionBy(*keys)))
    on = F.col("s._p") == F.col("c._p")
    for k in keys:
        on &= F.col(f"s.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    j = s.alias("s").join(F.broadcast(c.alias("c")) if not keys else c.alias("c"), on)
    return j.select(*[F.col(f"s.`{x}`") for x in cols], (F.col("s._i") - F.col("c._m") + F.col("c._o") + 1).alias(name), F.col(f"c.{name}_n"))


def bands(df: DataFrame, by: list[str], order: list[str], k: int, name: str = "band") -> DataFrame:
    """Band ``min(k - 1, (rank - 1) * k div n)`` of each row by ``order`` within ``by``."""
    r = rank_within(df, by, order, "_r")
    return r.withColumn(name, F.least(F.lit(k - 1), F.floor((F.col("_r") - 1) * k / F.col("_r_n"))).cast("long")).drop("_r", "_r_n")


def largest_remainder(counts: DataFrame, key: str, n: str, order: str, budget: int) -> DataFrame:
    """(key, n, quota): ``budget`` shared in proportion, floors first, then by largest remainder, ties by ``order``.

    ``counts`` has one row per source; capacity never binds as a share of the whole is at most the whole.
    """
    w = Window.partitionBy()
    e = F.lit(float(budget)) * F.col(n) / F.sum(n).over(w)
    x = counts.withColumn("_e", e).withColumn("_f", F.floor("_e"))
    x = x.withColumn("_left", F.lit(budget) - F.sum("_f").over(w)).withColumn("_k", F.row_number().over(w.orderBy((F.col("_e") - F.col("_f")).desc(), order)))
    return x.select(key, n, (F.col("_f") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def even_split(quota: Column, band: Column, k: int) -> Column:
    """The share of a quota that band number ``band`` of ``k`` gets; first bands take the remainder."""
    return F.expr("0").cast("long") + F.floor(quota / k) + F.when(band < quota % k, 1).otherwise(0)


def hash_order(seed: int, *parts: str) -> Column:
    """A seeded order that depends on the row alone, not on partitions."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]), 256)


def short_strata(df: DataFrame, strata: list[str], quota: DataFrame) -> DataFrame:
    """Strata with fewer rows than their quota, and how many they lack."""
    n = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    x = quota.join(n, strata, "left").withColumn("missing", F.col("quota") - F.coalesce("_n", F.lit(0)))
    return x.where("missing > 0").select(*strata, "missing")


def stratified(df: DataFrame, strata: list[str], quota: DataFrame, id_col: str, seed: int, strict: bool = False) -> DataFrame:
    """The first ``quota`` rows of each stratum in seeded hash order, with their rank; ``strict`` refuses short strata."""
    if strict and (short := short_strata(df, strata, quota).limit(5).collect()):
        raise ValueError(f"strata with too few rows: {[r.asDict() for r in short]}")
    h = rank_within(df.withColumn("_h", hash_order(seed, *strata, id_col)), strata, ["_h", id_col], "selection_rank")
    return h.join(quota, strata).where(F.col("selection_rank") <= F.col("quota")).drop("_h", "selection_rank_n")


def thinned(df: DataFrame, h: str, n: int) -> DataFrame:
    """Rows among which are the ``n`` of least ``h`` (a SHA-256 in hex), and about twice as many at most.

    A bound on the hash is taken from the number of rows, so that a top-n afterwards does not bring ``n`` rows of every
    task together; should the bound let too few through, all rows stay.
    """
    total = df.count()
    if total <= 4 * n + 1000:
        return df
    below = df.where(F.col(h) < f"{int((2 * n + 200) / total * 2**60):015x}")
    return below if below.count() >= n else df


def sample_n(df: DataFrame, id_col: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in seeded hash order: a distributed top-n over rows thinned by their hash."""
    x = df.withColumn("_h", hash_order(seed, id_col))
    return thinned(x, "_h", n).orderBy("_h", id_col).limit(n).drop("_h")


def complement(df: DataFrame, prior: DataFrame, id_col: str, order: str) -> DataFrame:
    """Rows whose id is not in ``prior``, ranked again 1..n in their order."""
    return rank_within(df.join(prior.select(id_col), id_col, "left_anti"), [], [order], "selection_rank").drop("selection_rank_n")
