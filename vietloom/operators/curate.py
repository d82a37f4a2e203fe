"""Cleaning, leakage guards, first-source de-duplication and validation of curated data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..session import written
from .ranking import rank_within


def protected_hashes(df: DataFrame, text: str) -> DataFrame:
    """Distinct SHA-256 of cleaned texts that must not be trained on."""
    return df.select(F.sha2(clean_text(text), 256).alias("sha256")).where("sha256 is not null").distinct()


def fates(df: DataFrame, protected: DataFrame, id_col: str, source: str, text: str, sources: list[str]) -> DataFrame:
    """Fate of each raw record, first match wins: empty, protected_overlap, duplicate, keep.

    The first record of a text over (source order, id) is kept: found by a min aggregate with map-side combine, not by
    sorting the copies, so a text that a third of all rows share is a row per task. Unknown sources come last.
    """
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(source)), F.lit(0))
    rank = F.when(place > 0, place).otherwise(len(sources) + 1)
    x = df.withColumn("clean", clean_text(text)).withColumn("source_index", rank)
    x = written(x.withColumn("_hash", F.sha2("clean", 256)), "cleaned")  # cleaned once, read by both sides below
    p = protected.select(F.col("sha256").alias("_hash"), F.lit(True).alias("_protected"))
    some = x.where("_hash is not null").withColumn("_key", F.struct(F.col("source_index").alias("s"), F.col(id_col).alias("i")))
    firsts = some.groupBy("_hash").agg(F.min("_key").alias("_first")).join(p, "_hash", "left")
    fate = F.when(F.col("_protected"), "protected_overlap").when(F.col("_key") > F.col("_first"), "duplicate").otherwise("keep")
    told = some.join(firsts, "_hash").select(*df.columns, "clean", "source_index", fate.alias("fate"))
    blank = x.where("_hash is null").select(*df.columns, "clean", "source_index", F.lit("empty").alias("fate"))  # these meet no join
    return told.unionByName(blank)


def fate_counts(f: DataFrame, source: str) -> DataFrame:
    return f.groupBy(source).agg(F.count("*").alias("raw"), *[F.count_if(F.col("fate") == x).alias(x) for x in ("empty", "protected_overlap", "duplicate", "keep")])


def numbered(df: DataFrame, order: list[str], name: str, pattern: str) -> DataFrame:
    """Dense ids over a global order, without a single-task window."""
    return rank_within(df, [], order, "_n").withColumn(name, F.format_string(pattern, "_n")).drop("_n", "_n_n")


def pairs(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs with both sides cleaned; a blank side drops the pair."""
    return df.withColumn(left, clean_text(left)).withColumn(right, clean_text(right)).where(F.col(left).isNotNull() & F.col(right).isNotNull())


def zero_filled(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows per allowed value, 0 where there is none."""
    want = df.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    return want.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def validation_report(gold: DataFrame, corpus: DataFrame, sources: list[str], source: str) -> DataFrame:
    """One row of violation counts; all zero means valid."""
    g = gold.withColumn("_i", clean_text("input_text")).withColumn("_t", clean_text("target_text"))
    c = corpus.withColumn("_i", clean_text("input_text"))
    a = g.agg(
        F.count_if(~F.col("split").isin("train", "dev", "test") | F.col("split").isNull()).alias("bad_split"),
        F.count_if(F.col("label_source").isNull() | (F.col("label_source") != "human")).alias("bad_label_source"),
        F.count_if(~F.col("input_text").eqNullSafe(F.col("_i")) | ~F.col("target_text").eqNullSafe(F.col("_t"))).alias("gold_not_clean"),
    )
    b = c.agg(F.count_if(F.col(source).isNull() | ~F.col(source).isin(*sources)).alias("bad_source"), F.count_if(~F.col("input_text").eqNullSafe(F.col("_i")) | F.col("input_text").isNull()).alias("corpus_not_clean"))
    ids = gold.select("id").unionByName(corpus.select("id")).groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("duplicate_ids"))
    texts = c.where("_i is not null").groupBy("_i").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_texts"))
    held = g.where("split in ('dev', 'test') and _i is not null").select("_i").distinct()
    overlap = c.join(held, "_i", "left_semi").agg(F.count("*").alias("protected_overlap"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    out = one(a)
    for d in (b, ids, texts, overlap):  # each is a single row
        out = out.join(one(d), "_one")
    return out.drop("_one")


def first_failing(*checks: tuple[Column, str], otherwise: str) -> Column:
    """The reason of the first check that holds."""
    c = F.when(checks[0][0], checks[0][1])
    for cond, reason in checks[1:]:
        c = c.when(cond, reason)
    return c.otherwise(otherwise)


def consecutive_distinct(df: DataFrame, key: str, order: list[str], values: list[str], keep: int) -> DataFrame:
    """Per key the newest ``keep`` rows that differ from the one before them, newest first.

    The row before is found by rank, in a join on (key, rank), so a key with a third of all rows is spread; the last
    window sees ``keep`` rows of a key from each task.
    """
    r = rank_within(df, [key], order, "_r").drop("_r_n")
    before = r.select(F.col(key).alias("_k"), (F.col("_r") + 1).alias("_p"), *[F.col(v).alias(f"_b_{v}") for v in values])
    same = F.col("_p").isNotNull()
    for v in values:
        same &= F.col(f"_b_{v}").eqNullSafe(F.col(v))
    x = r.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_p")), "left").where(~same)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("_r").desc()))
    return x.select(*df.columns, "_r").withColumn("place", place).where(F.col("place") <= keep).drop("_r")


def check_sources(specs: list[tuple[str, str]], allowed: list[str]) -> dict[str, str]:
    """(name, path) of raw sources as a dictionary: each allowed name once, no other; else an error."""
    names = [n for n, _ in specs]
    if sorted(names) != sorted(allowed):
        raise ValueError(f"sources must be exactly {allowed}, each once")
    return dict(specs)
