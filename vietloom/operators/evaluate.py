"""Metrics of normalisation: edits, error reduction, categories, contingency, bootstrap, ranking, training curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edits import let, token_edits, token_levenshtein, tokens


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: for each distinct value the lesser count."""
    count = lambda xs, v: F.size(F.filter(xs, lambda y: y == v))
    pair = F.struct(a.alias("a"), b.alias("b"))
    return let(pair, lambda p: F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda acc, v: acc + F.least(count(p["a"], v), count(p["b"], v)))).cast("long")


def row_stats(df: DataFrame) -> DataFrame:
    """Sufficient statistics per (id, model): edits of gold and prediction, those in common, token errors, exactness.

    ``df`` has id, model, input_text, target_text, prediction_text. Computed once; everything else sums integers.
    """
    i, t, p = tokens(F.col("input_text")), tokens(F.col("target_text")), tokens(F.col("prediction_text"))
    # equal texts have no edits: only pairs that differ leave the JVM
    none = F.array().cast("array<struct<src:string,tgt:string>>")
    edits = lambda a, b: F.when(F.col(a) == F.col(b), none).otherwise(token_edits(a, F.when(F.col(a) != F.col(b), F.col(b))))
    x = df.withColumn("_g", edits("input_text", "target_text")).withColumn("_p", edits("input_text", "prediction_text"))
    return x.select(
        "id", "model", F.size("_g").cast("long").alias("gold_edits"), F.size("_p").cast("long").alias("predicted_edits"), multiset_common(F.col("_g"), F.col("_p")).alias("correct_edits"),
        token_levenshtein(i, t).alias("lai_token_errors"), token_levenshtein(p, t).alias("system_token_errors"), (F.col("prediction_text") == F.col("target_text")).cast("long").alias("exact"),
    )


def error_stats(df: DataFrame) -> DataFrame:
    """The part of :func:`row_stats` that is native throughout."""
    t = tokens(F.col("target_text"))
    return df.select("id", "model", token_levenshtein(tokens(F.col("input_text")), t).alias("lai_token_errors"), token_levenshtein(tokens(F.col("prediction_text")), t).alias("system_token_errors"), (F.col("prediction_text") == F.col("target_text")).cast("long").alias("exact"))


def err(lai: Column, system: Column) -> Column:
    return ratio(lai - system, lai)


def metrics(stats: DataFrame, by: list[str]) -> DataFrame:
    """Micro precision, recall, F1, error reduction and exact match of summed statistics."""
    names = ["gold_edits", "predicted_edits", "correct_edits", "lai_token_errors", "system_token_errors"]
    s = stats.groupBy(*by).agg(F.count("*").alias("sample_count"), *[F.sum(n).alias(n) for n in names], F.sum("exact").alias("n_exact"))
    p, r = ratio(F.col("correct_edits"), F.col("predicted_edits")), ratio(F.col("correct_edits"), F.col("gold_edits"))
    return s.withColumn("precision", p).withColumn("recall", r).select(
        *by, "sample_count", *names, err(F.col("lai_token_errors"), F.col("system_token_errors")).alias("ERR"), "precision", "recall",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), ratio(F.col("n_exact"), F.col("sample_count")).alias("exact_match"))


def category(i: Column, t: Column, p: Column, noise: Column | None = None) -> Column:
    """First matching error category."""
    n = lambda c: F.size(tokens(c))
    c = F.when(p == t, "correct").when(i == t, "over-normalization").when(p == i, "missed").when(n(i) < n(t), "one-to-many").when(n(i) > n(t), "many-to-one")
    return (c.when(noise, "suspected-weak-label-noise") if noise is not None else c).otherwise("wrong")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact matches of model ``a`` against ``b`` over the same ids: wins, losses, both, neither."""
    x = df.where(F.col("model").isin(a, b)).groupBy("id").agg(F.max(F.when(F.col("model") == a, F.col("exact"))).alias("a"), F.max(F.when(F.col("model") == b, F.col("exact"))).alias("b"))
    c = lambda p, q: F.count_if((F.col("a") == p) & (F.col("b") == q))
    return x.where("a is not null and b is not null").agg(c(1, 0).alias("win"), c(0, 1).alias("loss"), c(1, 1).alias("both_right"), c(0, 0).alias("both_wrong"))


#: Upper ends of the Poisson(1) distribution: P(weight <= k) for k = 0, 1, ...
POISSON = [sum(1 / math.factorial(j) for j in range(k + 1)) / math.e for k in range(10)]


#: A prime below 2^31, so that a product of two residues fits 64 bits in every engine.
PRIME = 2**31 - 1


def drawn(df: DataFrame, replicate: str, row: str) -> DataFrame:
    """Adds ``w``, how often a bootstrap replicate takes a row: Poisson(1) from a few squarings modulo a prime of both
    numbers, so all arms and engines draw alike and a draw costs no text function. ``row`` is :func:`row_number_of`.
    Each step is a column, so that compiled code makes it once."""
    r, i = F.col(row), F.col(replicate) + 1
    x = df.withColumn("_a", (r + i * 1664525) % PRIME).withColumn("_a", (F.col("_a") * F.col("_a") + r) % PRIME)
    x = x.withColumn("_a", (F.col("_a") * F.col("_a") + i) % PRIME).withColumn("_a", (F.col("_a") * 48271) % PRIME)
    w = F.lit(len(POISSON))
    for k in reversed(range(len(POISSON))):
        w = F.when(F.col("_a") < int(POISSON[k] * PRIME), k).otherwise(w)
    return x.withColumn("w", w).drop("_a")


def row_number_of(id_col: Column, seed: int) -> Column:
    """A number below :data:`PRIME` for an id, from its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string"))), 1, 8), 16, 10).cast("long") % PRIME


def f1(gold: Column, predicted: Column, correct: Column) -> Column:
    p, r = ratio(correct, predicted), ratio(correct, gold)
    return ratio(2 * p * r, p + r)


def bootstrap(stats: DataFrame, a: str, b: str, replicates: int, seed: int) -> DataFrame:
    """Paired bootstrap of the differences in F1 and in error reduction, ``a`` minus ``b``, from the same draws: one row
    (metric, replicates, mean, low, high) for each metric that ``stats`` has the sums for, with the 95 % interval.

    Each row counts a Poisson(1) number of times in each replicate. Texts are reduced to integers per row once; the
    replicates of a row are made beside it and summed on the map side, so a replicate is one row per task. The last
    window sorts one row per replicate.
    """
    both = [c for c in ("gold_edits", "lai_token_errors") if c in stats.columns]
    arms = [c for c in ("predicted_edits", "correct_edits", "system_token_errors") if c in stats.columns]
    names = [*both, *[f"{c}_{k}" for k in "ab" for c in arms]]
    x = stats.where(F.col("model").isin(a, b)).groupBy("id").agg(*[F.max(c).alias(c) for c in both], *[F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{k}") for m, k in ((a, "a"), (b, "b")) for c in arms])
    x = x.select(row_number_of(F.col("id"), seed).alias("row"), *names).repartition(int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: on all cores
    each = x.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("rep"))
    each = drawn(each, "rep", "row")
    s = each.groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
    deltas = []
    if "correct_edits" in arms:
        f = lambda k: f1(F.col("gold_edits"), F.col(f"predicted_edits_{k}"), F.col(f"correct_edits_{k}"))
        deltas.append(F.struct(F.lit("f1").alias("metric"), (f("a") - f("b")).alias("delta")))
    if "system_token_errors" in arms:
        e = lambda k: err(F.col("lai_token_errors"), F.col(f"system_token_errors_{k}"))
        deltas.append(F.struct(F.lit("ERR").alias("metric"), (e("a") - e("b")).alias("delta")))
    r = s.select("rep", F.explode(F.array(*deltas)).alias("x")).select("rep", "x.*")
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("metric").orderBy("delta", "rep")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("metric")))
    at = lambda q: F.max(F.when(F.col("k") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col("delta")))
    return r.groupBy("metric").agg(F.count("*").alias("replicates"), F.avg("delta").alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))


def ranking(m: DataFrame, first: str = "model_a") -> DataFrame:
    """Models by error reduction, F1, exact match, and ``first`` before others."""
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ERR"), F.desc("f1"), F.desc("exact_match"), F.desc(F.col("model") == first))).cast("long"))


def two_model_rule(f1_a: Column, f1_b: Column, err_a: Column, err_b: Column, lower: bool = False) -> Column:
    """struct(winner, criterion): higher F1, then error reduction in the frozen direction, then the first model."""
    row = lambda w, c: F.struct(w.alias("winner"), F.lit(c).alias("criterion"))
    pick = lambda c: F.when(c, "model_a").otherwise("model_b")
    return F.when(f1_a != f1_b, row(pick(f1_a > f1_b), "higher_f1")).when(err_a != err_b, row(pick(err_a < err_b if lower else err_a > err_b), "lower_ERR" if lower else "higher_ERR")).otherwise(row(F.lit("model_a"), "model_a"))


def early_stopping(df: DataFrame, key: str, epoch: str, loss: str, patience: int, min_epochs: int, min_delta: float) -> DataFrame:
    """(key, best_epoch, stop_epoch): running best with a margin, stop after ``patience`` epochs without one.

    Sequential by nature: one fold over a key's epochs, whose number is bounded by the training run.
    """
    run = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(loss).alias("l"))))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def step(acc, x):
        better = x["l"] < acc["best"] - min_delta
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        stop = F.when((bad >= patience) & (x["e"] >= min_epochs), x["e"].cast("long"))
        nxt = F.struct(F.when(better, x["l"]).otherwise(acc["best"]).alias("best"), F.when(better, x["e"].cast("long")).otherwise(acc["at"]).alias("at"), bad.alias("bad"), stop.alias("stop"))
        return F.when(acc["stop"].isNotNull(), acc).otherwise(nxt)

    return df.groupBy(key).agg(F.aggregate(run, zero, step).alias("x"), F.max(epoch).cast("long").alias("last")).select(key, F.col("x.at").alias("best_epoch"), F.coalesce("x.stop", "last").alias("stop_epoch"))


def best_at_horizon(df: DataFrame, key: str, epoch: str, loss: str, horizon: int) -> DataFrame:
    """The epoch of least loss up to the horizon, the first of equals."""
    return df.where(F.col(epoch) <= horizon).groupBy(key).agg(F.min(F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e"))).alias("x")).select(key, F.col("x.e").cast("long").alias("epoch"), F.col("x.l").alias("loss"))


def factorial_effects(df: DataFrame) -> DataFrame:
    """Means of the four cells (size S / L, horizon 3 / 8), simple effects and interaction."""
    m = lambda s, h: F.avg(F.when((F.col("size") == s) & (F.col("horizon") == h), F.col("value")))
    x = df.agg(m("S", 3).alias("S3"), m("S", 8).alias("S8"), m("L", 3).alias("L3"), m("L", 8).alias("L8"))
    return x.select("*", (F.col("L3") - F.col("S3")).alias("effect_3"), (F.col("L8") - F.col("S8")).alias("effect_8"), ((F.col("L8") - F.col("L3")) - (F.col("S8") - F.col("S3"))).alias("interaction"))


def three_way(df: DataFrame, models: tuple[str, str, str] = ("model_a", "model_b", "model_c")) -> DataFrame:
    """A row per id: the three predictions, their categories, and whether the last model wins, loses or ties by exactness."""
    a, b, c = models
    x = df.withColumn("category", category(F.col("input_text"), F.col("target_text"), F.col("prediction_text")))
    pick = lambda m, v: F.max(F.when(F.col("model") == m, F.col(v)))
    x = x.groupBy("id", "input_text", "target_text").agg(*[pick(m, v).alias(f"{m}_{n}") for m in models for v, n in (("prediction_text", "prediction"), ("category", "category"))])
    right = lambda m: (F.col(f"{m}_prediction") == F.col("target_text")).cast("int")
    versus = lambda m: F.when(right(c) > right(m), c).when(right(c) < right(m), m).otherwise("tie").alias(f"{c}_vs_{m[-1]}")
    return x.select("*", versus(a), versus(b))
