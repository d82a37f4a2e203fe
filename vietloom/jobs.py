"""The engine's steps as functions of paths: prepare, select, review, build, score. Each reads tables, writes tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import curate, ranking, weak
from .operators import evaluate as E
from .operators import review as R
from .sources import io


def prepare(spark: SparkSession, sources: list[tuple[str, str]], allowed: list[str], text_field: str, held_out: DataFrame, held_text: str, out: str, dataset: str) -> DataFrame:
    """Raw files of named sources to a curated corpus (id, dataset, original_source, input_text): cleaned, free of
    held-out texts, the first of equal ones kept in the sources' order. Returns counts by fate."""
    raw = None
    for i, (name, path) in enumerate(curate.check_sources(sources, allowed).items()):
        rows = io.read_rows(spark, path, [text_field]).select(F.col(text_field).cast("string").alias("input_text"))
        rows = rows.select(F.format_string(f"{i}:%020d", F.monotonically_increasing_id()).alias("raw_id"), F.lit(name).alias("original_source"), "input_text")
        raw = rows if raw is None else raw.unionByName(rows)
    f = curate.fates(raw, curate.protected_hashes(held_out, held_text), "raw_id", "original_source", "input_text", [n for n, _ in sources])
    kept = curate.numbered(f.where("fate = 'keep'").drop("input_text"), ["source_index", "raw_id"], "id", f"{dataset}_%06d")
    kept.select("id", F.lit(dataset).alias("dataset"), "original_source", F.col("clean").alias("input_text")).write.parquet(out)
    return curate.fate_counts(f, "original_source")


def select(candidates: DataFrame, sources: list[str], budget: int, bands: int, seed: int, out: str, pilot: int = 5) -> None:
    """A review manifest: ``budget`` rows shared out over sources in proportion and over confidence bands evenly."""
    c = candidates.where(F.col("model_a_confidence").isNotNull() & F.col("original_source").isin(*sources))
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("original_source"))
    q = ranking.largest_remainder(c.groupBy("original_source").agg(F.count("*").alias("n")).withColumn("place", place), "original_source", "n", "place", budget)
    q = q.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("band", F.col("band").cast("long"))
    q = q.select("original_source", "band", ranking.even_split(F.col("quota"), F.col("band"), bands).cast("long").alias("quota"))
    b = ranking.bands(c, ["original_source"], ["model_a_confidence", "id"], bands)
    ranking.stratified(b, ["original_source", "band"], q, "id", seed).withColumn("is_pilot", F.col("selection_rank") <= pilot).write.parquet(out)


def run(spark: SparkSession, manifest: str, ledger: str, namespace: tuple[str, str, str], runner: Callable[[], R.Runner], size: int = 15) -> int:
    """Reviews what the ledger lacks of a manifest; returns the number of batches asked for."""
    return R.review(R.Ledger(spark, ledger), spark.read.parquet(manifest), "id", namespace, runner, size)


def build(spark: SparkSession, manifest: str, ledger: str, namespace: tuple[str, str, str], held_out: DataFrame, held_text: str, out: str, max_edit: float = 0.8) -> DataFrame:
    """Weak labels from the latest results of a namespace; returns rows by reason."""
    r = R.Ledger(spark, ledger, readonly=True).results()
    r = r.where(" and ".join(f"{k} = '{v}'" for k, v in zip(R.L.NAMESPACE, namespace, strict=True))).select(F.col("sample_id").alias("id"), "decision", "corrected_text")
    x = weak.reasons(spark.read.parquet(manifest).join(r, "id", "left").withColumn("pos", F.col("id")), curate.protected_hashes(held_out, held_text), max_edit=max_edit)
    x.where("reason = 'accepted'").drop("pos", "reason").write.parquet(out)
    return x.groupBy("reason").agg(F.count("*").alias("n"))


def score(predictions: DataFrame, out: str, title: str = "Scores") -> DataFrame:
    """Metrics by model of predictions (id, model, input_text, target_text, prediction_text), written as a report."""
    m = E.ranking(E.metrics(E.row_stats(predictions), ["model"])).orderBy("rank")
    io.write_report(m, out, title)
    return m
