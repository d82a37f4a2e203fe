"""Weak labels: the cascade that accepts or drops reviewed rows, and checks of the union of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import char_edit_ratio
from ..functions.text import clean_text


def is_artifact(t: Column) -> Column:
    return t.startswith("{") | t.startswith("[") | t.startswith("```") | t.contains('"decision"')


def reasons(rows: DataFrame, protected: DataFrame, low: float = 0.5, high: float = 2.0, max_edit: float | None = 0.8) -> DataFrame:
    """Adds ``target_text`` and ``reason`` (accepted, or the first check that fails).

    ``rows`` has pos, input_text, candidate_text, decision, corrected_text. A repeated input is a duplicate only after
    a row that was accepted: the least position among rows that pass all other checks decides, found by an aggregate.
    """
    target = clean_text(F.when(F.col("decision") == "KEEP", F.col("candidate_text")).otherwise(F.col("corrected_text")))
    x = rows.withColumn("target_text", target).withColumn("_h", F.sha2(clean_text("input_text"), 256))
    x = x.join(protected.select(F.col("sha256").alias("_h"), F.lit(True).alias("_protected")), "_h", "left")
    early = (
        F.when(F.col("decision").isNull(), "missing_valid_review").when(F.col("decision") == "REJECT", "llm_reject").when(F.col("target_text").isNull(), "empty_target")
        .when(is_artifact(F.col("target_text")), "response_artifact").when(F.col("_protected"), "protected_overlap")
    )
    share = F.length("target_text") / F.greatest(F.lit(1), F.length("input_text"))
    late = F.when((share < low) | (share > high), "length_ratio")
    if max_edit is not None:
        x = x.withColumn("_edit", char_edit_ratio("input_text", "target_text"))
        late = late.when(F.col("_edit") > max_edit, "edit_ratio")
    x = x.withColumn("_early", early).withColumn("_late", late)
    first = x.where("_early is null and _late is null").groupBy("input_text").agg(F.min("pos").alias("_first"))
    x = x.join(first, "input_text", "left")
    reason = F.coalesce("_early", F.when(F.col("_first") < F.col("pos"), "duplicate_input"), "_late", F.lit("accepted"))
    return x.withColumn("reason", reason).drop("_h", "_protected", "_early", "_late", "_first", "_edit")


def prefix_equal(prior: DataFrame, both: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows of ``prior`` and how many of them stand unchanged at the same position in ``both``."""
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return prior.alias("a").join(both.alias("b"), F.col("a.pos") == F.col("b.pos"), "left").agg(F.count("*").alias("n_prior"), F.count_if(same).alias("n_same"))
