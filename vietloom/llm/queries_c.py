"""Queries of problems 3, 4, 6 and 7: defective pairs, garbled text, abuse, private data."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import composed
from ..plans.common import bucket, bucket_sql
from . import mojibake, pairs, pii, toxicity
from .common import read, spread

TOXIC_FROM = 0.25
#: A sign that clean text does not hold, in the notation that both engines read.
CLEAN = "[^" + re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", mojibake._CLEAN) + "]"


def _corpus(spark, d):
    return spread(read(spark, d, "corpus").select("id", "original_source", "input_text"))


def _pairs(spark, d):
    """(id, answer_field, input_text, answer): both kinds of answers."""
    c = read(spark, d, "candidates").select("id", "input_text", "candidate_text").distinct()
    e = read(spark, d, "review_results").where("decision = 'EDIT'").select(F.col("sample_id").alias("id"), "corrected_text").distinct()
    one = c.select("id", "input_text").dropDuplicates(["id"])
    edits = e.join(one, "id", "left").select("id", F.lit("corrected_text").alias("answer_field"), "input_text", F.col("corrected_text").alias("answer"))
    return c.select("id", F.lit("candidate_text").alias("answer_field"), "input_text", F.col("candidate_text").alias("answer")).unionByName(edits)


def p3_found(spark, d):
    model = pairs.train(pairs.sample(read(spark, d, "candidates"), "input_text", "candidate_text"), spark)
    return pairs.flag(_pairs(spark, d), ["id", "answer_field"], "input_text", "answer", model).distinct()


def p3_counts(spark, d):
    """Defects per answer field and kind."""
    return p3_found(spark, d).groupBy("answer_field", "defect").agg(F.count("*").alias("n"))


def p4_found(spark, d):
    return mojibake.restore(_corpus(spark, d), "id", "input_text", "original_source").where("garbled").select("id").distinct()


def p4_restored(spark, d):
    """Every record with its text, restored where that could be done."""
    c = _corpus(spark, d)
    r = mojibake.restore(c, "id", "input_text", "original_source").where("garbled").dropDuplicates(["id"])
    return c.join(r, "id", "left").select("id", "original_source", F.coalesce("garbled", F.lit(False)).alias("garbled"), F.coalesce("restored", "input_text").alias("text"))


def p4_rates(spark, d):
    return p4_restored(spark, d).groupBy("original_source").agg(F.count("*").alias("n_records"), F.count_if("garbled").alias("n_garbled"))


def p4_roundtrip(spark, d):
    """Clean records of the corpus, a third of them garbled here: how many there are, and whether nearly all garbled ones
    are found and come back as they were, and no clean one is taken for garbled."""
    c = read(spark, d, "corpus").where("input_text is not null").select("id", "original_source", F.col("input_text").alias("true")).where(~F.col("true").rlike(CLEAN))
    bad = F.expr(bucket("id", 3)) == 0
    g = spread(c).withColumn("garbled", bad & F.col("true").rlike(r"[^\x00-\x7F]")).withColumn("input_text", F.when(bad, F.decode(F.encode("true", "UTF-8"), "ISO-8859-1")).otherwise(F.col("true")))
    r = mojibake.restore(g, "id", "input_text", "original_source").where("garbled").select("id", "restored").dropDuplicates(["id"])
    x = g.join(r, "id", "left").withColumn("back", F.col("restored") == composed(F.col("true")))
    share = lambda c: (F.count_if(F.col("garbled") & c) >= 0.98 * F.count_if("garbled"))
    return x.agg(F.count("*").alias("n_rows"), F.count_if("garbled").alias("n_garbled"), share(F.col("restored").isNotNull()).alias("found"), share(F.coalesce("back", F.lit(False))).alias("restored"), (F.count_if(~F.col("garbled") & F.col("restored").isNotNull()) == 0).alias("clean_kept"))


def _toxicity(spark, d):
    c = _corpus(spark, d)
    channel, model = toxicity.learn(c, "input_text", read(spark, d, "toxicity_labels"), "toxic")
    return toxicity.scores(c, "id", "input_text", channel, model)


def p6_found(spark, d):
    return _toxicity(spark, d).where(F.col("score") > TOXIC_FROM).select("id").distinct()


def p6_scores(spark, d):
    return _toxicity(spark, d)


def p6_rates(spark, d):
    s = _toxicity(spark, d).join(_corpus(spark, d).select("id", "original_source"), "id")
    return s.groupBy("original_source").agg(F.count("*").alias("n_records"), F.count_if(F.col("score") > TOXIC_FROM).alias("n_toxic"), F.avg("score").alias("mean_score"))


def _private(spark, d):
    c, g = read(spark, d, "corpus"), read(spark, d, "gold")
    model = pii.train(pii.sample(c, "input_text"), spark)
    rows = (
        c.select("id", F.lit("input_text").alias("field_name"), F.col("input_text").alias("t"))
        .unionByName(g.select("id", F.lit("input_text").alias("field_name"), F.col("input_text").alias("t")))
        .unionByName(g.select("id", F.lit("target_text").alias("field_name"), F.col("target_text").alias("t")))
    )
    keyed = spread(rows).select(F.struct("id", "field_name").alias("k"), "t")
    return pii.annotate(keyed, "k", "t", model)


def p7_found(spark, d):
    a = _private(spark, d).where(F.size("spans") > 0)
    return a.select("id.id", "id.field_name", F.explode("spans.pii_type").alias("pii_type")).distinct()


def p7_redacted(spark, d):
    """Every text with typed placeholders for its private data."""
    return _private(spark, d).select("id.id", "id.field_name", "redacted", F.size("spans").alias("n_spans"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_restored": p4_restored, "p4_rates": p4_rates, "p4_roundtrip": p4_roundtrip, "p6_found": p6_found, "p6_scores": p6_scores, "p6_rates": p6_rates, "p7_found": p7_found, "p7_redacted": p7_redacted}

ORACLE = {
    "p4_roundtrip": f"SELECT count(*) AS n_rows, count_if({bucket_sql('id', 3)} = 0 AND regexp_matches(input_text, '[^\\x00-\\x7F]'))::BIGINT AS n_garbled, true AS found, true AS restored, true AS clean_kept FROM corpus WHERE input_text IS NOT NULL AND NOT regexp_matches(input_text, '{CLEAN}')",
}
