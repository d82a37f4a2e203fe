"""Queries of bands, quotas, manifests and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..sources.io import chunk_state
from .common import SOURCES, case_sql, in_sql, read

BANDS, SEED, PILOT = 3, 2026, 5




def _candidates(spark, d):
    c = read(spark, d, "candidates").where(F.col("model_a_confidence").isNotNull() & F.col("original_source").isin(*SOURCES))
    return c.select("id", "original_source", "model_a_confidence").distinct()


def _banded(spark, d):
    return R.bands(_candidates(spark, d), ["original_source"], ["model_a_confidence", "id"], BANDS)


def _quotas(spark, d, parts: int = 3):
    c = _candidates(spark, d).groupBy("original_source").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 0
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("original_source"))
    return R.largest_remainder(c.withColumn("place", place), "original_source", "n", "place", total // parts)


def _band_quotas(spark, d):
    q = _quotas(spark, d).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("band", F.col("band").cast("long"))
    return q.select("original_source", "band", R.even_split(F.col("quota"), F.col("band"), BANDS).cast("long").alias("quota"))


def _manifest(spark, d):
    return R.stratified(_banded(spark, d), ["original_source", "band"], _band_quotas(spark, d), "id", SEED)


def q_bands(spark, d):
    return _banded(spark, d).select("id", "original_source", "band")


def q_quotas(spark, d):
    return _quotas(spark, d)


def q_band_quotas(spark, d):
    return _band_quotas(spark, d)


def q_manifest(spark, d):
    return _manifest(spark, d).select("id", "original_source", "band", "selection_rank", (F.col("selection_rank") <= PILOT).alias("is_pilot"))


def q_pilot(spark, d):
    return q_manifest(spark, d).where("is_pilot").groupBy("original_source", "band").agg(F.count("*").alias("n"))


def q_remaining(spark, d):
    return R.complement(_candidates(spark, d), _manifest(spark, d), "id", "id").select("id", "selection_rank")


def q_chunks(spark, d, size: int = 1000):
    r = R.rank_within(_candidates(spark, d), [], ["id"])
    return r.groupBy(F.floor((F.col("rank") - 1) / size).alias("chunk")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def q_audit(spark, d):
    """Ten reviewed rows per (decision, source), in seeded order."""
    c = read(spark, d, "candidates").select(F.col("id").alias("sample_id"), "original_source").dropDuplicates(["sample_id"])
    r = read(spark, d, "review_results").groupBy("sample_id").agg(F.max_by("decision", F.struct("reviewed_at", "prompt_version", "prompt_hash", "llm_model")).alias("decision"))
    j = r.join(c, "sample_id").where("original_source is not null")
    q = j.select("decision", "original_source").distinct().withColumn("quota", F.lit(10).cast("long"))
    return R.stratified(j, ["decision", "original_source"], q, "sample_id", SEED).select("sample_id", "decision", "original_source", "selection_rank")


def q_audit_bands(spark, d):
    """Ten reviewed rows per (decision, source, confidence band), in seeded order.

    A row without a confidence or from another source has no band; such rows are strata of their own, band -1.
    """
    b = _banded(spark, d).groupBy(F.col("id").alias("sample_id"), "original_source").agg(F.max("band").alias("band"))
    c = read(spark, d, "candidates").select(F.col("id").alias("sample_id"), "original_source").where("original_source is not null").distinct()
    r = read(spark, d, "review_results").groupBy("sample_id").agg(F.max_by("decision", F.struct("reviewed_at", "prompt_version", "prompt_hash", "llm_model")).alias("decision"))
    j = r.join(c, "sample_id").join(b, ["sample_id", "original_source"], "left").withColumn("band", F.coalesce("band", F.lit(-1).cast("long")))
    strata = ["decision", "original_source", "band"]
    q = j.select(*strata).distinct().withColumn("quota", F.lit(10).cast("long"))
    return R.stratified(j, strata, q, "sample_id", SEED).select("sample_id", *strata, "selection_rank")


def q_sample(spark, d):
    return R.sample_n(read(spark, d, "corpus").select("id", "original_source"), "id", SEED, 200)


def q_resume(spark, d):
    """Chunks by corpus order that lack candidates, hence must be generated anew."""
    c = R.rank_within(read(spark, d, "corpus").select("id"), [], ["id"]).withColumn("chunk", F.floor((F.col("rank") - 1) / 1000))
    done = read(spark, d, "candidates").where("generation_status = 'generated_text'").select("id").distinct()
    made = c.join(done, "id").select("chunk", F.lit(True).alias("valid"))
    return chunk_state(made, c.groupBy("chunk").agg(F.count("*").alias("expected")))


QUERIES = {
    "confidence_bands": q_bands, "source_quotas": q_quotas, "band_quotas": q_band_quotas, "stratified_manifest": q_manifest, "pilot_manifest": q_pilot,
    "remaining_manifest": q_remaining, "chunk_plan": q_chunks, "audit_sample": q_audit, "audit_sample_bands": q_audit_bands, "validation_sample": q_sample, "chunk_resume": q_resume,
}

_W = f"""c AS (SELECT DISTINCT id, original_source, model_a_confidence FROM candidates WHERE model_a_confidence IS NOT NULL AND original_source IN {in_sql(SOURCES)}),
b AS (SELECT *, least({BANDS - 1}, (row_number() OVER w - 1) * {BANDS} // count(*) OVER (PARTITION BY original_source))::BIGINT AS band FROM c WINDOW w AS (PARTITION BY original_source ORDER BY model_a_confidence, id)),
n AS (SELECT original_source, count(*) AS n, {case_sql("original_source", SOURCES)} AS place FROM c GROUP BY 1),
e AS (SELECT *, (SELECT sum(n) FROM n)::BIGINT // 3 AS budget, ((SELECT sum(n) FROM n)::BIGINT // 3)::DOUBLE * n / (SELECT sum(n) FROM n)::BIGINT AS e FROM n),
k AS (SELECT *, budget - (SELECT sum(floor(e)) FROM e) AS rest, row_number() OVER (ORDER BY e - floor(e) DESC, place) AS k FROM e),
q AS (SELECT original_source, n, (floor(e) + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM k),
bq AS (SELECT original_source, band, (quota // {BANDS} + CASE WHEN band < quota % {BANDS} THEN 1 ELSE 0 END)::BIGINT AS quota FROM q, (SELECT unnest([0, 1, 2])::BIGINT AS band)),
m AS (SELECT b.*, row_number() OVER (PARTITION BY original_source, band ORDER BY sha256('{SEED}:' || original_source || ':' || band || ':' || id), id) AS selection_rank FROM b),
s AS (SELECT m.* FROM m JOIN bq USING (original_source, band) WHERE selection_rank <= quota)"""
ORACLE = {
    "confidence_bands": f"WITH {_W} SELECT id, original_source, band FROM b",
    "source_quotas": f"WITH {_W} SELECT * FROM q",
    "band_quotas": f"WITH {_W} SELECT * FROM bq",
    "stratified_manifest": f"WITH {_W} SELECT id, original_source, band, selection_rank, selection_rank <= {PILOT} AS is_pilot FROM s",
    "pilot_manifest": f"WITH {_W} SELECT original_source, band, count(*) AS n FROM s WHERE selection_rank <= {PILOT} GROUP BY 1, 2",
    "remaining_manifest": f"WITH {_W} SELECT id, row_number() OVER (ORDER BY id) AS selection_rank FROM c WHERE id NOT IN (SELECT id FROM s)",
    "chunk_plan": f"WITH {_W} SELECT ((r - 1) // 1000)::BIGINT AS chunk, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM c) GROUP BY 1",
    "audit_sample": f"""WITH c AS (SELECT DISTINCT id, original_source FROM candidates),
r AS (SELECT sample_id, decision FROM review_results QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY reviewed_at DESC, prompt_version DESC, prompt_hash DESC, llm_model DESC) = 1)
SELECT sample_id, decision, original_source, row_number() OVER (PARTITION BY decision, original_source ORDER BY sha256('{SEED}:' || decision || ':' || original_source || ':' || sample_id), sample_id) AS selection_rank
FROM r JOIN c ON c.id = sample_id WHERE original_source IS NOT NULL QUALIFY selection_rank <= 10""",
    "audit_sample_bands": f"""WITH {_W}, a AS (SELECT DISTINCT id, original_source FROM candidates WHERE original_source IS NOT NULL),
g AS (SELECT id, original_source, max(band) AS band FROM b GROUP BY 1, 2),
r AS (SELECT sample_id, decision FROM review_results QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY reviewed_at DESC, prompt_version DESC, prompt_hash DESC, llm_model DESC) = 1),
j AS (SELECT sample_id, decision, a.original_source, coalesce(band, -1)::BIGINT AS band FROM r JOIN a ON a.id = sample_id LEFT JOIN g ON g.id = a.id AND g.original_source = a.original_source)
SELECT sample_id, decision, original_source, band, row_number() OVER (PARTITION BY decision, original_source, band ORDER BY sha256('{SEED}:' || decision || ':' || original_source || ':' || band || ':' || sample_id), sample_id) AS selection_rank
FROM j QUALIFY selection_rank <= 10""",
    "validation_sample": f"SELECT id, original_source FROM corpus ORDER BY sha256('{SEED}:' || id), id LIMIT 200",
    "chunk_resume": """WITH c AS (SELECT id, ((row_number() OVER (ORDER BY id) - 1) // 1000)::BIGINT AS chunk FROM corpus), k AS (SELECT DISTINCT id FROM candidates WHERE generation_status = 'generated_text')
SELECT chunk, count(*) AS expected, count(k.id) AS valid, count(*) = count(k.id) AS reusable FROM c LEFT JOIN k USING (id) GROUP BY 1""",
}
