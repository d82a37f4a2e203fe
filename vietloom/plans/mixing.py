"""Queries of mixtures, integrity and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_text, strip_diacritics
from ..operators import integrity as I
from ..operators import mixtures as M
from ..operators.ranking import rank_within
from .common import bucket, bucket_sql, clean_sql, read

SEED, PER, COUNT, ARMS = 2026, 100, 14, 4
WHOLE, WHOLE_ARMS = 7, 5


def _initial(spark, d):
    return read(spark, d, "corpus").select("id").where(F.expr(bucket("id", 10)) < 4)


def _pool(spark, d):
    return read(spark, d, "corpus").select("id")


def _epochs(spark, d):
    return M.epochs(_initial(spark, d), "id", PER, COUNT, SEED, refill=True)


def q_balanced(spark, d):
    return _epochs(spark, d)


def q_coverage(spark, d):
    return M.coverage_epochs(_initial(spark, d), "id", PER, SEED)


def q_exposure(spark, d):
    return M.exposure(_epochs(spark, d), _initial(spark, d), "id")


def q_validate(spark, d):
    return M.validated(_epochs(spark, d), _initial(spark, d), "id", PER)


def q_slots(spark, d):
    g = read(spark, d, "gold").where("split = 'dev'").select("id")
    return M.slots(g, _epochs(spark, d), SEED)


def q_factorial(spark, d):
    return M.factorial(_initial(spark, d), _pool(spark, d), "id", PER, ARMS, SEED)


def _whole_epochs(spark, d):
    """Seven epochs of two fifths of the corpus: 2.8 rounds, every other round boundary inside an epoch."""
    pool = _pool(spark, d)
    return M.epochs(pool, "id", M.share(pool, "id"), WHOLE, SEED)


def q_balanced_whole(spark, d):
    return _whole_epochs(spark, d)


def q_coverage_whole(spark, d):
    pool = _pool(spark, d)
    return M.coverage_epochs(pool, "id", M.share(pool, "id"), SEED)


def q_exposure_whole(spark, d):
    return M.exposure(_whole_epochs(spark, d), _pool(spark, d), "id")


def q_validate_whole(spark, d):
    pool = _pool(spark, d)
    per = M.share(pool, "id")
    return M.validated(M.epochs(pool, "id", per, WHOLE, SEED), pool, "id", per)


def q_slots_whole(spark, d):
    g = read(spark, d, "gold").where("split = 'dev'").select("id")
    return M.slots(g, _whole_epochs(spark, d), SEED)


def q_factorial_whole(spark, d):
    """(arm, epoch, id) over two rounds of the small arm, so that from the third epoch on its repeats are replaced."""
    small = _initial(spark, d)
    return M.factorial(small, _pool(spark, d), "id", M.share(small, "id"), WHOLE_ARMS, SEED)


def q_manifest(spark, d):
    return M.manifest(_whole_epochs(spark, d), SEED)


def q_digest(spark, d):
    return M.ordered_digest(read(spark, d, "corpus"), "id", "id")


def q_audit(spark, d):
    return I.run_audit(read(spark, d, "candidates"))


def q_full_audit(spark, d):
    """A generation run against its inputs: the candidates by id, one a corpus record, in chunks of a thousand."""
    r = lambda df: rank_within(df, [], ["id"], "_n").withColumn("pos", F.col("_n") - 1).drop("_n", "_n_n")
    inputs = r(read(spark, d, "corpus").select("id", "dataset", "original_source", "input_text"))
    one = read(spark, d, "candidates").groupBy("id").agg(F.max(F.struct("candidate_text", "model_a_confidence", "dataset", "original_source", "input_text", "generation_config_hash", "sequence_token_count", "generation_status")).alias("x")).select("id", "x.*")
    c = r(one).withColumn("chunk", F.floor(F.col("pos") / 1000))
    return I.audit(inputs, c, read(spark, d, "review_results").select(F.col("sample_id").alias("id")), ["dataset", "original_source", "input_text"], chunk=1000)


def q_inventory(spark, d):
    return I.inventory(spark, d)


def q_same(spark, d):
    c = read(spark, d, "candidates").select("id", "candidate_text")
    return I.same_rows(c, c.distinct())


def q_json(spark, d):
    x = I.canonical_json({"text": clean_text("input_text"), "id": F.col("id"), "split": F.col("split")})
    return read(spark, d, "gold").select("id", F.sha2(x, 256).alias("sha256"))


def q_confidence(spark, d):
    """Mean of the values that are not padding, as a model's mean token log probability."""
    v = F.filter("embedding", lambda x: x != 0)
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(F.size(v), F.lit(1)), 6).alias("confidence"))


def q_strip(spark, d):
    return read(spark, d, "gold").select("id", strip_diacritics(F.col("target_text")).alias("text"))


def q_duration(spark, d):
    return read(spark, d, "orders").select("o_orderkey", I.format_duration(F.col("o_orderkey") * 7 % 90_000).alias("duration"))


def q_status(spark, d):
    blank = F.coalesce(clean_text("candidate_text"), F.lit("")) == ""
    return read(spark, d, "candidates").groupBy(F.when(blank, "empty_after_special_token_decode").otherwise("generated_text").alias("derived"), "generation_status").agg(F.count("*").alias("n"))


QUERIES = {
    "balanced_epochs": q_balanced, "coverage_epochs": q_coverage, "exposure_histogram": q_exposure, "mixture_validate": q_validate, "slot_order": q_slots, "factorial_epochs": q_factorial,
    "balanced_epochs_whole": q_balanced_whole, "coverage_epochs_whole": q_coverage_whole, "exposure_histogram_whole": q_exposure_whole, "mixture_validate_whole": q_validate_whole, "slot_order_whole": q_slots_whole, "factorial_epochs_whole": q_factorial_whole, "mixture_manifest": q_manifest, "order_digest": q_digest, "run_audit": q_audit, "full_audit": q_full_audit,
    "file_inventory": q_inventory, "multiset_equality": q_same, "canonical_json": q_json, "token_confidence": q_confidence, "strip_diacritics": q_strip, "format_duration": q_duration, "generation_status": q_status,
}

_POOL = f"i AS (SELECT DISTINCT id FROM corpus WHERE {bucket_sql('id', 10)} < 4), p AS (SELECT id, row_number() OVER (ORDER BY sha256('{SEED}:' || id), id) - 1 AS r, count(*) OVER () AS n FROM i)"
_EPOCHS = f"{_POOL}, e AS (SELECT ((r + k * n) // {PER})::BIGINT AS epoch, id FROM p, range({COUNT * PER}) t(k) WHERE r + k * n < {COUNT * PER})"
_POOL_W = f"i AS (SELECT DISTINCT id FROM corpus), p AS (SELECT id, row_number() OVER (ORDER BY sha256('{SEED}:' || id), id) - 1 AS r, count(*) OVER () AS n FROM i), z AS (SELECT (2 * count(*) + 4) // 5 AS per FROM i)"
_EPOCHS_W = f"{_POOL_W}, e AS (SELECT ((r + k * n) // per)::BIGINT AS epoch, id FROM p, z, range({WHOLE}) t(k) WHERE r + k * n < {WHOLE} * per)"


def _factorial_sql(per: str, count: int) -> str:
    """The arms epoch by epoch, each a query over the usage the one before left."""
    out = [f"u0 AS MATERIALIZED (SELECT id, id IN (SELECT id FROM i) AS initial, 0 AS small, 0 AS large FROM (SELECT DISTINCT id FROM corpus))"]
    for e in range(count):
        h = f"sha256('{SEED}:{e}:' || id)"
        out += [
            f"s{e} AS MATERIALIZED (SELECT id, large FROM u{e} WHERE initial QUALIFY row_number() OVER (ORDER BY small, {h}, id) <= {per})", f"f{e} AS MATERIALIZED (SELECT id FROM s{e} WHERE large = 0)",
            f"l{e} AS MATERIALIZED (SELECT id FROM f{e} UNION ALL SELECT id FROM (SELECT id, large FROM u{e} ANTI JOIN f{e} USING (id)) QUALIFY row_number() OVER (ORDER BY large, {h}, id) <= {per} - (SELECT count(*) FROM f{e}))",
            f"u{e + 1} AS MATERIALIZED (SELECT id, initial, small + (id IN (SELECT id FROM s{e}))::INT AS small, large + (id IN (SELECT id FROM l{e}))::INT AS large FROM u{e})",
        ]
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT '{a}' AS arm, {e}::BIGINT AS epoch, id FROM {a[0]}{e}" for e in range(count) for a in ("small", "large"))


ORACLE = {
    "factorial_epochs": f"WITH {_POOL}, {_factorial_sql(str(PER), ARMS)}",
    "factorial_epochs_whole": f"WITH {_POOL}, z AS (SELECT (2 * count(*) + 4) // 5 AS per FROM i), {_factorial_sql('(SELECT per FROM z)', WHOLE_ARMS)}",
    "canonical_json": f"SELECT id, sha256(to_json({{'id': id, 'split': split, 'text': {clean_sql('input_text')}}})) AS sha256 FROM gold",
    "balanced_epochs": f"WITH {_EPOCHS} SELECT * FROM e",
    "coverage_epochs": f"WITH {_POOL} SELECT ((r + k * n) // {PER})::BIGINT AS epoch, id FROM p, range(2) t(k) WHERE r + k * n < ceil(n / {PER}) * {PER}",
    "exposure_histogram": f"WITH {_EPOCHS} SELECT coalesce(t, 0) AS times, count(*) AS n_ids FROM i LEFT JOIN (SELECT id, count(*) AS t FROM e GROUP BY 1) USING (id) GROUP BY 1",
    "mixture_validate": f"WITH {_EPOCHS}, s AS (SELECT epoch, count(*) AS n, count(DISTINCT id) AS d FROM e GROUP BY 1) SELECT count(*) AS n_epochs, count_if(n <> {PER})::BIGINT AS wrong_size, count_if(n <> d)::BIGINT AS with_repeats, (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM i)) AS foreign_ids, (SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM e)) AS unused_ids FROM s",
    "slot_order": f"""WITH {_EPOCHS}, x AS (SELECT epoch, g.id, 'gold' AS label_source, g.id AS place FROM (SELECT DISTINCT epoch FROM e), (SELECT id FROM gold WHERE split = 'dev') g UNION ALL SELECT epoch, id, 'pseudo', (row_number() OVER (PARTITION BY epoch ORDER BY id))::VARCHAR FROM e)
 SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('{SEED}:' || epoch || ':' || label_source || ':' || place), id) - 1 AS slot, id, label_source FROM x""",
    "balanced_epochs_whole": f"WITH {_EPOCHS_W} SELECT * FROM e",
    "coverage_epochs_whole": f"WITH {_POOL_W} SELECT ((r + k * n) // per)::BIGINT AS epoch, id FROM p, z, range(2) t(k) WHERE r + k * n < ceil(n / per) * per",
    "exposure_histogram_whole": f"WITH {_EPOCHS_W} SELECT coalesce(t, 0) AS times, count(*) AS n_ids FROM i LEFT JOIN (SELECT id, count(*) AS t FROM e GROUP BY 1) USING (id) GROUP BY 1",
    "mixture_validate_whole": f"WITH {_EPOCHS_W}, s AS (SELECT epoch, count(*) AS n, count(DISTINCT id) AS d FROM e GROUP BY 1) SELECT count(*) AS n_epochs, count_if(n <> (SELECT per FROM z))::BIGINT AS wrong_size, count_if(n <> d)::BIGINT AS with_repeats, (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM i)) AS foreign_ids, (SELECT count(*) FROM i WHERE id NOT IN (SELECT id FROM e)) AS unused_ids FROM s",
    "slot_order_whole": f"""WITH {_EPOCHS_W}, x AS (SELECT epoch, g.id, 'gold' AS label_source, g.id AS place FROM (SELECT DISTINCT epoch FROM e), (SELECT id FROM gold WHERE split = 'dev') g UNION ALL SELECT epoch, id, 'pseudo', (row_number() OVER (PARTITION BY epoch ORDER BY id))::VARCHAR FROM e)
 SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY sha256('{SEED}:' || epoch || ':' || label_source || ':' || place), id) - 1 AS slot, id, label_source FROM x""",
    "mixture_manifest": f"WITH {_EPOCHS_W} SELECT epoch, epoch + {SEED} AS epoch_seed, count(*) AS pseudo_count, count(DISTINCT id) AS n_distinct, sum(('0x' || substr(md5(id), 1, 8))::BIGINT)::BIGINT AS digest FROM e GROUP BY epoch",
    "order_digest": "WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM corpus), b AS (SELECT k // 10000 AS block, sha256(string_agg(id, ',' ORDER BY k)) AS h, count(*) AS n FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, ',' ORDER BY block)) AS digest FROM b",
    "run_audit": """WITH i AS (SELECT id, count(*) AS n FROM candidates GROUP BY 1), a AS (SELECT count(*) AS n_rows, bool_and(model_a_confidence IS NOT NULL AND NOT isnan(coalesce(model_a_confidence, 0))) AS confidence_finite, bool_and((generation_status = 'generated_text') = (length(trim(coalesce(candidate_text, ''), ' ')) > 0)) AS status_fits_text,
 bool_and(regexp_matches(generation_config_hash, '^[a-f0-9]{64}$')) AS hash_form, bool_and(sequence_token_count >= 1) AS token_count_positive, count(DISTINCT generation_config_hash) AS n_configs, count(DISTINCT candidate_checkpoint) AS n_checkpoints, (SELECT count(*) FROM i) AS n_ids, (SELECT count(*) FROM i WHERE n > 1) AS n_repeated_ids FROM candidates)
 SELECT *, n_repeated_ids = 0 AS ids_unique, confidence_finite AND status_fits_text AND hash_form AND token_count_positive AND n_repeated_ids = 0 AS passed FROM a""",
    "full_audit": f"""WITH a AS (SELECT id, dataset, original_source, input_text, row_number() OVER (ORDER BY id) - 1 AS pos FROM corpus),
 b AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY id ORDER BY candidate_text DESC NULLS LAST, model_a_confidence DESC NULLS LAST, dataset DESC NULLS LAST, original_source DESC NULLS LAST, input_text DESC NULLS LAST, generation_config_hash DESC, sequence_token_count DESC, generation_status DESC) = 1)),
 m AS (SELECT sample_id AS id FROM review_results), j AS (SELECT a.id AS ai, b.id AS bi, a.dataset IS NOT DISTINCT FROM b.dataset AND a.original_source IS NOT DISTINCT FROM b.original_source AND a.input_text IS NOT DISTINCT FROM b.input_text AS same FROM a FULL JOIN b USING (pos)),
 c AS (SELECT 'input_count' AS "check", 0 AS n_bad UNION ALL SELECT 'candidate_count', 0 UNION ALL SELECT 'input_ids_unique', count(*) - count(DISTINCT id) FROM a UNION ALL SELECT 'candidate_ids_unique', count(*) - count(DISTINCT id) FROM b
  UNION ALL SELECT 'order_matches_input', count_if(ai IS DISTINCT FROM bi) FROM j UNION ALL SELECT 'provenance_matches_input', count_if(NOT same) FROM j
  UNION ALL SELECT 'contract', count_if(NOT coalesce(id IS NOT NULL AND input_text IS NOT NULL AND sequence_token_count >= 1 AND regexp_matches(generation_config_hash, '^[a-f0-9]{{64}}$') AND (coalesce(trim(candidate_text, ' '), '') <> '') = (generation_status = 'generated_text'), false)) FROM b
  UNION ALL SELECT 'confidence_finite', count_if(model_a_confidence IS NULL OR isnan(model_a_confidence)) FROM b UNION ALL SELECT 'config_hash', count(DISTINCT generation_config_hash) - 1 FROM b UNION ALL SELECT 'chunks_contiguous', 0 UNION ALL SELECT 'chunk_sizes', 0 UNION ALL SELECT 'chunk_places', 0 UNION ALL SELECT 'manifest_count', 0
  UNION ALL SELECT 'manifest_ids_unique', count(*) - count(DISTINCT id) FROM m UNION ALL SELECT 'manifest_within_candidates', count_if(id NOT IN (SELECT id FROM b)) FROM m)
 SELECT "check", n_bad::BIGINT AS n_bad, n_bad = 0 AS passed FROM c""",
    "multiset_equality": "SELECT (SELECT count(*) FROM (SELECT id, candidate_text FROM candidates EXCEPT ALL SELECT DISTINCT id, candidate_text FROM candidates)) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT id, candidate_text FROM candidates EXCEPT ALL SELECT id, candidate_text FROM candidates)) AS only_right",
    "token_confidence": "SELECT vec_id, round(coalesce(list_sum(list_transform(v, lambda x: x::DOUBLE)), 0) / greatest(len(v), 1), 6) AS confidence FROM (SELECT vec_id, list_filter(embedding, lambda x: x <> 0) AS v FROM embeddings)",
    "strip_diacritics": "SELECT id, replace(lower(strip_accents(target_text)), 'đ', 'd') AS text FROM gold",
    "format_duration": "SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS duration FROM (SELECT o_orderkey, (o_orderkey * 7 % 90000)::BIGINT AS s FROM orders)",
    "generation_status": f"SELECT CASE WHEN {clean_sql('candidate_text')} IS NULL THEN 'empty_after_special_token_decode' ELSE 'generated_text' END AS derived, generation_status, count(*) AS n FROM candidates GROUP BY ALL",
}
