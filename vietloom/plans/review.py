"""Queries of the review ledger and the lexical policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import policy as P
from .common import bucket, bucket_sql, read

POLICY = P.Policy()


def _results(spark, d):
    return read(spark, d, "review_results")


def _attempts(spark, d):
    return read(spark, d, "review_attempts")


def _reviewed(spark, d):
    c = read(spark, d, "candidates").groupBy(F.col("id").alias("sample_id")).agg(F.max(F.struct("candidate_text", "input_text")).alias("c")).select("sample_id", "c.input_text", "c.candidate_text")
    return L.latest(_results(spark, d)).join(c, "sample_id")


def q_latest(spark, d):
    return L.latest(_results(spark, d)).select(*L.KEY, "decision", "corrected_text", "reason_code", "batch_id")


def q_state(spark, d):
    return L.batch_state(_attempts(spark, d)).select("batch_id", *L.NAMESPACE, "attempt_count", "status", "error_code")


def q_outcomes(spark, d):
    return L.outcomes(_attempts(spark, d))


def q_reconcile(spark, d):
    """The ledger as it stood after each batch's first attempt: which failures later results or exclusions settle."""
    out = read(spark, d, "candidates").select(F.col("id").alias("sample_id")).where(f"{bucket('sample_id', 7)} = 0")
    return L.reconciled(_attempts(spark, d).where("attempt_number = 1"), _results(spark, d), out)


def _recovery(spark, d):
    """For each attempt that failed, attempts of its samples one by one, every second of them blocked before an answer."""
    x = L.samples(_attempts(spark, d).where("status = 'failed'"))
    n = F.expr(bucket("concat(attempt_id, sample_id)", 4))
    meta = F.when(n < 2, F.lit('{"candidate_count": 0, "prompt_block_reason": "PROHIBITED_CONTENT"}')).otherwise(F.lit('{"finish_reason": "STOP"}'))
    return x.withColumn("sample_ids_json", F.when(n == 1, F.to_json(F.array("sample_id", "sample_id"))).otherwise(F.to_json(F.array("sample_id")))).withColumn("error_code", F.when(n < 2, "prompt_blocked").otherwise("timeout")).withColumn("response_metadata_json", meta).drop("sample_id")


def q_blocked(spark, d):
    return L.blocked_singletons(_recovery(spark, d))


def q_pending(spark, d):
    """Batches still to be reviewed in each namespace of the ledger, apart from excluded samples."""
    out = read(spark, d, "candidates").select(F.col("id").alias("sample_id")).where(f"{bucket('sample_id', 7)} = 0")
    spaces = [tuple(r) for r in _attempts(spark, d).select(*L.NAMESPACE).distinct().collect()]  # prompts by models
    x = L.pending(read(spark, d, "candidates"), _results(spark, d), "id", sorted(spaces), excluded=out)
    return x.select(*L.NAMESPACE, "batch_no", "batch_id", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first_id"))


def q_decisions(spark, d):
    x = L.latest(_results(spark, d)).groupBy(*L.NAMESPACE).agg(F.count("*").alias("n_reviews"), *[F.count_if(F.col("decision") == k).alias(f"n_{k.lower()}") for k in ("KEEP", "EDIT", "REJECT")])
    return x.select("*", *[F.round(F.col(f"n_{k}") / F.col("n_reviews"), 9).alias(f"{k}_rate") for k in ("keep", "edit", "reject")])


def q_reasons(spark, d):
    return L.latest(_results(spark, d)).where("decision = 'REJECT'").groupBy("reason_code").agg(F.count("*").alias("n"))


def q_errors(spark, d):
    a = _attempts(spark, d).where("status <> 'succeeded'")
    return a.select("attempt_id", L.error_class(F.col("error_detail")).alias("error_class"), L.safe_detail(F.col("error_detail")).alias("safe_detail"))


def q_gate(spark, d):
    return _attempts(spark, d).select("attempt_id", L.response_gate(F.col("response_metadata_json"), F.coalesce("raw_response", F.lit("kept elsewhere"))).alias("gate"))


def _answers(spark, d):
    """An answer to each attempt, sound or spoilt in one of six ways that its number tells."""
    x = _attempts(spark, d).withColumn("ids", F.from_json("sample_ids_json", "array<string>"))
    k = F.col("attempt_id") % 7
    one = lambda i: F.concat(F.lit('{"id":"'), i, F.lit('","decision":"KEEP","corrected_text":"null","reason_code":null}'))
    edit = lambda i: F.concat(F.lit('{"id":"'), i, F.lit('","decision":"EDIT","corrected_text":null,"reason_code":null}'))
    listed = lambda a: F.concat(F.lit('{"results":['), F.array_join(a, ","), F.lit("]}"))
    sound = listed(F.transform("ids", one))
    text = (
        F.when(k == 1, F.concat(F.lit("```json\n"), sound, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), sound)).when(k == 3, listed(F.transform(F.slice("ids", F.lit(2), F.size("ids")), one)))
        .when(k == 4, listed(F.transform("ids", edit))).when(k == 5, F.lit("no answer")).when(k == 6, listed(F.transform(F.concat("ids", F.slice("ids", 1, 1)), one))).otherwise(sound)
    )
    return x.select("attempt_id", "sample_ids_json", text.alias("raw"))


def q_parse(spark, d):
    x = L.parsed(_answers(spark, d), "raw", "sample_ids_json")
    return x.select("attempt_id", F.coalesce("parse_error", F.lit("none")).alias("parse_error"), F.when(F.col("results").isNotNull(), F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["id"], r["decision"], F.coalesce(r["corrected_text"], F.lit("-")))), ",")).alias("results"))


def q_canonical(spark, d):
    return read(spark, d, "corpus").select("id", P.canonicalize(F.col("input_text"), POLICY).alias("text"))


def q_opaque(spark, d):
    return read(spark, d, "corpus").select("id", P.is_opaque(F.col("input_text"), POLICY).alias("opaque"), P.is_ambiguous(F.col("input_text"), POLICY).alias("ambiguous"))


def q_preserved(spark, d):
    g = read(spark, d, "gold")
    return g.select("id", P.symbols_lost(F.col("input_text"), F.col("target_text")).alias("symbols_lost"), P.numbers_lost(F.col("input_text"), F.col("target_text")).alias("numbers_lost"))


def q_stretch(spark, d):
    g = read(spark, d, "gold")
    return g.select("id", P.stretch_lost(F.col("input_text"), F.col("target_text"), POLICY).alias("stretch_lost"))


def q_policy(spark, d):
    r = _reviewed(spark, d)
    x = P.decided(F.col("input_text"), F.col("candidate_text"), F.col("decision"), F.col("corrected_text"), F.col("reason_code"), POLICY)
    return r.select(*L.KEY, F.col("decision").alias("before"), x.alias("x")).select(*L.KEY, "before", "x.decision", "x.corrected_text", "x.reason_code")


QUERIES = {
    "ledger_latest": q_latest, "ledger_batch_state": q_state, "ledger_outcomes": q_outcomes, "ledger_reconcile": q_reconcile, "blocked_singletons": q_blocked, "pending_batches": q_pending, "decision_rates": q_decisions, "reject_reasons": q_reasons,
    "error_classes": q_errors, "response_gate": q_gate, "response_parse": q_parse, "policy_canonicalize": q_canonical, "policy_opaque": q_opaque, "policy_preservation": q_preserved, "policy_stretch": q_stretch, "policy_decisions": q_policy,
}

_K, _N = ", ".join(L.KEY), ", ".join(L.NAMESPACE)
_LATEST = f"(SELECT * FROM review_results QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY reviewed_at DESC, prompt_hash DESC, batch_id DESC, decision DESC, corrected_text DESC NULLS LAST, reason_code DESC NULLS LAST) = 1)"
_STATE = f"(SELECT batch_id, {_N}, count(*) OVER (PARTITION BY batch_id, {_N}) AS attempt_count, status, error_code FROM review_attempts QUALIFY row_number() OVER (PARTITION BY batch_id, {_N} ORDER BY attempt_number DESC, attempt_id DESC) = 1)"
_CASE_CLASS = "CASE WHEN regexp_matches(m, '429|quota|resource_exhausted') THEN 'quota' WHEN regexp_matches(m, '401|403|api key|authentication|permission_denied') THEN 'auth' ELSE 'transient' END"
_CASE_SAFE = "CASE WHEN contains(m, 'client has been closed') THEN 'client_closed' WHEN regexp_matches(m, 'not found|404') THEN 'model_or_endpoint_not_found' WHEN regexp_matches(m, 'invalid argument|400') THEN 'invalid_request' WHEN contains(m, 'response is not valid json') THEN 'invalid_json_response' WHEN contains(m, 'does not exactly match') THEN 'response_id_mismatch' WHEN contains(m, 'validationerror') THEN 'response_schema_invalid' ELSE 'api_or_transport_error' END"
_canon = "input_text"
for _k, _v in POLICY.ordered():
    # a boundary is consumed here, so each replacement runs twice
    for _ in (1, 2):
        _canon = rf"regexp_replace({_canon}, '(?i)(^|[^\p{{L}}\p{{N}}_]){P.sql_pattern(_k)}($|[^\p{{L}}\p{{N}}_])', '\1{_v}\2', 'g')"
_MARKS = r"[^\p{L}\p{N}_\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.,;:!?()\[\]{}''\"/@&*+=%#-]"
# runs of five and more equal signs, found by numbering the signs of a kind
_lost_sql = lambda i, t, pat: f"len(list_filter(regexp_extract_all({i}, '{pat}'), lambda x: NOT contains({t}, x))) > 0"
_NUM = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
_stretch = lambda rel, t: f"""SELECT key, bool_or(n >= {POLICY.stretched_min} AND NOT contains({t}, repeat(c, n))) AS lost FROM (SELECT key, {t}, c, g, count(*)::INT AS n FROM (SELECT key, {t}, c, k - row_number() OVER (PARTITION BY key, c ORDER BY k) AS g FROM (SELECT key, {t}, k, substr(i, k, 1) AS c FROM (SELECT key, i, {t}, unnest(range(1, length(i) + 1)) AS k FROM {rel})) WHERE c NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233))) GROUP BY ALL) GROUP BY key"""
ORACLE = {
    "policy_stretch": f"WITH r AS (SELECT id AS key, input_text AS i, target_text AS t FROM gold) SELECT gold.id, coalesce(lost, false) AS stretch_lost FROM gold LEFT JOIN ({_stretch('r', 't')}) s ON s.key = gold.id",
    "policy_decisions": f"""WITH l AS (SELECT * FROM {_LATEST}), c AS (SELECT id AS sample_id, input_text, candidate_text FROM candidates QUALIFY row_number() OVER (PARTITION BY id ORDER BY candidate_text DESC NULLS LAST, input_text DESC NULLS LAST) = 1),
 x AS (SELECT {_K}, decision AS before, corrected_text, reason_code, input_text AS i, CASE WHEN decision = 'KEEP' THEN candidate_text ELSE corrected_text END AS f FROM l JOIN c USING (sample_id)),
 y AS (SELECT *, struct_pack({_K}) AS key, {_canon.replace("input_text", "f")} AS t FROM x), s AS ({_stretch('y', 't')}), o AS (SELECT key, regexp_extract_all(i, '[A-Za-zÀ-ỹ]+') AS a FROM y),
 z AS (SELECT y.*, contains(lower(i), 'mưa rồi') AS amb, len(a) = 1 AND length(a[1]) >= 16 AND NOT regexp_matches(a[1], '(?i)[{P.VOWELS}]') AS opq, {_lost_sql("i", "t", _MARKS)} OR coalesce(lost, false) OR {_lost_sql("i", "t", _NUM)} AS bad FROM y LEFT JOIN s USING (key) LEFT JOIN o USING (key))
 SELECT {_K}, before, CASE WHEN amb OR opq THEN 'REJECT' WHEN before = 'REJECT' THEN before WHEN bad THEN 'REJECT' WHEN before = 'KEEP' AND t <> f THEN 'EDIT' ELSE before END AS decision,
 CASE WHEN amb OR opq THEN NULL WHEN before = 'REJECT' THEN corrected_text WHEN bad THEN NULL WHEN before = 'KEEP' AND t <> f THEN t WHEN before = 'EDIT' THEN t ELSE corrected_text END AS corrected_text,
 CASE WHEN amb THEN 'AMBIGUOUS' WHEN opq THEN 'NOT_LEXICAL_NORMALIZATION' WHEN before = 'REJECT' THEN reason_code WHEN bad THEN 'OTHER' WHEN before = 'KEEP' AND t <> f THEN NULL ELSE reason_code END AS reason_code FROM z""",
    "ledger_latest": f"SELECT {_K}, decision, corrected_text, reason_code, batch_id FROM {_LATEST}",
    "ledger_batch_state": f"SELECT * FROM {_STATE}",
    "ledger_outcomes": f"SELECT {_N}, status, coalesce(error_code, 'success') AS code, count(*) AS n FROM review_attempts GROUP BY ALL",
    "ledger_reconcile": f"""WITH a AS (SELECT * FROM review_attempts WHERE attempt_number = 1), f AS (SELECT batch_id, {_N} FROM a QUALIFY row_number() OVER (PARTITION BY batch_id, {_N} ORDER BY attempt_number DESC, attempt_id DESC) = 1 AND status = 'failed'), s AS (SELECT DISTINCT batch_id, {_N}, unnest(from_json(sample_ids_json, '["VARCHAR"]')) AS sample_id FROM a SEMI JOIN f USING (batch_id, {_N})),
 d AS (SELECT DISTINCT {_K}, 1 AS done FROM review_results), o AS (SELECT DISTINCT id AS sample_id FROM candidates WHERE {bucket_sql("id", 7)} = 0)
 SELECT batch_id, {_N}, count(*) AS n_samples, count(coalesce(done, CASE WHEN sample_id IN (SELECT sample_id FROM o) THEN 1 END)) AS n_resolved, CASE WHEN n_samples = n_resolved THEN 'superseded' ELSE 'failed' END AS status FROM s LEFT JOIN d USING ({_K}) GROUP BY batch_id, {_N}""",
    "blocked_singletons": f"""SELECT attempt_id, sample_id, {_N}, '{{"candidate_count": 0, "prompt_block_reason": "PROHIBITED_CONTENT"}}' AS response_metadata_json FROM (SELECT *, unnest(from_json(sample_ids_json, '["VARCHAR"]')) AS sample_id FROM review_attempts WHERE status = 'failed') WHERE {bucket_sql("(attempt_id || sample_id)", 4)} = 0""",
    "pending_batches": f"""WITH n AS (SELECT DISTINCT {_N} FROM review_attempts), i AS (SELECT DISTINCT id AS sample_id FROM candidates WHERE id IS NOT NULL AND {bucket_sql("id", 7)} <> 0),
 p AS (SELECT {_N}, sample_id, row_number() OVER (PARTITION BY {_N} ORDER BY sample_id) - 1 AS r FROM (SELECT * FROM n, i) ANTI JOIN review_results USING ({_K}))
 SELECT {_N}, (r // 15)::BIGINT AS batch_no, substr(sha256('{{"ids":["' || string_agg(sample_id, '","' ORDER BY sample_id) || '"],"prompt_hash":"' || prompt_hash || '"}}'), 1, 24) AS batch_id, count(*) AS n, min(sample_id) AS first_id FROM p GROUP BY {_N}, r // 15""",
    "response_parse": """WITH x AS (SELECT attempt_id, from_json(sample_ids_json, '["VARCHAR"]') AS ids FROM review_attempts) SELECT attempt_id, CASE attempt_id % 7 WHEN 3 THEN 'id_mismatch' WHEN 4 THEN 'schema' WHEN 5 THEN 'not_json' WHEN 6 THEN 'id_mismatch' ELSE 'none' END AS parse_error, CASE WHEN attempt_id % 7 < 3 THEN array_to_string(list_transform(ids, lambda i: i || ':KEEP:-'), ',') END AS results FROM x""",
    "decision_rates": f"SELECT {_N}, count(*) AS n_reviews, count_if(decision = 'KEEP')::BIGINT AS n_keep, count_if(decision = 'EDIT')::BIGINT AS n_edit, count_if(decision = 'REJECT')::BIGINT AS n_reject, round(count_if(decision = 'KEEP') / count(*), 9) AS keep_rate, round(count_if(decision = 'EDIT') / count(*), 9) AS edit_rate, round(count_if(decision = 'REJECT') / count(*), 9) AS reject_rate FROM {_LATEST} GROUP BY {_N}",
    "reject_reasons": f"SELECT reason_code, count(*) AS n FROM {_LATEST} WHERE decision = 'REJECT' GROUP BY 1",
    "error_classes": f"SELECT attempt_id, {_CASE_CLASS} AS error_class, {_CASE_SAFE} AS safe_detail FROM (SELECT attempt_id, lower(coalesce(error_detail, '')) AS m FROM review_attempts WHERE status <> 'succeeded')",
    "response_gate": """SELECT attempt_id, CASE WHEN b IS NOT NULL AND b <> 'BLOCKED_REASON_UNSPECIFIED' THEN 'prompt_blocked' WHEN n = '0' THEN 'no_candidates' WHEN f IS NOT NULL AND f NOT IN ('STOP', 'FINISH_REASON_UNSPECIFIED') THEN 'finish_' || lower(f) WHEN trim(coalesce(raw_response, 'kept elsewhere')) = '' THEN 'empty_response_text' END AS gate
 FROM (SELECT *, response_metadata_json->>'prompt_block_reason' AS b, response_metadata_json->>'candidate_count' AS n, response_metadata_json->>'finish_reason' AS f FROM review_attempts)""",
    "policy_canonicalize": f"SELECT id, {_canon} AS text FROM corpus",
    "policy_opaque": f"SELECT id, CASE WHEN len(t) = 1 THEN length(t[1]) >= 16 AND NOT regexp_matches(t[1], '(?i)[{P.VOWELS}]') WHEN t IS NOT NULL THEN false END AS opaque, contains(lower(input_text), 'mưa rồi') AS ambiguous FROM (SELECT id, input_text, regexp_extract_all(input_text, '[A-Za-zÀ-ỹ]+') AS t FROM corpus)",
    "policy_preservation": f"SELECT id, len(list_filter(regexp_extract_all(input_text, '{_MARKS}'), lambda x: NOT contains(target_text, x))) > 0 AS symbols_lost, len(list_filter(regexp_extract_all(input_text, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)?'), lambda x: NOT contains(target_text, x))) > 0 AS numbers_lost FROM gold",
}
