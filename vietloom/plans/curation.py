"""Queries over raw and curated data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS_CLASS, clean_text
from ..operators import curate
from ..operators.ranking import rank_within
from ..operators.weak import is_artifact
from .common import SOURCES, WS_SQL, case_sql, clean_sql, in_sql, read


def _held(spark, d):
    return read(spark, d, "gold").where("split in ('dev', 'test')")


def _fates(spark, d):
    c = read(spark, d, "corpus").select("id", "original_source", "input_text")
    return curate.fates(c, curate.protected_hashes(_held(spark, d), "input_text"), "id", "original_source", "input_text", SOURCES)


def q_clean(spark, d):
    return read(spark, d, "corpus").select("id", clean_text("input_text").alias("text"))


def q_fates(spark, d):
    return _fates(spark, d).select("id", "fate")


def q_fate_counts(spark, d):
    return curate.fate_counts(_fates(spark, d), "original_source")


def q_prepare(spark, d):
    k = _fates(spark, d).where("fate = 'keep'").select("id", "original_source", "source_index", F.col("clean").alias("input_text"))
    return curate.numbered(k, ["source_index", "id"], "new_id", "corpus_%06d").select("new_id", "id", "original_source", "input_text")


def q_pairs(spark, d):
    p = curate.pairs(read(spark, d, "gold").select("id", "split", "input_text", "target_text"), "input_text", "target_text")
    r = rank_within(p, ["split"], ["id"], "n").drop("n_n")
    return r.select("id", F.concat_ws("_", F.lit("pair"), "split", F.format_string("%06d", "n")).alias("pair_id"), "split", "input_text", "target_text")


def q_hashes(spark, d):
    return curate.protected_hashes(_held(spark, d), "input_text")


def q_leakage(spark, d):
    """Leaks in a corpus to which held-out texts were added, spaced otherwise."""
    h = curate.protected_hashes(_held(spark, d), "input_text")
    added = _held(spark, d).select(F.concat(F.lit("leak_"), "id").alias("id"), F.concat(F.lit(" \t"), F.replace("input_text", F.lit(" "), F.lit("  "))).alias("input_text"))
    c = read(spark, d, "corpus").select("id", "input_text").unionByName(added).select("id", F.sha2(clean_text("input_text"), 256).alias("sha256"))
    return c.join(h, "sha256", "left_semi").select("id", "sha256")


def q_validation(spark, d):
    return curate.validation_report(read(spark, d, "gold"), read(spark, d, "corpus"), SOURCES, "original_source")


def q_zero(spark, d):
    return curate.zero_filled(read(spark, d, "corpus"), "original_source", [*SOURCES, "none such"])


def q_raw(spark, d):
    j = read(spark, d, "raw_source").select("file_name", F.from_json("payload", "input_text string, original_source string, dataset string").alias("j"))
    return j.select("file_name", "j.*").groupBy("file_name", "original_source").agg(F.count("*").alias("n"), F.count_if(F.regexp_replace(F.coalesce("input_text", F.lit("")), WS_CLASS, "") == "").alias("n_blank"))


def q_text_stats(spark, d):
    g = read(spark, d, "gold")
    t = lambda c: F.size(F.array_remove(F.split(c, WS_CLASS + "+"), "")).cast("long")
    return g.select("id", t("input_text").alias("n_in"), t("target_text").alias("n_out"), F.round(F.length("target_text") / F.greatest(F.lit(1), F.length("input_text")), 9).alias("ratio"), F.sha2("input_text", 256).alias("sha"))


def q_artifact(spark, d):
    t = F.regexp_replace("candidate_text", f"^{WS_CLASS}+|{WS_CLASS}+$", "")
    return read(spark, d, "candidates").groupBy("original_source").agg(F.count_if(is_artifact(t)).alias("n_artifacts"), F.count_if(t == "").alias("n_blank"))


def q_history(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return curate.consecutive_distinct(e, "user_id", ["ts", "event_id"], ["event_type"], 10).select("user_id", "event_id", "event_type", F.col("place").cast("long").alias("place"))


QUERIES = {
    "clean_text": q_clean, "corpus_fates": q_fates, "corpus_fate_counts": q_fate_counts, "corpus_prepare": q_prepare, "gold_pairs": q_pairs, "protected_hashes": q_hashes, "leakage_check": q_leakage,
    "data_validation": q_validation, "source_counts": q_zero, "raw_parse": q_raw, "text_stats": q_text_stats, "response_artifacts": q_artifact, "history_dedup": q_history,
}

_FATES = f"""
p AS (SELECT DISTINCT {clean_sql("input_text")} AS t FROM gold WHERE split IN ('dev', 'test')),
x AS (SELECT id, original_source, {clean_sql("input_text")} AS t, {case_sql("original_source", SOURCES)} AS s FROM corpus),
y AS (SELECT *, t IN (SELECT t FROM p WHERE t IS NOT NULL) AS prot FROM x),
f AS (SELECT id, original_source, s, t, CASE WHEN t IS NULL THEN 'empty' WHEN prot THEN 'protected_overlap'
  WHEN row_number() OVER (PARTITION BY t, prot ORDER BY s, id) > 1 THEN 'duplicate' ELSE 'keep' END AS fate FROM y)"""
_C, _T = clean_sql("input_text"), clean_sql("target_text")
ORACLE = {
    "clean_text": f"SELECT id, {_C} AS text FROM corpus",
    "corpus_fates": f"WITH {_FATES} SELECT id, fate FROM f",
    "corpus_fate_counts": f"WITH {_FATES} SELECT original_source, count(*) AS raw, count_if(fate = 'empty')::BIGINT AS empty, count_if(fate = 'protected_overlap')::BIGINT AS protected_overlap, count_if(fate = 'duplicate')::BIGINT AS duplicate, count_if(fate = 'keep')::BIGINT AS keep FROM f GROUP BY 1",
    "corpus_prepare": f"WITH {_FATES} SELECT printf('corpus_%06d', row_number() OVER (ORDER BY s, id)) AS new_id, id, original_source, t AS input_text FROM f WHERE fate = 'keep'",
    "gold_pairs": f"SELECT id, 'pair_' || split || '_' || printf('%06d', row_number() OVER (PARTITION BY split ORDER BY id)) AS pair_id, split, {_C} AS input_text, {_T} AS target_text FROM gold WHERE {_C} IS NOT NULL AND {_T} IS NOT NULL",
    "protected_hashes": f"SELECT DISTINCT sha256({_C}) AS sha256 FROM gold WHERE split IN ('dev', 'test') AND {_C} IS NOT NULL",
    "leakage_check": f"SELECT id, sha256({_C}) AS sha256 FROM (SELECT id, input_text FROM corpus UNION ALL SELECT 'leak_' || id, chr(9) || replace(input_text, ' ', '  ') FROM gold WHERE split IN ('dev', 'test')) WHERE {_C} IN (SELECT {_C} FROM gold WHERE split IN ('dev', 'test') AND {_C} IS NOT NULL)",
    "data_validation": f"""WITH g AS (SELECT *, {_C} AS i, {_T} AS t FROM gold), c AS (SELECT *, {_C} AS i FROM corpus) SELECT
 (SELECT count(*) FROM g WHERE split IS NULL OR split NOT IN ('train', 'dev', 'test')) AS bad_split,
 (SELECT count(*) FROM g WHERE label_source IS DISTINCT FROM 'human') AS bad_label_source,
 (SELECT count(*) FROM g WHERE input_text IS DISTINCT FROM i OR target_text IS DISTINCT FROM t) AS gold_not_clean,
 (SELECT count(*) FROM c WHERE original_source IS NULL OR original_source NOT IN {in_sql(SOURCES)}) AS bad_source,
 (SELECT count(*) FROM c WHERE input_text IS NULL OR input_text IS DISTINCT FROM i) AS corpus_not_clean,
 (SELECT count(*) FROM (SELECT id FROM (SELECT id FROM gold UNION ALL SELECT id FROM corpus) GROUP BY id HAVING count(*) > 1)) AS duplicate_ids,
 (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM c WHERE i IS NOT NULL GROUP BY i)) AS duplicate_texts,
 (SELECT count(*) FROM c WHERE i IN (SELECT i FROM g WHERE split IN ('dev', 'test') AND i IS NOT NULL)) AS protected_overlap""",
    "source_counts": "SELECT s.original_source, count(c.id) AS n FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in [*SOURCES, "none such"]) + "]) AS original_source) s LEFT JOIN corpus c USING (original_source) GROUP BY 1",
    "raw_parse": f"SELECT file_name, payload->>'original_source' AS original_source, count(*) AS n, count_if(regexp_replace(coalesce(payload->>'input_text', ''), '{WS_SQL}', '', 'g') = '')::BIGINT AS n_blank FROM raw_source GROUP BY 1, 2",
    "text_stats": "SELECT id, len(list_filter(regexp_split_to_array(input_text, '{w}+'), lambda x: x <> '')) AS n_in, len(list_filter(regexp_split_to_array(target_text, '{w}+'), lambda x: x <> '')) AS n_out, round(length(target_text) / greatest(1, length(input_text)), 9) AS ratio, sha256(input_text) AS sha FROM gold".replace("{w}", WS_SQL),
    "response_artifacts": "SELECT original_source, count_if(starts_with(t, '{') OR starts_with(t, '[') OR starts_with(t, '```') OR contains(t, '\"decision\"'))::BIGINT AS n_artifacts, count_if(t = '')::BIGINT AS n_blank FROM (SELECT original_source, regexp_replace(candidate_text, '^{w}+|{w}+$', '', 'g') AS t FROM candidates) GROUP BY 1".replace("{w}", WS_SQL),
    "history_dedup": "WITH x AS (SELECT *, lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM x WHERE NOT same QUALIFY place <= 10",
}
