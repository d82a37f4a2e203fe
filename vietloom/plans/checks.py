"""Queries of contracts, set comparisons, look-ups and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.edits import similarity, tokens
from ..functions.text import clean_text
from ..operators import guards, ledger
from ..operators.ranking import rank_within, short_strata
from . import evaluation
from .common import SOURCES, WS_SQL, clean_sql, in_sql, read

LOOKUP = [7, 3, 250, 3]
LIMIT = 128


def q_contract(spark, d):
    """Violations of the candidate contract, one column a rule."""
    text = F.coalesce(clean_text("candidate_text"), F.lit(""))
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(True))).alias(name)
    return read(spark, d, "candidates").agg(
        F.count("*").alias("n_rows"), n(~F.col("original_source").isin(*SOURCES), "bad_source"), n((text != "") != (F.col("generation_status") == "generated_text"), "status_unlike_text"),
        n(F.isnan("model_a_confidence") | F.col("model_a_confidence").isNull(), "no_confidence"), n(~F.col("generation_config_hash").rlike("^[a-f0-9]{64}$"), "bad_hash"), n(F.col("sequence_token_count") < 1, "bad_count"))


def q_predictions(spark, d):
    """Per model: rows, ids twice, empty predictions, inputs unlike the gold row of the same id."""
    p = evaluation._predictions(spark, d)
    g = read(spark, d, "gold").select("id", clean_text("input_text").alias("gold_input"))
    x = p.join(g, "id", "left")
    twice = p.groupBy("model", "id").count().groupBy("model").agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    return x.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(F.col("prediction_text") == "").alias("empty"), F.count_if(~F.col("input_text").eqNullSafe(F.col("gold_input"))).alias("misaligned")).join(twice, "model")


def q_sets(spark, d):
    """Ids of corpus and candidates: common, missing, foreign, and whether the one contains the other."""
    a, b = read(spark, d, "corpus").select("id").distinct().withColumn("a", F.lit(1)), read(spark, d, "candidates").select("id").distinct().withColumn("b", F.lit(1))
    x = a.join(b, "id", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("foreign"))
    return x.withColumn("subset", F.col("foreign") == 0)


def q_configs(spark, d):
    c = read(spark, d, "candidates")
    return c.groupBy("original_source").agg(F.array_join(F.sort_array(F.collect_set("candidate_checkpoint")), ",").alias("checkpoints"), F.array_join(F.sort_array(F.collect_set("generation_config_hash")), ",").alias("configs"))


def q_lookup(spark, d):
    """Rows of a list of record numbers, in the list's order, repeats kept."""
    want = spark.createDataFrame(list(enumerate(LOOKUP)), "place long, n int")
    c = read(spark, d, "corpus").select(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int").alias("n"), "id", "input_text")
    return want.join(c, "n", "left").select("place", "id", "input_text")


def q_wins(spark, d):
    return evaluation.q_winner(spark, d).groupBy("winner").agg(F.count("*").alias("n"))


def q_guard(spark, d):
    """Requests by fate: empty, too_long or ok."""
    t, n = clean_text("input_text"), F.size(tokens(F.col("input_text")))
    fate = F.when(t.isNull(), "empty").when(n > LIMIT, "too_long").otherwise("ok")
    return read(spark, d, "corpus").groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


def q_prompts(spark, d):
    """A prompt per pending batch: the template with the batch's samples as JSON."""
    c = read(spark, d, "candidates").groupBy("id").agg(F.max(F.struct("input_text", "candidate_text")).alias("c"))
    done = read(spark, d, "review_results").select(F.col("sample_id").alias("id")).distinct()
    r = rank_within(c.join(done, "id", "left_anti"), [], ["id"])
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "c.input_text", "c.candidate_text")))  # at most 15 of them
    b = r.groupBy(F.floor((F.col("rank") - 1) / 15).alias("batch_no")).agg(rows.alias("s"))
    return b.select("batch_no", ledger.rendered(F.lit("Review these samples:\n{samples_json}\n"), F.col("s")).alias("prompt"))


def q_likeness(spark, d):
    """How alike the words at equal places of gold pairs are, a word against one word and against two."""
    g = read(spark, d, "gold").select(tokens(F.col("input_text")).alias("a"), tokens(F.col("target_text")).alias("b"))
    both = F.transform("a", lambda x, i: F.array(F.struct(F.array(x).alias("s"), F.slice("b", i + 1, 1).alias("t")), F.struct(F.array(x).alias("s"), F.slice("b", i + 1, 2).alias("t"))))
    e = g.select(F.explode(F.flatten(both)).alias("e")).select("e.s", "e.t").where("size(t) > 0").distinct()
    return e.select(F.array_join("s", " ").alias("src"), F.array_join("t", " ").alias("tgt"), F.round(similarity(F.col("s"), F.col("t")), 9).alias("similarity"))


def q_resolved(spark, d):
    """Samples of the attempts with and without a result in their namespace."""
    s = ledger.samples(read(spark, d, "review_attempts")).select(*ledger.KEY).distinct()
    r = read(spark, d, "review_results").select(*ledger.KEY).distinct().withColumn("done", F.lit(1))
    return s.join(r, ledger.KEY, "left").groupBy(*ledger.NAMESPACE).agg(F.count("*").alias("n_samples"), F.count("done").alias("n_resolved"))


def _contract_faults(spark, d):
    text = F.coalesce(clean_text("candidate_text"), F.lit(""))
    rules = [(~F.col("original_source").isin(*SOURCES), "bad_source"), ((text != "") != (F.col("generation_status") == "generated_text"), "status_unlike_text"), (F.isnan("model_a_confidence") | F.col("model_a_confidence").isNull(), "no_confidence")]
    bad = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in rules]))
    return read(spark, d, "candidates").select("id", F.array_join(bad, ",").alias("faults")).where("faults <> ''").distinct()


def q_first_faults(spark, d):
    """The first ten rows that break the contract, by id."""
    return _contract_faults(spark, d).orderBy("id", "faults").limit(10)


def q_paths(spark, d):
    """Rows of raw files by whether their name has a part that a run must not read."""
    r = read(spark, d, "raw_source")
    return r.groupBy("file_name").agg(F.count("*").alias("n")).select("file_name", "n", guards.has_forbidden_part(F.col("file_name"), ["test", "_02", "HOS"]).alias("forbidden"))


def q_strata(spark, d):
    """Strata of source and status with fewer candidates than a quota of 300 each."""
    c = read(spark, d, "candidates")
    q = c.select("original_source", "generation_status").where("original_source is not null").distinct().withColumn("quota", F.lit(300).cast("long"))
    return short_strata(c, ["original_source", "generation_status"], q)


QUERIES = {
    "first_contract_faults": q_first_faults, "path_guard": q_paths, "short_strata": q_strata,
    "candidate_contract": q_contract, "prediction_validation": q_predictions, "id_sets": q_sets, "distinct_configs": q_configs, "example_lookup": q_lookup, "win_tie_histogram": q_wins, "request_guard": q_guard,
    "prompt_render": q_prompts, "diff_similarity": q_likeness, "resolved_samples": q_resolved,
}

_K, _N = ", ".join(ledger.KEY), ", ".join(ledger.NAMESPACE)
_bad = lambda c: f"count_if(coalesce({c}, true))::BIGINT"
_TOKENS = f"list_filter(regexp_split_to_array({{}}, '{WS_SQL.replace('{', '{{').replace('}', '}}')}+'), lambda x: x <> '')"
_PLAIN = "replace(strip_accents(lower({})), 'đ', 'd')"
ORACLE = {
    "candidate_contract": f"SELECT count(*) AS n_rows, {_bad(f'original_source NOT IN {in_sql(SOURCES)}')} AS bad_source, {_bad('(' + clean_sql('candidate_text') + ' IS NOT NULL) <> (generation_status = ' + chr(39) + 'generated_text' + chr(39) + ')')} AS status_unlike_text, {_bad('isnan(model_a_confidence) OR model_a_confidence IS NULL')} AS no_confidence, {_bad('NOT regexp_matches(generation_config_hash, ' + chr(39) + '^[a-f0-9]{64}$' + chr(39) + ')')} AS bad_hash, {_bad('sequence_token_count < 1')} AS bad_count FROM candidates",
    "prediction_validation": f"WITH {evaluation._PRED}, x AS (SELECT p.*, {clean_sql('input_text')} AS gi FROM p LEFT JOIN gold USING (id)), t AS (SELECT model, count_if(n > 1)::BIGINT AS repeated_ids FROM (SELECT model, id, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1) SELECT model, count(*) AS n_rows, count_if(p = '')::BIGINT AS empty, count_if(i IS DISTINCT FROM gi)::BIGINT AS misaligned, any_value(repeated_ids) AS repeated_ids FROM x JOIN t USING (model) GROUP BY 1",
    "first_contract_faults": f"SELECT * FROM (SELECT DISTINCT id, array_to_string(list_filter([CASE WHEN coalesce(original_source NOT IN {in_sql(SOURCES)}, true) THEN 'bad_source' END, CASE WHEN coalesce(({clean_sql('candidate_text')} IS NOT NULL) <> (generation_status = 'generated_text'), true) THEN 'status_unlike_text' END, CASE WHEN coalesce(isnan(model_a_confidence) OR model_a_confidence IS NULL, true) THEN 'no_confidence' END], lambda x: x IS NOT NULL), ',') AS faults FROM candidates) WHERE faults <> '' ORDER BY id, faults LIMIT 10",
    "path_guard": "SELECT file_name, count(*) AS n, contains(lower(file_name), 'test') OR contains(lower(file_name), '_02') OR contains(lower(file_name), 'hos') AS forbidden FROM raw_source GROUP BY 1",
    "short_strata": "SELECT original_source, generation_status, 300 - count(*) AS missing FROM candidates WHERE original_source IS NOT NULL AND generation_status IS NOT NULL GROUP BY 1, 2 HAVING count(*) < 300",
    "id_sets": "WITH a AS (SELECT DISTINCT id, 1 AS a FROM corpus), b AS (SELECT DISTINCT id, 1 AS b FROM candidates) SELECT count_if(a IS NOT NULL AND b IS NOT NULL)::BIGINT AS common, count_if(b IS NULL)::BIGINT AS missing, count_if(a IS NULL)::BIGINT AS \"foreign\", count_if(a IS NULL) = 0 AS subset FROM a FULL JOIN b USING (id)",
    "distinct_configs": "SELECT original_source, string_agg(DISTINCT candidate_checkpoint, ',' ORDER BY candidate_checkpoint) AS checkpoints, string_agg(DISTINCT generation_config_hash, ',' ORDER BY generation_config_hash) AS configs FROM candidates GROUP BY 1",
    "example_lookup": "SELECT place, id, input_text FROM (VALUES " + ", ".join(f"({i}::BIGINT, {x})" for i, x in enumerate(LOOKUP)) + ") w(place, n) LEFT JOIN corpus ON try_cast(regexp_extract(id, '(\\d+)$', 1) AS INT) = n",
    "win_tie_histogram": f"SELECT winner, count(*) AS n FROM ({evaluation.ORACLE['pairwise_winner']}) GROUP BY 1",
    "request_guard": f"SELECT CASE WHEN {clean_sql('input_text')} IS NULL THEN 'empty' WHEN len(list_filter(regexp_split_to_array(input_text, '{WS_SQL}+'), lambda x: x <> '')) > {LIMIT} THEN 'too_long' ELSE 'ok' END AS fate, count(*) AS n FROM corpus GROUP BY 1",
    "prompt_render": """WITH c AS (SELECT id, input_text, candidate_text FROM candidates WHERE id NOT IN (SELECT sample_id FROM review_results) QUALIFY row_number() OVER (PARTITION BY id ORDER BY input_text DESC NULLS LAST, candidate_text DESC NULLS LAST) = 1), r AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 15 AS b FROM c),
 j AS (SELECT b, id, '  {' || chr(10) || '    "id": ' || to_json(id) || ',' || chr(10) || '    "source": ' || coalesce(to_json(input_text)::VARCHAR, 'null') || ',' || chr(10) || '    "candidate": ' || coalesce(to_json(candidate_text)::VARCHAR, 'null') || chr(10) || '  }' AS s FROM r)
 SELECT b::BIGINT AS batch_no, 'Review these samples:' || chr(10) || '[' || chr(10) || string_agg(s, ',' || chr(10) ORDER BY id) || chr(10) || ']' || chr(10) AS prompt FROM j GROUP BY 1""",
    "diff_similarity": f"""WITH g AS (SELECT {_TOKENS.format("input_text")} AS a, {_TOKENS.format("target_text")} AS b FROM gold), p AS (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM g),
 e AS (SELECT DISTINCT a[i] AS src, t FROM (SELECT a, i, b[i:i] AS t FROM p UNION ALL SELECT a, i, b[i:i + 1] FROM p) WHERE len(t) > 0),
 n AS (SELECT src, array_to_string(t, ' ') AS tgt, {_PLAIN.format("src")} AS s, list_transform(t, lambda x: {_PLAIN.format("x")}) AS w FROM e), q AS (SELECT *, array_to_string(w, ' ') AS t1, array_to_string(w, '') AS t0, array_to_string(list_transform(w, lambda x: x[1]), '') AS ini FROM n),
 {evaluation._LEV.replace("RECURSIVE lev", "toks AS (SELECT DISTINCT {'x': s, 'y': y} AS k, string_split(s, '') AS a, string_split(y, '') AS b FROM (SELECT s, t0 AS y FROM q UNION SELECT s, t1 FROM q)), lev")},
 z AS (SELECT q.*, least(x.distance, y.distance) AS d, regexp_replace(s, '[aeiouy]', '', 'g') AS bs, regexp_replace(t0, '[aeiouy]', '', 'g') AS bt FROM q JOIN dist x ON x.k = {{'x': s, 'y': t0}} JOIN dist y ON y.k = {{'x': s, 'y': t1}}),
 v AS (SELECT *, greatest(0, 1 - d / greatest(length(s), length(t0), 1)) AS near FROM z)
 SELECT src, tgt, round(CASE WHEN s = t1 OR s = t0 THEN 1.0 WHEN s = ini THEN 0.95 WHEN len(w) > 1 AND s = w[1][1] || array_to_string(w[2:], '') THEN 0.92 WHEN bs <> '' AND bs = bt THEN greatest(near, 0.85) ELSE near END, 9)::DOUBLE AS similarity FROM v""".replace("WITH g", "WITH RECURSIVE g", 1),
    "resolved_samples": f"WITH s AS (SELECT DISTINCT {_N}, unnest(from_json(sample_ids_json, '[\"VARCHAR\"]')) AS sample_id FROM review_attempts), r AS (SELECT DISTINCT {_K}, 1 AS done FROM review_results) SELECT {_N}, count(*) AS n_samples, count(done) AS n_resolved FROM s LEFT JOIN r USING ({_K}) GROUP BY {_N}",
}
