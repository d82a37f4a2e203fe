"""Queries of evaluation and weak labels.

Predictions are derived from gold pairs alike in both engines: model_a leaves the input, model_b gives the target for
half of the rows, model_c the first half of the target's tokens and the rest of the input's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits as D
from ..functions.text import clean_text
from ..operators import curate, guards, ledger
from ..operators import evaluate as E
from ..operators import weak as W
from ..operators.ranking import rank_within
from .common import WS_SQL, bucket, bucket_sql, clean_sql, read
from .sampling import _W as _BANDS_SQL
from .sampling import _banded

SEED, REPLICATES, RESAMPLES = 2026, 200, 2000


def _predictions(spark, d):
    g = read(spark, d, "gold").where("split <> 'train'").select("id", clean_text("input_text").alias("input_text"), clean_text("target_text").alias("target_text")).where("input_text is not null and target_text is not null")
    i, t = F.split("input_text", " "), F.split("target_text", " ")
    half = F.floor(F.size(t) / 2).cast("int")
    mixed = F.array_join(F.concat(F.slice(t, F.lit(1), half), F.slice(i, half + 1, F.greatest(F.size(i) - half, F.lit(0)))), " ")
    b = F.when(F.expr(bucket("id", 2)) == 0, F.col("target_text")).otherwise(F.col("input_text"))
    return g.select("id", "input_text", "target_text", F.explode(F.array(F.struct(F.lit("model_a").alias("model"), F.col("input_text").alias("p")), F.struct(F.lit("model_b").alias("model"), b.alias("p")), F.struct(F.lit("model_c").alias("model"), mixed.alias("p")))).alias("x")).select(
        "id", "input_text", "target_text", "x.model", F.col("x.p").alias("prediction_text"))


def _built(spark, d):
    """Pairs and predictions whose edits are known: the tokens of a target are numbered, hence unlike each other; of every
    six the first is edited in the target, of every twelve the first by model_c, which wrongly edits each fourth of six."""
    g = read(spark, d, "gold").select("id", D.tokens(F.col("target_text")).alias("w")).where("size(w) > 0")
    tok = lambda edit: F.array_join(F.transform("w", lambda x, i: edit(F.concat(x, F.lit("#"), i.cast("string")), i)), " ")
    x = g.select("id", tok(lambda x, i: x).alias("input_text"), tok(lambda x, i: F.when(i % 6 == 0, F.concat(x, F.lit("!"))).otherwise(x)).alias("target_text"), tok(lambda x, i: F.when(i % 12 == 0, F.concat(x, F.lit("!"))).when(i % 6 == 3, F.concat(x, F.lit("?"))).otherwise(x)).alias("c"))
    b = F.when(F.expr(bucket("id", 2)) == 0, F.col("target_text")).otherwise(F.col("input_text"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), t.alias("p")) for m, t in (("model_a", F.col("input_text")), ("model_b", b), ("model_c", F.col("c")))])).alias("x")
    return x.select("id", "input_text", "target_text", each).select("id", "input_text", "target_text", "x.model", F.col("x.p").alias("prediction_text"))


def q_prf_deltas(spark, d):
    """What model_c gains over each other model in every metric, over pairs of known edits."""
    m = q_metrics(spark, d)
    p = lambda c, k: F.max(F.when(F.col("model") == k, F.col(c)))
    rows = [F.struct(F.lit(k).alias("against"), *[_r(p(c, "model_c") - p(c, k)).alias(f"d_{c}") for c in ("ERR", "precision", "recall", "f1", "exact_match")]) for k in ("model_a", "model_b")]
    return m.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def q_cells(spark, d):
    """Runs of each cell of seeds, sizes and horizons, those without any included."""
    e = read(spark, d, "events").where("value is not null").select((F.col("event_id") % 7).cast("int").alias("seed"), F.when(F.col("event_id") % 2 == 0, "S").otherwise("L").alias("size"), F.when(F.col("event_id") % 3 == 0, 3).otherwise(8).alias("horizon"))
    return guards.cells(e, {"seed": [*range(9)], "size": ["S", "L"], "horizon": [3, 8]})


def _r(c):
    return F.round(c, 9)


def q_levenshtein(spark, d):
    g = read(spark, d, "gold")
    return g.select("id", D.token_levenshtein(D.tokens(F.col("input_text")), D.tokens(F.col("target_text"))).alias("distance"))


def q_edits(spark, d):
    """Edits of pairs whose edits are known."""
    x = _built(spark, d).where("model = 'model_c'")
    return x.select("id", F.explode(D.token_edits("input_text", "prediction_text")).alias("e")).select("id", "e.src", "e.tgt")


def q_ratio(spark, d):
    """Of an id between signs that it does not hold the id is all that matches."""
    g = read(spark, d, "gold").select("id", F.expr(bucket("id", 7)).cast("int").alias("n"))
    return g.select("id", _r(D.char_edit_ratio("id", F.concat(F.expr("repeat('~', n)"), "id", F.lit("~~")))).alias("edit_ratio"))


def q_multiset(spark, d):
    g = read(spark, d, "gold")
    return g.select("id", E.multiset_common(D.tokens(F.col("input_text")), D.tokens(F.col("target_text"))).alias("common"))


def _error_metrics(spark, d):
    s = E.error_stats(_predictions(spark, d)).groupBy("model").agg(F.count("*").alias("n"), F.sum("lai_token_errors").alias("lai"), F.sum("system_token_errors").alias("sys"), F.sum("exact").alias("exact"))
    return s.select("model", "n", "lai", "sys", _r(E.err(F.col("lai"), F.col("sys"))).alias("ERR"), _r(E.ratio(F.col("exact"), F.col("n"))).alias("exact_match"))


def q_metrics(spark, d):
    """Edit metrics of predictions whose edits are known."""
    return E.metrics(E.row_stats(_built(spark, d)), ["model"])


def q_metrics_gold(spark, d):
    """Edit metrics of predictions over the gold pairs themselves."""
    return E.metrics(E.row_stats(_predictions(spark, d)), ["model"])


def q_ranking(spark, d):
    return E.ranking(q_metrics(spark, d)).select("model", "rank", _r("ERR").alias("ERR"), _r("f1").alias("f1"))


def q_two(spark, d):
    m = q_metrics(spark, d).where("model in ('model_a', 'model_b')")
    p = lambda c, k: F.max(F.when(F.col("model") == k, F.col(c)))
    x = m.agg(p("f1", "model_a").alias("fa"), p("f1", "model_b").alias("fb"), p("ERR", "model_a").alias("ea"), p("ERR", "model_b").alias("eb"))
    return x.select(E.two_model_rule(F.col("fa"), F.col("fb"), F.col("ea"), F.col("eb")).alias("x")).select("x.*")


def _categories(spark, d):
    return _predictions(spark, d).withColumn("category", E.category(F.col("input_text"), F.col("target_text"), F.col("prediction_text")))


def q_categories(spark, d):
    return _categories(spark, d).select("id", "model", "category")


def q_histogram(spark, d):
    return _categories(spark, d).groupBy("model", "category").agg(F.count("*").alias("n"))


def q_contingency(spark, d):
    return E.contingency(_predictions(spark, d).withColumn("exact", (F.col("prediction_text") == F.col("target_text")).cast("long")), "model_c", "model_b")


def q_deltas(spark, d):
    m = _error_metrics(spark, d)
    p = lambda c, k: F.max(F.when(F.col("model") == k, F.col(c)))
    return m.agg(*[_r(p(c, "model_c") - p(c, k)).alias(f"{c}_c_minus_{k[-1]}") for c in ("ERR", "exact_match") for k in ("model_a", "model_b")])


def q_winner(spark, d):
    """Per id whether model_c beats model_b by exactness."""
    x = _predictions(spark, d).withColumn("e", (F.col("prediction_text") == F.col("target_text")).cast("int")).groupBy("id").pivot("model", ["model_b", "model_c"]).agg(F.max("e"))
    return x.select("id", F.when(F.col("model_c") > F.col("model_b"), "model_c").when(F.col("model_c") < F.col("model_b"), "model_b").otherwise("tie").alias("winner"))


def q_bootstrap(spark, d):
    x = E.bootstrap(E.error_stats(_predictions(spark, d)), "model_c", "model_b", REPLICATES, SEED)
    return x.select("replicates", *[_r(c).alias(c) for c in ("mean", "low", "high")])


def q_bootstrap_deltas(spark, d):
    """The resamples that the published intervals have, of F1 and error reduction alike."""
    x = E.bootstrap(E.row_stats(_built(spark, d)), "model_c", "model_b", RESAMPLES, SEED)
    return x.select("metric", "replicates", *[_r(c).alias(c) for c in ("mean", "low", "high")])


def q_three_way(spark, d):
    return E.three_way(_predictions(spark, d)).drop("input_text", "target_text")


def q_first_errors(spark, d):
    e = _categories(spark, d).where("category <> 'correct'").select("model", "id", "category")
    return rank_within(e, ["model"], ["id"], "place").where("place <= 20").drop("place_n")


def _losses(spark, d):
    e = read(spark, d, "events").where("value is not null").select("user_id", "ts", "event_id", "value")
    return rank_within(e, ["user_id"], ["ts", "event_id"], "epoch").withColumnRenamed("epoch_n", "epochs")


def q_stopping(spark, d):
    return E.early_stopping(_losses(spark, d), "user_id", "epoch", "value", 2, 3, 1e-4)


def q_horizon(spark, d):
    return E.best_at_horizon(_losses(spark, d), "user_id", "epoch", "value", 4)


def q_windows(spark, d):
    """Mean loss of all, of the first and of the last quarter of a run."""
    x = _losses(spark, d)
    q = F.greatest(F.lit(1), F.floor(F.col("epochs") / 4))
    return x.groupBy("user_id").agg(_r(F.avg("value")).alias("mean_all"), _r(F.avg(F.when(F.col("epoch") <= q, F.col("value")))).alias("mean_first"), _r(F.avg(F.when(F.col("epoch") > F.col("epochs") - q, F.col("value")))).alias("mean_last"))


def q_factorial(spark, d):
    e = read(spark, d, "events").where("value is not null")
    x = e.select(F.when(F.col("event_id") % 2 == 0, "S").otherwise("L").alias("size"), F.when(F.col("event_id") % 3 == 0, 3).otherwise(8).alias("horizon"), "value")
    y = E.factorial_effects(x)
    return y.select(*[F.round(c, 6).alias(c) for c in y.columns])


def _reviewed(spark, d):
    c = read(spark, d, "candidates").groupBy("id").agg(F.max(F.struct("input_text", "candidate_text", "original_source")).alias("c")).select("id", "c.*")
    r = ledger.latest(read(spark, d, "review_results")).groupBy(F.col("sample_id").alias("id")).agg(F.max(F.struct("reviewed_at", "prompt_version", "prompt_hash", "llm_model", "decision", "corrected_text")).alias("r"))
    return c.join(r.select("id", "r.decision", "r.corrected_text"), "id", "left").withColumn("pos", F.col("id"))


def _weak(spark, d, max_edit):
    p = curate.protected_hashes(read(spark, d, "gold").where("split in ('dev', 'test')"), "input_text")
    return W.reasons(_reviewed(spark, d), p, max_edit=max_edit)


def q_weak(spark, d):
    return _weak(spark, d, None).select("id", "reason")


def q_weak_drops(spark, d):
    return _weak(spark, d, None).groupBy("reason").agg(F.count("*").alias("n"))


def q_weak_edit(spark, d):
    """The cascade with a bound on edited characters, over targets of known ratio: the input between foreign signs."""
    r = _reviewed(spark, d).where("input_text is not null and decision is not null").withColumn("input_text", F.col("id")).withColumn("n", F.expr(bucket("id", 5)).cast("int"))
    t = F.when(F.col("n") == 4, F.expr("repeat('~', length(id))")).otherwise(F.concat(F.col("id"), F.expr("repeat('~', n)")))
    r = r.withColumn("candidate_text", t).withColumn("corrected_text", t).withColumn("decision", F.lit("KEEP"))
    p = curate.protected_hashes(read(spark, d, "gold").where("split in ('dev', 'test')"), "id")
    return W.reasons(r, p, max_edit=0.1).select("id", "reason")


def q_weak_pivot(spark, d):
    x = _weak(spark, d, None).where("decision is not null")
    return x.groupBy("original_source").agg(*[F.count_if(F.col("decision") == k).alias(k.lower()) for k in ("KEEP", "EDIT", "REJECT")], F.count_if(F.col("reason") == "accepted").alias("accepted"))


def q_weak_band_pivot(spark, d):
    """Decisions by confidence band; -1 is a row without one."""
    b = _banded(spark, d).groupBy("id", "original_source").agg(F.max("band").alias("band"))
    x = _weak(spark, d, None).where("decision is not null").join(b, ["id", "original_source"], "left")
    return x.groupBy(F.coalesce("band", F.lit(-1).cast("long")).alias("band")).agg(*[F.count_if(F.col("decision") == k).alias(k.lower()) for k in ("KEEP", "EDIT", "REJECT")], F.count_if(F.col("reason") == "accepted").alias("accepted"))


def q_prefix(spark, d):
    """Accepted rows of the first half of ids against a union that was made anew, with some of their targets changed."""
    a = rank_within(_weak(spark, d, None).where("reason = 'accepted'").select("id", "input_text", "target_text"), [], ["id"], "pos").drop("pos_n")
    prior = a.where(F.col("pos") <= a.count() // 2)
    union = a.withColumn("target_text", F.when(F.expr(bucket("id", 10)) == 0, F.concat("target_text", F.lit("."))).otherwise(F.col("target_text")))
    return W.prefix_equal(prior, union, ["id", "input_text", "target_text"])


def q_diff(spark, d):
    """Both texts put together again from the blocks of their diff, and whether there is any change."""
    g = read(spark, d, "gold").select("id", D.text_diff("input_text", "target_text").alias("x"))
    whole = lambda s: F.array_join(F.transform("x", lambda b: F.concat(b[f"{s}_space"], b[s])), "")
    return g.select("id", whole("src").alias("input_text"), whole("tgt").alias("target_text"), F.exists("x", lambda b: b["group_id"].isNotNull()).alias("changed"))


def q_diff_kinds(spark, d):
    g = read(spark, d, "gold").select("id", F.explode(D.text_diff("input_text", "target_text")).alias("x"))
    return g.groupBy("x.kind").agg(F.count("*").alias("n"))


def q_lexical(spark, d):
    t = D.lexical_tokens(F.col("input_text"))
    return read(spark, d, "gold").select("id", F.array_join(F.transform(t, lambda x: x["text"]), "\x01").alias("tokens"), F.size(F.filter(t, lambda x: x["is_word"])).cast("long").alias("n_words"))


QUERIES = {
    "token_levenshtein": q_levenshtein, "token_edits": q_edits, "char_edit_ratio": q_ratio, "multiset_intersect": q_multiset, "metrics_err": _error_metrics, "metrics_edit_prf": q_metrics, "metrics_edit_gold": q_metrics_gold, "model_ranking": q_ranking, "two_model_rule": q_two, "metric_deltas": q_prf_deltas, "factorial_cells": q_cells,
    "error_categories": q_categories, "category_histogram": q_histogram, "pairwise_contingency": q_contingency, "model_deltas": q_deltas, "pairwise_winner": q_winner, "bootstrap_ci": q_bootstrap, "bootstrap_ci_deltas": q_bootstrap_deltas, "first_errors": q_first_errors, "three_way_report": q_three_way,
    "early_stopping": q_stopping, "best_at_horizon": q_horizon, "loss_windows": q_windows, "factorial_effects": q_factorial, "weak_label_reasons": q_weak, "weak_label_drop_counts": q_weak_drops, "weak_label_edit_ratio": q_weak_edit,
    "weak_label_pivots": q_weak_pivot, "weak_label_band_pivots": q_weak_band_pivot, "weak_union_prefix": q_prefix, "text_diff": q_diff, "text_diff_kinds": q_diff_kinds, "lexical_tokens": q_lexical,
}

_TOK = lambda c: f"list_filter(regexp_split_to_array({c}, '{WS_SQL}+'), lambda x: x <> '')"


_LEV = f"""RECURSIVE lev(k, a, b, i, p) AS (
 SELECT k, a, b, 0, range(len(b) + 1) FROM toks
 UNION ALL
 SELECT k, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: j + list_min(t[:j + 1])) FROM (
  SELECT k, a, b, i, list_transform(range(len(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(p[j + 1] + 1, p[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) - j END) AS t FROM lev WHERE i < len(a))),
dist AS (SELECT k, p[len(b) + 1] AS distance FROM lev WHERE i = len(a))"""
_PRED = f"""g AS (SELECT id, {clean_sql("input_text")} AS i, {clean_sql("target_text")} AS t FROM gold WHERE split <> 'train'),
p AS (SELECT id, i, t, 'model_a' AS model, i AS p FROM g WHERE i IS NOT NULL AND t IS NOT NULL UNION ALL
 SELECT id, i, t, 'model_b', CASE WHEN {bucket_sql("id", 2)} = 0 THEN t ELSE i END FROM g WHERE i IS NOT NULL AND t IS NOT NULL UNION ALL
 SELECT id, i, t, 'model_c', array_to_string(list_concat((split(t, ' '))[:len(split(t, ' ')) // 2], (split(i, ' '))[len(split(t, ' ')) // 2 + 1:]), ' ') FROM g WHERE i IS NOT NULL AND t IS NOT NULL)"""
_CAT = """c AS (SELECT id, model, CASE WHEN p = t THEN 'correct' WHEN i = t THEN 'over-normalization' WHEN p = i THEN 'missed' WHEN len(split(i, ' ')) < len(split(t, ' ')) THEN 'one-to-many' WHEN len(split(i, ' ')) > len(split(t, ' ')) THEN 'many-to-one' ELSE 'wrong' END AS category FROM p)"""
_STATS = f"""{_LEV.replace("RECURSIVE lev", f"RECURSIVE {_PRED}, toks AS (SELECT {{'id': id, 'm': model, 's': 's'}} AS k, split(p, ' ') AS a, split(t, ' ') AS b FROM p UNION ALL SELECT {{'id': id, 'm': model, 's': 'l'}}, split(i, ' '), split(t, ' ') FROM p), lev")},
st AS (SELECT p.id, p.model, max(CASE WHEN k.s = 'l' THEN distance END)::BIGINT AS lai, max(CASE WHEN k.s = 's' THEN distance END)::BIGINT AS sys, max((p.p = p.t)::INT)::BIGINT AS exact FROM p JOIN dist ON k.id = p.id AND k.m = p.model GROUP BY 1, 2),
m AS (SELECT model, count(*) AS n, sum(lai)::BIGINT AS lai, sum(sys)::BIGINT AS sys, sum(exact) AS ex FROM st GROUP BY 1),
mm AS (SELECT model, n, lai, sys, round(CASE WHEN lai = 0 THEN 0 ELSE (lai - sys) / lai END, 9) AS "ERR", round((ex / n)::DOUBLE, 9) AS exact_match FROM m)"""
_LOSS = "l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, count(*) OVER (PARTITION BY user_id) AS epochs FROM events WHERE value IS NOT NULL)"
_WEAK = f"""r0 AS (SELECT * FROM review_results QUALIFY row_number() OVER (PARTITION BY sample_id, prompt_version, prompt_hash, llm_model ORDER BY reviewed_at DESC, prompt_hash DESC, batch_id DESC, decision DESC, corrected_text DESC NULLS LAST, reason_code DESC NULLS LAST) = 1),
r AS (SELECT sample_id AS id, decision, corrected_text FROM r0 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY reviewed_at DESC, prompt_version DESC, prompt_hash DESC, llm_model DESC, decision DESC, corrected_text DESC NULLS LAST) = 1),
c AS (SELECT id, input_text, candidate_text, original_source FROM candidates QUALIFY row_number() OVER (PARTITION BY id ORDER BY input_text DESC NULLS LAST, candidate_text DESC NULLS LAST, original_source DESC NULLS LAST) = 1),
h AS (SELECT DISTINCT {clean_sql("input_text")} AS t FROM gold WHERE split IN ('dev', 'test') AND {clean_sql("input_text")} IS NOT NULL),
x AS (SELECT c.*, decision, CASE WHEN decision = 'KEEP' THEN {clean_sql("candidate_text")} ELSE {clean_sql("corrected_text")} END AS target, {clean_sql("input_text")} IN (SELECT t FROM h) AS prot FROM c LEFT JOIN r USING (id)),
y AS (SELECT *, CASE WHEN decision IS NULL THEN 'missing_valid_review' WHEN decision = 'REJECT' THEN 'llm_reject' WHEN target IS NULL THEN 'empty_target' WHEN starts_with(target, '{{') OR starts_with(target, '[') OR starts_with(target, '```') OR contains(target, '"decision"') THEN 'response_artifact' WHEN prot THEN 'protected_overlap' END AS early,
 CASE WHEN length(target) / greatest(1, length(input_text)) NOT BETWEEN 0.5 AND 2.0 THEN 'length_ratio' END AS late FROM x),
z AS (SELECT *, min(CASE WHEN early IS NULL AND late IS NULL THEN id END) OVER (PARTITION BY input_text) AS first_ok FROM y),
w AS (SELECT id, original_source, decision, coalesce(early, CASE WHEN first_ok < id THEN 'duplicate_input' END, late, 'accepted') AS reason FROM z)"""
_ROW_SQL = f"(('0x' || substr(md5('{SEED}:' || id), 1, 8))::BIGINT % {E.PRIME})"
# draws of the table "each" (row x, replicate rep) by the same squarings
_DRAWS = f"""e1 AS (SELECT *, (x + (rep + 1) * 1664525) % {E.PRIME} AS a FROM each), e2 AS (SELECT *, (a * a + x) % {E.PRIME} AS b2 FROM e1), e3 AS (SELECT *, (b2 * b2 + rep + 1) % {E.PRIME} AS c2 FROM e2), e4 AS (SELECT *, (c2 * 48271) % {E.PRIME} AS u FROM e3),
 d AS (SELECT *, {" + ".join(f"(u >= {int(p * E.PRIME)})::INT" for p in E.POISSON)} AS w FROM e4)"""
_INTERVAL = "o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY delta, rep) - 1 AS k, count(*) OVER (PARTITION BY metric) AS n FROM q), i AS (SELECT metric, count(*) AS replicates, round(avg(delta), 9) AS mean, round(max(CASE WHEN k = floor(0.025 * (n - 1)) THEN delta END), 9) AS low, round(max(CASE WHEN k = floor(0.975 * (n - 1)) THEN delta END), 9) AS high FROM o GROUP BY 1)"
_f1_sql = lambda g, p, c: f"CASE WHEN {g} + {p} = 0 OR {c} = 0 THEN 0 ELSE 2 * ({c} / nullif({p}, 0)) * ({c} / nullif({g}, 0)) / ({c} / nullif({p}, 0) + {c} / nullif({g}, 0)) END"
_NUMBERED = f"w AS (SELECT id, {_TOK('target_text')} AS w FROM gold), t AS (SELECT id, w[i + 1] || '#' || i AS t, i FROM (SELECT id, w, unnest(range(len(w))) AS i FROM w))"
# of n numbered tokens: edits of the target, those of model_c that are right and wrong, whether model_b has them all
_BUILT = f"k AS (SELECT id, (n + 5) // 6 AS n6, (n + 11) // 12 AS n12, (n + 2) // 6 AS n3, CASE WHEN {bucket_sql('id', 2)} = 0 THEN 1 ELSE 0 END AS b FROM (SELECT id, len({_TOK('target_text')}) AS n FROM gold) WHERE n > 0)"
_BUILT_METRICS = f"""{_BUILT}, r AS (SELECT 'model_a' AS model, n6 AS g, 0 AS p, 0 AS c, n6 AS e FROM k UNION ALL SELECT 'model_b', n6, b * n6, b * n6, (1 - b) * n6 FROM k UNION ALL SELECT 'model_c', n6, n12 + n3, n12, n6 - n12 + n3 FROM k),
 z AS (SELECT model, count(*) AS sample_count, sum(g)::BIGINT AS gold_edits, sum(p)::BIGINT AS predicted_edits, sum(c)::BIGINT AS correct_edits, sum(g)::BIGINT AS lai_token_errors, sum(e)::BIGINT AS system_token_errors, count_if(e = 0) AS x FROM r GROUP BY 1),
 m AS (SELECT * EXCLUDE (x), CASE WHEN gold_edits = 0 THEN 0 ELSE (lai_token_errors - system_token_errors) / lai_token_errors END AS "ERR", CASE WHEN predicted_edits = 0 THEN 0 ELSE correct_edits / predicted_edits END AS precision, CASE WHEN gold_edits = 0 THEN 0 ELSE correct_edits / gold_edits END AS recall, {_f1_sql("gold_edits", "predicted_edits", "correct_edits")} AS f1, (x / sample_count)::DOUBLE AS exact_match FROM z)"""
_LEX_SQL = r"[\t-\r\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_lex = lambda c: f"regexp_extract_all({c}, '[^{_LEX_SQL[1:-1]}\\p{{P}}]+|\\p{{P}}')"
ORACLE = {
    "token_levenshtein": f"WITH {_LEV.replace('RECURSIVE lev', 'RECURSIVE toks AS (SELECT id AS k, ' + _TOK('input_text') + ' AS a, ' + _TOK('target_text') + ' AS b FROM gold), lev')} SELECT k AS id, distance::BIGINT AS distance FROM dist",
    "multiset_intersect": f"WITH x AS (SELECT id, {_TOK('input_text')} AS a, {_TOK('target_text')} AS b FROM gold), u AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(a) AS w FROM x) GROUP BY ALL), v AS (SELECT id, w, count(*) AS m FROM (SELECT id, unnest(b) AS w FROM x) GROUP BY ALL) SELECT id, coalesce(sum(least(n, m)), 0)::BIGINT AS common FROM gold LEFT JOIN (SELECT * FROM u JOIN v USING (id, w)) USING (id) GROUP BY 1",
    "metrics_err": f"WITH {_STATS} SELECT * FROM mm",
    "error_categories": f"WITH {_PRED}, {_CAT} SELECT * FROM c",
    "category_histogram": f"WITH {_PRED}, {_CAT} SELECT model, category, count(*) AS n FROM c GROUP BY ALL",
    "pairwise_contingency": f"WITH {_PRED}, e AS (SELECT id, max(CASE WHEN model = 'model_c' THEN (p = t)::INT END) AS a, max(CASE WHEN model = 'model_b' THEN (p = t)::INT END) AS b FROM p GROUP BY 1) SELECT count_if(a = 1 AND b = 0)::BIGINT AS win, count_if(a = 0 AND b = 1)::BIGINT AS loss, count_if(a = 1 AND b = 1)::BIGINT AS both_right, count_if(a = 0 AND b = 0)::BIGINT AS both_wrong FROM e",
    "pairwise_winner": f"WITH {_PRED}, e AS (SELECT id, max(CASE WHEN model = 'model_c' THEN (p = t)::INT END) AS a, max(CASE WHEN model = 'model_b' THEN (p = t)::INT END) AS b FROM p GROUP BY 1) SELECT id, CASE WHEN a > b THEN 'model_c' WHEN a < b THEN 'model_b' ELSE 'tie' END AS winner FROM e",
    "model_deltas": f"WITH {_STATS}, v AS (SELECT max(CASE WHEN model = 'model_a' THEN \"ERR\" END) AS ea, max(CASE WHEN model = 'model_b' THEN \"ERR\" END) AS eb, max(CASE WHEN model = 'model_c' THEN \"ERR\" END) AS ec, max(CASE WHEN model = 'model_a' THEN exact_match END) AS xa, max(CASE WHEN model = 'model_b' THEN exact_match END) AS xb, max(CASE WHEN model = 'model_c' THEN exact_match END) AS xc FROM mm) SELECT round(ec - ea, 9) AS \"ERR_c_minus_a\", round(ec - eb, 9) AS \"ERR_c_minus_b\", round(xc - xa, 9) AS exact_match_c_minus_a, round(xc - xb, 9) AS exact_match_c_minus_b FROM v",
    "bootstrap_ci": f"""WITH {_STATS}, x AS (SELECT id, max(lai) AS lai, max(CASE WHEN model = 'model_c' THEN sys END) AS ea, max(CASE WHEN model = 'model_b' THEN sys END) AS eb FROM st WHERE model IN ('model_b', 'model_c') GROUP BY id),
 each AS (SELECT {_ROW_SQL} AS x, rep, lai, ea, eb FROM x, range({REPLICATES}) a(rep)), {_DRAWS},
 s AS (SELECT rep, sum(w * lai)::DOUBLE AS lai, sum(w * ea)::DOUBLE AS ea, sum(w * eb)::DOUBLE AS eb FROM d GROUP BY 1), q AS (SELECT 'ERR' AS metric, rep, CASE WHEN lai = 0 THEN 0 ELSE (lai - ea) / lai - (lai - eb) / lai END AS delta FROM s), {_INTERVAL}
 SELECT replicates, mean, low, high FROM i""",
    "bootstrap_ci_deltas": f"""WITH {_BUILT}, each AS (SELECT {_ROW_SQL} AS x, rep, n6, n12, n3, b FROM k, range({RESAMPLES}) r(rep)), {_DRAWS},
 s AS (SELECT rep, sum(w * n6)::DOUBLE AS g, sum(w * (n12 + n3))::DOUBLE AS pc, sum(w * n12)::DOUBLE AS cc, sum(w * b * n6)::DOUBLE AS pb, sum(w * (n6 - n12 + n3))::DOUBLE AS ec, sum(w * (1 - b) * n6)::DOUBLE AS eb FROM d GROUP BY 1),
 q AS (SELECT 'f1' AS metric, rep, {_f1_sql("g", "pc", "cc")} - {_f1_sql("g", "pb", "pb")} AS delta FROM s UNION ALL SELECT 'ERR', rep, CASE WHEN g = 0 THEN 0 ELSE (g - ec) / g - (g - eb) / g END FROM s), {_INTERVAL}
 SELECT * FROM i""",
    "token_edits": f"WITH {_NUMBERED} SELECT id, t AS src, t || CASE WHEN i % 12 = 0 THEN '!' ELSE '?' END AS tgt FROM t WHERE i % 12 = 0 OR i % 6 = 3",
    "char_edit_ratio": f"SELECT id, round(1 - 2.0 * length(id) / (2 * length(id) + 2 + {bucket_sql('id', 7)}), 9)::DOUBLE AS edit_ratio FROM gold",
    "metrics_edit_prf": f"WITH {_BUILT_METRICS} SELECT * FROM m",
    "model_ranking": f"WITH {_BUILT_METRICS} SELECT model, row_number() OVER (ORDER BY \"ERR\" DESC, f1 DESC, exact_match DESC, model = 'model_a' DESC) AS rank, round(\"ERR\", 9) AS \"ERR\", round(f1, 9) AS f1 FROM m",
    "two_model_rule": f"WITH {_BUILT_METRICS}, v AS (SELECT max(CASE WHEN model = 'model_a' THEN f1 END) AS fa, max(CASE WHEN model = 'model_b' THEN f1 END) AS fb, max(CASE WHEN model = 'model_a' THEN \"ERR\" END) AS ea, max(CASE WHEN model = 'model_b' THEN \"ERR\" END) AS eb FROM m) SELECT CASE WHEN fa > fb THEN 'model_a' WHEN fb > fa THEN 'model_b' WHEN ea > eb THEN 'model_a' WHEN eb > ea THEN 'model_b' ELSE 'model_a' END AS winner, CASE WHEN fa <> fb THEN 'higher_f1' WHEN ea <> eb THEN 'higher_ERR' ELSE 'model_a' END AS criterion FROM v",
    "metric_deltas": f"WITH {_BUILT_METRICS} SELECT m.model AS against, " + ", ".join(f'round(c."{c}" - m."{c}", 9) AS "d_{c}"' for c in ("ERR", "precision", "recall", "f1", "exact_match")) + " FROM m, m c WHERE c.model = 'model_c' AND m.model <> 'model_c'",
    "factorial_cells": "SELECT seed::INT AS seed, size, horizon::INT AS horizon, count(event_id) AS n FROM range(9) a(seed), (VALUES ('S'), ('L')) b(size), (VALUES (3), (8)) h(horizon) LEFT JOIN events e ON value IS NOT NULL AND event_id % 7 = seed AND CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'L' END = size AND CASE WHEN event_id % 3 = 0 THEN 3 ELSE 8 END = horizon GROUP BY ALL",
    "three_way_report": f"""WITH {_PRED}, {_CAT}, v AS (SELECT p.id, any_value(t) AS t, {", ".join(f"max(CASE WHEN p.model = '{m}' THEN p END) AS {m}_prediction, max(CASE WHEN p.model = '{m}' THEN category END) AS {m}_category" for m in ("model_a", "model_b", "model_c"))} FROM p JOIN c ON c.id = p.id AND c.model = p.model GROUP BY p.id)
 SELECT * EXCLUDE (t), {", ".join(f"CASE WHEN (model_c_prediction = t)::INT > ({m}_prediction = t)::INT THEN 'model_c' WHEN (model_c_prediction = t)::INT < ({m}_prediction = t)::INT THEN '{m}' ELSE 'tie' END AS model_c_vs_{m[-1]}" for m in ("model_a", "model_b"))} FROM v""",
    "first_errors": f"WITH {_PRED}, {_CAT} SELECT model, id, category, row_number() OVER (PARTITION BY model ORDER BY id) AS place FROM c WHERE category <> 'correct' QUALIFY place <= 20",
    "best_at_horizon": f"WITH {_LOSS} SELECT user_id, epoch, value AS loss FROM l WHERE epoch <= 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, epoch) = 1",
    "loss_windows": f"WITH {_LOSS} SELECT user_id, round(avg(value), 9) AS mean_all, round(avg(CASE WHEN epoch <= greatest(1, epochs // 4) THEN value END), 9) AS mean_first, round(avg(CASE WHEN epoch > epochs - greatest(1, epochs // 4) THEN value END), 9) AS mean_last FROM l GROUP BY 1",
    "early_stopping": f"""WITH RECURSIVE {_LOSS}, r AS (SELECT user_id, 0::BIGINT AS epoch, 'Infinity'::DOUBLE AS best, NULL::BIGINT AS at_, 0 AS bad, NULL::BIGINT AS stop FROM l GROUP BY 1 UNION ALL
 SELECT r.user_id, l.epoch, CASE WHEN value < best - 1e-4 THEN value ELSE best END, CASE WHEN value < best - 1e-4 THEN l.epoch ELSE at_ END, CASE WHEN value < best - 1e-4 THEN 0 ELSE bad + 1 END, CASE WHEN (CASE WHEN value < best - 1e-4 THEN 0 ELSE bad + 1 END) >= 2 AND l.epoch >= 3 THEN l.epoch END
 FROM r JOIN l ON l.user_id = r.user_id AND l.epoch = r.epoch + 1 WHERE stop IS NULL)
 SELECT user_id, max_by(at_, epoch) AS best_epoch, max(epoch) AS stop_epoch FROM r GROUP BY 1""",
    "factorial_effects": """WITH x AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 'L' END AS size, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 8 END AS horizon, value FROM events WHERE value IS NOT NULL),
 m AS (SELECT avg(value) FILTER (size = 'S' AND horizon = 3) AS "S3", avg(value) FILTER (size = 'S' AND horizon = 8) AS "S8", avg(value) FILTER (size = 'L' AND horizon = 3) AS "L3", avg(value) FILTER (size = 'L' AND horizon = 8) AS "L8" FROM x)
 SELECT round("S3", 6) AS "S3", round("S8", 6) AS "S8", round("L3", 6) AS "L3", round("L8", 6) AS "L8", round("L3" - "S3", 6) AS effect_3, round("L8" - "S8", 6) AS effect_8, round(("L8" - "L3") - ("S8" - "S3"), 6) AS interaction FROM m""",
    "weak_label_reasons": f"WITH {_WEAK} SELECT id, reason FROM w",
    "weak_label_drop_counts": f"WITH {_WEAK} SELECT reason, count(*) AS n FROM w GROUP BY 1",
    "weak_label_pivots": f"WITH {_WEAK} SELECT original_source, count_if(decision = 'KEEP')::BIGINT AS keep, count_if(decision = 'EDIT')::BIGINT AS edit, count_if(decision = 'REJECT')::BIGINT AS reject, count_if(reason = 'accepted')::BIGINT AS accepted FROM w WHERE decision IS NOT NULL GROUP BY 1",
    "weak_label_band_pivots": f"WITH {_WEAK}, bands AS (WITH {_BANDS_SQL} SELECT id, original_source, max(band) AS band FROM b GROUP BY 1, 2) SELECT coalesce(band, -1)::BIGINT AS band, count_if(decision = 'KEEP')::BIGINT AS keep, count_if(decision = 'EDIT')::BIGINT AS edit, count_if(decision = 'REJECT')::BIGINT AS reject, count_if(reason = 'accepted')::BIGINT AS accepted FROM w LEFT JOIN bands USING (id, original_source) WHERE decision IS NOT NULL GROUP BY 1",
    "weak_label_edit_ratio": f"""WITH {_WEAK}, z2 AS (SELECT DISTINCT id, {bucket_sql("id", 5)} AS n FROM w WHERE decision IS NOT NULL AND id IN (SELECT id FROM c WHERE input_text IS NOT NULL))
 SELECT id, CASE WHEN n = 4 THEN 'edit_ratio' WHEN 1 - 2.0 * length(id) / (2 * length(id) + n) > 0.1 THEN 'edit_ratio' ELSE 'accepted' END AS reason FROM z2""",
    "weak_union_prefix": f"WITH {_WEAK}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS n FROM w WHERE reason = 'accepted') SELECT count(*) AS n_prior, count_if({bucket_sql('id', 10)} <> 0)::BIGINT AS n_same FROM a WHERE pos <= n // 2",
    "text_diff": f"SELECT id, input_text, target_text, input_text <> target_text AND ({_lex('input_text')} <> {_lex('target_text')}) AS changed FROM gold WHERE input_text IS NOT NULL AND target_text IS NOT NULL",
    "lexical_tokens": f"SELECT id, array_to_string({_lex('input_text')}, chr(1)) AS tokens, len(list_filter({_lex('input_text')}, lambda x: NOT regexp_matches(x, '^\\p{{P}}$'))) AS n_words FROM gold",
}
