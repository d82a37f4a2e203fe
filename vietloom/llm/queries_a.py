"""Queries of problems 1, 2 and 5: overlaps, copies, leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import formatting_dups, leaks, split_overlap
from .common import read, spread


def _overlaps(spark, d):
    return split_overlap.overlaps(spread(read(spark, d, "gold").select("id", "split", "input_text")), "id", "input_text", "split")


def p1_found(spark, d):
    o = _overlaps(spark, d)
    return o.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p1_coverage(spark, d):
    """Every overlapping evaluation record: training records it overlaps, and the largest share of its words that stand aligned in one."""
    best = _overlaps(spark, d).groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("n_train"), F.max(F.col("n_equal") / F.col("n_words")).alias("coverage"))
    g = read(spark, d, "gold").where("split in ('dev', 'test')").select("id", "split", "dataset")
    return g.join(best, "id").select("id", "split", "dataset", "n_train", F.round("coverage", 9).alias("coverage"))


def p1_report(spark, d):
    """Per split and dataset: records, overlapping ones, pairs, and the mean coverage of the overlapping ones."""
    hit = p1_coverage(spark, d).groupBy("split", "dataset").agg(F.count("*").alias("n_overlapping"), F.sum("n_train").alias("n_pairs"), F.avg("coverage").alias("mean_coverage"))
    all_ = read(spark, d, "gold").where("split in ('dev', 'test')").groupBy("split", "dataset").agg(F.count("*").alias("n_records"))
    on = all_["split"].eqNullSafe(hit["split"]) & all_["dataset"].eqNullSafe(hit["dataset"])
    n = lambda c: F.coalesce(hit[c], F.lit(0)).alias(c)
    return all_.join(hit, on, "left").select(all_["split"], all_["dataset"], "n_records", n("n_overlapping"), n("n_pairs"), F.round("mean_coverage", 9).alias("mean_coverage"))


def _raw(spark, d):
    r = read(spark, d, "raw_source").select("raw_id", F.from_json("payload", "input_text string, original_source string").alias("j"))
    return r.select("raw_id", "j.input_text", "j.original_source")


def p2_found(spark, d):
    c = formatting_dups.copies(_raw(spark, d), "raw_id", "input_text", "original_source")
    return c.select(F.col("first_id").alias("first_raw_id"), F.col("copy_id").alias("copy_raw_id"))


def p2_collapsed(spark, d):
    return formatting_dups.collapsed(_raw(spark, d), "raw_id", "input_text", "original_source").withColumnRenamed("first_id", "raw_id")


def p5_found(spark, d):
    g = spread(read(spark, d, "gold").where("split in ('dev', 'test')").select("id", "input_text", "target_text"))
    c = spread(read(spark, d, "corpus").select("id", "input_text"))
    return leaks.leaks(c, "id", "input_text", g, "id", ["input_text", "target_text"]).withColumnRenamed("item_id", "gold_id")


def p5_rates(spark, d):
    """Per source: records, records with a leak, leaked items."""
    hit = p5_found(spark, d).groupBy("corpus_id").agg(F.count("*").alias("items"))
    c = read(spark, d, "corpus").select(F.col("id").alias("corpus_id"), "original_source")
    return c.join(hit, "corpus_id", "left").groupBy("original_source").agg(
        F.count("*").alias("n_records"), F.count("items").alias("n_leaking"), F.round(F.count("items") / F.count("*"), 9).alias("rate"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_links"))


QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p1_report": p1_report, "p2_found": p2_found, "p2_collapsed": p2_collapsed, "p5_found": p5_found, "p5_rates": p5_rates}

_FOLD = r"regexp_replace(lower(nfc_normalize(coalesce({c}, ''))), '[\p{P}\p{Z}\p{C}$+<=>^`|~\x{FE0E}\x{FE0F}]', '', 'g')"
_WORDS = r"list_filter(regexp_split_to_array(replace(strip_accents(lower({c})), 'đ', 'd'), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_P5 = f"""WITH c AS (SELECT id, {_WORDS.replace("{c}", "input_text")} AS w FROM corpus), g AS (SELECT id, {_WORDS.replace("{c}", "t")} AS w FROM (SELECT id, unnest([input_text, target_text]) AS t FROM gold WHERE split IN ('dev', 'test'))),
 cw AS (SELECT DISTINCT id, array_to_string(w[k:k + 13], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 12)) AS k FROM c WHERE len(w) >= 14)),
 gw AS (SELECT DISTINCT id, array_to_string(w[k:k + 13], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 12)) AS k FROM g WHERE len(w) >= 14)),
 p5 AS (SELECT DISTINCT cw.id AS corpus_id, gw.id AS gold_id FROM cw JOIN gw USING (s))"""
_P2 = f"""WITH x AS (SELECT raw_id, payload->>'input_text' AS t, payload->>'original_source' AS s FROM raw_source), k AS (SELECT raw_id, {_FOLD.replace("{c}", "t")} AS t, CASE WHEN s IS NOT NULL THEN {_FOLD.replace("{c}", "s")} END AS s FROM x WHERE regexp_matches(t, '[^\\s\\p{{Z}}\\p{{C}}]')),
 f AS (SELECT min(raw_id) OVER (PARTITION BY t, s) AS first_raw_id, raw_id, count(*) OVER (PARTITION BY t, s) AS n FROM k)"""
# every pair that shares enough words, then the whole edit distance in words, row by row
_SQUEEZE = "array_to_string(list_filter(string_split({c}, ''), lambda x, i: i = 1 OR x <> string_split({c}, '')[i - 1] OR NOT regexp_matches(x, '\\p{L}')), '')"
_FOLDED = "replace(strip_accents(lower(input_text)), 'đ', 'd')"
_P1 = f"""WITH RECURSIVE r AS (SELECT id, split = 'train' AS train, list_filter(regexp_split_to_array({_SQUEEZE.replace("{c}", "f")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT id, split, {_FOLDED} AS f FROM gold WHERE split IN ('train', 'dev', 'test') AND id IS NOT NULL)),
 u AS (SELECT id, train, len(w) AS n, x, count(*) AS k FROM (SELECT id, train, w, unnest(w) AS x FROM r) GROUP BY ALL),
 c AS (SELECT e.id AS e, t.id AS t FROM u e JOIN u t ON e.x = t.x AND NOT e.train AND t.train AND abs(e.n - t.n) * 4 <= greatest(e.n, t.n) GROUP BY 1, 2, e.n, t.n HAVING sum(least(e.k, t.k)) >= greatest(e.n, t.n) - greatest(e.n, t.n) // 4),
 lev(e, t, a, b, i, p) AS (SELECT e, t, x.w, y.w, 0, range(len(y.w) + 1) FROM c JOIN r x ON x.id = e JOIN r y ON y.id = t WHERE NOT x.train AND y.train
  UNION ALL SELECT e, t, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: j + list_min(s[:j + 1])) FROM (
   SELECT e, t, a, b, i, list_transform(range(len(b) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(p[j + 1] + 1, p[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END) - j END) AS s FROM lev WHERE i < len(a)))
 SELECT DISTINCT least(e, t) AS id_a, greatest(e, t) AS id_b FROM lev WHERE i = len(a) AND p[len(b) + 1] * 4 <= greatest(len(a), len(b))"""
ORACLE = {
    "p1_found": _P1,
    "p2_found": f"{_P2} SELECT first_raw_id, raw_id AS copy_raw_id FROM f WHERE raw_id <> first_raw_id",
    "p2_collapsed": f"{_P2} SELECT raw_id, n AS n_copies FROM f WHERE raw_id = first_raw_id",
    "p5_found": f"{_P5} SELECT * FROM p5",
    "p5_rates": f"{_P5}, h AS (SELECT corpus_id, count(*) AS n FROM p5 GROUP BY 1) SELECT original_source, count(*) AS n_records, count(n) AS n_leaking, round(count(n) / count(*), 9) AS rate, coalesce(sum(n), 0)::BIGINT AS n_links FROM corpus LEFT JOIN h ON h.corpus_id = corpus.id GROUP BY 1",
}
