"""Queries of problems 8, 9 and 10: tokens, packing, shared spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import written
from . import packing, shared_spans, tokens
from .common import read


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def p8_ids(spark, d):
    return tokens.encode(_docs(spark, d), "doc_id", "text")


def p8_roundtrip(spark, d):
    """How many texts come back exactly from their ids, and the tokens they took."""
    docs, ids = _docs(spark, d), p8_ids(spark, d)
    back = tokens.decode(ids, "doc_id").withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").join(ids, "doc_id").agg(
        F.count("*").alias("n_texts"), F.count_if(F.coalesce("text", F.lit("")) == F.col("back")).alias("n_exact"), F.sum(F.size("ids")).alias("n_tokens"))


def p8_decoded(spark, d):
    """Every text as its ids decode it."""
    return tokens.decode(p8_ids(spark, d), "doc_id")


def p9_pack(spark, d):
    sizes = p8_ids(spark, d).select("doc_id", F.size("ids").alias("n"))
    return packing.pack(written(sizes, "sizes"), "doc_id", "n")


def p9_report(spark, d):
    """Containers by length, and the share of their space left unused."""
    c = p9_pack(spark, d).groupBy("container", "length").agg(F.sum("size").alias("used"))
    return c.groupBy("length").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.round(1 - F.sum("used") / F.sum("length"), 9).alias("unused_share"))


def p9_tradeoff(spark, d):
    """What a container costs besides its length, against containers and unused space; last, containers of one length."""
    sizes = p8_ids(spark, d).select("doc_id", F.size("ids").alias("n"))
    counts = packing.histogram(packing.pieces(sizes, "doc_id", "n", max(packing.LENGTHS)))
    kinds = [(f"overhead {o}", packing.LENGTHS, o) for o in (0, 64, 256, 1024, 2048)] + [("one length", packing.LENGTHS[-1:], None)]
    rows = [(k, *packing.outline(counts, x, o).values()) for k, x, o in kinds]
    return spark.createDataFrame(rows, "setting string, n_containers long, capacity long, unused_share double")


def p9_sound(spark, d):
    """Packing by the number of characters: pieces and their sum, and what must not be: containers too full, texts cut that
    fit, containers more than a hundredth above the least number."""
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    p = written(packing.pack(docs, "doc_id", "n"), "packed")
    full = p.groupBy("container", "length").agg(F.sum("size").alias("used"))
    a = full.agg(F.count_if(F.col("used") > F.col("length")).alias("too_full"), (F.count("*") <= F.ceil(1.01 * F.sum("used") / 2048) + 1).alias("near_least")).withColumn("_one", F.lit(1))
    b = p.agg(F.count("*").alias("n_pieces"), F.sum("size").cast("long").alias("total"), F.count_if((F.col("piece") > 0) & (F.col("start") % 2048 != 0)).alias("cut_elsewhere")).withColumn("_one", F.lit(1))
    return a.join(b, "_one").drop("_one")


def p10_found(spark, d):
    return shared_spans.shared(_docs(spark, d), "doc_id", "text").select("doc_id")


def p10_shares(spark, d):
    """Of every document the share of its characters that also stands elsewhere."""
    s = shared_spans.shared(_docs(spark, d), "doc_id", "text").select("doc_id", "n_shared")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    out = _docs(spark, d).select("doc_id", n.alias("n_chars")).join(s, "doc_id", "left")
    return out.select("doc_id", "n_chars", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.round(F.coalesce(F.try_divide("n_shared", "n_chars"), F.lit(0.0)), 9).alias("share"))


QUERIES = {"p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p8_decoded": p8_decoded, "p9_pack": p9_pack, "p9_report": p9_report, "p9_tradeoff": p9_tradeoff, "p9_sound": p9_sound, "p10_found": p10_found, "p10_shares": p10_shares}

_P10 = """WITH w AS (SELECT doc_id, k, text[k:k + 119] AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS k FROM documents WHERE length(text) >= 120)),
 c AS (SELECT doc_id, k FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1)), n AS (SELECT doc_id, sum(least(k - coalesce(p, k - 120), 120))::BIGINT AS n_shared FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM c) GROUP BY 1)"""
ORACLE = {
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_sound": "SELECT 0::BIGINT AS too_full, true AS near_least, sum(greatest(1, (coalesce(n_chars, 0) + 2047) // 2048))::BIGINT AS n_pieces, sum(coalesce(n_chars, 0))::BIGINT AS total, 0::BIGINT AS cut_elsewhere FROM documents",
    "p10_found": f"{_P10} SELECT doc_id FROM n",
    "p10_shares": f"{_P10} SELECT doc_id, length(coalesce(text, '')) AS n_chars, coalesce(n_shared, 0) AS n_shared, round(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE coalesce(n_shared, 0) / length(text) END, 9)::DOUBLE AS share FROM documents LEFT JOIN n USING (doc_id)",
}
