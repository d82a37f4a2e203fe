"""Audits, inventories and digests."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys, compact, non-ASCII kept; null fields are written as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical(value: Any) -> str:
    """JSON with sorted keys, compact, non-ASCII kept, of a value on the driver."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha256_of(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def run_audit(c: DataFrame) -> DataFrame:
    """One row of checks over candidate rows, and whether all of them hold."""
    text = F.length(F.trim(F.coalesce("candidate_text", F.lit("")))) > 0
    ids = c.groupBy("id").agg(F.count("*").alias("n"))
    a = c.agg(
        F.count("*").alias("n_rows"),
        F.bool_and(F.col("model_a_confidence").isNotNull() & ~F.isnan("model_a_confidence")).alias("confidence_finite"),
        F.bool_and((F.col("generation_status") == "generated_text") == text).alias("status_fits_text"),
        F.bool_and(F.col("generation_config_hash").rlike("^[a-f0-9]{64}$")).alias("hash_form"),
        F.bool_and(F.col("sequence_token_count") >= 1).alias("token_count_positive"),
        F.countDistinct("generation_config_hash").alias("n_configs"), F.countDistinct("candidate_checkpoint").alias("n_checkpoints"),
    ).withColumn("_one", F.lit(1))
    b = ids.agg(F.count("*").alias("n_ids"), F.count_if(F.col("n") > 1).alias("n_repeated_ids")).withColumn("_one", F.lit(1))
    x = a.join(b, "_one").drop("_one").withColumn("ids_unique", F.col("n_repeated_ids") == 0)
    return x.withColumn("passed", F.col("confidence_finite") & F.col("status_fits_text") & F.col("hash_form") & F.col("token_count_positive") & F.col("ids_unique"))


def audit(inputs: DataFrame, candidates: DataFrame, manifest: DataFrame, provenance: list[str], config_hash: str | None = None, chunk: int = 1000, n_inputs: int | None = None, n_manifest: int | None = None) -> DataFrame:
    """(check, n_bad, passed) of a finished generation run: counts, unique ids, the candidates' order and provenance
    against the inputs, contract, configuration, chunks and manifest. Every check is a count over whole tables.

    ``inputs`` and ``candidates`` have ``pos``, their place from 0; candidates also ``chunk``.
    """
    k = lambda d, c: d.agg(c.cast("long").alias("n_bad"))
    off = lambda want: F.abs(F.count("*") - F.lit(want)) if want is not None else F.lit(0)
    twice = lambda d: k(d.groupBy("id").count(), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)))
    a, b = inputs.alias("a"), candidates.alias("b")
    same = F.lit(True)
    for c in provenance:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    by_place = a.join(b, F.col("a.pos") == F.col("b.pos"), "full")
    text = F.coalesce(F.trim("candidate_text"), F.lit("")) != ""
    sound = F.col("id").isNotNull() & F.col("input_text").isNotNull() & (F.col("sequence_token_count") >= 1) & F.col("generation_config_hash").rlike("^[a-f0-9]{64}$") & (text == (F.col("generation_status") == "generated_text"))
    chunks = candidates.groupBy("chunk").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    last = F.col("chunk") == F.col("top")
    top = chunks.agg(F.max("chunk").alias("top"), F.count("*").alias("n_chunks")).withColumn("_one", F.lit(1))
    placed = chunks.withColumn("_one", F.lit(1)).join(top, "_one")
    checks = {
        "input_count": k(inputs, off(n_inputs)), "candidate_count": k(candidates, off(n_inputs)), "input_ids_unique": twice(inputs), "candidate_ids_unique": twice(candidates),
        "order_matches_input": k(by_place, F.count_if(~F.col("a.id").eqNullSafe(F.col("b.id")))), "provenance_matches_input": k(by_place, F.count_if(~same)), "contract": k(candidates, F.count_if(~F.coalesce(sound, F.lit(False)))),
        "confidence_finite": k(candidates, F.count_if(F.col("model_a_confidence").isNull() | F.isnan("model_a_confidence"))),
        "config_hash": k(candidates, F.count_if(~F.col("generation_config_hash").eqNullSafe(F.lit(config_hash)))) if config_hash else k(candidates, F.countDistinct("generation_config_hash") - 1),
        "chunks_contiguous": k(placed, F.max(F.col("top") + 1 - F.col("n_chunks"))), "chunk_sizes": k(placed, F.count_if(F.when(last, F.col("n") > chunk).otherwise(F.col("n") != chunk))),
        "chunk_places": k(chunks, F.count_if((F.col("lo") != F.col("chunk") * chunk) | (F.col("hi") - F.col("lo") + 1 != F.col("n")))),
        "manifest_count": k(manifest, off(n_manifest)), "manifest_ids_unique": twice(manifest), "manifest_within_candidates": k(manifest.select("id").join(candidates.select("id"), "id", "left_anti"), F.count("*")),
    }
    out = None
    for name, d in checks.items():
        row = d.select(F.lit(name).alias("check"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.col("n_bad") == 0)


def inventory(spark: SparkSession, path: str, normalize_newlines: bool = False) -> DataFrame:
    """(name, n_bytes, sha256) of every file below a folder by its path from there, hashed on the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    content = F.encode(F.regexp_replace(F.decode("content", "utf-8"), "\r\n?", "\n"), "utf-8") if normalize_newlines else F.col("content")
    base = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.when(F.contains("path", F.lit(f"{base}/")), F.substring_index("path", f"{base}/", -1)).otherwise(F.regexp_extract("path", "[^/]+$", 0))
    return f.select(name.alias("name"), F.length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("sha256"))


def frozen(spark: SparkSession, paths: dict[str, str], text: tuple[str, ...] = (), order: list[str] | None = None) -> dict[str, Any]:
    """A manifest of named folders or files: their inventories, a hash of each, and of the order of ids that must hold."""
    inputs = {}
    for name, path in sorted(paths.items()):
        files = [r.asDict() for r in inventory(spark, path, name in text).orderBy("name").collect()]  # artifacts by name, not rows
        if not files:
            raise ValueError(f"{path} holds no file")
        inputs[name] = {"path": path, "files": files, "sha256": sha256_of(files)}
    return {"status": "frozen", "inputs": inputs} | ({"order_sha256": sha256_of(order)} if order is not None else {})


def verify(spark: SparkSession, manifest: dict[str, Any], paths: dict[str, str], text: tuple[str, ...] = (), order: list[str] | None = None) -> list[str]:
    """Names of inputs that differ from a frozen manifest, ``order`` among them if the ids come in another one."""
    if manifest.get("status") != "frozen":
        raise ValueError("the manifest is not frozen")
    now = frozen(spark, paths, text, order)
    bad = [k for k in sorted({*manifest["inputs"], *now["inputs"]}) if manifest["inputs"].get(k, {}).get("sha256") != now["inputs"].get(k, {}).get("sha256")]
    return bad + (["order"] if manifest.get("order_sha256") != now.get("order_sha256") else [])


def write_once(path: str, doc: Any) -> str:
    """Write a JSON artifact that never changes: the same content again is fine, other content is refused. Gives its hash."""
    p = Path(path)
    new = canonical(doc)
    if p.exists():
        if canonical(json.loads(p.read_text(encoding="utf-8"))) != new:
            raise FileExistsError(f"{path} exists with other content")
    else:
        p.parent.mkdir(parents=True, exist_ok=True)
        part = p.with_name(p.name + ".part")
        part.write_text(json.dumps(doc, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
        part.replace(p)
    return sha256_of(doc)


@F.pandas_udf(StructType([StructField("ok", BooleanType()), StructField("members", LongType())]))
def zip_state(content: pd.Series) -> pd.DataFrame:
    """Whether a zip file's members all pass their checksums, and how many there are."""
    rows = []
    for c in content:
        try:
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                rows.append((z.testzip() is None, len(z.namelist())))
        except zipfile.BadZipFile:
            rows.append((False, 0))
    return pd.DataFrame(rows, columns=["ok", "members"])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (as multisets) in one table and not in the other."""
    one = lambda d: d.withColumn("_one", F.lit(1))
    x, y = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return one(x).join(one(y), "_one").drop("_one")


def forbidden_keys(doc: dict | list, names: set[str], at: str = "") -> list[str]:
    """Paths of forbidden keys anywhere in a report."""
    if isinstance(doc, dict):
        return [p for k, v in doc.items() for p in ([f"{at}/{k}"] if k in names else []) + forbidden_keys(v, names, f"{at}/{k}")]
    return [p for i, v in enumerate(doc) for p in forbidden_keys(v, names, f"{at}/{i}")] if isinstance(doc, list) else []


def format_duration(seconds: Column) -> Column:
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))
