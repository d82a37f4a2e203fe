"""Scans and sinks: delimited text, JSON lines, JSON documents, plain lists; versioned atomic publishing."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import WS_CLASS


def _plain(schema: StructType | list[str]) -> StructType:
    return schema if isinstance(schema, StructType) else StructType([StructField(c, StringType()) for c in schema])


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Header row, all values text, quotes doubled, line breaks in quotes, a byte-order mark dropped."""
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', encoding="utf-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: StructType | list[str]) -> DataFrame:
    """One object a line; blank lines are skipped, anything else fails."""
    return spark.read.schema(_plain(schema)).json(path, mode="FAILFAST")


def read_json_document(spark: SparkSession, path: str, schema: StructType | list[str]) -> DataFrame:
    """A list of objects, or the first of data / records / items that holds one."""
    rows = f"array<{_plain(schema).simpleString()}>"
    doc = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    obj = F.from_json("v", f"data {rows}, records {rows}, items {rows}")
    listed = F.when(F.col("v").rlike(r"^\s*\["), F.from_json("v", rows)).otherwise(F.coalesce(obj["data"], obj["records"], obj["items"]))
    return doc.select(F.explode(listed).alias("r")).select("r.*")


def read_rows(spark: SparkSession, path: str, schema: StructType | list[str] | None = None) -> DataFrame:
    """By suffix; unknown ones are refused."""
    kind = Path(path).suffix.lower()
    if kind in (".csv", ".tsv"):
        return read_delimited(spark, path, "\t" if kind == ".tsv" else ",")
    if kind in (".jsonl", ".json"):
        if schema is None:
            raise ValueError("JSON needs a schema")
        return (read_jsonl if kind == ".jsonl" else read_json_document)(spark, path, schema)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported input: {path}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.regexp_replace("value", f"^{WS_CLASS}+|{WS_CLASS}+$", "").alias("line")).where("line <> ''")


def write_jsonl(df: DataFrame, path: str) -> int:
    """Rows as JSON lines, nulls kept; the count comes with the write, without a second pass.

    Spark's commit protocol renames finished task output only, so a failed write leaves no part file behind.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path, mode="errorifexists", ignoreNullFields="false")
    return int(seen.get["n"])


def publish(df: DataFrame, root: str, version: str) -> str:
    """Write to a new versioned folder; readers take the newest that has a success mark."""
    path = f"{root}/version={version}"
    df.write.parquet(path, mode="errorifexists")
    return path


def read_published(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The newest version (by name) that was written whole, or the one named."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    whole = sorted(n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")))
    want = f"version={version}" if version else whole[-1] if whole else None
    if want not in whole:
        raise FileNotFoundError(f"no published version {version or ''} in {root}")
    return spark.read.parquet(f"{root}/{want}")


def write_report(df: DataFrame, path: str, title: str) -> None:
    """A small table of results as ``<path>.json`` and as a Markdown table in ``<path>.md``."""
    rows = [r.asDict() for r in df.collect()]  # a report: aggregated rows
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.with_suffix(".json").write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
    show = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(show(r[c]) for c in df.columns) + " |" for r in rows)]
    p.with_suffix(".md").write_text("\n".join(lines) + "\n", encoding="utf-8")


def first_rows(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``order``, for trial runs; all of them without ``n``."""
    return df if n is None else df.orderBy(order).limit(n)


def write_csv_sheet(df: DataFrame, path: str, blank: list[str]) -> None:
    """A worksheet with empty columns to fill in by hand; small by nature, so one file."""
    df.select("*", *[F.lit("").alias(c) for c in blank]).coalesce(1).write.csv(path, header=True, mode="overwrite")


def load_json_object(path: str) -> dict:
    doc = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(doc, dict):
        raise ValueError(f"{path} holds no JSON object")
    return doc


def chunk_state(done: DataFrame, expected: DataFrame, key: str = "chunk") -> DataFrame:
    """(key, expected, valid, reusable): a chunk is reusable if it has exactly the expected number of rows, all valid.

    ``done`` has the key and ``valid``, a row each; ``expected`` the key and the number of rows.
    """
    have = done.groupBy(key).agg(F.count_if(F.col("valid")).alias("valid"), F.count("*").alias("_all"))
    x = expected.join(have, key, "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    return x.select(key, "expected", "valid", ((F.col("valid") == F.col("expected")) & (F.col("_all") == F.col("expected"))).alias("reusable")).fillna(False, ["reusable"])


def resume_chunks(done: DataFrame, expected: DataFrame, key: str = "chunk") -> DataFrame:
    """Chunks still to be made."""
    return chunk_state(done, expected, key).where("not reusable").select(key, "expected")
