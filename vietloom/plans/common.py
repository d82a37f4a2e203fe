"""Shared by the query modules: reading tables, and pieces of SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The names of the corpus sources, in the order of their precedence.
SOURCES = ["ViHSD", "UIT-VSMEC", "ViHOS", "ViSpamReviews", "UIT-ViSFD"]
WS_SQL = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def read(spark, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def clean_sql(c: str) -> str:
    return f"nullif(trim(regexp_replace(nfc_normalize({c}), '{WS_SQL}+', ' ', 'g')), '')"


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def case_sql(c: str, values: list[str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{v}' THEN {i + 1}" for i, v in enumerate(values)) + f" ELSE {len(values) + 1} END"


def bucket(c: str, n: int) -> str:
    """A hash bucket of a string, in Spark SQL."""
    return f"(conv(substr(md5({c}), 1, 8), 16, 10) % {n})"


def bucket_sql(c: str, n: int) -> str:
    """The same in the checking SQL."""
    return f"(('0x' || substr(md5({c}), 1, 8))::BIGINT % {n})"
