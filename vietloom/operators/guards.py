"""Guards around a run: paths, frozen prompts, checkpoints with a fallback, completeness, replayed metrics, progress."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import integrity as I
from .review import identity


def has_forbidden_part(path: Column, parts: list[str]) -> Column:
    """Whether a path, in lower case and with forward slashes, contains any of the parts."""
    p = F.lower(F.translate(path, "\\", "/"))
    return functools.reduce(lambda a, b: a | b, [F.contains(p, F.lit(x.lower())) for x in parts], F.lit(False))


def refuse_paths(paths: list[str], parts: list[str]) -> None:
    bad = [p for p in paths if any(x.lower() in p.replace("\\", "/").lower() for x in parts)]
    if bad:
        raise ValueError(f"not to be read in this run: {bad}")


def frozen_prompt(prompt: str, policy: dict[str, Any], is_frozen: bool, digest: str | None) -> str:
    """The identity of prompt and policy, if the prompt is declared frozen and is what was frozen; else an error."""
    got = identity(prompt, policy)
    if not is_frozen:
        raise ValueError("the prompt is not frozen")
    if got != digest:
        raise ValueError("prompt and policy are not what was frozen")
    return got


def freeze_prompt(config: dict[str, Any], prompt: str, policy: dict[str, Any], reviewed: int, needed: int) -> dict[str, Any]:
    """``config`` with prompt and policy frozen, once ``needed`` pilot rows were reviewed; a frozen one stays as it is."""
    if config.get("prompt_frozen"):
        frozen_prompt(prompt, policy, True, config.get("frozen_prompt_sha256"))
        return config
    if reviewed < needed:
        raise ValueError(f"only {reviewed} of {needed} pilot rows are reviewed")
    return config | {"prompt_frozen": True, "frozen_prompt_sha256": identity(prompt, policy)}


def chosen(spark: SparkSession, selected: dict[str, str], fallback: dict[str, str]) -> str:
    """The path of the selected artifact if its folder has the hash it should have, else of the fallback, else an error."""
    for a in (selected, fallback):
        if Path(a["path"]).exists() and I.frozen(spark, {"x": a["path"]})["inputs"]["x"]["sha256"] == a["sha256"]:
            return a["path"]
    raise FileNotFoundError("neither the selected artifact nor its fallback is whole")


def named_files(spark: SparkSession, path: str, names: set[str]) -> DataFrame:
    """The inventory of the files of a folder that have one of the names, as of a tokenizer's vocabulary."""
    return I.inventory(spark, path).where(F.regexp_extract("name", "[^/]+$", 0).isin(*sorted(names)))


def cells(df: DataFrame, grid: dict[str, list[Any]]) -> DataFrame:
    """Rows of every cell of a grid of columns, 0 where there is none: a run is complete if no cell is empty."""
    spark = df.sparkSession
    want = spark.range(1)
    for k, values in grid.items():
        want = want.withColumn(k, F.explode(F.array(*[F.lit(v) for v in values])))
    n = df.groupBy(*grid).agg(F.count("*").alias("n"))
    return want.drop("id").join(n, list(grid), "left").fillna(0, ["n"])


def replayed(now: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """(key, column) of every value that a recomputed report has otherwise than the frozen one, rows that lack included."""
    cols = [c for c in frozen.columns if c != key]
    x = now.select(key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_n")).join(frozen.withColumn("_f", F.lit(True)), key, "full")
    differ = F.array(*[F.when(~F.col(f"n_{c}").eqNullSafe(F.col(c)) | F.col("_n").isNull() | F.col("_f").isNull(), F.lit(c)) for c in cols])
    return x.select(key, F.explode(F.array_compact(differ)).alias("column"))


def once_a_process(load: Callable[[], Any]) -> Callable[[], Any]:
    """``load`` deferred to the first use on each worker process and kept there: for models inside Arrow functions."""
    return functools.cache(load)


@dataclass
class Progress:
    """Done of total with rate and time left; the clock is a parameter."""

    total: int
    clock: Callable[[], float] = time.monotonic
    done: int = 0

    def __post_init__(self) -> None:
        self._start, self._first = self.clock(), self.done

    def advance(self, n: int = 1) -> dict[str, float | None]:
        self.done += n
        took = self.clock() - self._start
        rate = (self.done - self._first) / took if took > 0 else None
        return {"done": self.done, "total": self.total, "share": self.done / self.total if self.total else 1.0, "rate": rate, "seconds_left": (self.total - self.done) / rate if rate else None}
