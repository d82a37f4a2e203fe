"""A review ledger kept as append-only tables, and the runner that fills it.

Nothing is updated in place: attempts, their outcomes and results are events, and the state of an attempt, a batch or a
sample is an aggregate over them (``max`` of a struct, with map-side combine). A wave of batches is one append, so what
is lost with the driver or an executor is at most the wave under way; a rerun finds what is pending and goes on.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger as L
from .integrity import sha256_of

#: Outcomes after which the same request is not repeated, and those after which a batch is halved.
BLOCKED = ("prompt_blocked", "no_candidates", "finish_safety", "finish_prohibited_content", "finish_blocklist", "finish_spii", "finish_max_tokens")
RECOVERABLE = (*BLOCKED, "empty_response_text", "invalid_json_response", "response_schema_invalid", "response_id_mismatch", "finish_recitation", "finish_language", "finish_other")

_NS = "prompt_version string, prompt_hash string, llm_model string"
EVENTS = {
    "attempts": f"batch_id string, {_NS}, sample_ids_json string, attempt_number int, status string, error_code string, error_detail string, response_metadata_json string, raw_response string, created_at timestamp, completed_at timestamp",
    "results": f"sample_id string, {_NS}, batch_id string, decision string, corrected_text string, reason_code string, reviewed_at timestamp",
}


class Ledger:
    """A folder of event tables; opened ``readonly`` it refuses to append."""

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False):
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly

    def events(self, table: str) -> DataFrame:
        """All rows ever appended; none if nothing was."""
        try:
            return self.spark.read.schema(EVENTS[table]).parquet(f"{self.root}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], EVENTS[table])

    def append(self, table: str, rows: DataFrame) -> None:
        if self.readonly:
            raise PermissionError("the ledger was opened for reading only")
        want = self.spark.createDataFrame([], EVENTS[table]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want]).write.mode("append").parquet(f"{self.root}/{table}")

    def attempts(self) -> DataFrame:
        """Each attempt in its last state: an outcome stands over the mark that it is under way."""
        key = ["batch_id", *L.NAMESPACE, "attempt_number"]
        last = F.struct(F.col("completed_at").isNotNull().alias("done"), "completed_at", "status", "error_code", "error_detail", "response_metadata_json", "raw_response")
        x = self.events("attempts").groupBy(*key).agg(F.max("sample_ids_json").alias("sample_ids_json"), F.min("created_at").alias("created_at"), F.max(last).alias("x"))
        return x.select(F.xxhash64(*key).alias("attempt_id"), *key, "sample_ids_json", "created_at", "x.status", "x.error_code", "x.error_detail", "x.response_metadata_json", "x.raw_response", "x.completed_at")

    def results(self) -> DataFrame:
        return L.latest(self.events("results"))

    def mark_attempts(self, batches: DataFrame) -> DataFrame:
        """Append a mark "under way" for each batch (namespace, batch_id, ids), numbered on from its last attempt."""
        so_far = self.events("attempts").groupBy("batch_id", *L.NAMESPACE).agg(F.max("attempt_number").alias("n"))
        x = batches.join(so_far, ["batch_id", *L.NAMESPACE], "left").select("batch_id", *L.NAMESPACE, F.to_json("ids").alias("sample_ids_json"), (F.coalesce("n", F.lit(0)) + 1).alias("attempt_number"), F.lit("in_flight").alias("status"), F.current_timestamp().alias("created_at"))
        self.append("attempts", x)
        return x

    def complete(self, outcomes: DataFrame) -> None:
        """Append outcomes: details are cut to 1,000 characters, metadata written with sorted keys."""
        self.append("attempts", outcomes.withColumn("error_detail", F.substring("error_detail", 1, 1000)))

    def commit(self, results: DataFrame) -> None:
        """Append results; of a sample reviewed before in the namespace the newest holds."""
        self.append("results", results)

    def pending(self, rows: DataFrame, id_col: str, namespace: tuple[str, str, str], size: int = 15, excluded: DataFrame | None = None) -> DataFrame:
        return L.pending(rows, self.events("results"), id_col, [namespace], size, excluded)


@dataclass
class KeyPool:
    """Keys in turn, without those that are cooling down or disabled."""

    keys: list[str]
    cooldown_seconds: float = 60
    clock: Callable[[], float] = time.monotonic
    _until: dict[str, float] = field(default_factory=dict)
    _next: int = 0

    def __post_init__(self) -> None:
        if not self.keys or not all(self.keys):
            raise ValueError("at least one key is needed, and none may be empty")

    def acquire(self) -> str:
        for i in range(len(self.keys)):
            k = self.keys[(self._next + i) % len(self.keys)]
            if self._until.get(k, 0.0) <= self.clock():
                self._next = (self._next + i + 1) % len(self.keys)
                return k
        raise LookupError("no key is available")

    def cool(self, key: str) -> None:
        self._until[key] = self.clock() + self.cooldown_seconds

    def disable(self, key: str) -> None:
        self._until[key] = float("inf")


class ResponseError(Exception):
    """A response that cannot be used: its code, and what came with it."""

    def __init__(self, code: str, metadata: dict | None = None, raw: str | None = None):
        super().__init__(code)
        self.code, self.metadata, self.raw = code, metadata or {}, raw


def error_kind(e: Exception) -> tuple[str, str]:
    """(code, class) of an error, by the rules of :func:`ledger.safe_detail` and :func:`ledger.error_class`."""
    if isinstance(e, ResponseError):
        return e.code, "transient"
    m = f"{type(e).__name__}: {e}".lower()
    has = lambda *xs: any(x in m for x in xs)
    kind = "quota" if has("429", "quota", "resource_exhausted") else "auth" if has("401", "403", "api key", "authentication", "permission_denied") else "transient"
    rules = (("client_closed", ("client has been closed",)), ("model_or_endpoint_not_found", ("not found", "404")), ("invalid_request", ("invalid argument", "400")), ("invalid_json_response", ("response is not valid json",)), ("response_id_mismatch", ("does not exactly match",)), ("response_schema_invalid", ("validationerror",)))
    return next((code for code, marks in rules if has(*marks)), "api_or_transport_error"), kind


@dataclass
class Runner:
    """How one batch is asked for: tries with growing waits, no repeat of a blocked request, halving where samples of a
    batch spoil it. ``request(key, ids)`` gives (results, metadata, raw) or raises; ``policy`` may change results."""

    request: Callable[[str, list[str]], tuple[list[dict], dict, str | None]]
    keys: KeyPool
    tries: int = 5
    waits: tuple[float, ...] = (5, 15, 45, 90)
    jitter: float = 1.0
    policy: Callable[[list[dict]], list[dict]] | None = None
    sleep: Callable[[float], None] = time.sleep

    def _key(self) -> str:
        try:
            return self.keys.acquire()
        except LookupError:
            self.sleep(self.keys.cooldown_seconds)
            return self.keys.acquire()

    def ask(self, ids: list[str], first: int = 1, depth: int = 0) -> Iterator[dict[str, Any]]:
        """One event an attempt, the halves' after their batch's: ids, number, status, code, detail, metadata, raw, results."""
        code = ""
        for k in range(self.tries):
            event: dict[str, Any] = {"ids": ids, "attempt_number": first + k, "status": "failed", "code": None, "detail": None, "metadata": {}, "raw": None, "results": []}
            try:
                key = self._key()
            except LookupError as e:
                yield event | {"code": "api_or_transport_error", "detail": str(e)}
                return
            try:
                got, event["metadata"], event["raw"] = self.request(key, ids)
                by_id = {r["id"]: r for r in got}
                if len(got) != len(ids) or set(by_id) != set(ids):
                    raise ResponseError("response_id_mismatch", event["metadata"], event["raw"])
                got = [by_id[i] for i in ids]
                yield event | {"status": "succeeded", "results": self.policy(got) if self.policy else got}
                return
            except Exception as e:  # whatever the provider raises is an outcome of the attempt, never the end of the job
                code, kind = error_kind(e)
                if isinstance(e, ResponseError):
                    event |= {"metadata": e.metadata, "raw": e.raw}
                yield event | {"code": code, "detail": f"{type(e).__name__}: {e}"}
                if kind == "quota":
                    self.keys.cool(key)
                elif kind == "auth":
                    self.keys.disable(key)
                if code in BLOCKED or depth and code in RECOVERABLE:
                    break
                if k + 1 < self.tries:
                    self.sleep(self.waits[min(k, len(self.waits) - 1)] + random.uniform(0, self.jitter))
        if len(ids) > 1 and code in RECOVERABLE:
            half = len(ids) // 2
            yield from self.ask(ids[:half], 1, depth + 1)
            yield from self.ask(ids[half:], 1, depth + 1)


_ASKED = f"{_NS}, ids array<string>, attempt_number int, status string, code string, detail string, metadata string, raw string, results array<struct<id:string,decision:string,corrected_text:string,reason_code:string>>"


def asked(batches: DataFrame, runner: Callable[[], Runner]) -> DataFrame:
    """Runs batches (namespace, ids, last) on the executors, a runner a task: one row an attempt."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = runner()
        names = ["prompt_version", "prompt_hash", "llm_model"]
        for p in parts:
            rows = []
            for ns, ids, last in zip(p[names].itertuples(index=False), p["ids"], p["last"], strict=True):
                for e in r.ask(list(ids), int(last) + 1):
                    res = [{c: x.get(c) for c in ("id", "decision", "corrected_text", "reason_code")} for x in e["results"]]
                    rows.append((*ns, e["ids"], e["attempt_number"], e["status"], e["code"], e["detail"], json.dumps(e["metadata"], ensure_ascii=False, sort_keys=True) if e["metadata"] else None, e["raw"], res))
            yield pd.DataFrame(rows, columns=[*names, "ids", "attempt_number", "status", "code", "detail", "metadata", "raw", "results"])

    return batches.select(*L.NAMESPACE, "ids", "last").mapInPandas(run, _ASKED)


def review(ledger: Ledger, rows: DataFrame, id_col: str, namespace: tuple[str, str, str], runner: Callable[[], Runner], size: int = 15, wave: int = 10_000, excluded: DataFrame | None = None) -> int:
    """Reviews what is pending, ``wave`` batches an append, and returns how many batches were asked for.

    The waves are numbers of batches, so the driver holds none of their ids.
    """
    from ..session import written

    work = written(ledger.pending(rows, id_col, namespace, size, excluded), "pending")
    total = work.count()
    for at in range(0, total, wave):
        part = work.where((F.col("batch_no") >= at) & (F.col("batch_no") < at + wave))
        marked = written(ledger.mark_attempts(part).select("batch_id", *L.NAMESPACE, "attempt_number"), "marked")
        part = part.join(marked, ["batch_id", *L.NAMESPACE]).withColumn("last", F.col("attempt_number") - 1)
        got = written(asked(part, runner), "asked").withColumn("batch_id", L.batch_name(F.col("prompt_hash"), F.col("ids")))
        now = F.current_timestamp()
        ledger.commit(got.where("status = 'succeeded'").select(*L.NAMESPACE, "batch_id", F.explode("results").alias("r")).select(F.col("r.id").alias("sample_id"), *L.NAMESPACE, "batch_id", "r.decision", "r.corrected_text", "r.reason_code", now.alias("reviewed_at")))
        ledger.complete(got.select("batch_id", *L.NAMESPACE, F.to_json("ids").alias("sample_ids_json"), "attempt_number", "status", F.col("code").alias("error_code"), F.col("detail").alias("error_detail"), F.col("metadata").alias("response_metadata_json"), F.col("raw").alias("raw_response"), now.alias("created_at"), now.alias("completed_at")))
    return total


def identity(prompt: str, policy: dict) -> str:
    """The hash that names prompt and policy together: what a namespace's results were made with."""
    return sha256_of({"lexical_policy": policy, "prompt": prompt})


def scope_faults(rows: DataFrame, scope: str, count: int | None = None, fresh: bool = True) -> DataFrame:
    """One row of counts that must be 0: ids missing or repeated, rows of another scope or from a prior manifest, and
    how far the number of rows is off."""
    one = lambda d: d.withColumn("_one", F.lit(1))
    twice = rows.where("id is not null").groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    a = rows.agg(
        F.count_if(F.col("id").isNull() | (F.col("id") == "")).alias("missing_ids"), F.count_if(~F.col("review_scope").eqNullSafe(F.lit(scope))).alias("other_scope"),
        F.count_if(~F.col("prior_manifest").eqNullSafe(F.lit(False)) & F.lit(fresh)).alias("from_prior"), (F.count("*") - F.lit(count) if count is not None else F.lit(0).cast("long")).alias("rows_off"))
    return one(a).join(one(twice), "_one").drop("_one")  # one row each


def exclusion_faults(exclusions: DataFrame, rows: DataFrame, results: DataFrame, attempts: DataFrame, want: dict[str, Any], namespace: tuple[str, str, str], reason: str) -> DataFrame:
    """(id, fault) of each exclusion, the first that holds; null if it is approved rightly.

    ``want`` are the values that fields must have; the evidence is a blocked attempt of that sample alone whose metadata
    names ``reason`` and no candidates.
    """
    here = lambda d: d.where(" and ".join(f"{k} = '{v}'" for k, v in zip(L.NAMESPACE, namespace, strict=True)))
    mark = lambda d, c: d.select(F.col(d.columns[0]).alias("id")).distinct().withColumn(c, F.lit(True))
    meta = lambda k: F.get_json_object("response_metadata_json", f"$.{k}")
    seen = L.blocked_singletons(here(attempts)).where((meta("prompt_block_reason") == reason) & (meta("candidate_count") == "0")).select("sample_id")
    n = exclusions.groupBy("id").agg(F.count("*").alias("_n"))
    x = exclusions.join(n, "id", "left").join(mark(rows.select("id"), "_in"), "id", "left").join(mark(here(results).select("sample_id"), "_done"), "id", "left").join(mark(seen, "_seen"), "id", "left")
    fault = F.when(F.col("id").isNull(), "missing_id").when(F.col("_n") > 1, "repeated_id").when(F.col("_in").isNull(), "outside_manifest").when(F.col("_done"), "already_reviewed")
    for k, v in want.items():
        fault = fault.when(~F.col(k).eqNullSafe(F.lit(v)), f"invalid_{k}")
    fault = fault.when(~(F.coalesce("recovery_attempts", F.lit(0)) >= 1), "invalid_recovery_attempts").when(F.coalesce("approved_at", F.lit("")) == "", "missing_approved_at").when(F.col("_seen").isNull(), "no_evidence")
    return x.select("id", fault.alias("fault"))


def stats(rows: DataFrame, ledger: Ledger, namespace: tuple[str, str, str], n_excluded: int = 0) -> dict[str, Any]:
    """Counts of a finished review; raises while samples are open or a failed batch is not superseded."""
    here = lambda d: d.where(" and ".join(f"{k} = '{v}'" for k, v in zip(L.NAMESPACE, namespace, strict=True)))
    n = rows.select("id").distinct().count()
    r = here(ledger.results()).join(rows.select(F.col("id").alias("sample_id")).distinct(), "sample_id", "left_semi").groupBy("decision", "reason_code").count().collect()
    a = here(ledger.attempts())
    failed = L.reconciled(a, ledger.results()).where("status = 'failed'").count()
    done = sum(x["count"] for x in r)
    if done + n_excluded != n or failed and not n_excluded:
        raise RuntimeError(f"not all samples and batches are settled: {done} of {n} reviewed, {n_excluded} excluded, {failed} batches failed")
    decisions = {k: sum(x["count"] for x in r if x["decision"] == k) for k in ("KEEP", "EDIT", "REJECT")}
    reasons = {x["reason_code"]: x["count"] for x in r if x["decision"] == "REJECT"}
    outcomes = {f"{x.status}:{x.code}": x.n for x in L.outcomes(a).collect()}
    return {"n_rows": n, "n_reviews": done, "n_excluded": n_excluded, "decisions": decisions, "reject_reasons": dict(sorted(reasons.items())), "attempt_outcomes": dict(sorted(outcomes.items()))} | dict(zip(L.NAMESPACE, namespace, strict=True))
