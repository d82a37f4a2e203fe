"""The review ledger as append-only tables: latest-wins results, batch state, outcomes, reconciliation, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rank_within

KEY = ["sample_id", "prompt_version", "prompt_hash", "llm_model"]
NAMESPACE = ["prompt_version", "prompt_hash", "llm_model"]


def latest(results: DataFrame, key: list[str] = KEY, at: str = "reviewed_at") -> DataFrame:
    """The newest row of each key, as an aggregate with map-side combine; ties go to the largest row."""
    rest = [c for c in results.columns if c not in key and c != at]
    return results.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("_x")).select(*key, F.col(f"_x.{at}").alias(at), *[F.col(f"_x.{c}").alias(c) for c in rest])


def batch_state(attempts: DataFrame) -> DataFrame:
    """Attempts so far and latest status of each batch."""
    return attempts.groupBy("batch_id", *NAMESPACE).agg(
        F.count("*").alias("attempt_count"), F.max_by("status", F.struct("attempt_number", "attempt_id")).alias("status"), F.max_by("error_code", F.struct("attempt_number", "attempt_id")).alias("error_code"), F.max("completed_at").alias("completed_at"),
    )


def outcomes(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(*NAMESPACE, "status", F.coalesce("error_code", F.lit("success")).alias("code")).agg(F.count("*").alias("n"))


def samples(attempts: DataFrame) -> DataFrame:
    """One row per attempt and sample of its request."""
    return attempts.withColumn("sample_id", F.explode(F.from_json("sample_ids_json", "array<string>")))


def reconciled(attempts: DataFrame, results: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Batches whose last attempt failed: superseded if every sample of theirs has a result in the namespace or is
    excluded from review, else still failed. ``excluded`` has sample_id."""
    failed = batch_state(attempts).where("status = 'failed'").select("batch_id", *NAMESPACE)
    ids = samples(attempts).select("batch_id", *NAMESPACE, "sample_id").distinct().join(failed, ["batch_id", *NAMESPACE], "left_semi")
    x = ids.join(results.select(*KEY).distinct().withColumn("_done", F.lit(1)), KEY, "left")
    if excluded is not None:
        x = x.join(excluded.select("sample_id").distinct().withColumn("_out", F.lit(1)), "sample_id", "left").withColumn("_done", F.coalesce("_done", "_out"))
    x = x.groupBy("batch_id", *NAMESPACE).agg(F.count("*").alias("n_samples"), F.count("_done").alias("n_resolved"))
    return x.withColumn("status", F.when(F.col("n_samples") == F.col("n_resolved"), "superseded").otherwise("failed"))


def blocked_singletons(attempts: DataFrame, code: str = "prompt_blocked") -> DataFrame:
    """Attempts of one sample alone that were blocked before an answer, with what the provider said of them."""
    one = F.json_array_length("sample_ids_json") == 1
    return samples(attempts.where(one & (F.col("error_code") == code))).select("attempt_id", "sample_id", *NAMESPACE, "response_metadata_json")


def batch_name(prompt_hash: Column, ids: Column) -> Column:
    """The first 24 digits of the SHA-256 of the prompt's hash and the ids in order, as canonical JSON."""
    listed = F.to_json(F.struct(ids.alias("ids"), prompt_hash.alias("prompt_hash")))
    return F.substring(F.sha2(listed, 256), 1, 24)


def pending(rows: DataFrame, results: DataFrame, id_col: str, namespaces: list[tuple[str, str, str]], size: int = 15, excluded: DataFrame | None = None) -> DataFrame:
    """Batches of rows that have no result in a namespace and are not excluded: (namespace, batch_no, batch_id, ids).

    ``namespaces`` are (prompt_version, prompt_hash, llm_model), a handful by nature; ids go by their order.
    """
    x = rows.select(F.col(id_col).alias("sample_id")).where("sample_id is not null").distinct()
    if excluded is not None:
        x = x.join(excluded.select("sample_id"), "sample_id", "left_anti")
    each = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(NAMESPACE, n, strict=True)]) for n in namespaces])
    x = x.select("sample_id", F.explode(each).alias("n")).select("sample_id", "n.*").join(results.select(*KEY).distinct(), KEY, "left_anti")
    r = rank_within(x, NAMESPACE, ["sample_id"])
    b = r.groupBy(*NAMESPACE, F.floor((F.col("rank") - 1) / size).alias("batch_no")).agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))  # at most ``size`` ids
    return b.select(*NAMESPACE, "batch_no", batch_name(F.col("prompt_hash"), F.col("ids")).alias("batch_id"), "ids")


def json_value(c: Column) -> Column:
    """A string as JSON, quoted and escaped; null as null."""
    x = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(x, F.lit(2), F.length(x) - 2))


def rendered(template: Column, samples: Column) -> Column:
    """A prompt: the template with an array of samples (id, input_text, candidate_text) as indented JSON."""
    fields = (("id", "id"), ("source", "input_text"), ("candidate", "candidate_text"))
    one = lambda s: F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'    "{k}": '), json_value(s[c])) for k, c in fields]), F.lit("\n  }"))
    return F.replace(template, F.lit("{samples_json}"), F.concat(F.lit("[\n"), F.array_join(F.transform(samples, one), ",\n"), F.lit("\n]")))


def error_class(message: Column) -> Column:
    """quota, auth or transient."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.rlike("429|quota|resource_exhausted"), "quota").when(m.rlike("401|403|api key|authentication|permission_denied"), "auth").otherwise("transient")


def safe_detail(message: Column) -> Column:
    """The first code that the message shows, never the message itself."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.contains("client has been closed"), "client_closed").when(m.rlike("not found|404"), "model_or_endpoint_not_found").when(m.rlike("invalid argument|400"), "invalid_request")
        .when(m.contains("response is not valid json"), "invalid_json_response").when(m.contains("does not exactly match"), "response_id_mismatch").when(m.contains("validationerror"), "response_schema_invalid").otherwise("api_or_transport_error")
    )


def response_gate(meta: Column, text: Column) -> Column:
    """Why a response cannot be parsed; null if it can."""
    block, n, finish = F.get_json_object(meta, "$.prompt_block_reason"), F.get_json_object(meta, "$.candidate_count"), F.get_json_object(meta, "$.finish_reason")
    return (
        F.when(block.isNotNull() & (block != "BLOCKED_REASON_UNSPECIFIED"), "prompt_blocked").when(n == "0", "no_candidates")
        .when(finish.isNotNull() & ~finish.isin("STOP", "FINISH_REASON_UNSPECIFIED"), F.concat(F.lit("finish_"), F.lower(finish))).when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_response_text")
    )


RESPONSE = "results array<struct<id:string,decision:string,corrected_text:string,reason_code:string>>"


def parsed(df: DataFrame, text: str, ids_json: str) -> DataFrame:
    """Adds ``results`` in request order, or ``parse_error``: not_json, id_mismatch or schema."""
    fenced = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*\n([\s\S]*)\n```$", "$1")
    body = F.when(fenced.startswith("{"), fenced).otherwise(F.regexp_extract(fenced, r"(?s)\{.*\}", 0))
    null = lambda c: F.when(c != "null", c)
    x = df.withColumn("_ids", F.from_json(ids_json, "array<string>")).withColumn("_r", F.from_json(body, RESPONSE)["results"])
    x = x.withColumn("_r", F.transform("_r", lambda r: F.struct(r["id"].alias("id"), r["decision"].alias("decision"), null(r["corrected_text"]).alias("corrected_text"), null(r["reason_code"]).alias("reason_code"))))
    got = F.transform("_r", lambda r: r["id"])
    wrong = (F.size("_r") != F.size("_ids")) | (F.size(F.array_distinct(got)) != F.size("_ids")) | (F.size(F.array_except("_ids", got)) > 0)
    bad = F.exists("_r", lambda r: ~F.coalesce(
        ((r["decision"] == "KEEP") & r["corrected_text"].isNull() & r["reason_code"].isNull()) | ((r["decision"] == "EDIT") & (F.length(r["corrected_text"]) > 0) & r["reason_code"].isNull()) | ((r["decision"] == "REJECT") & r["corrected_text"].isNull() & r["reason_code"].isNotNull()), F.lit(False)))
    x = x.withColumn("parse_error", F.when(F.col("_r").isNull(), "not_json").when(F.coalesce(wrong, F.lit(True)), "id_mismatch").when(bad, "schema"))
    order = F.transform("_ids", lambda i: F.get(F.filter("_r", lambda r: r["id"] == i), F.lit(0)))
    return x.withColumn("results", F.when(F.col("parse_error").isNull(), order)).drop("_ids", "_r")
