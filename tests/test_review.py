"""The review ledger and its runner on small data: tries, halving, keys, commits, exclusions, exports, whole jobs."""

import json

import pytest
from pyspark.sql import functions as F

from vietloom import jobs
from vietloom.operators import integrity as I
from vietloom.operators import ledger as L
from vietloom.operators import policy as P
from vietloom.operators import review as R
from vietloom.sources import io

NS = ("v1", "h" * 8, "m")


def keep(ids):
    return [{"id": i, "decision": "KEEP", "corrected_text": None, "reason_code": None} for i in ids]


class Clock:
    now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_key_pool():
    c = Clock()
    k = R.KeyPool(["a", "b"], 10, c)
    assert [k.acquire() for _ in range(3)] == ["a", "b", "a"]
    k.cool("b")
    k.disable("a")
    with pytest.raises(LookupError):
        k.acquire()
    c.now = 11
    assert k.acquire() == "b" and k.acquire() == "b"
    with pytest.raises(ValueError):
        R.KeyPool(["a", ""])


def runner(request, tries=3, **more):
    c = Clock()
    return R.Runner(request, R.KeyPool(["a", "b"], 10, c), tries, (1, 2), 0.0, sleep=c.sleep, **more), c


def test_runner_retries_transient_errors_and_waits():
    calls = []

    def request(key, ids):
        calls.append(key)
        if len(calls) < 3:
            raise TimeoutError("timeout")
        return keep(ids), {"finish_reason": "STOP"}, "raw"

    r, c = runner(request)
    got = list(r.ask(["x", "y"]))
    assert [(e["status"], e["code"], e["attempt_number"]) for e in got] == [("failed", "api_or_transport_error", 1), ("failed", "api_or_transport_error", 2), ("succeeded", None, 3)]
    assert c.now == 3 and calls == ["a", "b", "a"] and [x["id"] for x in got[-1]["results"]] == ["x", "y"]


def test_runner_isolates_a_blocked_sample():
    def request(key, ids):
        if "bad" in ids:
            raise R.ResponseError("prompt_blocked", {"prompt_block_reason": "PROHIBITED_CONTENT", "candidate_count": 0})
        return keep(reversed(ids)), {}, None

    r, _ = runner(request)
    got = list(r.ask(["a", "b", "bad", "c", "d"]))
    assert {x["id"] for e in got for x in e["results"]} == {"a", "b", "c", "d"}
    assert [e["ids"] for e in got if e["status"] == "failed"] == [["a", "b", "bad", "c", "d"], ["bad", "c", "d"], ["bad"]]  # never twice


def test_runner_repeats_a_mismatch_before_halving_and_keeps_order():
    seen = []

    def request(key, ids):
        seen.append(len(ids))
        return keep(ids[1:] if len(ids) > 2 else ids), {}, "r"

    r, _ = runner(request)
    got = list(r.ask(["a", "b", "c", "d"]))
    assert seen == [4, 4, 4, 2, 2] and [e["code"] for e in got] == ["response_id_mismatch"] * 3 + [None, None]


def test_runner_disables_keys_and_gives_up():
    def request(key, ids):
        raise RuntimeError("403 permission_denied")

    r, _ = runner(request, tries=4)
    got = list(r.ask(["a"]))
    assert [e["status"] for e in got] == ["failed"] * 3 and "no key" in got[-1]["detail"]


@pytest.fixture
def make_runner():
    def make():
        def request(key, ids):
            if "s07" in ids:
                raise R.ResponseError("prompt_blocked", {"prompt_block_reason": "PROHIBITED_CONTENT", "candidate_count": 0})
            return [{"id": i, "decision": "KEEP", "corrected_text": None, "reason_code": None} for i in ids], {"finish_reason": "STOP"}, "{}"

        return R.Runner(request, R.KeyPool(["k"]), 2, (0,), 0.0, sleep=lambda s: None)

    return make


def test_review_to_export(spark, frame, tmp_path, make_runner):
    rows = frame([(f"s{i:02d}",) for i in range(20)] + [("s00",)], "id string")
    led = R.Ledger(spark, f"{tmp_path}/ledger")
    assert led.attempts().count() == 0 and led.results().count() == 0
    assert R.review(led, rows, "id", NS, make_runner, size=5, wave=3) == 4
    assert {r.sample_id for r in led.results().collect()} == {f"s{i:02d}" for i in range(20)} - {"s07"}
    a = led.attempts()
    assert a.where("status = 'in_flight'").count() == 0 and a.where("error_code = 'prompt_blocked'").count() == 3
    assert [r.sample_id for r in L.blocked_singletons(a).collect()] == ["s07"]
    assert led.pending(rows, "id", NS).select("ids").collect()[0].ids == ["s07"] and led.pending(rows, "id", ("v2", *NS[1:])).count() == 2
    with pytest.raises(RuntimeError):
        R.stats(rows, led, NS)
    want = {"status": "approved"}
    ok = dict(id="s07", status="approved", recovery_attempts=1, approved_at="2025-01-01")
    bad = [dict(ok, id="s01"), dict(ok, id="zz"), dict(ok, id="s07")]
    schema = "id string, status string, recovery_attempts int, approved_at string"
    faults = lambda ex: sorted((r.id, r.fault) for r in R.exclusion_faults(frame([tuple(e.values()) for e in ex], schema), rows, led.results(), a, want, NS, "PROHIBITED_CONTENT").collect())
    assert faults([ok]) == [("s07", None)] and faults([dict(ok, status="x")]) == [("s07", "invalid_status")] and faults([dict(ok, recovery_attempts=0)]) == [("s07", "invalid_recovery_attempts")]
    assert faults([ok, *bad]) == [("s01", "already_reviewed"), ("s07", "repeated_id"), ("s07", "repeated_id"), ("zz", "outside_manifest")]
    s = R.stats(rows, led, NS, n_excluded=1)
    assert (s["n_rows"], s["n_reviews"], s["decisions"]["KEEP"]) == (20, 19, 19)
    # a later review of the same sample holds, and nothing else is asked for again
    led.commit(frame([("s01", *NS, "b", "REJECT", None, "OTHER")], "sample_id string, prompt_version string, prompt_hash string, llm_model string, batch_id string, decision string, corrected_text string, reason_code string").withColumn("reviewed_at", F.current_timestamp()))
    assert led.results().where("sample_id = 's01'").first().decision == "REJECT" and led.results().count() == 19
    with pytest.raises(PermissionError):
        R.Ledger(spark, f"{tmp_path}/ledger", readonly=True).commit(led.results())


def test_batch_names_and_scope(frame):
    df = frame([(["a", "b"], "h1"), (["a", "b"], "h2"), (["a", 'q"'], "h1")], "ids array<string>, h string")
    got = [r[0] for r in df.select(L.batch_name(F.col("h"), F.col("ids"))).collect()]
    assert got == [I.sha256_of({"ids": i, "prompt_hash": h})[:24] for i, h in ((["a", "b"], "h1"), (["a", "b"], "h2"), (["a", 'q"'], "h1"))]
    rows = frame([("a", "r", False), ("a", "r", True), (None, "x", None)], "id string, review_scope string, prior_manifest boolean")
    assert R.scope_faults(rows, "r", 2).first().asDict() == {"missing_ids": 1, "other_scope": 1, "from_prior": 2, "rows_off": 1, "repeated_ids": 1}
    assert R.identity("p", {"b": 1}) == I.sha256_of({"prompt": "p", "lexical_policy": {"b": 1}})


def test_policy_file(frame, tmp_path):
    f = tmp_path / "p.json"
    doc = {"version": "v9", "canonical_replacements": {"C++": "cpp $1"}, "unambiguous_abbreviations": {"ko": "không"}, "ambiguous_source_phrases": ["mưa rồi"]}
    f.write_text(json.dumps(doc), encoding="utf-8")
    p = P.load_policy(str(f))
    got = [r[0] for r in frame([("KO biết C++ nha",), ("koala",), (None,)], "t string").select(P.canonicalize(F.col("t"), p)).collect()]
    assert got == ["không biết cpp $1 nha", "koala", None]
    for k in ("version", "canonical_replacements"):
        f.write_text(json.dumps({x: y for x, y in doc.items() if x != k}))
        with pytest.raises(ValueError):
            P.load_policy(str(f))


def test_artifacts(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"x\r\n")
    (tmp_path / "in/sub/a.txt").write_bytes(b"y")
    assert sorted(r.name for r in I.inventory(spark, f"{tmp_path}/in").collect()) == ["a.txt", "sub/a.txt"]
    m = I.frozen(spark, {"in": f"{tmp_path}/in"}, text=("in",), order=["1", "2"])
    assert I.verify(spark, m, {"in": f"{tmp_path}/in"}, ("in",), ["1", "2"]) == []
    (tmp_path / "in/a.txt").write_bytes(b"x\n")
    assert I.verify(spark, m, {"in": f"{tmp_path}/in"}, ("in",), ["2", "1"]) == ["order"]
    (tmp_path / "in/sub/a.txt").write_bytes(b"z")
    assert I.verify(spark, m, {"in": f"{tmp_path}/in"}, ("in",), ["1", "2"]) == ["in"]
    h = I.write_once(f"{tmp_path}/r.json", {"b": 1, "a": "é"})
    assert I.write_once(f"{tmp_path}/r.json", {"a": "é", "b": 1}) == h
    with pytest.raises(FileExistsError):
        I.write_once(f"{tmp_path}/r.json", {"a": 2})


def test_published_versions_and_reports(spark, frame, tmp_path):
    io.publish(frame([(1,)], "x int"), f"{tmp_path}/t", "001")
    io.publish(frame([(2,)], "x int"), f"{tmp_path}/t", "002")
    (tmp_path / "t/version=003").mkdir()  # never finished
    assert io.read_published(spark, f"{tmp_path}/t").first().x == 2 and io.read_published(spark, f"{tmp_path}/t", "001").first().x == 1
    with pytest.raises(FileNotFoundError):
        io.read_published(spark, f"{tmp_path}/none")
    io.write_report(frame([("m|x", 0.5, None)], "model string, f1 double, n int"), f"{tmp_path}/out/r", "R")
    assert (tmp_path / "out/r.md").read_text().splitlines()[-1] == "| m\\|x | 0.500000 |  |" and json.loads((tmp_path / "out/r.json").read_text())[0]["f1"] == 0.5


def test_jobs_from_files_to_scores(spark, frame, tmp_path, make_runner):
    a = tmp_path / "a.csv"
    a.write_text("text\nxin  chào\nheld out\n\nhay k\n", encoding="utf-8")
    b = tmp_path / "b.jsonl"
    b.write_text('{"text": "xin chào"}\n{"text": "quá đẹp"}\n', encoding="utf-8")
    held = frame([("held out",)], "t string")
    with pytest.raises(ValueError):
        jobs.prepare(spark, [("A", str(a))], ["A", "B"], "text", held, "t", f"{tmp_path}/c0", "c")
    counts = {r.original_source: r for r in jobs.prepare(spark, [("A", str(a)), ("B", str(b))], ["A", "B"], "text", held, "t", f"{tmp_path}/c", "c").collect()}
    assert (counts["A"].keep, counts["A"].protected_overlap, counts["B"].duplicate, counts["B"].keep) == (2, 1, 1, 1)
    corpus = spark.read.parquet(f"{tmp_path}/c")
    assert {r.id: r.input_text for r in corpus.collect()} == {"c_000001": "xin chào", "c_000002": "hay k", "c_000003": "quá đẹp"}
    jobs.select(corpus.withColumn("candidate_text", F.col("input_text")).withColumn("model_a_confidence", F.lit(0.5)), ["A", "B"], 3, 2, 1, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() >= 2
    n = jobs.run(spark, f"{tmp_path}/m", f"{tmp_path}/l", NS, make_runner)
    assert n == 1 and jobs.run(spark, f"{tmp_path}/m", f"{tmp_path}/l", NS, make_runner) == 0
    reasons = {r.reason: r.n for r in jobs.build(spark, f"{tmp_path}/m", f"{tmp_path}/l", NS, held, "t", f"{tmp_path}/w").collect()}
    assert set(reasons) == {"accepted"} and spark.read.parquet(f"{tmp_path}/w").count() == reasons["accepted"]
    p = frame([("1", "m1", "k", "không", "không"), ("1", "m2", "k", "không", "k")], "id string, model string, input_text string, target_text string, prediction_text string")
    assert [r.model for r in jobs.score(p, f"{tmp_path}/s").collect()] == ["m1", "m2"] and (tmp_path / "s.md").exists()


def test_shared_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    from vietloom import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://h:7077", applicationId="x"))
    with pytest.raises(RuntimeError):
        session.shared_dir(cluster)
    cluster.conf.get = lambda k, d: "hdfs:///t/"
    assert session.shared_dir(cluster) == "hdfs:///t"


def test_scratch_deletes_its_tables(frame, spark):
    from vietloom.session import scratch, written

    with scratch():
        w = written(frame([(1,)], "x int"), "probe")
        path = w.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert w.count() == 1 and __import__("os").path.isdir(path)
    assert not __import__("os").path.exists(path)
