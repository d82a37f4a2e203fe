import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vietloom.operators import curate, ledger, mixtures, policy, weak
from vietloom.operators import evaluate as E
from vietloom.operators import integrity as I
from vietloom.operators import ranking as R


def test_rank_within_skew_ties_nulls(frame):
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 6 + ["b", None]), r.randint(0, 5)) for i in range(400)]
    got = R.rank_within(frame(rows, "id int, k string, v int"), ["k"], ["v", "id"]).collect()
    want = defaultdict(list)
    for i, k, v in rows:
        want[k].append((v, i))
    want = {i: (n + 1, len(x)) for k, x in want.items() for n, (_, i) in enumerate(sorted(x))}
    assert {g.id: (g["rank"], g.rank_n) for g in got} == want
    assert R.rank_within(frame([], "id int, k string"), ["k"], ["id"]).count() == 0


def test_bands_and_quotas(frame):
    got = R.bands(frame([(i, "a", 0.5) for i in range(5)] + [(9, "b", 0.1)], "id int, s string, c double"), ["s"], ["c", "id"], 3).collect()
    assert {g.id: g.band for g in got} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 9: 0}
    q = R.largest_remainder(frame([("a", 3, 1), ("b", 3, 2), ("c", 4, 3)], "s string, n int, p int"), "s", "n", "p", 5).collect()
    assert {x.s: x.quota for x in q} == {"a": 2, "b": 1, "c": 2}


def test_stratified_and_complement(frame):
    df = frame([(f"i{i}", "ab"[i % 2]) for i in range(20)], "id string, s string")
    s = R.stratified(df, ["s"], frame([("a", 3), ("b", 2)], "s string, quota int"), "id", 7)
    assert Counter(r.s for r in s.collect()) == {"a": 3, "b": 2}
    c = R.complement(df, s, "id", "id").collect()
    assert sorted(r.selection_rank for r in c) == list(range(1, 16)) and [r.id for r in sorted(c, key=lambda r: r.selection_rank)] == sorted(r.id for r in c)


def test_fates(frame):
    rows = [("1", "b", "x  y"), ("2", "a", "x y"), ("3", "a", None), ("4", "zz", "  "), ("5", "a", "held"), ("6", None, "x y"), ("7", "b", "z")]
    f = curate.fates(frame(rows, "id string, s string, t string"), curate.protected_hashes(frame([("held ",)], "t string"), "t"), "id", "s", "t", ["a", "b"])
    assert {r.id: r.fate for r in f.collect()} == {"1": "duplicate", "2": "keep", "3": "empty", "4": "empty", "5": "protected_overlap", "6": "duplicate", "7": "keep"}


def test_history(frame):
    rows = [("u", i, v) for i, v in enumerate("aabbabbbcdefghij")]
    got = curate.consecutive_distinct(frame(rows, "k string, t int, v string"), "k", ["t"], ["v"], 10).orderBy("place").collect()
    assert "".join(r.v for r in got) == "jihgfedcba"


ATT = "attempt_id long, batch_id string, prompt_hash string, prompt_version string, llm_model string, sample_ids_json string, attempt_number int, status string, error_code string, response_metadata_json string, completed_at timestamp"


def test_ledger(frame):
    a = frame([(1, "b1", "h", "v", "m", '["x","y"]', 1, "failed", "quota", None, None), (2, "b2", "h", "v", "m", '["z"]', 1, "failed", "prompt_blocked", '{"candidate_count": 0}', None), (3, "b3", "h", "v", "m", '["x"]', 1, "failed", None, None, None), (4, "b3", "h", "v", "m", '["x"]', 2, "succeeded", None, None, None)], ATT)
    r = frame([("x", "v", "h", "m", 1, "KEEP"), ("x", "v", "h", "m", 2, "EDIT"), ("y", "v", "h", "m", 1, "KEEP"), ("z", "v2", "h", "m", 1, "KEEP")], "sample_id string, prompt_version string, prompt_hash string, llm_model string, reviewed_at int, decision string")
    assert {(x.sample_id, x.decision) for x in ledger.latest(r).collect()} == {("x", "EDIT"), ("y", "KEEP"), ("z", "KEEP")}
    assert {x.batch_id: x.status for x in ledger.reconciled(a, r).collect()} == {"b1": "superseded", "b2": "failed"}
    assert {x.batch_id: x.status for x in ledger.reconciled(a, r, frame([("z",)], "sample_id string")).collect()} == {"b1": "superseded", "b2": "superseded"}
    assert [(x.sample_id, x.response_metadata_json) for x in ledger.blocked_singletons(a).collect()] == [("z", '{"candidate_count": 0}')] and ledger.blocked_singletons(a, "quota").count() == 0
    assert {(x.status, x.code): x.n for x in ledger.outcomes(a).collect()} == {("failed", "quota"): 1, ("failed", "prompt_blocked"): 1, ("failed", "success"): 1, ("succeeded", "success"): 1}


def test_parse(frame):
    ok = '{"results":[{"id":"b","decision":"EDIT","corrected_text":"x","reason_code":"null"},{"id":"a","decision":"KEEP","corrected_text":null,"reason_code":null}]}'
    rows = [("```json\n" + ok + "\n```", '["a","b"]'), ("Here: " + ok + " done", '["a","b"]'), (ok, '["a"]'), (ok, '["a","b","c"]'), ("{", '["a"]'), (ok.replace("EDIT", "REJECT"), '["a","b"]')]
    got = ledger.parsed(frame(rows, "t string, i string"), "t", "i").collect()
    assert [g.parse_error for g in got] == [None, None, "id_mismatch", "id_mismatch", "not_json", "schema"]
    assert [x.id for x in got[0].results] == ["a", "b"] and got[0].results[1].reason_code is None


def test_policy(frame):
    p = policy.Policy()
    rows = [("ĐT đtx sp1 mn", "điện thoại đtx sp1 mọi người"), ("Sài Gòn", "xài Gòn"), ("ko ko", "không không"), (None, None)]
    assert [r[0] for r in frame(rows, "t string, w string").select(policy.canonicalize(F.col("t"), p)).collect()] == [w for _, w in rows]
    q = policy.Policy(replacements={"a": "$1\\"}, abbreviations={})
    assert frame([("x a",)], "t string").select(policy.canonicalize(F.col("t"), q)).first()[0] == "x $1\\"
    s = [("5.5 đ", "5,5 đ", ["number_removed"]), ("haaaaaa", "ha", ["expressive_elongation_removed"]), ("haaaa", "ha", []), ("ok 🥺", "ok", ["source_symbol_removed"])]
    got = frame([x[:2] for x in s], "a string, b string").select(policy.preservation_errors(F.col("a"), F.col("b"), p)).collect()
    assert [g[0] for g in got] == [x[2] for x in s]
    o = frame([("bcdfghjklmnpqrst",), ("bcdf",), ("bcdfghjklmnpqrsta",), ("",)], "t string").select(policy.is_opaque(F.col("t"), p)).collect()
    assert [x[0] for x in o] == [True, False, False, False]


def test_weak_cascade(frame):
    rows = [(1, "a b", "long " * 5, "KEEP", None), (2, "a b", "a b", "KEEP", None), (3, "a b", "a b c", "KEEP", None), (4, "a b", "x" * 99, "KEEP", None), (5, "q", "q", "REJECT", None), (6, "r", None, None, None), (7, "s", "s", "EDIT", " "), (8, "t", "{t}", "KEEP", None), (9, "held", "held", "KEEP", None)]
    got = weak.reasons(frame(rows, "pos int, input_text string, candidate_text string, decision string, corrected_text string"), curate.protected_hashes(frame([("held",)], "t string"), "t"))
    assert {r.pos: r.reason for r in got.collect()} == {1: "length_ratio", 2: "accepted", 3: "duplicate_input", 4: "duplicate_input", 5: "llm_reject", 6: "missing_valid_review", 7: "empty_target", 8: "response_artifact", 9: "protected_overlap"}


@pytest.mark.parametrize("n, want", [((1778, 1703, 1250, 2404, 961), (0.6002495840266223, 0.733998825601879, 0.703037120359955, 0.7181844297615628)), ((1778, 1690, 1287, 2404, 882), (0.6331114808652246, None, None, 0.7422145328719723)), ((0, 0, 0, 0, 0), (0.0, 0.0, 0.0, 0.0))])
def test_published_metrics(frame, n, want):
    m = E.metrics(frame([("m", *n, 1)], "model string, gold_edits long, predicted_edits long, correct_edits long, lai_token_errors long, system_token_errors long, exact long"), ["model"]).first()
    for got, w in zip((m.ERR, m.precision, m.recall, m.f1), want, strict=True):
        assert w is None or abs(got - w) < 1e-12


def test_row_stats_brute(frame):
    rows = [("1", "m", "t k bik", "tôi không biết", "tôi k biết"), ("2", "m", "a a", "b b", "b b"), ("3", "m", "x", "x", "")]
    s = {r.id: r for r in E.row_stats(frame(rows, "id string, model string, input_text string, target_text string, prediction_text string")).collect()}
    assert (s["2"].gold_edits, s["2"].predicted_edits, s["2"].correct_edits, s["2"].exact) == (1, 1, 1, 1)
    assert (s["1"].lai_token_errors, s["1"].system_token_errors) == (3, 1) and s["3"].system_token_errors == 1
    assert frame([(["a", "a", "b"], ["a", "b", "b", "c"])], "a array<string>, b array<string>").select(E.multiset_common(F.col("a"), F.col("b"))).first()[0] == 2


def test_categories_ranking_rule(frame):
    rows = [("a", "b", "b"), ("a", "a", "b"), ("a", "b", "a"), ("a", "b c", "x"), ("a b", "c", "x"), ("a", "b", "c")]
    got = [r[0] for r in frame(rows, "i string, t string, p string").select(E.category(F.col("i"), F.col("t"), F.col("p"))).collect()]
    assert got == ["correct", "over-normalization", "missed", "one-to-many", "many-to-one", "wrong"]
    r = E.ranking(frame([("model_b", 0.5, 0.5, 0.5), ("model_a", 0.5, 0.5, 0.5)], "model string, ERR double, f1 double, exact_match double")).collect()
    assert {x.model: x["rank"] for x in r} == {"model_a": 1, "model_b": 2}
    w = frame([(0.1, 0.1, 0.3, 0.2)], "a double, b double, c double, d double").select(E.two_model_rule(*[F.col(c) for c in "abcd"]).alias("x")).first().x
    assert (w.winner, w.criterion) == ("model_a", "higher_ERR")


def test_bootstrap_equal_arms(frame):
    rows = [(str(i), m, 3, 1, 0) for i in range(4) for m in "ab"]
    b = E.bootstrap(frame(rows, "id string, model string, lai_token_errors long, system_token_errors long, exact long"), "a", "b", 20, 1).first()
    assert (b["replicates"], b["mean"], b["low"], b["high"]) == (20, 0.0, 0.0, 0.0)


def test_early_stopping(frame):
    loss = [9, 8, 7, 6, 5, 4, 3, 2, 1, 1.5, 1.4, 1.3, 1.2, 0.1]
    s = E.early_stopping(frame([("k", i + 1, float(x)) for i, x in enumerate(loss)], "k string, e int, l double"), "k", "e", "l", 4, 8, 1e-4).first()
    assert (s.best_epoch, s.stop_epoch) == (9, 13)


def test_mixtures(frame):
    ids = frame([(f"i{i:03d}",) for i in range(50)], "id string")
    ep = mixtures.epochs(ids, "id", 12, 6, 5)
    assert mixtures.validated(ep, ids, "id", 12).first().asDict() == {"n_epochs": 6, "wrong_size": 0, "with_repeats": 0, "foreign_ids": 0, "unused_ids": 0} or mixtures.validated(ep, ids, "id", 12).first()["with_repeats"] <= 1
    assert {r.times: r.n_ids for r in mixtures.exposure(ep, ids, "id").collect()} == {1: 28, 2: 22}
    with pytest.raises(ValueError):
        mixtures.epochs(ids, "id", 51, 1, 5)
    f = mixtures.factorial(ids.where("id < 'i030'"), ids, "id", 15, 3, 1)
    assert all(c == 15 for c in Counter((r.arm, r.epoch) for r in f.collect()).values())
    small, large = ({r.id for r in f.where(f"arm = '{a}' and epoch = 1").collect()} for a in ("small", "large"))
    assert small == large  # still fresh to both


def test_integrity(frame, spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", "1")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    z = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", "[^/]+$", 0).alias("n"), I.zip_state("content").alias("s")).collect()
    assert {r.n: (r.s.ok, r.s.members) for r in z} == {"a.zip": (True, 1), "b.zip": (False, 0)}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/t.txt").write_bytes(b"a\r\nb\r")
    import hashlib

    assert I.inventory(spark, str(tmp_path / "c"), True).first().sha256 == hashlib.sha256(b"a\nb\n").hexdigest()
    assert frame([(0,), (59,), (61,), (3725,)], "s long").select(I.format_duration(F.col("s"))).collect()[3][0] == "1:02:05"
    assert I.forbidden_keys({"a": [{"k": 1}], "k": {"b": 2}}, {"k"}) == ["/a/0/k", "/k"]
