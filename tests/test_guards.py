"""Guards: prompts, paths, artifacts with a fallback, strata, manifests, replays, progress."""

import pytest
from pyspark.sql import functions as F

from vietloom.operators import guards as G
from vietloom.operators import integrity as I
from vietloom.operators import mixtures as M
from vietloom.operators import ranking
from vietloom.operators.review import identity


def test_paths(frame):
    got = [r[0] for r in frame([("D:\\Data\\TEST\\x",), ("data/train",), (None,)], "p string").select(G.has_forbidden_part(F.col("p"), ["/test/"])).collect()]
    assert got == [True, False, None]
    G.refuse_paths(["a/train"], ["test"])
    with pytest.raises(ValueError):
        G.refuse_paths(["a\\Test\\b"], ["/test/"])


def test_prompt_gate():
    policy = {"version": "1"}
    with pytest.raises(ValueError):
        G.freeze_prompt({}, "p", policy, 9, 10)
    c = G.freeze_prompt({}, "p", policy, 10, 10)
    assert c["prompt_frozen"] and G.frozen_prompt("p", policy, True, c["frozen_prompt_sha256"]) == identity("p", policy) and G.freeze_prompt(c, "p", policy, 0, 10) == c
    for args in (("p", policy, False, identity("p", policy)), ("q", policy, True, identity("p", policy))):
        with pytest.raises(ValueError):
            G.frozen_prompt(*args)
    with pytest.raises(ValueError):
        G.freeze_prompt(c, "other", policy, 10, 10)


def test_artifact_with_fallback(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).mkdir()
        (tmp_path / n / "model.bin").write_text(n)
        (tmp_path / n / "vocab.json").write_text("{}")
    h = {n: I.frozen(spark, {"x": f"{tmp_path}/{n}"})["inputs"]["x"]["sha256"] for n in "ab"}
    a, b = ({"path": f"{tmp_path}/{n}", "sha256": h[n]} for n in "ab")
    assert G.chosen(spark, a, b) == a["path"] and [r.name for r in G.named_files(spark, a["path"], {"vocab.json", "merges.txt"}).collect()] == ["vocab.json"]
    (tmp_path / "a/model.bin").write_text("changed")
    assert G.chosen(spark, a, b) == b["path"]
    with pytest.raises(FileNotFoundError):
        G.chosen(spark, a, b | {"sha256": "x"})


def test_strata_too_small_are_refused(frame):
    df = frame([("a", "1"), ("a", "2"), ("b", "3")], "s string, id string")
    q = frame([("a", 2), ("b", 2), ("c", 1)], "s string, quota long")
    assert {r.s: r.missing for r in ranking.short_strata(df, ["s"], q).collect()} == {"b": 1, "c": 1}
    with pytest.raises(ValueError):
        ranking.stratified(df, ["s"], q, "id", 1, strict=True)
    assert ranking.stratified(df, ["s"], q.where("s = 'a'"), "id", 1, strict=True).count() == 2


def test_manifest_faults(frame):
    ep = frame([(0, "a"), (0, "b"), (1, "a"), (1, "a")], "epoch long, id string")
    m = M.manifest(ep, 7)
    assert {r.epoch: (r.epoch_seed, r.pseudo_count, r.n_distinct) for r in m.collect()} == {0: (7, 2, 2), 1: (8, 2, 1)}
    assert {(r.epoch, r.fault) for r in M.manifest_faults(m, 7, 2).collect()} == {(1, "repeated_ids")}
    assert {(r.epoch, r.fault) for r in M.manifest_faults(m.where("epoch = 0"), 8, 3).collect()} == {(0, "seed"), (0, "not_one_to_one")}
    same = M.manifest(frame([(0, "b"), (0, "a")], "epoch long, id string"), 7).first()
    assert same.digest == m.where("epoch = 0").first().digest


def test_replay_and_cells(frame):
    a = frame([("m", 0.5, 1), ("n", 0.1, 2)], "model string, f1 double, n int")
    assert G.replayed(a, a, "model").count() == 0
    b = frame([("m", 0.5, 2), ("o", 0.1, 2)], "model string, f1 double, n int")
    assert {(r.model, r.column) for r in G.replayed(a, b, "model").collect()} == {("m", "n"), ("n", "f1"), ("n", "n"), ("o", "f1"), ("o", "n")}
    c = G.cells(frame([("S", 3), ("S", 3)], "size string, h int"), {"size": ["S", "L"], "h": [3, 8]})
    assert {(r["size"], r.h): r.n for r in c.collect()} == {("S", 3): 2, ("S", 8): 0, ("L", 3): 0, ("L", 8): 0}


def test_progress_and_loading():
    now = [0.0]
    p = G.Progress(10, lambda: now[0], 2)
    now[0] = 4.0
    assert p.advance(2) == {"done": 4, "total": 10, "share": 0.4, "rate": 0.5, "seconds_left": 12.0}
    calls = []
    load = G.once_a_process(lambda: calls.append(1) or "model")
    assert load() == load() == "model" and len(calls) == 1
