"""Learning unknown code pages, ordered samples, kept weights, packing settings, spans against suffix automata."""

import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vietloom.llm import automaton, common, mojibake, packing, pairs, shared_spans, toxicity

DATA = "/root/testdata/sf0.01"
needs = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_assignment_is_the_best():
    import itertools

    r = np.random.default_rng(1)
    for _ in range(60):
        n = int(r.integers(1, 6))
        m = int(r.integers(n, 7))
        g = r.normal(size=(n, m))
        a = mojibake.assign(g)
        assert len(set(a)) == n and abs(g[np.arange(n), a].sum() - max(sum(g[i, c[i]] for i in range(n)) for c in itertools.permutations(range(m), n))) < 1e-9


@needs
def test_unknown_page_is_learned_from_contexts(spark, frame):
    """A page that stands in no table: each letter with a mark becomes a sign at random. One source is garbled by it."""
    r = random.Random(3)
    t = [unicodedata.normalize("NFC", x.input_text) for x in spark.read.parquet(f"{DATA}/corpus.parquet").where("input_text is not null").orderBy("id").collect()]
    t = [x for x, bad in zip(t, mojibake.suspects(t), strict=True) if not bad]
    letters = [c for c in mojibake.ALPHA if ord(c) > 127]
    signs = [chr(c) for c in [*range(0x410, 0x450), *range(0x391, 0x3D0), *range(0x450, 0x460), *range(0xA1, 0xC0)] if chr(c) in mojibake._signs() and chr(c) not in letters]
    r.shuffle(signs)
    page = str.maketrans(dict(zip(letters, signs, strict=False)))
    assert len(signs) >= len(letters)
    rows = [(f"c{i}", "A", x, x) for i, x in enumerate(t[500:])] + [(f"g{i}", "B", x.translate(page), x) for i, x in enumerate(t[:500])]
    df = frame(rows, "id string, s string, x string, true string")
    got = {g.id: g for g in mojibake.restore(df, "id", "x", "s").where("garbled").collect()}
    garbled = [i for i, _, x, true in rows if x != true]
    true = {i: x for i, _, _, x in rows}
    assert sum(i in got for i in garbled) >= 0.98 * len(garbled) and not any(i.startswith("c") for i in got)
    # a letter that is a word by itself, and letters seen a few times only, may stay as they are
    right = total = 0
    for i in garbled:
        for a, b, c in zip(got[i].restored if i in got else "", true[i], true[i].translate(page), strict=False):
            total += b != c
            right += b != c and a == b
    assert right >= 0.97 * total


def test_foreign_scripts_are_no_units(frame):
    df = frame([("1", None, "漢字 한국어 Привет мир"), ("2", None, "日本語のテキスト"), ("3", "x", None), ("4", None, "")], "id string, s string, t string")
    ctx = mojibake.contexts(df, "t", "s").collect()
    assert all(c.u in mojibake._signs() for c in ctx) and not any(ord(k) >= 0x3000 for c in ctx for k in c.u + c.a + c.z)
    assert [r.id for r in mojibake.restore(df, "id", "t", "s").where("garbled").collect()] == []


def test_samples_do_not_depend_on_layout(frame):
    rows = [(f"text {i}", f"answer {i}") for i in range(3000)] + [(None, "x"), ("long " * 2000, "y")]
    a, b = frame(rows, "s string, x string"), frame(rows[::-1], "s string, x string").repartition(7)
    assert common.sampled(a, ["s", "x"], 50) == common.sampled(b, ["s", "x"], 50)
    assert len(common.sampled(a, ["s", "x"], 50)) == 50 and len(common.sampled(a.limit(3), ["s", "x"], 50)) <= 3
    assert pairs.sample(a.where("s = ''"), "s", "x") == []


def test_labels_beyond_the_bound_are_the_same_rows_always(frame, monkeypatch):
    monkeypatch.setattr(toxicity, "LABELLED", 40)
    rows = [(f"bạn ngu {i}" if i % 2 else f"hôm nay vui {i}", i % 2) for i in range(200)] + [(None, 1), ("x", None)]
    corpus = frame([("hôm nay trời đẹp",)], "t string")
    got = [toxicity.learn(corpus, "t", frame(x, "t string, y int").repartition(p), "y")[1] for x, p in ((rows, 1), (rows[::-1], 5))]
    assert np.array_equal(got[0].keys, got[1].keys) and np.allclose(got[0].weights, got[1].weights)


def test_weights_are_made_once(spark):
    calls = []
    make = lambda: calls.append(1) or b"w"
    key = ["k", random.random()]
    assert common.stored(spark, "t", key, make) == b"w" == common.stored(spark, "t", key, make)
    common._models.clear()  # another process finds them in the shared folder
    assert common.stored(spark, "t", key, make) == b"w" and len(calls) == 1


def test_packing_settings():
    r = random.Random(2)
    counts = {s: r.randint(1, 40) for s in r.sample(range(1, 2049), 300)}
    least = -(-sum(s * n for s, n in counts.items()) // 2048)
    few, tight, one = packing.outline(counts), packing.outline(counts, overhead=0), packing.outline(counts, packing.LENGTHS[-1:])
    assert least <= few["n_containers"] <= 1.02 * least and few["n_containers"] <= one["n_containers"] * 1.01 + 1
    assert tight["n_containers"] >= few["n_containers"] and tight["unused_share"] <= few["unused_share"] + 1e-12
    assert packing.outline({}) == {"n_containers": 0, "capacity": 0, "unused_share": 0.0}


def test_spans_against_suffix_automata(frame):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.randint(5, 60)))
    shared = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (119, 120, 121, 200, 340)]
    texts = [word() + "".join(r.choice(shared)[r.randint(0, 30) :] + word() for _ in range(r.randint(1, 3))) for _ in range(24)]
    got = {x.i: x.n_shared for x in shared_spans.shared(frame(list(enumerate(texts)), "i int, t string"), "i", "t", 120).collect()}
    want = {i: n for i, n in enumerate(automaton.covered(texts, 120)) if n}
    assert got == want and len(want) > 5


def test_automaton_knows_all_substrings():
    r = random.Random(8)
    t = "".join(r.choice("abc") for _ in range(60))
    a = automaton.SuffixAutomaton(t)
    q = "".join(r.choice("abcd") for _ in range(80))
    want = [max(n for n in range(i + 2) if q[i + 1 - n : i + 1] in t) for i in range(len(q))]
    assert a.statistics(q) == want and len(a.length) <= 2 * len(t)


def test_hot_copies_are_split_by_their_number(frame):
    from vietloom.llm import formatting_dups

    n = formatting_dups.HOT * 2 + 7
    df = frame([(1,)], "x int").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("t", F.when(F.col("i") % 2 == 0, "Xin chào!").otherwise("xin  CHÀO"))
    assert formatting_dups.copies(df.withColumn("s", F.lit("A")), "i", "t", "s").count() == n - 1
