import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vietloom.llm import mojibake, pairs, pii, toxicity
from vietloom.llm.crf import TokenCrf

DATA = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_crf_viterbi_brute():
    r = np.random.default_rng(1)
    m = TokenCrf(3, lambda t: [t, t[0]], offsets=(-1, 0, 1), bits=8)
    m.w, m.t, m.start = (r.normal(size=x.shape).astype(np.float32) for x in (m.w, m.t, m.start))
    rows = [["a1", "b2", "a1", "c"], [], ["c"], ["b2", "b2", "a1"]]
    off = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    names = ["a1", "b2", "c"]
    which = np.array([names.index(t) for x in rows for t in x])
    got, e = m.decode(off, names, which), m.emissions(off, names, which)
    import itertools

    for i in range(len(rows)):
        n = len(rows[i])
        if n:
            s = lambda p: m.start[p[0]] + sum(e[off[i] + k, p[k]] for k in range(n)) + sum(m.t[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert tuple(got[off[i] : off[i + 1]]) == max(itertools.product(range(3), repeat=n), key=s)


def test_crf_learns():
    r = random.Random(2)
    rows = [[r.choice("xyz") for _ in range(r.randint(2, 8))] for _ in range(200)]
    labels = [[0] + [int(a == "x") for a in x[:-1]] for x in rows]
    m = TokenCrf(2, lambda t: [t], offsets=(-1, 0), bits=8).fit(rows, labels, epochs=60)
    off = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    assert (m.decode(off, list("xyz"), np.array(["xyz".index(t) for x in rows for t in x])) == np.array([y for x in labels for y in x])).mean() > 0.98


@pytest.fixture(scope="module")
def tagger():
    import pandas as pd

    t = list(pd.read_parquet(f"{DATA}/corpus.parquet").input_text.dropna())
    return pii.train(t)


@needs
def test_private_data(tagger):
    cases = {
        "liên hệ qua an.99@hop.test nhé": {"email"}, "viết cho binh_shop[a còng]thu chấm example": {"email"}, "alo +84 612 345 678 gấp": {"phone"}, "sđt 0612.345.678": {"phone"}, "zalo không sáu ba hai bốn ba ba sáu hai bảy": {"phone"},
        "căn cước 098 765 432 109": {"id_number"}, "số hộ chiếu K1234567 nha": {"id_number"}, "giao tới hẻm 12 đường Hoa Sen, quận Đồi Mây": {"address"}, "người nhận là Trần Khánh Nga": {"name"},
        "mã vận đơn 5908 202 60": set(), "mã đơn DH58692728": set(), "theo dõi @shopxinh nhé": set(), "giá chỉ 495.000đ": set(), "bánh tráng được 593 phần trăm mà nhạt nhẽo": set(), "": set(),
    }
    found = pii.find(tagger, [*cases, None])
    assert sum({k for _, _, k in f} == want for f, want in zip(found, cases.values(), strict=False)) >= len(cases) - 1 and found[-1] == []
    t = "alo  +84 612 345 678,  cảm ơn!"
    assert pii.redact(t, [(5, 20, "phone")]) == "alo  <PHONE>,  cảm ơn!"


@needs
def test_private_data_held_out(tagger):
    """Types per row on rows written by another seed of the generator, over backgrounds of the tables."""
    import pandas as pd

    xs, ys = pii.labelled(list(pd.read_parquet(f"{DATA}/gold.parquet").input_text), rows=300, seed=99)
    off = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    which, names = pd.factorize(np.array([t for x in xs for t in x], dtype=object))
    got = tagger.decode(off, list(names), which)
    y = np.array([v for r in ys for v in r])
    assert ((got > 0) == (y > 0)).mean() > 0.97


@needs
def test_annotate_frame(frame, tagger):
    df = frame([("a", "sđt 0612345678", 1), ("b", None, 2), ("a", "sđt 0612345678", 3)], "id string, x string, spans int")
    got = {r.id: (r.redacted, len(r.spans)) for r in pii.annotate(df, "id", "x", tagger).collect()}
    assert got == {"a": ("sđt <PHONE>", 1), "b": (None, 0)}
    assert pii.annotate(df.where("id = ''"), "id", "x", tagger).count() == 0


def test_pairs():
    sound = [(f"hom nay t k bik lam j, mai minh di choi nha {i} nguoi ban cu", f"hôm nay tôi không biết làm gì, mai mình đi chơi nhà {i} người bạn cũ") for i in range(50)]
    m = pairs.train(sound)
    a, b = sound[3]
    cases = [
        (b, None), (None, "empty"), (" \n", "empty"), ("N/A", "empty"), ("…", "empty"), (a, "copy"), (f"Input: {a.upper()}!", "copy"), (" ".join(b.split()[:8]) + "…", "truncated"),
        ("Xin lỗi, tôi không thể xử lý yêu cầu này. Cảm ơn bạn", "refusal"), ("I'm sorry, I can't help with this text", "refusal"), ("The seller sent me a broken phone and the box arrived very late again", "other_language"), ("质量一般，卖家热情，价格便宜", "other_language"),
    ]
    assert pairs.defects(m, [a] * len(cases), [x for x, _ in cases]) == [w for _, w in cases]
    assert pairs.defects(m, [None, None, ""], [None, "mình đi chơi nhé", "mình đi"]) == ["empty", None, None]


def test_flag_frame(frame):
    m = pairs.train([])
    df = frame([("1", "a b c d", None), ("2", "mot hai", "một hai"), ("2", "mot hai", "một hai"), ("3", None, "null")], "defect string, s string, x string").withColumnRenamed("defect", "id")
    assert {(r.id, r.defect) for r in pairs.flag(df, ["id"], "s", "x", m).collect()} == {("1", "empty"), ("3", "empty")}


CLEAN = ["mình thấy quán nước này rất ổn định và dễ chịu", "hôm qua cả nhà đi chơi ở công viên với bạn bè", "thầy chủ nhiệm kể về cuốn truyện cũ kỹ trên lớp", "được chứ, nhưng mà lớp học thêm vẫn đông người", "ngoài ra bữa cơm tối nay khá đậm đà và nóng hổi"]


def test_mojibake(frame):
    r = random.Random(1)
    clean = [" ".join(r.sample(CLEAN, 2)) for _ in range(150)]
    bad = [(f"{c}{i}", x.encode().decode(c, "ignore" if c == "cp1252" else "strict") if c != "twice" else x.encode().decode("latin-1").encode().decode("latin-1"), x) for i in range(4) for c in ("latin-1", "mac_roman", "twice") for x in [clean[i]]]
    part = [("part", "Hôm nay " + "thấy quán nước".encode().decode("latin-1") + " rất vui", "Hôm nay thấy quán nước rất vui")]
    lost = [("lost", "Em l�c n�o c�ng", None)]
    fine = [("ok1", "quán café «Ngõ Nhỏ» ©"), ("ok2", "nhiệt độ 37°C ±1"), ("ok3", "hãng Ôm® to"), ("ok4", "giá 12€ hay £9 🥺"), ("ok5", None), ("ok6", " "), ("ok7", "Ơ KÌA Ã Ạ"), ("ok8", "hay không? được?")]
    rows = [(f"c{i}", x, "s") for i, x in enumerate(clean)] + [(i, x, "s") for i, x, _ in bad + part + lost] + [(i, x, None) for i, x in fine]
    got = {g.id: g for g in mojibake.restore(frame(rows, "id string, x string, s string").withColumn("t", F.lit(1)), "id", "x", "s").collect()}
    found = {i for i, g in got.items() if g.garbled}
    assert found == {i for i, *_ in bad + part + lost}
    assert sum(got[i].restored == w for i, _, w in bad + part) >= len(bad)


def test_mojibake_flags_are_per_text():
    t = ["mình vui", "quán?", "lớp học", None, "thÊy", "M·∫π"]
    assert mojibake.suspects(t).tolist() == [False, False, False, False, True, True]


def test_channel_and_scores(frame):
    r = random.Random(1)
    bad, good = ["đồ khốn nạn", "thằng chó má", "lũ súc vật"], ["bánh mì ngon", "quán nước đẹp", "trà sữa thơm", "mưa to quá"]
    corpus = frame([(f"c{i}", " ".join(r.choice(good + bad) for _ in range(6))) for i in range(300)], "id string, x string")
    lab = frame([(f"{r.choice(good)} {x} {r.choice(good)}", int(x in bad)) for x in (good + bad) * 20], "x string, y int")
    ch, m = toxicity.learn(corpus, "x", lab, "y")
    assert ch.text("k*h*ố*n n-ạ-n nhé") == "khon nan nhé" and ch.text("ch0 má").startswith("cho") and ch.text("s ú c vật") and ch.text(None) is None
    assert ch.text("bánh mì ngon") == "bánh mì ngon"
    t = [("1", "bánh mì ngon đồ khốn nạn"), ("2", "trà sữa thơm"), ("3", "THẰNG CHÓ MÁ"), ("4", None), ("5", " "), ("6", "do kh-on n.a.n"), ("2", "trà sữa thơm")]
    s = {x.id: x.score for x in toxicity.scores(frame(t, "id string, x string").withColumn("w", F.lit(1)), "id", "x", ch, m).collect()}
    assert min(s["1"], s["3"], s["6"]) > 0.25 > max(s["2"], s["4"], s["5"]) and len(s) == 6


@needs
def test_toxicity_held_out(spark):
    lab = spark.read.parquet(f"{DATA}/toxicity_labels.parquet")
    ch, m = toxicity.learn(spark.read.parquet(f"{DATA}/corpus.parquet"), "input_text", lab.where("label_id % 4 <> 0"), "toxic")
    held = lab.where("label_id % 4 = 0")
    s = toxicity.scores(held, "label_id", "input_text", ch, m).join(held.select("label_id", "toxic"), "label_id").collect()
    tp = sum(x.score > 0.25 and x.toxic == 1 for x in s)
    assert tp >= 0.88 * sum(x.toxic for x in s) and sum(x.score > 0.25 and x.toxic == 0 for x in s) <= 3


@needs
def test_prefilter_misses_no_span(spark):
    t = [r[0] for r in spark.read.parquet(f"{DATA}/toxicity_labels.parquet").select("input_text").collect()] + ["a-b", "x y z", "g41", "k**n", "a@b", "", None, "v c l như"]
    may = toxicity.maybe(t)
    assert all(m or not x or not toxicity._SPAN.search(x) for x, m in zip(t, may, strict=True))


@needs
def test_queries_run(spark):
    from vietloom.llm import queries

    q = queries.queries()
    assert {f"p{n}_{'ids' if n == 8 else 'pack' if n == 9 else 'found'}" for n in range(1, 11)} <= set(q)
    for n in ("p1_report", "p2_collapsed", "p3_counts", "p4_rates", "p5_rates", "p6_rates", "p7_redacted", "p8_roundtrip", "p9_report", "p10_shares"):
        assert len(q[n](spark, DATA).collect()) > 0
