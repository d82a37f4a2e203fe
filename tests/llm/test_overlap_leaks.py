import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from vietloom.llm import formatting_dups, leaks, seeds, shared_spans, split_overlap

WORDS = "mình tôi bạn ăn cơm đi chơi nhà phố mưa nắng sách vở xe máy điện thoại trường lớp quán nước trà sữa bánh mì".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_alignment():
    r = random.Random(1)
    xs = [np.array([r.randint(1, 5) for _ in range(r.randint(0, 30))], np.int64) for _ in range(300)]
    ys = [np.array([r.randint(1, 5) for _ in range(r.randint(0, 30))], np.int64) for _ in range(300)]
    true = [lev(list(x), list(y)) for x, y in zip(xs, ys, strict=True)]
    d, same = split_overlap.align(xs, ys, np.full(300, 40))
    assert d.tolist() == true
    assert all(s <= min(len(x), len(y)) and max(len(x), len(y)) - s <= t for s, x, y, t in zip(same, xs, ys, true, strict=True))
    band = np.array([r.randint(0, 20) for _ in xs])
    d, _ = split_overlap.align(xs, ys, band)
    assert [(x if x <= k else -1) for x, k in zip(d, band, strict=True)] == [(x if x <= k else -1) for x, k in zip(true, band, strict=True)]


def test_minima_are_disjoint_and_least():
    r = random.Random(4)
    rows = [[r.randint(1, 30) for _ in range(n)] for n in (4, 5, 9, 40, 63, 64, 65, 200, 1000)]
    off, h = np.cumsum([0, *map(len, rows)]).astype(np.int64), np.array([x for w in rows for x in w], np.int64)
    n = np.diff(off)
    sketch = np.full(1 << 12, 5, np.uint8)
    want = split_overlap.need(n, 4)
    row, pos, g = seeds.minima(off, h, want, sketch)
    assert np.bincount(row, minlength=len(n)).tolist() == want.tolist()
    size = {}
    for k in range(1, seeds.GRAM + 1):
        size |= {int(x): k for x in seeds.run_hashes(off, h, k)}
    for i in range(len(n)):
        spans = sorted((p, p + size[int(x)]) for p, x in zip(pos[row == i], g[row == i], strict=True))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= n[i]


def test_overlap_recall_with_regular_changes(frame):
    """Each k-th word changed to one that stands nowhere else: all pairs within a quarter are found, at any length."""
    r = random.Random(5)
    rows, want = [], set()
    for n in (4, 8, 12, 24, 40, 80, 200):
        for every in (4, 5, 6):
            for i in range(12):
                w = [r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n)]
                name = f"{n}q{every}q{i}"
                rows.append((f"t{name}", "train", " ".join(w)))
                rows.append((f"e{name}", "dev", " ".join(f"zz{name}x{j}" if j % every == every - 1 else x for j, x in enumerate(w))))
                want.add((f"e{name}", f"t{name}"))
    got = {(g.eval_id, g.train_id): g for g in split_overlap.overlaps(frame(rows, "id string, split string, x string"), "id", "x", "split").collect()}
    assert want <= set(got)
    assert all(g.n_equal == g.n_words - g.distance for k, g in got.items() if k in want)


def test_overlap_with_other_shares(frame):
    """Short texts against brute force where a half or a third of the words may differ."""
    r = random.Random(9)
    rows = [(f"{k}{i}", k, " ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randint(1, 7)))) for i in range(40) for k in ("train", "dev")]
    df = frame(rows, "id string, split string, x string")
    for share in (2, 3):
        want = {(a, b) for a, s, x in rows for b, t, y in rows if s == "dev" and t == "train" and lev(x.split(), y.split()) * share <= max(len(x.split()), len(y.split()))}
        assert {(g.eval_id, g.train_id) for g in split_overlap.overlaps(df, "id", "x", "split", share=share).collect()} == want


def test_overlap_of_hot_and_repetitive_texts(frame):
    """A phrase in all records of both sides, and long texts of one word, cost no pair and make no product."""
    r = random.Random(6)
    hot = "xin chào mọi người hôm nay shop có hàng mới về".split()
    rows = []
    for i in range(150):
        own = [r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(12)]
        rows += [(f"t{i}", "train", " ".join(hot + own)), (f"e{i}", "test", " ".join(hot + own[:-1] + [f"khác{i}"]))]
    rows += [("tl", "train", "ha " * 3000), ("el", "dev", "ha " * 2900 + "hi " * 50), ("tm", "train", "ha " * 500)]
    got = {(g.eval_id, g.train_id) for g in split_overlap.overlaps(frame(rows, "id string, split string, x string"), "id", "x", "split").collect()}
    assert got == {(f"e{i}", f"t{i}") for i in range(150)} | {("el", "tl")}


def test_split_overlap_brute(frame):
    r = random.Random(2)
    rows, words = [], {}
    for i in range(60):
        t = text(r, r.randint(3, 40))
        rows.append((f"t{i}", "train", t))
        w = t.split()
        for _ in range(r.randint(0, len(w) // 3)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((f"e{i}", r.choice(["dev", "test"]), " ".join(w).upper() + "!!"))
    rows += [("n1", "train", None), ("n2", "dev", "..."), ("n3", "dev", None), ("n4", None, rows[0][2]), ("t0", "train", rows[0][2])]
    from vietloom.functions.text import fold_words

    df = frame(rows, "id string, split string, x string")
    for p in df.select("id", "split", fold_words(F.col("x"), True).alias("w")).collect():
        words[p.id, p.split] = p.w or []
    want = set()
    for (a, s), x in words.items():
        for (b, s2), y in words.items():
            if s in ("dev", "test") and s2 == "train" and x and y and lev(x, y) * 4 <= max(len(x), len(y)):
                want.add((a, b))
    got = {(g.eval_id, g.train_id) for g in split_overlap.overlaps(df, "id", "x", "split").collect()}
    assert got == want and len(want) > 15
    assert split_overlap.overlaps(df.where("id = ''"), "id", "x", "split").count() == 0


def test_leaks_brute(frame):
    r = random.Random(3)
    items = [(f"g{i}", text(r, r.randint(5, 40)), text(r, 20) if i % 3 else None) for i in range(30)]
    corpus = []
    for i in range(80):
        own = text(r, r.randint(0, 30)).split()
        if r.random() < 0.6:
            w = (r.choice(items)[1]).split()
            a = r.randrange(len(w))
            at = r.randint(0, len(own))
            own = own[:at] + w[a : a + r.randint(8, 30)] + own[at:]
        corpus.append((f"c{i}", ", ".join(own).title()))
    corpus += [("n", None), ("b", " "), ("c0", corpus[0][1]), ("long", text(r, 20_000) + " " + items[0][1] + " " + items[1][1])]
    norm = lambda t: "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not unicodedata.combining(c)).replace("đ", "d").replace(",", " ").split()
    grams = lambda w: {tuple(w[i : i + 14]) for i in range(len(w) - 13)}
    want = {(c, g) for c, t in corpus for g, *ts in items if any(grams(norm(t)) & grams(norm(x)) for x in ts)}
    got = leaks.leaks(frame(corpus, "id string, x string").withColumn("g", F.lit(1)), "id", "x", frame(items, "id string, a string, b string"), "id", ["a", "b"]).collect()
    assert {tuple(g) for g in got} == want and len(want) == len(got) >= 10


def test_formatting(frame):
    t = "Ổn định, ĐẸP lắm 🥺 5 sao"
    same = [t, unicodedata.normalize("NFD", t), "ổn  định đẹp-lắm🥺5 SAO!!!", "ổn định đẹp lắm 🥺️ (5) sao"]
    other = ["ổn định đẹp lắm 5 sao", "on dinh dep lam 🥺 5 sao", "ổn định đẹp lắm 🥺 6 sao", "định ổn đẹp lắm 🥺 5 sao"]
    rows = [(i, x, "S") for i, x in enumerate(same + other)] + [(20, t, "T"), (21, t, None), (22, t, None), (30, None, "S"), (31, " 　", "S"), (40, "x" * 100_000, "S"), (41, "X " * 100_000, "S")]
    got = {tuple(r) for r in formatting_dups.copies(frame(rows, "n long, x string, s string").withColumn("h1", F.lit("clash")), "n", "x", "s").collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (21, 22), (40, 41)}
    c = {r.first_id: r.n_copies for r in formatting_dups.collapsed(frame(rows, "n long, x string, s string"), "n", "x", "s").collect()}
    assert c[0] == 4 and c[4] == 1 and c[40] == 2 and 30 not in c
    assert formatting_dups.copies(frame([], "n long, x string, s string"), "n", "x", "s").count() == 0
    h = formatting_dups.fold_hash(["straße", "STRASSE", "각", unicodedata.normalize("NFD", "각"), "", None])
    assert h[0][0] == h[0][1] and h[0][2] == h[0][3] and h[0][4] == h[0][5] == 0


def test_formatting_hot_group(frame, monkeypatch):
    monkeypatch.setattr(formatting_dups, "HOT", 5)
    rows = [(i, "một câu" + "!" * (i % 7), "S") for i in range(200)] + [(1000 + i, f"câu {i}", "S") for i in range(100)]
    got = formatting_dups.copies(frame(rows, "n long, x string, s string"), "n", "x", "s").collect()
    assert sorted(g.copy_id for g in got) == list(range(1, 200)) and {g.first_id for g in got} == {0}


def test_shared_spans_brute(frame):
    r = random.Random(4)
    base = "".join(r.choice("abcđ ế🥺") for _ in range(400))
    rows = [(i, "".join(r.choice("abcđ ế🥺") for _ in range(r.randint(0, 500)))) for i in range(40)]
    for i in range(14):
        n = r.choice([100, 119, 120, 121, 200])
        a = r.randrange(len(base) - n)
        rows.append((100 + i, rows[i][1][:50] + base[a : a + n] + "z" * i))
    rows += [(200, base), (201, base), (202, None), (203, ""), (204, "ab" * 300), (205, "x" + "ab" * 70 + "y"), (206, "q" * 500)]
    df = frame(rows, "n long, x string")
    got = {g.n: g.n_shared for g in shared_spans.shared(df, "n", "x").collect()}
    seen, at = {}, {}
    for i, t in rows:
        for j in range(len(t or "") - 119):
            seen.setdefault(t[j : j + 120], set()).add(i)
    for i, t in rows:
        cover = set()
        for j in range(len(t or "") - 119):
            if len(seen[t[j : j + 120]]) > 1:
                cover |= set(range(j, j + 120))
        if cover:
            at[i] = len(cover)
    assert got == at and 200 in got and 204 in got and 206 not in got
    assert shared_spans.shared(df.where("n < 0"), "n", "x").count() == 0
