import unicodedata
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vietloom.functions import edits as D
from vietloom.functions.text import clean_text, composed, fold_words, strip_diacritics


def test_clean_text(frame):
    rows = [(None,), ("",), (" \t\n",), ("a b\u001cc　d",), ("ét",), ("hayyyyy 🥺",), ("x" * 50_000,)]
    got = [r[0] for r in frame(rows, "t string").select(clean_text("t")).collect()]
    assert got == [None, None, None, "a b c d", "ét", "hayyyyy 🥺", "x" * 50_000]


def test_strip_diacritics_composed_and_not(frame):
    t = "Đường ƯỚT nhòe Ệ"
    got = frame([(t,), (unicodedata.normalize("NFD", t),)], "t string").select(strip_diacritics(F.col("t"))).collect()
    assert [r[0] for r in got] == ["duong uot nhoe e"] * 2


def test_fold_words(frame):
    got = frame([("Nhaaa, đi-NÀO 12_3!",), ("...",), (None,)], "t string").select(fold_words(F.col("t"), squeeze=True)).collect()
    assert [r[0] for r in got] == [["nha", "di", "nao", "12", "3"], [], None]


def _lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_token_levenshtein(frame):
    import random

    r = random.Random(1)
    pairs = [(" ".join(r.choice("a b c đ 🥺 ơi".split()) for _ in range(r.randint(0, 9))), " ".join(r.choice("a b c đ 🥺 ơi".split()) for _ in range(r.randint(0, 9)))) for _ in range(120)]
    got = frame(pairs, "a string, b string").select(D.token_levenshtein(D.tokens(F.col("a")), D.tokens(F.col("b")))).collect()
    assert [g[0] for g in got] == [_lev(a.split(), b.split()) for a, b in pairs]


def test_token_edits_and_ratio(frame):
    df = frame([("t k bik", "tôi không biết"), ("a b", "a b"), ("a", None), ("x y", "")], "a string, b string")
    e = [r[0] for r in df.select(D.token_edits("a", "b")).collect()]
    assert [(x.src, x.tgt) for x in e[0]] == [("t k bik", "tôi không biết")] and e[1] == [] and e[2] is None and [(x.src, x.tgt) for x in e[3]] == [("x y", "")]
    assert abs(df.select(D.char_edit_ratio("a", "b")).first()[0] - (1 - SequenceMatcher(None, "t k bik", "tôi không biết").ratio())) < 1e-12


@settings(max_examples=150, deadline=None)
@given(st.text("ab đơ,\n!", max_size=20), st.text("ab đơ,\n!", max_size=20))
def test_diff_keeps_both_texts(a, b):
    d = D.diff_rows(a, b)
    assert "".join(x["src_space"] + x["src"] for x in d) == a
    assert "".join(x["tgt_space"] + x["tgt"] for x in d) == b
    assert all((x["kind"] == "equal") == (x["group_id"] is None) for x in d)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_tokens_are_a_longest_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    # walking back from the ends, the first text's tokens are dropped first
    want, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            want.append((i, j))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    assert D.common_tokens(a, b) == want[::-1] and len(want) == best[-1][-1]


def test_diff_of_known_texts():
    kinds = lambda a, b: [(x["kind"], x["src"], x["tgt"]) for x in D.diff_rows(a, b)]
    assert kinds("k biết", "không biết") == [("changed", "k", "không"), ("equal", "biết", "biết")]
    assert kinds("hqua đi học", "hôm qua đi học")[0] == ("changed", "hqua", "hôm qua")
    assert kinds("hs, cx", "học sinh, cũng") == [("changed", "hs", "học sinh"), ("equal", ",", ","), ("changed", "cx", "cũng")]
    assert kinds("", "") == [] and kinds("a b", "a b") == [("equal", "a b", "a b")] and kinds("", "a b") == [("inserted", "", "a b")]
    long = [f"w{i}" for i in range(70)]
    got = kinds(" ".join(long), " ".join(f"{w}x" for w in long))  # 4,900 cells, aligned word by word
    assert got == [("changed", w, f"{w}x") for w in long]


LIKE = {("k", "không"): 0.95, ("hs", "học sinh"): 0.95, ("cx", "cũng"): 0.25, ("hqua", "hôm qua"): 0.92, ("Đẹp", "dep"): 1.0, ("mn", "mọi người"): 0.95, ("ngừi", "người"): 0.85, ("bt", "biết"): 0.85, ("hocsinh", "học sinh"): 1.0}


def test_similarity(frame):
    df = frame([(a.split(), b.split()) for a, b in LIKE], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(D.similarity(F.col("a"), F.col("b"))).collect()]
    for (a, b), want, g in zip(LIKE, LIKE.values(), got, strict=True):
        assert abs(g - D.chunk_similarity(a.split(), b.split())) < 1e-12 and abs(g - want) < 1e-9, (a, b, g)


def test_code_points_of_places(frame):
    """Places beside and beyond the surrogates stand for code points that are unlike each other and survive decoding."""
    places = [1, 2, 35_000, 55_040, 55_041, 55_042, 60_000, 65_000, 70_000, D.VOCABULARY]
    got = [r[0] for r in frame([(p,) for p in places], "p long").select(F.decode(F.unhex(D.code_point(F.col("p"))), "UTF-32")).collect()]
    assert len(set(got)) == len(places) and all(len(x) == 1 and x != "\ufffd" for x in got)
    far = "".join(got)
    df = frame([(far, far[1:] + "x", far[::-1])], "a string, b string, c string")
    assert df.select(F.levenshtein("a", "b"), F.levenshtein("a", "a")).first()[:] == (2, 0)


def test_lexical_tokens(frame):
    got = frame([("Hi, bạn  ơi!\n-x",), ("",), (None,)], "t string").select(D.lexical_tokens(F.col("t")).alias("x")).collect()
    assert [(t.space, t.text, t.is_word) for t in got[0].x] == [("", "Hi", True), ("", ",", False), (" ", "bạn", True), ("  ", "ơi", True), ("", "!", False), ("\n", "-", False), ("", "x", True)]
    assert got[1].x == [] and got[2].x is None


def test_nfc_guard_changes_nothing(frame):
    import unicodedata

    texts = ["e\u0301", "é", "Å", "\u212b", "한", "\u1112\u1161\u11ab", "🙂 \u2003x", "ﬁ", "\u2000a", "a\u200db", "x\n", None]
    got = [r.x for r in frame([(t,) for t in texts], "t string").select(composed(F.col("t")).alias("x")).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
