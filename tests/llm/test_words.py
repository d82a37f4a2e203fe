import random

from pyspark.sql import functions as F

from vietloom.functions.text import fold_words
from vietloom.llm.common import ragged, row_hashes, with_words, word_rows

LETTERS = "aAăẴđĐeéẸ́ oOơỢ  1２3,.-_İßﬁ漢字가나🙂ñ\t ​zZ"


def test_words_are_those_of_the_string_functions(frame):
    r = random.Random(1)
    texts = [None, "", " ,. ", "Hoàààà ĐẸP quáaaa", *("".join(r.choice(LETTERS) for _ in range(r.randint(0, 30))) for _ in range(400))]
    df = frame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for squeeze in (False, True):
        want = {x.i: x.w or [] for x in df.select("i", fold_words(F.col("t"), squeeze).alias("w")).collect()}
        off, h = word_rows(texts, squeeze)
        to: dict = {}
        back: dict = {}
        for i in range(len(texts)):
            own = h[off[i] : off[i + 1]].tolist()
            assert len(own) == len(want[i]), (texts[i], want[i])
            for a, b in zip(own, want[i], strict=True):
                assert to.setdefault(a, b) == b and back.setdefault(b, a) == a


def test_row_hashes_tell_orders_and_places_apart(frame):
    df = with_words(frame([(1, "a b c"), (2, "c b a"), (3, "x a b c"), (4, "A, B c"), (5, None), (6, "a b c " * 5000)], "i int, t string"), "t")
    off, h = ragged(df.orderBy("i").toArrow()["w"])
    k = row_hashes(off, h, 1)
    assert k[0] == k[3] and len({int(x) for x in k}) == 5
