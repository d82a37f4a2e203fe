import os
import random

import pytest
from pyspark.sql import functions as F

from vietloom.llm import packing, tokens

needs = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")


@needs
def test_encode_round_trip(frame, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 3000)
    r = random.Random(1)
    odd = ["", None, " ", "\n\n  a b", "it's we'll 'tis", "<|endoftext|> x", "🥺❤️ ô̂ ̣", "a\u001cb\u0085c", "质量一般，卖家", "12345 6,7", "!!'s ??", "x" * 20_000, "   trailing   "]
    rows = list(enumerate(odd)) + [(100 + i, "".join(r.choice("ab đế 🥺'!.\n\t12") for _ in range(r.randint(0, 300)))) for i in range(60)]
    df = frame(rows, "n long, x string").withColumn("words", F.lit(1)).withColumn("block", F.lit(2))
    got = {g.n: list(g.ids) for g in tokens.encode(df, "n", "x").collect()}
    t = tokens.tokenizer(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    assert got == {n: t.encode(x or "", add_special_tokens=False).ids for n, x in rows}
    back = {b.n: b.text for b in tokens.decode(frame(list(got.items()), "n long, ids array<int>"), "n").collect()}
    assert back == {n: x or "" for n, x in rows}
    assert tokens.encode(df.where("n < 0"), "n", "x").count() == 0


def test_plan_packs_tight():
    r = random.Random(2)
    counts = {s: r.randint(1, 50) for s in r.sample(range(1, 2049), 400)}
    total = sum(s * n for s, n in counts.items())
    p = packing.plan(counts)
    used = {}
    for sizes, length, times in p:
        assert sum(sizes) <= length
        for s in sizes:
            used[s] = used.get(s, 0) + times
    assert used == counts
    bins = sum(t for _, _, t in p)
    assert bins <= max(total / 2048, sum(n for s, n in counts.items() if s > 1024)) * 1.02 + 1  # two items over half a container never share one
    small = packing.plan({100: 1}, (128, 2048))
    assert small == [((100,), 128, 1)] and packing.plan({}) == []
    with pytest.raises(ValueError):
        packing.plan({4000: 1})


def test_pack(frame):
    r = random.Random(3)
    rows = [(i, r.choice([5, 5, 5, 700, 1500, 2048, 2049, 5000, 0, None])) for i in range(300)]
    got = packing.pack(frame(rows, "n long, z int"), "n", "z").collect()
    by, size = {}, {}
    for g in got:
        by.setdefault((g.container, g.length), 0)
        by[g.container, g.length] += g.size
        size[g.n] = size.get(g.n, 0) + g.size
    assert all(u <= length <= 2048 for (_, length), u in by.items()) and len({c for c, _ in by}) == len(by)
    assert size == {i: z or 0 for i, z in rows}
    assert all(sum(g.n == i for g in got) == max(1, -(-(z or 0) // 2048)) for i, z in rows)
    assert packing.pack(frame([], "n long, z int"), "n", "z").count() == 0
    assert [g.container for g in packing.pack(frame([(1, None)], "n long, z int"), "n", "z").collect()] == [1]
