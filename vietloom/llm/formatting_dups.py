"""Problem 2: records that are the same apart from formatting.

Text is streamed through a lookup table that skips (white space, punctuation, controls) and folds (case, Unicode
composition) code points straight into two rolling polynomial hashes; no canonical string is made. Rows whose
128-bit hash and folded length clash are compared by two pointers that skip and fold on the fly.

Cases: null or blank texts are no records (dropped); a null source equals a null source; texts of nothing but
punctuation are equal to each other within a source; ties of ids give no copy row.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import U, bitmap, codes, in_bitmap, mix

#: Code points from here on are kept as they are, unfolded: none of them has case, composition or is punctuation in use.
TABLE_END = 0x20000
HOT = 10_000
MULTS = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_ASCII_SYMBOLS = set("$+<=>^`|~")
#: Variation selectors and joiners only choose a drawing style.
_STYLE = {0xFE0E, 0xFE0F, 0x200D, 0x200C, 0x2060}


def _letters(cp: int) -> str | None:
    """Folded, decomposed letters of a code point; None if it is skipped."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat[0] in "PZC" or ch in _ASCII_SYMBOLS or cp in _STYLE:
        return None
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", ch).casefold())


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: how many base letters it adds, and its hash value under each multiplier.

    Combining marks add at their base letter's place, so composed and decomposed forms, and marks in any order, sum
    to the same value.
    """
    adv = np.ones(TABLE_END, np.uint8)
    own = mix(np.arange(TABLE_END, dtype=U) + U(0x5851F42D))
    val = np.stack([mix(own ^ U(3)), mix(own ^ U(5))])
    base = val.copy()
    for cp in range(TABLE_END):
        if 0x3400 <= cp < 0xA000:  # ideographs stand for themselves
            continue
        t = _letters(cp)
        if t is None:
            adv[cp] = 0
            val[:, cp] = 0
        elif len(t) != 1 or ord(t) != cp or unicodedata.combining(t[0]):
            at, v = -1, [0, 0]
            for c in t:
                mark = unicodedata.combining(c) != 0
                at += not mark
                for j in (0, 1):
                    # a mark alone in its code point stands at the place before, hence the inverse power
                    p = pow(int(MULTS[j]), at, 1 << 64)
                    v[j] = (v[j] + int(base[j, min(ord(c), TABLE_END - 1)]) * (3 if mark else 1) * p) % (1 << 64)
            adv[cp] = at + 1
            val[:, cp] = np.array(v, dtype=U)
    return adv, val


def fold_hash(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash 1, hash 2, number of folded letters) of each text."""
    adv, val = _tables()
    off, cp = codes(texts)
    known = np.minimum(cp, TABLE_END - 1)
    step = adv[known].astype(np.int64)
    if (far := cp >= TABLE_END).any():
        step[far] = 1
    upto = np.concatenate([[0], np.cumsum(step)])
    rank = upto[:-1] - np.repeat(upto[off[:-1]], np.diff(off))
    n = upto[off[1:]] - upto[off[:-1]]
    out = []
    for j in (0, 1):
        v = val[j][known]
        if far.any():
            v[far] = mix(cp[far].astype(U) + U(7 + j))
        power = np.concatenate([np.ones(1, U), np.cumprod(np.full(int(rank.max(initial=0)) + 1, MULTS[j], dtype=U))])
        total = np.concatenate([np.zeros(1, U), np.cumsum(v * power[rank], dtype=U)])
        out.append(total[off[1:]] - total[off[:-1]])
    return out[0], out[1], n


@functools.cache
def _fold_char(ch: str) -> tuple[str, ...]:
    return tuple(_letters(ord(ch)) or "") if ord(ch) < TABLE_END else (ch,)


def _stream(t: str):
    """Folded letters one by one, the marks of one base letter in a fixed order."""
    marks: list[str] = []
    for ch in t:
        for c in _fold_char(ch):
            if unicodedata.combining(c):
                marks.append(c)
            else:
                if marks:
                    yield from sorted(marks)
                    marks.clear()
                yield c
    yield from sorted(marks)


def same_folded(a: str | None, b: str | None) -> bool:
    """Two-pointer comparison that skips and folds as it goes."""
    if a == b:
        return True
    if a is None or b is None:
        return False
    x, y = _stream(a), _stream(b)
    while True:
        p, q = next(x, None), next(y, None)
        if p != q:
            return False
        if p is None:
            return True


def fold_hash_columns(df: DataFrame, columns: list[str], among: np.ndarray | None = None) -> DataFrame:
    """``df`` with h1, h2, n: hashes over the folded ``columns`` in turn, each kept apart from the next; only rows whose
    h1 may be in the bitmap ``among``, if there is one."""
    fields = [f for f in df.schema.fields if f.name not in ("h1", "h2", "n")]
    keep = [f.name for f in fields]

    def run(batches):
        for b in batches:
            h = [np.zeros(b.num_rows, U), np.zeros(b.num_rows, U)]
            n = np.zeros(b.num_rows, np.int64)
            for c in columns:
                texts = b.column(c).to_pylist()
                x, y, m = fold_hash(texts)
                absent = np.array([t is None for t in texts], U)
                h = [mix(h[0] * U(31) + x + absent), mix(h[1] * U(37) + y + absent)]
                n = n * 1_000_003 + m
            out = pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(v.view(np.int64)) for v in h), pa.array(n)], names=[*keep, "h1", "h2", "n"])
            yield out if among is None else out.filter(pa.array(in_bitmap(among, h[0])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", h1 long, h2 long, n long"
    return df.select(*keep).mapInArrow(run, schema)


def copies(df: DataFrame, id_col: str, text: str | Column, source: str | Column) -> DataFrame:
    """(first_id, copy_id) of every record but the first of each group of copies.

    Groups are found over ids and hashes alone, summed on the map side, so one that holds a third of all rows costs a
    row per task. Only rows that a bitmap of the groups (2 MB) lets through travel with their texts, and once. Rows that clash are compared with the group's first row; groups above ``HOT`` rows are split into
    a part for each so many rows, each with its own copy of the first row.
    """
    rows = df.select(F.col(id_col).alias("_id"), (F.col(text) if isinstance(text, str) else text).alias("_t"), (F.col(source) if isinstance(source, str) else source).alias("_s"))
    rows = rows.where(F.col("_t").rlike(r"[^\s\p{Z}\p{C}]"))
    key = ["h1", "h2", "n"]
    groups = fold_hash_columns(rows, ["_t", "_s"]).groupBy(*key).agg(F.min("_id").alias("_f"), F.count("*").alias("_c")).where("_c > 1")
    groups = written(groups, "groups")
    inside = written(fold_hash_columns(rows, ["_t", "_s"], bitmap(groups, "h1")).join(groups, key), "clashes")
    parts = F.ceil(F.col("_c") / HOT).cast("int")
    first = inside.where("_id = _f").select(*key, F.struct("_id", "_t", "_s").alias("f"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_p"))
    clash = inside.where("_id <> _f").withColumn("_p", F.pmod(F.xxhash64("_id"), parts).cast("int")).join(first, [*key, "_p"])

    def verify(batches):
        for b in batches:
            f = b.column("f")
            first = [f.field(i).to_pylist() for i in range(3)]
            own = [b.column(c).to_pylist() for c in ("_id", "_t", "_s")]
            ok = [same_folded(t, ft) and same_folded(s, fs) for t, ft, s, fs in zip(own[1], first[1], own[2], first[2], strict=True)]
            yield pa.RecordBatch.from_arrays([f.field(0), b.column("_id"), pa.array(ok)], names=["first_id", "copy_id", "ok"])

    kind = dict(df.dtypes)[id_col]
    return clash.select("f", "_id", "_t", "_s").mapInArrow(verify, f"first_id {kind}, copy_id {kind}, ok boolean").where("ok").drop("ok")


def collapsed(df: DataFrame, id_col: str, text: str | Column, source: str | Column) -> DataFrame:
    """One row per distinct record: its first id and the number of copies it had (1 if it stands alone)."""
    c = copies(df, id_col, text, source)
    ids = df.where((F.col(text) if isinstance(text, str) else text).rlike(r"[^\s\p{Z}\p{C}]")).select(F.col(id_col).alias("first_id"))
    counts = c.groupBy("first_id").agg((F.count("*") + 1).alias("n"))
    return ids.join(c.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti").join(counts, "first_id", "left").select("first_id", F.coalesce("n", F.lit(1)).alias("n_copies"))
