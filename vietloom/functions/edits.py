"""Edit distances and alignments: native where Spark can express them, Arrow functions where it cannot."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .text import WS_CLASS, strip_diacritics

EDITS = ArrayType(StructType([StructField("src", StringType()), StructField("tgt", StringType())]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column) -> Column:
    """White-space tokens, none of them empty."""
    return F.array_remove(F.split(c, WS_CLASS + "+"), "")


#: Code points that may stand for tokens: all of Unicode from 256 on, without the surrogates.
VOCABULARY = 0x110000 - 0x800 - 256


def code_point(place: Column) -> Column:
    """The code point that stands for place 1, 2, ..., as eight hex digits."""
    return F.lpad(F.hex(F.when(place + 255 < 0xD800, place + 255).otherwise(place + 255 + 0x800)), 8, "0")


def token_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance in tokens: each pair's tokens become one character each for the built-in ``levenshtein``.

    Places in the pair's own vocabulary are written as code points beside the surrogates; a pair of more than
    :data:`VOCABULARY` (1.1 million) distinct tokens raises an error.
    """

    one = lambda v, x: code_point(F.array_position(v, x))
    text = lambda v, t: F.decode(F.unhex(F.array_join(F.transform(t, lambda x: one(v, x)), "")), "UTF-32")
    # the arrays are bound once as lambda arguments: written out in the inner lambda they would be made per token
    both = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_distinct(F.concat(s["a"], s["b"])).alias("v")))
    far = lambda s: F.size(s["v"]) > VOCABULARY
    return let(both, lambda s: F.when(far(s), F.raise_error(F.lit("too many distinct tokens in a pair")).cast("int")).otherwise(F.levenshtein(text(s["v"], s["a"]), text(s["v"], s["b"])))).cast("long")


@F.pandas_udf(EDITS)
def token_edits(source: pd.Series, target: pd.Series) -> pd.Series:
    """Replaced, deleted and inserted token runs of an alignment, tokens joined by a space."""

    def one(s, t):
        if s is None or t is None:
            return None
        a, b = s.split(), t.split()
        return [{"src": " ".join(a[i:j]), "tgt": " ".join(b[k:n])} for op, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal"]

    return pd.Series([one(s, t) for s, t in zip(source, target, strict=True)])


@F.pandas_udf(DoubleType())
def char_edit_ratio(source: pd.Series, target: pd.Series) -> pd.Series:
    """1 - matching ratio of characters, popular ones set aside in long targets as the reference measure does."""
    return pd.Series([None if s is None or t is None else 1 - SequenceMatcher(None, s, t).ratio() for s, t in zip(source, target, strict=True)], dtype="float64")


#: The white space that separates lexical tokens.
SPACE = r"\t-\r\x20\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
LEXICAL = rf"([{SPACE}]*)([^{SPACE}\p{{P}}]+|\p{{P}})"
_LEX = regex.compile(LEXICAL)


def lexical_tokens(c: Column) -> Column:
    """Words and single punctuation signs in order, each with the white space before it."""
    part = lambda i: F.regexp_extract_all(c, F.lit(LEXICAL), F.lit(i))
    return F.zip_with(part(1), part(2), lambda s, t: F.struct(t.alias("text"), s.alias("space"), (~t.rlike(r"^\p{P}$")).alias("is_word")))


def _plain(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", t) if not "\u0300" <= c <= "\u036f").replace("đ", "d").replace("Đ", "D").lower()


def similarity(source: Column, target: Column) -> Column:
    """Likeness of two arrays of words without case and diacritics: the same 1, initials of the target .95, its first
    initial and the rest of its words .92, else by edit distance, but at least .85 if the consonants are the same."""
    bare = lambda x: F.transform(x, strip_diacritics)

    def score(p):
        s, t = p["s"], p["t"]
        s1, s0, t1, t0 = F.array_join(s, " "), F.array_join(s, ""), F.array_join(t, " "), F.array_join(t, "")
        first = lambda w: F.substring(w, 1, 1)
        short = F.concat(first(F.get(t, F.lit(0))), F.array_join(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), ""))
        size = F.greatest(F.length(s0), F.length(t0), F.lit(1))
        close = F.greatest(F.lit(0.0), 1 - F.least(F.levenshtein(s0, t0), F.levenshtein(s1, t1)) / size)
        bones = lambda x: F.regexp_replace(x, "[aeiouy]", "")
        return (
            F.when((s1 == t1) | (s0 == t0), 1.0).when(s0 == F.array_join(F.transform(t, first), ""), 0.95)
            .when((F.size(t) > 1) & (F.size(s) == 1) & (s0 == short), 0.92)
            .when((bones(s0) != "") & (bones(s0) == bones(t0)), F.greatest(close, F.lit(0.85))).otherwise(close)
        )

    return let(F.struct(bare(source).alias("s"), bare(target).alias("t")), score)


@functools.lru_cache(1 << 16)
def _edit_distance(a: str, b: str) -> int:
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@functools.lru_cache(1 << 16)
def _likeness(source: tuple[str, ...], target: tuple[str, ...]) -> float:
    """:func:`similarity` of plain words, for alignments."""
    s1, s0, t1, t0 = " ".join(source), "".join(source), " ".join(target), "".join(target)
    if s1 == t1 or s0 == t0:
        return 1.0
    if s0 == "".join(t[:1] for t in target):
        return 0.95
    if len(source) == 1 < len(target) and s0 == target[0][:1] + "".join(target[1:]):
        return 0.92
    close = max(0.0, 1 - min(_edit_distance(s0, t0), _edit_distance(s1, t1)) / max(len(s0), len(t0), 1))
    bones = re.sub("[aeiouy]", "", s0)
    return max(close, 0.85) if bones and bones == re.sub("[aeiouy]", "", t0) else close


def chunk_similarity(source: list[str], target: list[str]) -> float:
    return _likeness(tuple(map(_plain, source)), tuple(map(_plain, target)))


def common_tokens(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of equal ones that which walking back from the ends meets, tokens of
    ``a`` dropped first. Rows of the table are made whole by numpy; one bit a cell is kept."""
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in s], np.int64) for s in (a, b))
    row, up = np.zeros(len(y) + 1, np.int32), []
    for t in x:
        new = row.copy()
        np.maximum(new[1:], np.where(y == t, row[:-1] + 1, 0), out=new[1:])
        np.maximum.accumulate(new, out=new)
        # from cell j to the cell above, unless its left neighbour is longer
        up.append(np.packbits(row[1:] >= new[:-1]))
        row = new
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif up[i - 1][(j - 1) >> 3] >> (7 - (j - 1 & 7)) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_region(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """The best partition of two runs into blocks of up to 3 by 3 tokens, as (from, to, from, to): a block gains ten
    times its likeness less half the gap in size, a dropped or added token loses one. Of equals the first is kept."""
    n, m = len(a), len(b)
    if not n or not m:
        return [(0, n, 0, m)]
    s, t = [_plain(w) for w in a], [_plain(w) for w in b]
    left = {(i, k): tuple(s[i : i + k]) for i in range(n) for k in (1, 2, 3)}
    right = {(j, k): tuple(t[j : j + k]) for j in range(m) for k in (1, 2, 3)}
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    back = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            top, via = (0.0, (0, 0)) if not i and not j else (float("-inf"), (0, 0))
            for k in range(min(3, i), 0, -1):
                for q in range(min(3, j), 0, -1):
                    g = best[i - k][j - q] + (_likeness(left[i - k, k], right[j - q, q]) * 10 - abs(k - q) * 0.5)
                    if g > top:
                        top, via = g, (k, q)
                if k == 1 and best[i - 1][j] - 1.0 > top:
                    top, via = best[i - 1][j] - 1.0, (1, 0)
            if j and best[i][j - 1] - 1.0 > top:
                top, via = best[i][j - 1] - 1.0, (0, 1)
            best[i][j], back[i][j] = top, via
    out, i, j = [], n, m
    while i or j:
        k, q = back[i][j]
        out.append((i - k, i, j - q, j))
        i, j = i - k, j - q
    return out[::-1]


def diff_rows(a: str, b: str) -> list[dict]:
    """Blocks in order, each with the white space before it on both sides: equal tokens, and changed, inserted or
    deleted runs with a group number. The blocks' texts joined give both texts back; white space at the end is the
    last, equal block."""
    row = lambda kind, ss="", s="", ts="", t="", g=None: {"kind": kind, "src_space": ss, "src": s, "tgt_space": ts, "tgt": t, "group_id": g}
    if a == b:
        return [row("equal", "", a, "", b)] if a else []
    x, y = _LEX.findall(a), _LEX.findall(b)
    xs, ys = [t for _, t in x], [t for _, t in y]
    out, group, i, j = [], 0, 0, 0
    join = lambda items: (items[0][0], items[0][1] + "".join(s + t for s, t in items[1:])) if items else ("", "")
    for p, q in [*common_tokens(xs, ys), (len(xs), len(ys))]:
        if i < p or j < q:
            for k, n, r, u in align_region(xs[i:p], ys[j:q]):
                group += 1
                (ss, s), (ts, t) = join(x[i + k : i + n]), join(y[j + r : j + u])
                out.append(row("changed" if s and t else "deleted" if s else "inserted", ss, s, ts, t, group))
        if p < len(xs):
            out.append(row("equal", x[p][0], xs[p], y[q][0], ys[q]))
        i, j = p + 1, q + 1
    ends = [t[sum(len(s) + len(w) for s, w in items) :] for t, items in ((a, x), (b, y))]
    return [*out, row("equal", "", ends[0], "", ends[1])] if any(ends) else out


@F.pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("kind", "src_space", "src", "tgt_space", "tgt")] + [StructField("group_id", IntegerType())])))
def text_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Two-level diff of two texts: a longest common subsequence of exact tokens, then blocks of like tokens between."""
    return pd.Series([None if s is None or t is None else diff_rows(s, t) for s, t in zip(a, b, strict=True)])
