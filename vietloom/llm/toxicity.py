"""Problem 6: scores for abusive, hateful or sexual language, also in disguise.

A noisy channel is inverted first: spans with separators or masks inside words, digits for letters or letters spaced
apart become a lattice of what each character may stand for, and Viterbi takes the best path under a character
trigram model of the corpus, in which labelled abusive rows weigh more. The restored text is scored by a logistic
model over runs of one to four words, fitted on all rows of the labelled table: on the driver where they are few
(``LABELLED``), else in the tasks, with the same sums to the bit.

Cases: null and blank texts score by the model's base rate and are never found; composed and decomposed text are read
alike; rows that repeat score the same; very long texts are scored whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, written
from .common import U, as_long, codes, grams, in_slices, lists, mix, owners, ragged, word_rows

#: Up to so many labelled rows (of 200 characters on average) are held by the driver while fitting; more stay in the tasks.
LABELLED = 20_000
#: Penalty on squared weights, and the weight below which a run is left out of the model.
L2, LIVE = 0.0005, 1e-3
#: Errors are summed in this fixed point: whole numbers add up alike in any order.
ONE = 2.0**28
#: Sums of so many runs go from task to task as one value.
PIECE = 1 << 16
ALPHABET = " abcdefghijklmnopqrstuvwxyz"
S = len(ALPHABET)
#: What signs and digits stand for in disguised words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "£": "l", "¡": "i"}
#: Letters of other scripts that look like Latin ones.
LOOKALIKE = str.maketrans("аеіорсухѕһԁɡαορυτκ", "aeiopcyxshdgaoputk"[:18])
SEPARATORS = "-_*.·•~'`^+/\\|​‌‍"
MASKS = "*#"
_SPAN = re.compile(
    r"(?:[^\W\d_][̀-ͯ]*[-_*.·•~'`^+/\\|​-‍]+){1,}[^\W\d_]"  # separators or masks inside
    r"|[^\W\d_][*#]{1,}[^\W\d_]"
    r"|(?<!\w)(?=[^\W_]*[^\W\d_])(?=[^\W_]*\d)[^\W_]{2,}(?!\w)"  # digits among letters
    r"|(?<!\w)(?:[^\W\d_][̀-ͯ]*[ .]){2,}[^\W\d_](?!\w)"  # letters spaced apart
    r"|[^\W\d_]+[@$!][^\W\d_]+"
)


@functools.cache
def _kinds() -> np.ndarray:
    """Per code point: 1 letter or mark on one, 2 digit, 4 separator or mask, 8 white space, 16 sign for a letter."""
    k = np.zeros(0x110000, np.uint8)
    for cp in [*range(0xD800), *range(0xE000, 0x20000)]:
        c = chr(cp)
        k[cp] = 1 * (c.isalpha() or unicodedata.combining(c) > 0) + 2 * c.isdigit() + 4 * (c in SEPARATORS or c in MASKS or 0x200B <= cp <= 0x200D) + 8 * c.isspace() + 16 * (c in "@$!")
    k[0x20000:] = 1
    return k


def maybe(texts: list[str | None]) -> np.ndarray:
    """Whether a composed text may hold a disguised stretch; where this says no, :data:`_SPAN` matches nothing."""
    off, cp = codes([f"{t or ''} " for t in texts])
    k = _kinds()[cp]
    letter, digit, sep, space = (k & 1) > 0, (k & 2) > 0, (k & 4) > 0, (k & 8) > 0
    hit = np.zeros(len(k), bool)
    if len(k) > 1:
        hit[:-1] |= letter[:-1] & digit[1:] | digit[:-1] & letter[1:]
    if len(k) > 2:
        hit[:-2] |= letter[:-2] & ((k[1:-1] & 16) > 0) & letter[2:]
        after = np.minimum.accumulate(np.where(sep, len(k) - 1, np.arange(len(k)))[::-1])[::-1]  # the next sign that is no separator
        hit[:-1] |= letter[:-1] & sep[1:] & letter[after[1:]]
        apart = space | (cp == 46)
        # a letter between gaps (or after a text's start) and the next two as well
        gap = np.concatenate([[True], ~(letter | digit)[:-1]])
        if len(k) > 4:
            hit[:-4] |= gap[:-4] & letter[:-4] & apart[1:-3] & letter[2:-2] & apart[3:-1] & letter[4:]
    n = np.concatenate([[0], np.cumsum(hit)])
    return n[off[1:]] > n[off[:-1]]


def spans(text: str) -> list[tuple[int, int]]:
    """Disguised stretches widened to whole words, near ones joined."""
    out: list[tuple[int, int]] = []
    for m in _SPAN.finditer(text):
        a, b = m.span()
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Channel:
    """Viterbi over the lattice of a span, states being the last two letters."""

    def __init__(self, counts: np.ndarray):
        two = counts.sum(2, keepdims=True)
        one = counts.sum((0, 1)) + 1.0
        bi = counts.sum(0) + 0.5 * one / one.sum()
        bi = bi / bi.sum(1, keepdims=True)
        self.lm = np.log((counts + 4.0 * bi) / (two + 4.0)).astype(np.float32)

    @staticmethod
    @functools.cache
    def arcs(ch: str) -> tuple[tuple[int, float], ...]:
        """(letter or -1 for nothing, cost) a character may stand for."""
        base = unicodedata.normalize("NFD", ch.lower().translate(LOOKALIKE))[0]
        base = "d" if base == "đ" else base
        if base in ALPHABET[1:]:
            return ((ALPHABET.index(base), 0.0),)
        if unicodedata.combining(base):
            return ((-1, 0.0),)
        if ch.isspace():
            return ((0, 0.2), (-1, 0.6))
        out = [(ALPHABET.index(x), 1.0) for x in LEET.get(ch, "")]
        if ch in MASKS:
            out += [(i, 1.2) for i in range(1, S)]
        if ch in SEPARATORS or not ch.isalnum():
            out += [(-1, 0.3), (0, 1.5)]
        return tuple(out) or ((-1, 3.0),)

    def restore(self, span: str) -> str:
        neg = np.float32(-1e9)
        score = np.full((S, S), neg, np.float32)
        score[0, 0] = 0
        back: list[tuple[np.ndarray, np.ndarray]] = []
        for ch in span:
            new = np.full((S, S), neg, np.float32)
            via = np.zeros((S, S), np.int16)  # the letter before last that led here
            kept = np.zeros((S, S), bool)  # the character stood for nothing
            for letter, cost in self.arcs(ch):
                if letter < 0:
                    c = score - np.float32(cost)
                    better = c > new
                    new = np.where(better, c, new)
                    kept |= better
                    continue
                c = score + self.lm[:, :, letter]  # [a, b] then letter
                best = c.argmax(0)
                val = c[best, np.arange(S)] - np.float32(cost)
                better = val > new[:, letter]
                new[better, letter] = val[better]
                via[better, letter] = best[better]
                kept[better, letter] = False
                if letter:  # the same letter again may be mere stretching
                    c = score[:, letter] - np.float32(0.4)
                    b2 = c > new[:, letter]
                    new[b2, letter] = c[b2]
                    kept[b2, letter] = True
            back.append((via, kept))
            score = new
        end = score + self.lm[:, :, 0]
        a, b = np.unravel_index(end.argmax(), end.shape)
        out = []
        for via, kept in reversed(back):
            if kept[a, b]:
                continue
            out.append(ALPHABET[b])
            a, b = via[a, b], a
        return "".join(reversed(out)).strip()

    def text(self, t: str | None) -> str | None:
        """The text with restored spans added after each disguised one."""
        if t is None:
            return None
        t = unicodedata.normalize("NFC", t)
        out, at = [], 0
        for a, b in spans(t):
            out += [t[at:a], self.restore(t[a:b])]
            at = b
        return "".join([*out, t[at:]]) if out else t


@functools.cache
def _letters() -> np.ndarray:
    """Per code point: its letter without case and marks, 0 for what is none, -1 for combining marks."""
    out = np.zeros(0x1F01, np.int8)
    for cp in range(0x1F00):
        base = unicodedata.normalize("NFD", chr(cp).lower())[0]
        out[cp] = -1 if unicodedata.combining(chr(cp)) else max(ALPHABET.find("d" if base == "đ" else base), 0)
    return out


def count_trigrams(texts: list[str | None]) -> np.ndarray:
    """Counts of letter trigrams, flat."""
    letter = _letters()
    _, cp = codes([f"  {x} " for x in texts if x is not None])
    c = letter[np.minimum(cp, len(letter) - 1)].astype(np.int64)
    c = c[c >= 0]
    c = c[np.concatenate([[True, True], (c[2:] > 0) | (c[1:-1] > 0) | (c[:-2] > 0)])] if len(c) > 2 else c  # gaps count as two spaces at most
    return np.bincount(c[:-2] * S * S + c[1:-1] * S + c[2:], minlength=S**3) if len(c) > 2 else np.zeros(S**3, np.int64)


def trigram_counts(df: DataFrame, text: str) -> np.ndarray:
    """Counts of letter trigrams over all rows: at most ``27 ** 3`` rows reach the driver."""

    def count(batches):
        total = np.zeros(S**3, np.int64)
        for b in batches:
            total += count_trigrams(b.column("t").to_pylist())
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["g", "n"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(S**3, np.float64)
    if rows.num_rows:
        out[rows["g"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(S, S, S)


def restore_all(texts: list[str | None], channel: Channel) -> list[str | None]:
    t = [x if x is None else unicodedata.normalize("NFC", x) for x in texts]
    return [channel.text(x) if may else x for x, may in zip(t, maybe(t), strict=True)]


def runs(off: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all runs of one to four words."""
    rows, hs = [], []
    for k in (1, 2, 3, 4):
        r, _, g = grams(off, h, k)
        rows.append(r)
        hs.append(mix(g + U(k)))
    return np.concatenate(rows), np.concatenate(hs)


def distinct_runs(off: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different runs of each row, in order."""
    row, g = runs(off, h)
    at = np.lexsort((g, row))
    row, g = row[at], g[at]
    new = np.ones(len(g), bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def pull(r: np.ndarray, f: np.ndarray, y: np.ndarray, m: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
    """What examples (``m`` rows each, label ``y``) with runs ``(r, f)`` pull at weights ``v``: the sum of errors of each
    run, of all rows, and the loss, in fixed point."""
    z = np.bincount(r, v[f], len(y)) + bias
    e = np.rint(m * (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * ONE)
    loss = np.rint(m * (np.logaddexp(0, z) - y * z) * ONE)
    return np.concatenate([np.bincount(f, e[r], len(v)), [e.sum(), loss.sum()]]).astype(np.int64)


def descend(pulls, scale: np.ndarray, rows: int, mean: float, near: float = 1e-7, passes: int = 1000, kept: int = 5) -> tuple[np.ndarray, float]:
    """(weights, bias) of least mean loss and penalty, by L-BFGS; ``pulls(weights, bias)`` is a pass over all examples."""

    def at(x):
        p = pulls(x[:-1] * scale, x[-1])
        return p[-1] / ONE / rows + L2 / 2 * (x[:-1] @ x[:-1]), np.append(L2 * x[:-1] - p[:-2] * scale / ONE / rows, -p[-2] / ONE / rows)

    x = np.append(np.zeros(len(scale)), np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    loss, grad = at(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    while np.abs(grad).max() > near and passes > 0:
        q, back = grad.copy(), []
        for s, d, c in reversed(past):
            back.append(c * (s @ q))
            q -= back[-1] * d
        if past:
            q *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1]))
        for (s, d, c), a in zip(past, reversed(back), strict=True):
            q += s * (a - c * (d @ q))
        slope, step = grad @ q, 1.0
        while True:
            to = x - step * q
            there, g = at(to)
            passes -= 1
            if there <= loss - 1e-4 * step * slope + 1e-9 or passes <= 0:
                break
            step /= 2
        s, d = to - x, g - grad
        if s @ d > 0:
            past = [*past, (s, d, 1 / (s @ d))][-kept:]
        x, loss, grad = to, there, g
    return x[:-1] * scale, float(x[-1])


def may_live(n, pos, weight, rows):
    """Whether a run can reach a weight of ``LIVE``: at the least loss a weight times ``L2`` is the run's mean error times
    its squared room, and no row errs by more than one. Numbers or columns."""
    return weight > LIVE * L2 * rows * (1 + n - pos)


class Scorer:
    """Logistic model over the presence of word runs."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.keys & U((1 << 20) - 1)).astype(np.int64)] = True

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, pos: np.ndarray, rows: int, mean: float, pulls) -> Scorer:
        """The model over runs ``keys``, each in ``n`` examples, ``pos`` of them abusive."""
        # a run seen in innocent rows too says little: it gets less room to grow
        w, bias = descend(pulls, np.sqrt(1.0 / (1.0 + (n - pos))), rows, mean)
        live = np.abs(w) > LIVE
        return cls(keys[live], w[live], bias)

    @classmethod
    def fit(cls, off: np.ndarray, h: np.ndarray, y: np.ndarray, m: np.ndarray | None = None, least: int = 2) -> Scorer:
        """From different examples in memory, ``m`` rows each."""
        m = np.ones(len(y), np.int64) if m is None else m
        row, g = distinct_runs(off, h)
        keys, f, n = np.unique(g, return_inverse=True, return_counts=True)
        pos, weight, rows = np.bincount(f, y[row], len(keys)), np.bincount(f, m[row], len(keys)), max(int(m.sum()), 1)
        keep = (n >= least) & may_live(n, pos, weight, rows)
        ok = keep[f]
        r, f = row[ok], (np.cumsum(keep) - 1)[f[ok]]
        return cls.of(keys[keep], n[keep], pos[keep], rows, float((m * y).sum()) / rows, lambda v, bias: pull(r, f, y, m, v, bias))

    @classmethod
    def fit_table(cls, examples: DataFrame, channel: Channel, least: int = 2) -> Scorer:
        """From a table (t, y, m) of different examples: runs stay in the tasks, sums by run reach the driver."""

        def read(batches):
            for b in batches:
                for part, texts in in_slices(b, "t"):
                    row, g = distinct_runs(*word_rows(restore_all(texts, channel), squeeze=True))
                    off = np.searchsorted(row, np.arange(len(texts) + 1))
                    yield pa.RecordBatch.from_arrays([part.column("y"), part.column("m"), lists(off, as_long(g))], names=["y", "m", "g"])

        table = written(examples.mapInArrow(read, "y double, m long, g array<long>"), "labelled")
        total = table.agg(F.coalesce(F.sum("m"), F.lit(1)).alias("m"), F.coalesce(F.sum(F.col("m") * F.col("y")), F.lit(0.0)).alias("y")).first()
        seen = table.select("y", "m", F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.sum("m").alias("weight"))
        seen = seen.where((F.col("n") >= least) & may_live(F.col("n"), F.col("pos"), F.col("weight"), total["m"])).select("g", "n", "pos").toArrow()
        keys = seen["g"].to_numpy().view(U)
        order = np.argsort(keys)
        keys, n, pos = keys[order], seen["n"].to_numpy()[order], seen["pos"].to_numpy()[order]

        def number(batches):
            for b in batches:
                off, g = ragged(b.column("g"))
                g = g.view(U)
                at = np.searchsorted(keys, g).clip(max=max(len(keys) - 1, 0))
                ok = keys[at] == g if len(keys) else np.zeros(len(g), bool)
                off = np.concatenate([[0], np.cumsum(ok)])[off]
                f = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((4 * off).astype(np.int32)), pa.py_buffer(at[ok].astype(np.int32))])
                yield pa.RecordBatch.from_arrays([b.column("y"), b.column("m"), f], names=["y", "m", "f"])

        numbered = written(table.mapInArrow(number, "y double, m long, f binary"), "labelled_runs")
        numbered = numbered.coalesce(numbered.sparkSession.sparkContext.defaultParallelism)

        def pulls(v, bias):
            size = len(v) + 2

            def add(batches):
                total = np.zeros(size, np.int64)
                for b in batches:
                    c = b.column("f")
                    off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] // 4
                    f = np.frombuffer(c.buffers()[2] or b"", np.int32)[off[0] : off[-1]]
                    total += pull(owners(off), f, b.column("y").to_numpy(), b.column("m").to_numpy(), v, bias)
                at = range(0, size, PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : i + PIECE].tobytes() for i in at], pa.binary())], names=["i", "s"])

            def join(t):
                s = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in t["s"]], 0)
                return pa.table({"i": t["i"][:1], "s": pa.array([s.tobytes()], pa.binary())})

            got = numbered.mapInArrow(add, "i int, s binary").groupBy("i").applyInArrow(join, "i int, s binary").toArrow()
            out = np.zeros(size, np.int64)
            for i, x in zip(got["i"].to_pylist(), got["s"], strict=True):
                out[i : i + PIECE] = np.frombuffer(x.as_buffer(), np.int64)
            return out

        return cls.of(keys, n, pos, total["m"], total["y"] / total["m"], pulls)

    def score(self, off: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        for k in (1, 2, 3, 4):
            row, _, g = grams(off, h, k)
            g = mix(g + U(k))
            near = np.nonzero(self.known[(g & U((1 << 20) - 1)).astype(np.int64)])[0]
            row, g = row[near], g[near]
            at = np.searchsorted(self.keys, g).clip(max=max(len(self.keys) - 1, 0))
            ok = np.nonzero(self.keys[at] == g)[0] if len(self.keys) else np.zeros(0, np.int64)
            hit = np.unique(row[ok] * np.int64(len(self.keys)) + at[ok])
            z += np.bincount(hit // max(len(self.keys), 1), self.weights[hit % max(len(self.keys), 1)], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def weighed(counts: np.ndarray, labelled: np.ndarray, share: float) -> np.ndarray:
    """The counts of the corpus with the labelled ones brought to ``share`` of their sum."""
    return counts + labelled * (share * counts.sum() / max(labelled.sum(), 1))


def learn(corpus: DataFrame, text: str, labels: DataFrame, label: str, share: float = 0.5) -> tuple[Channel, Scorer]:
    """The character model over the whole corpus and the classifier, both over all rows of the labelled table.

    Abusive rows weigh ``share`` of the corpus in the character model, whatever the size of either. Equal rows are one
    example of the classifier that weighs as many: a run must stand in different texts to be known.
    """
    rows = labels.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("double").alias("y"))
    channel = Channel(weighed(trigram_counts(corpus, text), trigram_counts(rows.where("y = 1"), "t"), share))
    examples = rows.groupBy("t", "y").agg(F.count("*").alias("m"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    if n > LABELLED or chars > 200 * LABELLED:
        with scratch():
            return channel, Scorer.fit_table(examples.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // LABELLED)), channel)
    table = examples.toArrow()
    return channel, Scorer.fit(*word_rows(restore_all(table["t"].to_pylist(), channel), squeeze=True), table["y"].to_numpy(), table["m"].to_numpy())


def scores(df: DataFrame, id_col: str, text: str, channel: Channel, model: Scorer) -> DataFrame:
    """(id, score) of every row."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            for part, texts in in_slices(b, "t"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.score(*word_rows(restore_all(texts, channel), squeeze=True)))], names=["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
