"""Problem 4: text decoded with a wrong character encoding, found and restored.

An unknown code-page swap is a substitution cipher: what one letter became (one foreign sign, a run of signs that were
the bytes of one UTF-8 letter, or a vowel with a foreign mark) is a cipher unit. Per source, the mapping from units to
letters is learned by expectation-maximization: counts of units between their neighbours are taken over all rows in
Spark, and letters are weighed by the letter bigrams of the clean rows; units that are valid UTF-8 under a known code
page, or letters of two older fonts, start from that letter with a finite weight, so contexts can overrule it. Single
signs are mapped once more as one cipher, each to a letter of its own, which needs no table of the page; that mapping
holds where it explains the contexts better. All learning runs in Spark tasks, one a source. Restoring replaces units
by private signs and applies ``str.translate``; text garbled twice takes a second pass.

A record counts as garbled if it holds replacement characters inside words, a unit of several signs that is a letter's
UTF-8 bytes inside a word, or two words with foreign signs that read as words once mapped. Single symbols such as ©
or ° beside clean words are no case.

Cases: null and blank texts are never found; lost bytes are found but stay as they are; a null source is a source of
its own; rows that repeat give the same result each.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import codes

#: The letters of Vietnamese.
LOWER = "aàáảãạăằắẳẵặâầấẩẫậbcdđeèéẻẽẹêềếểễệfghiìíỉĩịjklmnoòóỏõọôồốổỗộơờớởỡợpqrstuùúủũụưừứửữựvwxyỳýỷỹỵz"
ALPHA = " " + LOWER + LOWER.upper()
N = len(ALPHA)
INDEX = {c: i for i, c in enumerate(ALPHA)}
PAGES = ("latin-1", "cp1252", "cp1258", "mac_roman", "cp437", "cp850")
LOST = "�"
#: Signs that stand in clean text: ASCII, the letters, their combining marks, common punctuation and drawings.
_CLEAN = "\\x00-\\x7F" + "".join(c for c in ALPHA if ord(c) > 127) + "\\u0300-\\u0303\\u0306\\u0309\\u031B\\u0323\\u2010-\\u2026\\u200B-\\u200D\\uFE0E\\uFE0F\\u2190-\\u21FF\\u2600-\\u27BF\\u2B00-\\u2BFF\\x{1F000}-\\x{1FAFF}\\x{E0020}-\\x{E007F}"
_UP = "".join(c for c in LOWER.upper() if ord(c) > 127)
#: Letters that older Vietnamese fonts write after a vowel as its mark, as Latin-1 shows them.
VNI_ONLY, VNI_ALL = "ïëäåøûüæ", "ùøûõïâêáàåãäëéèúüôÙØÛÕÏÂÊÁÀÅÃÄËÉÈÚÜ"
VOWELS = "aeiouyAEIOUYôöÔÖ"
#: The marks those letters stand for (combining signs of shape, then of tone), and their whole letters.
VNI_MARKS = {"ù": "\u0301", "ø": "\u0300", "û": "\u0309", "õ": "\u0303", "ï": "\u0323", "â": "\u0302", "á": "\u0302\u0301", "à": "\u0302\u0300", "å": "\u0302\u0309", "ã": "\u0302\u0303", "ä": "\u0302\u0323", "ê": "\u0306", "é": "\u0306\u0301", "è": "\u0306\u0300", "ú": "\u0306\u0309", "ü": "\u0306\u0303", "ë": "\u0306\u0323"}
VNI_LETTERS = {"ñ": "đ", "ö": "ư", "ô": "ơ", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ", "Ñ": "Đ", "Ö": "Ư", "Ô": "Ơ"}
#: The single-byte letters of the national standard of 1993, as Latin-1 shows them, and what they are.
TCVN = dict(zip("¨©ª«¬\xad®µ¶·¸¹»¼½¾ÆÇÈÉÊËÌÎÏÐÑÒÓÔÕÖ×ØÜÝÞßáâãäåæçèéêëìíîïñòóôõö÷øùúûüýþ", "ăâêôơưđàảãáạằẳẵắặầẩẫấậèẻẽéẹềểễếệìỉĩíịòỏõóọồổỗốộờởỡớợùủũúụừửữứựỳỷỹýỵ", strict=True))


@functools.cache
def _known(unit: str) -> tuple[str, ...]:
    """Letters that old fonts show as this unit: where expectation-maximization starts, not where it must end."""
    out = []
    if len(unit) == 2 and unit[1].lower() in VNI_MARKS:
        base = VNI_LETTERS.get(unit[0], unit[0])
        x = unicodedata.normalize("NFC", base + VNI_MARKS[unit[1].lower()])
        if len(x) == 1 and x in INDEX:
            out.append(x)
    if len(unit) == 1:
        out += [t[unit] for t in (VNI_LETTERS, TCVN) if unit in t]
    return tuple(out)


@functools.cache
def _page(name: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


#: Single-byte code pages whose signs may be cipher units; signs of no code page never are.
CODE_PAGES = (
    "latin-1 cp1250 cp1251 cp1252 cp1253 cp1254 cp1257 cp1258 koi8-r koi8-u mac_roman mac_cyrillic mac_greek mac_latin2 mac_turkish cp437 cp737 cp775 cp850 cp852 cp855 cp857 cp860 cp861 cp863 cp865 cp866 cp869"
    " iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-7 iso8859-9 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16"
).split()


@functools.cache
def _signs() -> frozenset[str]:
    """ASCII, the letters, their marks, and all signs of the code pages: some hundreds, whatever the corpus holds."""
    return frozenset([*map(chr, range(128)), *ALPHA, *"\u0300\u0301\u0302\u0303\u0306\u0309\u031b\u0323", *(c for name in CODE_PAGES for c in _page(name))])


@functools.cache
def _letter(unit: str) -> str | None:
    """The one character whose UTF-8 bytes the unit shows under some code page."""
    best = None
    for name in PAGES:
        page = _page(name)
        if all(c in page for c in unit):
            try:
                x = bytes(page[c] for c in unit).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(x) == 1:
                if x in INDEX:
                    return x
                if best is None and (unicodedata.category(x)[0] in "LPSM" or 0x80 <= ord(x) <= 0xFF):
                    best = x
    return best


@functools.cache
def _lead(c: str) -> int:
    """How many signs may follow this one, at most."""
    n = 0
    for name in PAGES:
        b = _page(name).get(c, 0)
        n = max(n, 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0)
    return n


_foreign = re.compile(f"[^{_CLEAN}]".replace("\\x{1F000}-\\x{1FAFF}", "\U0001f000-\U0001faff").replace("\\x{E0020}-\\x{E007F}", "\U000e0020-\U000e007f"))


@functools.cache
def _kinds() -> np.ndarray:
    """Per code point: 1 foreign, 2 capital with a mark, 4 ASCII small letter, 8 question mark, 16 letter."""
    k = np.zeros(0x110000, np.uint8)
    for cp in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0100)]:
        c = chr(cp)
        k[cp] = 1 * bool(_foreign.match(c)) + 2 * (c in _UP) + 4 * ("a" <= c <= "z") + 8 * (c == "?") + 16 * c.isalpha()
    k[0x3000:0xA000] = 1
    k[0xD800:0xE000] = 1
    k[0x20000:0xE0000] = 1
    k[0xE0100:] = 1
    return k


def suspects(texts: list[str | None]) -> np.ndarray:
    """Whether each text holds a foreign sign, a marked capital between small letters, or question marks in words.

    Texts without any of these hold nothing to restore.
    """
    off, cp = codes(texts)
    k = _kinds()[cp]
    hit = (k & 1) > 0
    if len(k) > 2:
        inner = np.zeros(len(k), bool)
        inner[1:-1] = ((k[:-2] & 4) > 0) & ((k[1:-1] & 2) > 0) & ((k[2:] & 4) > 0) | ((k[:-2] & 16) > 0) & ((k[1:-1] & 8) > 0) & ((k[2:] & 16) > 0)
        full = off[1:] > off[:-1]
        inner[off[:-1][full]] = inner[off[1:][full] - 1] = False  # no run across texts
        hit |= inner
    n = np.concatenate([[0], np.cumsum(hit)])
    return n[off[1:]] > n[off[:-1]]


def units(token: str, vni: bool) -> list[str]:
    """Cipher units of a token in order; clean letters are units of themselves."""
    out, i, n = [], 0, len(token)
    while i < n:
        c = token[i]
        got = None
        if ord(c) > 127:
            for k in range(min(_lead(c), n - i - 1), 0, -1):
                u = token[i : i + k + 1]
                if _letter(u):
                    got = u
                    break
            if got is None and _lead(c) == 2 and i + 1 < n and token[i + 1] in "»º" and c in "áß":
                got = token[i : i + 2]  # the last byte was lost
        elif c in VOWELS and i + 1 < n and token[i + 1] in (VNI_ALL if vni else VNI_ONLY):
            got = token[i : i + 2]
        if got is None and vni and c in "ôöÔÖ" and i + 1 < n and token[i + 1] in VNI_ALL:
            got = token[i : i + 2]
        out.append(got or c)
        i += len(out[-1])
    return out


def _is_vni(text: str) -> bool:
    return sum(a in VOWELS and b in VNI_ONLY for a, b in zip(text, text[1:], strict=False)) + sum(c in "öñ" for c in text) >= 3


def tokens(text: str) -> list[str]:
    return re.split(r"([ \t\r\n]+)", text)


def suspect(token: str) -> bool:
    return bool(_foreign.search(token)) or bool(re.search(f"[a-z][{_UP}][a-z]", token))


def bigrams(df: DataFrame, text: str) -> np.ndarray:
    """log P(next letter | letter) of the rows without suspect signs; ``N ** 2`` counts at most come back."""
    table = np.zeros(0x2000, np.int64)
    for c, i in INDEX.items():
        table[ord(c)] = i

    def count(batches):
        total = np.zeros(N * N, np.int64)
        for b in batches:
            t = b.column("t").to_pylist()
            off, cp = codes([f" {unicodedata.normalize('NFC', x)} " for x, bad in zip(t, suspects(t), strict=True) if not bad])
            k = table[np.minimum(cp, 0x1FFF)]
            total += np.bincount(k[:-1] * N + k[1:], minlength=N * N)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["g", "n"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    c = np.full(N * N, 0.01)
    if rows.num_rows:
        c[rows["g"].to_numpy()] += rows["n"].to_numpy()
    c = c.reshape(N, N)
    return np.log(c / c.sum(1, keepdims=True))


def contexts(df: DataFrame, text: str, source: str) -> DataFrame:
    """(s, u, a, z, n): counts of cipher units between their neighbours by source, over all suspect rows.

    Rows are distinct symbols, not records: units consist of code-page signs, and a neighbour that is neither a letter
    nor such a unit counts as a gap, so their number a source is bounded by the code pages.
    """

    def run(batches):
        signs = _signs()
        for b in batches:
            c: Counter = Counter()
            texts = b.column("t").to_pylist()
            b = b.filter(pa.array(suspects(texts)))
            side = lambda x: x if x in INDEX or (len(x) > 1 or ord(x) > 127) and all(k in signs for k in x) and x != LOST else " "
            for s, t in zip(b.column("s").to_pylist(), b.column("t").to_pylist(), strict=True):
                t = unicodedata.normalize("NFC", t)
                vni = _is_vni(t)
                for w in tokens(t):
                    if suspect(w) or vni:
                        u = [" ", *units(w, vni), " "]
                        for a, x, z in zip(u, u[1:], u[2:], strict=False):
                            if len(x) > 1 and len(z) > 1 and _letter(z) not in INDEX:
                                continue  # bytes of bytes: garbled twice, this is no letter yet
                            if (x not in INDEX or len(x) > 1 or x in _UP) and x != LOST and any(ord(k) > 127 for k in x) and all(k in signs for k in x) and (len(x) == 1 or (_letter(x) or " ") in INDEX):
                                c[s, x, side(a), side(z)] += 1
            cols = list(zip(*((*k, n) for k, n in c.items()), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in cols[:4]), pa.array(cols[4], pa.int64())], names=["s", "u", "a", "z", "n"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(source).alias("s"), F.col(text).alias("t")).mapInArrow(run, "s string, u string, a string, z string, n long")
    return rows.groupBy("s", "u", "a", "z").agg(F.sum("n").alias("n"))


def assign(gain: np.ndarray) -> np.ndarray:
    """The column of each row, all different, of the largest total gain (the Hungarian method; rows <= columns)."""
    n, m = gain.shape
    up, vp = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        least, came, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        r, j = i, -1
        while True:  # grow the tree of tight edges from row i until a free column is met
            slack = -gain[r] - up[r] - vp
            better = ~seen & (slack < least)
            least[better], came[better] = slack[better], j
            k = int(np.argmin(np.where(seen, np.inf, least)))
            step = least[k]
            up[i] += step
            up[row_of[seen]] += step
            vp[seen] -= step
            least[~seen] -= step
            seen[k] = True
            j = k
            if row_of[k] < 0:
                break
            r = row_of[k]
        while j >= 0:
            row_of[j] = i if came[j] < 0 else row_of[came[j]]
            j = came[j]
    out = np.zeros(n, np.int64)
    out[row_of[row_of >= 0]] = np.nonzero(row_of >= 0)[0]
    return out


#: A letter that a table gives to a unit counts as so many sightings, and this many times the unit's own.
TRUST = (60, 2.0)


def learn(rows: list[tuple[str, str, str, int]], logb: np.ndarray, prior: dict[str, np.ndarray] | None = None, rounds: int = 12) -> dict[str, np.ndarray]:
    """Expectation-maximization of P(letter | unit) from (unit, left, right, count)."""
    if not rows:
        return {}
    b = np.exp(logb)
    freq = b.mean(0) + 1e-6
    freq[0] = 0.0
    names = sorted({u for u, *_ in rows})
    at = {u: i for i, u in enumerate(names)}
    u = np.array([at[r[0]] for r in rows])
    n = np.array([r[3] for r in rows], float)
    uses = np.bincount(u, n, len(names))
    base = np.empty((len(names), N))
    for name, i in at.items():
        x = _letter(name) if len(name) > 1 else None
        p = 0.3 * freq / freq.sum()
        if x in INDEX:
            p[INDEX[x]] += TRUST[0] + TRUST[1] * uses[i]
        for y in _known(name):
            p[INDEX[y]] += TRUST[0]
        if len(name) == 1 and name in INDEX:
            p[INDEX[name]] += 1
        elif len(name) == 2 and name[0] in INDEX and x not in INDEX:  # a vowel and its mark: the same vowel, most likely
            same = [INDEX[c] for c in ALPHA if c != " " and unicodedata.normalize("NFD", c)[0] == unicodedata.normalize("NFD", name[0])[0]]
            p[same] += 1.0 / len(same)
        p[0] = 0
        base[i] = p if prior is None or name not in prior else p * 0.2 + 3 * prior[name]
    theta = base / base.sum(1, keepdims=True)
    # a neighbour is a known letter (row of the identity) or another unit (row of theta)
    side = lambda j: np.array([N + at[r[j]] if r[j] in at else INDEX.get(r[j], 0) for r in rows])
    left, right = side(1), side(2)
    for _ in range(rounds):
        known = np.concatenate([np.eye(N), theta])
        q = theta[u] * (known[left] @ b) * (known[right] @ b.T) + 1e-300
        q[:, 0] = 0  # a unit is a letter, never a gap
        q /= q.sum(1, keepdims=True)
        new = base.copy()
        np.add.at(new, u, q * n[:, None])
        theta = new / new.sum(1, keepdims=True)
    return dict(zip(names, _one_cipher(names, uses, theta, u, left, right, n, logb), strict=True))


def _one_cipher(names: list[str], uses: np.ndarray, theta: np.ndarray, u: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, logb: np.ndarray, least: int = 200, margin: float = 0.1) -> np.ndarray:
    """``theta`` with the single signs mapped one to one, if they are a page that the tables do not have.

    That is where most of their uses are signs without a letter in the tables, or where the one-to-one mapping explains
    the contexts of those that have one better than the tables by ``margin`` a use. Each round scores every letter for
    every sign by the bigrams with its neighbours as they are mapped so far, and takes the best assignment of all signs
    together; the neighbours' mapping starts soft and hardens.
    """
    accented = np.array([ord(c) > 127 for c in ALPHA])
    single = np.array([i for i in np.argsort(-uses, kind="stable") if len(names[i]) == 1 and names[i] not in INDEX], np.int64)[: int(accented.sum())]
    place = np.full(len(names), -1)
    place[single] = np.arange(len(single))
    on = place[u] >= 0
    if not len(single) or n[on].sum() < least:
        return theta
    b = np.exp(logb)
    own, w = place[u[on]], n[on]

    def scores(t: np.ndarray) -> np.ndarray:
        known = np.concatenate([np.eye(N), t])
        s = np.zeros((len(single), N))
        np.add.at(s, own, (np.log(known[left[on]] @ b + 1e-12) + np.log(known[right[on]] @ b.T + 1e-12)) * w[:, None])
        return s

    hard = lambda t: np.eye(N)[t.argmax(1)]
    was = hard(theta)
    in_table = np.array([k for k, i in enumerate(single) if _known(names[i])], np.int64)
    soft = np.where(accented, b.mean(0), 0)
    soft = soft / soft.sum()
    now = was.copy()
    now[single] = soft
    for k in range(8):
        s = scores(now)
        s[:, ~accented] = -1e12
        letter = assign(s)
        t = max(0.0, 0.5 - 0.08 * k)
        now[single] = (1 - t) * np.eye(N)[letter] + t * soft
    weight = np.bincount(own, w, len(single))
    if weight[in_table].sum() >= 0.5 * weight.sum():
        gain = scores(hard(now))[in_table, letter[in_table]].sum() - scores(was)[in_table, theta[single].argmax(1)[in_table]].sum()
        if gain <= margin * weight[in_table].sum():
            return theta
    out = theta.copy()
    out[single] = 0.1 * theta[single] + 0.9 * np.eye(N)[letter]
    return out


def mapping(ctx: DataFrame, logb: np.ndarray) -> tuple[dict[str, str], dict[str | None, dict[str, str]]]:
    """(unit to letter over all sources, the units of each source that it maps otherwise).

    Learned in one task for all sources together, whose contexts are bounded by the code pages, and in one a source;
    the driver gets a row a unit, and a row for each unit that a source maps otherwise.
    """
    ctx = written(ctx, "contexts")
    rows = lambda t: list(zip(*(t[c].to_pylist() for c in ("u", "a", "z", "n")), strict=True))

    def all_(t: pa.Table) -> pa.Table:
        theta = learn(rows(t), logb)
        return pa.table({"u": pa.array(list(theta), pa.string()), "p": pa.array([p.astype(np.float32).tobytes() for p in theta.values()], pa.binary())})

    whole = ctx.groupBy("u", "a", "z").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(all_, "u string, p binary").toArrow()
    theta = {u: np.frombuffer(p, np.float32).astype(float) for u, p in zip(whole["u"].to_pylist(), whole["p"].to_pylist(), strict=True)}
    table = {u: ALPHA[int(p.argmax())] for u, p in theta.items()}

    def own(t: pa.Table) -> pa.Table:
        got = [(u, ALPHA[int(p.argmax())]) for u, p in learn(rows(t), logb, theta).items()]
        got = [(u, x) for u, x in got if table.get(u) != x]
        s = t["s"][0].as_py() if t.num_rows else None
        return pa.table({"s": pa.array([s] * len(got), pa.string()), "u": pa.array([u for u, _ in got], pa.string()), "x": pa.array([x for _, x in got], pa.string())})

    other: dict[str | None, dict[str, str]] = {}
    t = ctx.groupBy("s").applyInArrow(own, "s string, u string, x string").toArrow()
    for s, u, x in zip(*(t[c].to_pylist() for c in ("s", "u", "x")), strict=True):
        other.setdefault(s, {})[u] = x
    return table, other


class Restorer:
    """Mappings by source, and the letter bigrams to judge what they give."""

    def __init__(self, table: dict[str, str], other: dict[str | None, dict[str, str]], logb: np.ndarray):
        self.logb = logb
        self.default = self._tables(table)
        self.maps = {s: self._tables(table | own) for s, own in other.items()}

    @staticmethod
    def _tables(letters: dict[str, str]) -> tuple[dict[str, str], dict[int, str]]:
        """Units to private signs, and private signs to letters for ``str.translate``."""
        signs = {u: chr(0xF0000 + i) for i, u in enumerate(sorted(letters))}
        return signs, {ord(c): letters[u] for u, c in signs.items()}

    def word(self, token: str, source: str | None, vni: bool) -> tuple[str, bool]:
        """(restored token, whether a unit of several signs was a letter's bytes)."""
        signs, table = self.maps.get(source, self.default)
        out, sure = [], False
        for u in units(token, vni):
            if len(u) > 1 and ord(u[0]) > 127 and (x := _letter(u)):
                sure |= x in INDEX
                out.append(signs[u] if u in signs and x in INDEX else x)
            elif u in signs and not (len(u) == 1 and u in INDEX and not vni and not suspect(token)):
                out.append(signs[u])
            else:
                out.append(u)
        return "".join(out).translate(table), sure

    def likely(self, token: str) -> float:
        """Mean log probability of a token's letters."""
        k = [0, *(INDEX.get(c, -1) for c in token), 0]
        if -1 in k:
            return -20.0
        return float(np.mean(self.logb[k[:-1], k[1:]]))

    def row(self, text: str, source: str | None, least: float) -> tuple[bool, str]:
        """(is garbled, restored text)."""
        text = unicodedata.normalize("NFC", text)
        garbled, out = 0, text
        lost = len(re.findall(f"[^\\W\\d_]{LOST}|{LOST}[^\\W\\d_]|{LOST}{{2}}", text)) + (1 if len(re.findall(r"(?<=[^\W\d_])\?(?=[^\W\d_])", text)) >= 3 else 0)
        for _ in range(3):
            vni, parts, changed = _is_vni(out), tokens(out), False
            alone: list[tuple[int, str]] = []  # letters and drawings by themselves: no proof, but restored along with the row
            for i, w in enumerate(parts):
                if not w or w.isspace() or not (suspect(w) or vni):
                    continue
                core = w.strip(".,!?;:()\"'[]")
                if not any(c.isalpha() or ord(c) > 127 for c in core):
                    continue
                new, sure = self.word(core, source, vni)
                if new == core:
                    continue
                if not sure and suspect(new):  # garbled twice: letters show only a pass further on
                    again, sure = self.word(new, source, vni)
                    new = again if sure else new
                bare = "".join(c for c in new if c.isalpha())
                letters = sum(c.isalpha() for c in core)
                reads = new == bare and letters >= 1 and len(new) > 1 and self.likely(new) > max(least, self.likely(core) + 0.5)
                if sure and (letters > 1 or len(core) > 2) or reads:
                    garbled += 2 if sure else 1
                    parts[i] = w.replace(core, new)
                    changed = True
                elif sure or any(len(u) > 1 and ord(u[0]) > 127 and _letter(u) for u in units(core, vni)):
                    alone.append((i, w.replace(core, new)))
            if garbled >= 2:
                for i, w in alone:
                    parts[i] = w
                    changed = True
            if not changed:
                break
            out = "".join(parts)
        return bool(lost) or garbled >= 2, out if garbled >= 2 else text


def restore(df: DataFrame, id_col: str, text: str, source: str, least: float = -4.6) -> DataFrame:
    """(id, garbled, restored) of every suspect row; the others are clean as they are."""
    logb = bigrams(df, text)
    r = Restorer(*mapping(contexts(df, text, source), logb), logb)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(suspects(b.column("t").to_pylist())))
            done = [r.row(t, s, least) for t, s in zip(b.column("t").to_pylist(), b.column("s").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x for x, _ in done], pa.bool_()), pa.array([x for _, x in done], pa.string())], names=["id", "garbled", "restored"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.col(source).alias("s"))
    return rows.mapInArrow(run, f"id {kind}, garbled boolean, restored string").withColumnRenamed("id", id_col)
