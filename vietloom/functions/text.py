"""Scalar text functions as native expressions; Arrow UDFs only where Spark has no equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The code points that Unicode counts as white space in Python's ``str.isspace``.
WS_CLASS = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _fold_table() -> tuple[str, str]:
    """Letters of Latin blocks that decompose to an ASCII letter and marks, and those letters in lower case."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c)).lower()
        if len(base) == 1 and base.isascii() and base.isalpha():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src) + "đĐ", "".join(dst) + "dd"


FOLD_FROM, FOLD_TO = _fold_table()


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Signs that NFC leaves as they are and that never compose with what stands beside them; any other sign (marks,
#: Hangul parts, compatibility forms, letters beyond Latin) sends a text through :func:`nfc`.
COMPOSED = r"^[\x00-\u02FF\u1E00-\u1EFF\u200B-\u200D\uFE0F\u2010-\u2027\u2030-\u205E\u20A0-\u20BF\u2190-\u21FF\u2600-\u27BF\x{1F300}-\x{1FAFF}]*\z"


def composed(c: Column) -> Column:
    """Unicode NFC; only texts with a sign that may change leave the JVM."""
    return F.when(c.rlike(COMPOSED), c).otherwise(nfc(F.when(~c.rlike(COMPOSED), c)))


def clean_text(col: Column | str) -> Column:
    """NFC, every run of Unicode white space to one space, stripped; blank or null gives null."""
    c = F.col(col) if isinstance(col, str) else col
    return clean_nfc(composed(c))


def clean_nfc(c: Column) -> Column:
    """:func:`clean_text` for text that is in NFC already (ASCII, or composed before)."""
    return F.nullif(F.trim(F.regexp_replace(c, WS_CLASS + "+", " ")), F.lit(""))


def strip_diacritics(c: Column) -> Column:
    """Lower case without diacritics (đ becomes d), for composed and decomposed text alike."""
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"\p{M}+", "")


def fold_words(c: Column, squeeze: bool = False) -> Column:
    """Runs of letters or digits without case and diacritics; ``squeeze`` also collapses repeated letters.

    Null gives null, a text without letters and digits an empty array.
    """
    x = strip_diacritics(c)
    if squeeze:
        x = F.regexp_replace(x, r"(\p{L})\1+", "$1")
    return F.array_remove(F.split(x, r"[^\p{L}\p{N}]+"), "")


def word_hashes(words: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))
