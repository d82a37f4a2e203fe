"""Problem 3: defective answers to texts that were to be normalised.

An answer is cut into clauses; a linear-chain conditional random field tags each as answer, refusal, echo, foreign or
unfinished from how much of it stands in the input, whether its words are Vietnamese syllables, whether it shows a cue
of refusing, whether the answer has the input's words in their order, how much of the input is left without counterpart
behind it, and its words where they are not the input's. These are features only: the share of words under each tag
decides the pair's defect, and an answer without any words to tag is empty. The field is trained from a small labelled
table: at most ``SAMPLE`` sound pairs of the data, their cut and echoed forms, and refusals and foreign sentences
written here; a training row has its first 40 clauses, answers to be judged have all of theirs.

Cases: a null, blank or stand-in answer is empty, whatever the input; a null input gives only empty, refusal and other
language; repeated rows are one; a status column takes no part.
"""

from __future__ import annotations

import random
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import sampled, stored
from .crf import TokenCrf

SAMPLE, EPOCHS = 600, 160
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"[^.!?,;:\n…。，！？、]+")
#: Answers that stand for no text, without signs.
STAND_IN = {"", "na", "null", "none", "nan", "nil", "empty", "undefined", "pad", "pads", "s", "eos", "unk", "blank", "trống", "rỗng", "không có", "không có nội dung", "no text", "no output", "n a", "pad s", "tbd", "todo", "unk s"}
_SYLLABLE = re.compile(r"(?:b|ch|c|d|gh|gi|g|h|kh|k|l|m|ngh|ng|nh|n|ph|p|qu|q|r|s|th|tr|t|v|x)?(?:uye|uya|uyu|ieu|yeu|uoi|uou|oai|oay|oeo|uay|iu|ia|ie|ua|uo|uu|ui|ue|uy|oa|oe|oi|ai|ao|au|ay|eo|eu|ye|a|e|i|o|u|y)(?:ch|c|m|ng|nh|n|p|t)?")

_folded: dict[str, str] = {}


def fold(w: str) -> str:
    got = _folded.get(w)
    if got is None:
        if len(_folded) > 500_000:
            _folded.clear()
        x = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).replace("đ", "d")
        got = _folded[w] = re.sub(r"([^\W\d_])\1+", r"\1", x)
    return got


def words(t: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", t).lower()) if t else []


def left_over(a: list[str], b: list[str]) -> float:
    """Share of the input's words behind the last one that has a counterpart in the answer, if the answer follows it."""
    if not a or len(b) > 0.85 * len(a):
        return 0.0
    blocks = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    same = sum(m.size for m in blocks)
    if not blocks or same < 0.45 * len(b) or blocks[0].a > 0.3 * len(a) + 2:
        return 0.0
    # the last words of the answer must lie where the matching stops, else it does not simply break off
    end = blocks[-1].a + blocks[-1].size + (len(b) - blocks[-1].b - blocks[-1].size)
    return max(0.0, 1 - end / len(a))


def _bin(x: float) -> int:
    return 0 if x < 0.1 else 1 if x < 0.3 else 2 if x < 0.55 else 3 if x < 0.8 else 4 if x < 1 else 5


def _echoes(a: list[str], b: list[str], answer: str) -> bool:
    """Whether the answer has the input's words and no other, but for a label of up to four words and a colon in front."""
    extra = len(b) - len(a)
    if not a or not 0 <= extra <= 4 or b[extra:] != a:
        return False
    if not extra:
        return True
    label = [m.end() for _, m in zip(range(extra), WORD.finditer(answer), strict=False)][-1]
    return answer[label:].lstrip().startswith(":")


def clauses(source: str | None, answer: str) -> tuple[list[str], list[int]]:
    """(signature of each clause, words in it)."""
    a = words(source)
    fa, exact = {fold(w) for w in a}, set(a)
    answer = unicodedata.normalize("NFC", answer).lower()
    rows = [w for m in CLAUSE.finditer(answer) if (w := WORD.findall(m.group()))]
    b = [w for r in rows for w in r]
    equal = _echoes(a, b, answer)
    folded = [[fold(w) for w in r] for r in rows]
    rest = 0.0 if equal else left_over([fold(w) for w in a], [w for f in folded for w in f]) if a and len(b) <= 0.85 * len(a) else 0.0
    cues = [_CUE.search(" ".join(f) + " ") is not None for f in folded]
    any_cue = _CUE.search(" ".join(w for f in folded for w in f) + " ") is not None
    sig, n = [], []
    for k, (r, f) in enumerate(zip(rows, folded, strict=True)):
        m = sum(w in fa for w in f) / len(f)
        v = sum(_SYLLABLE.fullmatch(w) is not None for w in f) / len(f)
        parts = [f"m{_bin(m)}", f"e{_bin(sum(w in exact for w in r) / len(r))}", f"v{_bin(v)}", f"q{int(equal)}", f"n{min(len(r), 6)}", f"mv{_bin(m)}{_bin(v)}", f"k{int(cues[k])}{int(any_cue)}", f"mk{_bin(m)}{int(cues[k])}{int(any_cue)}", f"z{int(not a)}{_bin(v)}{int(any_cue)}"]
        if k == len(rows) - 1:
            parts.append(f"u{0 if rest < 0.1 else 1 if rest < 0.2 else 2 if rest < 0.25 else 3}")
        if m < 0.55:
            parts += [f"w={w}" for w in f] + [f"p={x} {y}" for x, y in zip(f, f[1:], strict=False)]
            if any(ord(c) > 0x2E7F or 0x400 <= ord(c) < 0x1E00 for w in r for c in w):
                parts.append("script")
        sig.append("|".join(parts))
        n.append(len(r))
    return sig, n


def features(signature: str) -> list[str]:
    return ["b", *signature.split("|")]


_FIRST = ["Xin lỗi", "Mình xin lỗi", "Tôi rất lấy làm tiếc", "Thành thật xin lỗi", "Rất tiếc", "Tiếc quá", "Sorry", "I'm sorry", "I am sorry", "Với vai trò trợ lý", "As an assistant", "Là một mô hình ngôn ngữ", "As a language model", "Unfortunately", "I apologize", "Xin thứ lỗi", ""]
_BODY = [
    "tôi không thể thực hiện yêu cầu này", "tôi không thể chuẩn hóa nội dung này", "câu này tôi xin phép không trả lời", "tôi từ chối đưa ra kết quả cho câu trên", "yêu cầu này vi phạm hướng dẫn nên tôi dừng lại", "tôi chưa thể trả lời mẫu này", "tôi không hỗ trợ yêu cầu kiểu này", "mình không được phép xử lý đoạn này", "nội dung này không phù hợp để xử lý",
    "tôi không có quyền viết lại câu này", "mình không giúp được với văn bản này", "tôi xin từ chối", "I can't help with this text", "I cannot help with that", "I am unable to rewrite that", "I won't be able to process this request", "I can't assist with this", "I'm not able to normalize this sentence", "I must decline this request", "I cannot comply with that", "I will not provide this",
]
_LAST = ["mong bạn thông cảm", "cảm ơn bạn", "bạn vui lòng gửi câu khác", "hãy liên hệ người duyệt", "Please try another sentence", "vì nội dung nhạy cảm", "do chính sách an toàn", "please contact support", "due to our policy", ""]
_ABROAD = {
    "en": "the a this that my our her his was were is not very small big old new phone seller order box colour arrived late broken cheap and but because when after before with without for in on under near last night week kitchen friend group everyone stopped working looked nice song lost found today again really good bad price sound bag trip needed made".split(),
    "fr": "le la les un une des ce cette mon ma est sont pas plus très trop avec sans dans pour hier demain soir vendeur couleur cadeau petit grand joli cher bien arrivé merci beaucoup nous vous ils attendons encore téléphone commande cuisine problème recommande".split(),
    "id": "yang ini itu saya kami sudah belum tidak sangat sekali cukup agak barang penjual pengiriman datang terlambat murah bagus warnanya dengan untuk teman rumah kemarin malam lagi terima kasih masih baru kualitasnya mudah dipakai sesuai gambar".split(),
    "es": "el la los una este esta muy pero porque cuando con sin para ayer noche vendedor color pequeño grande barato llegó tarde gracias nosotros todavía teléfono pedido cocina problema".split(),
    "de": "der die das ein eine mein ist nicht sehr aber weil mit ohne für gestern abend verkäufer farbe klein groß billig kam spät danke wir noch handy bestellung küche".split(),
    "zh": "质量一般 卖家热情 颜色不对 价格便宜 手机很卡 下次再买 东西很好 昨天收到 我很喜欢 包装破了".split(),
    "ko": "배송이 늦었어요 색상이 다르네요 아주 좋아요 다시 살게요 품질이 별로예요".split(),
    "ja": "とても良い 色が違う 配送が遅い また買います 品質は普通".split(),
    "th": "สินค้าดีมาก ส่งช้า สีไม่ตรง ราคาถูก ชอบมาก".split(),
    "ru": "товар хороший доставка поздно цвет другой очень дешево спасибо продавец".split(),
}


_DOES = "came went arrived broke kept made took got felt looked smelled sounded turned stopped started needed saved ruined surprised fitted worked wasn't couldn't didn't had hasn't doesn't ran fell sold bought sent lost found charged".split()
_TAIL = "again late on time in the rain near the lake at the market during lunch last night since the summer for no reason by mistake right away with a small gift under the desk on the bus before the exam after two weeks as promised worth it be better a repair everyone laugh out of power really nice too small very cheap".split(" ")
_CUE = re.compile(r"xin loi|thu loi|lay lam tiec|tiec qua|rat tiec|tu choi|khong the|khong ho tro|khong duoc phep|phep khong|chua the|vi pham|khong phu hop|khong giup|khong co quyen|sory|apologi|canot|can t |unable|won t |decline|not able|comply|as an as?istant|language model|ngon ngu|refuse|tro ly|wil not|unfortunately")
_LABELS = ["Input", "Văn bản", "Source", "SOURCE", "Câu gốc", "Nguyên văn", "Text", "Đầu vào", "Original", "Bản gốc", "Câu"]


def _abroad(r: random.Random) -> str:
    lang = r.choice(["en", "en", "en", *_ABROAD])
    if lang != "en":
        return ("，" if lang == "zh" else " ").join(r.choice(_ABROAD[lang]) for _ in range(r.randint(5, 30)))
    some = _ABROAD["en"]
    part = lambda: " ".join([r.choice(["the", "a", "this", "that", "my", "our", "her", "his", "everyone in the"]), r.choice(some), r.choice(some), r.choice(_DOES), *r.sample(_TAIL, r.randint(1, 4))])
    t = r.choice([" and then ", " because ", " but ", " although ", " until ", " even though "]).join(part() for _ in range(r.randint(1, 4)))
    return t[0].upper() + t[1:] + r.choice([".", "", "!"])


def labelled(sound: list[tuple[str, str]], rows: int = 1500, seed: int = 11) -> tuple[list[list[str]], list[list[int]]]:
    """The small labelled table: clause signatures and tags."""
    r = random.Random(seed)
    good = []
    for a, b in sound:
        wa, wb = words(a), words(b)
        if wa and wb and wa != wb and abs(len(wa) - len(wb)) <= 1 and sum(fold(w) in {fold(x) for x in wa} for w in wb) >= 0.6 * len(wb):
            good.append((a, b))
    good = good or [("hom nay tui buồn qua ma k biet noi gi", "hôm nay tôi buồn quá mà không biết nói gì")]
    xs, ys = [], []
    for i in range(rows):
        a, b = r.choice(good)
        kind = i % 6
        if kind == REFUSAL:
            b = r.choice([". ", ", ", " - ", " nhưng ", " "]).join(x for x in (r.choice(_FIRST), r.choice(_BODY)) if x) + r.choice([". ", ", ", "", " "]) + r.choice(_LAST)
        elif kind == ECHO:
            b = r.choice([a, a.upper(), a.lower(), f"“{a}”", *[f"{r.choice(_LABELS)}: {x}" for x in (a, a.lower(), a.upper())]])
        elif kind == FOREIGN:
            b = _abroad(r)
        elif kind == UNFINISHED or kind == ANSWER and i % 12:  # cut short, or by so little that it is no defect
            w = b.split(" ")
            b = " ".join(w[: max(3, int(len(w) * (r.uniform(0.25, 0.7) if kind else r.uniform(0.76, 0.98))))])
            b = b[: r.randint(max(1, len(b) - 3), len(b))] + r.choice(["", "…", " ...", ""]) if kind else b
        elif kind == 5:  # an input in which a single word is left to normalise is answered, not echoed
            w = b.split(" ")
            j = r.randrange(len(w))
            w[j] = fold(w[j].lower()) if fold(w[j].lower()) != w[j].lower() else w[j] + "z"
            a = " ".join(w)
        if kind in (ANSWER, REFUSAL, FOREIGN) and r.random() < 0.2:
            a = None  # an answer whose input is not known, of any length
            if kind == ANSWER:
                w = b.split(" ")
                at = r.randrange(len(w))
                b = " ".join(w[at : at + r.randint(1, len(w))])
        sig, _ = clauses(a, b)
        if not sig:
            continue
        tag = [kind if kind in (REFUSAL, ECHO, FOREIGN) else ANSWER] * len(sig)
        if kind in (ANSWER, UNFINISHED) and "u3" in sig[-1].split("|"):
            tag[-1] = UNFINISHED
        xs.append(sig[:40])
        ys.append(tag[:40])
    return xs, ys


def train(sound: list[tuple[str, str]], spark: SparkSession | None = None) -> TokenCrf:
    """The field for a sample of sound pairs; with a session its weights are made once and kept."""
    model = TokenCrf(5, features, offsets=(-1, 0, 1), bits=13)
    table = labelled(sound)
    make = lambda: model.fit(*table, epochs=EPOCHS).dump()
    return model.load(stored(spark, "pairs", (EPOCHS, table), make) if spark else make())


def is_empty(answer: str | None) -> bool:
    return answer is None or " ".join(words(answer)) in STAND_IN and not any(unicodedata.category(c) == "So" for c in answer)


def defects(model: TokenCrf, inputs: list[str | None], answers: list[str | None]) -> list[str | None]:
    """The defect of each pair, or None."""
    sigs, sizes, out = [], [], []
    for a, b in zip(inputs, answers, strict=True):
        empty = is_empty(b)
        out.append("empty" if empty else None)
        s, n = ([], []) if empty else clauses(a, b)
        sigs.append(s)
        sizes.append(n)
    off = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int64)
    if not off[-1]:
        return out
    which, distinct = pd.factorize(np.array([x for s in sigs for x in s], dtype=object))
    tag = model.decode(off, list(distinct), which)
    for i in range(len(out)):
        t = tag[off[i] : off[i + 1]]
        if not t.any():
            continue
        share = np.bincount(t, sizes[i], 5) / sum(sizes[i])
        if share[REFUSAL] + share[FOREIGN] >= 0.5:
            out[i] = "refusal" if share[REFUSAL] >= share[FOREIGN] else "other_language"
        elif share[ECHO] >= 0.5:
            out[i] = "copy"
        elif t[-1] == UNFINISHED:
            out[i] = "truncated"
    return out


def sample(df: DataFrame, source: str, answer: str, rows: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``rows`` pairs, the same ones however the table is laid out."""
    return sampled(df, [source, answer], rows)


def flag(df: DataFrame, keys: list[str], source: str, answer: str, model: TokenCrf) -> DataFrame:
    """``keys`` and ``defect`` of every defective pair."""

    def run(batches):
        for b in batches:
            d = pa.array(defects(model, b.column(source).to_pylist(), b.column(answer).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), d], names=[*keys, "defect"])

    kinds = dict(df.dtypes)
    return df.select(*keys, source, answer).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", defect string").where("defect is not null")
