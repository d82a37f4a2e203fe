"""Problem 7: private data in free text, by a linear-chain conditional random field over word shapes.

The field is trained on each use from a small labelled table that :func:`labelled` writes: sentence parts of a bounded
sample of the corpus (``SAMPLE`` rows) without any cue of private data, with made-up private data and look-alikes
(order codes, prices, handles, bus lines) put in. Decoding is Viterbi in numpy batches over whole texts; a found
span must then pass a format check of its type.

Cases: null and blank texts have nothing found and stay as they are; composed and decomposed text are read alike;
very long texts are one row; rows that repeat give the same result each.
"""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled, stored
from .crf import TokenCrf

SAMPLE = 900
TYPES = ("email", "phone", "id_number", "address", "name")
TOKEN = re.compile(r"\s*(?:(?:[^\W\d_][̀-ͯ]*)+|\d+|[^\w\s]|_)")

#: Common and less common Vietnamese family names, and syllables of given names.
FAMILY = "nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý tạ lã khúc doãn thạch đinh đoàn trịnh mai đào lâm phùng tô hà cao chu tăng kiều quách từ tống thái châu lương vương triệu nghiêm lưu ông la văn giang mạc thân tiêu bạch âu ninh cù lại hứa".split()
GIVEN = (
    "an anh ánh bách bảo bích bình cẩm châu chi cường cúc danh diệp diệu dung duy dũng dương đạt đăng đông đức gia giang hà hải hạnh hân hằng hiền hiếu hoa hoài hòa hoàng hồng huệ hùng huy huyền hương hữu kha khải khang khánh khoa khôi kiên kiến kiệt kim kỳ lam lâm lan lệ liên linh loan lộc long ly mai mạnh mẫn mi minh my mỹ nam nga ngân nghĩa ngọc nguyên nguyệt nhã nhân nhật nhi nhiên như nhung oanh phát phong phú phúc phước phương quang quân quế quốc quyên quỳnh sơn sương tài tâm tân tấn thạch thái thanh thành thảo thắng thắm thiên thiện thịnh thoa thơ thu thuận thục thủy thúy thư thương tiến tiệp tín tịnh toàn trang trâm trí trinh trọng trung trúc tú tuấn tuệ tùng tường tuyết uyên vân văn việt vinh vũ vy vỹ xuân yến thị"
).split()
DIGITS = "không một hai ba bốn năm sáu bảy tám chín".split()
STREETS = "hoa sen mai đào trúc cúc tre dừa bàng phượng lúa suối đồi núi sông hồ biển cát đá mây gió nắng mưa sao trăng sương đêm sớm xanh vàng đỏ trắng lớn nhỏ cũ mới cầu bến chợ vườn đầm ngàn thông lá cỏ hạt chim cau sếu én ri mười hai ba gạo ngọc trai non dẻ me khuya cuội lạnh lùa rừng thác ghềnh".split()
SYLLABLES = "hanh phong tinh oanh nga lam dang trong thao kiet man loc quyen tung khoi cam linh minh tuan huong shop kho store studio tiem nha vuon meo cafe thu viet hop mail gui nhanh mot hai ba bon anh em duong son tra".split()


def fold(w: str) -> str:
    x = "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c)).replace("đ", "d")
    return re.sub(r"([^\W\d_])\1+", r"\1", x)


_FAMILY = {fold(x) for x in FAMILY}
_GIVEN = {fold(x) for x in GIVEN}
_DIGIT = {fold(x) for x in DIGITS} | {"mot", "lam", "tu", "le", "linh"}


def features(token: str) -> list[str]:
    w = token.lstrip()
    out = ["b", "glued" if len(w) == len(token) else "apart"]
    w = unicodedata.normalize("NFC", w)
    c = w[0]
    if c.isdigit():
        return [*out, "num", f"len{min(len(w), 14)}", f"first{c}", f"first{c}len{min(len(w), 14)}", f"first{w[:2]}", f"glued{len(w) == len(token)}len{min(len(w), 14)}"]
    if not c.isalpha():
        return [*out, f"mark{w}", f"mark{w}{out[1]}"]
    f = fold(w)
    case = "up" if w.isupper() and len(w) > 1 else "title" if c.isupper() else "low"
    out += ["word", case, f"w={f}", f"suf={f[-2:]}", f"len{min(len(f), 8)}", f"ascii{w.isascii()}"]
    if f in _FAMILY:
        out += ["family", f"family{case}", f"family={w.lower()}"]
    if f in _GIVEN:
        out += ["given", f"given{case}", f"given={w.lower()}"]
    if f in _DIGIT:
        out.append("digitword")
    if len(w) == 1:
        out.append(f"letter{case}")
    return out


def _maker(seed: int):
    r = random.Random(seed)
    pick, num = r.choice, lambda n: "".join(r.choice("0123456789") for _ in range(n))
    flat = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")

    def spelled(s: str) -> str:
        k = r.random()
        s = s if k < 0.5 else s.lower() if k < 0.62 else flat(s) if k < 0.72 else flat(s.lower()) if k < 0.92 else s.upper()
        return s

    def email():
        local = pick(SYLLABLES) + pick(["", "", "_", "."]) + pick([num(pick([2, 2, 3, 4])), pick(SYLLABLES), pick(SYLLABLES) + num(2)])
        dot = pick([".", ".", ".", ".", " chấm ", " cham ", "[chấm]", " dot "])
        host = dot.join([pick(SYLLABLES) + pick(["", "", pick(SYLLABLES)]), *([pick(SYLLABLES)] if r.random() < 0.3 else []), pick(["test", "example", "invalid", "com", "vn", "net", "com" + dot + "vn"])])
        s = local + pick(["@", "@", "@", "@", " @ ", " (at) ", "[at]", "[a còng]", " a còng ", "(a còng)", "[a cong]"]) + host
        return s.upper() if r.random() < 0.15 else s

    def grouped(d: str, cuts, sep: str) -> str:
        out, i = [], 0
        for c in cuts:
            out.append(d[i : i + c])
            i += c
        return sep.join(x for x in [*out, d[i:]] if x)

    def phone():
        d = pick("3567898666") + num(8)
        k = r.random()
        if k < 0.14:
            return " ".join(DIGITS[int(x)] for x in "0" + d) if r.random() < 0.6 else flat(" ".join(DIGITS[int(x)] for x in "0" + d))
        if k < 0.34:
            return "+84" + pick(["", " ", "-", " ("]) + grouped(d, pick([(9,), (2, 3), (3, 6), (5,), (3, 3), (6,), (8,), (2, 7)]), pick([" ", "-", "."]))
        s = pick("oO") + d if k < 0.48 else "0" + d
        return grouped(s, pick([(10,), (10,), (10,), (4, 3), (3, 3), (2, 2, 2, 2), (4,), (5,), (3, 4)]), pick([" ", ".", "-", " "]))

    def id_number():
        k = r.random()
        if k < 0.25:
            s = pick("ABCEKNPQ") + num(7)
            return s.lower() if r.random() < 0.1 else s
        if k < 0.55:
            return grouped(num(9), pick([(9,), (9,), (3, 3)]), pick([" ", ".", "-"]))
        return grouped("0" + num(11), pick([(12,), (12,), (3, 3, 3), (4, 4)]), pick([" ", ".", " "]))

    def place():
        return " ".join(x.title() for x in r.sample(STREETS, pick([2, 2, 2, 3, 3, 4])))

    def address():
        n, m = str(r.randint(1, 399)), str(r.randint(1, 99))
        ward = pick(["phường ", "phường ", "quận ", "p. ", "P. ", "q. ", "thị trấn ", "xã ", "huyện "]) + place()
        road = pick(["đường ", "đường ", "đ. ", "phố ", "Đ. "]) + place()
        s = pick([
            f"số {n} {road}, {ward}", f"{n}/{m} {place()}, {ward}", f"{n} {place()}, {ward}, tầng {r.randint(1, 12)}", f"hẻm {n} {road}, {ward}", f"ngõ {m} phố {place()}, nhà {n}", f"số nhà {n}, tổ {m}, {ward}", f"{n}/{m} {place()}, {ward}", f"{n} {place()}, {ward}",
            f"ngách {n}/{m} {road}", f"nhà {n}, ngõ {m} {road}, {ward}", f"số {n}/{m} {road}, {ward}", f"{n} {road}, {ward}", f"số {n} {road}, {ward}",
        ])
        return spelled(s)

    def name():
        return spelled(" ".join(x.title() for x in [pick(FAMILY), *(pick(GIVEN) for _ in range(pick([1, 2, 2, 2, 2, 3])))]))

    lead = {
        "email": ["liên hệ qua", "mail của mình là", "gửi thông tin về", "hỏi thêm thì viết cho", "email", "mail:", "", "", "", ""],
        "phone": ["sđt", "zalo", "alo", "ib hoặc nhắn", "gọi giúp số", "số điện thoại", "hotline", "sdt:", "gọi", "", "", ""],
        "id_number": ["căn cước", "giấy tờ gồm số cmnd:", "em gửi CMT", "đăng ký bằng số căn cước công dân", "số hộ chiếu", "passport", "CCCD số", "chứng minh thư số", "thẻ căn cước:", "giấy tờ gồm hộ chiếu", "cccd", "cmnd", "hộ chiếu", "em gửi passport"],
        "address": ["ship về", "giao tới", "qua lấy tại", "địa chỉ", "mình ở", "nhà em ở", "", "", ""],
        "name": ["người nhận là", "tên mình là", "cảm ơn", "gửi cho", "gặp", "hỏi", "mình tên", "tên em là", "", "", "", "", "", ""],
    }
    value = {"email": email, "phone": phone, "id_number": id_number, "address": address, "name": name}

    def decoy():
        return pick([
            f"mã đơn DH{num(8)}", f"mã đơn {pick('ABDH')}{pick('HVN')}{num(7)}", f"mã vận đơn {num(4)} {num(3)} {num(2)}", f"mã vận đơn {num(9)}", f"lô sản xuất {num(5)}", f"ở quận {r.randint(1, 12)} ship nhanh", f"giá chỉ {num(3)}.000đ", f"giá {num(2)}k", f"tỉ số {num(1)}-{num(1)}", f"dung lượng {num(3)}MB",
            f"nhiệt độ {num(2)}°C ±1", f"giá {num(2)}€ hay £{num(1)}", f"xe {num(1)}B tuyến {num(3)}", f"phòng {num(3)} tầng {num(1)}", f"theo dõi @{pick(SYLLABLES)}{pick(SYLLABLES)} nhé", f"theo dõi @{pick(SYLLABLES)} nhé", f"hôm {num(1)}/{num(1)} nhận", f"quán café «{place()}» ©", f"lễ hội của người {place()} năm nay đông", f"bọn phe {place()} mến khách",
            f"thấy dân {place()} là phải tránh", f"được {num(3)} phần trăm", f"khoảng {num(3)} tiếng", f"phim {place()}", f"gặp ngoài đường", f"tìm đường về nhà", f"qua cầu {place()}", f"số lượng {num(4)}", f"đơn hàng {num(10)}", f"mã giảm giá {pick('ABCXYZ')}{pick('ABCXYZ')}{num(4)}", f"năm {num(4)}", f"cảm ơn shop", f"hỏi mẹ", f"gửi cho em gái", f"người nhận là hàng xóm",
            f"model {pick(SYLLABLES)}{pick(SYLLABLES)}{num(3)}", f"điểm {num(3)},{num(pick([1, 2]))}", f"hôm {num(2)}/{num(2)} nhận", pick([":[((", ":))", ":)))", "=))", ":((", "=)))", ":[", "..", "...", "... ạ.", ", ạ.", "!!", "huhu."]), pick(["... :))", ", hả trời. :[((", ", ạ...", "haha. =))", "á à... :)"]),
        ])

    return r, lead, value, decoy, spelled


#: Backgrounds must show none of these, so that what is put in is all there is.
CUES = r"(?i)@|\(at\)|\[|còng|cong\]|cccd|cmnd|cmt|căn cước|can cuoc|chứng minh|chung minh|hộ chiếu|ho chieu|passport|sđt|zalo|alo |ib ho|gọi giúp|goi giup|liên hệ|lien he|phường|phuong |phuờng|ngõ|hẻm|hem |số nhà|so nha|nhà số|thị trấn|thi tran|[, ]p\. |tên mình|ten minh|người nhận|nguoi nhan|cảm ơn|cam on|gửi cho|gui cho|gặp|hỏi |\+84|\d{4}|\d/\d|\d [Đđ]|o\d|địa chỉ|dia chi|giao tới|ship về|mình ở|lấy tại|mail|(không|một|hai|ba|bốn|năm|sáu|bảy|tám|chín)( (không|một|hai|ba|bốn|năm|sáu|bảy|tám|chín)){2}"


def _bare_name(t: str) -> bool:
    w = re.findall(r"[^\W\d_]+", t)
    return any(fold(a) in _FAMILY and fold(b) in _GIVEN and fold(c) in _GIVEN for a, b, c in zip(w, w[1:], w[2:], strict=False))


def labelled(backgrounds: list[str], rows: int = 4400, seed: int = 7) -> tuple[list[list[str]], list[list[int]]]:
    """The small labelled table: tokens and states (0 outside, 2t+1 begin, 2t+2 inside of type t)."""
    r, lead, value, decoy, spelled = _maker(seed)
    back = [t for t in backgrounds if t and not re.search(CUES, t) and not _bare_name(t)] or ["bài hát này hay"]
    xs, ys = [], []
    for _ in range(rows):
        base = TOKEN.findall(r.choice(back))
        a = r.randrange(max(1, len(base) - 8))
        base = base[a : a + r.randint(4, 16)]
        parts: list[tuple[str, int]] = []
        for _ in range(r.choice([0, 1, 1, 1, 2])):
            k = r.random()
            if k < 0.25:
                parts.append((decoy(), -1))
            else:
                t = r.choices(range(5), (3, 4, 5, 4, 5))[0]
                parts.append((spelled(r.choice(lead[TYPES[t]])), -1))
                parts.append((value[TYPES[t]](), t))
                if r.random() < 0.35:
                    parts.append((",", -2))
        where = r.choice([0, len(base), r.randint(0, len(base)), r.randint(0, len(base))])
        toks, labs = base[:where], [0] * len(base[:where])
        for text, t in parts:
            own = TOKEN.findall(text if t == -2 else " " + text)
            toks += own
            labs += [0] * len(own) if t < 0 else [2 * t + 1] + [2 * t + 2] * (len(own) - 1)
        toks += base[where:]
        labs += [0] * len(base[where:])
        if toks:
            xs.append(toks[:70])
            ys.append(labs[:70])
    return xs, ys


def train(backgrounds: list[str], spark: SparkSession | None = None) -> TokenCrf:
    """The field for a sample of backgrounds; with a session its weights are made once and kept."""
    model = TokenCrf(11, features)
    table = labelled(backgrounds)
    make = lambda: model.fit(*table).dump()
    return model.load(stored(spark, "pii", table, make) if spark else make())


_AT = re.compile(r"@|\(\s*at\s*\)|\[\s*at\s*\]|a c[òo]ng", re.I)


def plausible(kind: str, s: str) -> bool:
    """The exact check of a span's format."""
    words = re.findall(r"(?:[^\W\d_][\u0300-\u036f]*)+", unicodedata.normalize("NFC", s))
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(_AT.search(unicodedata.normalize("NFC", s))) and len(words) >= 2
    if kind == "phone":
        return 9 <= digits + len(re.findall(r"(?i)(?<![^\W\d_])o(?=[\d .\-])", s)) <= 13 if digits else sum(fold(w) in _DIGIT for w in words) >= 9
    if kind == "id_number":
        if digits == 9:  # in one piece or by threes; order codes are grouped otherwise
            return {len(x) for x in re.findall(r"\d+", s)} <= {9} or [len(x) for x in re.findall(r"\d+", s)] == [3, 3, 3]
        return digits == 12 or digits in (7, 8) and len(words) == 1 and len(words[0]) == 1
    if kind == "address":
        return digits > 0 and len(words) >= 2
    if not 2 <= len(words) <= 5 or digits:
        return False
    title = all(w[0].isupper() for w in words)
    if len(words) == 2:  # short ones only as they are properly written
        return title and words[0].lower() in FAMILY and fold(words[1]) in _GIVEN
    return fold(words[0]) in _FAMILY and sum(fold(w) in _GIVEN for w in words[1:]) >= 2 or title


_RUN = re.compile(r"(?:\(?\+\(?|(?<![^\W_])[(]?[oO](?=\d)|\(?)\d(?:[ .\-()]{0,2}\d)*")


def whole_number(text: str, a: int, b: int) -> tuple[int, int, str] | None:
    """The run of digit groups around a tagged part, and what its form says it is: the field may cut runs short."""
    for m in _RUN.finditer(text, max(0, a - 40)):
        if m.start() >= b:
            return None
        if m.end() > a:
            t, n = m.group(), sum(c.isdigit() for c in m.group())
            if "+" in t or t.lstrip("(")[0] in "oO":
                return (*m.span(), "phone") if 9 <= n <= 12 else None
            first = next(c for c in t if c.isdigit())
            if n == 12 or n == 9 and first != "0":
                return (*m.span(), "id_number")
            return (*m.span(), "phone") if n == 10 and first == "0" else None
    return None


def find(model: TokenCrf, texts: list[str | None], checked: bool = True) -> list[list[tuple[int, int, str]]]:
    """(start, end, type) of the private data of each text; unless ``checked`` just as the field gives them."""
    rows = [TOKEN.findall(t) if t else [] for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not off[-1]:
        return out
    which, distinct = pd.factorize(np.array([t for r in rows for t in r], dtype=object))
    state = model.decode(off, list(distinct), which)
    hit = np.unique(np.searchsorted(off, np.nonzero(state)[0], "right") - 1)
    for i in hit:
        st = state[off[i] : off[i + 1]]
        spans = [m.span() for m in TOKEN.finditer(texts[i])]
        k = 0
        while k < len(st):
            if not st[k]:
                k += 1
                continue
            t, j = (st[k] - 1) // 2, k + 1
            while j < len(st) and st[j] == 2 * t + 2:
                j += 1
            a = spans[k][0] + len(rows[i][k]) - len(rows[i][k].lstrip())
            b = spans[j - 1][1]
            known = TYPES[t]
            if checked and known in ("phone", "id_number") and (run := whole_number(texts[i], a, b)):
                a, b, known = run
            if (not checked or plausible(known, texts[i][a:b])) and not (out[i] and out[i][-1][1] > a):
                out[i].append((a, b, known))
            k = j
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Typed placeholders for the spans, the rest as it was."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def sample(df: DataFrame, text: str, rows: int = SAMPLE) -> list[str]:
    """At most ``rows`` texts, the same ones for the same table however it is laid out."""
    return [t for (t,) in sampled(df, [text], rows)]


def annotate(df: DataFrame, id_col: str, text: str, model: TokenCrf) -> DataFrame:
    """(id, spans, redacted) of every row; spans is an array of (start, end, pii_type)."""
    kind = dict(df.dtypes)[id_col]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string())]))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            found = find(model, texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[{"start": a, "end": e, "pii_type": k} for a, e, k in f] for f in found], span), pa.array([t if not f else redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string())],
                names=["id", "spans", "redacted"],
            )

    return df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, spans array<struct<start:int,end:int,pii_type:string>>, redacted string")
