"""Private data per type: held-out rows of the labelled table, and sentences by another hand."""

import os

import pytest

from vietloom.llm import pii

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

HAND = [
    ("Anh Phan Quốc Bảo nhờ mình nhắn lại là mai họp", "name"), ("chuyển khoản cho Đỗ Thị Hồng Nhung giúp em", "name"), ("bác sĩ Vũ Hoàng Long khám rất kỹ", "name"), ("hôm qua gặp cô giáo Lê Thị Thu Hằng ở chợ", "name"), ("người bán tên Trịnh Công Danh", "name"),
    ("có gì bạn gọi 0987 654 321 nha", "phone"), ("số của shop: 0912.345.678", "phone"), ("liên lạc +84 903 123 456", "phone"), ("đt 0356789012 gặp chủ nhà", "phone"), ("nhắn tin qua số 0777123456 nhé", "phone"),
    ("thư gửi về hotro.khachhang@gmail.com", "email"), ("mình xài mail tuananh1990@yahoo.com.vn", "email"), ("viết cho mình ở lan_pham@outlook.com", "email"), ("đăng ký bằng địa chỉ abc.xyz@company.vn", "email"),
    ("số CMND 024567891 cấp tại đây", "id_number"), ("căn cước của em là 079203001234", "id_number"), ("hộ chiếu B1234567 hết hạn rồi", "id_number"), ("giấy chứng minh 251234567", "id_number"),
    ("em ở số 12 đường Trần Hưng Đạo, phường 5, quận 1", "address"), ("ship tới 45/7 Nguyễn Trãi, phường Bến Thành", "address"), ("nhà 8 ngõ 120 phố Hoàng Quốc Việt", "address"), ("địa chỉ: 234 đường Lê Lợi, quận Hải Châu", "address"),
]
CLEAN = ["mã đơn hàng 1234567890 giao chậm", "giá 250.000đ một cái", "chuyến bay VN1234 lúc 7h30", "năm 2023 mình mua 15 cái", "theo dõi @shopxinh nhé", "tỉ số 3-1 quá đẹp", "lớp 12A1 đi xe số 45", "quá trời luôn :[((", "", None]


@pytest.fixture(scope="module")
def backgrounds(spark):
    return pii.sample(spark.read.parquet(f"{DATA}/corpus.parquet"), "input_text", 1500)


@pytest.fixture(scope="module")
def model(spark, backgrounds):
    return pii.train(backgrounds[:900], spark)


def test_recall_per_type_on_held_out_rows(model, backgrounds):
    rows, labels = pii.labelled(backgrounds[900:], rows=800, seed=99)
    hit, total, false = dict.fromkeys(pii.TYPES, 0), dict.fromkeys(pii.TYPES, 0), 0
    for toks, lab in zip(rows, labels, strict=True):
        at, true, i = [0], [], 0
        for t in toks:
            at.append(at[-1] + len(t))
        while i < len(lab):
            j = i + 1
            if lab[i] % 2:
                while j < len(lab) and lab[j] == lab[i] + 1:
                    j += 1
                true.append((at[i], at[j], pii.TYPES[(lab[i] - 1) // 2]))
            i = j
        got = pii.find(model, ["".join(toks)])[0]
        meets = lambda x, y: x[2] == y[2] and x[0] < y[1] and y[0] < x[1]
        for x in true:
            total[x[2]] += 1
            hit[x[2]] += any(meets(x, y) for y in got)
        false += sum(not any(meets(x, y) for x in true) for y in got)
    recall = {k: hit[k] / total[k] for k in total}
    assert recall["name"] > 0.75 and all(recall[k] > 0.92 for k in ("email", "phone", "id_number", "address")), recall
    assert false <= 0.02 * sum(total.values())


def test_sentences_by_another_hand(model):
    found = [{k for *_, k in f} for f in pii.find(model, [t for t, _ in HAND])]
    for kind in pii.TYPES:
        own = [kind in f for f, (_, k) in zip(found, HAND, strict=True) if k == kind]
        assert sum(own) >= len(own) - 1, (kind, own)
    assert pii.find(model, CLEAN) == [[] for _ in CLEAN]


def test_redaction_keeps_the_rest(model):
    t = "gọi 0987 654 321 nha, mail lan_pham@outlook.com nhé"
    spans = pii.find(model, [t])[0]
    assert pii.redact(t, spans) == "gọi <PHONE> nha, mail <EMAIL> nhé"
