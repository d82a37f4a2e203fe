"""Words of a clause count wherever they stand."""

from vietloom.llm import pairs


def test_words_behind_the_thirtieth():
    long = " ".join(f"lạ{i}" for i in range(40))
    (a,), (n,) = pairs.clauses("chào bạn", f"{long} tôi không thể thực hiện")
    (b,), _ = pairs.clauses("chào bạn", f"{long} tôi muốn mua điện thoại")
    assert n == 45 and a != b
    assert {"w=khong", "w=hien", "p=khong the", "p=thuc hien"} <= set(pairs.features(a))
