"""Epochs over whole pools: every id is drawn, rounds wrap, and repeats of the small arm are replaced."""

import hashlib
from collections import Counter, defaultdict

import pytest

from vietloom.operators import mixtures
from vietloom.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pool"))
    spark.createDataFrame([(f"i{i:03d}",) for i in range(203)], "id string").write.parquet(f"{d}/corpus.parquet")
    spark.createDataFrame([("g1", "dev"), ("g2", "dev"), ("g3", "test")], "id string, split string").write.parquet(f"{d}/gold.parquet")
    return d


def run(spark, d, name):
    return catalog.queries()[name](spark, d).collect()


def test_whole_pool_is_drawn(spark, tables):
    by = defaultdict(list)
    for r in run(spark, tables, "balanced_epochs_whole"):
        by[r.epoch].append(r.id)
    assert {e: (len(x), len(set(x))) for e, x in by.items()} == {e: (82, 82) for e in range(7)}
    used = Counter(i for x in by.values() for i in x)
    assert len(used) == 203 and set(used.values()) == {2, 3}
    assert {r.times: r.n_ids for r in run(spark, tables, "exposure_histogram_whole")} == Counter(used.values())
    assert run(spark, tables, "mixture_validate_whole")[0].asDict() == {"n_epochs": 7, "wrong_size": 0, "with_repeats": 0, "foreign_ids": 0, "unused_ids": 0}
    cover = run(spark, tables, "coverage_epochs_whole")
    assert len(cover) == 3 * 82 and len({r.id for r in cover}) == 203
    assert Counter(r.label_source for r in run(spark, tables, "slot_order_whole")) == {"gold": 14, "pseudo": 574}


def brute(initial, pool, per, count, seed):
    """The reference's loop with hashes for shuffles."""
    small_used, large_used, out = Counter(), Counter(), {}
    for e in range(count):
        h = lambda i: hashlib.sha256(f"{seed}:{e}:{i}".encode()).hexdigest()  # noqa: B023, E731
        small = sorted(initial, key=lambda i: (small_used[i], h(i), i))[:per]
        shared = [i for i in small if not large_used[i]]
        rest = sorted(set(pool) - set(shared), key=lambda i: (large_used[i], h(i), i))
        large = shared + rest[: per - len(shared)]
        small_used.update(small)
        large_used.update(large)
        out["small", e], out["large", e] = set(small), set(large)
    return out


def test_repeats_of_the_small_arm_are_replaced(spark, tables):
    from vietloom.plans.mixing import SEED, _initial

    initial = [r.id for r in _initial(spark, tables).collect()]
    per, got = -(-len(initial) * 2 // 5), defaultdict(set)
    for r in run(spark, tables, "factorial_epochs_whole"):
        got[r.arm, r.epoch].add(r.id)
    assert got == brute(initial, [f"i{i:03d}" for i in range(203)], per, 5, SEED)
    assert got["small", 3] & (got["small", 0] | got["small", 1]) and not got["large", 3] & set().union(*(got["large", e] for e in range(3)))


def test_least_used_ranks(frame):
    from pyspark.sql import functions as F

    x = frame([("a", 1), ("b", 0), ("c", 0), ("d", 2)], "id string, used int")
    assert sorted(r.id for r in mixtures.least_used(x, 3, F.col("id")).collect()) == ["a", "b", "c"]
