"""Pools smaller than an epoch are drawn again and again, as the SQL has it; empty pools give no rows."""

from collections import Counter, defaultdict

import duckdb
import pytest

from vietloom.plans import mixing


@pytest.mark.parametrize("size", [0, 60])
def test_small_pool(spark, tmp_path, size):
    spark.createDataFrame([(f"i{i:02d}",) for i in range(size)], "id string").write.parquet(f"{tmp_path}/corpus.parquet")
    got = [(r.epoch, r.id) for r in mixing.q_balanced(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view corpus as select * from '{tmp_path}/corpus.parquet/*.parquet'")
    assert sorted(got) == sorted(con.sql(mixing.ORACLE["balanced_epochs"]).fetchall())
    by = defaultdict(Counter)
    for e, i in got:
        by[e][i] += 1
    n = mixing._initial(spark, str(tmp_path)).count()
    assert {e: sum(c.values()) for e, c in by.items()} == ({e: mixing.PER for e in range(mixing.COUNT)} if n else {})
    assert n < mixing.PER and all(max(c.values()) - min(c[i] for i in c) <= 1 and len(c) == n for c in by.values())
