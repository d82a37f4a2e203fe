"""Every confidence band gets audited rows of its own, and rows without a band are not lost."""

from collections import Counter
from datetime import datetime

import pytest

from vietloom.plans import catalog
from vietloom.plans.common import SOURCES

REVIEW = "sample_id string, prompt_version string, prompt_hash string, llm_model string, decision string, corrected_text string, reason_code string, batch_id string, reviewed_at timestamp"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("audit"))
    rows = [(f"i{i:02d}", SOURCES[0], i / 60 if i < 60 else None, f"in {i}", f"in {i}") for i in range(63)]
    spark.createDataFrame(rows, "id string, original_source string, model_a_confidence double, input_text string, candidate_text string").write.parquet(f"{d}/candidates.parquet")
    spark.createDataFrame([(r[0], "v", "h", "m", "KEEP", None, None, "b", datetime(2026, 1, 1)) for r in rows], REVIEW).write.parquet(f"{d}/review_results.parquet")
    spark.createDataFrame([("g", "dev", "held", "held")], "id string, split string, input_text string, target_text string").write.parquet(f"{d}/gold.parquet")
    return d


def test_audit_of_each_band(spark, tables):
    got = catalog.queries()["audit_sample_bands"](spark, tables).collect()
    assert Counter(r.band for r in got) == {0: 10, 1: 10, 2: 10, -1: 3}
    assert all(r.band == -1 if int(r.sample_id[1:]) >= 60 else r.band == int(r.sample_id[1:]) // 20 for r in got)


def test_pivot_by_band(spark, tables):
    got = catalog.queries()["weak_label_band_pivots"](spark, tables).collect()
    assert {r.band: (r.keep, r.edit, r.reject, r.accepted) for r in got} == {0: (20, 0, 0, 20), 1: (20, 0, 0, 20), 2: (20, 0, 0, 20), -1: (3, 0, 0, 3)}
