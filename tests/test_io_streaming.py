import json

import pytest
from pyspark.sql import functions as F

from vietloom.sources import io
from vietloom.streaming import ingest


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿x,y\n"a ""b""\nc",2\n'.encode())
    assert [tuple(r) for r in io.read_rows(spark, str(tmp_path / "a.csv")).collect()] == [('a "b"\nc', "2")]
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    df = io.read_rows(spark, str(tmp_path / "a.tsv"))
    assert df.columns == ["x", "y"] and df.first().y == "2"
    with pytest.raises(ValueError):
        io.read_rows(spark, "a.xml")


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x":"đ"}\n\n{"x":null}\n')
    assert [r.x for r in io.read_rows(spark, str(tmp_path / "a.jsonl"), ["x"]).collect()] == ["đ", None]
    for doc in ([{"x": "1"}], {"records": [{"x": "1"}]}, {"items": [{"x": "1"}], "other": 3}):
        (tmp_path / "d.json").write_text(json.dumps(doc))
        assert [r.x for r in io.read_rows(spark, str(tmp_path / "d.json"), ["x"]).collect()] == ["1"]
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):  # noqa: B017
        io.read_rows(spark, str(tmp_path / "bad.jsonl"), ["x"]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("đ", None), ("b", 1)], "x string, n int")
    assert io.write_jsonl(df, str(tmp_path / "out")) == 2
    assert io.read_jsonl(spark, str(tmp_path / "out"), df.schema).exceptAll(df).count() == 0
    io.publish(df, str(tmp_path / "pub"), "1")
    with pytest.raises(Exception):  # noqa: B017
        io.publish(df, str(tmp_path / "pub"), "1")
    io.write_csv_sheet(df, str(tmp_path / "sheet"), ["note"])
    assert io.read_delimited(spark, str(tmp_path / "sheet")).columns == ["x", "n", "note"]
    (tmp_path / "l.txt").write_text(" a \n\n\tb\n")
    assert [r.line for r in io.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    done = spark.createDataFrame([(0, True), (0, True), (1, True), (1, False)], "chunk int, valid boolean")
    left = io.resume_chunks(done, spark.createDataFrame([(0, 2), (1, 2), (2, 2)], "chunk int, expected int"))
    assert sorted(r.chunk for r in left.collect()) == [1, 2]


def test_stream_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    rows = lambda n: spark.createDataFrame([(f"k{i % 3}", i) for i in range(n)], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    rows(5).coalesce(1).write.parquet(src)
    go = lambda: ingest.drain(ingest.first_seen(ingest.tail(spark, src, rows(1)), "at", ["k"]), out, mark)
    go()
    rows(9).coalesce(1).write.mode("append").parquet(src)
    go()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["k0", "k1", "k2"]
    ingest.drain(ingest.windowed_counts(ingest.tail(spark, src, rows(1)), "at", "k", "2 seconds", "0 seconds"), str(tmp_path / "w"), str(tmp_path / "wm"))
    assert spark.read.parquet(str(tmp_path / "w")).count() > 0
