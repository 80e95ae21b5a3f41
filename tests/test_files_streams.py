import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.functions import extend as Z
from chainloom.sources import files as S
from chainloom.sources import sinks as W
from chainloom.streaming import events as T


def test_fasta_of_odd_lines(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one first words\nACD\nEF G\n\n>two\n>three\nAA\r\nCC\n")
    assert {r.name: r.sequence for r in S.read_fasta(spark, str(tmp_path / "a.fasta")).collect()} == {"one": "ACDEFG", "two": "", "three": "AACC"}


def test_csv_bad_cells_are_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\nx,1.5\n007,bad\n"a,b",\n')
    assert [tuple(r) for r in S.read_table(spark, str(tmp_path / "a.csv"), "id string, v double").collect()] == [("x", 1.5), ("007", None), ("a,b", None)]
    with pytest.raises(ValueError, match="unknown suffix"):
        S.read_table(spark, "a.odd")


def test_dx_in_fortran_order():
    body = b"# c\nobject 1 class gridpositions counts 2 1 2\norigin 0 1 2\ndelta 0.5 0 0\ndelta 0 0.5 0\ndelta 0 0 0.5\nobject 3 class array\n1 2\n3 4\nattribute x\n"
    grid = S.parse_dx(body).iloc[0]
    assert grid["values"] == [1.0, 3.0, 2.0, 4.0] and grid["step"] == [0.5] * 3
    with pytest.raises(ValueError):
        S.parse_dx(body[:120])


def test_split_npy(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 2, 2)
    out = io.BytesIO()
    np.save(out, a)
    for i, part in enumerate((out.getvalue()[:100], out.getvalue()[100:])):
        (tmp_path / f"x.npy.part{i}").write_bytes(part)
    got = {r.row: (r.shape, r.values) for r in S.read_npy(spark, f"{tmp_path}/x.npy*").collect()}
    assert got == {i: ([2, 2], a[i].ravel().tolist()) for i in range(3)}


def test_notebook_outputs(spark, tmp_path):
    (tmp_path / "n.ipynb").write_text('{"cells": [{"outputs": []}, {"outputs": [{"text": ["a\\n", "b"]}, {"data": {"text/plain": ["c"]}}]}, {"source": "no outputs"}]}')
    assert [(r.cell, r.output, r.text) for r in S.read_notebook(spark, str(tmp_path / "n.ipynb")).orderBy("cell", "output").collect()] == [(1, 0, "a\nb"), (1, 1, "c")]


def test_fetch_retries_caches_and_gives_up(tmp_path):
    import urllib.error

    calls, pauses = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return b"body"

    assert S.fetch("u", str(tmp_path), opener=flaky, sleep=pauses.append) == b"body" and pauses == [1.0, 2.0]
    assert S.fetch("u", str(tmp_path), opener=lambda u: 1 / 0) == b"body"

    def gone(url):
        raise urllib.error.HTTPError(url, 404, "gone", None, None)

    assert S.fetch("v", str(tmp_path), opener=gone) is None


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("b", 2.0), ("a", None)], "id string, v double")
    assert W.markdown(d.orderBy("id")) == "| id | v |\n|---|---|\n| a |  |\n| b | 2 |"
    first = W.write_parquet(d, f"{tmp_path}/p", "id")
    assert first == W.write_parquet(d.orderBy("id").coalesce(1), f"{tmp_path}/q", "id") and first["n_rows"] == 2
    digest = W.write_json(f"{tmp_path}/x.json", {"b": 1, "a": [2]})
    assert (tmp_path / "x.json.sha256").read_text() == digest and S.read_config(f"{tmp_path}/x.json") == {"a": [2], "b": 1}
    packed = W.pack(str(tmp_path / "p"), str(tmp_path / "z.zip"), lambda n: n.endswith(".parquet"))
    assert packed and W.pack(str(tmp_path / "p"), str(tmp_path / "z2.zip"), lambda n: n.endswith(".parquet")) == packed
    assert (tmp_path / "z.zip").read_bytes() == (tmp_path / "z2.zip").read_bytes()


def test_extractor_failures_stay_with_their_row(spark):
    d = spark.createDataFrame([(1, "2"), (2, "x"), (3, None)], "k int, t string")
    got = {r.k: (r.v, r.error) for r in Z.extract(d, lambda t: {"v": float(t)}, ["t"], "v double", ["k"]).collect()}
    assert got[1] == (2.0, None) and got[2][0] is None and "ValueError" in got[2][1] and "TypeError" in got[3][1]


def test_stream_drops_late_rows_and_repeats(spark, tmp_path):
    schema = "event_id long, ts timestamp, v double"
    for i, rows in enumerate([[(1, "2024-01-01 00:00:01", 1.0), (1, "2024-01-01 00:00:02", 1.0)], [(2, "2024-01-01 05:00:00", 2.0)], [(6, "2024-01-01 05:01:00", 0.0)], [(3, "2024-01-01 00:10:00", 9.0), (4, "2024-01-01 05:10:00", 3.0)], [(5, "2024-01-01 12:00:00", 1.0)]]):
        spark.createDataFrame(rows, "event_id long, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        os.utime(next((tmp_path / "in" / f"b={i}").glob("*.parquet")), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = lambda: T.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema)
    got = {r.start.hour: (r.n, r.total) for r in T.drain(T.windowed(stream(), "ts", [], "1 hour", "v"), "w").collect()}
    assert got == {0: (2, 2.0), 5: (3, 5.0)}  # the row of 00:10 came too late, 12:00 is still open
    assert T.drain(T.once(stream(), "ts", ["event_id"]), "d").where("event_id = 1").count() == 1
