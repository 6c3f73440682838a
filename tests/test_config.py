import json

import pytest

from galena.sources import config as C
from galena.sources import scans
from galena.streaming import logs as L


def test_settings_never_override_the_environment():
    known = C.settings("# c\nA=1\n B = 'two' \n\nJUDGE_KEY=x", {"A": "env"})
    assert known == {"A": "env", "B": "two", "JUDGE_KEY": "x"}
    assert C.role_setting(known, "judge", "KEY") == "x" and C.role_setting(known, "other", "B") == "two" and C.role_setting(known, "other", "KEY", "-") == "-"
    with pytest.raises(ValueError):
        C.settings("nothing", {})


def test_cells_and_paths(spark):
    spec = {"tables": {"arms": [{"name": "x", "role": "base", "cells": [{"responses": "r.jsonl", "grades": "s3a://b/g", "seed": 42}]}, {"name": "y", "cells": [{"responses": "q"}]}]}}
    got = {tuple(r) for r in C.cells(spark, spec, "tables", "/d").collect()}
    assert got == {("x", "base", 42, "/d/r.jsonl", "s3a://b/g"), ("y", "table", None, "/d/q", None)}
    assert C.named_path("a=p:m:3:0.5") == ("a", "p", "m", 3, 0.5) and C.named_path("a=s3a://b/c") == ("a", "s3a://b/c", None, 1, 0.0)
    assert C.point_path("a:s1:50=p") == ("a", "s1", 50, "p")
    assert C.pairs(None, ["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")] and C.pairs("c:a", ["a", "c"]) == [("c", "a")]
    for bad in ("a:a", "a:q", "a"):
        with pytest.raises(ValueError):
            C.pairs(bad, ["a", "b"])
    with pytest.raises(ValueError):
        C.named_path("=p")


def test_plugins_and_reports(tmp_path):
    @C.plugin("test-manager")
    def manager():
        return 1

    assert C.plugin_named("test-manager") is manager
    for bad in (lambda: C.plugin("test-manager")(manager), lambda: C.plugin_named("absent")):
        with pytest.raises(ValueError):
            bad()
    rows = [{"arm": "a_b", "v": 1.234, "n": None}]
    assert C.report(rows) == "| arm | v | n |\n| --- | --- | --- |\n| a_b | 1.23 | - |"
    assert C.report(rows, "latex") == r"a\_b & 1.23 & - \\" and json.loads(C.report(rows, "json")) == rows
    path = tmp_path / "r.md"
    C.write_whole(str(path), "one")
    C.write_whole(str(path), "two")
    assert path.read_text() == "two" and len(list(tmp_path.iterdir())) == 1


def test_rollouts_leave_out_the_file_that_is_being_written(spark, tmp_path):
    for step in (1, 2, 10):
        (tmp_path / f"{step}.jsonl").write_text(f'{{"v": {step}}}\n')
    read = lambda **kw: sorted((r.step, r.v) for r in scans.rollouts(spark, str(tmp_path), "v int", **kw).collect())
    assert read() == [(1, 1), (2, 2)] and read(last=10) == [(1, 1), (2, 2), (10, 10)]
    scans.append_rows(spark.createDataFrame([(1,)], "v int"), str(tmp_path / "log"))
    scans.append_rows(spark.createDataFrame([(2,)], "v int"), str(tmp_path / "log"))
    assert sorted(r.v for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]


def test_baselines_of_both_shapes(spark):
    text = spark.createDataFrame([("a", [("q",), ("r",)])], "id string, m array<struct<content:string>>")
    nested = spark.createDataFrame([("a", [(("q",),), (("r",),)])], "id string, m array<struct<content:struct<answer:string>>>")
    for rows in (text, nested):
        assert [tuple(r) for r in scans.suite_baselines(rows, "m").collect()] == [("a", "r")]


def test_large_logs_are_read_in_blocks(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(f'{{"id": {i}}}\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        good, _ = scans.read_log(spark, str(path), "id int")
        assert good.rdd.getNumPartitions() > 3
        assert [r.id for r in good.orderBy("file", "ln").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_call_limits(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    schema = "w string, i int, hit boolean"
    outcomes = [False, False, True, True, False, True]
    for part in (outcomes[:4], outcomes[4:]):
        base = 0 if part is not outcomes[4:] and len(part) == 4 else 4
        spark.createDataFrame([("a", base + i, h) for i, h in enumerate(part)], schema).coalesce(1).write.mode("append").json(str(src))
        limits = L.call_limits(spark.readStream.schema(schema).json(str(src)), "w", "i", "hit", first=8, most=9)
        limits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = [r.allowed for r in spark.read.parquet(str(tmp_path / "out")).orderBy("i").collect()]
    want, limit = [], 8
    for hit in outcomes:
        limit = max(1, limit // 2) if hit else min(9, limit + 1)
        want.append(limit)
    assert got == want
