"""Commits of runs over several logs."""

import pytest
from pyspark.sql import functions as F

from tickerloom.session import run_folder
from tickerloom.sources import run_logs


def tables(spark, rows):
    df = spark.createDataFrame(rows, "run_id string, value long").withColumn("as_of", F.lit("2024-02-01 10:00:00").cast("timestamp"))
    return {"iv_snapshots": df, "prediction_snapshots": df.withColumn("value", F.col("value") * 10)}


def seen(spark, base, name="iv_snapshots"):
    return sorted((r.run_id, r.value) for r in run_logs.read_runs(spark, base, name).collect())


def test_a_run_is_seen_whole_or_not_at_all(spark, monkeypatch):
    base = run_folder(spark, "t")
    write, names = run_logs.stage, []

    def dies(given, *rest):
        first = dict(list(given.items())[:1])
        names.extend(first)
        write(first, *rest)
        raise RuntimeError("lost between two logs")

    monkeypatch.setattr(run_logs, "stage", dies)
    with pytest.raises(RuntimeError):
        run_logs.commit_runs(tables(spark, [("a", 1)]), base)
    monkeypatch.setattr(run_logs, "stage", write)
    assert names == ["iv_snapshots"] and seen(spark, base) == []
    run_logs.commit_runs(tables(spark, [("a", 2)]), base)
    assert seen(spark, base) == [("a", 2)] and seen(spark, base, "prediction_snapshots") == [("a", 20)]


def test_a_run_counts_once(spark):
    base = run_folder(spark, "t")
    run_logs.commit_runs(tables(spark, [("a", 1), ("a", 1), ("007", 5)]), base)
    run_logs.commit_runs(tables(spark, [("a", 9), ("b", 3)]), base)
    assert seen(spark, base) == [("007", 5), ("a", 1), ("a", 1), ("b", 3)]
    # two writers that did not see each other: the first manifest counts
    run_logs.stage(tables(spark, [("b", 77)]), base, "late")
    late = spark.createDataFrame([("b", None, "late", None, None)], run_logs.MANIFEST_SCHEMA).withColumn("committed_at", F.lit("2999-01-01").cast("timestamp"))
    late.write.mode("append").parquet(f"{base}/{run_logs.MANIFESTS}")
    assert seen(spark, base)[-1] == ("b", 3)
    staged = {r.run_id: r.staged for r in run_logs.committed_runs(spark, base).collect()}
    assert staged["a"] == {"iv_snapshots": 2, "prediction_snapshots": 2}


def test_unknown_logs_and_empty_runs(spark):
    base = run_folder(spark, "t")
    with pytest.raises(ValueError):
        run_logs.commit_runs({"other": tables(spark, [("a", 1)])["iv_snapshots"]}, base)
    run_logs.commit_runs(tables(spark, [("a", 1)]), base)
    empty = {k: v.where("false") for k, v in tables(spark, [("b", 1)]).items()}
    run_logs.commit_runs(empty, base)
    assert seen(spark, base) == [("a", 1)]
