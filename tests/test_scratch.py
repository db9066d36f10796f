import os

from tidewheel.plans import scratch


def files(spark):
    top = scratch.root(spark).removeprefix("file://") + "/tidewheel"
    return sorted(os.listdir(top)) if os.path.isdir(top) else []


def test_tables_come_back_and_go(spark):
    before = files(spark)
    own = scratch.materialize(spark.range(10).toDF("x"), "numbers")
    assert own.count() == 10 and own.dtypes == [("x", "bigint")] and len(files(spark)) == len(before) + 1
    assert "Range" not in own._jdf.queryExecution().optimizedPlan().toString()
    scratch.release(own, spark.range(1))  # what was never written is left alone
    assert files(spark) == before


def test_the_session_names_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "KEY", "tidewheel.folder")  # the real setting cannot change in a running session
    spark.conf.set(scratch.KEY, f"file://{tmp_path}")
    try:
        assert scratch.root(spark) == f"file://{tmp_path}"
        assert scratch.materialize(spark.range(3).toDF("x")).count() == 3
        assert os.listdir(tmp_path / "tidewheel")
        scratch.purge(spark)
        assert not (tmp_path / "tidewheel").exists()
    finally:
        spark.conf.unset(scratch.KEY)
