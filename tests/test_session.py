import __spark_entry__ as entry

from shardloom.session import materialize, shared_dir


def test_materialize_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, [1.5]), (2, "x", None)], "a bigint, b string, c array<double>")
    m = materialize(df)
    assert m.schema == df.schema and sorted(map(str, m.collect())) == sorted(map(str, df.collect()))
    assert shared_dir(spark) == shared_dir(spark)
    assert materialize(df.limit(0)).count() == 0


def test_entry(spark):
    e = entry.entry(spark)
    assert e.columns == ["batch_id", "n", "min_event_id", "max_event_id"] and e.count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scratch_and_discard_delete_what_was_written(spark):
    import os

    from shardloom.session import discard, materialize, scratch

    at = lambda df: df._shardloom_path.removeprefix("file://")
    with scratch():
        a, b = materialize(spark.range(5)), materialize(spark.range(6))
        assert b.count() == 6 and os.path.isdir(at(a))
        discard(a)
        assert not os.path.exists(at(a)) and os.path.isdir(at(b))
    assert not os.path.exists(at(b))
