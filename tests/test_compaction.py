import pytest
from pyspark.sql import functions as F

from shardloom.operators import compaction as c

SCHEMA = "file_id bigint, dataset int, path string, n_obs int, obs_names array<string>, indptr array<int>, indices array<int>, data array<float>, extra string"


def files(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, 0, "p", 2, ["a", "b"], [10, 12, 13], [5, 3, 7], [1.0, 2.0, 0.0], "x"),
    (2, 0, "p", None, ["a", "b", "a"], [0, 3, 4, 6], [3, 5, 9, 1, 5, 3], [2.0, 1.0, 0.0, 4.0, 1.0, 2.0], "x"),  # a twice as a copy; other b
    (3, 1, "p", 9, ["z", None], [0, 2, 3], [3, 5, 1], [2.0, 1.0, 1.0], None),  # same content, other name
    (4, 1, "p", 9, [None, "b"], [0, 1, 1], [1], [1.0], None),  # a null name is a name of its own; b with nothing
    (5, 1, "p", 0, [], [0], [], [], None),
    (6, 1, "p", None, None, None, None, None, None),
]


def test_copies(spark):
    m = c.mark_copies(c.explode_files(files(spark, ROWS))).toPandas()
    assert len(m) == 9
    assert {(r.file_id, r.row_no) for r in m[m.is_copy].itertuples()} == {(2, 0), (2, 2), (4, 0), (4, 1)}
    one = m[(m.file_id == 1) & (m.row_no == 0)].iloc[0]
    assert list(one["indices"]) == [3, 5] and list(one["values"]) == [2.0, 1.0]
    assert len(m[(m.file_id == 1) & (m.row_no == 1)].iloc[0]["indices"]) == 0


def test_a_hot_content(spark):
    rows = [(i, 0, "p", 1, ["a"], [0, 1], [1], [1.0], None) for i in range(400)] + [(1000 + i, 0, "p", 1, [f"n{i}"], [0, 1], [1], [1.0], None) for i in range(50)]
    m = c.mark_copies(c.explode_files(files(spark, rows).repartition(7)))
    assert m.count() == 450 and m.where("is_copy").count() == 399 and m.where("NOT is_copy AND obs_name = 'a'").first().file_id == 0


def test_compact_writes_all_once(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    info = c.compact(spark, files(spark, ROWS + ROWS[:1]).repartition(5), out, 1 << 20)  # a file row delivered twice
    assert info["rows"] == 5 and info["copies"] == 4 and info["files"] >= 1
    back = spark.read.parquet(out)
    assert back.count() == 5 and list(c.checksum(back, back.columns)) == [5, *[int(x) for x in info["checksum"]]]
    with pytest.raises(FileExistsError):
        c.compact(spark, files(spark, ROWS), out)
    assert back.count() == 5


def test_empty_table_and_checksum(spark, tmp_path):
    assert c.mark_copies(c.explode_files(files(spark, []))).count() == 0
    assert c.compact(spark, files(spark, []), f"file://{tmp_path}/e")["rows"] == 0
    a = spark.range(50).withColumn("v", F.col("id") % 3)
    assert c.checksum(a, ["id", "v"]) == c.checksum(a.repartition(9), ["id", "v"]) != c.checksum(a.unionAll(a.limit(1)), ["id", "v"])


def test_one_file_id_with_other_records_and_other_columns(spark, tmp_path):
    again = [(1, 0, "elsewhere", 2, *ROWS[0][4:8], "y"), (1, 0, "p", 1, ["q"], [0, 1], [4], [1.0], None)]
    out = f"file://{tmp_path}/out"
    info = c.compact(spark, files(spark, ROWS + again), out)
    assert info["rows"] == 6 and {(r.file_id, r.row_no) for r in c.left_out(spark, out).collect()} == {(2, 0), (2, 2), (4, 0), (4, 1)}


def test_a_failure_leaves_nothing_and_no_settings(spark, tmp_path, monkeypatch):
    before = dict(spark.conf.getAll)
    sums = iter([(1, 1, 1), (2, 2, 2)])
    monkeypatch.setattr(c, "checksum", lambda *_: next(sums))
    with pytest.raises(RuntimeError):
        c.compact(spark, files(spark, ROWS), f"file://{tmp_path}/out")
    assert not list(tmp_path.iterdir()) and dict(spark.conf.getAll) == before
