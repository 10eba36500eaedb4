import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.loader import Loader
from shardloom.plans import samplers as s
from shardloom.sources.collection import Collection, write_sharded


def source(spark, n, tag, label="a"):
    rows = [(f"cell_{i}-{tag}", i, label if i % 2 else "b", [i % 7, 7], [float(i), 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "obs_name string, numeric bigint, label string, x_indices array<int>, x_values array<float>")


@pytest.fixture()
def collection(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    assert c.is_empty and c.obs().count() == 0
    with pytest.raises(ValueError):
        c.read()
    return c.add([source(spark, 60, 0), source(spark, 43, 1)], dataset_size=40, block=5)


def test_create_append_and_versions(spark, collection):
    c = collection
    assert not c.is_empty and c.n_obs == 103 and len(c.sizes) == 3 and max(c.sizes.values()) == 40
    d = c.read().toPandas()
    assert d.obs_name.nunique() == 103 and set(d.src_path) == {"source_0", "source_1"}
    for _, g in d.groupby("dataset"):
        assert sorted(g.row) == list(range(len(g)))
    moved = d.sort_values(["dataset", "row"]).obs_idx.to_numpy() != np.arange(103)
    assert moved.mean() > 0.9
    assert c.obs(["label", "nothing", "obs_name"]).columns == ["dataset", "row", "label", "obs_name"] and c.obs([]).count() == 0
    assert sum(x.count() for x in c) == 103
    old = c.read()
    with pytest.warns(UserWarning):
        c.add([source(spark, 40, 2).drop("label"), source(spark, 3, 0)], block=5, groupby="numeric")
    assert c.n_obs == 146 and len(c.sizes) == 3 and c.manifest["version"] == 2 and old.count() == 103
    d = c.read().toPandas()
    assert d.obs_name.nunique() == 146  # the names of the last source were taken
    for _, g in d.groupby("dataset"):
        assert g.sort_values("row").numeric.is_monotonic_increasing
    with pytest.raises(ValueError):
        c.add([source(spark, 8, 3)], block=5)  # two blocks for three datasets
    c.vacuum()
    assert not [n for n in c.files.names() if n.startswith("v1-") or n == "manifest-1.json"] and c.read().count() == 146


def test_fetch_ranges(spark, collection):
    want = [*range(3, 7), *range(38, 50), *range(100, 103)]
    for most in (64, 1):
        got = collection.fetch([slice(38, 45), slice(3, 7), slice(44, 50), slice(100, None), slice(5, 5)], most)
        assert sorted(r.obs_idx for r in got.select("obs_idx").collect()) == want
    assert collection.fetch([]).count() == 0
    with pytest.raises(ValueError):
        collection.fetch([slice(0, 999)])
    plan = collection.fetch([slice(38, 45)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan or "PartitionFilters: [(" in plan or "dataset" in plan.split("PartitionFilters")[1][:80]


def test_unshuffled_grouped_create(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c").add([source(spark, 30, 0)], dataset_size="1GB", block=10, shuffle=False, groupby="label", categories={"label": ["b", "a"]}, order=["numeric"], var_subset=[7])
    d = c.read().toPandas().sort_values("row")
    assert d.label.tolist() == ["b"] * 15 + ["a"] * 15 and d.numeric.tolist() == [*range(0, 30, 2), *range(1, 30, 2)]
    assert all(list(i) == [7] for i in d.x_indices) and len(c.sizes) == 1
    with pytest.raises(ValueError):
        Collection(spark, f"file://{tmp_path}/d").add([source(spark, 5, 0)], groupby="none")
    with pytest.raises(ValueError):
        Collection(spark, f"file://{tmp_path}/d").add([source(spark, 5, 0).limit(0)])
    with pytest.raises(TypeError):
        Collection(spark, 5)


def test_sources_by_extension(spark, tmp_path):
    df = source(spark, 6, 0).select("obs_name", "numeric")
    df.write.orc(f"{tmp_path}/a.orc"), df.write.json(f"{tmp_path}/b.json"), df.write.option("header", True).csv(f"{tmp_path}/c.csv"), df.write.parquet(f"{tmp_path}/d.parquet")
    c = Collection(spark, f"file://{tmp_path}/k").add([f"{tmp_path}/a.orc", f"{tmp_path}/d.parquet"], block=2)
    assert c.n_obs == 12
    from shardloom.sources.collection import read_source

    assert read_source(spark, f"{tmp_path}/b.json").count() == read_source(spark, f"{tmp_path}/c.csv").count() == 6


def test_sharded_write(spark, tmp_path):
    df = source(spark, 100, 0)
    assert write_sharded(df.coalesce(1), f"{tmp_path}/w", rows_per_page=10, shard_size=25) == (10, 20)
    assert spark.read.parquet(f"{tmp_path}/w").count() == 100 and len(spark.read.parquet(f"{tmp_path}/w").inputFiles()) == 5
    assert write_sharded(df, f"{tmp_path}/v", shard_size="1KB")[0] == 64
    with pytest.raises(ValueError):
        write_sharded(df.limit(0), f"{tmp_path}/u")


def test_loader_over_a_collection(spark, collection):
    x = Loader(chunk_size=8, preload_nchunks=4, batch_size=16, shuffle=True, return_index=True, to="dense").use_collection(collection)
    batches = list(x)
    assert len(batches) == len(x) == 7 and [len(b["index"]) for b in batches] == [16] * 6 + [7]
    index = np.concatenate([b["index"] for b in batches])
    assert sorted(index) == list(range(103))
    rows = {r.obs_idx: r for r in collection.indexed().collect()}
    for b in batches:
        for i, name, xrow in zip(b["index"], b["obs"]["obs_name"], b["X"]):
            assert rows[i].obs_name == name and xrow[rows[i].x_indices[0]] in (rows[i].numeric, rows[i].numeric + 1)
    with pytest.raises(RuntimeError):
        x.use_collection(collection)
    n = x.map_batches(lambda p: p.groupby("batch_id", as_index=False).agg(n=("obs_idx", "size")).astype("int64"), "batch_id bigint, n bigint").toPandas()
    assert n.n.sum() == 103


def test_loader_over_frames_in_request_order(spark):
    d = [spark.createDataFrame([(100 * k + i, [float(100 * k + i)]) for i in range(10)], "k bigint, x array<double>") for k in range(3)]

    class Fixed(s.Sampler):
        batch_size, shuffle = 4, False

        def n_batches(self, n_obs):
            return 3

        def validate(self, n_obs):
            if n_obs > 30:
                raise ValueError("too many")

        def _plan(self, spark, n_obs):
            return s.requests_plan(spark, [[slice(10, 14), slice(20, 24), slice(0, 3), 0]])

    x = Loader(Fixed()).add_datasets(d, "k")
    assert [b["X"].ravel().tolist() for b in x] == [[100, 101, 102, 103], [200, 201, 202, 203], [0, 1, 2, 0]]
    before = x.rows().count()
    with pytest.raises(ValueError):
        x.add_dataset(d[0].withColumn("k", F.col("k") + 1000), "k")  # the sampler refuses: nothing changes
    assert x.n_obs == 30 and x.rows().count() == before
    with pytest.raises(TypeError):
        x.add_dataset(source(spark, 3, 0).withColumn("k", F.col("numeric") + 5000), "k")


def test_loader_checks(spark):
    with pytest.raises(ValueError):
        Loader(s.SequentialSampler(1, 1, 1), batch_size=3)
    with pytest.raises(ValueError):
        Loader(batch_size=0)
    with pytest.raises(ValueError):
        list(Loader(batch_size=1))
    v = lambda *n: spark.createDataFrame(list(enumerate(n)), "var_idx int, var_name string")
    d = spark.createDataFrame([(1, [1.0, 2.0])], "k bigint, x array<double>")
    x = Loader(batch_size=1).add_datasets([d], "k", [v("a", "b")])
    assert x.n_var == 2 and x.n_obs == 1
    with pytest.raises(ValueError):
        x.add_dataset(d, "k", v("a", "c"))
    with pytest.raises(ValueError):
        x.add_dataset(d, "k")


def test_stream_append(spark, tmp_path):
    from shardloom.streaming.ingest import append_stream

    source(spark, 30, 0).write.parquet(f"{tmp_path}/in")
    c = Collection(spark, f"file://{tmp_path}/c")
    stream = spark.readStream.schema(source(spark, 1, 0).schema).parquet(f"{tmp_path}/in")
    append_stream(stream, c, f"{tmp_path}/ck", dataset_size=10, block=5).awaitTermination()
    assert c.n_obs == 30
    source(spark, 20, 1).write.mode("append").parquet(f"{tmp_path}/in")
    append_stream(stream, c, f"{tmp_path}/ck", block=5).awaitTermination()
    assert c.n_obs == 50 and len(c.sizes) == 3


def features(spark, names, **attrs):
    rows = [(i, n, *[v[i] for v in attrs.values()]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, ", ".join(["var_idx int", "var_name string", *[f"`{a}` string" for a in attrs]]))


def matrix(spark, tag, rows):
    return spark.createDataFrame([(f"{tag}{k}", i, v, i, v, [k, k, k], [0, 9], [1.0, 2.0]) for k, (i, v) in enumerate(rows)], "obs_name string, x_indices array<int>, x_values array<double>, layer_indices array<int>, layer_values array<double>, side array<int>, raw_indices array<int>, raw_values array<double>")


def by_name(c, element="x", var="var"):
    names = {r.var_idx: r.var_name for r in getattr(c, var).collect()}
    return {r.obs_name: {names[i]: v for i, v in zip(r[f"{element}_indices"], r[f"{element}_values"])} for r in c.read().collect()}


def test_features_are_aligned_on_create_and_append(spark, tmp_path):
    va, vb = features(spark, ["a", "b", "c"], kind=["p", "q", "r"], only=["1", "2", "3"]), features(spark, ["c", "d"], kind=["r", "s"])
    ra = features(spark, [f"g{i}" for i in range(10)])
    rb = features(spark, [f"g{9 - i}" for i in range(10)])
    a, b = matrix(spark, "a", [([2, 0], [3.0, 1.0]), ([], [])]), matrix(spark, "b", [([0, 1], [5.0, 6.0])])
    c = Collection(spark, f"file://{tmp_path}/c").add([a, b], vars_=[va, vb], raw_vars=[ra, rb], merge="unique", block=1)
    assert [(r.var_idx, r.var_name) for r in c.var.orderBy("var_idx").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    want = {"a0": {"a": 1.0, "c": 3.0}, "a1": {}, "b0": {"c": 5.0, "d": 6.0}}
    assert by_name(c) == by_name(c, "layer") == want
    assert by_name(c, "raw", "raw_var") == {"a0": {"g0": 1.0, "g9": 2.0}, "a1": {"g0": 1.0, "g9": 2.0}, "b0": {"g9": 1.0, "g0": 2.0}}
    assert {r.obs_name: list(r.side) for r in c.read().collect()}["a1"] == [1, 1, 1]
    more = matrix(spark, "m", [([0, 1], [7.0, 8.0])])
    c.add([more], vars_=[features(spark, ["new", "b"])], raw_vars=[ra], block=1, spread=False)
    assert by_name(c) == want | {"m0": {"b": 8.0}} and c.var.count() == 4
    with pytest.raises(ValueError):
        c.add([more], block=1)  # features for all or none
    with pytest.raises(ValueError):
        c.add([more], vars_=[features(spark, ["x", "x"])], raw_vars=[ra], block=1)
    x = Loader(batch_size=2, to="dense").use_collection(c)
    assert x.n_var == 4 and {b["X"].shape[1] for b in x} == {4}


def test_merge_modes_on_create(spark, tmp_path):
    va, vb = features(spark, ["a", "b"], same=["1", "2"], other=["x", "y"], first=["f", "g"]), features(spark, ["b", "a"], same=["2", "1"], other=["y", "z"])
    got = {}
    for m in (None, "same", "unique", "first", "only"):
        c = Collection(spark, f"file://{tmp_path}/{m}").add([matrix(spark, "a", [([0], [1.0])]), matrix(spark, "b", [([0], [1.0])])], vars_=[va, vb], merge=m, block=1)
        got[m] = {k: [r[k] for r in c.var.orderBy("var_idx").collect()] for k in c.var.columns[2:]}
    assert got == {None: {}, "same": {"same": ["1", "2"]}, "unique": {"same": ["1", "2"], "first": ["f", "g"]}, "first": {"same": ["1", "2"], "other": ["x", "y"], "first": ["f", "g"]}, "only": {"first": ["f", "g"]}}


def test_dense_rows_are_aligned_with_nan(spark, tmp_path):
    d = lambda tag, x: spark.createDataFrame([(tag, x)], "obs_name string, x array<float>")
    c = Collection(spark, f"file://{tmp_path}/c").add([d("a", [1.0, 2.0]), d("b", [3.0, 4.0])], vars_=[features(spark, ["p", "q"]), features(spark, ["q", "r"])], block=1)
    got = {r.obs_name: r.x for r in c.read().collect()}
    assert got["a"][:2] == [1.0, 2.0] and np.isnan(got["a"][2]) and np.isnan(got["b"][0]) and got["b"][1:] == [3.0, 4.0]


def test_rows_of_more_dimensions_keep_their_shape(spark, tmp_path):
    d = spark.createDataFrame([(f"i{k}", [[[float(k), 1.0, 2.0], [3.0, 4.0, 5.0]]] * 4) for k in range(6)], "obs_name string, x array<array<array<float>>>")
    c = Collection(spark, f"file://{tmp_path}/c").add([d], block=2)
    b = list(Loader(batch_size=4, chunk_size=2, preload_nchunks=2).use_collection(c))
    assert [x["X"].shape for x in b] == [(4, 4, 2, 3), (2, 4, 2, 3)] and b[0]["X"].dtype == np.float32


def test_commits_are_exclusive_and_failures_leave_the_old_version(spark, collection, monkeypatch):
    before = collection.manifest
    one = Collection(spark, collection.root)
    raced = one.files.commit

    def late(rel, text):
        Collection(spark, collection.root).add([source(spark, 20, 7)], block=5)  # another writer is faster
        raced(rel, text)

    monkeypatch.setattr(one.files, "commit", late)
    with pytest.raises(FileExistsError):
        one.add([source(spark, 20, 8)], block=5)
    assert collection.n_obs == 123 and collection.manifest["version"] == before["version"] + 1

    def dies(rel, text):
        raise OSError("no more disk")

    monkeypatch.setattr(one.files, "commit", dies)
    with pytest.raises(OSError):
        one.add([source(spark, 20, 8)], block=5)
    assert collection.n_obs == 123
    again = Collection(spark, collection.root).add([source(spark, 20, 8)], block=5)  # nothing is in the way
    assert again.n_obs == 143
    again.vacuum()
    assert sorted(n for n in again.files.names() if not n.startswith(".")) == sorted([again.manifest["folders"][0], f"manifest-{again.manifest['version']}.json"])
    empty = Collection(spark, collection.root + "-none")
    empty.vacuum()


def test_streams_do_not_meet_and_batches_come_once(spark, tmp_path):
    from shardloom.streaming.ingest import append_stream

    source(spark, 10, 0).write.parquet(f"{tmp_path}/a"), source(spark, 10, 1).write.parquet(f"{tmp_path}/b")
    c = Collection(spark, f"file://{tmp_path}/c")
    for k in "ab":
        stream = spark.readStream.schema(source(spark, 1, 0).schema).parquet(f"{tmp_path}/{k}")
        append_stream(stream, c, f"{tmp_path}/ck-{k}", block=5).awaitTermination()
    assert c.n_obs == 20
    c.add([source(spark, 10, 2)], block=5, token=("s", 4))
    c.add([source(spark, 10, 2)], block=5, token=("s", 4))  # run again after a failure
    assert c.n_obs == 30 and c.manifest["tokens"]["s"] == 4


def test_categories_agree_or_are_united(spark, tmp_path):
    two = [source(spark, 10, 0), source(spark, 10, 1)]
    with pytest.raises(ValueError, match="differ"):
        Collection(spark, f"file://{tmp_path}/a").add(two, groupby="label", categories=[{"label": ["a", "b"]}, {"label": ["b", "a"]}], block=5)
    with pytest.raises(ValueError, match="some sources only"):
        Collection(spark, f"file://{tmp_path}/a").add(two, groupby="label", categories=[{"label": ["a", "b"]}, {}], block=5)
    c = Collection(spark, f"file://{tmp_path}/b").add(two, categories=[{"label": ["b"]}, {"label": ["a", "b"]}], block=5)
    assert c.manifest["categories"] == {"label": ["b", "a"]}
    with pytest.raises(ValueError, match="differ"):
        c.add(two[:1], groupby="label", categories={"label": ["a", "b"]}, block=5)


def test_windows_deliver_what_the_plan_says(spark, collection, monkeypatch):
    import shardloom.loader as module

    monkeypatch.setattr(module, "WINDOW_ROWS", 40)
    x = Loader(chunk_size=4, preload_nchunks=4, batch_size=8, shuffle=True, drop_last=True, return_index=True).use_collection(collection)
    plan = x.rows().select("batch_id", "pos_in_batch", "obs_idx").toPandas().sort_values(["batch_id", "pos_in_batch"])
    assert [b["index"].tolist() for b in x] == [g.obs_idx.tolist() for _, g in plan.groupby("batch_id")] and len(x) == 12
    d = s.DistributedSampler(s.RandomSampler(4, 4, 8, seed=3), dist_info=lambda: (1, 2))
    y = Loader(d, return_index=True).use_collection(collection)
    got = np.concatenate([b["index"] for b in y])
    assert sorted(got) == list(range(48, 96)) and len(list(y)) == 6
