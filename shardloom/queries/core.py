"""Queries of the core operators, each with equivalent SQL where SQL can express it.

of vec_id; BK = sparse baskets, obs = l_orderkey, feature = l_partkey, value = summed
quantity; SRC = EV split into three "files" by user_id % 3, in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import geometry as g
from shardloom.operators import census, compaction, index, matrix, schema_drift, shuffling
from shardloom.plans import samplers as s
from shardloom.queries import stored
from shardloom.session import scratch_path

SEED = 7
WEIGHTS = {"c0": 3, "c1": 1, "c2": 0, "c3": 2, "c4": 1}  # by the class's place in alphabetical order


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ev(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return index.dense_index(_t(spark, d, "events").select("event_id", *cols), "event_id")


def _n(spark: SparkSession, d: str, name: str) -> int:
    return _t(spark, d, name).count()  # from the files' footers


def _big(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT, as the comparison wants them."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


# -- sequential and random epochs ------------------------------------------------


def _batches(df: DataFrame) -> DataFrame:
    return _big(df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("obs_idx").alias("min_idx"), F.max("obs_idx").alias("max_idx"), F.sum("event_id").alias("sum_event_id")))


def seq_batches(spark, d):
    return _batches(s.SequentialSampler(100, 4, 80).annotate(_ev(spark, d), _n(spark, d, "events")))


def seq_batches_drop_last(spark, d):
    return _batches(s.SequentialSampler(100, 12, 48, drop_last=True).annotate(_ev(spark, d), _n(spark, d, "events")))


MASK = (123, 567)  # thousandths of the rows


def mask_window(spark, d):
    n = _n(spark, d, "events")
    m = slice(n * MASK[0] // 1000, n * MASK[1] // 1000)
    return _batches(s.SequentialSampler(100, 4, 50, mask=m).annotate(_ev(spark, d), n)).drop("sum_event_id")


def _epoch(spark, d, **kw):
    n = _n(spark, d, "events")
    return _big(s.RandomSampler(64, 8, 128, seed=SEED, **kw).annotate(_ev(spark, d), n).select("event_id", "request_id", "batch_id", "pos_in_batch"))


def random_chunks_epoch(spark, d):
    return _epoch(spark, d)


def random_drop_last(spark, d):
    return _epoch(spark, d, drop_last=True)


def random_num_samples(spark, d):
    return _epoch(spark, d, num_samples=_n(spark, d, "events") * 37 // 100)


def random_masked(spark, d):
    n = _n(spark, d, "events")
    return _epoch(spark, d, mask=slice(n // 10, n * 9 // 10))


def flagship(spark, d):
    e = random_chunks_epoch(spark, d)
    return e.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("min_event_id"), F.max("event_id").alias("max_event_id"))


def pivot_chunk_sizes(spark, d):
    return _big(s.RandomSampler(64, 8, 128, seed=SEED).chunks(spark, _n(spark, d, "events")))


def _replacement(spark, d):
    n = _n(spark, d, "events")
    return s.RandomSampler(50, 4, 40, replacement=True, num_samples=n * 103 // 1000 + 13, seed=SEED), n


def replacement_plan(spark, d):
    r, n = _replacement(spark, d)
    return _big(r.slices(spark, n))


def replacement_gather(spark, d):
    r, n = _replacement(spark, d)
    return _big(matrix.gather(index.expand(r.slices(spark, n)), _ev(spark, d)).select("slice_ord", "offset", "event_id"))


# -- preshuffling ----------------------------------------------------------------

BLOCK, SIZE = 100, 255  # rows, thousandths of all rows a dataset


def _datasets(spark, d, *cols):
    n = _n(spark, d, "events")
    return shuffling.assign_blocks(_ev(spark, d, *cols), n, BLOCK, seed=SEED, dataset_size=max(BLOCK, n * SIZE // 1000))


def block_shuffle_assignment(spark, d):
    return _big(shuffling.place_rows(_datasets(spark, d), seed=SEED).select("event_id", "dataset", "row"))


def collection_sizes(spark, d):
    return _big(_datasets(spark, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")))


def groupby_sorted_rows(spark, d):
    return _big(shuffling.place_rows(_datasets(spark, d, "event_type"), groupby=["event_type"], seed=SEED).select("dataset", "row", "event_id"))


def groupby_multi_key(spark, d):
    return _big(shuffling.place_rows(_datasets(spark, d, "event_type", "user_id"), groupby=["event_type", "user_id"], seed=SEED).select("dataset", "row", "event_id"))


def category_order_sort(spark, d):
    """Category order as declared (not alphabetical), unknown values last."""
    df = shuffling.with_codes(_datasets(spark, d, "event_type"), "event_type", CATS)
    return _big(shuffling.place_rows(df, groupby=["event_type_code"], seed=SEED).select("dataset", "row", "event_id"))


CATS = ["view", "click", "purchase", "search"]


def append_deal(spark, d):
    new = _t(spark, d, "events").where("event_id % 5 = 0").select("event_id")
    n = new.count()
    e = index.dense_index(new, "event_id")
    return _big(shuffling.assign_blocks(e, n, 37, seed=SEED, n_datasets=4).select("event_id", "dataset"))


# -- concatenation and features --------------------------------------------------


def _sources(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    drop = ["value", "event_type", "user_id"]  # a column missing in each source
    return [e.where(F.col("user_id") % 3 == i).drop(drop[i]) for i in range(3)]


def concat_outer_obs(spark, d):
    c = matrix.concat_rows(_sources(spark, d))
    return c.select("event_id", F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.coalesce("event_type", F.lit("(none)")).alias("event_type"), F.coalesce("value", F.lit(-1.0)).alias("value"))


def src_provenance(spark, d):
    return matrix.concat_rows(_sources(spark, d), ["a", "b", "c"]).groupBy("src_path").agg(F.count(F.lit(1)).alias("n"))


def obs_projection(spark, d):
    e = _t(spark, d, "events")
    return e.select(*[c for c in ["value", "no_such_column", "event_id"] if c in e.columns])


def key_presence_census(spark, d):
    return census.key_census(dict(zip("abc", _sources(spark, d))))


def _bk(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("obs"), F.col("l_partkey").alias("feature")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))


def _axes(spark, d):
    f = _t(spark, d, "lineitem").select(F.expr("l_orderkey % 3").alias("src"), "l_partkey").distinct()
    return [f.where(F.col("src") == i).select(F.col("l_partkey").alias("var_idx"), F.col("l_partkey").cast("string").alias("var_name")) for i in range(3)]


def concat_outer_features(spark, d):
    return matrix.feature_axis(_axes(spark, d)).select(F.col("name").alias("feature"), "new_idx", "n_sources")


def var_subset(spark, d):
    keep = _t(spark, d, "part").where("p_partkey <= 500").select(F.col("p_partkey").alias("feature"))
    return matrix.subset_features(_bk(spark, d), keep).select("obs", "feature", "value")


def append_feature_subset(spark, d):
    b = _bk(spark, d)
    target = b.where("obs % 5 <> 0 AND feature % 7 <> 0").select("feature")
    return matrix.subset_features(b.where("obs % 5 = 0"), target).select("obs", "feature", "value")


def feature_remap(spark, d):
    """Cells' X on an axis without the features whose partial_share is unknown."""
    f = _t(spark, d, "features").where("partial_share IS NOT NULL")
    axis = matrix.feature_axis([f.select("var_idx", F.concat_ws("#", "var_name", F.col("var_idx").cast("string")).alias("var_name"))])
    m = axis.select(F.substring_index("name", "#", -1).cast("int").alias("old_idx"), "new_idx")
    rows = matrix.remap_rows(_t(spark, d, "cells").select("rec_id", "x_indices", "x_values").where("x_indices IS NOT NULL").dropDuplicates(["rec_id"]), m)
    long = matrix.to_long(rows, "rec_id").where("value <> 0")
    return long.groupBy(F.col("feature").cast("bigint").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


def _attrs(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand")
    a = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("feature"), F.lit(0).alias("src"), F.col("p_brand").alias("value"))
    b = p.where("p_partkey % 4 <> 1").select(F.col("p_partkey").alias("feature"), F.lit(1).alias("src"), F.when(F.col("p_partkey") % 10 == 0, "other").otherwise(F.col("p_brand")).alias("value"))
    c = p.where("p_partkey % 4 NOT IN (2, 1)").select(F.col("p_partkey").alias("feature"), F.lit(2).alias("src"), F.col("p_brand").alias("value"))
    return a.unionAll(b).unionAll(c)


def _merge(mode):
    return lambda spark, d: matrix.merge_by_feature(_attrs(spark, d), mode, 3)


def obs_names_unique(spark, d):
    e = _ev(spark, d, "user_id").select("obs_idx", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("obs_name"))
    return shuffling.unique_names(e).select("obs_idx", F.col("obs_name").alias("name"))


# -- classes ---------------------------------------------------------------------


def _classes(spark, d):
    """Events sorted by type inside 4 datasets of consecutive event_ids: (obs_idx, class)."""
    n = _n(spark, d, "events")
    q = -(-n // 4)
    e = _ev(spark, d, "event_type").withColumn("dataset", F.expr(f"obs_idx div {q}"))
    e = shuffling.place_rows(e, shuffle=False, groupby=["event_type"]).withColumn("obs_idx", F.col("dataset") * q + F.col("row"))
    return e.select("obs_idx", F.col("event_type").alias("class")), n


def _weights(spark, d):
    names = [r[0] for r in _t(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]  # the categories
    return {c: WEIGHTS.get(f"c{i}", 1) for i, c in enumerate(names)}


def _class_sampler(spark, d, cs=9, bs=6, pn=4, ns=None, **kw):
    c, n = _classes(spark, d)
    return s.ClassSampler(cs, pn, bs, classes=c, num_samples=ns or n * 545 // 1000, class_weights=_weights(spark, d), seed=SEED, **kw), n


def class_runs(spark, d):
    c, n = _classes(spark, d)
    return _big(s.ClassSampler(1, 1, 1, classes=c, num_samples=1).class_runs(n))


def class_run_violations(spark, d):
    c, n = _classes(spark, d)
    return _big(s.ClassSampler(n // 20 + 1, 1, 1, classes=c, num_samples=1, class_weights=_weights(spark, d)).violations(n))


def class_probabilities(spark, d):
    x, n = _class_sampler(spark, d)
    return _big(x.probabilities(n).select("class", "n_runs", F.round("prob", 12).alias("prob")))


def class_mask_renormalized(spark, d):
    n = _n(spark, d, "events")
    q = -(-n // 4)
    x, n = _class_sampler(spark, d, mask=slice(q // 8, q // 2))
    return x.probabilities(n).select("class", F.round("prob", 12).alias("prob"))


def class_plan(spark, d):
    x, n = _class_sampler(spark, d)
    return _big(x.slices(spark, n))


def class_batches_coherent(spark, d):
    x, n = _class_sampler(spark, d)
    p = matrix.gather(x._plan(spark, n).select("obs_idx", "batch_id"), x.classes)
    return _big(p.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class").alias("n_classes")))


def class_drop_last(spark, d):
    """Class draws whose last, short batch is left out."""
    x, n = _class_sampler(spark, d, drop_last=True)
    return _big(x._plan(spark, n).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("obs_idx").alias("min_idx"), F.max("obs_idx").alias("max_idx")))


# -- ranks, workers, requests ----------------------------------------------------


def _shards(equal):
    def q(spark, d):
        n = _n(spark, d, "events")
        return _big(s.shard_of(_ev(spark, d), n, 3, 128, equal).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("obs_idx").alias("min_idx"), F.max("obs_idx").alias("max_idx")))

    return q


def worker_split(spark, d):
    w = s.RandomSampler(64, 8, 128, seed=SEED, drop_last=True, num_workers=4).workers(spark, _n(spark, d, "events"))
    return _big(w.select("chunk", "worker"))


def _src_index(spark, d):
    """SRC as one collection: sources in order, obs_idx over all."""
    e = _t(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("int").alias("dataset"))
    sizes = {r["dataset"]: r["count"] for r in e.groupBy("dataset").count().collect()}  # three rows
    off = {k: a for k, (a, _) in index.offsets(sizes).items()}
    u = None
    for k in sorted(sizes):
        x = index.dense_index(e.where(F.col("dataset") == k), "event_id", "local_row").withColumn("obs_idx", F.col("local_row") + off[k])
        u = x if u is None else u.unionByName(x)
    return u, sizes


def _request(spark, d):
    """All rows, chunks of 50 listed from the last to the first of source 1, of 2, then of 0 (no involution)."""
    u, sizes = _src_index(spark, d)
    off = index.offsets(sizes)
    req = [[slice(off[k][0] + a, min(off[k][0] + a + 50, off[k][1])) for k in (1, 2, 0) if k in off for a in reversed(range(0, sizes[k], 50))]]
    return u, sizes, s.requests_plan(spark, req)


def range_to_dataset(spark, d):
    u, sizes, plan = _request(spark, d)
    return _big(index.locate(plan, "obs_idx", sizes).select(F.col("pos").alias("request_pos"), "dataset", "local_row"))


def request_order_gather(spark, d):
    u, _, plan = _request(spark, d)
    return _big(matrix.gather(plan, u).select(F.col("pos").alias("request_pos"), "dataset", "local_row", "event_id"))


# -- matrices --------------------------------------------------------------------


def sparse_basket_rows(spark, d):
    return _big(_bk(spark, d).groupBy("obs").agg(F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("sum_value")))


def _basket_request(spark, d):
    """All orders in the order of their keys, each third one twice."""
    o = _t(spark, d, "orders").select("o_orderkey")
    i = index.dense_index(o, "o_orderkey", "k")
    return i.withColumn("rep", F.explode(F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select((F.col("k") * 2 + F.col("rep")).alias("pos"), F.col("o_orderkey").alias("obs"), F.expr("k div 64").alias("batch"))


def sparse_row_gather(spark, d):
    return matrix.gather(_basket_request(spark, d), _bk(spark, d), "obs").select("pos", "feature", "value")


def sparse_indptr(spark, d):
    nnz = _bk(spark, d).groupBy("obs").agg(F.count(F.lit(1)).alias("nnz"))
    j = _basket_request(spark, d).join(nnz, "obs", "left").withColumn("nnz", F.coalesce("nnz", F.lit(0)))
    return matrix.indptr(j, "batch", "pos", F.col("nnz"))


def _em(spark, d):
    return index.dense_index(_t(spark, d, "embeddings"), "vec_id")


def dense_gather(spark, d):
    n = _n(spark, d, "embeddings")
    plan = s.RandomSampler(16, 4, 32, seed=SEED, num_samples=n // 4).plan(spark, n)
    j = matrix.gather(plan, _em(spark, d)).select(F.col("batch_id"), F.col("pos_in_batch"), "vec_id", F.posexplode("embedding").alias("dim", "value"))
    return _big(j.withColumn("value", F.round(F.col("value").cast("double"), 6)))


def dense_batch_stats(spark, d):
    n = _n(spark, d, "embeddings")
    j = s.RandomSampler(16, 4, 32, seed=SEED).annotate(_em(spark, d), n)
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")
    return _big(j.groupBy("batch_id", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(mean), 6).alias("mean")))


def dtype_promotion(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "value")
    parts = [e.where(F.col("user_id") % 3 == i).select("event_id", F.col("value").cast(t).alias("value")) for i, t in enumerate(["int", "float", "double"])]
    return matrix.union_promoted(parts, "value").withColumn("value", F.round("value", 4))


GEOMETRIES = [(10, 3, 10), (10, 5, 10), (1000, 64, 200), (50, 64, 200), (103, 10, 25), (1, 64, 1)]
SPARSE = [(10, 35, 3, 10), (1000, 12345, 64, 200), (5, 0, 64, 200), (7, 3, 2, 4), (500, 2500, 64, 300)]


def shard_geometry_dense(spark, d):
    return spark.createDataFrame([(n, p, z, *g.dense_geometry(n, p, z)) for n, p, z in GEOMETRIES], "n bigint, asked_page bigint, asked_shard bigint, page bigint, shard bigint")


def shard_geometry_sparse(spark, d):
    return spark.createDataFrame([(n, k, p, z, *g.sparse_geometry(n, k, p, z)) for n, k, p, z in SPARSE], "n bigint, nnz bigint, asked_page bigint, asked_shard bigint, page bigint, shard bigint")


def bytes_per_row(spark, d):
    b = _bk(spark, d).agg(F.countDistinct("obs").alias("n"), F.count(F.lit(1)).alias("nnz")).first()
    rows = [("basket", g.sparse_row_bytes(b["n"], b["nnz"])), ("embedding", float(g.dense_row_bytes((1, 64), "float"))), ("events", float(g.table_row_bytes(_t(spark, d, "events").schema, frozenset({"event_type"})))), ("orders", float(g.table_row_bytes(_t(spark, d, "orders").schema)))]
    return spark.createDataFrame([(k, round(v, 6)) for k, v in rows], "element string, bytes_per_row double")


def run_coalescing(spark, d):
    e = _ev(spark, d, "value")
    r = index.coalesce_runs(e.where("value > 50"), "obs_idx")
    return _big(r.select(F.col("start").alias("run_start"), (F.col("stop") - F.col("start")).alias("run_len")))


def auto_batches(spark, d):
    """Batches for a custom plan without any: requests of 300 consecutive rows."""
    p = _ev(spark, d).select(F.expr("obs_idx div 300").alias("request_id"), (F.col("obs_idx") % 300).alias("pos"), "obs_idx", "event_id")
    return _big(s.auto_batches(p, 128, True, SEED).select("event_id", "request_id", "batch_id", "pos_in_batch"))


# -- small files, drifting schemas -----------------------------------------------


def _compacted(spark: SparkSession, d: str) -> tuple[str, dict]:
    out = scratch_path(spark, "compacted")
    return out, compaction.compact(spark, _t(spark, d, "csr_files"), out)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """p3_found(file_id, row_no): record copies that the compaction left out."""
    return compaction.left_out(spark, _compacted(spark, d)[0])


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The records in the compacted files, with the size and sum of their X row."""
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    m = spark.read.parquet(_compacted(spark, d)[0])
    return m.select("file_id", "row_no", F.col("dataset").cast("bigint").alias("dataset"), "obs_name", F.size("values").cast("bigint").alias("nnz"), F.round(total, 3).alias("total"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Files before, records kept, copies left out."""
    info = _compacted(spark, d)[1]
    return spark.createDataFrame([(_t(spark, d, "csr_files").distinct().count(), info["rows"], info["copies"])], "files_before bigint, n_rows bigint, copies bigint")


def queries() -> dict:
    own = [
        seq_batches, seq_batches_drop_last, mask_window, random_chunks_epoch, random_drop_last, random_num_samples, random_masked, pivot_chunk_sizes,
        replacement_plan, replacement_gather, block_shuffle_assignment, collection_sizes, groupby_sorted_rows, groupby_multi_key, category_order_sort,
        append_deal, concat_outer_obs, src_provenance, obs_projection, key_presence_census, concat_outer_features, var_subset, append_feature_subset,
        feature_remap, obs_names_unique, class_runs, class_run_violations, class_probabilities, class_mask_renormalized, class_plan,
        class_batches_coherent, class_drop_last, worker_split, range_to_dataset, request_order_gather, sparse_basket_rows, sparse_row_gather, sparse_indptr,
        dense_gather, dense_batch_stats, dtype_promotion, shard_geometry_dense, shard_geometry_sparse, bytes_per_row, run_coalescing, auto_batches,
        p3_found, p3_kept, p3_report,
    ]
    t = _t
    return (
        {f.__name__: f for f in own}
        | {f"var_merge_{m}": _merge(m) for m in ("same", "unique", "first", "only")}
        | {"dist_shards_equal": _shards(True), "dist_shards_raw": _shards(False)}
        | {
            "p2_found": lambda sp, d: schema_drift.changes(t(sp, d, "raw_records")).distinct(),
            "p2_columns": lambda sp, d: schema_drift.settled_columns(t(sp, d, "raw_records")),
            "p2_table": lambda sp, d: schema_drift.settled_table(t(sp, d, "raw_records")),
        }
        | stored.queries()
    )


# -- the same in SQL -------------------------------------------------------------

_EV = "ev AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS obs_idx FROM events), cnt AS (SELECT count(*) AS n FROM events)"


def _h(tag: str, *keys: str) -> str:
    return f"md5('{SEED}:{tag}:' || " + " || ':' || ".join(f"({k})::VARCHAR" for k in keys) + ")"


def _u(tag: str, key: str) -> str:
    return f"('0x' || substr({_h(tag, key)}, 1, 8))::BIGINT"


def _draw(n: str, tag: str, key: str) -> str:
    return f"(({_u(tag, key)} * ({n})::BIGINT) // 4294967296)"


def _seq(cs: int, pn: int, bs: int, a: str = "0", z: str = "(SELECT n FROM cnt)", drop: bool = False, total: bool = True) -> str:
    cut = f"AND i < ({z} - {a}) - (({z} - {a}) % {bs})" if drop else ""
    more = ", sum(event_id)::BIGINT AS sum_event_id" if total else ""
    return f"WITH {_EV}, q AS (SELECT event_id, obs_idx, obs_idx - {a} AS i FROM ev WHERE obs_idx >= {a} AND obs_idx < {z}) SELECT (i // {bs})::BIGINT AS batch_id, count(*)::BIGINT AS n, min(obs_idx)::BIGINT AS min_idx, max(obs_idx)::BIGINT AS max_idx{more} FROM q WHERE true {cut} GROUP BY 1"


def _chunk_ctes(table: str, key: str, cs: int, a: str = "0", z: str = "(SELECT n FROM cnt)") -> str:
    """ev, cnt, rng, ch (chunk, start, stop, visit_rank): an epoch's chunks."""
    return (
        f"ev AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS obs_idx FROM {table}), cnt AS (SELECT count(*) AS n FROM {table}),"
        f" rng AS (SELECT {a} AS a, {z} AS z), nc AS (SELECT a, z, z - a AS total, (z - a + {cs - 1}) // {cs} AS n, CASE WHEN (z - a) % {cs} = 0 THEN {cs} ELSE (z - a) % {cs} END AS r FROM rng),"
        f" ids AS (SELECT unnest(range(n)) AS chunk FROM nc), rk AS (SELECT chunk, row_number() OVER (ORDER BY {_h('chunk', 'chunk')}, chunk) - 1 AS visit_rank FROM ids),"
        " pv AS (SELECT chunk AS p FROM rk, nc WHERE visit_rank = n - 1),"
        f" ch AS (SELECT chunk, CASE WHEN chunk <= p THEN a + chunk * {cs} ELSE a + (chunk - 1) * {cs} + r END AS start,"
        f" CASE WHEN chunk < p THEN a + chunk * {cs} + {cs} WHEN chunk = p THEN a + chunk * {cs} + r ELSE a + chunk * {cs} + r END AS stop, visit_rank FROM rk, pv, nc)"
    )


def _epoch_ctes(table: str, key: str, cs: int, pn: int, bs: int, a: str = "0", z: str = "(SELECT n FROM cnt)", drop: bool = False) -> str:
    m = cs * pn
    cut = f"WHERE request_id * {m} + pos < (SELECT total - total % {bs} FROM nc)" if drop else ""
    return (
        _chunk_ctes(table, key, cs, a, z)
        + f", pl AS (SELECT unnest(range(start, stop)) AS obs_idx, start, visit_rank FROM ch), po AS (SELECT obs_idx, visit_rank // {pn} AS request_id, (visit_rank % {pn}) * {cs} + obs_idx - start AS pos FROM pl),"
        f" pr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_h('row', 'obs_idx')}, obs_idx) - 1 AS r FROM po {cut}),"
        f" plan AS (SELECT obs_idx, request_id, request_id * {m // bs} + r // {bs} AS batch_id, r % {bs} AS pos_in_batch FROM pr)"
    )


def _epoch_sql(extra: str = "", **kw) -> str:
    return f"WITH {_epoch_ctes('events', 'event_id', 64, 8, 128, **kw)} SELECT event_id, request_id::BIGINT AS request_id, batch_id::BIGINT AS batch_id, pos_in_batch::BIGINT AS pos_in_batch FROM plan JOIN ev USING (obs_idx) {extra}"


def _slices_sql(ns: str) -> str:
    return (
        f"{_EV}, k AS (SELECT n, {ns} AS ns, ({ns}) // 50 AS k, ({ns}) % 50 AS rem FROM cnt), sl AS (SELECT unnest(range(k + CASE WHEN rem > 0 THEN 1 ELSE 0 END)) AS slice_ord, n, k, rem FROM k),"
        " sz AS (SELECT slice_ord, n, CASE WHEN slice_ord < k THEN 50 ELSE rem END AS size FROM sl),"
        f" rs AS (SELECT slice_ord, {_draw('n - size + 1', 'start', 'slice_ord')} AS start, size FROM sz)"
    )


_DS = (
    f"{_EV}, bk AS (SELECT unnest(range((n + {BLOCK - 1}) // {BLOCK})) AS blk, n, greatest({BLOCK}, n * {SIZE} // 1000) AS size FROM cnt), "
    f"br AS (SELECT blk, n, size, row_number() OVER (ORDER BY {_h('blk', 'blk')}, blk) - 1 AS rank FROM bk), "
    f"bd AS (SELECT blk, CASE WHEN n <= size OR size // {BLOCK} <= 1 THEN 0 ELSE rank // (size // {BLOCK}) END AS dataset FROM br), "
    f"ds AS (SELECT ev.*, dataset FROM ev JOIN bd ON obs_idx // {BLOCK} = blk)"
)


def _placed(order: str = "") -> str:
    return f"WITH {_DS} SELECT event_id, dataset::BIGINT AS dataset, (row_number() OVER (PARTITION BY dataset ORDER BY {order} {_h('row', 'obs_idx')}, obs_idx) - 1)::BIGINT AS row FROM ds"


_BK = "bk AS (SELECT l_orderkey AS obs, l_partkey AS feature, sum(CAST(l_quantity AS BIGINT))::BIGINT AS value FROM lineitem GROUP BY 1, 2)"
_ATTR = (
    "att AS (SELECT p_partkey AS feature, 0 AS src, p_brand AS value FROM part WHERE p_partkey % 4 <> 0 UNION ALL"
    " SELECT p_partkey, 1, CASE WHEN p_partkey % 10 = 0 THEN 'other' ELSE p_brand END FROM part WHERE p_partkey % 4 <> 1 UNION ALL"
    " SELECT p_partkey, 2, p_brand FROM part WHERE p_partkey % 4 NOT IN (2, 1)),"
    " gr AS (SELECT feature, count(DISTINCT src) AS k, count(DISTINCT value) AS d, arg_min(value, src) AS value FROM att GROUP BY 1)"
)
_CL = (
    f"{_EV}, q AS (SELECT (n + 3) // 4 AS q FROM cnt), dd AS (SELECT event_id, event_type, obs_idx, obs_idx // q AS dataset, q FROM ev, q),"
    " cl AS (SELECT dataset * q + row_number() OVER (PARTITION BY dataset ORDER BY event_type NULLS LAST, obs_idx) - 1 AS i, event_type AS class FROM dd),"
    " nm AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS c FROM (SELECT DISTINCT class FROM cl)),"
    " wt AS (SELECT class, CASE c WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS w FROM nm)"
)


def _runs_sql(where: str = "true") -> str:
    return (
        f"{_CL}, mk AS (SELECT i, cl.class, w FROM cl JOIN wt USING (class), q WHERE {where}), fl AS (SELECT *, CASE WHEN lag(i) OVER (ORDER BY i) = i - 1 AND lag(class) OVER (ORDER BY i) = class THEN 0 ELSE 1 END AS f FROM mk),"
        " gg AS (SELECT *, sum(f) OVER (ORDER BY i) AS g FROM fl), ru AS (SELECT any_value(class) AS class, any_value(w) AS w, min(i)::BIGINT AS start, (max(i) + 1)::BIGINT AS stop FROM gg GROUP BY g),"
        " pb AS (SELECT class, any_value(w) AS w, count(*) AS n_runs FROM ru GROUP BY class),"
        " pp AS (SELECT class, n_runs, w, w / sum(w) OVER () AS prob, (sum(w) OVER (ORDER BY class) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY class) / sum(w) OVER () AS hi FROM pb)"
    )


def _class_slices() -> str:
    return (
        f"{_runs_sql('w > 0')}, ns AS (SELECT n * 545 // 1000 AS ns FROM cnt), so AS (SELECT unnest(range((ns + 8) // 9)) AS slice_ord, ns FROM ns),"
        f" du AS (SELECT slice_ord, ns, {_u('class', 'slice_ord // 2')} / 4294967296.0::DOUBLE AS u FROM so),"
        f" dc AS (SELECT slice_ord, ns, class, {_draw('n_runs', 'run', 'slice_ord')} AS run_ord FROM du JOIN pp ON u >= lo AND u < hi),"
        " ro AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY start) - 1 AS run_ord FROM ru),"
        f" st AS (SELECT slice_ord, ns, dc.class, start + {_draw('stop - start - 9 + 1', 'start', 'slice_ord')} AS start FROM dc JOIN ro ON dc.class = ro.class AND dc.run_ord = ro.run_ord),"
        " sl AS (SELECT slice_ord::BIGINT AS slice_ord, class, start::BIGINT AS start, least(start + 9, start + ns - slice_ord * 9)::BIGINT AS stop FROM st)"
    )


_SRC = "sr AS (SELECT event_id, (user_id % 3)::BIGINT AS dataset FROM events), so AS (SELECT *, row_number() OVER (ORDER BY dataset, event_id) - 1 AS obs_idx, row_number() OVER (PARTITION BY dataset ORDER BY event_id) - 1 AS local_row FROM sr), sz AS (SELECT dataset, min(obs_idx) AS a, count(*) AS n FROM so GROUP BY 1)"
_REQ = (
    _SRC + ", rp AS (SELECT obs_idx, row_number() OVER (ORDER BY CASE dataset WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END, -(local_row // 50), local_row) - 1 AS pos FROM so)"
)
_BREQ = "oi AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders), rq AS (SELECT k * 2 + rep AS pos, o_orderkey AS obs, k // 64 AS batch FROM oi, (SELECT unnest(range(2)) AS rep) WHERE rep = 0 OR k % 3 = 0)"
# The fields of raw_records by file: fs(file_id, field, type), and the changes, as far as one
# field has the evidence for one other: fo(file_id, change, old_field, new_field).
_DRIFT = (
    "rl AS (SELECT DISTINCT file_id, kind, store_id, written_at, line_no, rec_key, record FROM raw_records WHERE file_id IS NOT NULL),"
    " fq AS (SELECT file_id, min(kind) AS kind, min(store_id) AS store_id, min(written_at) AS t FROM rl GROUP BY 1),"
    " sq AS (SELECT file_id, kind, store_id, lag(file_id) OVER (PARTITION BY kind, store_id ORDER BY t, file_id) AS prev_id FROM fq),"
    " rd AS (SELECT file_id, rec_key, line_no, record::JSON AS j FROM rl WHERE json_valid(record) AND json_type(record) = 'OBJECT'),"
    " ky AS (SELECT file_id, rec_key, line_no, j, unnest(json_keys(j)) AS field FROM rd),"
    " vl AS (SELECT file_id, rec_key, line_no, field, json_extract(j, '$.\"' || field || '\"') AS v FROM ky),"
    " ty AS (SELECT *, CASE json_type(v) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'double' ELSE 'integer' END AS type FROM vl),"
    " fs AS (SELECT file_id, field, nullif(array_to_string(list_sort(CASE WHEN list_contains(l, 'double') THEN list_filter(l, lambda x: x <> 'integer') ELSE l END), '|'), '') AS type FROM (SELECT file_id, field, coalesce(list(DISTINCT type) FILTER (WHERE type IS NOT NULL), []) AS l FROM ty GROUP BY 1, 2)),"
    " va AS (SELECT file_id, rec_key, field, arg_max({'v': CASE WHEN type IS NULL THEN NULL ELSE type || ':' || CASE WHEN type IN ('integer', 'double') THEN v::DOUBLE::VARCHAR ELSE v::VARCHAR END END}, (line_no, coalesce(v::VARCHAR, ''))).v AS val FROM ty GROUP BY 1, 2, 3),"
    " pr AS (SELECT file_id, prev_id FROM sq WHERE prev_id IS NOT NULL),"
    " nf AS (SELECT p.file_id, f.field FROM pr p JOIN fs f USING (file_id) WHERE NOT EXISTS (SELECT 1 FROM fs o WHERE o.file_id = p.prev_id AND o.field = f.field)),"
    " gf AS (SELECT p.file_id, p.prev_id, f.field FROM pr p JOIN fs f ON f.file_id = p.prev_id WHERE NOT EXISTS (SELECT 1 FROM fs n WHERE n.file_id = p.file_id AND n.field = f.field)),"
    " ov AS (SELECT g.file_id, rec_key, g.field AS o, val AS x FROM gf g JOIN va ON va.file_id = g.prev_id AND va.field = g.field), nv AS (SELECT n.file_id, rec_key, n.field AS n, val AS y FROM nf n JOIN va USING (file_id, field)),"
    " ev AS (SELECT file_id, o, n FROM ov JOIN nv USING (file_id, rec_key) GROUP BY ALL HAVING bool_and(x IS NOT DISTINCT FROM y) AND count(x) > 0),"
    " fo AS (SELECT file_id, 'renamed' AS change, o AS old_field, n AS new_field FROM ev UNION ALL SELECT file_id, 'removed', field, '' FROM gf WHERE (file_id, field) NOT IN (SELECT (file_id, o) FROM ev)"
    " UNION ALL SELECT file_id, 'added', '', field FROM nf WHERE (file_id, field) NOT IN (SELECT (file_id, n) FROM ev)"
    " UNION ALL SELECT p.file_id, 'retyped', a.field, a.field FROM pr p JOIN fs a USING (file_id) JOIN fs b ON b.file_id = p.prev_id AND b.field = a.field WHERE a.type <> b.type)"
)
_REC = (
    "fx AS (SELECT DISTINCT * FROM csr_files), ex AS (SELECT file_id, dataset, obs_names, indptr, indices, data, unnest(range(least(len(obs_names), len(indptr) - 1))) AS row_no FROM fx WHERE obs_names IS NOT NULL AND indptr IS NOT NULL),"
    " rw AS (SELECT file_id, row_no::BIGINT AS row_no, dataset, obs_names[row_no + 1] AS obs_name, indices[indptr[row_no + 1] - indptr[1] + 1 : indptr[row_no + 2] - indptr[1]] AS ii, data[indptr[row_no + 1] - indptr[1] + 1 : indptr[row_no + 2] - indptr[1]] AS vv FROM ex),"
    " rz AS (SELECT file_id, row_no, dataset, obs_name, list_sort(list_filter(list_zip(ii, vv), lambda p: p[2] <> 0)) AS p FROM rw),"
    " rn AS (SELECT *, row_number() OVER (PARTITION BY obs_name, p::VARCHAR ORDER BY file_id, row_no) AS k FROM rz)"
)


def oracle_sql() -> dict[str, str]:
    n37, tenth = "(SELECT n * 37 // 100 FROM cnt)", ("(SELECT n // 10 FROM cnt)", "(SELECT n * 9 // 10 FROM cnt)")
    slices = _slices_sql("n * 103 // 1000 + 13")
    shard = lambda eq: f"WITH {_EV}, pe AS (SELECT {'n // 3 - (n // 3) % 128' if eq else 'n // 3'} AS per FROM cnt) SELECT (obs_idx // per)::BIGINT AS rank, count(*)::BIGINT AS n, min(obs_idx)::BIGINT AS min_idx, max(obs_idx)::BIGINT AS max_idx FROM ev, pe WHERE obs_idx < per * 3 GROUP BY 1"
    cats = "CASE event_type " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATS)) + " END NULLS LAST,"
    values = lambda rows: ", ".join(str(tuple(r)) for r in rows)
    return stored.oracle_sql(_h, _epoch_ctes) | {
        "seq_batches": _seq(100, 4, 80),
        "seq_batches_drop_last": _seq(100, 12, 48, drop=True),
        "mask_window": _seq(100, 4, 50, f"(SELECT n * {MASK[0]} // 1000 FROM cnt)", f"(SELECT n * {MASK[1]} // 1000 FROM cnt)", total=False),
        "random_chunks_epoch": _epoch_sql(),
        "random_drop_last": _epoch_sql(drop=True),
        "random_num_samples": _epoch_sql(f"WHERE batch_id < ({n37} + 127) // 128"),
        "random_masked": _epoch_sql(a=tenth[0], z=tenth[1]),
        "pivot_chunk_sizes": f"WITH {_chunk_ctes('events', 'event_id', 64)} SELECT chunk::BIGINT AS chunk, start::BIGINT AS start, stop::BIGINT AS stop, visit_rank::BIGINT AS visit_rank FROM ch",
        "replacement_plan": f"WITH {slices} SELECT slice_ord::BIGINT AS slice_ord, start::BIGINT AS start, (start + size)::BIGINT AS stop FROM rs",
        "replacement_gather": f"WITH {slices}, ex AS (SELECT slice_ord, start, unnest(range(size)) AS o FROM rs) SELECT slice_ord::BIGINT AS slice_ord, o::BIGINT AS \"offset\", event_id FROM ex JOIN ev ON ev.obs_idx = start + o",
        "block_shuffle_assignment": _placed(),
        "collection_sizes": f"WITH {_DS} SELECT dataset::BIGINT AS dataset, count(*)::BIGINT AS n FROM ds GROUP BY 1",
        "groupby_sorted_rows": _placed("event_type NULLS LAST,"),
        "groupby_multi_key": _placed("event_type NULLS LAST, user_id NULLS LAST,"),
        "category_order_sort": _placed(cats),
        "append_deal": f"WITH nw AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_id % 5 = 0), nb AS (SELECT unnest(range((count(*) + 36) // 37)) AS blk FROM nw), nd AS (SELECT blk, ntile(4) OVER (ORDER BY {_h('blk', 'blk')}, blk) - 1 AS dataset FROM nb) SELECT event_id, dataset::BIGINT AS dataset FROM nw JOIN nd ON i // 37 = blk",
        "concat_outer_obs": "SELECT event_id, CASE WHEN user_id % 3 = 2 THEN -1 ELSE user_id END AS user_id, CASE WHEN user_id % 3 = 1 THEN '(none)' ELSE event_type END AS event_type, CASE WHEN user_id % 3 = 0 THEN -1.0 ELSE value END AS value FROM events WHERE user_id IS NOT NULL",
        "src_provenance": "SELECT CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS src_path, count(*)::BIGINT AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1",
        "obs_projection": "SELECT value, event_id FROM events",
        "key_presence_census": "SELECT key, n_sources::BIGINT AS n_sources FROM (VALUES ('event_id', 3), ('user_id', 2), ('event_type', 2), ('value', 2)) t(key, n_sources)",
        "concat_outer_features": "WITH f AS (SELECT DISTINCT l_orderkey % 3 AS src, l_partkey AS p FROM lineitem), g AS (SELECT p, count(*) AS n, min(src * 1000000000000 + p) AS first FROM f GROUP BY p) SELECT p::VARCHAR AS feature, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS new_idx, n::BIGINT AS n_sources FROM g",
        "var_subset": f"WITH {_BK} SELECT obs, feature, value FROM bk WHERE feature IN (SELECT p_partkey FROM part WHERE p_partkey <= 500)",
        "append_feature_subset": f"WITH {_BK} SELECT obs, feature, value FROM bk WHERE obs % 5 = 0 AND feature IN (SELECT feature FROM bk WHERE obs % 5 <> 0 AND feature % 7 <> 0)",
        "feature_remap": "WITH ax AS (SELECT var_idx, row_number() OVER (ORDER BY var_idx) - 1 AS i FROM features WHERE partial_share IS NOT NULL), ce AS (SELECT DISTINCT rec_id, x_indices, x_values FROM cells WHERE x_indices IS NOT NULL), lo AS (SELECT unnest(x_indices) AS f, unnest(x_values) AS v FROM ce) SELECT i::BIGINT AS feature, count(*)::BIGINT AS n, round(sum(v::DOUBLE), 3) AS total FROM lo JOIN ax ON f = var_idx WHERE v <> 0 GROUP BY 1",
        "obs_names_unique": f"WITH {_EV}, k AS (SELECT obs_idx, 'user_' || user_id AS nm, row_number() OVER (PARTITION BY user_id ORDER BY obs_idx) - 1 AS k FROM ev) SELECT obs_idx::BIGINT AS obs_idx, CASE WHEN k = 0 THEN nm ELSE nm || '-' || k END AS name FROM k",
        "var_merge_same": f"WITH {_ATTR} SELECT feature, value FROM gr WHERE d = 1 AND k = 3",
        "var_merge_unique": f"WITH {_ATTR} SELECT feature, value FROM gr WHERE d = 1",
        "var_merge_first": f"WITH {_ATTR} SELECT feature, value FROM gr",
        "var_merge_only": f"WITH {_ATTR} SELECT feature, value FROM gr WHERE k = 1",
        "class_runs": f"WITH {_runs_sql()} SELECT class, start, stop FROM ru",
        "class_run_violations": f"WITH {_runs_sql('w > 0')} SELECT class, count(*)::BIGINT AS n_short FROM ru, cnt WHERE stop - start < n // 20 + 1 GROUP BY class",
        "class_probabilities": f"WITH {_runs_sql('w > 0')} SELECT class, n_runs::BIGINT AS n_runs, round(prob, 12) AS prob FROM pp",
        "class_mask_renormalized": f"WITH {_runs_sql('w > 0 AND i >= q // 8 AND i < q // 2')} SELECT class, round(prob, 12) AS prob FROM pp",
        "class_plan": f"WITH {_class_slices()} SELECT slice_ord, class, start, stop FROM sl",
        "class_batches_coherent": f"WITH {_class_slices()}, ex AS (SELECT (slice_ord * 9 + unnest(range(stop - start))) // 6 AS batch_id, class FROM sl) SELECT batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n, count(DISTINCT class)::BIGINT AS n_classes FROM ex GROUP BY 1",
        "class_drop_last": f"WITH {_class_slices()}, ex AS (SELECT slice_ord * 9 + unnest(range(stop - start)) AS p, unnest(range(start, stop)) AS obs_idx FROM sl) SELECT (p // 6)::BIGINT AS batch_id, count(*)::BIGINT AS n, min(obs_idx)::BIGINT AS min_idx, max(obs_idx)::BIGINT AS max_idx FROM ex, ns WHERE p < ns - ns % 6 GROUP BY 1",
        "dist_shards_equal": shard(True),
        "dist_shards_raw": shard(False),
        "worker_split": f"WITH {_chunk_ctes('events', 'event_id', 64)} SELECT chunk::BIGINT AS chunk, (ntile(4) OVER (ORDER BY visit_rank) - 1)::BIGINT AS worker FROM ch",
        "range_to_dataset": f"WITH {_REQ} SELECT pos::BIGINT AS request_pos, dataset::BIGINT AS dataset, local_row::BIGINT AS local_row FROM rp JOIN so USING (obs_idx)",
        "request_order_gather": f"WITH {_REQ} SELECT pos::BIGINT AS request_pos, dataset::BIGINT AS dataset, local_row::BIGINT AS local_row, event_id FROM rp JOIN so USING (obs_idx)",
        "sparse_basket_rows": f"WITH {_BK} SELECT obs, count(*)::BIGINT AS nnz, sum(value)::BIGINT AS sum_value FROM bk GROUP BY obs",
        "sparse_row_gather": f"WITH {_BK}, {_BREQ} SELECT pos::BIGINT AS pos, feature, value FROM rq JOIN bk USING (obs)",
        "sparse_indptr": f"WITH {_BK}, {_BREQ}, nz AS (SELECT obs, count(*) AS nnz FROM bk GROUP BY obs) SELECT batch::BIGINT AS batch, pos::BIGINT AS pos, (sum(coalesce(nnz, 0)) OVER (PARTITION BY batch ORDER BY pos))::BIGINT AS indptr FROM rq LEFT JOIN nz USING (obs)",
        "dense_gather": f"WITH {_epoch_ctes('embeddings', 'vec_id', 16, 4, 32)}, pk AS (SELECT * FROM plan WHERE batch_id < ((SELECT n // 4 FROM cnt) + 31) // 32) SELECT batch_id::BIGINT AS batch_id, pos_in_batch::BIGINT AS pos_in_batch, vec_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS dim, round(unnest(embedding)::DOUBLE, 6) AS value FROM pk JOIN ev USING (obs_idx)",
        "dense_batch_stats": f"WITH {_epoch_ctes('embeddings', 'vec_id', 16, 4, 32)} SELECT batch_id::BIGINT AS batch_id, label::BIGINT AS label, count(*)::BIGINT AS n, round(avg(list_sum(embedding::DOUBLE[]) / len(embedding)), 6) AS mean FROM plan JOIN ev USING (obs_idx) GROUP BY 1, 2",
        "dtype_promotion": "SELECT event_id, round(CASE user_id % 3 WHEN 0 THEN trunc(value)::DOUBLE WHEN 1 THEN value::FLOAT::DOUBLE ELSE value END, 4) AS value FROM events WHERE user_id IS NOT NULL",
        "shard_geometry_dense": f"SELECT n::BIGINT AS n, ap::BIGINT AS asked_page, az::BIGINT AS asked_shard, least(ap, n)::BIGINT AS page, greatest(least(ap, n), least(az, n) - least(az, n) % least(ap, n))::BIGINT AS shard FROM (VALUES {values(GEOMETRIES)}) t(n, ap, az)",
        "shard_geometry_sparse": f"WITH t AS (SELECT * FROM (VALUES {values(SPARSE)}) t(n, nnz, ap, az)), c AS (SELECT *, least(greatest(1, floor(ap * (nnz::DOUBLE / n))), greatest(1, nnz))::BIGINT AS page, least(greatest(1, floor(az * (nnz::DOUBLE / n))), greatest(1, nnz))::BIGINT AS s FROM t) SELECT n::BIGINT AS n, nnz::BIGINT AS nnz, ap::BIGINT AS asked_page, az::BIGINT AS asked_shard, page, greatest(page, s - s % page)::BIGINT AS shard FROM c",
        "bytes_per_row": f"WITH {_BK}, b AS (SELECT count(DISTINCT obs) AS n, count(*) AS nnz FROM bk) SELECT 'basket' AS element, round((nnz * 8 + (n + 1) * 8)::DOUBLE / n, 6) AS bytes_per_row FROM b UNION ALL SELECT 'embedding', 256.0 UNION ALL SELECT 'events', 8 + 8 + 8 + 4 + 8 + 8.0 UNION ALL SELECT 'orders', 8 + 8 + 8 + 8 + 8 + 8.0",
        "run_coalescing": f"WITH {_EV}, f AS (SELECT obs_idx - row_number() OVER (ORDER BY obs_idx) AS g, obs_idx FROM ev WHERE value > 50) SELECT min(obs_idx)::BIGINT AS run_start, count(*)::BIGINT AS run_len FROM f GROUP BY g",
        "auto_batches": f"WITH {_EV}, p AS (SELECT event_id, obs_idx // 300 AS request_id, obs_idx % 300 AS pos FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_h('auto', 'request_id', 'pos')}, pos) - 1 AS rr FROM p), z AS (SELECT request_id, sum((n + 127) // 128) OVER (ORDER BY request_id) - (n + 127) // 128 AS b FROM (SELECT request_id, count(*) AS n FROM p GROUP BY 1)) SELECT event_id, request_id::BIGINT AS request_id, (b + rr // 128)::BIGINT AS batch_id, (rr % 128)::BIGINT AS pos_in_batch FROM r JOIN z USING (request_id)",
        "p2_found": f"WITH {_DRIFT} SELECT DISTINCT file_id, change, old_field, new_field FROM fo",
        "p2_columns": (
            f"WITH RECURSIVE {_DRIFT}, ti AS (SELECT DISTINCT kind, store_id, old_field AS o, new_field AS n FROM fo JOIN sq USING (file_id) WHERE change = 'renamed'),"
            " ed AS (SELECT kind, store_id, o AS a, n AS b FROM ti UNION SELECT kind, store_id, n, o FROM ti), rr AS (SELECT kind, store_id, a, a AS b FROM ed UNION SELECT rr.kind, rr.store_id, rr.a, ed.b FROM rr JOIN ed ON rr.kind = ed.kind AND rr.store_id = ed.store_id AND rr.b = ed.a),"
            " nm AS (SELECT kind, store_id, a AS field, arg_min(b, (CASE WHEN EXISTS (SELECT 1 FROM ti WHERE ti.kind = rr.kind AND ti.store_id = rr.store_id AND ti.n = rr.b) THEN 1 ELSE 0 END, b)) AS col FROM rr GROUP BY 1, 2, 3),"
            " fl AS (SELECT DISTINCT kind, store_id, field, type FROM fs JOIN sq USING (file_id)), fc AS (SELECT kind, store_id, field, type, coalesce(col, field) AS col FROM fl LEFT JOIN nm USING (kind, store_id, field)),"
            " tl AS (SELECT col, list(DISTINCT t) AS l FROM (SELECT col, unnest(string_split(type, '|')) AS t FROM fc WHERE type IS NOT NULL) GROUP BY 1), tw AS (SELECT col, CASE WHEN list_contains(l, 'double') THEN list_filter(l, lambda x: x <> 'integer') ELSE l END AS l FROM tl)"
            ' SELECT DISTINCT kind, store_id, field, col AS "column", CASE WHEN len(l) = 1 AND l[1] <> \'object\' THEN l[1] ELSE \'string\' END AS type FROM fc LEFT JOIN tw USING (col)'
        ),
        "p3_found": f"WITH {_REC} SELECT DISTINCT file_id, row_no FROM rn WHERE k > 1",
        "p3_report": f"WITH {_REC} SELECT (SELECT count(*) FROM fx)::BIGINT AS files_before, count(*) FILTER (WHERE k = 1)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT file_id, row_no FROM rn WHERE k > 1))::BIGINT AS copies FROM rn",
        "p3_kept": f"WITH {_REC} SELECT file_id, row_no, dataset::BIGINT AS dataset, obs_name, len(p)::BIGINT AS nnz, round(coalesce(list_sum(list_transform(p, lambda x: x[2]::DOUBLE)), 0), 3) AS total FROM rn WHERE k = 1",
    }
