"""Queries that go through ``Collection`` and ``Loader``, each with SQL for the same rows.

Every query writes a collection of its own into the shared folder, so nothing is left over
from one run to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.loader import Loader
from shardloom.operators import matrix
from shardloom.plans import samplers as s
from shardloom.session import scratch_path
from shardloom.sources.collection import Collection, bytes_per_row

SEED = 7
BLOCK = 100
CHUNK, PRELOAD, BATCH = 64, 8, 128


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _new(spark: SparkSession) -> Collection:
    return Collection(spark, scratch_path(spark, "collection"))


def _big(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("obs_name", F.concat(F.lit("e"), F.col("event_id").cast("string")))


def _events(spark, d) -> tuple[Collection, int]:
    """Events of three sources, of which each lacks a column."""
    e = _named(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"))
    parts = [e.where(F.col("user_id") % 3 == i).drop(c) for i, c in enumerate(["value", "event_type", "user_id"])]
    n = e.count()
    return _new(spark).add(parts, order=["event_id"], dataset_size=max(BLOCK, n * 255 // 1000), block=BLOCK, seed=SEED), n


def collection_rows(spark, d):
    """Create: concatenate, deal blocks over datasets, permute."""
    return _big(_events(spark, d)[0].read().select("dataset", "row", "obs_idx", "event_id", "src_path"))


def collection_grouped_rows(spark, d):
    """Create, sorted by a categorical column in its declared order."""
    e = _named(_t(spark, d, "events").select("event_id", "event_type"))
    n = e.count()
    c = _new(spark).add([e], order=["event_id"], groupby="event_type", categories={"event_type": CATS}, dataset_size=max(BLOCK, n * 255 // 1000), block=BLOCK, seed=SEED)
    return _big(c.read().select("dataset", "row", "event_id"))


CATS = ["view", "click", "purchase", "search"]


def _two_parts(spark, d, **append) -> Collection:
    e = _named(_t(spark, d, "events").select("event_id", "value"))
    old, new = e.where("event_id % 5 <> 0"), e.where("event_id % 5 = 0").drop("value")
    n = old.count()
    c = _new(spark).add([old], order=["event_id"], dataset_size=max(BLOCK, n * 3 // 10), block=BLOCK, seed=SEED)
    return c.add([new], order=["event_id"], block=37, seed=SEED, **append)


def collection_append_rows(spark, d):
    """Append: new blocks dealt over the datasets there are, each permuted anew."""
    return _big(_two_parts(spark, d).read().select("dataset", "row", "obs_idx", "event_id"))


def collection_added_rows(spark, d):
    """Append beside: the stored datasets stay, the new rows become datasets of their own."""
    c = _two_parts(spark, d, spread=False)
    return _big(c.read().select("dataset", "row", "event_id"))


def collection_obs(spark, d):
    """Obs columns of a collection whose sources are read through a projection."""
    n = _t(spark, d, "events").count()
    load = lambda sp, path: _named(sp.read.parquet(path).select("event_id", "value", "event_type"))
    c = _new(spark).add([f"{d}/events.parquet"], load=load, order=["event_id"], dataset_size=max(BLOCK, n * 255 // 1000), block=BLOCK, seed=SEED)
    return _big(c.obs(["value", "nothing", "event_type"]))


def collection_fetch(spark, d):
    """The first half of every second hundred of the stored rows, by ranges."""
    c, n = _events(spark, d)
    return _big(c.fetch([slice(a, min(n, a + 50)) for a in range(0, n, 200)]).select(F.col("obs_idx"), "event_id"))


def _axis(spark, d) -> DataFrame:
    """Features by unique names, with two attributes for the merge."""
    return _t(spark, d, "features").select("var_idx", F.concat_ws("#", "var_name", F.col("var_idx").cast("string")).alias("var_name"), "same", "partial_share")


def _featured(spark, d, **how) -> Collection:
    """Cells of even rec_id on the features in their order, of odd rec_id on the reversed
    axis without every seventh feature; a layer holds the doubled values."""
    v = _axis(spark, d)
    top = v.agg(F.max("var_idx")).first()[0]
    x = _t(spark, d, "cells").select("rec_id", "x_indices", "x_values").where("x_indices IS NOT NULL AND x_values IS NOT NULL").dropDuplicates(["rec_id"])
    x = x.withColumn("obs_name", F.concat(F.lit("r"), F.col("rec_id").cast("string")))
    x = x.withColumn("twice_indices", F.col("x_indices")).withColumn("twice_values", F.transform("x_values", lambda a: a * 2))
    turn = lambda c: F.transform(c, lambda i: F.lit(top) - i)
    a, b = x.where("rec_id % 2 = 0"), x.where("rec_id % 2 <> 0")
    b = b.withColumn("x_indices", turn("x_indices")).withColumn("twice_indices", turn("twice_indices"))
    keep = F.expr(f"filter(arrays_zip(x_indices, x_values), p -> ({top} - p.x_indices) % 7 <> 0)")
    b = b.withColumn("__k", keep).withColumn("x_indices", F.col("__k.x_indices")).withColumn("x_values", F.col("__k.x_values")).drop("__k")
    vb = v.where("var_idx % 7 <> 0").withColumn("var_idx", F.lit(top) - F.col("var_idx")).withColumn("partial_share", F.when(F.col("var_idx") % 10 == 0, -1).otherwise(F.col("partial_share")))
    va = v.withColumn("first_only", F.col("var_idx") * 3)
    c = _new(spark)
    if how.pop("append", False):
        c.add([a], vars_=[va], var_subset=[r["var_name"] for r in va.where("var_idx % 5 <> 0").select("var_name").collect()], order=["rec_id"], block=50, seed=SEED)
        return c.add([b], vars_=[vb], order=["rec_id"], block=50, seed=SEED)
    return c.add([a, b], vars_=[va, vb], order=["rec_id"], block=50, seed=SEED, **how)


def _by_feature(c: Collection, element: str) -> DataFrame:
    long = matrix.to_long(c.read(), "rec_id", f"{element}_indices", f"{element}_values").where("value <> 0")
    by = long.groupBy(F.col("feature").alias("var_idx")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))
    return c.var.select("var_idx", "var_name").join(by, "var_idx").select("var_name", F.col("var_idx").cast("bigint").alias("var_idx"), "n", "total")


def collection_features(spark, d):
    """X of two sources with different axes, on their outer join, by feature name."""
    return _by_feature(_featured(spark, d), "x")


def collection_layer(spark, d):
    """The same for a layer, which is on the same axis."""
    return _by_feature(_featured(spark, d), "twice").select("var_name", "n", "total")


def collection_append_features(spark, d):
    """An append is cut to the stored features; the stored ones were chosen by name."""
    return _by_feature(_featured(spark, d, append=True), "x").select("var_name", "n", "total")


def _var_merge(mode):
    def q(spark, d):
        v = _featured(spark, d, merge=mode).var
        return v.select("var_name", *[F.coalesce(F.col(c).cast("bigint"), F.lit(-9)).alias(c) for c in v.columns if c not in ("var_idx", "var_name")])

    return q


def _loader(spark, d, **kw) -> Loader:
    return Loader(s.RandomSampler(CHUNK, PRELOAD, BATCH, seed=SEED), **kw).use_collection(_events(spark, d)[0])


def loader_epoch(spark, d):
    """A random epoch over a collection: every delivered row with its batch."""
    return _big(_loader(spark, d).rows().select("event_id", "batch_id", "pos_in_batch"))


def loader_batches(spark, d):
    """The same batches worked on by the executors, a batch at a time."""
    schema = "batch_id bigint, n bigint, first_event bigint, sum_event_id bigint"
    f = lambda b: b.head(1)[["batch_id"]].assign(n=len(b), first_event=b["event_id"].iloc[0], sum_event_id=b["event_id"].sum())
    return _loader(spark, d).map_batches(f, schema)


def loader_delivery(spark, d):
    """The same batches as the caller's iteration gets them, in order, with their index."""
    rows = [(i, len(b["obs"]), int(b["obs"]["event_id"].iloc[0]), int(b["obs"]["event_id"].sum()), int(b["index"].sum())) for i, b in enumerate(_loader(spark, d, return_index=True))]
    return spark.createDataFrame(rows, "batch_id bigint, n bigint, first_event bigint, sum_event_id bigint, sum_index bigint")


def loader_frames(spark, d):
    """Two tables registered one after the other, read in order in batches of their X."""
    e = _t(spark, d, "events").select("event_id", F.array("value", F.col("event_id").cast("double")).alias("x"))
    x = Loader(chunk_size=50, preload_nchunks=4, batch_size=40).add_dataset(e.where("event_id % 2 = 1"), "event_id").add_dataset(e.where("event_id % 2 = 0"), "event_id")
    rows = [(i, len(b["X"]), float(round(b["X"][:, 1].sum(), 3))) for i, b in enumerate(x)]
    return spark.createDataFrame(rows, "batch_id bigint, n bigint, total double")


def distributed_epoch(spark, d):
    """Three ranks' epochs over their shards, each with its own order."""
    n = _t(spark, d, "events").count()
    u = None
    for r in range(3):
        x = s.DistributedSampler(s.RandomSampler(CHUNK, PRELOAD, BATCH, seed=SEED), dist_info=lambda r=r: (r, 3))
        p = x.plan(spark, n).select(F.lit(r).alias("rank"), "obs_idx", "batch_id", "pos_in_batch")
        u = p if u is None else u.unionAll(p)
    return _big(u)


class Backwards(s.Sampler):
    """A sampler of one's own: chunks from the last to the first, a chunk a request."""

    batch_size, shuffle = 40, False

    def n_batches(self, n_obs):
        return n_obs // 100 * 3 + -(-(n_obs % 100) // 40)

    def validate(self, n_obs):
        if n_obs < 1:
            raise ValueError("no rows")

    def _plan(self, spark, n_obs):
        last = (n_obs - 1) // 100
        p = spark.range(n_obs).select(F.col("id").alias("obs_idx"), (F.lit(last) - F.expr("id div 100")).alias("request_id"), (F.col("id") % 100).alias("pos"))
        return p


def custom_sampler_rows(spark, d):
    """A custom sampler's plan, which gets its batches, over a registered table."""
    x = Loader(Backwards()).add_dataset(_t(spark, d, "events").select("event_id"), "event_id")
    return _big(x.rows().select("event_id", "request_id", "batch_id", "pos_in_batch"))


def category_union(spark, d):
    """The categories of two sources and of an append, united in order of appearance."""
    e = _named(_t(spark, d, "events").select("event_id", "event_type"))
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # the categories
    c = _new(spark).add([e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1")], order=["event_id"], block=BLOCK, categories=[{"event_type": names[2:]}, {"event_type": names[1:3]}])
    c.add([e.where("event_id % 3 = 2")], order=["event_id"], block=BLOCK, categories={"event_type": names})
    return spark.createDataFrame(list(enumerate(c.manifest["categories"]["event_type"])), "pos bigint, event_type string")


def bytes_per_row_measured(spark, d):
    """Estimated bytes of a row, with the strings' and arrays' real lengths."""
    rows = [("eval_items", bytes_per_row(_t(spark, d, "eval_items"), frozenset({"suite"}))), ("vectors", bytes_per_row(_t(spark, d, "vectors"))), ("events", bytes_per_row(_t(spark, d, "events").select("event_id", "ts", "event_type")))]
    return spark.createDataFrame([(k, round(v, 6)) for k, v in rows], "element string, bytes_per_row double")


def sharded_write(spark, d):
    """A matrix in files of a number of rows and pages, read back."""
    from shardloom.sources.collection import write_sharded

    out = scratch_path(spark, "sharded")
    page, shard = write_sharded(_t(spark, d, "embeddings").repartition(1), out, rows_per_page=10, shard_size=305)
    back = spark.read.parquet(out).select("vec_id", F.input_file_name().alias("f"))
    n = back.groupBy("f").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("files"))
    return n.select("n", "files", F.lit(page).cast("bigint").alias("page"), F.lit(shard).cast("bigint").alias("shard"))


def queries() -> dict:
    own = [
        collection_rows, collection_grouped_rows, collection_append_rows, collection_added_rows, collection_obs, collection_fetch, collection_features,
        collection_layer, collection_append_features, loader_epoch, loader_batches, loader_delivery, loader_frames, distributed_epoch,
        custom_sampler_rows, category_union, bytes_per_row_measured, sharded_write,
    ]
    return {f.__name__: f for f in own} | {f"collection_var_{m}": _var_merge(m) for m in ("same", "unique", "first", "only")}


def oracle_sql(h, chunk_epoch) -> dict[str, str]:
    """``h(tag, *keys)``: the hash of keys in SQL; ``chunk_epoch(table, order, ...)``: the CTEs
    of an epoch (see core.py)."""
    deal = (
        f"bk AS (SELECT unnest(range((n + {BLOCK - 1}) // {BLOCK})) AS blk, n, greatest({BLOCK}, n * {{size}}) AS size FROM cn),"
        f" br AS (SELECT blk, n, size, row_number() OVER (ORDER BY {h('blk', 'blk')}, blk) - 1 AS rank FROM bk),"
        f" bd AS (SELECT blk, CASE WHEN n <= size OR size // {BLOCK} <= 1 THEN 0 ELSE rank // (size // {BLOCK}) END AS dataset FROM br),"
    )
    row = lambda order="": f'row_number() OVER (PARTITION BY dataset ORDER BY {order} {h("row", "obs_idx")}, obs_idx) - 1'
    # Events in three sources, stored: pl(event_id, obs_idx, dataset, r).
    src = (
        "so AS (SELECT *, row_number() OVER (ORDER BY user_id % 3, event_id) - 1 AS obs_idx FROM events WHERE user_id IS NOT NULL), cn AS (SELECT count(*) AS n FROM events),"
        f" {deal.format(size='255 // 1000')} ds AS (SELECT so.*, dataset FROM so JOIN bd ON obs_idx // {BLOCK} = blk), pl AS (SELECT *, {row()} AS r FROM ds)"
    )
    one = src.replace("ORDER BY user_id % 3, event_id", "ORDER BY event_id").replace("WHERE user_id IS NOT NULL", "")
    two = (
        "ol AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS obs_idx FROM events WHERE event_id % 5 <> 0), cn AS (SELECT count(*) AS n FROM ol),"
        f" {deal.format(size='3 // 10')} od AS (SELECT ol.*, dataset FROM ol JOIN bd ON obs_idx // {BLOCK} = blk),"
        " ne AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_id % 5 = 0),"
        f" nb AS (SELECT unnest(range((count(*) + 36) // 37)) AS blk FROM ne), nr AS (SELECT blk, row_number() OVER (ORDER BY {h('blk', 'blk')}, blk) - 1 AS rank FROM nb)"
    )
    append = (
        f"{two}, kk AS (SELECT count(DISTINCT dataset) AS k FROM od), qq AS (SELECT k, (SELECT count(*) FROM nb) // k AS q, (SELECT count(*) FROM nb) % k AS r FROM kk),"
        " nd AS (SELECT blk, CASE WHEN rank < r * (q + 1) THEN rank // (q + 1) ELSE r + (rank - r * (q + 1)) // q END AS dataset FROM nr, qq),"
        " al AS (SELECT event_id, obs_idx, dataset FROM od UNION ALL SELECT event_id, n + i, dataset FROM ne JOIN nd ON i // 37 = blk, cn)"
    )
    beside = (
        f"{two}, sz AS (SELECT max(c) AS size, count(*) AS k FROM (SELECT count(*) AS c FROM od GROUP BY dataset)), nn AS (SELECT count(*) AS m FROM ne),"
        " nd AS (SELECT blk, k + CASE WHEN m <= greatest(37, size) OR greatest(37, size) // 37 <= 1 THEN 0 ELSE rank // (greatest(37, size) // 37) END AS dataset FROM nr, sz, nn),"
        " al AS (SELECT event_id, obs_idx, dataset FROM od UNION ALL SELECT event_id, n + i, dataset FROM ne JOIN nd ON i // 37 = blk, cn)"
    )
    placed = "SELECT dataset::BIGINT AS dataset, r::BIGINT AS row, {0} FROM pl"
    ax = "ax AS (SELECT var_idx AS i, concat_ws('#', var_name, var_idx) AS var_name, same, partial_share FROM features)"
    x = "ce AS (SELECT DISTINCT rec_id, x_indices, x_values FROM cells WHERE x_indices IS NOT NULL AND x_values IS NOT NULL), lo AS (SELECT rec_id, unnest(x_indices) AS i, unnest(x_values) AS v FROM ce)"
    total = lambda v="v": f"count(*)::BIGINT AS n, round(sum({v}::DOUBLE), 3) AS total"
    epoch = f"WITH {src.replace('pl AS (', 'pe AS (')}, st AS (SELECT event_id, dataset, r FROM pe), {chunk_epoch('st', 'dataset, r', CHUNK, PRELOAD, BATCH)}, dl AS (SELECT event_id, obs_idx, batch_id, pos_in_batch FROM plan JOIN ev USING (obs_idx))"
    batches = "batch_id::BIGINT AS batch_id, count(*)::BIGINT AS n, arg_min(event_id, pos_in_batch) AS first_event, sum(event_id)::BIGINT AS sum_event_id"
    ranks = []
    for r in range(3):
        per = "(SELECT n // 3 - (n // 3) % 128 FROM cnt)"
        e = chunk_epoch("events", "event_id", CHUNK, PRELOAD, BATCH, a=f"{r} * {per}", z=f"{r + 1} * {per}").replace(f"'{SEED}:", f"'{SEED * 1_000_003 + r}:")
        ranks.append(f"SELECT * FROM (WITH {e} SELECT {r}::BIGINT AS rank, obs_idx::BIGINT AS obs_idx, batch_id::BIGINT AS batch_id, pos_in_batch::BIGINT AS pos_in_batch FROM plan)")
    whens = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATS))
    both = "va AS (SELECT *, i * 3 AS first_only FROM ax), vb AS (SELECT var_name, i, same, CASE WHEN (t - i) % 10 = 0 THEN -1 ELSE partial_share END AS partial_share FROM ax, (SELECT max(i) AS t FROM ax) WHERE i % 7 <> 0)"
    nul = lambda c: f"coalesce({c}, -9)::BIGINT AS {c}"
    return {
        "collection_rows": f"WITH {src} " + placed.format("obs_idx::BIGINT AS obs_idx, event_id, 'source_' || (user_id % 3) AS src_path"),
        "collection_grouped_rows": f"WITH {one.replace(row(), row(f'CASE event_type {whens} END NULLS LAST,'))} {placed.format('event_id')}",
        "collection_append_rows": f"WITH {append}, pl AS (SELECT *, {row()} AS r FROM al) {placed.format('obs_idx::BIGINT AS obs_idx, event_id')}",
        "collection_added_rows": f"WITH {beside}, pl AS (SELECT *, {row()} AS r FROM al) {placed.format('event_id')}",
        "collection_obs": f"WITH {one} {placed.format('value, event_type')}",
        "collection_fetch": f"WITH {src}, st AS (SELECT event_id, row_number() OVER (ORDER BY dataset, r) - 1 AS place FROM pl) SELECT place::BIGINT AS obs_idx, event_id FROM st WHERE place % 200 < 50",
        "collection_features": f"WITH {ax}, {x}, k AS (SELECT i, v FROM lo WHERE v <> 0 AND (rec_id % 2 = 0 OR i % 7 <> 0)) SELECT var_name, i::BIGINT AS var_idx, {total()} FROM k JOIN ax USING (i) GROUP BY 1, 2",
        "collection_layer": f"WITH {ax}, {x}, k AS (SELECT i, v FROM lo WHERE v <> 0 AND (rec_id % 2 = 0 OR i % 7 <> 0)) SELECT var_name, {total('(v * 2)')} FROM k JOIN ax USING (i) GROUP BY 1",
        "collection_append_features": f"WITH {ax}, {x}, k AS (SELECT i, v FROM lo WHERE v <> 0 AND i % 5 <> 0 AND (rec_id % 2 = 0 OR i % 7 <> 0)) SELECT var_name, {total()} FROM k JOIN ax USING (i) GROUP BY 1",
        "collection_var_same": f"WITH {ax} SELECT var_name FROM ax",
        "collection_var_unique": f"WITH {ax} SELECT var_name, {nul('first_only')} FROM (SELECT *, i * 3 AS first_only FROM ax)",
        "collection_var_first": f"WITH {ax}, {both} SELECT var_name, {nul('same')}, {nul('partial_share')}, {nul('first_only')} FROM va",
        "collection_var_only": f"WITH {ax}, {both} SELECT var_name, {nul('first_only')} FROM va",
        "loader_epoch": f"{epoch} SELECT event_id, batch_id::BIGINT AS batch_id, pos_in_batch::BIGINT AS pos_in_batch FROM dl",
        "loader_batches": f"{epoch} SELECT {batches} FROM dl GROUP BY 1",
        "loader_delivery": f"{epoch} SELECT {batches}, sum(obs_idx)::BIGINT AS sum_index FROM dl GROUP BY 1",
        "loader_frames": "WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id % 2 DESC, event_id) - 1 AS i FROM events) SELECT (i // 40)::BIGINT AS batch_id, count(*)::BIGINT AS n, round(sum(event_id)::DOUBLE, 3) AS total FROM o GROUP BY 1",
        "distributed_epoch": " UNION ALL ".join(ranks),
        "custom_sampler_rows": "WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events), q AS (SELECT event_id, (n - 1) // 100 - i // 100 AS request_id, i % 100 AS pos FROM e), z AS (SELECT request_id, (count(*) + 39) // 40 AS k FROM q GROUP BY 1), b AS (SELECT request_id, sum(k) OVER (ORDER BY request_id) - k AS base FROM z) SELECT event_id, request_id::BIGINT AS request_id, (base + pos // 40)::BIGINT AS batch_id, (pos % 40)::BIGINT AS pos_in_batch FROM q JOIN b USING (request_id)",
        "category_union": "WITH c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)) SELECT (row_number() OVER (ORDER BY CASE WHEN i >= 2 THEN i WHEN i = 1 THEN 1000 ELSE 1001 END) - 1)::BIGINT AS pos, event_type FROM c",
        "bytes_per_row_measured": "SELECT 'eval_items' AS element, round(8 + avg(strlen(text)) + 4, 6) AS bytes_per_row FROM eval_items UNION ALL SELECT 'vectors', round(16 + sum(coalesce(len(embedding), 0)) * 4.0::DOUBLE / count(*), 6) FROM vectors UNION ALL SELECT 'events', round(16 + avg(strlen(event_type)), 6) FROM events",
        "sharded_write": "WITH c AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT n, least(10, n) AS page, greatest(least(10, n), least(305, n) - least(305, n) % least(10, n)) AS shard FROM c), f AS (SELECT least(shard, n - k * shard) AS m, page, shard FROM (SELECT *, unnest(range((n + shard - 1) // shard)) AS k FROM p)) SELECT m::BIGINT AS n, count(*)::BIGINT AS files, page::BIGINT AS page, shard::BIGINT AS shard FROM f GROUP BY ALL",
    }
