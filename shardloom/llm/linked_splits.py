"""Splits that keep related records together.

Components come from random-mate contraction. Each round every vertex tosses a
seeded coin; a tail with a head among its neighbours joins one of them (the smallest
by hash), edges are rewritten to the joined vertices, loops and repeats fall away, and
the joins are written down. This ends when no edge is left. Every step is an equi-join or a grouped minimum that combines
before the shuffle; a hub with a third of all edges gives one row a task to its
minimum, and joins on it are split by adaptive skew handling. Each round is written to
the shared folder, so lineage stays one round long and lost executors cost nothing.
The joins form a forest, which is unwound by pointer doubling.

A round removes at least a quarter of the vertices that still have edges, in
expectation, so rounds grow with the logarithm of the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.hashing import md5_key
from shardloom.session import discard, materialize, scratch_path


def _heads(v: str) -> Column:
    return F.pmod(F.xxhash64(F.col("s"), F.col(v)), F.lit(2)) == 1


def components(edges: DataFrame, seed: int = 7, max_rounds: int = 200) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a BIGINT, b BIGINT): vertices share a root
    iff they are connected. Loops and repeats of edges are fine; null ends are left out.
    The root is one of the component's vertices (not the smallest).

    A round is one write of two parts, the edges left and the joins made. The round's
    salt is a column, so all rounds run the same compiled code.
    """
    spark = edges.sparkSession
    at = scratch_path(spark, "rounds")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(conf)
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e.select("a", "b", F.lit(seed).cast("bigint").alias("s"), F.lit(0).alias("part")).write.partitionBy("part").parquet(f"{at}/0")
    rnd = 0
    while fs.exists(path(f"{at}/{rnd}/part=0")):
        if rnd == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        e = spark.read.schema("a bigint, b bigint, s bigint").parquet(f"{at}/{rnd}/part=0")
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
        joined = both.where(~_heads("a") & _heads("b")).groupBy(F.col("a").alias("v")).agg(F.min_by("b", F.xxhash64("s", "b")).alias("to"))
        l, r = (joined.select(F.col("v").alias(x), F.col("to").alias(f"t{x}")) for x in "ab")
        nxt = e.join(l, "a", "left").join(r, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "s").where("x <> y")
        nxt = nxt.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.xxhash64("s").alias("s")).distinct().withColumn("part", F.lit(0))
        made = joined.select(F.col("v").alias("a"), F.col("to").alias("b"), F.lit(0).cast("bigint").alias("s"), F.lit(1).alias("part"))
        nxt.unionAll(made).write.partitionBy("part").parquet(f"{at}/{rnd + 1}")
        fs.delete(path(f"{at}/{rnd}/part=0"), True)
        rnd += 1
    # Every vertex joined another at most once, so the joins form a forest no deeper than
    # the rounds; doubling the steps finds all roots.
    made = [f"{at}/{i}/part=1" for i in range(1, rnd + 1) if fs.exists(path(f"{at}/{i}/part=1"))]
    if not made:
        return spark.createDataFrame([], "v bigint, root bigint")
    up = spark.read.schema("a bigint, b bigint").parquet(*made).select(F.col("a").alias("v"), F.col("b").alias("root"))
    for _ in range(max(0, (len(made) - 1).bit_length())):
        nxt = up.select(F.col("v").alias("root"), F.col("root").alias("higher"))
        last, up = up, materialize(up.join(nxt, "root", "left").select("v", F.coalesce("higher", "root").alias("root")), "roots")
        discard(last)
    return up.unionAll(up.select(F.col("root").alias("v"), "root").distinct())


#: A record is linked through these columns; see link_keys.
KINDS = {"donor": 1, "sample": 2, "name": 3}


def donor_number(c: Column) -> Column:
    """The number in a donor's spelling, without leading zeros; null if there are no digits."""
    d = F.regexp_extract(c, "([0-9]+)", 1)
    return F.when(d != "", F.regexp_replace(d, "^0+(?=[0-9])", ""))


def plain_key(c: Column) -> Column:
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def link_keys(cells: DataFrame) -> DataFrame:
    """rec_id and its three link keys as 64-bit hashes, with the donor's number.

    donor: the number in donor_id. sample: sample_id ignoring case and outer blanks.
    name: obs_name likewise, unless it is of digits only. Empty and null keys are null.
    """
    name = plain_key(F.col("obs_name"))
    d = donor_number(F.col("donor_id"))
    h = lambda kind, k: F.when(k.isNotNull(), F.xxhash64(F.lit(KINDS[kind]), k))
    return cells.where(F.col("rec_id").isNotNull()).select(
        "rec_id", d.cast("decimal(38,0)").alias("donor_no"), h("donor", d).alias("donor"), h("sample", plain_key(F.col("sample_id"))).alias("sample"),
        h("name", F.when(~name.rlike("^[0-9]+$"), name)).alias("name"),
    )


def linked_groups(cells: DataFrame, seed: int = 7) -> DataFrame:
    """rec_id, group, donor_no of every record (donor_no the record's own, maybe null).

    Keys that only one record has link nothing and are dropped first. What is left are
    edges between keys (a record with several keys ties them), which copies of a link
    collapse into one. A record without shared keys is its own group.
    """
    r = link_keys(cells).distinct()
    keys = r.select("rec_id", "donor_no", F.explode(F.array(*KINDS)).alias("k")).where("k IS NOT NULL")
    shared = keys.groupBy("k").agg(F.min("rec_id").alias("lo"), F.max("rec_id").alias("hi")).where("lo <> hi").select("k")
    own = materialize(keys.join(shared, "k", "left_semi"), "keys")
    # One vertex per shared key; a record ties its smallest key to its others. A rec_id
    # whose rows differ has the keys of all its rows.
    per = own.groupBy("rec_id").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    ties = per.where("size(ks) > 1").select(F.col("ks")[0].alias("a"), F.explode(F.slice("ks", 2, 1 << 20)).alias("b"))
    comp = components(ties, seed)
    rec = per.select("rec_id", F.col("ks")[0].alias("v")).join(comp, "v", "left").select("rec_id", F.coalesce("root", "v").alias("group"))
    alone = r.select("rec_id").distinct()
    all_ = alone.join(rec, "rec_id", "left").withColumn("group", F.coalesce("group", F.xxhash64(F.lit("alone"), "rec_id")))
    donors = r.groupBy("rec_id").agg(F.min("donor_no").alias("donor_no"))
    return all_.join(donors, "rec_id")


def found(cells: DataFrame, seed: int = 7) -> DataFrame:
    """p5_found(rec_id, group_donor): records in groups of two or more distinct rec_id;
    group_donor is the group's smallest donor number (null if it has no donor)."""
    g = materialize(linked_groups(cells, seed), "groups")
    size = g.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("donor_no").cast("bigint").alias("group_donor")).where("n > 1")
    return g.join(size, "group").select("rec_id", "group_donor")


def assign_splits(cells: DataFrame, shares: dict[str, float] | None = None, seed: int = 7, digits: int = 4) -> DataFrame:
    """rec_id, group (the smallest rec_id of the linked group), split. Groups are laid out by
    md5('seed:group:id') along the cumulative weight (records) and a split is the stretch of the
    total its share covers, so proportions hold to within the one group at each border. The running total is taken over
    the first ``digits`` hex digits first and inside such a slot second: no single task sorts all groups.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    if any(s < 0 for s in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must be >= 0 and add up to 1")
    g = materialize(linked_groups(cells, seed), "groups")
    w = g.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("id"))
    w = w.withColumn("h", md5_key(seed, "group", "id")).withColumn("slot", F.substring("h", 1, digits))
    per = w.groupBy("slot").agg(F.sum("n").alias("sn"))
    per = per.select("slot", (F.sum("sn").over(Window.orderBy("slot")) - F.col("sn")).alias("base"), F.sum("sn").over(Window.partitionBy()).alias("total"))  # 16**digits rows
    mid = F.col("base") + F.sum("n").over(Window.partitionBy("slot").orderBy("h", "id")) - F.col("n") / 2
    at = w.join(per, "slot").select("group", "id", (mid / F.col("total")).alias("at"))
    split = F.lit(list(shares)[-1])
    for name, upto in reversed(borders(shares)):
        split = F.when(F.col("at") < upto, F.lit(name)).otherwise(split)
    return g.join(at, "group").select("rec_id", F.col("id").alias("group"), split.alias("split"))


def borders(shares: dict[str, float]) -> list[tuple[str, float]]:
    """Each split's end on [0, 1], a trifle beyond so that rounding excludes nobody."""
    out, upto = [], 1.0
    for name in reversed(list(shares)):
        out.append((name, upto + 1e-12))
        upto -= shares[name]
    return out[::-1]
