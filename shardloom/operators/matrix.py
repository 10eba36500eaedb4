"""Sparse and dense rows: aligning feature axes, subsets, gathers, CSR export.

A sparse row is two arrays, feature indices and values; the long form is (obs, feature,
value). Feature axes are small tables (var_idx, var_name, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.geometry import promote


#: The prefix of the element that has a feature axis of its own.
RAW = "raw"


def feature_axis(sources: list[DataFrame], name: str = "var_name", idx: str = "var_idx") -> DataFrame:
    """Outer union of feature axes: name, new_idx (0-based, in order of first appearance),
    n_sources. Names must be unique within each source."""
    u = None
    for i, s in enumerate(sources):
        d = s.select(F.lit(i).alias("src"), F.col(idx).cast("bigint").alias("i"), F.col(name).alias("name"))
        u = d if u is None else u.unionAll(d)
    if u.groupBy("src", "name").count().where("count > 1").limit(1).count():
        raise ValueError("feature names repeat within a source")
    g = u.groupBy("name").agg(F.min(F.struct("src", "i")).alias("first"), F.countDistinct("src").alias("n_sources"))
    w = Window.orderBy("first.src", "first.i")  # features, not rows
    return g.select("name", (F.row_number().over(w) - 1).cast("bigint").alias("new_idx"), F.col("n_sources").cast("bigint").alias("n_sources"))


def remap_long(long: DataFrame, var: DataFrame, axis: DataFrame, feature: str = "feature", name: str = "var_name", idx: str = "var_idx") -> DataFrame:
    """A source's long rows with ``new_idx`` of the outer axis. The source's map is one row a
    feature; adaptive execution broadcasts it while it is small."""
    m = var.select(F.col(idx).alias(feature), F.col(name).alias("name")).join(axis.select("name", "new_idx"), "name").select(feature, "new_idx")
    return long.join(m, feature)


def index_map(mapping: DataFrame, max_features: int = 2_000_000) -> Column:
    """``mapping`` (old_idx, new_idx) as one array, at place old_idx the new index or null,
    from a scalar subquery: an entry is looked up in constant time. It is checked to
    have at most ``max_features`` places."""
    top = mapping.agg(F.max("old_idx")).first()[0]
    if top is not None and top >= max_features:
        raise ValueError(f"feature {top} is beyond max_features")
    m = mapping.select(F.col("old_idx").cast("bigint").alias("o"), F.col("new_idx").cast("int").alias("n"))
    m = mapping.sparkSession.range((top if top is not None else -1) + 1).join(m, F.col("id") == F.col("o"), "left")
    return m.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "n"))), lambda x: x["n"])).scalar()


def remap_rows(rows: DataFrame, mapping: DataFrame, indices: str = "x_indices", values: str = "x_values", max_features: int = 2_000_000) -> DataFrame:
    """Rewrites the index arrays by ``mapping`` (old_idx, new_idx), drops features without a
    new index and sorts entries by the new one. Null rows stay null."""
    j = rows.withColumn("__m", index_map(mapping, max_features))
    p = F.expr(f"array_sort(filter(zip_with(`{indices}`, `{values}`, (i, v) -> struct(if(i < 0, null, get(__m, i)) AS i, v AS v)), p -> p.i IS NOT NULL))")
    j = j.withColumn("__p", p)
    return j.withColumn(indices, F.col("__p.i")).withColumn(values, F.col("__p.v")).drop("__p", "__m")


def remap_dense(rows: DataFrame, mapping: DataFrame, width: int, column: str = "x", max_features: int = 2_000_000) -> DataFrame:
    """Dense rows on the outer axis of ``width`` features: NaN where the source has no such
    feature. ``mapping`` (old_idx, new_idx) as above."""
    back = mapping.where("new_idx IS NOT NULL").select(F.col("new_idx").alias("old_idx"), F.col("old_idx").alias("new_idx"))
    j = rows.withColumn("__m", index_map(back, max_features))
    kind = dict(rows.dtypes)[column][6:-1]
    kind = kind if kind in ("float", "double") else promote(kind, "float")
    x = F.expr(f"if(`{column}` IS NULL, null, transform(sequence(0, {width - 1}), j -> coalesce(cast(get(`{column}`, get(__m, j)) AS {kind}), cast('NaN' AS {kind}))))") if width else F.col(column)
    return j.withColumn(column, x).drop("__m")


def align_dense(row: str, old_to_new: list[int | None], width: int) -> Column:
    """A dense row on the outer axis, for a handful of features known to the caller."""
    back: list[int | None] = [None] * width
    for o, n in enumerate(old_to_new):
        if n is not None:
            back[n] = o
    return F.array(*[F.lit(float("nan")) if o is None else F.col(row)[o].cast("double") for o in back])


def subset_axis(var: DataFrame, names: list[str], name: str = "var_name") -> DataFrame:
    """A feature table's rows whose name is asked for, in their own order."""
    keep = var.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "__n string")
    return var.join(keep, F.col(name) == F.col("__n"), "left_semi")


def sparse_elements(df: DataFrame) -> list[str]:
    """The prefixes p of which df has arrays p_indices and p_values: X, layers, raw."""
    t = dict(df.dtypes)
    return [c[:-8] for c in df.columns if c.endswith("_indices") and t[c].startswith("array") and t.get(c[:-8] + "_values", "").startswith("array")]


def subset_features(long: DataFrame, keep: DataFrame, feature: str = "feature") -> DataFrame:
    return long.join(keep.select(feature).distinct(), feature, "left_semi")


MERGE_MODES = (None, "same", "unique", "first", "only")


def merge_attribute(sources: list[tuple[DataFrame, str | None]], mode: str | None, feature: str = "feature") -> DataFrame | None:
    """One attribute of the feature axis from several sources, by feature.

    ``sources``: (features with the attribute, its column or None if the source lacks
    it). None keeps no attribute. same: kept if every source has it and all values of a
    feature's sources agree for all features. unique: kept if there is just one
    distinct set of values over the sources that have it. first: the first source's
    value. only: kept if exactly one source has the attribute. Returns (feature, value),
    or None if the attribute is not kept.

    Values are compared over the outer axis, so a source without a feature disagrees
    with one that has it.
    """
    if mode not in MERGE_MODES:
        raise ValueError(f"merge is one of {MERGE_MODES}")
    have = [(i, s.select(F.col(feature).alias("feature"), F.col(c).alias("value"))) for i, (s, c) in enumerate(sources) if c is not None]
    if mode is None or not have:
        return None
    if mode == "only":
        return have[0][1] if len(have) == 1 else None
    if mode == "first":
        u = None
        for i, s in have:
            d = s.withColumn("src", F.lit(i))
            u = d if u is None else u.unionAll(d)
        return u.groupBy("feature").agg(F.min_by("value", "src").alias("value"))
    if mode == "same" and len(have) < len(sources):
        return None
    axis = None
    for s, _ in sources:
        d = s.select(F.col(feature).alias("feature"))
        axis = d if axis is None else axis.union(d)
    axis = axis.distinct()
    agree = agreement(have, axis, len(have))
    return None if agree.where("NOT agree").limit(1).count() else agree.select("feature", "value")


def agreement(have: list[tuple[int, DataFrame]], axis: DataFrame, n: int) -> DataFrame:
    """feature, value, agree: whether all n sources give the feature the same value."""
    u = None
    for i, s in have:
        d = s.withColumn("src", F.lit(i))
        u = d if u is None else u.unionAll(d)
    g = u.groupBy("feature").agg(F.min_by("value", "src").alias("value"), F.countDistinct("src").alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("real"), F.count(F.lit(1)).alias("all"))
    ok = (F.col("k") == n) & ((F.col("lo").eqNullSafe(F.col("hi"))) & ((F.col("real") == 0) | (F.col("real") == F.col("all"))))
    return axis.join(g, "feature", "left").select("feature", "value", F.coalesce(ok, F.lit(False)).alias("agree"))


def merge_tables(vars_: list[DataFrame], axis: DataFrame, mode: str | None, name: str = "var_name", idx: str = "var_idx") -> DataFrame:
    """The feature table of an outer axis (name, new_idx): var_idx, var_name and the attributes
    that ``mode`` keeps, with nulls for features that only sources without the attribute have."""
    out = axis.select(F.col("new_idx").alias("var_idx"), F.col("name").alias("var_name"))
    for c in dict.fromkeys(c for v in vars_ for c in v.columns if c not in (name, idx)):
        a = merge_attribute([(v, c if c in v.columns else None) for v in vars_], mode, name)
        if a is not None:
            out = out.join(a.select(F.col("feature").alias("__f"), F.col("value").alias(c)), F.col("var_name") == F.col("__f"), "left").drop("__f")
    return out


def merge_by_feature(long: DataFrame, mode: str, n_sources: int) -> DataFrame:
    """The four modes feature by feature on (src, feature, value): same - all n_sources
    agree; unique - the sources that have the feature agree; first - the first source's
    value; only - just one source has the feature."""
    g = long.groupBy("feature").agg(F.countDistinct("src").alias("k"), F.countDistinct("value").alias("d"), F.count("value").alias("c"), F.count(F.lit(1)).alias("n"), F.min_by("value", "src").alias("value"))
    one = (F.col("d") + F.when(F.col("c") < F.col("n"), 1).otherwise(0)) == 1
    keep = {"same": one & (F.col("k") == n_sources), "unique": one, "first": F.lit(True), "only": F.col("k") == 1}[mode]
    return g.where(keep).select("feature", "value")


def union_promoted(sources: list[DataFrame], column: str) -> DataFrame:
    """UNION ALL by name (missing columns null) with one column promoted by NumPy's rules."""
    t = promote(*[dict(s.dtypes)[column] for s in sources])
    u = None
    for s in sources:
        d = s.withColumn(column, F.col(column).cast(t))
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    return u


def concat_rows(sources: list[DataFrame], names: list[str] | None = None, src: str = "src_path") -> DataFrame:
    """Row concatenation by name (outer columns), with the source's name if ``names`` are given."""
    u = None
    for i, s in enumerate(sources):
        d = s.withColumn(src, F.lit(names[i])) if names else s
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    return u


def to_long(rows: DataFrame, obs: str, indices: str = "x_indices", values: str = "x_values") -> DataFrame:
    p = rows.select(F.col(obs).alias("obs"), F.explode(F.arrays_zip(F.col(indices).alias("i"), F.col(values).alias("v"))).alias("p"))
    return p.select("obs", F.col("p.i").alias("feature"), F.col("p.v").alias("value"))


def to_rows(long: DataFrame) -> DataFrame:
    """Long form to rows with sorted index arrays; entries of one place add up."""
    e = long.groupBy("obs", "feature").agg(F.sum("value").alias("value"))
    g = e.groupBy("obs").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("p"))  # one row's features
    return g.select("obs", F.col("p.feature").alias("indices"), F.col("p.value").alias("values"))


def indptr(rows: DataFrame, group: str, pos: str, size: Column) -> DataFrame:
    """group, pos, indptr (entries up to and with the row): a batch's CSR pointers."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(group, pos, F.sum(size.cast("bigint")).over(w).alias("indptr"))


def gather(plan: DataFrame, data: DataFrame, idx: str = "obs_idx") -> DataFrame:
    """Rows of ``data`` in the plan's places; repeats stay, nothing is reordered but by
    the plan's own columns. A plain equi-join: adaptive execution broadcasts a small plan."""
    return plan.join(data, idx)


def csr_arrow(indices, values, width: int | None = None):
    """(data, indices, indptr, shape) of a batch's Arrow list columns; null rows are empty.
    Without ``width`` it is the largest index + 1."""
    import numpy as np

    lens = np.where(indices.is_null().to_numpy(zero_copy_only=False), 0, np.diff(indices.offsets.to_numpy()))
    ptr = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    ind, data = (a.flatten().to_numpy(zero_copy_only=False) for a in (indices, values))  # flatten leaves nulls out
    return data, ind, ptr, (len(lens), width if width is not None else int(ind.max()) + 1 if len(ind) else 0)


def csr_dense(data, ind, ptr, shape):
    """A CSR batch as a dense array; entries of one place add up."""
    import numpy as np

    out = np.zeros(shape, data.dtype)
    np.add.at(out, (np.repeat(np.arange(shape[0]), np.diff(ptr)), ind), data)
    return out
