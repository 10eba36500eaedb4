"""Collections on disk: folders of Parquet datasets under numbered manifests.

    root/v<k>-<id>/dataset=<i>/part-*.parquet    columns row, obs_idx, obs_name, ... , x_*
    root/var-<k>-<id>/                           var_idx, var_name and merged attributes
    root/manifest-<k>.json                       {"version": k, "folders": [...], "sizes": {i: rows}, "var": ...}

The manifest of the highest number holds. A manifest is written aside and renamed into
place, and the rename fails if its number is taken: of two writers that started from the
same version one commits and the other raises, readers see the old or the new version and
never none, and a writer that dies leaves only folders that no manifest names (``vacuum``
removes them). Data folders have a unique suffix, so nothing has to be cleaned up before
the next try.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import geometry as g
from shardloom.operators import census, matrix
from shardloom.operators.index import dense_index_by, partitions_for
from shardloom.operators.shuffling import assign_blocks, range_rows, unique_names, with_codes
from shardloom.session import materialize

CODECS = {"lz4": "lz4_raw", "zstd": "zstd", "snappy": "snappy", "gzip": "gzip", "none": "uncompressed"}


class Files:
    """The few file operations needed, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, rel: str = ""):
        return self._path(f"{self.root}/{rel}" if rel else self.root)

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self.path(rel))

    def read(self, rel: str) -> str:
        stream = self.fs.open(self.path(rel))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def commit(self, rel: str, text: str) -> None:
        """The file ``rel`` with this text, whole or not at all; raises if it is there."""
        aside = f".{rel}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self.path(aside), self.path(rel), options)
        except Exception as e:
            self.fs.delete(self.path(aside), False)
            raise FileExistsError(f"{rel}: another writer was first, or the rename failed") from e

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path())] if self.fs.exists(self.path()) else []

    def delete(self, rel: str) -> None:
        self.fs.delete(self.path(rel), True)


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """The default opener: Parquet, or by extension ORC, JSON lines or CSV with a header."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "orc":
        return spark.read.orc(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.parquet(path)


class Collection:
    """A preshuffled collection of row-annotated matrices."""

    def __init__(self, spark: SparkSession, root: str):
        if not isinstance(root, str):
            raise TypeError("root is a path")
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # -- reading ---------------------------------------------------------------
    @property
    def manifest(self) -> dict:
        k = max((int(m[1]) for n in self.files.names() if (m := re.fullmatch(r"manifest-([0-9]+)\.json", n))), default=None)
        return {} if k is None else json.loads(self.files.read(f"manifest-{k}.json"))

    @property
    def sizes(self) -> dict[int, int]:
        return {int(k): n for k, n in sorted(self.manifest.get("sizes", {}).items(), key=lambda x: int(x[0]))}

    @property
    def is_empty(self) -> bool:
        return not self.sizes

    @property
    def n_obs(self) -> int:
        return sum(self.sizes.values())

    @property
    def var(self) -> DataFrame | None:
        """The feature table (var_idx, var_name, attributes), if the collection has one."""
        return self._side("var")

    @property
    def raw_var(self) -> DataFrame | None:
        """The feature table of the ``raw`` element."""
        return self._side("raw_var")

    def _side(self, which: str) -> DataFrame | None:
        at = self.manifest.get(which)
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def __iter__(self) -> Iterator[DataFrame]:
        for i in self.sizes:
            yield self.read().where(F.col("dataset") == i)

    def read(self) -> DataFrame:
        """All rows, with dataset and row; empty collections raise."""
        return self._read(self.manifest)

    def _read(self, m: dict) -> DataFrame:
        if not m.get("sizes"):
            raise ValueError(f"{self.root} is empty")
        u = None
        for at in m["folders"]:  # one, and one for each addition beside it
            d = self.spark.read.schema(m["schema"]).parquet(f"{self.root}/{at}")
            u = d if u is None else u.unionByName(d)
        return u

    def obs(self, columns: list[str] | None = None) -> DataFrame:
        """Columns in the order asked for (unknown ones are ignored), with dataset and row to
        order by; only those are read. No columns or no datasets give an empty frame."""
        if self.is_empty:
            return self.spark.createDataFrame([], "dataset int, row bigint")
        d = self.read()
        own = [c for c in d.columns if c not in ("dataset", "row") and not c.endswith(("_indices", "_values"))]
        pick = own if columns is None else [c for c in columns if c in own]
        d = d.select("dataset", "row", *pick)
        return d.limit(0) if columns is not None and not pick else d

    def indexed(self) -> DataFrame:
        """All rows with ``obs_idx``, the ordinal over datasets in order; by a lookup of the
        dataset's offset, without a shuffle."""
        off = _starts(self.sizes)
        m = F.create_map(*[F.lit(x) for kv in off.items() for x in kv])
        return self.read().withColumn("obs_idx", m[F.col("dataset")].cast("bigint") + F.col("row"))

    def fetch(self, ranges: list[slice], max_predicates: int = 512) -> DataFrame:
        """The rows of global half-open ranges, with obs_idx. Each range becomes (dataset, row
        range) predicates that prune partitions and, as files are sorted by row, row
        groups; ranges that touch are one. More than ``max_predicates`` are joined instead. A
        row that several ranges name comes once (use a plan for repeats)."""
        starts, sizes = _starts(self.sizes), self.sizes
        if any(r.step not in (None, 1) or (r.start or 0) < 0 or (r.stop is not None and r.stop > self.n_obs) for r in ranges):
            raise ValueError("ranges have step 1 and lie within the rows")
        merged: list[list[int]] = []
        for a, z in sorted((r.start or 0, self.n_obs if r.stop is None else r.stop) for r in ranges):
            if z > a and merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            elif z > a:
                merged.append([a, z])
        parts = [(k, max(a, starts[k]) - starts[k], min(z, starts[k] + n) - starts[k]) for a, z in merged for k, n in sizes.items() if a < starts[k] + n and z > starts[k]]
        if not parts:
            return self.indexed().limit(0)
        if len(parts) <= max_predicates:
            hit = " OR ".join(f"(dataset = {k} AND `row` >= {a} AND `row` < {z})" for k, a, z in parts)  # the parser makes it a balanced tree
            return self.indexed().where(hit)
        from shardloom.operators.index import expand

        t = self.spark.createDataFrame(parts, "dataset int, start bigint, stop bigint")
        return self.indexed().join(expand(t, out="row").select("dataset", "row"), ["dataset", "row"], "left_semi")

    # -- writing ---------------------------------------------------------------
    def add(self, sources: list[str | DataFrame], *, load: Callable[[SparkSession, str], DataFrame] = read_source, vars_: list[DataFrame] | None = None, raw_vars: list[DataFrame] | None = None, merge: str | None = None, name: str = "obs_name", order: list[str] | None = None, groupby: str | list[str] | None = None, categories: dict[str, list[str]] | list[dict[str, list[str]]] | None = None, var_subset: list | None = None, dataset_size: int | str = "20GB", block: int = 1000, page: int = 64, codec: str = "lz4", shuffle: bool = True, seed: int = 7, provenance: str | None = "src_path", spread: bool = True, token: tuple[str, int] | None = None) -> Collection:
        """Create the collection, or append to it if it has rows.

        Sources are paths (opened by ``load``) or DataFrames. Rows are concatenated by
        column name in the order of the sources, then by ``order`` (a unique key within a
        source; by default the name).

        *Features.* ``vars_`` has each source's feature table (var_idx, var_name, attributes).
        A new collection gets the outer join of the names, in order of first appearance,
        and of the attributes what ``merge`` keeps (None, same, unique, first, only). Rows are
        rewritten to that axis: an absent sparse entry is none, an absent dense value (column x)
        NaN. ``<layer>_indices`` and ``<layer>_values`` are layers on the same axis; ``raw_*`` has an axis of
        its own, ``raw_vars``. Appended sources are cut to the stored names and the stored feature
        table stays. Without feature tables indices are taken as they are; a collection has
        feature tables for all of its sources or for none.
        ``var_subset`` keeps features by name (by index, without feature tables).

        *Order.* ``categories`` orders the values of columns, for all sources or for each; of
        ``groupby`` columns they must agree, of others they are united, also with the stored
        ones. dataset_size and block as in ``block_plan``; on an append dataset_size is ignored and blocks are dealt
        over the datasets there are, which are written anew, or with ``spread=False`` become
        new datasets beside them.

        ``token`` (stream, number) is kept in the manifest: numbers up to the last one
        committed of that stream do nothing.
        """
        before = self.manifest
        if token and before.get("tokens", {}).get(token[0], -1) >= token[1]:
            return self
        fresh = not before.get("sizes")
        cols = census.normalize_groupby(groupby)
        names = [s if isinstance(s, str) else f"source_{i}" for i, s in enumerate(sources)]
        if not names:
            raise ValueError("no sources")
        frames = [load(self.spark, s) if isinstance(s, str) else s for s in sources]
        keyed = {f"{i}: {n}": f for i, (n, f) in enumerate(zip(names, frames))}
        census.warn_missing(keyed)
        own = categories if isinstance(categories, list) else [categories or {}] * len(frames)
        if len(own) != len(frames):
            raise ValueError("categories for each source, or for all")
        said = dict(zip(keyed, own))
        check = dict(keyed)
        if not fresh:
            check["(stored)"], said["(stored)"] = self._read(before), before.get("categories", {})
        if cols:
            census.check_groupby(check, cols, said)
        lists: dict[str, list[list[str]]] = {}
        for c in [*([said["(stored)"]] if not fresh else []), *own]:
            for k, v in c.items():
                lists.setdefault(k, []).append(list(v))
        united = {k: census.union_categories(v) for k, v in lists.items()}

        counts = [f.count() for f in frames]
        n = sum(counts)
        if not n:
            raise ValueError("nothing to write: 0 rows")
        row_bytes = sum(bytes_per_row(f, frozenset(united)) for f in frames) / len(frames)
        raw = [matrix.RAW]
        frames, var = self._align(frames, vars_, before.get("var"), fresh, merge, var_subset, lambda f: [e for e in matrix.sparse_elements(f) if e not in raw], "x")
        if raw_vars is not None or before.get("raw_var"):
            frames, raw_var = self._align(frames, raw_vars, before.get("raw_var"), fresh, merge, None, lambda f: [e for e in matrix.sparse_elements(f) if e in raw], None)
        else:
            raw_var = None
        rows = matrix.concat_rows([f.withColumn("__src", F.lit(i)) for i, f in enumerate(frames)], names if provenance else None, provenance or "src_path")
        rows = dense_index_by(rows.drop("obs_idx", "dataset", "row"), ["__src", *(order or [name])], n=n, row_bytes=row_bytes).drop("__src")
        folders, base, first = [], 0, 0
        if fresh:
            size = dataset_size if isinstance(dataset_size, int) else max(1, int(g.parse_bytes(dataset_size) / max(1, row_bytes)))
            how = {"dataset_size": max(min(n, size), min(block, n))}
            total = n
        else:
            k = len(before["sizes"])
            base = before["next"]
            how = {"n_datasets": k} if spread else {"dataset_size": max(block, max(before["sizes"].values()))}
            first = 0 if spread else k
            total = n + (sum(before["sizes"].values()) if spread else 0)
            folders = [] if spread else before["folders"]
        placed = assign_blocks(rows, n, min(block, n) if fresh else block, shuffle=shuffle, seed=seed, **how)
        placed = placed.withColumn("dataset", F.col("dataset") + first).withColumn("obs_idx", F.col("obs_idx") + base)
        if not fresh and spread:
            placed = self._read(before).drop("row").unionByName(placed, allowMissingColumns=True)
        if name in placed.columns:
            taken = None if fresh or spread else self._read(before).select(name)
            placed = unique_names(placed, name, taken=taken)
        sort = [c for c in cols if c in united]
        for c in sort:
            placed = with_codes(placed, c, united[c], f"__{c}")
        keys = [f"__{c}" if c in united else c for c in cols]
        parts = max(partitions_for(placed, total, row_bytes), 1)
        placed = range_rows(placed, parts, shuffle=shuffle, groupby=keys, seed=seed).drop(*[f"__{c}" for c in sort])
        return self._write(placed, before, folders, page, codec, var=var, raw_var=raw_var, categories=united, token=token)

    def _align(self, frames: list[DataFrame], vars_: list[DataFrame] | None, stored: str | None, fresh: bool, merge: str | None, subset: list | None, elements: Callable[[DataFrame], list[str]], dense: str | None) -> tuple[list[DataFrame], DataFrame | str | None]:
        """The frames on one feature axis, and its feature table (a path if it is stored)."""
        if vars_ is None:
            if stored:
                raise ValueError("the collection has features: give those of the sources")
            if subset is not None:
                keep = F.array(*[F.lit(int(v)) for v in subset])
                out = []
                for f in frames:
                    for e in elements(f):
                        p = F.filter(F.arrays_zip(F.col(f"{e}_indices").alias("i"), F.col(f"{e}_values").alias("v")), lambda p: F.array_contains(keep, p["i"]))
                        f = f.withColumn("__p", p).withColumn(f"{e}_indices", F.col("__p.i")).withColumn(f"{e}_values", F.col("__p.v")).drop("__p")
                    out.append(f)
                frames = out
            return frames, None
        if len(vars_) != len(frames):
            raise ValueError("one feature table for each source")
        if not fresh and not stored:
            raise ValueError("the collection has no features, so none can be given")
        for v in vars_:
            census.check_axis(v)
        if subset is not None:
            vars_ = [matrix.subset_axis(v, subset) for v in vars_]
        if stored:
            kept = self.spark.read.parquet(f"{self.root}/{stored}")
            axis, table = kept.select(F.col("var_name").alias("name"), F.col("var_idx").alias("new_idx")), stored
        else:
            axis = materialize(matrix.feature_axis(vars_), "axis")
            table = matrix.merge_tables(vars_, axis, merge)
        width = axis.count()
        out = []
        for f, v in zip(frames, vars_):
            m = v.join(axis, F.col("var_name") == F.col("name")).select(F.col("var_idx").alias("old_idx"), "new_idx")
            for e in elements(f):
                f = matrix.remap_rows(f, m, f"{e}_indices", f"{e}_values")
            if dense and dict(f.dtypes).get(dense, "").startswith("array") and not dict(f.dtypes)[dense].startswith("array<array"):
                f = matrix.remap_dense(f, m, width, dense)
            out.append(f)
        return out, table

    def _write(self, placed: DataFrame, before: dict, folders: list[str], page: int, codec: str, *, var: DataFrame | str | None, raw_var: DataFrame | str | None, categories: dict, token: tuple[str, int] | None) -> Collection:
        version = before.get("version", 0) + 1
        mark = f"{version}-{uuid.uuid4().hex[:12]}"
        d = placed.withColumn("dataset", F.col("dataset").cast("int"))
        out = f"{self.root}/v{mark}"
        # Rows are in partitions of consecutive (dataset, row) already, so files are row ranges.
        d.write.option("compression", CODECS.get(codec, codec)).option("parquet.page.row.count.limit", str(max(1, page))).partitionBy("dataset").parquet(out)
        sides = {"var": var, "raw_var": raw_var}
        for k, v in sides.items():
            if isinstance(v, DataFrame):
                v.repartition(1).sortWithinPartitions("var_idx").write.parquet(f"{self.root}/{k}-{mark}")
                sides[k] = f"{k}-{mark}"
        back = self.spark.read.schema(d.schema).parquet(out)
        stats = back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max("obs_idx").alias("last")).collect()  # one row a dataset
        sizes = dict(before.get("sizes", {})) if folders else {}
        sizes |= {str(r["dataset"]): r["n"] for r in sorted(stats, key=lambda r: r["dataset"])}
        old = {f.name: f for f in self._read(before).schema.fields} if folders else {}
        fields = {**old, **{f.name: f for f in d.schema.fields}}
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.values())
        tokens = dict(before.get("tokens", {})) | ({token[0]: token[1]} if token else {})
        info = {"version": version, "folders": [*folders, f"v{mark}"], "sizes": sizes, "next": max([before.get("next", 0) - 1, *(r["last"] for r in stats)]) + 1, "schema": ddl, "categories": categories, "tokens": tokens, **sides}
        self.files.commit(f"manifest-{version}.json", json.dumps(info))
        return self

    def vacuum(self) -> None:
        """Remove older versions and what writers that failed left behind. Readers of older
        versions and writers at work lose their files, so run it when there are none; without
        a manifest nothing is removed."""
        now = self.manifest
        if not now:
            return
        keep = {*now["folders"], now.get("var"), now.get("raw_var"), f"manifest-{now['version']}.json"}
        for n in self.files.names():
            if n not in keep and re.fullmatch(r"(v|var-|raw_var-)[0-9]+-[0-9a-f]+|\.?manifest-[0-9]+\.json.*", n):
                self.files.delete(n)


def bytes_per_row(df: DataFrame, categories: frozenset[str] = frozenset()) -> float:
    """Estimated bytes of a row: fixed-width columns, the mean bytes of strings (categorical
    ones count as their code) and the mean length of arrays; other kinds of columns raise."""
    total, measured = 0.0, {}
    for c, t in df.dtypes:
        if c in categories:
            total += 4
        elif t in g.ITEM:
            total += g.ITEM[t]
        elif t in ("timestamp", "timestamp_ntz", "date"):
            total += 8
        elif t in ("string", "binary"):
            measured[c] = (F.avg(F.octet_length(F.col(c))), 1)
        elif t.startswith("array<"):
            inner, size = t[6:-1], F.size(c)
            while inner.startswith("array<"):  # N-d rows: all have one shape
                inner, size = inner[6:-1], F.size(F.flatten(F.col(c))) if t.count("array<") == 2 else size
            measured[c] = (F.avg(F.when(F.col(c).isNotNull(), size).otherwise(0)), g.ITEM.get(inner, 8))
        elif t.startswith("decimal"):
            total += 16
        elif t.startswith(("struct", "map", "variant")):
            measured[c] = (F.avg(F.octet_length(F.to_json(c))), 1)
        else:
            raise TypeError(f"the size of {c} {t} is not known")
    if measured:
        avg = df.agg(*[a.alias(f"c{i}") for i, (a, _) in enumerate(measured.values())]).first()
        total += sum((avg[i] or 0) * w for i, (_, w) in enumerate(measured.values()))
    return total


def _starts(sizes: dict[int, int]) -> dict[int, int]:
    out, at = {}, 0
    for k in sorted(sizes):
        out[k] = at
        at += sizes[k]
    return out


def write_sharded(df: DataFrame, out: str, *, rows_per_page: int = 64, shard_size: int | str = "1GB", codec: str = "lz4") -> tuple[int, int]:
    """One matrix as files of ``shard_size`` (rows, or bytes as text) and pages of
    ``rows_per_page`` rows; returns (page, shard) in rows. Zero rows raise."""
    n = df.count()
    if isinstance(shard_size, str):
        shard_size = g.shard_rows(shard_size, bytes_per_row(df) * n, n)
    page, shard = g.dense_geometry(n, rows_per_page, shard_size)
    df.write.option("compression", CODECS.get(codec, codec)).option("maxRecordsPerFile", shard).option("parquet.page.row.count.limit", str(page)).parquet(out)
    return page, shard
