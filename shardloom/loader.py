"""Loader: batches of a collection or of DataFrames in exactly the order of a plan.

A collection's epoch without replacement is delivered window by window: the chunks of some
requests are row ranges of its files, which are fetched by partition and row-group pruning
and batched, while the next window is being fetched. Nothing is shuffled but the rows of
one window. Other plans, and DataFrames, which have no order on disk, are ranged by batch.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.geometry import check_at_least_1
from shardloom.operators import census, matrix
from shardloom.operators.index import dense_index_by
from shardloom.plans.samplers import Sampler, default_sampler
from shardloom.session import discard, materialize
from shardloom.sources.collection import Collection

#: Rows that are delivered at once.
WINDOW_ROWS = 100_000
#: Chunks, and so ranges, of one scan.
WINDOW_CHUNKS = 256
#: Windows that are fetched at once while one is delivered.
AHEAD = 4


class Loader:
    """Registers datasets and delivers batches {"X", "obs", "var", "index"}.

    Give either ``sampler`` or the sampler's own settings. Registering is all or nothing:
    a dataset whose features or X type differ, or a sampler that does not fit the new total,
    raises and leaves the loader as it was.
    """

    def __init__(self, sampler: Sampler | None = None, *, chunk_size: int | None = None, preload_nchunks: int | None = None, batch_size: int | None = None, shuffle: bool | None = None, drop_last: bool | None = None, seed: int = 7, return_index: bool = False, to: str = "csr"):
        own = {"chunk_size": chunk_size, "preload_nchunks": preload_nchunks, "batch_size": batch_size, "shuffle": shuffle, "drop_last": drop_last}
        given = {k: v for k, v in own.items() if v is not None}
        if sampler is not None and given:
            raise ValueError(f"give a sampler or {sorted(given)}, not both")
        check_at_least_1(**{k: v for k, v in given.items() if k in ("chunk_size", "preload_nchunks", "batch_size")})
        if to not in ("csr", "dense", "rows"):
            raise ValueError("to is csr, dense or rows")
        self.sampler = sampler or default_sampler(**given, seed=seed)
        self.return_index, self.to = return_index, to
        self._rows: DataFrame | None = None
        self._var: DataFrame | None = None
        self._n = 0
        self._from_collection = False
        self._fetch: Callable | None = None
        self._x: str | None = None

    # -- registering -----------------------------------------------------------
    def use_collection(self, collection: Collection, load: Callable[[DataFrame], DataFrame] | None = None, var: DataFrame | None = None) -> Loader:
        """Use a collection, once and as the only source."""
        if self._from_collection or self._rows is not None:
            raise RuntimeError("a loader takes one collection and nothing else")
        if collection.is_empty:
            raise ValueError("the collection is empty")
        rows = collection.indexed()
        rows = load(rows) if load else rows
        self._accept(rows, collection.n_obs, collection.var if var is None else var)
        self._from_collection = True
        self._fetch = lambda ranges: load(collection.fetch(ranges)) if load else collection.fetch(ranges)
        return self

    def add_datasets(self, datasets: list[DataFrame], order: str | list[str], vars_: list[DataFrame] | None = None) -> Loader:
        """Add DataFrames (rows in the order of the unique key ``order``), all or none."""
        if self._from_collection:
            raise RuntimeError("this loader has a collection")
        keys = [order] if isinstance(order, str) else list(order)
        if vars_ and len(vars_) != len(datasets):
            raise ValueError("one feature table for each dataset, or none")
        if (self._var is not None and not vars_) or (self._rows is not None and self._var is None and vars_):
            raise ValueError("features are given for all datasets or for none")
        for v in vars_ or []:
            census.check_axis(v)
        census.same_features([v for v in [self._var, *(vars_ or [])] if v is not None])
        kinds = {self._kind(d) for d in datasets} | ({self._x} if self._x else set())
        if len(kinds) > 1:
            raise TypeError(f"X differs between datasets: {sorted(map(str, kinds))}")
        rows, n = self._rows, self._n
        for d in datasets:
            own = d.count()
            i = dense_index_by(d, keys, n=own).withColumn("obs_idx", F.col("obs_idx") + n)
            n += own
            rows = i if rows is None else matrix.union_promoted([rows, i], "x") if kinds == {"dense scalar"} else rows.unionByName(i, allowMissingColumns=True)
        if rows is None:
            raise ValueError("no datasets")
        self._accept(rows, n, vars_[0] if vars_ else self._var)
        self._x = kinds.pop()
        return self

    def add_dataset(self, dataset: DataFrame, order: str | list[str], var: DataFrame | None = None) -> Loader:
        return self.add_datasets([dataset], order, [var] if var is not None else None)

    @staticmethod
    def _kind(d: DataFrame) -> str:
        t = dict(d.dtypes)
        if "x_indices" in t:
            if not t["x_indices"].startswith("array") or not t.get("x_values", "").startswith("array"):
                raise TypeError("x_indices and x_values are arrays")
            return f"sparse {t['x_values']}"
        return f"dense {t['x']}" if t.get("x", "").startswith("array") else "dense scalar" if "x" in t else "none"

    def _accept(self, rows: DataFrame, n: int, var: DataFrame | None) -> None:
        self.sampler.validate(n)  # before anything changes
        self._rows, self._n, self._var = rows, n, var

    # -- facts -----------------------------------------------------------------
    @property
    def n_obs(self) -> int:
        return self._n

    @property
    def n_var(self) -> int:
        if self._var is None:
            raise ValueError("no features are registered")
        return self._var.count()

    @property
    def var(self) -> DataFrame | None:
        return self._var

    def __len__(self) -> int:
        return self.sampler.n_batches(self._n)

    # -- delivery --------------------------------------------------------------
    def rows(self) -> DataFrame:
        """Every delivered row with batch_id and pos_in_batch, in no order."""
        if self._rows is None or not self._n:
            raise ValueError("no rows are registered")
        s = self._epoch()
        if hasattr(s, "annotate") and not getattr(s, "replacement", False):
            return s.annotate(self._rows, self._n)
        return matrix.gather(s.plan(self._rows.sparkSession, self._n), self._rows)

    def _epoch(self) -> Sampler:
        s = self.sampler
        while hasattr(s, "masked"):  # a rank's shard is a mask of its own sampler
            s = s.masked(self._n)
        return s

    def map_batches(self, fn: Callable, schema: str) -> DataFrame:
        """``fn(pandas rows of one batch) -> pandas`` on the executors, a batch at a time."""
        def one(pdf):
            return fn(pdf.sort_values("pos_in_batch", ignore_index=True))

        return self.rows().groupBy("batch_id").applyInPandas(one, schema)

    def __iter__(self) -> Iterator[dict]:
        """Batches in order. Every batch is packed into one Arrow buffer on the executors, so
        the driver fetches a few large rows: one window or partition at a time, the next
        one meanwhile."""
        if self._rows is None or not self._n:
            raise ValueError("no rows are registered")
        extra = {"obs_idx", "request_id", "pos", "batch_id", "pos_in_batch", "dataset", "row"}
        names = [c for c in self._rows.columns if c not in extra and not c.endswith(("_indices", "_values")) and c != "x"]
        width = self.n_var if self._var is not None else None
        s = self._epoch()
        if self._fetch is not None and hasattr(s, "chunks") and not s.replacement and s.num_workers == 1:
            bodies = self._windows(s)
        else:
            n = max(1, min(len(self), -(-self._n // WINDOW_ROWS)))
            ordered = self.rows().repartitionByRange(n, "batch_id").sortWithinPartitions("batch_id", "pos_in_batch")
            bodies = (r["body"] for r in ordered.mapInArrow(pack_batches, "batch_id bigint, body binary").toLocalIterator(prefetchPartitions=True))
        for body in bodies:
            yield self._batch(pa.ipc.open_stream(body).read_all(), names, width)

    def _windows(self, s: Sampler) -> Iterator[bytes]:
        """The packed batches of an epoch, by windows of whole requests: about ``WINDOW_ROWS`` rows, and no
        more chunks than ranges that a scan is pruned by."""
        spark, n = self._rows.sparkSession, self._n
        chunks = materialize(s.chunks(spark, n), "chunks")
        each = max(1, min(WINDOW_ROWS // (s.chunk_size * s.preload_nchunks), WINDOW_CHUNKS // s.preload_nchunks)) * s.preload_nchunks  # chunks a window
        visits = chunks.orderBy("visit_rank").select("start", "stop").toLocalIterator()

        def fetch(ranges: list[slice]) -> list[tuple[int, bytes]]:
            d = s.annotate(self._fetch(ranges), n, chunks=chunks)
            parts = max(1, min(spark.sparkContext.defaultParallelism, sum(r.stop - r.start for r in ranges) // 4096))
            d = d.repartition(parts, "batch_id").sortWithinPartitions("batch_id", "pos_in_batch")
            return sorted(((r["batch_id"], r["body"]) for r in d.mapInArrow(pack_batches, "batch_id bigint, body binary").collect()), key=lambda x: x[0])  # a window

        with ThreadPoolExecutor(AHEAD) as pool:
            ahead: deque = deque()
            while True:
                while len(ahead) <= AHEAD and (ranges := [slice(r["start"], r["stop"]) for r in islice(visits, each)]):
                    ahead.append(pool.submit(fetch, ranges))
                if not ahead:
                    break
                yield from (body for _, body in ahead.popleft().result())
        discard(chunks)

    def _batch(self, t: pa.Table, names: list[str], width: int | None) -> dict:
        out: dict = {"obs": t.select(names).to_pandas() if names else None, "var": self._var, "index": t["obs_idx"].to_numpy() if self.return_index else None}
        if "x_indices" in t.column_names:
            x = matrix.csr_arrow(t["x_indices"].combine_chunks(), t["x_values"].combine_chunks(), width)
            out["X"] = x if self.to == "csr" else matrix.csr_dense(*x) if self.to == "dense" else t.select(["x_indices", "x_values"]).to_pandas()
        elif "x" in t.column_names and self.to != "rows" and pa.types.is_list(t["x"].type):
            out["X"] = dense_rows(t["x"].combine_chunks())
        else:
            out["X"] = t["x"].to_numpy() if "x" in t.column_names else None
        return out


def dense_rows(x: pa.Array) -> np.ndarray:
    """Dense rows of one shape, of any number of dimensions, as one array."""
    shape = [len(x)]
    while pa.types.is_list(x.type):
        inner = x.flatten()
        shape.append(len(inner) // max(1, len(x)))
        x = inner
    return x.to_numpy(zero_copy_only=False).reshape(shape)


def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch_id -> one row a batch with its rows as an Arrow stream."""

    def pack(t: pa.Table) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return pa.RecordBatch.from_arrays([pa.array([t["batch_id"][0].as_py()], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch_id", "body"])

    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        ids = b.column("batch_id").to_numpy()
        if not len(ids):
            continue
        cut = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, z in zip(cut, cut[1:]):
            if held and ids[a] != now:
                yield pack(pa.Table.from_batches(held))
                held = []
            now = ids[a]
            held.append(b.slice(a, z - a))
    if held:
        yield pack(pa.Table.from_batches(held))
