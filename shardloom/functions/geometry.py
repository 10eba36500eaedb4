"""Sizes: batches, pages, shards, bytes. All plain arithmetic on the driver."""

from __future__ import annotations

import math
import re

from pyspark.sql import types as T


def round_down(n: int, divisor: int) -> int:
    return n - n % divisor


def array_split(n: int, k: int) -> list[int]:
    """Sizes of k nearly equal parts; the first n % k have one more."""
    return [n // k + (i < n % k) for i in range(k)]


def fixed_split(n: int, size: int) -> list[int]:
    """Sizes of parts of ``size``; the last may be shorter."""
    return [min(size, n - a) for a in range(0, n, size)]


def intervals(lengths: list[int]) -> list[tuple[int, int]]:
    """Half-open intervals that consecutive slices fill in their concatenation."""
    out, at = [], 0
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def check_at_least_1(**values: int) -> None:
    for name, v in values.items():
        if v < 1:
            raise ValueError(f"{name} must be at least 1, not {v}")


def check_preload(chunk_size: int, preload_nchunks: int, batch_size: int) -> None:
    """chunk_size, preload_nchunks, batch_size >= 1; a request holds a whole number of batches."""
    check_at_least_1(chunk_size=chunk_size, preload_nchunks=preload_nchunks, batch_size=batch_size)
    m = chunk_size * preload_nchunks
    if batch_size > m:
        raise ValueError(f"batch_size {batch_size} is larger than a request of {m} rows")
    if m % batch_size:
        raise ValueError(f"a request of {m} rows is no multiple of batch_size {batch_size}")


def resolve_mask(mask: slice | None, n_obs: int | None = None) -> tuple[int, int | None]:
    """Half-open [start, stop) of a mask; stop None means n_obs."""
    mask = mask or slice(0, None)
    if mask.step not in (None, 1):
        raise ValueError("a mask's step must be 1")
    start, stop = mask.start or 0, mask.stop
    if start < 0:
        raise ValueError("a mask starts at 0 or later")
    if stop is not None and start >= stop:
        raise ValueError("a mask's start must be below its stop")
    if n_obs is not None:
        stop = n_obs if stop is None else stop
        if stop > n_obs:
            raise ValueError(f"the mask stops at {stop} but there are {n_obs} rows")
        if start >= stop:
            raise ValueError("the mask has no rows")
    return start, stop


_UNITS = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4, "P": 5}


def parse_bytes(size: str) -> int:
    """'1KB' = 1024; K, M, G, T, P, with or without B or iB, case and blanks ignored."""
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([KMGTP]?)(?:I?B)?\s*", size.upper())
    if not m:
        raise ValueError(f"no size: {size!r}")
    return int(float(m[1]) * 1024 ** _UNITS[m[2]])


def shard_rows(size: int | str, element_bytes: float, n_rows: int) -> int:
    """A shard's size in rows: an int is rows; a string is bytes; at least 1."""
    if isinstance(size, int):
        return size
    if not n_rows or not element_bytes:
        return 1
    return max(1, int(parse_bytes(size) / (element_bytes / n_rows)))


def dense_geometry(n: int, page: int, shard: int) -> tuple[int, int]:
    """Rows of a page and a shard of a dense element of n rows."""
    if n < 1:
        raise ValueError("nothing to write: 0 rows")
    c = min(page, n)
    return c, max(c, round_down(min(shard, n), c))


def sparse_geometry(n: int, nnz: int, page: int, shard: int) -> tuple[int, int]:
    """Entries of a page and a shard of a sparse element of n rows and nnz entries."""
    if n < 1:
        raise ValueError("nothing to write: 0 rows")
    avg = nnz / n
    c = min(max(1, int(page * avg)), max(1, nnz))
    s = min(max(1, int(shard * avg)), max(1, nnz))
    return c, max(c, round_down(s, c))


ITEM = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8}


def sparse_row_bytes(n: int, nnz: int, data: str = "float", index: str = "int", pointer: str = "bigint") -> float:
    """(nnz * (data + index) + pointers) / n."""
    return (nnz * (ITEM[data] + ITEM[index]) + (n + 1) * ITEM[pointer]) / n if n else 0.0


def dense_row_bytes(shape: tuple[int, ...], dtype: str) -> int:
    return math.prod(shape[1:]) * ITEM[dtype]


def table_row_bytes(schema: T.StructType, categories: frozenset[str] = frozenset()) -> int:
    """Bytes of a row's fixed-width columns; a categorical column counts as its code,
    other strings as a pointer, nested columns are skipped."""
    total = 0
    for f in schema.fields:
        t = f.dataType.simpleString()
        if f.name in categories:
            total += 4
        elif t in ITEM:
            total += ITEM[t]
        elif t in ("string", "timestamp", "timestamp_ntz", "date"):
            total += 8
    return total


_ORDER = ["boolean", "tinyint", "smallint", "int", "bigint"]


def promote(*types: str) -> str:
    """The type that holds all, by NumPy's rules: smallint and float make float, wider
    integers and float make double."""
    kinds = set(types)
    unknown = kinds - set(ITEM)
    if unknown:
        raise TypeError(f"no numeric type: {sorted(unknown)}")
    if "double" in kinds:
        return "double"
    if "float" in kinds:
        return "double" if kinds & {"int", "bigint"} else "float"
    return max(kinds, key=_ORDER.index)


def delivery_type(dtype: str) -> str:
    """Sparse values for a device: float, double and boolean stay, narrower than 4 bytes
    become float, the rest double."""
    if dtype in ("float", "double", "boolean"):
        return dtype
    return "float" if ITEM[dtype] < 4 else "double"


def dataset_number(name: str) -> int | None:
    """The number in 'dataset_<i>' or 'dataset=<i>', else None."""
    m = re.fullmatch(r"dataset[_=]([0-9]+)", name)
    return int(m[1]) if m else None


def lcm_group(chunk_size: int, batch_size: int) -> int:
    """Chunks after which a chunk edge is a batch edge again."""
    return batch_size // math.gcd(chunk_size, batch_size)
