"""Checks across the files of an ingest: metadata only, no rows are read."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_census(sources: dict[str, DataFrame]) -> DataFrame:
    """key, n_sources: how many sources have each column."""
    spark = next(iter(sources.values())).sparkSession
    rows = [(s, k) for s, d in sources.items() for k in d.columns]
    t = spark.createDataFrame(rows, "source string, key string")
    return t.groupBy("key").agg(F.countDistinct("source").alias("n_sources"))


def warn_missing(sources: dict[str, DataFrame]) -> list[str]:
    """Warns of columns that only some sources have; returns them."""
    seen: dict[str, int] = {}
    for d in sources.values():
        for k in d.columns:
            seen[k] = seen.get(k, 0) + 1
    some = sorted(k for k, n in seen.items() if n < len(sources))
    if some:
        warnings.warn(f"not in every source, null where missing: {', '.join(some)}", stacklevel=2)
    return some


def normalize_groupby(groupby: str | list[str] | None) -> list[str]:
    cols = [groupby] if isinstance(groupby, str) else list(groupby or [])
    if groupby is not None and not cols:
        raise ValueError("groupby names no column")
    if len(set(cols)) < len(cols):
        raise ValueError("groupby names a column twice")
    return cols


def check_groupby(sources: dict[str, DataFrame], groupby: list[str], categories: dict[str, dict[str, list[str]]] | None = None) -> None:
    """Sort columns must be in all sources; where they are categorical they must be so
    everywhere, with the same categories in the same order. categories[source][column]."""
    for c in groupby:
        have = [s for s, d in sources.items() if c in d.columns]
        if not have:
            raise ValueError(f"groupby column {c!r} is in no source")
        if len(have) < len(sources):
            raise ValueError(f"groupby column {c!r} is missing in {sorted(set(sources) - set(have))}")
        cats = [(categories or {}).get(s, {}).get(c) for s in sources]
        if any(x is None for x in cats) and not all(x is None for x in cats):
            raise ValueError(f"groupby column {c!r} is categorical in some sources only")
        if any(x != cats[0] for x in cats):
            raise ValueError(f"categories of {c!r} differ")


def same_features(vars_: list[DataFrame], name: str = "var_name", idx: str = "var_idx") -> None:
    """Raises unless all feature axes have the same names in the same order."""
    if len(vars_) < 2:
        return
    first = vars_[0].select(F.col(idx).cast("bigint").alias("i"), F.col(name).alias("n"))
    for v in vars_[1:]:
        d = v.select(F.col(idx).cast("bigint").alias("i"), F.col(name).alias("n"))
        if first.exceptAll(d).limit(1).count() or d.exceptAll(first).limit(1).count():
            raise ValueError("features differ between datasets")


def check_axis(var: DataFrame, name: str = "var_name", idx: str = "var_idx") -> None:
    """Raises unless a feature table has names and indices of the right kinds, neither null nor twice."""
    t = dict(var.dtypes)
    if t.get(name) != "string" or t.get(idx) not in ("int", "bigint", "smallint"):
        raise TypeError(f"a feature table has {name} (string) and {idx} (integer), not {t}")
    n, names, places, low = var.agg(F.count(F.lit(1)), F.countDistinct(name), F.countDistinct(idx), F.min(idx)).first()
    if names < n or places < n or (low is not None and low < 0):
        raise ValueError("feature names or indices repeat, are null or negative")


def union_categories(lists: list[list[str]]) -> list[str]:
    """Categories of all inputs; the first input's order, then new ones as they come."""
    return list(dict.fromkeys(c for cats in lists for c in cats))
