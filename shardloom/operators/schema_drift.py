"""Schemas that drift between files: one settled table and a report of every change.

Input: one row per JSON line (``record``) with the file it came from (file_id, kind,
store_id, written_at, line_no) and the record it describes (rec_key). Files of one
(kind, store_id) follow each other by (written_at, file_id); each is compared with the
one before.

* Lines are parsed once, to VARIANT, and exploded to fields inside the JVM. Lines that
  are no JSON object (cut off, other JSON values, null) are skipped; of a key that a line
  repeats the line is unreadable as the parser rejects it.
* A file's schema is an aggregate: field, its types. Evidence that an old field went on
  under a new name comes from records in both files, by an equi-join on (file, record)
  restricted to fields that vanished and fields that are new.
* Similarity flooding (Melnik et al.) then decides which fields of the two schemas are the
  same, per pair of files with fields gone and fields new, on what is bounded by their
  schemas, not by their rows: the schemas are graphs of fields, their types and their
  nesting; the pairwise connectivity graph joins pairs of fields through the pairs of their
  types and of the fields (or roots) that they lie in. Scores start from names and value
  evidence, flow along the graph to a fixpoint, and a stable one-to-one choice is taken
  among pairs that are near the best of both of their fields. Fields not chosen as
  the same are never renamed; of the chosen ones those are, exactly, whose evidence is without exception.

Types: string, boolean, array, object, integer, or double if any number of the file has
a fraction; several of them joined by '|'. A field of nulls alone has no type and is not
retyped. A record that a file has several times shows the value of its last readable line
(by line_no) with the field. Rows repeated exactly change nothing. A file without readable
lines has no fields. The first file of a store has no changes. Null file_ids are left out.
With ``depth`` > 0 the fields of objects are fields, too, named by their path (``a.b``), down
to that many levels below the top.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.session import materialize


def file_sequence(raw: DataFrame) -> DataFrame:
    """file_id, kind, store_id, prev_id (null for a first file).

    The order is cut into months; only a month's last file is carried on to the next, so
    a store that holds most files is not ordered by one task.
    """
    f = raw.where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("kind").alias("kind"), F.min("store_id").alias("store_id"), F.min("written_at").alias("t"))
    f = f.withColumn("month", F.date_trunc("month", F.coalesce("t", F.lit("1970-01-01").cast("timestamp_ntz"))))
    keys, order = ["kind", "store_id"], ["t", "file_id"]
    inside = f.withColumn("p", F.lag("file_id").over(Window.partitionBy(*keys, "month").orderBy(*order)))
    ends = f.groupBy(*keys, "month").agg(F.max_by("file_id", F.struct("t", "file_id")).alias("last"))
    ends = ends.withColumn("q", F.lag("last").over(Window.partitionBy(*keys).orderBy("month"))).drop("last")
    e = ends.select(F.col("kind").alias("k"), F.col("store_id").alias("s"), F.col("month").alias("m"), "q")
    j = inside.join(e, inside["kind"].eqNullSafe(e["k"]) & inside["store_id"].eqNullSafe(e["s"]) & (inside["month"] == e["m"]))
    return j.select("file_id", "kind", "store_id", F.coalesce("p", "q").alias("prev_id"))


def _kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", None).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object").when(kind == "BIGINT", "integer").when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").otherwise("double")
    )


def readable(raw: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and ``__v`` (VARIANT) of the lines that are a JSON object."""
    v = raw.select("record", *cols).where("file_id IS NOT NULL").withColumn("__v", F.try_parse_json(F.col("record")))
    return v.where(F.schema_of_variant("__v").startswith("OBJECT<")).drop("record")


def fields(raw: DataFrame, *carry: str, depth: int = 0) -> DataFrame:
    """One row per field of each readable line: file_id, rec_key, line_no, field, value
    (VARIANT), type (null for a JSON null) and ``carry``."""
    own = ["file_id", "rec_key", "line_no", *carry]  # other columns' names may clash
    spark = raw.sparkSession
    level = readable(raw, *own).lateralJoin(spark.tvf.variant_explode(F.col("__v").outer())).select(*own, F.col("key").alias("field"), "value")
    level = level.withColumn("type", _kind(F.col("value")))
    out = level
    for _ in range(depth):
        inside = level.where("type = 'object'").withColumnsRenamed({"value": "__v", "field": "__in"})
        level = inside.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer())).select(*own, F.concat_ws(".", "__in", "key").alias("field"), "value")
        level = level.withColumn("type", _kind(F.col("value")))
        out = out.unionByName(level)
    return out


def _canonical(value: Column, typ: Column) -> Column:
    """Text that is equal for equal JSON values of one type; null for null."""
    number = F.try_variant_get(value, "$", "double").cast("string")
    whole = F.try_variant_get(value, "$", "decimal(38,0)").cast("string")
    body = F.when(typ == "double", number).when(typ == "integer", whole).otherwise(F.to_json(value))
    return F.when(typ.isNotNull(), F.concat(F.when(typ.isin("integer", "double"), F.lit("number")).otherwise(typ), F.lit(":"), body))


def file_schemas(f: DataFrame) -> DataFrame:
    """file_id, field, type of the output of ``fields``."""
    t = f.groupBy("file_id", "field").agg(F.array_sort(F.collect_set("type")).alias("t"))  # at most six types
    t = t.withColumn("t", F.when(F.array_contains("t", "double"), F.filter("t", lambda x: x != "integer")).otherwise(F.col("t")))
    return t.select("file_id", "field", F.when(F.size("t") > 0, F.concat_ws("|", "t")).alias("type"))


def _grams(name: str) -> set[str]:
    s = "".join(c for c in name.rsplit(".", 1)[-1].lower() if c.isalnum())
    return {s[i : i + 2] for i in range(len(s) - 1)} or {s}


def _name_likeness(old: list[str], new: list[str]) -> np.ndarray:
    """Shared bigrams by all bigrams, for every pair of names."""
    go, gn = [_grams(f) for f in old], [_grams(f) for f in new]
    at = {g: i for i, g in enumerate(sorted(set().union(*go, *gn)))}

    def table(grams):
        m = np.zeros((len(grams), len(at)), np.float32)
        for r, g in enumerate(grams):
            m[r, [at[x] for x in g]] = 1
        return m

    a, b = table(go), table(gn)
    both = a @ b.T
    return (both / (a.sum(1)[:, None] + b.sum(1)[None, :] - both)).astype(float)


def flood(old: list[tuple[str, str]], new: list[tuple[str, str]], evidence: dict[tuple[str, str], tuple[int, int, int]], rounds: int = 100, eps: float = 1e-4) -> dict[tuple[str, str], float]:
    """Similarity flooding between two whole schemas given as (field, type) lists.

    evidence[(o, n)] = records showing both, equal ones, equal ones that aren't null. The
    connectivity graph's nodes are pairs of fields, of types and the pair of roots. A pair of
    fields hangs on the pair of its types and on the pair of the fields that they are nested
    in (of the roots, at the top), and on none if only one of them is at the top. A node's
    flow along one kind of edge is shared by its neighbours, as in the paper. Start: half
    the likeness of the names; 1 for equal names; for values that are compared, 1 plus
    that half if all agree, else 0. Returns the converged scores of the field pairs, largest 1.
    """
    no, nn = len(old), len(new)
    if not no or not nn:
        return {}
    fo, fn = [f for f, _ in old], [f for f, _ in new]
    types_o, types_n = sorted({t or "?" for _, t in old}), sorted({t or "?" for _, t in new})
    to = np.eye(len(types_o))[[types_o.index(t or "?") for _, t in old]]
    tn = np.eye(len(types_n))[[types_n.index(t or "?") for _, t in new]]

    def up(schema, names):
        objects = {f: i for i, f in enumerate(names) if schema[i][1] and "object" in schema[i][1]}
        return np.eye(len(names) + 1)[[objects.get(f.rsplit(".", 1)[0], len(names)) if "." in f else len(names) for f in names]]

    po, pn = up(old, fo), up(new, fn)  # field x (field or root that it lies in)
    start = 0.5 * _name_likeness(fo, fn)
    start[np.array(fo)[:, None] == np.array(fn)[None, :]] = 1.0
    row, col = {f: i for i, f in enumerate(fo)}, {f: i for i, f in enumerate(fn)}
    for (o, n), (both, equal, real) in evidence.items():
        if o in row and n in col and both:
            start[row[o], col[n]] = 1.0 + start[row[o], col[n]] if both == equal and real else 0.0
    tstart = np.array([[1.0 if x == y else 0.2 if {x, y} == {"integer", "double"} else 0.05 for y in types_n] for x in types_o])
    per_type = np.maximum(to.sum(0)[:, None] * tn.sum(0)[None, :], 1)
    per_home = np.maximum(po.sum(0)[:, None] * pn.sum(0)[None, :], 1)
    s, t, root = start.copy(), tstart.copy(), 1.0
    for _ in range(rounds):
        home = np.zeros((no + 1, nn + 1))
        home[:no, :nn], home[no, nn] = s, root
        down = to @ (t / per_type) @ tn.T + po @ (home / per_home) @ pn.T
        above = po.T @ s @ pn
        s2 = start + s + down + above[:no, :nn]
        t2, r2 = tstart + t + to.T @ s @ tn / per_type, 1.0 + root + above[no, nn] / per_home[no, nn]
        s2, t2, r2 = s2 / s2.max(), t2 / t2.max(), r2 / max(r2, s2.max())
        moved = max(np.abs(s2 - s).max(), np.abs(t2 - t).max(), abs(r2 - root))
        s, t, root = s2, t2, r2
        if moved < eps:
            break
    return {(fo[a], fn[b]): float(s[a, b]) for a in range(no) for b in range(nn)}


def correspondences(scores: dict[tuple[str, str], float], near: float = 0.6) -> list[tuple[str, str]]:
    """A stable one-to-one choice of pairs by score (ties by name), among pairs that have at least
    ``near`` of the best score of both of their fields."""
    best_o: dict[str, float] = {}
    best_n: dict[str, float] = {}
    for (o, n), v in scores.items():
        best_o[o], best_n[n] = max(v, best_o.get(o, 0.0)), max(v, best_n.get(n, 0.0))
    took_o: set[str] = set()
    took_n: set[str] = set()
    out = []
    for v, (o, n) in sorted((-v, p) for p, v in scores.items()):
        if o not in took_o and n not in took_n and v < 0 and -v >= near * max(best_o[o], best_n[n]):
            took_o.add(o), took_n.add(n)
            out.append((o, n))
    return out


def select_renames(old: list[tuple[str, str]], new: list[tuple[str, str]], evidence: dict[tuple[str, str], tuple[int, int, int]], scores: dict[tuple[str, str], float] | None = None) -> list[tuple[str, str]]:
    """The corresponding fields of which one is gone and one is new and whose evidence is without
    exception: all records showing both agree, and not all values are null."""
    a, c = {f for f, _ in old}, {f for f, _ in new}
    pairs = correspondences(flood(old, new, evidence) if scores is None else scores)
    ok = lambda both, equal, real: both and both == equal and real
    return [(o, n) for o, n in pairs if o not in c and n not in a and ok(*evidence.get((o, n), (0, 0, 0)))]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for file_id, before, now, ev in zip(b["file_id"], b["before"], b["now"], b["evidence"]):
            old = [(x["field"], x["type"]) for x in (before if before is not None else [])]
            new = [(x["field"], x["type"]) for x in (now if now is not None else [])]
            evidence = {(x["o"], x["n"]): (x["both"], x["equal"], x["real"]) for x in (ev if ev is not None else [])}
            a, c = dict(old), dict(new)
            renames = []
            if evidence:
                renames = select_renames(old, new, evidence)
            gone, came = {o for o, _ in renames}, {n for _, n in renames}
            out += [(file_id, "renamed", o, n) for o, n in renames]
            out += [(file_id, "removed", o, "") for o in a if o not in c and o not in gone]
            out += [(file_id, "added", "", n) for n in c if n not in a and n not in came]
            out += [(file_id, "retyped", o, o) for o in a if o in c and a[o] and c[o] and a[o] != c[o]]
        yield pd.DataFrame(out, columns=["file_id", "change", "old_field", "new_field"]).astype({"file_id": "int64"})


def changes(raw: DataFrame, depth: int = 0) -> DataFrame:
    """p2_found(file_id, change, old_field, new_field): every change, by file."""
    seq = materialize(file_sequence(raw), "files").where("prev_id IS NOT NULL").select("file_id", "prev_id")
    f = fields(raw, depth=depth)
    last = F.struct("line_no", F.coalesce("val", F.lit("")).alias("val"))
    vals = f.withColumn("val", _canonical(F.col("value"), F.col("type"))).groupBy("file_id", "rec_key", "field").agg(
        F.max_by(F.struct("val"), last).alias("v"), F.collect_set("type").alias("types"))
    vals = materialize(vals.select("file_id", "rec_key", "field", F.col("v.val").alias("val"), "types"), "values")
    typed = vals.select("file_id", "field", F.explode_outer("types").alias("type"))
    sch = materialize(file_schemas(typed), "schemas")
    # Fields that vanished, and fields that are new.
    cur = seq.join(sch, "file_id").select("file_id", "prev_id", "field")
    old = seq.join(sch.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "prev_id", "field")
    new_f = cur.join(old.select("file_id", "field"), ["file_id", "field"], "left_anti")
    gone_f = old.join(cur.select("file_id", "field"), ["file_id", "field"], "left_anti")
    a = vals.withColumnRenamed("file_id", "prev_id").join(gone_f, ["prev_id", "field"]).select("file_id", "rec_key", F.col("field").alias("o"), F.col("val").alias("ov"))
    b = vals.join(new_f, ["file_id", "field"]).select("file_id", "rec_key", F.col("field").alias("n"), F.col("val").alias("nv"))
    same = F.col("ov").eqNullSafe(F.col("nv"))
    ev = a.join(b, ["file_id", "rec_key"]).groupBy("file_id", "o", "n").agg(
        F.count(F.lit(1)).alias("both"), F.count_if(same).alias("equal"), F.count_if(same & F.col("ov").isNotNull()).alias("real"))
    ev = ev.groupBy("file_id").agg(F.collect_list(F.struct("o", "n", "both", "equal", "real")).alias("evidence"))  # bounded by the schemas
    lists = sch.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("field", "type"))).alias("fields"))
    j = seq.join(lists.withColumnRenamed("fields", "now"), "file_id", "left").join(lists.select(F.col("file_id").alias("prev_id"), F.col("fields").alias("before")), "prev_id", "left").join(ev, "file_id", "left")
    return j.select("file_id", "before", "now", "evidence").mapInPandas(_compare, "file_id bigint, change string, old_field string, new_field string")


def settled_columns(raw: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """kind, store_id, field, column, type: the settled column of every field. Names that
    renames tie together in a store are one column, called by its smallest name that is
    no rename's target (else its smallest name); its type is the widest that the files of all
    stores and kinds have, as it is one column of one table: integer and double make double, any other mixture string, no type string."""
    found = materialize(changes(raw), "changes") if found is None else found
    seq = file_sequence(raw).select("file_id", "kind", "store_id")
    ties = found.where("change = 'renamed'").join(seq, "file_id").groupBy("kind", "store_id").agg(F.collect_set(F.struct(F.col("old_field").alias("o"), F.col("new_field").alias("n"))).alias("ties"))  # distinct names only
    sch = file_schemas(fields(raw)).join(seq, "file_id").groupBy("kind", "store_id", "field").agg(F.collect_set("type").alias("types"))

    def settle(batches):
        for b in batches:
            out = []
            for kind, store, own in zip(b["kind"], b["store_id"], b["ties"]):
                up: dict[str, str] = {}

                def root(x, up=up):
                    while up.setdefault(x, x) != x:
                        x = up[x]
                    return x

                targets = {t["n"] for t in own}
                for t in own:
                    a, c = root(t["o"]), root(t["n"])
                    if a != c:
                        up[c] = a
                groups: dict[str, list[str]] = {}
                for x in list(up):
                    groups.setdefault(root(x), []).append(x)
                for g in groups.values():
                    name = min(g, key=lambda x: (x in targets, x))
                    out += [(kind, store, x, name) for x in g]
            yield pd.DataFrame(out, columns=["kind", "store_id", "field", "column"])

    k = f"kind string, store_id {dict(raw.dtypes)['store_id']}, field string, column string"
    named = ties.mapInPandas(settle, k)
    n = named.select(F.col("kind").alias("__k"), F.col("store_id").alias("__s"), F.col("field").alias("__f"), "column")
    c = sch.join(n, sch["kind"].eqNullSafe(n["__k"]) & sch["store_id"].eqNullSafe(n["__s"]) & (sch["field"] == n["__f"]), "left").drop("__k", "__s", "__f").withColumn("column", F.coalesce("column", "field"))
    wide = c.groupBy("column").agg(F.array_distinct(F.flatten(F.collect_set("types"))).alias("t")).select("column", F.array_distinct(F.flatten(F.transform("t", lambda x: F.split(x, r"\|")))).alias("t"))
    wide = wide.withColumn("t", F.when(F.array_contains("t", "double"), F.filter("t", lambda x: x != "integer")).otherwise(F.col("t")))
    wide = wide.select("column", F.when((F.size("t") == 1) & (F.col("t")[0] != "object"), F.col("t")[0]).otherwise("string").alias("type"))
    return c.select("kind", "store_id", "field", "column").join(wide, "column")


SQL_TYPES = {"string": "string", "boolean": "boolean", "integer": "bigint", "double": "double", "array": "array<string>"}


def settled_table(raw: DataFrame, kind: str | None = None, max_columns: int = 2000) -> DataFrame:
    """All readable lines (of all kinds, or one) in one table: kind, store_id, file_id, line_no,
    rec_key and a column for each settled field, cast to its settled type.

    The columns are read from the schemas (never the rows); more than ``max_columns``
    raise. Fields of a line that settle to one column give its first non-null value by
    name; a line without any non-null field stays, with nulls; rows repeated exactly are one. Nothing is
    pivoted: a line is parsed once, its fields are renamed by its store's map, and the columns are picked by name.
    """
    if kind is not None:
        raw = raw.where(F.col("kind") == kind)
    cols = materialize(settled_columns(raw), "columns")
    heads = cols.select("column", "type").distinct().limit(max_columns + 1).collect()
    if len(heads) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    renamed = cols.where("field <> column").groupBy("kind", "store_id").agg(F.map_from_entries(F.collect_set(F.struct("field", "column"))).alias("__to"))
    r = renamed.select(F.col("kind").alias("__k"), F.col("store_id").alias("__s"), "__to")
    keys = ["kind", "store_id", "file_id", "line_no", "rec_key"]
    v = readable(raw.select(*keys, "record").distinct(), *keys)
    v = v.join(r, v["kind"].eqNullSafe(r["__k"]) & v["store_id"].eqNullSafe(r["__s"]), "left").drop("__k", "__s")
    entries = F.map_entries(F.variant_get("__v", "$", "map<string,variant>"))
    to = lambda x: F.struct(F.coalesce(F.col("__to")[x["key"]], x["key"]).alias("column"), x["key"].alias("field"), F.to_json(x["value"]).alias("value"))
    e = F.array_sort(F.filter(F.transform(entries, to), lambda x: x["value"].isNotNull() & (x["value"] != "null")))
    v = v.withColumn("e", e)
    first = F.expr("filter(e, (x, i) -> i = 0 OR e[i - 1].column <> x.column)")  # the first field of each column
    f = v.withColumn("m", F.map_from_entries(F.transform(first, lambda x: F.struct(x["column"], x["value"]))))
    names = {h["column"]: h["type"] for h in sorted(heads)}
    taken = {"kind", "store_id", "file_id", "line_no", "rec_key"}
    seen: set[str] = set()
    picked = []
    for c, t in names.items():
        out, n = c, 1
        while out.lower() in taken | seen:  # clashing or case-differing names get a number
            out, n = f"{c}_{n}", n + 1
        seen.add(out.lower())
        v = F.try_parse_json(F.col("m")[F.lit(c)])
        val = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)) if t == "string" else F.try_variant_get(v, "$", SQL_TYPES[t])
        picked.append(val.alias(out))
    return f.select("kind", "store_id", "file_id", "line_no", "rec_key", *picked)
