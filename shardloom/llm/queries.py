"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardloom.llm import flow_clusters, leakage, linked_splits, mixture, neighbours, quota_sample, shared_spans


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict:
    t = _t
    return {
        "p1_found": lambda s, d: flow_clusters.found(t(s, d, "cells")),
        "p1_clusters": lambda s, d: flow_clusters.describe(t(s, d, "cells")),
        "p4_found": lambda s, d: quota_sample.found(t(s, d, "cells"), t(s, d, "load_plans")),
        "p4_sample": lambda s, d: quota_sample.sample(t(s, d, "cells"), t(s, d, "load_plans")),
        "p5_found": lambda s, d: linked_splits.found(t(s, d, "cells")),
        "p5_splits": lambda s, d: linked_splits.assign_splits(t(s, d, "cells")),
        "p6_found": lambda s, d: neighbours.found(t(s, d, "vectors")),
        "p6_neighbours": lambda s, d: neighbours.neighbours(t(s, d, "vectors")),
        "p7_found": lambda s, d: leakage.leaks(t(s, d, "documents"), t(s, d, "eval_items")),
        "p7_items": lambda s, d: leakage.item_report(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_found": lambda s, d: mixture.found(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_found": lambda s, d: shared_spans.shared_chars(t(s, d, "documents")),
        "p9_factors": lambda s, d: shared_spans.parse(t(s, d, "documents")),
        "p9_report": lambda s, d: shared_spans.report(t(s, d, "documents")),
        "p8_report": lambda s, d: mixture.mixture_report(t(s, d, "documents"), t(s, d, "mix_targets")),
    }


_LABEL = "trim(regexp_replace(lower({0}), '[\\s_-]+', ' ', 'g'))"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _also(sql: dict[str, str]) -> dict[str, str]:
    """With the queries that follow from another's rows."""
    shares = " ".join(f"WHEN mid / total < {upto!r}::DOUBLE THEN '{name}'" for name, upto in linked_splits.borders({"train": 0.8, "validation": 0.1, "test": 0.1}))
    linked = sql["p5_found"]
    groups = linked[: linked.index(", sz AS (")]
    return sql | {
        "p5_splits": (
            f"{groups}, al AS (SELECT DISTINCT c.rec_id, root FROM cells c LEFT JOIN g USING (rec_id) WHERE c.rec_id IS NOT NULL), gi AS (SELECT rec_id, coalesce(min(rec_id) OVER (PARTITION BY root), rec_id) AS id, root FROM al),"
            " gf AS (SELECT rec_id, CASE WHEN root IS NULL THEN rec_id ELSE id END AS grp FROM gi), gw AS (SELECT grp, count(*) AS n FROM gf GROUP BY 1),"
            " gm AS (SELECT grp, sum(n) OVER (ORDER BY md5('7:group:' || grp), grp) - n / 2 AS mid, sum(n) OVER () AS total FROM gw)"
            f' SELECT rec_id, grp AS "group", CASE {shares} ELSE \'test\' END AS split FROM gf JOIN gm USING (grp)'
        ),
        "p7_items": f"SELECT item_id, suite, n_docs FROM (SELECT item_id, count(*)::BIGINT AS n_docs FROM ({sql['p7_found']}) GROUP BY 1) JOIN (SELECT DISTINCT item_id, suite FROM eval_items) USING (item_id)",
        "p9_report": (
            f"SELECT doc_id, n_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared_chars, 0) / n_chars ELSE 0.0::DOUBLE END AS share FROM (SELECT doc_id, max(length(text))::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1) LEFT JOIN ({sql['p9_found']}) USING (doc_id)"
        ),
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express (p6_found by brute force, of which the operator
    finds nearly all); the others are tested against brute force in tests/llm."""
    pools = f"po AS (SELECT store_id, {_LABEL.format('label')} AS k, count(DISTINCT rec_id) AS h FROM cells WHERE label IS NOT NULL GROUP BY 1, 2)"
    size = f"sz AS (SELECT lower(trim(source, {_BLANKS})) AS k, sum(strlen(text))::HUGEINT AS tokens FROM documents GROUP BY 1), tt AS (SELECT sum(tokens) AS total FROM sz)"
    # Words of a text, and its runs of n words as text.
    words = "list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    runs = lambda n: f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n} - 1], ' '))"
    links = "RECURSIVE {0}, rr(a, b) AS (SELECT DISTINCT v, v FROM vs UNION SELECT rr.a, e.b FROM rr JOIN e ON rr.b = e.a), ro AS (SELECT a, min(b) AS root FROM rr GROUP BY a)"  # vs(v), e(a, b) both ways
    entries = "ce AS (SELECT DISTINCT rec_id, x_indices, x_values FROM cells WHERE rec_id IS NOT NULL AND len(x_indices) > 0), lo AS (SELECT rec_id, unnest(x_indices) AS f, unnest(x_values)::DOUBLE AS v FROM ce), nn AS (SELECT rec_id, sqrt(sum(v * v)) AS n FROM lo GROUP BY 1 HAVING sum(v * v) > 0), un AS (SELECT rec_id, f, v / n AS v FROM lo JOIN nn USING (rec_id) WHERE v <> 0)"
    keys = (
        f"d AS (SELECT rec_id, nullif(regexp_extract(donor_id, '[0-9]+'), '')::BIGINT AS dn, lower(trim(sample_id, {_BLANKS})) AS s, lower(trim(obs_name, {_BLANKS})) AS o FROM cells),"
        " ks AS (SELECT rec_id, 'd' || dn AS k FROM d WHERE dn IS NOT NULL UNION SELECT rec_id, 's' || s FROM d WHERE s <> '' UNION SELECT rec_id, 'o' || o FROM d WHERE o <> '' AND NOT regexp_full_match(o, '[0-9]+')),"
        " mk AS (SELECT rec_id, min(k) AS k0 FROM ks GROUP BY 1), e AS (SELECT k0 AS a, k AS b FROM ks JOIN mk USING (rec_id) WHERE k0 <> k UNION SELECT k, k0 FROM ks JOIN mk USING (rec_id) WHERE k0 <> k), vs AS (SELECT DISTINCT k AS v FROM ks)"
    )
    return _also({
        "p1_found": f"WITH {links.format(entries + ', pr AS (SELECT x.rec_id AS a, y.rec_id AS b FROM un x JOIN un y ON x.f = y.f AND x.rec_id < y.rec_id GROUP BY 1, 2 HAVING sum(x.v * y.v) >= 0.7), e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), vs AS (SELECT DISTINCT a AS v FROM e)')}, sz AS (SELECT root FROM ro GROUP BY root HAVING count(*) >= 3) SELECT a AS rec_id, root AS cluster_rec FROM ro JOIN sz USING (root)",
        "p5_found": f"WITH {links.format(keys)}, g AS (SELECT rec_id, root FROM mk JOIN ro ON k0 = a), sz AS (SELECT root, min(dn) AS group_donor FROM g JOIN d USING (rec_id) GROUP BY root HAVING count(DISTINCT rec_id) >= 2) SELECT rec_id, group_donor FROM g JOIN sz USING (root)",
        "p9_found": (
            "WITH po AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200))),"
            " sh AS (SELECT h FROM po GROUP BY h HAVING min(doc_id) <> max(doc_id)), st AS (SELECT doc_id, i, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) AS n FROM po WHERE h IN (SELECT h FROM sh))"
            " SELECT doc_id, sum(n)::BIGINT AS shared_chars FROM st GROUP BY doc_id"
        ),
        "p4_found": f"WITH {pools} SELECT DISTINCT plan_id, split_name, label FROM load_plans p LEFT JOIN po ON po.store_id = p.store_id AND po.k = {_LABEL.format('p.label')} WHERE coalesce(h, 0) * 1000 < share_pm * sample_size OR coalesce(h, 0) < min_rows",
        "p4_sample": (
            f"WITH {pools}, pl AS (SELECT DISTINCT plan_id, split_name, store_id, sample_size, label, share_pm, min_rows, {_LABEL.format('label')} AS k FROM load_plans), t AS (SELECT pl.*, coalesce(h, 0) AS h FROM pl LEFT JOIN po USING (store_id, k)),"
            " ex AS (SELECT *, unnest(range(1, least(h, greatest(min_rows, CASE WHEN share_pm > 0 THEN sample_size ELSE 0 END)) + 1)) AS i FROM t), pr AS (SELECT *, CASE WHEN i <= least(h, min_rows) THEN -1.0::DOUBLE ELSE (i - 0.5)::DOUBLE / share_pm::DOUBLE END AS p FROM ex),"
            " o AS (SELECT *, row_number() OVER (PARTITION BY plan_id, split_name ORDER BY p, k, i) AS n FROM pr), se AS (SELECT plan_id, split_name, store_id, k, label, max(i) AS seats FROM o WHERE p < 0 OR n <= sample_size GROUP BY ALL),"
            f" rc AS (SELECT DISTINCT store_id, {_LABEL.format('label')} AS k, rec_id FROM cells WHERE label IS NOT NULL AND rec_id IS NOT NULL AND store_id IS NOT NULL),"
            " rk AS (SELECT plan_id, split_name, label, rec_id, seats, row_number() OVER (PARTITION BY plan_id, split_name, label ORDER BY md5('7:draw:' || plan_id || ':' || split_name || ':' || rec_id), rec_id) AS r FROM se JOIN rc USING (store_id, k))"
            " SELECT plan_id, split_name, label, rec_id FROM rk WHERE r <= seats"
        ),
        "p6_found": (
            "WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM vectors WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),"
            " u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),"
            " c AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.u, y.u), 12) AS c FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.u) = len(y.u)),"
            " r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM c) SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE r <= 5"
        ),
        "p7_found": (
            f"WITH iw AS (SELECT item_id, {words} AS w FROM eval_items WHERE text IS NOT NULL), ip AS (SELECT DISTINCT item_id, least(25, len(w)) AS n, unnest({runs('least(25, len(w))')}) AS r FROM iw WHERE len(w) > 0),"
            f" ns AS (SELECT DISTINCT n FROM ip), dw AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), dp AS (SELECT DISTINCT doc_id, n, unnest({runs('n')}) AS r FROM dw, ns WHERE len(w) >= n)"
            " SELECT DISTINCT doc_id, item_id FROM dp JOIN ip USING (n, r)"
        ),
        "p8_found": f"WITH {size} SELECT DISTINCT mix_id, source FROM mix_targets m LEFT JOIN sz ON lower(trim(m.source, {_BLANKS})) = k, tt WHERE weight_bp::HUGEINT * budget_pct * total > max_repeats::HUGEINT * coalesce(tokens, 0) * 1000000",
        "p8_report": (
            f"WITH {size}, rt AS (SELECT m.*, coalesce(tokens, 0) AS tok, weight_bp / 10000.0::DOUBLE * budget_pct / 100 * total::DOUBLE AS wanted, weight_bp::HUGEINT * budget_pct * total > max_repeats::HUGEINT * coalesce(tokens, 0) * 1000000 AS short, lower(trim(m.source, {_BLANKS})) AS key FROM mix_targets m LEFT JOIN sz ON lower(trim(m.source, {_BLANKS})) = k, tt),"
            " ra AS (SELECT *, CASE WHEN tok > 0 THEN least(wanted / tok::DOUBLE, max_repeats::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM rt),"
            f" dc AS (SELECT doc_id, lower(trim(source, {_BLANKS})) AS key, strlen(text) AS b FROM documents WHERE text IS NOT NULL),"
            " em AS (SELECT mix_id, key, b, floor(rate) + CASE WHEN ('0x' || substr(md5('7:mix:' || mix_id || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS c FROM dc JOIN ra USING (key)),"
            " ou AS (SELECT mix_id, key, sum(b * c)::BIGINT AS reached, sum(c)::BIGINT AS copies FROM em GROUP BY 1, 2), re AS (SELECT ra.*, coalesce(reached, 0) AS r, coalesce(copies, 0) AS c FROM ra LEFT JOIN ou USING (mix_id, key))"
            " SELECT mix_id, source, rate, trunc(wanted)::BIGINT AS wanted, r::BIGINT AS reached, c::BIGINT AS copies, CASE WHEN sum(r) OVER (PARTITION BY mix_id) > 0 THEN r / (sum(r) OVER (PARTITION BY mix_id))::BIGINT ELSE 0.0::DOUBLE END AS share, short FROM re"
        ),
    })
