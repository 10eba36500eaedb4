"""Mixing sources to target weights of a token budget.

Tokens are those of the byte-level tokenizer ByT5 without end token, one per UTF-8
byte, so sizes are ``octet_length(text)``: exact, inside the JVM, no model needed.

Definitions for odd input: a null text has size 0 and is emitted never; an empty
text has size 0 and is repeated like any other; spellings of a source are equal
ignoring case and surrounding blanks; a null source matches no target but counts in
the total size. A source named by a mix but absent from the documents has size 0
and falls short unless its weight is 0. Documents of sources that a mix does not
name are not in that mix. Extra columns of the documents pass through;
ones called mix_id or copy_no get the suffix _doc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.hashing import u32

BLANKS = " \t\n\r\f\v"


def source_key(c: Column) -> Column:
    return F.lower(F.trim(c, F.lit(BLANKS)))


def source_sizes(documents: DataFrame) -> DataFrame:
    """key, tokens, docs per source; combines before the shuffle (few sources)."""
    t = F.octet_length("text").cast("bigint")
    return documents.select(source_key(F.col("source")).alias("key"), t.alias("t")).groupBy("key").agg(
        F.coalesce(F.sum("t"), F.lit(0)).cast("decimal(38,0)").alias("tokens"), F.count("t").alias("docs"))


def mixture_rates(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, key, tokens, budget, wanted, rate, short: the repetition rate of
    each source (capped at ``max_repeats``) and whether its target cannot be met.

    ``short`` is decided in whole numbers: weight_bp * budget_pct * total >
    max_repeats * tokens * 10^6.
    """
    sizes = source_sizes(documents)
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("decimal(38,0)").alias("total"))
    t = targets.withColumn("key", source_key(F.col("source"))).join(sizes, "key", "left").withColumn("total", total.scalar())
    dec = lambda c: F.col(c).cast("decimal(18,0)")
    tokens = F.coalesce(F.col("tokens"), F.lit(0).cast("decimal(38,0)"))
    big = lambda c: c.cast("decimal(24,0)")
    asked = (dec("weight_bp").cast("decimal(7,0)") * dec("budget_pct").cast("decimal(7,0)")) * big(F.col("total"))
    have = dec("max_repeats").cast("decimal(7,0)") * F.lit(1_000_000).cast("decimal(7,0)") * big(tokens)
    wanted = F.col("weight_bp") / 1e4 * F.col("budget_pct") / 100 * F.col("total").cast("double")
    rate = F.when(tokens > 0, F.least(wanted / tokens.cast("double"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return t.select(
        "mix_id", "source", "key", "weight_bp", "max_repeats", tokens.cast("bigint").alias("tokens"),
        (F.col("budget_pct") / 100 * F.col("total").cast("double")).alias("budget"), wanted.alias("wanted"), rate.alias("rate"), (asked > have).alias("short"),
    )


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """The mixture: every document floor(rate) times plus once more with the
    probability of the fraction, decided by md5('seed:mix:mix_id:doc_id'), with
    ``mix_id`` and ``copy_no``. The rates are one row a mix and source and the plan
    lets adaptive execution broadcast them; the documents are not shuffled then."""
    r = mixture_rates(documents, targets).select(F.col("mix_id"), F.col("key").alias("__key"), F.col("rate").alias("__rate"))
    d = documents.withColumnsRenamed({c: f"{c}_doc" for c in ("mix_id", "copy_no") if c in documents.columns})
    d = d.where(F.col("text").isNotNull()).withColumn("__key", source_key(F.col("source")))
    j = d.join(r, "__key")
    u = u32(seed, "mix", "mix_id", "doc_id") / F.lit(float(1 << 32))
    n = (F.floor("__rate") + F.when(u < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)).cast("int")
    return j.withColumn("__n", n).where("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__key", "__rate", "__n")


def mixture_report(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """mix_id, source, rate, wanted and reached tokens, reached share (of the mixture)."""
    out = mix(documents, targets, seed).groupBy("mix_id", source_key(F.col("source")).alias("key")).agg(F.sum(F.octet_length("text")).cast("bigint").alias("reached"), F.count(F.lit(1)).alias("copies"))
    r = mixture_rates(documents, targets).join(out, ["mix_id", "key"], "left")
    got = F.coalesce(F.col("reached"), F.lit(0)).cast("bigint")
    all_ = F.sum(got).over(Window.partitionBy("mix_id"))
    return r.select("mix_id", "source", F.col("rate"), F.col("wanted").cast("bigint").alias("wanted"), got.alias("reached"),
                    F.coalesce(F.col("copies"), F.lit(0)).cast("bigint").alias("copies"), F.when(all_ > 0, got / all_).otherwise(0.0).alias("share"), "short")


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """p8_found(mix_id, source): sources whose target cannot be met by repeating."""
    return mixture_rates(documents, targets).where("short").select("mix_id", "source").distinct()
