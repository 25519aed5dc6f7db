"""Mixing sources to target weights by capped water-filling.

Each source gets the share of the word budget that its weight asks for, but
never more than ``max_epochs`` times its own words; what a capped source
cannot take is shared among the others by weight until none is above its cap.
A target is then met with whole repetitions of every document, and one
fractional repetition: documents in a seeded order, until the words run out.

Everything is DataFrame work. Per-source totals and the seeded order's
prefix sums are aggregates of (source, bucket), so a source that holds most of
the rows is split over ``BUCKETS`` window groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import WORD, text_or_empty, written

#: Groups of the seeded order in each source (three hex digits of its key).
BUCKETS = 4096


def n_words(text: str = "text") -> Column:
    return F.expr(f"cast(regexp_count(coalesce(`{text}`, ''), r'{WORD}') as bigint)")


def water_fill(sources: DataFrame, weights: list[float], budget_ratio: float,
               max_epochs: float) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``.

    Weights repeat over the sources in code-point order, null last. The fill
    level is the one at which the capped sources' caps and the others' weights
    add up to the budget: with sources ordered by cap over weight, the capped
    ones are a prefix. One window over the sources (not the documents).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_rn") % len(weights) + 1).cast("int"))
    s = (sources.withColumn("_rn", F.row_number().over(by_name) - 1)
         .withColumn("weight", weight)
         .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_rn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (s.withColumn("_budget", F.sum("source_size").over(every) * F.lit(float(budget_ratio)))
         .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_level", F.col("_left") / F.sum("weight").over(after))
         .withColumn("_open", F.col("_cap") / F.col("weight") > F.col("_level"))
         .withColumn("_fill", F.max(F.when(F.col("_open"), F.col("_level"))).over(every)))
    return s.select("source", "source_size", "weight",
                    F.when(F.col("_open"), F.least("_cap", F.col("_fill") * F.col("weight")))
                    .otherwise(F.col("_cap")).alias("target"))


def mix(docs: DataFrame, weights: list[float], budget_ratio: float, max_epochs: float,
        seed: str, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, tie, source, size, source_size, target,
    whole, extra, taken``.

    ``whole`` repetitions of every document of a source, and ``extra`` words of
    a further one: all of a document's words for the first documents of the
    seeded order, some of them for at most one document of each source, none
    for the rest. So each source's taken words are its target, rounded.

    Null text has size 0; a null source is a source of its own; null and
    repeated ids are ordinary rows (``tie`` is the text's hash, so that rows
    with one id and other texts stay apart). A source without words has target
    0. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    sizes = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("tie"),
        F.col(source).alias("source"), n_words(text).alias("size"), key.alias("key"),
    ).withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")), "mix-sizes")

    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    buckets = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("n").over(buckets), F.lit(0)))
    filled = water_fill(per_bucket.groupBy("source").agg(F.sum("n").alias("source_size")),
                        weights, budget_ratio, max_epochs)
    plan = (starts.withColumnRenamed("source", "_s").withColumnRenamed("bucket", "_b").drop("n")
            .join(filled, F.col("_s").eqNullSafe(F.col("source"))).drop("source"))

    order = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie")
             .rowsBetween(Window.unboundedPreceding, -1))
    d = sizes.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    out = d.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("whole", whole.cast("bigint"))
    fraction = F.round(F.col("target")).cast("bigint") - F.col("whole") * F.col("source_size")
    out = out.withColumn("extra", F.least(F.col("size"), F.greatest(
        F.lit(0).cast("bigint"), fraction - F.col("start") - F.col("before"))))
    return out.select("doc_id", "tie", "source", "size", "source_size", "target", "whole", "extra",
                      (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def apply_mix(docs: DataFrame, weights: list[float], budget_ratio: float, max_epochs: float,
              seed: str) -> DataFrame:
    """The mixed documents: the columns of ``docs``, a row for each repetition.

    A whole repetition is the row as it is; the one document of a source whose
    last repetition is fractional gives its first words, joined by a space.
    Documents without words carry nothing into a mix and stay as they are.
    """
    cols = docs.columns
    plan = mix(docs, weights, budget_ratio, max_epochs, seed).select(
        F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("size").alias("_size"),
        F.col("whole").alias("_whole"), F.col("extra").alias("_extra"))
    # Rows equal in id and text are told apart by a number, in any order:
    # whichever of them gets a repetition, the mixed rows are the same.
    same = Window.partitionBy("_id", "_tie").orderBy(F.desc("_extra"))
    plan = plan.withColumn("_n", F.row_number().over(same))
    d = docs.select(*[F.col(f"`{c}`") for c in cols], F.xxhash64(text_or_empty()).alias("_dtie"))
    again = Window.partitionBy("doc_id", "_dtie").orderBy(*[F.col(f"`{c}`") for c in cols if c != "doc_id"])
    d = d.withColumn("_dn", F.row_number().over(again))
    both = d.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_dtie") == F.col("_tie"))
                  & (F.col("_dn") == F.col("_n")))
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(
        (F.col("_whole") + (F.col("_extra") > 0).cast("bigint")).cast("int"))
    both = both.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(
        F.array().cast("array<int>"))))
    part = (F.col("_copy") > F.col("_whole")) & (F.col("_extra") < F.col("_size")) & (F.col("_size") > 0)
    cut = F.expr(f"array_join(slice(regexp_extract_all(text, r'{WORD}', 0), 1, cast(_extra as int)), ' ')")
    return both.select(*[F.when(part, cut).otherwise(F.col("text")).alias("text") if c == "text"
                         else F.col(f"`{c}`") for c in cols])
