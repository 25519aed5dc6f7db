"""Streaming O21: errors and explanations that both arrive as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.logs import ERROR_LEVEL


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def stream_error_enrich(records: DataFrame, explanations: DataFrame, *, key: str = "id", session: str = "session_id",
                        ts: str = "ts", level: str = "level", message: str = "message",
                        completion: str = "completion", code: str = "code", explained: str = "ts",
                        before_s: int = 3600, after_s: int = 600, delay_s: int = 600,
                        explanations_delay_s: int | None = None) -> DataFrame:
    """The records, each once, an error's message followed by the newest
    explanation and code that its session has between ``before_s`` seconds
    before the error and ``after_s`` after it. Both sides are streams, ordered
    by event time (``ts`` of a record, ``explained`` of an explanation).

    A left outer join bounded in time, with a watermark on both sides: an error
    is told when both watermarks have passed its time and ``after_s``, with an
    explanation or without (of several at one time, the larger text). State older
    than that is dropped. Errors and explanations that are later than the
    watermark (``delay_s``, ``explanations_delay_s`` behind the newest seen) are
    dropped, as Spark's stateful operators do. Other records, and errors without
    time or session, pass by at once, without state. All records move their
    watermark, and all explanations with a session theirs.

    Sessions are split by time: errors meet explanations by (session, bucket of
    ``before_s + after_s`` seconds), and an explanation goes to the one or two
    buckets it can serve, so a session with a third of all rows is not one
    task's state. ``key`` identifies a record together with its time. Columns
    of the result are those of ``records``. Append mode.
    """
    span = 1_000_000 * max(1, before_s + after_s)
    bucket = lambda micros: F.floor(micros / F.lit(span))
    at, gap = F.col("_ets"), lambda s: F.expr(f"interval '{s}' second")
    e = explanations.select(F.col(session).alias("_s"), F.col(explained).alias("_ets"),
                            F.col(completion).alias("_c"), F.col(code).alias("_code")) \
        .withWatermark("_ets", f"{delay_s if explanations_delay_s is None else explanations_delay_s} seconds")
    # Which rows join is told by whether they have a bucket: a plain filter would
    # be pushed below the watermark, and the rows it drops would not move that.
    usable = (F.coalesce("_c", F.lit("")) != "") | (F.coalesce("_code", F.lit("")) != "")
    e = e.withColumn("_b", F.explode(F.when(usable, F.sequence(bucket(_micros(at) - F.lit(1_000_000 * after_s)),
                                                               bucket(_micros(at) + F.lit(1_000_000 * before_s))))))
    joins = (F.col(level) == ERROR_LEVEL) & F.col(ts).isNotNull() & F.col(session).isNotNull()
    told = records.withWatermark(ts, f"{delay_s} seconds").withColumn("_eb", F.when(joins, bucket(_micros(F.col(ts)))))
    met = told.where(F.col("_eb").isNotNull()).join(
        e, (F.col(session) == F.col("_s")) & (F.col("_eb") == F.col("_b"))
        & (at >= F.col(ts) - gap(before_s)) & (at <= F.col(ts) + gap(after_s)), "leftOuter")
    rest = [c for c in records.columns if c not in (key, ts)]
    newest = lambda c: F.max(F.when(F.col(c) != "", F.struct(at, F.col(c))))[c]  # noqa: E731  (ties: the larger text)
    one = met.groupBy(key, ts).agg(F.first(F.struct(*rest)).alias("_r"), newest("_c").alias("_c"), newest("_code").alias("_code"))
    text = F.when(F.col("_c").isNotNull(), F.concat_ws("\n\n", F.col(f"_r.`{message}`"), "_c", "_code")) \
        .otherwise(F.col(f"_r.`{message}`"))
    enriched = one.select(*[F.col(c) if c in (key, ts) else text.alias(c) if c == message else F.col(f"_r.`{c}`").alias(c)
                            for c in records.columns])
    return enriched.unionByName(told.where(F.col("_eb").isNull()).select(*records.columns))
