"""Streaming O8 and O29: quality counts of every micro-batch, without a second pass.

The counts are ``observe`` metrics: they are gathered while the stream's rows
pass on to its sink. A listener writes each batch's counts to a quality table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from parley.operators.settings import parses

QUALITY = "query string, batch long, name string, metric string, value long"


def observe_prompt_fields(checked: DataFrame, name: str = "prompt_fields") -> DataFrame:
    """``checked`` (rows of ``prompt_field_check``) as it is, with the counts of
    ``prompt_field_report`` observed under ``name``."""
    return checked.observe(name, F.count(F.lit(1)).alias("rows"),
                           F.count_if(F.size("missing") > 0).alias("rows_missing"),
                           F.count_if(F.size("unexpected") > 0).alias("rows_unexpected"),
                           F.count_if(F.col("error").isNull()).alias("rows_ok"))


def observe_types(df: DataFrame, types: Mapping[str, str], name: str = "types") -> DataFrame:
    """``df`` as it is, with the counts of ``schema_check`` observed under
    ``name``: ``<column>__n`` values and ``<column>__bad`` that don't parse."""
    return df.observe(name, *[m for c, t in types.items() for m in (
        F.count(F.col(c)).alias(f"{c}__n"), F.count_if(F.col(c).isNotNull() & ~parses(c, t)).alias(f"{c}__bad"))])


class QualityTable(StreamingQueryListener):
    """Appends the observed counts of every batch to the table at ``path``
    (``query, batch, name, metric, value``). Add it with
    ``spark.streams.addListener``. Spark tells a listener of a batch after the
    batch, once or, if the query dies in between, again when it is replayed:
    read the table through ``quality_table``, which has each batch once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.id), p.batchId, name, metric, value) for name, row in p.observedMetrics.items()
                for metric, value in row.asDict().items()]
        if rows and p.numInputRows:
            self.spark.createDataFrame(rows, QUALITY).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def quality_table(spark: SparkSession, path: str) -> DataFrame:
    """The counts, each batch's once."""
    return spark.read.schema(QUALITY).parquet(path).dropDuplicates(["query", "batch", "name", "metric"])
