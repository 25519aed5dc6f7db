"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import scratch_path

# White space as the contracts name it: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared checkpoint folder and read
    it back: the lineage is cut and any executor may be lost afterwards."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


#: Stands for a null id while rows are in pandas, where a column of long ids
#: with nulls would turn to doubles.
NO_ID = -(1 << 63)


def id_in(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id")


def id_out(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID + 1} - 1)"))
