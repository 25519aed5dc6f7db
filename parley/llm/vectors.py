"""Vector tables as rows of packed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Of a vector: there, not empty, without null or non-finite components."""
    return F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> "
                  f"x is not null and not isnan(x) and abs(x) < double('infinity'))")


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec``: the usable vectors, one of each id, as 8-byte doubles.

    Rows with a null id, or a vector that is null, empty, or holds null or
    non-finite components, take no part; nor do vectors whose length is not the
    table's most common one (the longest of those, if several are). Of several
    vectors of one id the one with the smallest bytes counts.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & finite("v"))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = v.where(F.size("v") == (common["d"] if common else 0))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "vec": [np.asarray(x, dtype="<f8").tobytes() for x in pdf["v"]]})

    return v.mapInPandas(pack, "id long, vec binary").groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column, dtype: str = "<f8") -> np.ndarray:
    """A column of packed vectors as the rows of a matrix."""
    n = len(column)
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(n, -1) if n else np.zeros((0, 0))
