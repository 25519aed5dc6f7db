"""Settings tables: upsert a change log into a snapshot, resolve layered
settings by precedence, and check column types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: layer precedence, highest first
LAYERS = ["explicit", "config", "template"]


# ---------------------------------------------------------------- O26 ----
def settings_upsert(base: DataFrame | None, changes: DataFrame, *,
                    owner: str = "owner", key: str = "key", value: str = "value",
                    seq: str = "seq") -> DataFrame:
    """Snapshot after applying ``changes`` to ``base``: the latest value per
    ``(owner, key)`` wins, a NULL value deletes the key, values are replaced
    whole. ``base`` rows rank before every change.

    ``max_by(value, seq)`` per key in one partially aggregated ``groupBy``;
    deletions are applied after the aggregate."""
    ch = changes.select(owner, key, value, F.col(seq).cast("bigint").alias("_seq"),
                        F.lit(1).alias("_src"))
    if base is not None:
        b = base.select(owner, key, value, F.lit(None).cast("bigint").alias("_seq"),
                        F.lit(0).alias("_src"))
        ch = b.unionByName(ch)
    latest = ch.groupBy(owner, key).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct("_src", "_seq")).alias("_last"))
    return latest.where(F.col("_last.v").isNotNull()) \
        .select(owner, key, F.col("_last.v").alias(value))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Plain parquet has no MERGE: the full snapshot is rewritten."""
    snapshot.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- O27 ----
def settings_resolve(layers: DataFrame, *, owner: str = "owner", key: str = "key",
                     value: str = "value", layer: str = "layer",
                     order: Sequence[str] = LAYERS, seq: str | None = None) -> DataFrame:
    """One value per ``(owner, key)`` by precedence explicit > config >
    template. An explicit value wins by presence (even NULL or ''); an empty
    config value is ignored. Within one layer the latest ``seq`` wins."""
    prio = F.lit(None).cast("int")
    for i, name in enumerate(order):
        prio = F.when(F.col(layer) == name, F.lit(i)).otherwise(prio)
    cand = layers.withColumn("_prio", prio).where(
        F.col("_prio").isNotNull() &
        ~((F.col(layer) == "config") & (F.coalesce(F.col(value), F.lit("")) == "")))
    best = cand.groupBy(owner, key).agg(
        F.min_by(F.struct(F.col(value).alias("v"), F.col(layer).alias("l")),
                 F.struct(F.col("_prio"), (-F.col(seq)) if seq else F.lit(0))).alias("_b"))
    return best.select(owner, key, F.col("_b.v").alias(value), F.col("_b.l").alias("source"))


# ---------------------------------------------------------------- O29 ----
def schema_violations(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> list[str]:
    """Plan-time check of declared column types: each declared column that is
    present must have one of the allowed type names (absent ones are not
    checked). Messages ``k must be X, not Y``."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for k, types in allowed.items():
        if k in have and have[k] not in types:
            out.append(f"{k} must be {' or '.join(types)}, not {have[k]}")
    return out


# Superset of the strings Spark can cast to an integral type (trimmed
# control/space characters, sign, digits, a decimal point). Rows outside it
# are malformed without asking ``try_cast``, which pays for an exception per
# malformed row.
_NUMERIC_SHAPE = r"^[\x00-\x20]*[+-]?[0-9.]+[\x00-\x20]*$"
_INTEGRAL = {"tinyint", "smallint", "int", "integer", "bigint", "long", "short", "byte"}


def parses(c: str, t: str) -> Column:
    """Whether a column's text parses as a type."""
    cast_ok = F.col(c).try_cast(t).isNotNull()
    if t.lower() in _INTEGRAL:
        return F.when(F.col(c).cast("string").rlike(_NUMERIC_SHAPE), cast_ok) \
            .otherwise(F.lit(False))
    return cast_ok


def schema_check(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """For untyped text columns: rows whose value does not parse as the
    declared type (``try_cast`` NULL while the raw value is not NULL), per
    column, as one row of counts per column (an aggregate, no rows kept)."""
    aggs = []
    for c, t in types.items():
        bad = F.col(c).isNotNull() & ~parses(c, t)
        aggs += [F.count_if(bad).alias(f"{c}__bad"), F.count(F.col(c)).alias(f"{c}__n")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"),
                     F.col(f"{c}__n").alias("values"), F.col(f"{c}__bad").alias("violations"))
            for c, t in types.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
