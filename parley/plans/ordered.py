"""Skew-safe ordered scans within groups (running sums, first/last values,
carry-forward of the last non-null value).

A plain ``Window.partitionBy(key).orderBy(order)`` sends a whole group to one
task; one conversation or session holding a third of the table would then be
a third of the job on one core. Here the rows are partitioned by range on
``(keys, order)``, so a hot group is split by rows wherever its order values
lie (dense turns, epoch times, random 64-bit ids), and written once to the
shared folder with their partition's number:

1. one window per ``(keys, partition)`` gives local running values; no window
   group is larger than a range partition;
2. a partially aggregated table of ``(keys, partition)`` totals, and a window
   over the partitions of a key, give offsets. Only groups that lie in several
   partitions are kept: at most two rows a partition, and the partitions of
   hot groups;
3. the offsets are left-joined back on ``(keys, partition)``; AQE turns the
   join into a broadcast when their measured size allows it.

The input is evaluated for the range partitioning only (Spark samples the
keys, then writes the rows); both branches read the written rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.session import scratch_path

PART = "_part"

#: Characters of a part of a long text.
PART_CHARS = 1 << 20


def _names(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def ordered_scan(df: DataFrame, keys: Sequence[str] | str,
                 order: Sequence[str] | str, *,
                 sums: Sequence[str] = (), firsts: Sequence[str] = (),
                 lasts: Sequence[str] = (), carries: Sequence[str] = (),
                 position: str | None = None, group_rows: str | None = None,
                 parts: int | None = None) -> DataFrame:
    """Add, per row of each group ``keys`` in ``order``:

    * ``{c}_run`` / ``{c}_total`` for ``c`` in ``sums`` (inclusive prefix sum,
      group total);
    * ``{c}_first`` / ``{c}_last``: value of ``c`` at the group's first/last row;
    * ``{c}_prev``: last non-NULL ``c`` strictly before the row (NULL if none);
    * ``position`` (0-based rank in the group) and ``group_rows`` if named.

    ``parts`` is the number of range partitions (default: the session's
    shuffle partitions, joined by AQE where they are small). ``order`` must be
    unique within a group.
    """
    keys, order = _names(keys), _names(order)
    sums, firsts, lasts, carries = map(list, (sums, firsts, lasts, carries))
    by = [*keys, *order]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    d = ranged.withColumn(PART, F.spark_partition_id())
    path = scratch_path(df.sparkSession, "ordered")
    d.write.parquet(path)
    d = df.sparkSession.read.schema(d.schema).parquet(path)

    # -- 1. local window (one Exchange on (keys, partition), one Sort) ------
    wl = Window.partitionBy(*keys, PART).orderBy(*order)
    run = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = wl.rowsBetween(Window.unboundedPreceding, -1)
    full = wl.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = [F.count(F.lit(1)).over(run).alias("_l_cnt"),
             F.count(F.lit(1)).over(full).alias("_c_cnt")]
    for c in sums:
        local += [F.sum(c).over(run).alias(f"_l_{c}"),
                  F.sum(c).over(full).alias(f"_c_{c}")]
    for c in firsts:
        local.append(F.first(c).over(full).alias(f"_cf_{c}"))
    for c in lasts:
        local.append(F.last(c).over(full).alias(f"_cl_{c}"))
    for c in carries:
        local.append(F.last(c, ignorenulls=True).over(before).alias(f"_lp_{c}"))
    loc = d.select("*", *local)

    # -- 2. totals: partial aggregate, then offsets across partitions ------
    # A bare order column keeps min_by/max_by buffers fixed-width for
    # fixed-width values, so the totals are a HashAggregate (no sort).
    ordkey = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])
    aggs = [F.count(F.lit(1)).alias("_s_cnt")]
    for c in sums:
        aggs.append(F.sum(c).alias(f"_s_{c}"))
    for c in firsts:
        aggs.append(F.min_by(F.col(c), ordkey).alias(f"_s_f_{c}"))
    for c in lasts:
        aggs.append(F.max_by(F.col(c), ordkey).alias(f"_s_l_{c}"))
    for c in carries:
        nn = F.col(c).isNotNull()
        aggs.append(F.max_by(F.when(nn, F.col(c)), F.when(nn, ordkey))
                    .alias(f"_s_p_{c}"))
    totals = d.groupBy(*keys, PART).agg(*aggs)
    cw = Window.partitionBy(*keys).orderBy(PART)
    prev = cw.rowsBetween(Window.unboundedPreceding, -1)
    whole = cw.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = [F.count(F.lit(1)).over(whole).alias("_n_parts"),
            F.coalesce(F.sum("_s_cnt").over(prev), F.lit(0)).alias("_o_cnt"),
            F.sum("_s_cnt").over(whole).alias("_g_cnt")]
    for c in sums:
        offs += [F.coalesce(F.sum(f"_s_{c}").over(prev), F.lit(0)).alias(f"_o_{c}"),
                 F.sum(f"_s_{c}").over(whole).alias(f"_g_{c}")]
    for c in firsts:
        offs.append(F.first(f"_s_f_{c}").over(whole).alias(f"_g_f_{c}"))
    for c in lasts:
        offs.append(F.last(f"_s_l_{c}").over(whole).alias(f"_g_l_{c}"))
    for c in carries:
        offs.append(F.last(f"_s_p_{c}", ignorenulls=True).over(prev)
                    .alias(f"_g_p_{c}"))
    off = (totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                         F.col(PART).alias("_k_part"), *offs)
           .where(F.col("_n_parts") > 1))

    # -- 3. join offsets back (small side; AQE broadcasts it when small) ---
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond.append(F.col(PART) == F.col("_k_part"))
    j = loc.join(off, cond, "left")
    multi = F.col("_k_part").isNotNull()
    out = []
    for c in sums:
        out += [(F.col(f"_l_{c}") + F.coalesce(F.col(f"_o_{c}"), F.lit(0)))
                .alias(f"{c}_run"),
                F.when(multi, F.col(f"_g_{c}")).otherwise(F.col(f"_c_{c}"))
                .alias(f"{c}_total")]
    for c in firsts:
        out.append(F.when(multi, F.col(f"_g_f_{c}")).otherwise(F.col(f"_cf_{c}"))
                   .alias(f"{c}_first"))
    for c in lasts:
        out.append(F.when(multi, F.col(f"_g_l_{c}")).otherwise(F.col(f"_cl_{c}"))
                   .alias(f"{c}_last"))
    for c in carries:
        out.append(F.coalesce(F.col(f"_lp_{c}"), F.col(f"_g_p_{c}"))
                   .alias(f"{c}_prev"))
    if position:
        out.append((F.col("_l_cnt") + F.coalesce(F.col("_o_cnt"), F.lit(0)) - 1)
                   .alias(position))
    if group_rows:
        out.append(F.when(multi, F.col("_g_cnt")).otherwise(F.col("_c_cnt"))
                   .alias(group_rows))
    return j.select(*[F.col(c) for c in df.columns], *out)


def text_parts(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str, piece: str, *,
               sep: str = "\n\n", part_chars: int = PART_CHARS, parts: int | None = None) -> DataFrame:
    """``keys..., part, text``: of each key, its pieces in order with ``sep``
    between them, cut into parts of exactly ``part_chars`` characters (the last
    may be shorter). The parts of a key, one after another, are its text.

    Where a piece starts is the sum of the lengths before it, from the ordered
    scan; a piece is cut at the parts it lies in, so no group is longer than a
    part, however long the key's text is. NULL pieces are left out, a key
    without others has no part; a key whose text is empty has one empty part.
    ``order`` must be unique within a key."""
    keys, order = _names(keys), _names(order)
    scanned = ordered_scan(
        df.select(*keys, *order, F.col(piece).alias("_piece")).where("_piece is not null")
        .withColumn("_chars", F.length("_piece").cast("long")),
        keys, order, sums=["_chars"], position="_at", group_rows="_of", parts=parts)
    size = F.lit(part_chars).cast("long")
    placed = scanned.select(
        *keys, F.when(F.col("_at") < F.col("_of") - 1, F.concat("_piece", F.lit(sep))).otherwise(F.col("_piece")).alias("_text"),
        (F.col("_chars_run") - F.col("_chars") + F.col("_at") * len(sep)).alias("_from"), F.col("_at")) \
        .withColumn("_to", F.col("_from") + F.length("_text")) \
        .where("_to > _from or _at = 0")
    cut = placed.withColumn("part", F.explode(F.sequence(
        F.floor(F.col("_from") / size), F.floor(F.greatest(F.col("_from"), F.col("_to") - 1) / size))))
    begin = F.greatest(F.col("_from"), F.col("part") * size)
    end = F.least(F.col("_to"), (F.col("part") + 1) * size)
    return cut.select(*keys, "part", begin.alias("_begin"), F.substring(
        F.col("_text"), (begin - F.col("_from") + 1).cast("int"), (end - begin).cast("int")).alias("_text")) \
        .groupBy(*keys, "part").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_begin", "_text"))), lambda x: x["_text"]), "").alias("text"))
