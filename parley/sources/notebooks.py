"""Notebooks and shell histories as text (O24, O25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.plans.ordered import PART_CHARS, ordered_scan, text_parts

# A cell's source is a list of strings or one string.
CELL = T.StructType([T.StructField("cell_type", T.StringType()),
                     T.StructField("source", T.VariantType())])
NOTEBOOK = T.StructType([
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("cells", T.ArrayType(CELL))])

FENCE = "```"
# What a history line is stripped of: Unicode whitespace (Java's (?U)\s).
SPACES = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
          + "\u2028\u2029\u202f\u205f\u3000")


def _source(cell) -> Column:
    """The source as one text; '' for an empty or missing one."""
    v = cell["source"]
    return F.coalesce(
        F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
        F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.lit(""))


def _cell_text(cell) -> Column:
    src = F.concat(F.lit("\n"), _source(cell), F.lit("\n"))
    return F.when(cell["cell_type"] == "code",
                  F.concat(F.lit("\n" + FENCE), src, F.lit(FENCE + "\n"))).otherwise(src)


def read_notebooks(spark: SparkSession, paths, *, multiline: bool = True) -> DataFrame:
    """Notebook JSON with a fixed schema (no inference). ``multiline`` reads
    one document per file (``.ipynb``); ``False`` reads JSON lines."""
    return (spark.read.schema(NOTEBOOK).option("multiLine", multiline).json(paths)
            .withColumn("file", F.col("_metadata.file_path")))


def notebook_text(nb: DataFrame) -> DataFrame:
    """One text per notebook: cells with an empty source are skipped, code
    cells are fenced, all concatenated in order. Works on the cell array in
    the row (no shuffle)."""
    kept = F.filter(F.col("cells"), lambda c: _source(c) != "")
    return nb.withColumn("text", F.array_join(F.transform(kept, _cell_text), ""))


def notebook_cells(nb: DataFrame) -> DataFrame:
    """One row per non-empty cell: ``file, cell_no (0-based), cell_type, text``."""
    c = nb.select("*", F.posexplode("cells").alias("cell_no", "_c")).where(
        _source(F.col("_c")) != "")
    return c.select(*[x for x in nb.columns if x != "cells"],
                    F.col("cell_no").cast("bigint").alias("cell_no"),
                    F.col("_c.cell_type").alias("cell_type"),
                    _cell_text(F.col("_c")).alias("text"))


# ----------------------------------------------------------------- O25 ----
def history_lines(spark: SparkSession, paths, *, session: str | None = None) -> DataFrame:
    """Shell history lines ``n: code`` -> ``file, _block, _id, cell`` where
    cell is the stripped text after the *first* colon; lines without a colon
    or with nothing after it are dropped (so continuation lines of multi-line
    cells are lost, as in the reference). ``session`` names a column for the
    session of lines ``session/n: code``, as a file of many sessions has them
    (text; NULL for none)."""
    raw = (spark.read.text(paths)
           .select(F.col("value").alias("line"),
                   F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_id"), "*")).drop("value")
    colon = F.instr("line", ":")
    if session is not None:
        number = F.substring_index("line", ":", 1)
        raw = raw.withColumn(session, F.when(
            number.contains("/"), F.nullif(F.trim(F.substring_index(number, "/", 1)), F.lit(""))))
    # A plain cut and trim: a regular expression would try each place of the line.
    cell = F.trim(F.substr("line", colon + 1), F.lit(SPACES))
    return raw.withColumn("cell", cell).where((colon > 0) & (F.col("cell") != ""))


def history_text(lines: DataFrame, keys=("file",)) -> DataFrame:
    """One text per history file: each cell fenced, cells separated by a blank
    line, in the order of files, then lines. The ordered concat is an aggregate
    of the keys: the result is one text of each. Lines are shuffled once, by the
    keys; the lines of a split become one text first, so that files' names are
    kept and compared once a split, not once a line."""
    keys = list(keys)
    piece = F.concat(F.lit(FENCE + "\n"), F.col("cell"), F.lit("\n" + FENCE))
    whole = lambda *order: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, "_p"))), lambda x: x["_p"]), "\n\n")
    split = [c for c in ("file", "_block") if c not in keys]
    pieces = lines.select(*keys, *split, "_id", piece.alias("_p"))
    return ((pieces.repartition(*keys) if keys else pieces)
            .groupBy(*keys, *split).agg(whole("_id").alias("_p"))
            .groupBy(*keys).agg(whole(*split).alias("text")))


def history_text_parts(lines: DataFrame, keys=("file",), *, part_chars: int = PART_CHARS,
                       parts: int | None = None) -> DataFrame:
    """``keys..., part, text``: the text of ``history_text`` in parts of
    ``part_chars`` characters, for histories of any length: no group holds more
    than a part (see ``text_parts``)."""
    keys = list(keys)
    order = [c for c in ("file", "_block", "_id") if c not in keys]
    piece = F.concat(F.lit(FENCE + "\n"), F.col("cell"), F.lit("\n" + FENCE))
    return text_parts(lines.withColumn("piece", piece), keys, order, "piece", part_chars=part_chars, parts=parts)


def history_cell_numbers(lines: DataFrame, keys=("file",)) -> DataFrame:
    """Cells with their 0-based number in the key, in the order of files, then
    lines (skew-safe ordered scan)."""
    return ordered_scan(lines, list(keys), [c for c in ("file", "_block", "_id") if c not in keys],
                        position="cell_no")
