"""Multi-line text logs: write records as ``asctime [LEVEL]: message`` lines
(O20) and read them back into records (O19).

A record is a line that starts with the record prefix plus every following
line up to the next record start. Files are read as ordinary splits; the line
order inside a file comes from ``(file_block_start, monotonically_increasing_id)``
and the record number of each line is a running count of record starts over
the skew-safe ordered scan, so no file is ever read
by one task and records that cross a split boundary are still joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.ordered import ordered_scan

# Record format (Python logging's asctime has milliseconds
# after a comma) and the pattern that recognises a record start. A level is
# any text without a closing bracket ("Level 15" is Python's own name for an
# unnamed level).
TS_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
NO_TS = "0000-00-00 00:00:00,000"
RECORD_START = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} \[[^\]\r\n]*\]: "
# A message line that itself looks like a record start is written with one
# extra leading space; the reader removes exactly one.
ESCAPE_FIND = r"(\n *)(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} \[[^\]\r\n]*\]: )"
UNESCAPE = r"^ ( *\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3} \[[^\]\r\n]*\]: )"


def format_records(df: DataFrame, *, ts: str = "ts", level: str = "level",
                   message: str = "message") -> Column:
    """The record's text. Nothing is lost to a NULL: a NULL time is written as
    all zeros and a NULL level as an empty one (both read back as NULL), a NULL
    message as an empty one. A closing bracket or line break in a level becomes
    a space."""
    msg = F.regexp_replace(F.coalesce(F.col(message).cast("string"), F.lit("")),
                           ESCAPE_FIND, "$1 $2")
    lev = F.regexp_replace(F.coalesce(F.col(level).cast("string"), F.lit("")), r"[\]\r\n]", " ")
    return F.concat(F.coalesce(F.date_format(F.col(ts), TS_FORMAT), F.lit(NO_TS)), F.lit(" ["), lev,
                    F.lit("]: "), msg)


def log_write(df: DataFrame, path: str, mode: str = "a", *, ts: str = "ts",
              level: str = "level", message: str = "message", order=()) -> None:
    """Write records as text, lines ended by ``\n`` alone. ``mode`` ``a``
    appends, ``w`` overwrites (the reference's file modes). With ``order``
    (column names) the records of each file, and the files by name, are in that
    order."""
    if mode not in ("a", "w"):
        raise ValueError("mode must be 'a' or 'w'")
    if order:
        df = df.orderBy(*order)
    out = df.select(format_records(df, ts=ts, level=level, message=message).alias("value"))
    out.write.mode("append" if mode == "a" else "overwrite").option("lineSep", "\n").text(path)


def log_lines(spark: SparkSession, paths) -> DataFrame:
    """Raw lines with file, split start and in-split order. Only ``\n`` ends a
    line: a carriage return in a message is part of it."""
    return (spark.read.text(paths, lineSep="\n")
            .select(F.col("value").alias("line"),
                    F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_id")))


def _parsed(first: Column, rest: Column, is_rec: Column) -> list[Column]:
    """``ts, level, message`` of a record's first line and the others."""
    more = F.transform(rest, lambda x: F.regexp_replace(x, UNESCAPE, "$1"))
    head = F.when(is_rec, F.regexp_replace(first, RECORD_START, "")).otherwise(first)
    body = F.when(F.size(more) > 0, F.concat(head, F.lit("\n"), F.array_join(more, "\n"))).otherwise(head)
    stamp = F.try_to_timestamp(F.substring(first, 1, 23), F.lit(TS_FORMAT)).cast("timestamp_ntz")
    level = F.regexp_extract(first, r"^[^\[]*\[([^\]\r\n]*)\]: ", 1)
    return [F.when(is_rec, stamp).alias("ts"), F.when(is_rec & (level != ""), level).alias("level"),
            body.alias("message")]


def log_records(spark: SparkSession, paths, parts: int | None = None) -> DataFrame:
    """Records ``file, rec, ts, level, message`` (``rec`` 1-based within the
    file). Each line before a file's first record is a row of its own, with
    ``rec`` 0 and NULL ts and level, so a file that is no log is not gathered
    into one row."""
    lines = log_lines(spark, paths).withColumn(
        "_start", F.col("line").rlike(RECORD_START).cast("int"))
    s = ordered_scan(lines, "file", ["_block", "_id"], sums=["_start"], parts=parts)
    grouped = s.groupBy("file", F.col("_start_run").alias("rec"),
                        F.when(F.col("_start_run") == 0, F.col("_id")).alias("_alone")).agg(
        F.array_sort(F.collect_list(F.struct("_block", "_id", "line"))).alias("_l"))
    rest = F.transform(F.slice(F.col("_l"), 2, F.greatest(F.size("_l") - 1, F.lit(0))), lambda x: x["line"])
    return grouped.select("file", F.col("rec").cast("bigint").alias("rec"),
                          *_parsed(F.element_at(F.col("_l"), 1)["line"], rest, F.col("rec") > 0))


# ------------------------------------------------------------- streaming --
def stream_log_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """Streaming O19 for rolled log files: each new file is one row
    (``wholetext``), cut into records at every line that starts a record
    (look-ahead split), stateless. Files must be of bounded size (rolled
    logs); very large single files belong to the split-safe batch reader."""
    # `wholetext` must be passed to text(): its default argument would reset
    # an option set earlier.
    raw = (spark.readStream.options(**options).text(path, wholetext=True)
           .select(F.col("value"), F.col("_metadata.file_path").alias("file"))
           .where(F.col("value") != ""))  # empty part files hold no record
    body = F.regexp_replace(F.col("value"), r"\n\z", "")
    parts = F.split(body, "\n(?=" + RECORD_START[1:] + ")")
    recs = raw.select("file", F.posexplode(parts).alias("_p", "_r"))
    lines = F.split(F.col("_r"), "\n")
    first = F.element_at(lines, 1)
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return recs.select("file", *_parsed(first, rest, first.rlike(RECORD_START)))


def stream_log_write(stream: DataFrame, path: str, checkpoint: str, *, ts: str = "ts",
                     level: str = "level", message: str = "message"):
    """Streaming O20: append formatted records to a text file sink. Returns
    the started query."""
    out = stream.select(format_records(stream, ts=ts, level=level, message=message)
                        .alias("value"))
    return (out.writeStream.format("text").option("path", path).option("lineSep", "\n")
            .option("checkpointLocation", checkpoint).outputMode("append").start())
