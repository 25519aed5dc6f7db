"""Error logs and typed lines: enrich error records with the session's
explanation, route typed lines, strip debugger-call lines, mask keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import (DEBUGGER_MARKER, VERBOSE_PREFIX, is_conversational,
                                   looks_like_key, redact, strip_comment_prefix,
                                   strip_marker_lines)
ERROR_LEVEL = "ERROR"


# ---------------------------------------------------------------- O21 ----
def session_explanations(log: DataFrame, *, session: str = "session_id",
                         order: tuple[str, ...] = ("seq",),
                         code: str = "new_code") -> DataFrame:
    """Newest non-empty completion and code per session: two conditional
    ``max_by`` aggregates in one partially aggregated ``groupBy``."""
    ordkey = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])

    def newest(v):
        good = F.col(v).isNotNull() & (F.col(v) != "")
        return F.max_by(F.when(good, F.col(v)), F.when(good, ordkey))

    return log.groupBy(session).agg(newest("completion").alias("completion"),
                                    newest(code).alias("code"))


def error_enrich(records: DataFrame, explanations: DataFrame, *,
                 session: str = "session_id", level: str = "level",
                 message: str = "message") -> DataFrame:
    """Append the session's explanation and code to each error record's
    message, separated by blank lines; other records, and errors of sessions
    without a completion, are unchanged. Only error records are joined; the
    others pass by unshuffled."""
    e = explanations.select(F.col(session).alias("_s"), F.col("completion").alias("_c"),
                            F.col("code").alias("_code"))
    is_error = F.coalesce(F.col(level) == F.lit(ERROR_LEVEL), F.lit(False))
    j = records.where(is_error).join(e, F.col(session) == F.col("_s"), "left")
    enriched = F.concat_ws("\n\n", F.col(message), F.col("_c"),
                           F.when(F.col("_code") != "", F.col("_code")))
    errors = j.withColumn(message, F.when(F.col("_c").isNotNull(), enriched)
                          .otherwise(F.col(message))).drop("_s", "_c", "_code")
    return errors.unionByName(records.where(~is_error))


# ---------------------------------------------------------------- O22 ----
def route_turns(lines: DataFrame, line: str = "line") -> DataFrame:
    """``kind`` conversational (contains ``?`` or starts with ``>``) or
    command; ``verbose`` if it starts with ``[dev]``; ``text`` is what is
    sent (leading ``>`` removed from conversational lines)."""
    conv = is_conversational(line)
    return (lines.withColumn("kind", F.when(conv, "conversational").otherwise("command"))
            .withColumn("verbose", conv & F.col(line).startswith(VERBOSE_PREFIX))
            .withColumn("text", F.when(conv, strip_comment_prefix(line))
                        .otherwise(F.col(line))))


def write_routed(routed: DataFrame, path: str, mode: str = "append") -> None:
    """Send conversational lines and commands to separate sinks: one
    partitioned write, a folder per ``kind``."""
    routed.write.mode(mode).partitionBy("kind").parquet(path)


# ---------------------------------------------------------------- O23 ----
def strip_lines(df: DataFrame, col: str = "code", marker: str = DEBUGGER_MARKER,
                out: str | None = None) -> DataFrame:
    """Drop lines whose stripped text starts with ``marker``."""
    return df.withColumn(out or col, strip_marker_lines(col, marker))


# ---------------------------------------------------------------- O28 ----
def redact_columns(df: DataFrame, cols, suffix: str = "") -> DataFrame:
    """Keep 4 characters of each value, the rest become ``*``; also flag
    values that do not look like keys (``{c}_looks_valid``)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    for c in cols:
        df = df.withColumn(f"{c}_looks_valid", looks_like_key(c)) \
               .withColumn(c + suffix, redact(c))
    return df


def redact_secrets(df: DataFrame, text: str, pattern: str, group: int = 1,
                   keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per secret found in ``text`` by ``pattern``: masked value and
    the key-shape flag (the clear value never leaves the expression)."""
    found = df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern),
                                                               group)).alias("pos", "_v"))
    return found.select(*keys, F.col("pos").cast("bigint").alias("pos"),
                        redact("_v").alias("masked"),
                        looks_like_key("_v").alias("looks_valid"))
