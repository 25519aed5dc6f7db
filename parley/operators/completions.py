"""Completions: code blocks, explanation, the per-session completion log,
newest useful value, line diffs between revisions and model calls in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DataType, MapType,
                               NumericType, StringType, StructField, StructType)

from parley.functions.text import (LINE_BREAK, MULTI_BLOCK_PREFIX, code_blocks,
                                   explanation, join_code_blocks)
from parley.plans.ordered import ordered_scan


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- O13 ----
def extract_code_blocks(df: DataFrame, text: str = "completion",
                        keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per fenced code block: ``keys..., block_no (1-based), code``."""
    return df.select(*keys, F.posexplode(code_blocks(text)).alias("_p", "code")) \
        .select(*keys, (F.col("_p") + 1).cast("bigint").alias("block_no"), "code")


# ---------------------------------------------------------------- O14 ----
def join_blocks(df: DataFrame, text: str = "completion", out: str = "code",
                prefix_template: str = MULTI_BLOCK_PREFIX) -> DataFrame:
    """All blocks of a completion as one string (numbered when several)."""
    return df.withColumn(out, join_code_blocks(code_blocks(text), prefix_template))


# ---------------------------------------------------------------- O15 ----
def default_parser(text: Column) -> Column:
    """``STRUCT<explanation, code, extra>``: text before the first fence, the
    joined code blocks and no extra values."""
    return F.struct(explanation(text).alias("explanation"),
                    join_code_blocks(code_blocks(text)).alias("code"),
                    F.lit(None).cast("map<string,string>").alias("extra"))


def parse_completion(df: DataFrame, text: str = "completion",
                     parser: Callable[[Column], Column] = default_parser) -> DataFrame:
    """Add ``explanation``, ``code``, ``extra`` from ``parser`` (any
    ``Column -> STRUCT`` with those fields, e.g. one built on ``from_json``)."""
    p = parser(_col(text))
    return df.withColumn("_parsed", p).select(
        "*", F.col("_parsed.explanation").alias("explanation"),
        F.col("_parsed.code").alias("code"),
        F.col("_parsed.extra").cast("map<string,string>").alias("extra")) \
        .drop("_parsed")


# ---------------------------------------------------------------- O16 ----
def completion_log(answers: DataFrame, *, session: str = "session_id",
                   seq: str = "seq", completion: str = "completion",
                   old_code: str | None = None, keep: Sequence[str] = (),
                   parser: Callable[[Column], Column] = default_parser) -> DataFrame:
    """Log rows for answered questions: ``session_id, seq, completion,
    explanation, code (the snippet asked about), new_code, lines_added,
    lines_removed, extra``.

    An empty answer is replaced by the fixed apology text before parsing. The
    diff of old and new code is the number of lines only one of them has, as
    in O18 (character colouring is display only); none without new code. Columns
    named by ``keep`` follow.
    """
    answer = F.regexp_replace(F.col(completion), r"(?U)^\s+|\s+\z", "")
    answer = F.when(answer == "", F.lit(EMPTY_ANSWER)).otherwise(answer)
    base = answers.select(F.col(session).alias("_sid"), F.col(seq).alias("_seq"),
                          answer.alias("_answer"),
                          (F.col(old_code) if old_code else F.lit("")).alias("_old"),
                          F.struct(F.lit(0).alias("_"), *keep).alias("_keep"))
    p = parse_completion(base, "_answer", parser).withColumnRenamed("code", "_new")
    gone = F.when(F.col("_new") == "", F.lit(0).cast("bigint")).otherwise(_only_in("_old", "_new"))
    return p.select(F.col("_sid").alias("session_id"), F.col("_seq").alias("seq"),
                    F.col("_answer").alias("completion"), "explanation",
                    F.col("_old").alias("code"), F.col("_new").alias("new_code"),
                    _only_in("_new", "_old").alias("lines_added"), gone.alias("lines_removed"), "extra",
                    *[F.col(f"_keep.{c}").alias(c) for c in keep])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbered(lines: Column) -> Column:
    """Each line with how often it came before, as text: all are different.
    One sort; runs of equal lines are counted from where they start."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return _let(starts, lambda at: F.flatten(F.transform(at, lambda i, j: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(s)) - i - 1),
            lambda k: F.concat(k.cast("string"), F.lit(":"), F.get(s, i))))))

    return _let(F.sort_array(lines), runs)


def _only_in(a: str, b: str) -> Column:
    """Lines of ``a`` beyond those that ``b`` also has, counting repeats: a sort
    of each and one hash lookup a line. A NULL text has no lines."""
    la, lb = text_lines(F.col(a)), text_lines(F.col(b))
    return F.size(F.array_except(_numbered(la), _numbered(lb))).cast("bigint")


# Fixed value: text stored when the model returns only whitespace.
EMPTY_ANSWER = "Sorry, I don't know. Can you try rephrasing your question?"


# ---------------------------------------------------------------- O17 ----
def is_useful(v: Column, dt: DataType) -> Column:
    """Whether a value says something: not NULL, and by its type not an empty
    text, binary, array or map, not zero and not false. NaN, times and structs
    (with fields) always do. Never NULL."""
    if isinstance(dt, (StringType, BinaryType)):
        ok = F.length(v) > 0
    elif isinstance(dt, (ArrayType, MapType)):
        ok = F.size(v) > 0
    elif isinstance(dt, NumericType):
        ok = v != F.lit(0).cast(dt)
    elif isinstance(dt, BooleanType):
        ok = v
    else:
        ok = F.lit(not (isinstance(dt, StructType) and not dt.fields))
    return v.isNotNull() & ok


def latest_nonempty(log: DataFrame, value: str, *, key: str = "session_id",
                    order: tuple[str, ...] = ("seq",), newest: bool = True,
                    out: str = "latest") -> DataFrame:
    """Newest (or oldest) useful ``value`` per key; NULL when none. See
    ``is_useful``: an empty text, list or map, zero and false are not.

    ``max_by``/``min_by`` with the condition inside: partial aggregation
    before the shuffle, one row per key and partition exchanged."""
    v = F.col(value)
    good = is_useful(v, log.schema[value].dataType)
    ordkey = F.when(good, F.struct(*[F.col(o) for o in order]))
    agg = F.max_by if newest else F.min_by
    return log.groupBy(key).agg(agg(F.when(good, v), ordkey).alias(out))


# ---------------------------------------------------------------- O18 ----
def text_lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them; '' and NULL have none."""
    body = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")) \
        .otherwise(F.split(body, LINE_BREAK))


def revision_diff(versions: DataFrame, *, doc: str = "doc_id",
                  version: str = "version", text: str = "text",
                  parts: int | None = None) -> DataFrame:
    """Lines added / removed from each version to the next (multiset diff);
    the first version adds all its lines.

    The next version comes from a skew-safe ordered scan of the two id columns
    in descending order, joined back to the texts; each line then contributes
    ``+1`` to its own version and ``-1`` to the next one, summed with one
    partially aggregated ``groupBy``."""
    ids = versions.select(doc, version, (-F.col(version)).alias("_neg"), F.col(version).alias("_v"))
    nxt = ordered_scan(ids, doc, "_neg", carries=["_v"], parts=parts) \
        .select(F.col(doc).alias("_d0"), F.col(version).alias("_v0"), F.col("_v_prev").alias("_next"))
    v = versions.select(doc, version, text).join(
        nxt, F.col(doc).eqNullSafe(F.col("_d0")) & (F.col(version) == F.col("_v0")))
    rows = v.select(doc, version, "_next", F.explode_outer(text_lines(F.col(text))).alias("_line"))
    deltas = rows.select(
        doc, F.explode(F.array(
            F.struct(F.col(version).alias("v"), F.lit(1).alias("d")),
            F.struct(F.col("_next").alias("v"), F.lit(-1).alias("d")))).alias("_e"),
        "_line")
    deltas = deltas.where(F.col("_e.v").isNotNull()).select(
        doc, F.col("_e.v").alias(version), "_line",
        F.when(F.col("_line").isNull(), 0).otherwise(F.col("_e.d")).alias("_d"))
    per_line = deltas.groupBy(doc, version, "_line").agg(F.sum("_d").alias("_d"))
    return per_line.groupBy(doc, version).agg(
        F.sum(F.greatest(F.col("_d"), F.lit(0))).cast("bigint").alias("lines_added"),
        F.sum(F.greatest(-F.col("_d"), F.lit(0))).cast("bigint").alias("lines_removed"))


# ---------------------------------------------------------------- O30 ----
class RowErrors(Exception):
    """Raised by a model for a batch of which some prompts failed:
    ``results`` has a completion or an exception for each prompt, in order, so
    that no prompt that was answered is sent again."""

    def __init__(self, results):
        super().__init__("some prompts of the batch failed")
        self.results = list(results)


def upper_model(prompt: Column) -> Column:
    """Stub model as a native expression: the last message, upper-cased."""
    return F.upper(prompt)


def batch_complete(prompts: DataFrame,
                   model: Callable[[pd.Series], Sequence] | None = None, *,
                   native: Callable[[Column], Column] | None = None,
                   prompt: str = "prompt") -> DataFrame:
    """Add ``completion`` and ``error`` for each prompt.

    ``native`` is a model that is a Column expression (the default is the
    stub); ``model`` is called once for each Arrow batch of prompts and returns
    one completion a prompt. A model that raises RowErrors names the failing
    rows. If it raises anything else, or returns another number of completions,
    no prompt is sent again: each row of the batch gets the error and a NULL
    completion (the reference withdraws the turn and re-raises; a table job
    keeps the other batches)."""
    if model is None:
        return prompts.select("*", (native or upper_model)(F.col(prompt)).alias("completion"),
                              F.lit(None).cast("string").alias("error"))
    schema = StructType(list(prompts.schema.fields) + [
        StructField("completion", StringType()), StructField("error", StringType())])

    def told(e: BaseException) -> str:
        return f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            try:
                results = list(model(pdf[prompt].reset_index(drop=True)))
            except RowErrors as e:
                results = e.results
            except Exception as e:  # noqa: BLE001 - told in the error column
                results = [e] * n
            if len(results) != n:
                results = [ValueError(f"the model returned {len(results)} completions for {n} prompts")] * n
            failed = [isinstance(r, BaseException) for r in results]
            yield pdf.assign(
                completion=pd.Series([None if f else r for r, f in zip(results, failed, strict=True)],
                                     index=pdf.index, dtype=object),
                error=pd.Series([told(r) if f else None for r, f in zip(results, failed, strict=True)],
                                index=pdf.index, dtype=object))

    return prompts.mapInPandas(run, schema)
