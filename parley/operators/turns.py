"""Conversation budget: word counts, truncation to a model's word budget
(once, and at every user turn), status, rendering, model limits.

Input ``turns(conv_id, turn, role, text)``; ``turn`` orders a conversation and
is unique in it. The first row of a conversation is pinned (whatever its role).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.text import speaker_label, speaker_words
from parley.plans.ordered import PART_CHARS, ordered_scan, text_parts

# Fixed values (reference model table and budget rule):
#   context windows in tokens per model name; unknown models get the smallest
MODEL_WINDOWS = [
    ("gpt-3.5-turbo", 16385),
    ("gpt-4", 8192),
    ("gpt-4-turbo", 128000),
    ("gpt-4o", 128000),
    ("gpt-4o-mini", 128000),
]
#   words per token used for both budgets
WORDS_PER_TOKEN = 0.75

# Rows of a position chunk of O3, at least.
POSITION_ROWS = 1 << 16


def _lim(limit) -> Column:
    return limit if isinstance(limit, Column) else F.lit(limit)


# ---------------------------------------------------------------- O1 -----
def turn_words(turns: DataFrame, text: str = "text",
               out: str = "n_words") -> DataFrame:
    """Words of ``"Speaker: text"`` per row: content tokens + 1."""
    return turns.withColumn(out, speaker_words(text))


# ---------------------------------------------------------------- O2 -----
def kept_turns(words: DataFrame, *, key: str = "conv_id", order: str = "turn", limit: str = "limit",
               parts: int | None = None) -> DataFrame:
    """The rows of ``words`` (``key, order, n_words, limit`` and what else is to
    travel with them; no text) that O2 keeps, and their ``status``."""
    s = ordered_scan(words, key, order, sums=["n_words"],
                     firsts=["n_words", order], lasts=["n_words", order], parts=parts)
    lim = F.col(limit)
    w0 = F.col("n_words_first")
    suffix = F.col("n_words_total") - F.col("n_words_run") + F.col("n_words")
    single = F.col(f"{order}_first") == F.col(f"{order}_last")
    overflow = F.when(single, w0 > lim).otherwise(w0 + F.col("n_words_last") > lim)
    keep = ((F.col(order) == F.col(f"{order}_first")) |
            (F.col(order) == F.col(f"{order}_last")) | (w0 + suffix <= lim))
    return s.where(keep).select(*words.columns, F.when(overflow, "overflow").otherwise("ok").alias("status"))


def history_truncate(turns: DataFrame, limit, *, key: str = "conv_id",
                     order: str = "turn", parts: int | None = None, keyed: bool = False) -> DataFrame:
    """Final history of each conversation after dropping the oldest
    non-pinned turns until it fits ``limit`` words.

    Closed form of the pop loop: row *k* stays iff it is the first row, the
    last row, or ``w_first + suffix_words(k) <= limit``. ``status`` is
    ``overflow`` when the first and last rows alone exceed the limit (a lone
    row: when it exceeds it), else ``ok``. ``limit`` may be a column.

    The scan carries key, order and word count only; the kept rows then get
    their other columns by a join on key and order, so no dropped text goes
    further than the table's scan, and a hot conversation is spread by its
    turns. ``keyed`` says that neither key nor order is NULL: over a table of
    ``save_turns`` the texts are then not shuffled at all.
    """
    narrow = turns.select(F.col(key), F.col(order), speaker_words("text").alias("n_words"), _lim(limit).alias("_limit"))
    kept = kept_turns(narrow, key=key, order=order, limit="_limit", parts=parts).select(
        F.col(key).alias("_k"), F.col(order).alias("_o"), "n_words", "status")
    same = F.col(key) == F.col("_k"), F.col(order) == F.col("_o")
    if not keyed:
        same = F.col(key).eqNullSafe(F.col("_k")), F.col(order).eqNullSafe(F.col("_o"))
    return turns.join(kept, same[0] & same[1]).select(*turns.columns, "n_words", "status")


def save_turns(turns: DataFrame, table: str, buckets: int, *, key: str = "conv_id", order: str = "turn") -> None:
    """Save turns as a table bucketed and sorted by key and order, so that O2
    joins kept rows to their texts without shuffling these. ``buckets``: so
    many that one of them suits a task."""
    turns.write.bucketBy(buckets, key, order).sortBy(key, order).mode("overwrite").saveAsTable(table)


# ---------------------------------------------------------------- O3 -----
def context_at_turn(turns: DataFrame, limit, *, key: str = "conv_id",
                    order: str = "turn", role: str = "role",
                    user_role: str = "user", parts: int | None = None,
                    position_rows: int = POSITION_ROWS) -> DataFrame:
    """What is sent to the model at each user turn when the history is
    truncated after every user message (drops are permanent, answers are
    appended afterwards).

    For user turn *t* the first kept row *i* is the smallest with
    ``w_first + words(i..t) <= limit``; when even *i = t* does not fit the
    status is ``overflow`` and only the pinned row and *t* are sent.

    Found as an as-of lookup: candidates keyed ``cum(i) - n(i)`` and probes
    keyed ``cum(t) + w_first - limit`` in one window ordered by key. Every row has at
    least one word, so *i* is at most ``limit`` rows before *t*: with
    position chunks of ``max(limit, position_rows)`` rows and each candidate
    copied into the next chunk, no window partition exceeds three chunks.

    ``limit`` is an int or a column, each user turn's own (e.g. the hard budget
    of its model, O6); the largest one in the data sizes the position chunks.
    A NULL limit keeps nothing but the pinned row and the turn (``overflow``).

    Output per user turn: ``conv_id, turn, first_kept, turns_sent, words,
    status``.
    """
    t = turn_words(turns).select(key, order, role, "n_words",
                                 F.coalesce(_lim(limit).cast("bigint"), F.lit(0)).alias("_limit"))
    s = ordered_scan(t, key, order, sums=["n_words"], firsts=["n_words"],
                     position="_pos", parts=parts)
    bound = s.agg(F.max("_limit")).first()[0] or 0
    limit = F.col("_t_lim")
    width = max(bound, int(position_rows), 1)
    s = s.withColumn("_c2", F.floor(F.col("_pos") / F.lit(width)))
    w0 = F.col("n_words_first")
    # One pass emits both sides of the as-of lookup: each non-pinned row is a
    # candidate in its position chunk and in the next one; each user row is
    # also a probe in its own chunk. (Two branches over the scan would run
    # the whole ordered scan twice.)
    before_i = F.col("n_words_run") - F.col("n_words")
    turn_t = s.schema[order].dataType
    cand_val = F.struct(F.col("_pos").cast("bigint").alias("pos"),
                        F.col(order).alias("turn"), before_i.cast("bigint").alias("before"))

    def item(c2, k, probe, cand, t_pos, t_turn, t_run, t_n, w, keep, lim=F.lit(None)):
        return F.struct(keep.alias("_keep"), c2.cast("bigint").alias("_c2"),
                        k.cast("bigint").alias("_key"), F.lit(probe).alias("_probe"),
                        cand.alias("_cand"), t_pos.cast("bigint").alias("_t_pos"),
                        t_turn.cast(turn_t).alias("_t_turn"), t_run.cast("bigint").alias("_t_run"),
                        t_n.cast("bigint").alias("_t_n"), w.cast("bigint").alias("_w0"),
                        lim.cast("bigint").alias("_t_lim"))

    nul = F.lit(None)
    is_cand = F.col("_pos") >= 1
    items = F.array(
        item(F.col("_c2"), before_i, 0, cand_val, nul, nul, nul, nul, nul, is_cand),
        item(F.col("_c2") + 1, before_i, 0, cand_val, nul, nul, nul, nul, nul, is_cand),
        item(F.col("_c2"), F.col("n_words_run") + w0 - F.col("_limit"), 1,
             F.when(F.lit(False), cand_val), F.col("_pos"), F.col(order),
             F.col("n_words_run"), F.col("n_words"), w0, F.col(role) == user_role,
             F.col("_limit")))
    u0 = s.select(key, F.explode(F.filter(items, lambda x: x["_keep"])).alias("_e")) \
        .select(key, "_e.*").drop("_keep")
    w = (Window.partitionBy(key, "_c2").orderBy(F.col("_key").desc(), "_probe")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u0.withColumn("_best", F.min("_cand").over(w))
    p = u.where(F.col("_probe") == 1)
    pinned = F.col("_t_pos") == 0
    over = F.when(pinned, F.col("_w0") > limit).otherwise(
        F.col("_w0") + F.col("_t_n") > limit)
    fits = ~over & F.col("_best").isNotNull() & (F.col("_best.pos") <= F.col("_t_pos"))
    first_pos = F.when(pinned, F.lit(None)).when(fits, F.col("_best.pos")) \
        .otherwise(F.col("_t_pos"))
    first_turn = F.when(pinned, F.lit(None)).when(fits, F.col("_best.turn")) \
        .otherwise(F.col("_t_turn"))
    before = F.when(fits, F.col("_best.before")) \
        .otherwise(F.col("_t_run") - F.col("_t_n"))
    words = F.when(pinned, F.col("_w0")).otherwise(
        F.col("_w0") + F.col("_t_run") - before)
    return p.select(
        F.col(key), F.col("_t_turn").alias(order),
        first_turn.alias("first_kept"),
        F.when(pinned, F.lit(1)).otherwise(F.col("_t_pos") - first_pos + 2)
        .cast("bigint").alias("turns_sent"),
        words.cast("bigint").alias("words"),
        F.when(over, "overflow").otherwise("ok").alias("status"))


# ---------------------------------------------------------------- O6 -----
def models_table(spark: SparkSession, windows=None) -> DataFrame:
    """The model table as a JVM-side literal relation (no Python RDD)."""
    rows = MODEL_WINDOWS if windows is None else list(windows)
    return spark \
        .range(1).select(F.inline(F.array(*[
            F.struct(F.lit(m).cast("string").alias("model"),
                     F.lit(w).cast("int").alias("context_window")) for m, w in rows])))


def model_limits(df: DataFrame, models: DataFrame, *, model: str = "model",
                 max_tokens: int | str = 0) -> DataFrame:
    """Context window per row by model name (unknown -> smallest known), and
    the hard / soft word budgets ``int(.75 * window)`` and
    ``int(.75 * (window - max_tokens))`` (truncation toward zero).

    The default window is a scalar subquery over ``models``. A model named
    twice has its smallest window. Whether the table is broadcast is left to
    its measured size.
    """
    default = models.agg(F.min("context_window")).scalar()
    m = models.groupBy(F.col("model").alias("_m")).agg(F.min("context_window").alias("_w"))
    j = df.join(m, df[model] == F.col("_m"), "left")
    win = F.coalesce(F.col("_w"), default)
    mt = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
    return (j.withColumn("context_window", win.cast("bigint"))
            .withColumn("hard_limit",
                        (F.lit(WORDS_PER_TOKEN) * F.col("context_window")).cast("bigint"))
            .withColumn("soft_limit",
                        (F.lit(WORDS_PER_TOKEN) * (F.col("context_window") - mt))
                        .cast("bigint"))
            .drop("_m", "_w"))


# ---------------------------------------------------------------- O4 -----
def budget_status(turns: DataFrame, models: DataFrame, *, key: str = "conv_id",
                  order: str = "turn", model: str = "model", max_tokens: int = 0,
                  parts: int | None = None) -> DataFrame:
    """Per conversation: truncate to its model's hard budget (O2), then
    ``overflow`` (pinned + last alone exceed it), ``warn`` (remaining words
    above the soft budget) or ``ok``.

    ``turns`` carries the conversation's model name in column ``model``. The
    limits come from a join with the model table; the output row of
    a conversation comes from the same partially aggregated ``groupBy`` (the
    model and its limits are constant within a conversation, so grouping by
    them too changes nothing and keeps the aggregate a HashAggregate). Texts are
    counted in the scan and go no further."""
    words = turns.select(F.col(key), F.col(order), F.col(model), speaker_words("text").alias("n_words"))
    t = model_limits(words, models, model=model, max_tokens=max_tokens)
    kept = kept_turns(t, key=key, order=order, limit="hard_limit", parts=parts)
    per = kept.groupBy(key, model, "context_window", "hard_limit", "soft_limit").agg(
        F.sum("n_words").cast("bigint").alias("words_kept"),
        F.count(F.lit(1)).alias("turns_kept"),
        F.max(F.col("status") == "overflow").alias("_over"))
    status = (F.when(F.col("_over"), "overflow")
              .when(F.col("words_kept") > F.col("soft_limit"), "warn")
              .otherwise("ok"))
    return per.select(key, model, "context_window", "hard_limit", "soft_limit",
                      "words_kept", "turns_kept", status.alias("status"))


# ---------------------------------------------------------------- O5 -----
def history_render(turns: DataFrame, *, key: str = "conv_id",
                   order: str = "turn", sep: str = "\n\n",
                   speaker_prefix: bool = True, limit=None,
                   parts: int | None = None) -> DataFrame:
    """One string per conversation, turns in order, ``"Speaker: text"``.

    Ordered string aggregate per conversation: ``collect_list`` of
    ``(turn, piece)`` (an ObjectHashAggregate with partial aggregation), then
    ``array_sort`` and ``array_join``. The output is one value per
    conversation, so its size is that conversation's text; feed it the
    truncated history (O2) to bound it by the word budget: with ``limit``
    given, only the turns O2 keeps are rendered, so no group holds more than
    the pinned turn, the last turn and ``limit`` words."""
    if limit is not None:
        turns = history_truncate(turns, limit, key=key, order=order, parts=parts)
    body = F.coalesce(F.col("text"), F.lit(""))
    piece = F.concat(speaker_label("role"), F.lit(": "), body) if speaker_prefix \
        else body
    return (turns.groupBy(key)
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                     piece.alias("p")))),
                lambda x: x["p"]), sep).alias("history")))


def history_parts(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", sep: str = "\n\n",
                  speaker_prefix: bool = True, part_chars: int = PART_CHARS, parts: int | None = None) -> DataFrame:
    """``key, part, text``: the history of ``history_render`` in parts of
    ``part_chars`` characters, for conversations of any length: no group holds
    more than a part (see ``text_parts``)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    piece = F.concat(speaker_label("role"), F.lit(": "), body) if speaker_prefix else body
    return text_parts(turns.select(key, order, piece.alias("piece")), key, order, "piece", sep=sep,
                      part_chars=part_chars, parts=parts)
