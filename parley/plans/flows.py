"""The reference's two end-to-end paths as single Spark lineages.

* ``answer_questions``: typed lines -> route (O22) -> prompt kind (O9) ->
  render (O7) -> truncated conversation (O2, O5) -> model (O30) -> parse (O15)
  -> completion log (O16).
* ``explain_errors``: log files (O19) -> error records -> render (O7) ->
  model (O30) -> parse + log (O15/O16) -> enriched records -> written log (O20).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.completions import batch_complete, completion_log
from parley.operators.logs import route_turns
from parley.operators.prompts import CONTEXTFUL, CONTEXTLESS, prompt_kind, prompt_render
from parley.operators.turns import history_render, history_truncate
from parley.plans.ordered import ordered_scan
from parley.session import cut_lineage
from parley.sources.logtext import log_records, log_write

# Our own prompt wording; the field sets (which values a prompt needs) are
# the reference's.
QUESTION_TEMPLATES = {
    CONTEXTFUL: ("Asked: {question}\nSource:\n{code}\nAbout to run: {next_line}\n"
                 "Locals: {local_vars}\nGlobals: {global_vars}\n"
                 "Reply with an explanation, then fixed code in one fenced block."),
    CONTEXTLESS: "Asked: {question}",
}
ERROR_TEMPLATE = "Explain this error:\n{message}"
STATE_FIELDS = ("code", "next_line", "local_vars", "global_vars")

Model = Callable[[pd.Series], Sequence]


def _asked(lines: DataFrame, session: str, seq: str, line: str, state: Sequence[str],
           templates: Mapping[str, str], answered: str | None) -> DataFrame:
    """Conversational lines with their prompt kind and rendered prompt. The
    state belongs to contextful questions; contextless ones have ''."""
    routed = route_turns(lines, line).where(F.col("kind") == "conversational") \
        .withColumn("question", F.col("text"))
    kinds = prompt_kind(routed, session=session, order=(seq,), state=tuple(state),
                        answered=F.col(answered) if answered else F.lit(True))
    rendered = prompt_render(kinds, dict(templates), choose="prompt_kind")
    code = F.when(F.col("prompt_kind") == CONTEXTFUL, F.col(state[0])) if state else F.lit(None)
    return rendered.select(F.col(session).alias("session_id"), F.col(seq).alias("seq"), "prompt_kind", "prompt",
                           F.coalesce(code.cast("string"), F.lit("")).alias("_code"))


def answer_questions(lines: DataFrame, *, session: str = "session_id", seq: str = "seq",
                     line: str = "line", state: Sequence[str] = STATE_FIELDS,
                     templates: Mapping[str, str] = QUESTION_TEMPLATES,
                     model: Model | None = None, answered: str | None = None,
                     context_limit: int | None = None, system: str = "") -> DataFrame:
    """Completion log for the conversational lines of each session. Prompt
    kind compares the state with the last answered question; ``answered``
    names a column from an earlier run (default: every question answered).

    Without ``context_limit`` each prompt is sent alone, all in one pass. With
    it (words, e.g. a model's hard budget from O6) a question is sent with its
    session's conversation: the pinned ``system`` message, the earlier prompts
    and answers, truncated by O2. An answer may depend on those before it, so
    questions are asked in rounds, the n-th of all sessions together; a round
    holds the conversations of the sessions that still ask. A failed question
    is withdrawn from the conversation, what was dropped for it stays dropped.
    The log then also has ``context_words`` and ``context_status``."""
    asked = cut_lineage(_asked(lines, session, seq, line, state, templates, answered))
    if context_limit is None:
        # Model answers are written to the shared checkpoint folder once: a lost
        # executor downstream must not call the model again.
        done = cut_lineage(batch_complete(asked, model))
        return completion_log(done.where(F.col("error").isNull()), old_code="_code")
    ranked = cut_lineage(ordered_scan(asked, "session_id", "seq", position="_n", group_rows="_of"))
    rounds = ranked.agg(F.max("_of")).first()[0] or 0
    history = ranked.where("_n = 0").select(
        F.col("session_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
        F.lit("system").alias("role"), F.lit(system).alias("text"))
    logs = []
    for n in range(rounds):
        now = ranked.where(F.col("_n") == n)
        ask = now.select(F.col("session_id").alias("conv_id"), F.lit(2 * n).cast("long").alias("turn"),
                         F.lit("user").alias("role"), F.col("prompt").alias("text"))
        mine = history.join(now.select(F.col("session_id").alias("conv_id")), "conv_id", "left_semi")
        kept = cut_lineage(history_truncate(mine.unionByName(ask), context_limit))
        words = kept.groupBy("conv_id").agg(F.sum("n_words").cast("long").alias("context_words"),
                                            F.first("status").alias("context_status"))
        sent = now.join(history_render(kept).join(words, "conv_id").withColumnRenamed("conv_id", "session_id"),
                        "session_id")
        # The model gets the whole conversation; the stub answers its last message.
        done = cut_lineage(batch_complete(sent, model, prompt="prompt" if model is None else "history"))
        logs.append(completion_log(done.where(F.col("error").isNull()), old_code="_code",
                                   keep=("context_words", "context_status")))
        failed = done.where(F.col("error").isNotNull()).select(F.col("session_id").alias("conv_id"))
        withdrawn = failed.withColumn("turn", F.lit(2 * n).cast("long"))
        answers = done.where(F.col("error").isNull()).select(
            F.col("session_id").alias("conv_id"), F.lit(2 * n + 1).cast("long").alias("turn"),
            F.lit("assistant").alias("role"), F.col("completion").alias("text"))
        history = kept.select("conv_id", "turn", "role", "text") \
            .join(withdrawn, ["conv_id", "turn"], "left_anti").unionByName(answers)
    if not logs:
        return completion_log(asked.where("false").select(
            "*", F.lit("").alias("completion"), F.lit(0).cast("long").alias("context_words"),
            F.lit("").alias("context_status")), old_code="_code", keep=("context_words", "context_status"))
    return reduce(DataFrame.unionByName, logs)


def explain_errors(spark: SparkSession, log_paths, out_path: str | None = None, *,
                   template: str = ERROR_TEMPLATE, model: Model | None = None) -> DataFrame:
    """Read logs, explain each ERROR record with the model and return (and
    optionally write, in the order of file and record) the records with
    explanations appended. An explanation belongs to one record, so explained
    errors and the other records are put together without a join."""
    recs = log_records(spark, log_paths)
    # The parsed error records alone are written once for the model branch.
    errs = cut_lineage(recs.where(F.col("level") == "ERROR"))
    prompts = prompt_render(errs, {"error": template})
    done = cut_lineage(batch_complete(prompts, model))
    ids = done.withColumn("session_id", F.concat_ws("#", "file", F.col("rec").cast("string")))
    ok = completion_log(ids.where(F.col("error").isNull()), seq="rec", keep=("file", "ts", "level", "message"))
    text = F.concat_ws("\n\n", F.col("message"), F.when(F.col("completion") != "", F.col("completion")),
                       F.when(F.col("new_code") != "", F.col("new_code")))
    cols = ["file", "rec", "ts", "level", "message"]
    explained = ok.withColumnRenamed("seq", "rec").withColumn("message", text).select(cols)
    enriched = explained.unionByName(done.where(F.col("error").isNotNull()).select(cols)) \
        .unionByName(recs.where(~F.coalesce(F.col("level") == "ERROR", F.lit(False))).select(cols))
    if out_path:
        enriched = cut_lineage(enriched)  # read once for the file, once by the caller
        log_write(enriched, out_path, "w", order=("file", "rec"))
    return enriched
