"""Registered queries: one Spark job per operator over the given tables, and
for each the DuckDB SQL that must give the same rows.

Each query takes ``(spark, sf_dir)`` and reads whole tables. Inputs that the
reference would receive from a live session (completions, questions, code,
settings changes) are derived from the tables by the same expressions on both
sides, so the work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import completions as C
from parley.operators import logs as L
from parley.operators import prompts as P
from parley.operators import settings as S
from parley.operators import snapshots as SN
from parley.operators import turns as T
from parley.plans import flows as FL
from parley.session import DROP_SHUFFLES, scratch_path, table, with_conf
from parley.sources import logstream as LG
from parley.sources import logtext as LT
from parley.sources import notebooks as NB
from parley.streaming import stateful as ST
from parley.streaming.enrich import stream_error_enrich
from parley.streaming.requests import complete_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# Unicode whitespace (Java's (?U)\s) spelled out for RE2 in the oracles.
WS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]+")


def words_sql(c: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array(coalesce({c}, ''), "
            f"'{WS}'), lambda x: x <> '')) AS BIGINT)")


# ------------------------------------------------------------ conversations
TRUNCATE_LIMIT = 200
CONTEXT_LIMIT = 70


@register("turn_words", f"""
SELECT conv_id, turn, role, text, {words_sql('text')} + 1 AS n_words
FROM conversations""")
def q_turn_words(spark, sf):
    return T.turn_words(table(spark, sf, "conversations"))


@register("history_truncate", f"""
WITH t AS (SELECT conv_id, turn, role, text, {words_sql('text')} + 1 AS n_words
           FROM conversations),
s AS (SELECT *,
  first_value(n_words) OVER w AS w0, last_value(n_words) OVER w AS wl,
  min(turn) OVER w AS t0, max(turn) OVER w AS tl,
  sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix
  FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT conv_id, turn, role, text, n_words,
  CASE WHEN (t0 = tl AND w0 > {TRUNCATE_LIMIT}) OR (t0 <> tl AND w0 + wl > {TRUNCATE_LIMIT})
       THEN 'overflow' ELSE 'ok' END AS status
FROM s WHERE turn = t0 OR turn = tl OR w0 + suffix <= {TRUNCATE_LIMIT}""")
def q_history_truncate(spark, sf):
    return T.history_truncate(table(spark, sf, "conversations"), TRUNCATE_LIMIT)


@register("context_at_turn", f"""
WITH t AS (SELECT conv_id, turn, role, {words_sql('text')} + 1 AS n_words
           FROM conversations),
p AS (SELECT *,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
  first_value(n_words) OVER (PARTITION BY conv_id ORDER BY turn) AS w0
  FROM t),
probe AS (SELECT * FROM p WHERE role = 'user'),
best AS (
  SELECT a.conv_id, a.turn, min(b.pos) AS bpos
  FROM probe a JOIN p b ON a.conv_id = b.conv_id AND b.pos >= 1 AND b.pos <= a.pos
   AND a.w0 + a.run - (b.run - b.n_words) <= {CONTEXT_LIMIT}
  WHERE a.pos >= 1
  GROUP BY a.conv_id, a.turn),
j AS (
  SELECT a.*, f.turn AS fturn, f.pos AS fpos, f.run - f.n_words AS fbefore
  FROM probe a LEFT JOIN best USING (conv_id, turn)
  LEFT JOIN p f ON f.conv_id = a.conv_id AND f.pos = best.bpos)
SELECT conv_id, turn,
  CASE WHEN pos = 0 THEN NULL WHEN fpos IS NULL THEN turn ELSE fturn END AS first_kept,
  CAST(CASE WHEN pos = 0 THEN 1 WHEN fpos IS NULL THEN 2 ELSE pos - fpos + 2 END
       AS BIGINT) AS turns_sent,
  CAST(CASE WHEN pos = 0 THEN w0 WHEN fpos IS NULL THEN w0 + n_words
            ELSE w0 + run - fbefore END AS BIGINT) AS words,
  CASE WHEN (pos = 0 AND w0 > {CONTEXT_LIMIT}) OR (pos > 0 AND w0 + n_words > {CONTEXT_LIMIT})
       THEN 'overflow' ELSE 'ok' END AS status
FROM j""")
def q_context_at_turn(spark, sf):
    return T.context_at_turn(table(spark, sf, "conversations"), CONTEXT_LIMIT)


@register("history_render", """
SELECT conv_id, string_agg(
  CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI'
            WHEN 'system' THEN 'System' END || ': ' || coalesce(text, ''),
  chr(10) || chr(10) ORDER BY turn) AS history
FROM conversations GROUP BY conv_id""")
def q_history_render(spark, sf):
    return T.history_render(table(spark, sf, "conversations"))


HISTORY_PART_CHARS = 300


@register("history_parts", f"""
WITH h AS (SELECT conv_id, string_agg(
    CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI'
              WHEN 'system' THEN 'System' END || ': ' || coalesce(text, ''),
    chr(10) || chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, history, unnest(range(0, greatest(1, (length(history) + {HISTORY_PART_CHARS - 1}) // {HISTORY_PART_CHARS}))) AS part
      FROM h WHERE history IS NOT NULL)
SELECT conv_id, CAST(part AS BIGINT) AS part,
  substr(history, part * {HISTORY_PART_CHARS} + 1, {HISTORY_PART_CHARS}) AS text FROM p""")
def q_history_parts(spark, sf):
    return T.history_parts(table(spark, sf, "conversations"), part_chars=HISTORY_PART_CHARS)


# models assigned to conversations and events by the same CASE on both sides
CONV_MODEL_SQL = ("CASE conv_id % 4 WHEN 0 THEN 'gpt-4' WHEN 1 THEN 'gpt-3.5-turbo' "
                  "WHEN 2 THEN 'gpt-4o-mini' ELSE 'local-model' END")
EVENT_MODEL_SQL = ("CASE event_type WHEN 'view' THEN 'gpt-4' WHEN 'click' THEN "
                   "'gpt-3.5-turbo' WHEN 'purchase' THEN 'gpt-4o' "
                   "WHEN 'signup' THEN 'gpt-4o-mini' ELSE 'local-model' END")
def _models_sql(windows) -> str:
    rows = ", ".join(f"('{m}', {w})" for m, w in windows)
    return f"(SELECT * FROM (VALUES {rows}) AS m(model, context_window))"


MODELS_SQL = _models_sql(T.MODEL_WINDOWS)
# Windows small enough for the conversations to be truncated, to overflow, to
# pass the soft budget and to stay below it.
BUDGET_WINDOWS = [("gpt-4", 130), ("gpt-3.5-turbo", 500), ("gpt-4o-mini", 4000)]
BUDGET_SQL = _models_sql(BUDGET_WINDOWS)
BUDGET_MIN = min(w for _, w in BUDGET_WINDOWS)
BUDGET_MAX_TOKENS = 60


@register("model_limits", f"""
WITH e AS (SELECT event_id, {EVENT_MODEL_SQL} AS model FROM events)
SELECT e.event_id, e.model,
  CAST(coalesce(m.context_window, (SELECT min(context_window) FROM {MODELS_SQL})) AS BIGINT) AS context_window,
  CAST(trunc(0.75 * coalesce(m.context_window, (SELECT min(context_window) FROM {MODELS_SQL})))
       AS BIGINT) AS hard_limit,
  CAST(trunc(0.75 * (coalesce(m.context_window, (SELECT min(context_window) FROM {MODELS_SQL})) - 512))
       AS BIGINT) AS soft_limit
FROM e LEFT JOIN {MODELS_SQL} m ON e.model = m.model""")
def q_model_limits(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.expr(EVENT_MODEL_SQL).alias("model"))
    return T.model_limits(ev, T.models_table(spark), max_tokens=512)


@register("budget_status", f"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations),
cm AS (SELECT conv_id, {CONV_MODEL_SQL} AS model FROM c),
lim AS (
  SELECT cm.conv_id, cm.model,
    CAST(coalesce(m.context_window, {BUDGET_MIN}) AS BIGINT) AS context_window,
    CAST(trunc(0.75 * coalesce(m.context_window, {BUDGET_MIN})) AS BIGINT) AS hard_limit,
    CAST(trunc(0.75 * (coalesce(m.context_window, {BUDGET_MIN}) - {BUDGET_MAX_TOKENS})) AS BIGINT)
      AS soft_limit
  FROM cm LEFT JOIN {BUDGET_SQL} m ON cm.model = m.model),
t AS (SELECT c.conv_id, c.turn, {words_sql('c.text')} + 1 AS n_words, lim.hard_limit
      FROM conversations c JOIN lim USING (conv_id)),
s AS (SELECT *,
  first_value(n_words) OVER w AS w0, last_value(n_words) OVER w AS wl,
  min(turn) OVER w AS t0, max(turn) OVER w AS tl,
  sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix
  FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT conv_id, sum(n_words) AS words_kept, count(*) AS turns_kept,
        bool_or((t0 = tl AND w0 > hard_limit) OR (t0 <> tl AND w0 + wl > hard_limit)) AS over
      FROM s WHERE turn = t0 OR turn = tl OR w0 + suffix <= hard_limit
      GROUP BY conv_id)
SELECT lim.conv_id, lim.model, lim.context_window, lim.hard_limit, lim.soft_limit,
  CAST(k.words_kept AS BIGINT) AS words_kept, CAST(k.turns_kept AS BIGINT) AS turns_kept,
  CASE WHEN k.over THEN 'overflow' WHEN k.words_kept > lim.soft_limit THEN 'warn'
       ELSE 'ok' END AS status
FROM k JOIN lim USING (conv_id)""")
def q_budget_status(spark, sf):
    conv = table(spark, sf, "conversations").withColumn("model", F.expr(CONV_MODEL_SQL))
    return T.budget_status(conv, T.models_table(spark, BUDGET_WINDOWS), max_tokens=BUDGET_MAX_TOKENS)


# ------------------------------------------------------------- completions
# Completions built from conversation text by one portable SQL expression
# (the generated text holds no fences): assistant turns get zero, one or two
# fenced blocks whose content comes from the row itself.
COMPLETION_SQL = """CASE
  WHEN role <> 'assistant' THEN text
  WHEN turn % 4 = 1 THEN text || chr(10) || chr(10) || '```python' || chr(10)
       || 'n_chars = ' || CAST(length(text) AS STRING) || chr(10) || '```'
  WHEN turn % 4 = 3 THEN text || chr(10) || '```' || chr(10)
       || regexp_extract(text, '[^ ]+$', 0) || chr(10) || '```' || chr(10) || chr(10)
       || '```python' || chr(10) || 'turn = ' || CAST(turn AS STRING) || chr(10) || '```'
  ELSE text END"""
BLOCK_RE = r"(?s)```(?:python)?\n(.*?)\n```"


def _completions(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.expr(COMPLETION_SQL).alias("completion"))


COMPLETIONS_CTE = f"""c AS (SELECT conv_id, turn, role, {COMPLETION_SQL} AS completion
                 FROM conversations),
b AS (SELECT *, regexp_extract_all(completion, '{BLOCK_RE}', 1) AS blocks FROM c)"""
JOINED_SQL = """CASE WHEN len(blocks) = 0 THEN '' WHEN len(blocks) = 1 THEN blocks[1]
  ELSE '# 1' || chr(10) || blocks[1] || array_to_string(list_transform(blocks[2:],
       lambda x, i: chr(10) || chr(10) || '# ' || CAST(i + 1 AS VARCHAR) || chr(10) || x), '')
  END"""


@register("extract_code_blocks", f"""
WITH {COMPLETIONS_CTE},
e AS (SELECT conv_id, turn, blocks, unnest(generate_series(1, len(blocks))) AS i FROM b)
SELECT conv_id, turn, CAST(i AS BIGINT) AS block_no, blocks[i] AS code FROM e""")
def q_extract_code_blocks(spark, sf):
    return C.extract_code_blocks(_completions(spark, sf), keys=("conv_id", "turn"))


@register("join_code_blocks", f"""
WITH {COMPLETIONS_CTE}
SELECT conv_id, turn, {JOINED_SQL} AS code FROM b""")
def q_join_code_blocks(spark, sf):
    return C.join_blocks(_completions(spark, sf)).select("conv_id", "turn", "code")


@register("parse_completion", f"""
WITH {COMPLETIONS_CTE}
SELECT conv_id, turn, split_part(completion, chr(10) || '```', 1) AS explanation,
  {JOINED_SQL} AS code FROM b""")
def q_parse_completion(spark, sf):
    return C.parse_completion(_completions(spark, sf)).select(
        "conv_id", "turn", "explanation", "code")


EMPTY_SQL = "'" + C.EMPTY_ANSWER.replace("'", "''") + "'"
STRIP_SQL = r"regexp_replace(completion, '^\s+|\s+$', '', 'g')"


OLD_CODE_SQL = ("CASE turn % 4 WHEN 1 THEN 'n_chars = ' || CAST(length(text) AS STRING) || chr(10) || 'pass' "
                "|| chr(10) || 'pass' WHEN 3 THEN 'turn = 0' ELSE '' END")


def _only_in_sql(a: str, b: str) -> str:
    la, lb = (f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, chr(10)) END" for x in (a, b))
    return (f"CAST(coalesce(list_sum(list_transform(list_distinct({la}), lambda x: greatest(0, "
            f"len(list_filter({la}, lambda y: y = x)) - len(list_filter({lb}, lambda z: z = x))))), 0) AS BIGINT)")


@register("completion_log", f"""
WITH c AS (SELECT conv_id, turn, {COMPLETION_SQL} AS completion, {OLD_CODE_SQL} AS old
           FROM conversations WHERE role = 'assistant'),
a AS (SELECT conv_id, turn, old, CASE WHEN {STRIP_SQL} = ''
        THEN {EMPTY_SQL} ELSE {STRIP_SQL} END AS completion FROM c),
b AS (SELECT *, regexp_extract_all(completion, '{BLOCK_RE}', 1) AS blocks FROM a),
n AS (SELECT *, {JOINED_SQL} AS new_code FROM b)
SELECT conv_id AS session_id, turn AS seq, completion,
  split_part(completion, chr(10) || '```', 1) AS explanation, old AS code, new_code,
  {_only_in_sql('new_code', 'old')} AS lines_added,
  CASE WHEN new_code = '' THEN 0 ELSE {_only_in_sql('old', 'new_code')} END AS lines_removed,
  NULL::MAP(VARCHAR, VARCHAR) AS extra
FROM n""")
def q_completion_log(spark, sf):
    answers = table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.expr(COMPLETION_SQL).alias("completion"), F.expr(OLD_CODE_SQL).alias("old"))
    return C.completion_log(answers, session="conv_id", seq="turn", old_code="old")


PURCHASE_SQL = "CASE WHEN event_type = 'purchase' THEN props ELSE '' END"


@register("latest_nonempty", f"""
WITH v AS (SELECT user_id, ts, event_id, {PURCHASE_SQL} AS v FROM events),
r AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id
        ORDER BY ts DESC, event_id DESC) AS rn FROM v WHERE v <> '')
SELECT u.user_id, r.v AS latest FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN r ON r.user_id = u.user_id AND r.rn = 1""")
def q_latest_nonempty(spark, sf):
    ev = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.expr(PURCHASE_SQL).alias("v"))
    return C.latest_nonempty(ev, "v", key="user_id", order=("ts", "event_id"))


LINES_SQL = (r"CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE "
             r"regexp_split_to_array(regexp_replace(text, '(?:\r\n|[\n\x0B\x0C\r\x{85}"
             r"\x{2028}\x{2029}])\z', ''), '\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]') END")


@register("revision_diff", f"""
WITH v AS (SELECT conv_id, turn, text,
             lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
l AS (SELECT conv_id, turn, nxt, unnest({LINES_SQL}) AS line FROM v),
d AS (SELECT conv_id, turn, line, 1 AS d FROM l
      UNION ALL SELECT conv_id, nxt, line, -1 FROM l WHERE nxt IS NOT NULL),
pl AS (SELECT conv_id, turn, line, sum(d) AS d FROM d GROUP BY ALL)
SELECT v.conv_id, v.turn,
  CAST(coalesce(sum(greatest(pl.d, 0)), 0) AS BIGINT) AS lines_added,
  CAST(coalesce(sum(greatest(-pl.d, 0)), 0) AS BIGINT) AS lines_removed
FROM v LEFT JOIN pl USING (conv_id, turn) GROUP BY v.conv_id, v.turn""")
def q_revision_diff(spark, sf):
    return C.revision_diff(table(spark, sf, "conversations"), doc="conv_id",
                           version="turn")


@register("batch_complete", """
SELECT conv_id, turn, text AS prompt, upper(replace(text, 'ß', 'ss')) AS completion,
  NULL::VARCHAR AS error
FROM conversations WHERE role = 'user'""")
def q_batch_complete(spark, sf):
    prompts = table(spark, sf, "conversations").where(F.col("role") == "user") \
        .select("conv_id", "turn", F.col("text").alias("prompt"))
    return C.batch_complete(prompts)


# ----------------------------------------------------------------- prompts
WS1 = WS[:-1]  # one whitespace character (class without '+')
DOC_TEMPLATE = ("Document {doc_id} ({lang}, {source}) quality={quality} "
                "toxic={toxic}:\n{text}\n{{end}}")


def _docs_labels(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@register("prompt_render", """
SELECT d.doc_id, 'Document ' || CAST(d.doc_id AS VARCHAR) || ' (' || coalesce(lang, '')
  || ', ' || coalesce(source, '') || ') quality=' || coalesce(CAST(quality AS VARCHAR), '')
  || ' toxic=' || coalesce(CAST(toxic AS VARCHAR), '') || ':' || chr(10)
  || coalesce(text, '') || chr(10) || '{end}' AS prompt
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_prompt_render(spark, sf):
    return P.prompt_render(_docs_labels(spark, sf), {"doc": DOC_TEMPLATE}) \
        .select("doc_id", "prompt")


FIELD_TEMPLATE = "Review {text} from {source} in {lang}; quality {quality}."


def _field_rows(spark, sf):
    d = _docs_labels(spark, sf)
    # A key is there by a rule on the label, whatever its value: unlabelled
    # documents have the key "quality" with a NULL value.
    m = F.map_filter(F.create_map(
        F.lit("text"), F.col("text"), F.lit("source"), F.col("source"),
        F.lit("lang"), F.col("lang"), F.lit("quality"), F.col("quality").cast("string"),
        F.lit("toxic"), F.when(F.col("toxic") == 1, F.lit("yes"))),
        lambda k, v: ~k.isin("quality", "toxic") | ((k == "quality") & F.coalesce(F.col("quality") != 0, F.lit(True)))
        | ((k == "toxic") & v.isNotNull()))
    return P.prompt_field_check(d.select("doc_id", m.alias("fields")), FIELD_TEMPLATE)


FIELD_CHECK_CTE = f"""g AS (SELECT d.doc_id, list_filter([
    'text', 'source', 'lang', CASE WHEN coalesce(quality, 1) <> 0 THEN 'quality' END,
    CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS given
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT doc_id,
  list_sort(list_filter(given, lambda x: NOT list_contains(['lang', 'quality', 'source', 'text'], x))) AS unexpected,
  list_sort(list_filter(['lang', 'quality', 'source', 'text'], lambda x: NOT list_contains(given, x))) AS missing
  FROM g),
r AS (SELECT doc_id, unexpected, missing,
  CASE WHEN len(unexpected) > 0 THEN '{P.UNEXPECTED_MSG}{{' ||
         array_to_string(list_transform(unexpected, lambda x: '''' || x || ''''), ', ') || '}}'
       WHEN len(missing) > 0 THEN '{P.MISSING_MSG}{{' ||
         array_to_string(list_transform(missing, lambda x: '''' || x || ''''), ', ') || '}}'
  END AS error FROM c)"""


@register("prompt_field_check", f"""
WITH {FIELD_CHECK_CTE}
SELECT * FROM r""")
def q_prompt_field_check(spark, sf):
    return _field_rows(spark, sf).select("doc_id", "unexpected", "missing", "error")


@register("prompt_field_report", f"""
WITH {FIELD_CHECK_CTE}
SELECT count(*) AS rows, count(*) FILTER (WHERE len(missing) > 0) AS rows_missing,
  count(*) FILTER (WHERE len(unexpected) > 0) AS rows_unexpected,
  count(*) FILTER (WHERE error IS NULL) AS rows_ok FROM r""")
def q_prompt_field_report(spark, sf):
    return P.prompt_field_report(_field_rows(spark, sf))


@register("prompt_kind", """
WITH e AS (SELECT user_id, event_id, ts, event_type, event_type <> 'error' AS answered
           FROM events),
p AS (SELECT *, last_value(CASE WHEN answered THEN {'s': event_type} END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e)
SELECT user_id, event_id, CASE WHEN prev IS NOT NULL AND
  prev IS NOT DISTINCT FROM {'s': event_type} THEN 'contextless' ELSE 'contextful' END
  AS prompt_kind FROM p""")
def q_prompt_kind(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return P.prompt_kind(ev, session="user_id", order=("ts", "event_id"),
                         state=("event_type",), answered=F.col("event_type") != "error").select("user_id", "event_id", "prompt_kind")


SHELL_SQL = ", ".join(f"'{n}'" for n in P.SHELL_NAMES)


@register("used_variables", f"""
WITH bt AS (SELECT item_id, unnest(list_distinct(list_filter(
              regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> ''))) AS name
            FROM benchmark),
v AS (SELECT name, min(item_id) AS value FROM bt GROUP BY name),
v2 AS (SELECT * FROM v WHERE NOT (regexp_matches(name, '^_{{1,2}}i?[0-9]*$')
         OR replace(name, '_', '') = '' OR name IN ({SHELL_SQL}))),
t AS (SELECT doc_id, unnest(list_distinct(list_filter(
        regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> ''))) AS token
      FROM documents)
SELECT t.doc_id, v2.name, v2.value FROM t JOIN v2 ON t.token = v2.name""")
def q_used_variables(spark, sf):
    bt = P.code_tokens(table(spark, sf, "benchmark"), "text", ["item_id"])
    variables = bt.groupBy(F.col("token").alias("name")).agg(F.min("item_id").alias("value"))
    return P.used_variables(variables, table(spark, sf, "documents"), code_col="text",
                            code_keys=["doc_id"])


@register("used_variables_session", f"""
WITH w AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(
             regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> ''))) AS name FROM conversations),
v AS (SELECT conv_id, name, CASE WHEN min(turn) % 2 = 0 THEN 'local' ELSE 'global' END AS scope
      FROM w WHERE turn < 2 AND NOT (regexp_matches(name, '^_{{1,2}}i?[0-9]*$')
        OR replace(name, '_', '') = '' OR name IN ({SHELL_SQL})) GROUP BY conv_id, name)
SELECT w.turn, v.conv_id, v.name, v.scope FROM w JOIN v USING (conv_id, name)""")
def q_used_variables_session(spark, sf):
    conv = table(spark, sf, "conversations")
    names = P.code_tokens(conv, "text", ["conv_id", "turn"])
    scope = F.when(F.min("turn") % 2 == 0, "local").otherwise("global")
    variables = names.where("turn < 2").groupBy("conv_id", F.col("token").alias("name")).agg(scope.alias("scope"))
    return P.used_variables(variables, conv, keys=["conv_id"], code_col="text", code_keys=["conv_id", "turn"])


def _str_preview_sql(x: str, n: int = 400) -> str:
    q = f"('''' || {x} || '''')"
    return (f"CASE WHEN {x} IS NULL THEN 'None' WHEN length({q}) < {n} THEN {q} "
            f"ELSE left({q}, {n - 16}) || '...'' (truncated)' END")


SNAP_COLS = [("c_custkey", "bigint", False), ("c_name", "string", True),
             ("c_nationkey", "int", False), ("c_acctbal", "double", False),
             ("c_mktsegment", "string", True)]


def _snapshot_sql() -> str:
    parts = []
    for c, t, is_str in SNAP_COLS:
        v = _str_preview_sql(c) if is_str else \
            f"CASE WHEN {c} IS NULL THEN 'None' ELSE CAST({c} AS VARCHAR) END"
        parts.append(f"chr(10) || '    ''{c}'': ' || ({v}) || ',   # type: {t}'")
    return "'{' || " + " || ".join(parts) + " || chr(10) || '}'"


@register("state_snapshot", f"""
SELECT c_custkey, {_snapshot_sql()} AS snapshot FROM customer""")
def q_state_snapshot(spark, sf):
    return P.state_snapshot(table(spark, sf, "customer"), [c for c, _, _ in SNAP_COLS]) \
        .select("c_custkey", "snapshot")


def _until_comma_sql(s: str) -> str:
    return (f"CASE WHEN strpos({s}, ',') = 0 THEN left({s}, length({s}) - 1) "
            f"ELSE left({s}, length({s}) - strpos(reverse({s}), ',')) END")


def _int_list_preview_sql(a: str, n: int = 400) -> str:
    items = f"list_transform({a}, lambda x: coalesce(CAST(x AS VARCHAR), 'None'))"
    full = f"('[' || array_to_string({items}, ', ') || ']')"
    k = f"greatest(1, CAST(trunc({float(n)} / length({full}) * len({a})) AS BIGINT))"
    head = f"array_to_string(list_slice({items}, 1, {k}), ', ')"
    return (f"CASE WHEN {a} IS NULL THEN 'None' WHEN length({full}) < {n} THEN {full} "
            f"WHEN {k} = len({a}) THEN '<list, truncated_data=' || "
            f"{_until_comma_sql(f'left({full}, {n - 10})')} || ', len=' || "
            f"CAST(len({a}) AS VARCHAR) || '>' "
            f"ELSE '<list, truncated_data=[' || {head} || ', ...], len=' || "
            f"CAST(len({a}) AS VARCHAR) || '>' END")


@register("bounded_preview", f"""
WITH d AS (SELECT doc_id, text,
  list_transform(string_split(text, ' '), lambda w: length(w)) AS word_lengths FROM documents)
SELECT doc_id, {_str_preview_sql('text')} AS text_preview,
  {_int_list_preview_sql('word_lengths')} AS word_lengths_preview FROM d""")
def q_bounded_preview(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "text",
        F.transform(F.split(F.col("text"), " ", -1), lambda w: F.length(w)).alias("word_lengths"))
    return P.bounded_preview(d, ["text", "word_lengths"]).select(
        "doc_id", "text_preview", "word_lengths_preview")


# -------------------------------------------------------------------- logs
LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END"
MESSAGE_SQL = "event_type || ' ' || coalesce(props, '')"


@register("error_enrich", f"""
WITH c AS (SELECT conv_id, turn, {COMPLETION_SQL} AS completion
           FROM conversations WHERE role = 'assistant'),
a AS (SELECT conv_id, turn, CASE WHEN {STRIP_SQL} = ''
        THEN {EMPTY_SQL}
        ELSE {STRIP_SQL} END AS completion FROM c),
b AS (SELECT *, regexp_extract_all(completion, '{BLOCK_RE}', 1) AS blocks FROM a),
lg AS (SELECT conv_id, turn, completion, {JOINED_SQL} AS new_code FROM b),
lc AS (SELECT conv_id, completion FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
         ORDER BY turn DESC) rn FROM lg WHERE completion <> '') WHERE rn = 1),
lk AS (SELECT conv_id, new_code FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
         ORDER BY turn DESC) rn FROM lg WHERE new_code <> '') WHERE rn = 1),
ex AS (SELECT s.conv_id, lc.completion, lk.new_code AS code
       FROM (SELECT DISTINCT conv_id FROM lg) s LEFT JOIN lc USING (conv_id)
       LEFT JOIN lk USING (conv_id)),
r AS (SELECT event_id, user_id, {LEVEL_SQL} AS level, {MESSAGE_SQL} AS message FROM events)
SELECT r.event_id, r.user_id, r.level,
  CASE WHEN ex.completion IS NOT NULL THEN concat_ws(chr(10) || chr(10), r.message,
       ex.completion, CASE WHEN ex.code <> '' THEN ex.code END) ELSE r.message END AS message
FROM r LEFT JOIN ex ON r.user_id = ex.conv_id AND r.level = 'ERROR'""")
def q_error_enrich(spark, sf):
    answers = _completions(spark, sf).where(F.col("role") == "assistant")
    log = C.completion_log(answers, session="conv_id", seq="turn")
    ex = L.session_explanations(log, session="session_id", order=("seq",)) \
        .withColumnRenamed("session_id", "user_id")
    recs = table(spark, sf, "events").select(
        "event_id", "user_id", F.expr(LEVEL_SQL).alias("level"),
        F.expr(MESSAGE_SQL).alias("message"))
    return L.error_enrich(recs, ex, session="user_id")


LINE_SQL = ("CASE turn % 3 WHEN 0 THEN '>' || text WHEN 1 THEN '[dev]' || text || '?' "
            "ELSE text END")


@register("route_turns", f"""
WITH l AS (SELECT conv_id, turn, {LINE_SQL} AS line FROM conversations),
k AS (SELECT *, (contains(line, '?') OR starts_with(line, '>')) AS conv FROM l)
SELECT conv_id, turn, line, CASE WHEN conv THEN 'conversational' ELSE 'command' END AS kind,
  conv AND starts_with(line, '[dev]') AS verbose,
  CASE WHEN conv THEN regexp_replace(line, '^>+', '') ELSE line END AS text FROM k""")
def q_route_turns(spark, sf):
    lines = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr(LINE_SQL).alias("line"))
    return L.route_turns(lines)


LB = r"\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]"
STRIP_MARKER = "The "


@register("strip_lines", f"""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN '' ELSE
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '(?:{LB})\\z', ''),
  '{LB}'), lambda l: NOT regexp_matches(l, '^{WS1}*The ')), chr(10)) END AS cleaned
FROM documents""")
def q_strip_lines(spark, sf):
    return L.strip_lines(table(spark, sf, "documents"), "text", STRIP_MARKER, out="cleaned") \
        .select("doc_id", "cleaned")


SECRET_RE = 'token = "([^"]+)"'


@register("redact_secrets", f"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '{SECRET_RE}', 1) AS v FROM documents),
e AS (SELECT doc_id, v, unnest(generate_series(1, len(v))) AS i FROM s)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos,
  left(v[i], 4) || repeat('*', CAST(greatest(0, length(v[i]) - 4) AS BIGINT)) AS masked,
  starts_with(v[i], 'sk-') AS looks_valid FROM e""")
def q_redact_secrets(spark, sf):
    return L.redact_secrets(table(spark, sf, "documents"), "text", SECRET_RE, 1,
                            keys=("doc_id",))


# ---------------------------------------------------------------- settings
SETTING_VALUE_SQL = "CASE WHEN value < 5 THEN NULL ELSE props END"


@register("settings_upsert", f"""
WITH c AS (SELECT user_id AS owner, event_type AS key, {SETTING_VALUE_SQL} AS value,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn
           FROM events)
SELECT owner, key, value FROM c WHERE rn = 1 AND value IS NOT NULL""")
def q_settings_upsert(spark, sf):
    ch = table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.col("event_type").alias("key"),
        F.expr(SETTING_VALUE_SQL).alias("value"), F.col("event_id").alias("seq"))
    return S.settings_upsert(None, ch)


LAYER_SQL = ("CASE event_type WHEN 'purchase' THEN 'explicit' WHEN 'signup' THEN 'config' "
             "WHEN 'view' THEN 'template' ELSE 'other' END")
LAYER_KEY_SQL = "CASE WHEN value < 30 THEN 'model_name' ELSE 'openai_api_key' END"
LAYER_VALUE_SQL = "CASE WHEN value < 10 THEN '' ELSE props END"


@register("settings_resolve", f"""
WITH l AS (SELECT user_id AS owner, {LAYER_KEY_SQL} AS key, {LAYER_VALUE_SQL} AS value,
             {LAYER_SQL} AS layer, event_id FROM events),
c AS (SELECT *, CASE layer WHEN 'explicit' THEN 0 WHEN 'config' THEN 1
                 WHEN 'template' THEN 2 END AS prio FROM l
      WHERE layer IN ('explicit', 'config', 'template')
        AND NOT (layer = 'config' AND coalesce(value, '') = '')),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, key ORDER BY prio, event_id DESC) AS rn
      FROM c)
SELECT owner, key, value, layer AS source FROM r WHERE rn = 1""")
def q_settings_resolve(spark, sf):
    lay = table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.expr(LAYER_KEY_SQL).alias("key"),
        F.expr(LAYER_VALUE_SQL).alias("value"), F.expr(LAYER_SQL).alias("layer"),
        F.col("event_id").alias("seq"))
    return S.settings_resolve(lay, seq="seq")


SCHEMA_TYPES = [("o_orderpriority", "int"), ("o_orderstatus", "string"),
                ("o_orderkey_text", "bigint"), ("o_mixed", "int")]
MIXED_SQL = ("CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_orderkey AS STRING) END")


@register("schema_check", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS \"values\", "
    f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {t.upper()}) IS NULL) "
    f"AS violations FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS o_orderkey_text, {MIXED_SQL} AS o_mixed FROM orders)"
    for c, t in SCHEMA_TYPES))
def q_schema_check(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "o_orderkey_text", F.col("o_orderkey").cast("string")).withColumn("o_mixed", F.expr(MIXED_SQL))
    return S.schema_check(o, dict(SCHEMA_TYPES))


# ------------------------------------------------------------ files (O19-O25)
# Messages span lines; error messages carry a line that looks like a record
# start (written escaped) after a carriage return alone and after a line
# break, and an indented trace line. Levels are NULL or have no capitals only.
LOG_LEVEL_SQL = ("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'Level 15' "
                 "WHEN 'view' THEN NULL ELSE 'INFO' END")
LOG_MESSAGE_SQL = ("CASE WHEN event_type = 'error' THEN 'failed: ' || coalesce(props, '') "
                   "|| chr(13) || '1999-12-31 23:59:59,998 [ERROR]: forged' "
                   "|| chr(10) || '1999-12-31 23:59:59,999 [ERROR]: nested' || chr(10) "
                   "|| '  trace ' || CAST(event_id AS STRING) "
                   "ELSE event_type || ' ' || coalesce(props, '') END")


def _log_events(spark, sf):
    return table(spark, sf, "events").select(
        "ts", F.expr(LOG_LEVEL_SQL).alias("level"), F.expr(LOG_MESSAGE_SQL).alias("message"))


@register("log_records", f"""
SELECT CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, {LOG_LEVEL_SQL} AS level,
  {LOG_MESSAGE_SQL} AS message FROM events""")
def q_log_records(spark, sf):
    path = scratch_path(spark, "log")
    LT.log_write(_log_events(spark, sf), path, "w")
    return LT.log_records(spark, path).select("ts", "level", "message")


@register("log_write", f"""
WITH r AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' [' || coalesce({LOG_LEVEL_SQL}, '') || ']: ' ||
  regexp_replace({LOG_MESSAGE_SQL}, '{LT.ESCAPE_FIND.replace(chr(92) + "n", chr(10))}',
                 '\\1 \\2', 'g') AS rec FROM events)
SELECT unnest(string_split(rec, chr(10))) AS value FROM r""")
def q_log_write(spark, sf):
    path = scratch_path(spark, "log")
    LT.log_write(_log_events(spark, sf), path, "w")
    return spark.read.text(path, lineSep="\n")


def _source_lines_sql() -> str:
    return ("CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN [] ELSE "
            "list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN "
            "i < len(string_split(text, chr(10))) THEN l || chr(10) ELSE l END) END")


@register("notebook_text", """
SELECT conv_id, coalesce(string_agg(CASE WHEN text IS NULL OR text = '' THEN NULL
    WHEN role = 'assistant' THEN chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10)
    ELSE chr(10) || text || chr(10) END, '' ORDER BY turn), '') AS text
FROM conversations GROUP BY conv_id""")
def q_notebook_text(spark, sf):
    conv = table(spark, sf, "conversations")
    parts = F.split(F.col("text"), "\n", -1)
    src = (F.when(F.col("text").isNull(), F.lit(None))
           .when(F.col("text") == "", F.array().cast("array<string>"))
           .otherwise(F.transform(parts, lambda l, i: F.when(
               i < F.size(parts) - 1, F.concat(l, F.lit("\n"))).otherwise(l))))
    kind = F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type")
    # Every second cell's source is one string, the others' a list of lines.
    cell = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(kind, F.col("text").alias("source")))) \
        .otherwise(F.to_json(F.struct(kind, src.alias("source"))))
    nbs = conv.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))), lambda x: x["c"]), ",").alias("cells"))
    path = scratch_path(spark, "notebooks")
    nbs.select(F.format_string('{"metadata": {"conv_id": "%d"}, "cells": [%s]}', "conv_id", "cells")) \
        .write.option("lineSep", "\n").text(path)
    nb = NB.notebook_text(NB.read_notebooks(spark, path, multiline=False))
    return nb.select(F.col("metadata")["conv_id"].cast("bigint").alias("conv_id"), "text")


HISTORY_SESSION_ROWS = 100


@register("history_text", f"""
WITH l AS (SELECT doc_id // {HISTORY_SESSION_ROWS} AS session, doc_id,
             unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT session, doc_id, i, regexp_replace(replace(line, chr(13), ' '),
        '^{WS}|{WS}$', '', 'g') AS cell FROM l)
SELECT CAST(session AS BIGINT) AS session, string_agg('```' || chr(10) || cell || chr(10) || '```',
  chr(10) || chr(10) ORDER BY doc_id, i) AS text FROM c WHERE cell <> '' GROUP BY session""")
def q_history_text(spark, sf):
    docs = table(spark, sf, "documents").select(
        (F.col("doc_id") / HISTORY_SESSION_ROWS).cast("bigint").alias("session"), "doc_id",
        F.replace("text", F.lit("\r"), F.lit(" ")).alias("text"))
    # Documents are shuffled, not their lines, and a file has many sessions
    # (``session/n: code``): a folder and a file for each would be made, listed
    # and opened one by one.
    lines = docs.repartition("session").select(
        "session", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    path = scratch_path(spark, "history")
    hist = lines.sortWithinPartitions("session", "doc_id", "i").select(F.concat(
        F.coalesce(F.col("session").cast("string"), F.lit("")), F.lit("/"),
        (F.col("i") + 1).cast("string"), F.lit(": "), "line").alias("value"))
    with with_conf(spark, DROP_SHUFFLES):
        hist.write.option("lineSep", "\n").text(path)
    out = NB.history_text(NB.history_lines(spark, path, session="session"), keys=("session",))
    return out.select(F.col("session").cast("bigint").alias("session"), "text")


# -------------------------------------------------------- end-to-end paths
QUESTION_STATE = {"code": "'x = ' || CAST(turn // 4 AS STRING)", "next_line": "'run'",
                  "local_vars": "'{}'", "global_vars": "'{}'"}
QUESTION_LIMIT, QUESTION_SYSTEM = 120, "You help with code. Be brief."


@register("answer_questions", f"""
WITH q AS (SELECT conv_id, turn, regexp_replace('>' || coalesce(text, ''), '^>+', '') AS question,
             {QUESTION_STATE['code']} AS code FROM conversations WHERE role = 'user'),
k AS (SELECT *, row_number() OVER w - 1 AS n, lag(code) OVER w IS NOT DISTINCT FROM code
        AND row_number() OVER w > 1 AS same FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT *, CASE WHEN same THEN 'Asked: ' || question ELSE 'Asked: ' || question || chr(10) || 'Source:' || chr(10)
        || code || chr(10) || 'About to run: run' || chr(10) || 'Locals: {{}}' || chr(10) || 'Globals: {{}}' || chr(10)
        || 'Reply with an explanation, then fixed code in one fenced block.' END AS prompt FROM k),
a AS (SELECT *, regexp_replace(upper(replace(prompt, 'ß', 'ss')), '^{WS}|{WS}$', '', 'g') AS completion FROM p),
t AS (SELECT conv_id, -1 AS pos, 'system' AS role, {words_sql("'" + QUESTION_SYSTEM + "'")} + 1 AS n_words
      FROM (SELECT DISTINCT conv_id FROM q)
      UNION ALL SELECT conv_id, 2 * n, 'user', {words_sql('prompt')} + 1 FROM a
      UNION ALL SELECT conv_id, 2 * n + 1, 'assistant', {words_sql('prompt')} + 1 FROM a),
r AS (SELECT *, sum(n_words) OVER (PARTITION BY conv_id ORDER BY pos) AS run,
        first_value(n_words) OVER (PARTITION BY conv_id ORDER BY pos) AS w0 FROM t),
best AS (SELECT u.conv_id, u.pos, min(c.run - c.n_words) AS before
         FROM r u JOIN r c ON c.conv_id = u.conv_id AND c.pos >= 0 AND c.pos <= u.pos
          AND u.w0 + u.run - (c.run - c.n_words) <= {QUESTION_LIMIT}
         WHERE u.role = 'user' GROUP BY u.conv_id, u.pos)
SELECT a.conv_id AS session_id, a.turn AS seq, a.completion, a.completion AS explanation,
  CASE WHEN same THEN '' ELSE code END AS code, '' AS new_code, CAST(0 AS BIGINT) AS lines_added,
  CAST(0 AS BIGINT) AS lines_removed, NULL::MAP(VARCHAR, VARCHAR) AS extra,
  CAST(CASE WHEN best.before IS NULL THEN u.w0 + u.n_words ELSE u.w0 + u.run - best.before END AS BIGINT)
    AS context_words,
  CASE WHEN u.w0 + u.n_words > {QUESTION_LIMIT} THEN 'overflow' ELSE 'ok' END AS context_status
FROM a JOIN r u ON u.conv_id = a.conv_id AND u.pos = 2 * a.n
LEFT JOIN best ON best.conv_id = u.conv_id AND best.pos = u.pos""")
def q_answer_questions(spark, sf):
    lines = table(spark, sf, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", F.concat(F.lit(">"), F.coalesce("text", F.lit(""))).alias("line"),
        *[F.expr(e.replace("//", "div")).alias(c) for c, e in QUESTION_STATE.items()])
    return FL.answer_questions(lines, session="conv_id", seq="turn", context_limit=QUESTION_LIMIT,
                               system=QUESTION_SYSTEM)


@register("explain_errors", f"""
WITH r AS (SELECT CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, {LOG_LEVEL_SQL} AS level,
             {LOG_MESSAGE_SQL} AS message FROM events)
SELECT ts, level, CASE WHEN level = 'ERROR' THEN message || chr(10) || chr(10) ||
  upper(replace('Explain this error:' || chr(10) || message, 'ß', 'ss')) ELSE message END
  AS message FROM r""")
def q_explain_errors(spark, sf):
    path = scratch_path(spark, "log")
    LT.log_write(_log_events(spark, sf), path, "w")
    return FL.explain_errors(spark, path).select("ts", "level", "message")


PREVIEW_COLS = [c for c, _, _ in SNAP_COLS]


def _list_sql(c: str, is_str: bool) -> str:
    item = f"CASE WHEN {c} IS NULL THEN 'None' ELSE " + (
        f"'''' || {c} || '''' END" if is_str else f"CAST({c} AS VARCHAR) END")
    return item


@register("table_preview", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, (SELECT count({c}) FROM customer) AS non_null, "
    f"'[' || (SELECT string_agg({_list_sql(c, t == 'string')}, ', ' ORDER BY c_custkey) FROM "
    f"(SELECT * FROM customer ORDER BY c_custkey LIMIT 3)) || ']' AS first_values"
    for c, t, _ in SNAP_COLS))
def q_table_preview(spark, sf):
    return P.table_preview(table(spark, sf, "customer"), PREVIEW_COLS, ["c_custkey"], k=3)


# --------------------------------------------------------------- streaming
def _stream_source(spark, df, col: str, bounds: list[int], key: str) -> str:
    """The table written as consecutive slices of ``col``, one write each,
    hash-partitioned by ``key``: a key's rows of one slice share a file, and
    later slices have later files, so a file stream sees each key in order."""
    src = scratch_path(spark, "stream-src")
    lo = None
    for hi in bounds + [None]:
        part = df
        if lo is not None:
            part = part.where(F.col(col) >= lo)  # rows without the column are in the first slice
        if hi is not None:
            part = part.where((F.col(col) < hi) | (F.col(col).isNull() if lo is None else F.lit(False)))
        part.repartition(key).write.mode("append").parquet(src)
        lo = hi
    return src


def _files_per_trigger(spark, src: str, batches: int = 3) -> int:
    """About ``batches`` micro-batches whatever the number of files (any
    boundary keeps each key in order: see ``_stream_source``)."""
    n = len(spark.read.parquet(src).inputFiles())
    return max(1, -(-n // batches))


STREAM_CONF = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _started(spark, writer, checkpoint=None):
    """Start a stream with its state in RocksDB and as many state partitions as
    the default parallelism: both are fixed when a stream starts (then kept in
    its checkpoint), so the session's settings are restored right after."""
    conf = STREAM_CONF | {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return writer.option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")).start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _finished(query) -> None:
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _run_to_parquet(spark, sdf) -> DataFrame:
    """Run an appending stream to completion into a parquet sink; read it back."""
    out = scratch_path(spark, "stream-out")
    _finished(_started(spark, sdf.writeStream.format("parquet").option("path", out).outputMode("append")))
    return spark.read.parquet(out)


def _run_updates(spark, sdf, keys: list[str]) -> DataFrame:
    """Run an updating stream to completion, each batch's changed rows written
    under its number; the last row of each key is the result."""
    out = scratch_path(spark, "stream-out")

    def write(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    _finished(_started(spark, sdf.writeStream.foreachBatch(write).outputMode("update")))
    rest = [c for c in sdf.columns if c not in keys]
    last = spark.read.option("recursiveFileLookup", True).parquet(out).groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "_batch").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _event_stream(spark, df, key: str):
    n = df.agg(F.max("event_id")).first()[0] or 0
    src = _stream_source(spark, df, "event_id", [n // 3 + 1, 2 * n // 3 + 1], key)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", _files_per_trigger(spark, src)).parquet(src)


@register("latest_nonempty_stream", ORACLES["latest_nonempty"])
def q_latest_nonempty_stream(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", F.expr(PURCHASE_SQL).alias("v"))
    return _run_updates(spark, ST.stream_latest_nonempty(
        _event_stream(spark, ev, "user_id"), "v", key="user_id", order=("ts", "event_id")), ["user_id"])


@register("settings_upsert_stream", ORACLES["settings_upsert"])
def q_settings_upsert_stream(spark, sf):
    ch = table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.col("event_type").alias("key"),
        F.expr(SETTING_VALUE_SQL).alias("value"), "event_id")
    got = _run_updates(spark, ST.stream_settings_upsert(
        _event_stream(spark, ch, "owner").withColumnRenamed("event_id", "seq")), ["owner", "key"])
    return got.where("value is not null")


@register("route_turns_stream", ORACLES["route_turns"])
def q_route_turns_stream(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(LINE_SQL).alias("line"))
    src = _stream_source(spark, lines, "turn", [2, 4], "conv_id")
    return _run_to_parquet(spark, L.route_turns(spark.readStream.schema(lines.schema).parquet(src)))


@register("context_at_turn_stream", ORACLES["context_at_turn"])
def q_context_at_turn_stream(spark, sf):
    conv = table(spark, sf, "conversations")
    src = _stream_source(spark, conv, "turn", [2, 4], "conv_id")
    stream = spark.readStream.schema(conv.schema).option(
        "maxFilesPerTrigger", _files_per_trigger(spark, src)).parquet(src)
    out = _run_to_parquet(spark, ST.stream_context_at_turn(stream, CONTEXT_LIMIT))
    return out.select("conv_id", "turn", "first_kept", "turns_sent", "words", "status")


@register("prompt_kind_stream", ORACLES["prompt_kind"])
def q_prompt_kind_stream(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    n = ev.agg(F.max("event_id")).first()[0] or 0
    src = _stream_source(spark, ev, "event_id", [n // 3 + 1, 2 * n // 3 + 1], "user_id")
    stream = spark.readStream.schema(ev.schema).option(
        "maxFilesPerTrigger", _files_per_trigger(spark, src)).parquet(src)
    out = _run_to_parquet(spark, ST.stream_prompt_kind(
        stream, session="user_id", seq=("ts", "event_id"), state=("event_type",),
        answered=F.col("event_type") != "error"))
    return out.select(F.col("session").alias("user_id"), "event_id", "prompt_kind")


@register("revision_diff_stream", ORACLES["revision_diff"])
def q_revision_diff_stream(spark, sf):
    conv = table(spark, sf, "conversations")
    src = _stream_source(spark, conv, "turn", [2, 4], "conv_id")
    stream = spark.readStream.schema(conv.schema).option(
        "maxFilesPerTrigger", _files_per_trigger(spark, src)).parquet(src)
    out = _run_to_parquet(spark, ST.stream_revision_diff(stream, doc="conv_id", version="turn"))
    return out.select("conv_id", "turn", "lines_added", "lines_removed")


@register("log_records_stream", ORACLES["log_records"])
def q_log_records_stream(spark, sf):
    """All but the last record of each file in a first run; a second one, from
    the first one's checkpoint, drains the files."""
    path, out, ckpt = (scratch_path(spark, n) for n in ("log", "stream-out", "stream-ckpt"))
    LT.log_write(_log_events(spark, sf), path, "w")
    for drain in (False, True):
        stream = LG.stream_growing_log(spark, path, drain=drain, partition_bytes=4 << 20)
        _finished(_started(spark, stream.writeStream.format("parquet").option("path", out).outputMode("append"), ckpt))
    return spark.read.parquet(out).select("ts", "level", "message")


EXPLAIN_BEFORE_S, EXPLAIN_AFTER_S = 86_400, 21_600
EXPLAIN_CODE_SQL = "CASE WHEN value < 50 THEN event_type || '()' ELSE '' END"


@register("error_enrich_stream", f"""
WITH r AS (SELECT event_id, user_id, ts, {LEVEL_SQL} AS level, {MESSAGE_SQL} AS message FROM events),
x AS (SELECT user_id, ts AS ets, coalesce(props, '') AS completion, {EXPLAIN_CODE_SQL} AS code
      FROM events WHERE event_type IN ('click', 'view')),
m AS (SELECT r.event_id, x.* EXCLUDE (user_id) FROM r JOIN x ON r.level = 'ERROR' AND r.user_id = x.user_id
      AND x.ets >= r.ts - INTERVAL {EXPLAIN_BEFORE_S} SECOND AND x.ets <= r.ts + INTERVAL {EXPLAIN_AFTER_S} SECOND),
c AS (SELECT event_id, completion FROM m WHERE completion <> ''
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ets DESC, completion DESC) = 1),
k AS (SELECT event_id, code FROM m WHERE code <> ''
      QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ets DESC, code DESC) = 1)
SELECT r.event_id, r.user_id, r.level, CASE WHEN c.completion IS NOT NULL
  THEN concat_ws(chr(10) || chr(10), r.message, c.completion, k.code) ELSE r.message END AS message
FROM r LEFT JOIN c USING (event_id) LEFT JOIN k USING (event_id)""")
def q_error_enrich_stream(spark, sf):
    """Two streams of event-time slices; a last row of each moves the
    watermarks past all others."""
    ev = table(spark, sf, "events")
    recs = ev.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                     F.expr(LEVEL_SQL).alias("level"), F.expr(MESSAGE_SQL).alias("message"))
    expl = ev.where("event_type in ('click', 'view')").select(
        "user_id", F.col("ts").cast("timestamp").alias("ets"), F.coalesce("props", F.lit("")).alias("completion"),
        F.expr(EXPLAIN_CODE_SQL).alias("code"))
    span = recs.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "a", "b", (F.unix_micros("b") - F.unix_micros("a")).alias("n")).first()
    step = (span["n"] or 0) // 3 + 1
    bounds = [span["a"] + timedelta(microseconds=step * i) for i in (1, 2)] if span["a"] else []
    after = (span["b"] or datetime(2000, 1, 1)) + timedelta(days=3650)
    sides = []
    for df, ts, key, last in ((recs, "ts", "user_id", (None, None, after, "INFO", "end")),
                              (expl, "ets", "user_id", (-1, after, "end", ""))):
        src = _stream_source(spark, df, ts, bounds, key)
        spark.createDataFrame([last], df.schema).write.mode("append").parquet(src)
        sides.append(spark.readStream.schema(df.schema).option(
            "maxFilesPerTrigger", _files_per_trigger(spark, src, 4)).parquet(src))
    # No row is later than the slice before its own.
    out = _run_to_parquet(spark, stream_error_enrich(
        *sides, key="event_id", session="user_id", explained="ets", before_s=EXPLAIN_BEFORE_S,
        after_s=EXPLAIN_AFTER_S, delay_s=2 * step // 1_000_000 + 1))
    return out.where("event_id is not null").select("event_id", "user_id", "level", "message")


@register("batch_complete_stream", ORACLES["batch_complete"])
def q_batch_complete_stream(spark, sf):
    prompts = table(spark, sf, "conversations").where(F.col("role") == "user") \
        .select("conv_id", "turn", F.col("text").alias("prompt"))
    src = _stream_source(spark, prompts, "turn", [2, 4], "conv_id")
    stream = spark.readStream.schema(prompts.schema).option(
        "maxFilesPerTrigger", _files_per_trigger(spark, src)).parquet(src)
    journal, out = scratch_path(spark, "journal"), scratch_path(spark, "stream-out")
    _finished(_started(spark, stream.writeStream.foreachBatch(
        lambda batch, number: complete_batch(batch, number, journal_path=journal, out=out))))
    return spark.read.option("recursiveFileLookup", True).parquet(out)


@register("settings_upsert_snapshot", ORACLES["settings_upsert"])
def q_settings_upsert_snapshot(spark, sf):
    """The change log in three slices, upserted one after the other into a
    snapshot in buckets."""
    ch = table(spark, sf, "events").select(
        F.col("user_id").alias("owner"), F.col("event_type").alias("key"),
        F.expr(SETTING_VALUE_SQL).alias("value"), F.col("event_id").alias("seq"))
    path = scratch_path(spark, "snapshot")
    n = ch.agg(F.max("seq")).first()[0] or 0
    for lo, hi in ((None, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, None)):
        part = ch.where(F.col("seq") >= lo) if lo is not None else ch
        SN.upsert_snapshot(path, part.where(F.col("seq") < hi) if hi is not None else part, buckets=8)
    return SN.read_snapshot(spark, path, SN._schema("owner", "key", "value", ch))
