from collections import defaultdict
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from parley.operators import completions as C
from parley.operators import logs as L
from parley.operators import prompts as P
from parley.operators import settings as S
from parley.session import table


def test_prompt_field_check(spark):
    tmpl = "Q: {question}\nCODE: {code}"
    df = spark.createDataFrame(
        [(1, {"question": "q", "code": "c"}), (2, {"question": "q"}),
         (3, {"question": "q", "code": "c", "stack_trace": "t"}),
         (4, {"stack_trace": "t", "question": None})],
        "id int, fields map<string,string>")
    got = {r.id: (r.unexpected, r.missing, r.error)
           for r in P.prompt_field_check(df, tmpl).collect()}
    assert got[1] == ([], [], None)
    assert got[2] == ([], ["code"], "Missing required kwarg(s): {'code'}")
    assert got[3][2] == "Received unexpected kwarg(s): {'stack_trace'}"
    assert got[4][1] == ["code"]  # a key with a NULL value is given
    rep = P.prompt_field_report(P.prompt_field_check(df, tmpl)).first()
    assert (rep.rows, rep.rows_missing, rep.rows_unexpected, rep.rows_ok) == (4, 2, 2, 1)


def _kind_replay(rows):
    """rows: [(seq, state, answered)] -> {seq: kind}; the reference's rule."""
    out, prev = {}, None
    have = False
    for seq, state, answered in sorted(rows):
        out[seq] = "contextless" if have and prev == (state,) else "contextful"
        if answered:
            prev, have = (state,), True
    return out


def test_prompt_kind_vs_replay(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    rows = ev.select("user_id", "event_id", "event_type").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.user_id].append((r.event_id, r.event_type, r.event_type != "error"))
    for parts in (None, 7):
        got = P.prompt_kind(ev.select("user_id", "event_id", "event_type"),
                            session="user_id", order=("event_id",), state=("event_type",),
                            answered=F.col("event_type") != "error", parts=parts)
        res = {(r.user_id, r.event_id): r.prompt_kind for r in got.collect()}
        for uid, rs in by.items():
            for seq, kind in _kind_replay(rs).items():
                assert res[(uid, seq)] == kind


def test_prompt_kind_null_state(spark):
    df = spark.createDataFrame(
        [(1, 1, None, True), (1, 2, None, True), (1, 3, "a", False), (1, 4, None, True),
         (2, 1, "x", False), (2, 2, "x", True), (2, 3, "x", True)],
        "session_id int, seq int, state string, answered boolean")
    got = {(r.session_id, r.seq): r.prompt_kind for r in P.prompt_kind(df).collect()}
    assert got == {(1, 1): "contextful", (1, 2): "contextless", (1, 3): "contextful",
                   (1, 4): "contextless", (2, 1): "contextful", (2, 2): "contextful",
                   (2, 3): "contextless"}
    assert {r.prompt_kind for r in P.prompt_kind(df, single_template=True).collect()} == \
        {"contextful"}


def test_used_variables(spark):
    code = spark.createDataFrame([(1, 1, "for j in range(n): nums[j] += x"),
                                  (1, 2, "print(_) ; In x")], "sid int, seq int, code string")
    var = spark.createDataFrame([(1, 1, "nums", "[1]"), (1, 1, "n", "3"), (1, 1, "x", "2"),
                                 (1, 2, "_", "9"), (1, 2, "In", "[]"), (1, 2, "x", "2"),
                                 (1, 2, "__3", "0")],
                                "sid int, seq int, name string, value string")
    got = sorted((r.seq, r.name) for r in P.used_variables(var, code, keys=["sid", "seq"])
                 .collect())
    assert got == [(1, "x"), (2, "x")]  # nums[j] does not use nums; shell names dropped
    ident = sorted((r.seq, r.name) for r in
                   P.used_variables(var, code, keys=["sid", "seq"], tokens="identifier")
                   .collect())
    assert ident == [(1, "n"), (1, "nums"), (1, "x"), (2, "x")]


def test_error_enrich(spark):
    recs = spark.createDataFrame(
        [(1, "s1", "ERROR", "list index out of range"), (2, "s1", "WARNING", "warn"),
         (3, "s2", "ERROR", "boom"), (4, "s3", "ERROR", "no code")],
        "id int, session_id string, level string, message string")
    log = spark.createDataFrame(
        [("s1", 1, "EXPLANATION", "fix()"), ("s1", 2, "LATER", ""), ("s3", 1, "ONLY TEXT", "")],
        "session_id string, seq int, completion string, new_code string")
    ex = L.session_explanations(log)
    got = {r.id: r.message for r in L.error_enrich(recs, ex).collect()}
    assert got == {1: "list index out of range\n\nLATER\n\nfix()", 2: "warn", 3: "boom",
                   4: "no code\n\nONLY TEXT"}


def test_latest_nonempty_oldest(spark):
    log = spark.createDataFrame([("a", 1, ""), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "")],
                                "session_id string, seq int, v string")
    newest = {r.session_id: r.latest for r in C.latest_nonempty(log, "v").collect()}
    oldest = {r.session_id: r.latest for r in C.latest_nonempty(log, "v", newest=False).collect()}
    assert newest == {"a": "y", "b": None} and oldest == {"a": "x", "b": None}


def test_settings_upsert_and_resolve(spark):
    base = spark.createDataFrame([("u", "openai_api_key", "sk-1")], "owner string, key string, value string")
    ch = spark.createDataFrame([("u", "model_name", "gpt-3.5-turbo", 1),
                                ("u", "model_name", None, 2)],
                               "owner string, key string, value string, seq long")
    snap = {r.key: r.value for r in S.settings_upsert(base, ch).collect()}
    assert snap == {"openai_api_key": "sk-1"}
    snap2 = {r.key: r.value for r in S.settings_upsert(base, ch.where("seq = 1")).collect()}
    assert snap2 == {"openai_api_key": "sk-1", "model_name": "gpt-3.5-turbo"}
    layers = spark.createDataFrame(
        [("a", "model_name", "gpt-3.5-turbo", "template"), ("a", "model_name", "gpt-4", "config"),
         ("b", "model_name", "gpt-3.5-turbo", "template"), ("b", "model_name", "gpt-4", "config"),
         ("b", "model_name", "gpt-3.5-turbo", "explicit"),
         ("c", "model_name", "gpt-4o-mini", "template"), ("c", "model_name", "", "config"),
         ("d", "model_name", "", "explicit"), ("d", "model_name", "gpt-4", "config")],
        "owner string, key string, value string, layer string")
    got = {r.owner: r.value for r in S.settings_resolve(layers).collect()}
    assert got == {"a": "gpt-4", "b": "gpt-3.5-turbo", "c": "gpt-4o-mini", "d": ""}


def test_schema_check(spark):
    df = spark.createDataFrame([("1", "x"), ("y", None), (None, "2")], "a string, b string")
    got = {r.column: (r.values, r.violations) for r in S.schema_check(df, {"a": "int", "b": "int"}).collect()}
    assert got == {"a": (2, 1), "b": (2, 1)}
    assert S.schema_violations(df, {"a": ["int"], "z": ["int"]}) == ["a must be int, not string"]


def test_batch_complete_calls_the_model_once_a_batch(spark):
    import pandas as pd

    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, "boom" if i == 3 else f"p{i}") for i in range(20)],
                               "id int, prompt string").coalesce(1)

    def some_fail(s: pd.Series) -> list:
        calls.add(len(s))
        out = [ValueError("bad prompt") if p == "boom" else p.upper() for p in s]
        raise C.RowErrors(out)

    def short(s: pd.Series) -> list:
        calls.add(len(s))
        return ["only one"]

    def down(s: pd.Series) -> list:
        calls.add(len(s))
        raise RuntimeError("down")

    got = {r.id: (r.completion, r.error) for r in C.batch_complete(df, some_fail).collect()}
    assert got[3] == (None, "ValueError: bad prompt") and got[4] == ("P4", None) and calls.value == 20
    got = C.batch_complete(df, short).collect()
    assert {(r.completion, r.error) for r in got} == \
        {(None, "ValueError: the model returned 1 completions for 20 prompts")} and calls.value == 40
    assert {r.error for r in C.batch_complete(df, down).collect()} == {"RuntimeError: down"} and calls.value == 60
    assert {r.completion for r in C.batch_complete(df).collect()} == {"BOOM", *(f"P{i}" for i in range(20) if i != 3)}


def test_revision_diff_over_partitions(spark):
    df = spark.createDataFrame(
        [(1, 0, "a\nb"), (1, 1, "a\nc\nc"), (1, 2, ""), (1, 5, "c"), (2, 3, None)],
        "doc_id long, version long, text string")
    for parts in (None, 1, 4):
        got = {(r.doc_id, r.version): (r.lines_added, r.lines_removed)
               for r in C.revision_diff(df, parts=parts).collect()}
        assert got == {(1, 0): (2, 0), (1, 1): (2, 1), (1, 2): (0, 3), (1, 5): (1, 0),
                       (2, 3): (0, 0)}


def test_used_variables_in_row(spark):
    df = spark.createDataFrame(
        [("for j in range(n): nums[j] += x", {"nums": "[1]", "n": "3", "x": "2", "_": "9"})],
        "code string, vars map<string,string>")
    got = P.used_variables_in_row(df, "vars", "code").first().vars
    assert got == {"x": "2"}
    got = P.used_variables_in_row(df, "vars", "code", tokens="identifier").first().vars
    assert got == {"nums": "[1]", "n": "3", "x": "2"}


def test_parse_completion_with_json_parser(spark):
    schema = "explanation string, code string, extra map<string,string>"
    df = spark.createDataFrame(
        [('{"explanation": "why", "code": "fix()", "extra": {"k": "v"}}',)], "completion string")
    r = C.parse_completion(df, parser=lambda c: F.from_json(c, schema)).first()
    assert (r.explanation, r.code, r.extra) == ("why", "fix()", {"k": "v"})


def test_completion_log_counts_changed_lines(spark):
    df = spark.createDataFrame([(1, 1, "why\n```\na\nb\nb\n```", "b\nc"), (1, 2, "no code", "x"), (1, 3, "  ", None)],
                               "session_id int, seq int, completion string, old string")
    got = {r.seq: (r.code, r.new_code, r.lines_added, r.lines_removed, r.completion)
           for r in C.completion_log(df, old_code="old").collect()}
    assert got[1][:4] == ("b\nc", "a\nb\nb", 2, 1) and got[2][1:4] == ("", 0, 0)
    assert got[3][4] == C.EMPTY_ANSWER


def test_completion_log_counts_many_lines_in_time(spark):
    """20,000 lines, repeats among them, counted as a multiset difference."""
    import random
    import time
    from collections import Counter
    r = random.Random(3)
    new = [f"x{r.randrange(9000)}" for _ in range(20_000)]
    old = [f"x{r.randrange(9000)}" for _ in range(20_000)] + ["", "1:x5"]
    df = spark.createDataFrame([(1, 1, "why\n```\n" + "\n".join(new) + "\n```", "\n".join(old))],
                               "session_id int, seq int, completion string, old string")
    began = time.time()
    got = C.completion_log(df, old_code="old").first()
    assert time.time() - began < 30
    assert (got.lines_added, got.lines_removed) == ((Counter(new) - Counter(old)).total(), (Counter(old) - Counter(new)).total())


@pytest.mark.parametrize("kind,values,want", [
    ("map<string,string>", [{"a": "b"}, {}, None], {"a": "b"}), ("array<int>", [[0], [], None], [0]),
    ("bigint", [5, 0, None], 5), ("double", [float("nan"), 0.0, -0.0], float("nan")), ("boolean", [True, False, None], True),
    ("string", ["0", "", None], "0"), ("binary", [b"x", b"", None], b"x"), ("decimal(9,2)", [Decimal("0.10"), Decimal("0.00"), None], Decimal("0.10")),
    ("struct<a: int>", [(None,), None, None], (None,)), ("date", [date(1970, 1, 1), None, None], date(1970, 1, 1))])
def test_latest_useful_value_by_type(spark, kind, values, want):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"session_id int, seq int, v {kind}")
    got = C.latest_nonempty(df, "v").first().latest
    assert got == want or (got != got and want != want)
    assert C.latest_nonempty(df.where("seq > 0"), "v").first().latest is None
