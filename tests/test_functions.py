"""Text rules on hand-computed cases."""
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as X
from parley.operators import completions as C
from parley.operators import logs as L
from parley.operators import prompts as P


def one(spark, col, value, schema):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", schema)]))
    return df.select(col(F.col("v")).alias("o")).first().o


LONGS, DOUBLES = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())


@pytest.mark.parametrize("value,schema,n,expected", [
    ([3, 1, 2], LONGS, 400, "[3, 1, 2]"),
    ({"k": 5}, T.MapType(T.StringType(), T.LongType()), 400, "{'k': 5}"),
    (False, T.BooleanType(), 400, "False"),
    (-12, T.LongType(), 400, "-12"),
    (None, T.LongType(), 400, "None"),
    ("quick", T.StringType(), 400, "'quick'"),
    # 40 numbers of two digits: 160 characters, so a limit of 60 fits 15 of them
    (list(range(50, 90)), LONGS, 60, "<list, truncated_data=[" + ", ".join(map(str, range(50, 65))) + ", ...], len=40>"),
    ("0123456789" * 4, T.StringType(), 30, "'0123456789012...' (truncated)"),
    (0.1, T.DoubleType(), 400, "0.1"),
    (-0.00001, T.DoubleType(), 400, "-1e-05"),
    (0.00012, T.DoubleType(), 400, "0.00012"),
    (12345678.9, T.DoubleType(), 400, "12345678.9"),
    (1e15, T.DoubleType(), 400, "1000000000000000.0"),
    (2.5e16, T.DoubleType(), 400, "2.5e+16"),
    (1e100, T.DoubleType(), 400, "1e+100"),
    (float("nan"), T.DoubleType(), 400, "nan"),
    (float("-inf"), T.DoubleType(), 400, "-inf"),
    (123456789012, T.LongType(), 10, "1.235e+11"),
    (date(2024, 2, 29), T.DateType(), 400, "2024-02-29"),
    ([[1, 2], [], None], T.ArrayType(LONGS), 400, "[[1, 2], [], None]"),
    ({"a": [0.5]}, T.MapType(T.StringType(), DOUBLES), 400, "{'a': [0.5]}"),
    (bytearray(b"xy"), T.BinaryType(), 400, "<binary>"),
])
def test_bounded_preview(spark, value, schema, n, expected):
    assert one(spark, lambda c: P.preview(c, schema, n), value, schema) == expected


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=True, width=64), min_size=20, max_size=40))
def test_float_text_is_python_s(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for r in df.select("x", P._float_repr(F.col("x")).alias("t")).collect():
        assert float(r.t) == r.x or (r.x != r.x and r.t == "nan")
        mantissa, _, exponent = repr(r.x).partition("e")
        assert r.t.partition("e")[2] == exponent and ("." in r.t) == ("." in repr(r.x))


def test_preview_same_length_branch(spark):
    # n == len: one element longer than the limit -> cut at the last comma
    v = [10 ** 17 + 1]
    got = one(spark, lambda c: P.preview(c, T.ArrayType(T.LongType()), 12), v,
              T.ArrayType(T.LongType()))
    s = repr(v)[:2]
    assert got == f"<list, truncated_data={s[:s.rfind(',')]}, len=1>"


def test_state_snapshot(spark):
    df = spark.createDataFrame([("ab", [7, 8], (True, ("q", 1.5)))],
                               "name string, xs array<int>, at struct<on: boolean, pos: struct<k: string, v: double>>")
    got = P.state_snapshot(df, ["name", "xs", "at"]).first().snapshot
    assert got == ("{\n    'name': 'ab',   # type: string\n    'xs': [7, 8],   # type: array<int>\n"
                   "    'at': {'on': True, 'pos': {'k': 'q', 'v': 1.5}},   "
                   "# type: struct<on:boolean,pos:struct<k:string,v:double>>\n}")


def test_struct_previews(spark):
    t = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.IntegerType())])
    whole = "{'x': 'abc', 'y': None}"
    assert one(spark, lambda c: P.preview(c, t, 24), ("abc", None), t) == whole
    # As a map of the same text: cut to pairs, one of the two that 30 / 41 leaves.
    assert one(spark, lambda c: P.preview(c, t, 30), ("a" * 25, 12), t) == f"<dict, truncated_data=[('x', '{'a' * 25}'), ...], len=2>"
    assert one(spark, lambda c: P.preview(c, t, 24), None, t) == "None"
    nested = T.ArrayType(t)
    assert one(spark, lambda c: P.preview(c, nested, 100), [("p", 1), None], nested) == "[{'x': 'p', 'y': 1}, None]"


def test_map_snapshot_of_nothing(spark):
    empty = spark.createDataFrame([({},)], "m map<string,string>")
    assert empty.select(P.map_snapshot(F.col("m")).alias("s")).first().s == "{\n}"


@pytest.mark.parametrize("text,expected", [
    ("plain words", ""),
    ("before\n```python\nk = 1\n```\nafter", "k = 1"),
    ("```\nfirst()\n```\nand\n```python\nsecond()\nthird()\n```", "# 1\nfirst()\n\n# 2\nsecond()\nthird()"),
    ("```sql\nselect 1\n```", ""),  # another language's fence is none of ours
])
def test_join_code_blocks(spark, text, expected):
    df = spark.createDataFrame([(text,)], "completion string")
    assert C.join_blocks(df).first().code == expected


def test_extract_code_blocks_list(spark):
    df = spark.createDataFrame([("```\na\n```\n```python\nb\n\nc\n```\n```\nopen",)], "completion string")
    assert [(r.block_no, r.code) for r in C.extract_code_blocks(df).orderBy("block_no").collect()] == \
        [(1, "a"), (2, "b\n\nc")]


def test_an_indented_fence_does_not_close_a_block(spark):
    body = "def f():\n    # sample:\n    ```\n    g()\n    ```\n    return 2"
    df = spark.createDataFrame([(f"Look:\n```\n{body}\n```\nDone.",)], "completion string")
    assert C.join_blocks(df).first().code == body


def test_parse_completion_splits_at_the_first_fence(spark):
    text = "Count down:\n\n```python\nwhile n:\n    n -= 1\n```\nThen stop.\n```\nstop()\n```"
    r = C.parse_completion(spark.createDataFrame([(text,)], "completion string")).first()
    assert r.explanation == "Count down:\n"
    assert r.code == "# 1\nwhile n:\n    n -= 1\n\n# 2\nstop()"


def test_route_turns(spark):
    routes = {"where is it?": (True, "where is it?"), "a?b": (True, "a?b"), "> tell me": (True, " tell me"),
              ">>x": (True, "x"), "[dev] why?": (True, "[dev] why?"), "up": (False, "up"),
              "y > 3": (False, "y > 3"), " >x": (False, " >x"), "": (False, "")}
    df = spark.createDataFrame([(x,) for x in routes], "line string")
    got = {r.line: (r.kind == "conversational", r.text, r.verbose) for r in L.route_turns(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == routes
    assert [k for k, v in got.items() if v[2]] == ["[dev] why?"]


STRIP_CASES = [
    ("def f(a):\n    duck()\n    return a", "def f(a):\n    return a"),
    ("duck(1)\n  duck (2)\n# duck()\nunduck()", "  duck (2)\n# duck()\nunduck()"),
    ("duck()", ""),
    ("nothing here\n\n", "nothing here\n"),
    # line-break and whitespace variants (splitlines / strip semantics)
    ("a\r\n\tduck()\r\nb\n", "a\nb"),
    ("a\x0bduck(1)\x85b\u2028 duck()", "a\nb"),
    ("", ""),
]


def test_strip_lines(spark):
    df = spark.createDataFrame(STRIP_CASES, "code string, expected string")
    for r in L.strip_lines(df, "code", out="got").collect():
        assert r.got == r.expected


def test_template_fields_and_render(spark):
    contextful = ("Q: {question}\nCODE: {code}\nNEXT: {next_line}\nLOCALS: {local_vars}\n"
                  "GLOBALS: {global_vars}\n{{ answer }}")
    assert set(X.template_fields(contextful)) == {"code", "global_vars", "local_vars",
                                                  "next_line", "question"}
    assert X.template_fields("Asked: {question}") == ["question"]
    df = spark.createDataFrame([("why?", "x = 1", None, "{}", "{}")],
                               "question string, code string, next_line string, "
                               "local_vars string, global_vars string")
    got = P.prompt_render(df, {"contextful": contextful}).first().prompt
    assert got == "Q: why?\nCODE: x = 1\nNEXT: \nLOCALS: {}\nGLOBALS: {}\n{ answer }"
    with pytest.raises(ValueError):
        P.prompt_render(df, {"x": "{missing_column}"})


def test_redact(spark):
    df = spark.createDataFrame([("sk-abcdefgh",), ("abc",), ("",)], "k string")
    got = {r.k: (r.m, r.v) for r in df.select(
        "k", X.redact("k").alias("m"), X.looks_like_key("k").alias("v")).collect()}
    assert got == {"sk-abcdefgh": ("sk-a*******", True), "abc": ("abc", False), "": ("", False)}


def test_speaker_words_unicode(spark):
    df = spark.createDataFrame([("a b c  d\t",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(X.speaker_words("t").alias("n")).collect()] == [5, 1, 1]
