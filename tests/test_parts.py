"""Long texts in parts (O5, O25) and frequent names in slices (O10)."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.operators import prompts as P
from parley.operators import turns as T
from parley.plans.ordered import text_parts
from parley.sources import notebooks as NB


def cut(text, n):
    return {i: text[i * n:(i + 1) * n] for i in range(max(1, -(-len(text) // n)))}


@pytest.mark.parametrize("sep, size", [("\n\n", 7), ("", 5), ("--", 1), ("\n\n", 10_000)])
def test_parts_are_slices_of_the_whole_text(spark, sep, size):
    r = random.Random(size)
    pieces = ["", "a", "äöü€", "𝄞𝄞", "line\nline", "x" * 40, None]
    rows = [(k, i, r.choice(pieces)) for k in ("a", "b", None) for i in range(60)] \
        + [("hot", i, f"{i}") for i in range(3000)] + [("empty", 0, ""), ("null", 0, None)]
    df = spark.createDataFrame(rows, "k string, o int, p string")
    want = defaultdict(list)
    for k, _, p in rows:
        if p is not None:
            want[k].append(p)
    got = defaultdict(dict)
    for x in text_parts(df, "k", "o", "p", sep=sep, part_chars=size, parts=6).collect():
        assert x["part"] not in got[x["k"]]
        got[x["k"]][x["part"]] = x["text"]
    assert got == {k: cut(sep.join(v), size) for k, v in want.items()}
    assert text_parts(df.where("false"), "k", "o", "p").count() == 0


def test_history_parts_join_to_the_rendered_history(spark):
    rows = [(c, t, ("system", "user", "assistant", "tool")[t % 4], "w" * (t * 37 % 11) if t % 5 else None)
            for c in range(3) for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole = {x["conv_id"]: x["history"] for x in T.history_render(df).collect()}
    got = {(x["conv_id"], x["part"]): x["text"] for x in T.history_parts(df, part_chars=16, parts=5).collect()}
    assert got == {(c, i): t for c, h in whole.items() for i, t in cut(h, 16).items()}


def test_shell_history_parts(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_text("".join(f"{i}: print({i}, '{name}')\n" for i in range(400)))
    lines = NB.history_lines(spark, str(tmp_path))
    whole = {x["file"]: x["text"] for x in NB.history_text(lines).collect()}
    got = {(x["file"], x["part"]): x["text"] for x in NB.history_text_parts(lines, part_chars=100, parts=4).collect()}
    assert len(whole) == 2 and got == {(f, i): t for f, h in whole.items() for i, t in cut(h, 100).items()}


@pytest.mark.parametrize("keys", [[], ["sid"]])
def test_frequent_names_are_dealt_to_slices(spark, keys):
    """A token that every row has: the same rows as without slices."""
    rows = [(s, i, f"hot x{i % 50} t{i}") for s in ("a", "b") for i in range(1000)] + [("a", 5000, None), ("b", 5000, "")]
    code = spark.createDataFrame(rows, "sid string, seq int, code string")
    names = [(s, n, f"{s}{n}") for s in ("a", "b") for n in ("hot", "x1", "t999", "unused", "_1")]
    variables = spark.createDataFrame(names, "sid string, name string, value string")
    if not keys:
        variables = variables.where("sid = 'a'").drop("sid")
    use = lambda n: P.used_variables(variables, code, keys=keys, code_keys=["sid", "seq"], hot_rows=n)
    want = sorted((s, i, n) for s, i, c in rows for n in ("hot", "x1", "t999") if n in (c or "").split())
    for hot_rows in (100, 10 ** 6):
        got = use(hot_rows)
        assert set(got.columns) == {"sid", "seq", "name", "value"}
        assert sorted((x["sid"], x["seq"], x["name"]) for x in got.collect()) == want
    toks = P.code_tokens(code, "code", ["sid", "seq"])
    assert {x["_hot"]: x["_slices"] for x in P.hot_tokens(toks, 100).collect()} == {"hot": 20}
    assert P.hot_tokens(toks.where("false"), 100).count() == 0
    assert P.used_variables(variables, code.where(F.lit(False)), keys=keys, code_keys=["sid", "seq"]).count() == 0
