from parley.plans import flows as FL


def test_answer_questions(spark):
    lines = spark.createDataFrame([
        (1, 1, "why is x 3?", "x = 3", "x", "{'x': 3}", "{}"),
        (1, 2, "n", "x = 3", "x", "{'x': 3}", "{}"),            # a command: not sent
        (1, 3, "> and then?", "x = 3", "x", "{'x': 3}", "{}"),  # same state: contextless
        (1, 4, "what now?", "y = 1", "y", "{'y': 1}", "{}"),    # state changed
    ], "session_id long, seq long, line string, code string, next_line string, "
       "local_vars string, global_vars string")
    log = {r.seq: r for r in FL.answer_questions(lines).collect()}
    assert sorted(log) == [1, 3, 4]
    assert log[1].completion.startswith("ASKED: WHY IS X 3?\nSOURCE:\nX = 3")
    assert log[3].completion == "ASKED:  AND THEN?"
    assert log[4].code == "y = 1" and "SOURCE:" in log[4].completion
    assert log[3].code == "" and log[1].code == "x = 3"  # a contextless question has no code


def _asks(spark, n):
    rows = [(s, i, f"why {i}?", "x", "y", "{}", "{}") for s in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "session_id long, seq long, line string, code string, next_line string, "
                                       "local_vars string, global_vars string")


def test_questions_are_sent_with_their_conversation(spark):
    from tests import replay
    lines = _asks(spark, 4)

    def model(history):  # answers with the number of turns it was sent
        return [f"saw {h.count(chr(10) * 2 + 'Human: ') + h.startswith('Human: ')} questions, {h[:12]}" for h in history]

    log = {(r.session_id, r.seq): r for r in FL.answer_questions(
        lines, model=model, context_limit=1000, system="Be brief").collect()}
    assert [log[1, i].completion for i in range(4)] == [f"saw {i + 1} questions, System: Be b" for i in range(4)]
    # With the stub (answers are the prompts, upper-cased) the words are known.
    got = FL.answer_questions(lines, context_limit=40, system="Be brief").collect()
    for r in got:
        if r.session_id == 1:
            turns = [(-1, "system", "Be brief")]
            for q in sorted(x.seq for x in got if x.session_id == 1 and x.seq <= r.seq):
                text = next(x.completion for x in got if x.session_id == 1 and x.seq == q)
                turns += [(2 * q, "user", text), (2 * q + 1, "assistant", text)]
            want = replay.context_replay(turns, 40)[2 * r.seq]
            assert (r.context_words, r.context_status) == (want[2], want[3])


def test_a_failed_question_is_withdrawn(spark):
    from parley.operators.completions import RowErrors

    def model(history):
        out = [RuntimeError("no") if h.rstrip().endswith("why 1?") or "why 1?" in h.rpartition("Human: ")[2]
               else f"turns {h.count('Human: ')}" for h in history]
        raise RowErrors(out)

    log = {r.seq: r.completion for r in FL.answer_questions(
        _asks(spark, 4).where("session_id = 1"), model=model, context_limit=1000).collect()}
    assert log == {0: "turns 1", 2: "turns 2", 3: "turns 3"}


def test_explain_errors_with_failing_model(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from parley.operators.completions import RowErrors

    from parley.session import scratch_path
    from parley.sources import logtext as LT

    recs = spark.createDataFrame(
        [("2024-01-01 00:00:01", "ERROR", "bad index"), ("2024-01-01 00:00:02", "INFO", "fine"),
         ("2024-01-01 00:00:03", "ERROR", "boom here")],
        "ts string, level string, message string").withColumn("ts", F.to_timestamp_ntz("ts"))
    path = scratch_path(spark, "log")
    LT.log_write(recs, path, "w")

    def model(prompts: pd.Series):
        raise RowErrors([RuntimeError("model down") if "boom" in p else "Because.\n```python\nfix()\n```"
                         for p in prompts])

    out = {r.message.split("\n")[0]: r.message
           for r in FL.explain_errors(spark, path, model=model).collect()}
    assert out["fine"] == "fine"
    assert out["boom here"] == "boom here"  # the model failed: record unchanged
    assert out["bad index"] == "bad index\n\nBecause.\n```python\nfix()\n```\n\nfix()"
