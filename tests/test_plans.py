"""Plan shape as regression tests: the properties that matter at scale."""
import pytest

import __spark_entry__ as E


def _plan(spark, sf_dir, name):
    """The plan that ran: the DataFrame's own execution is collected, so an
    adaptive plan is final."""
    df = E.queries()[name](spark, sf_dir)
    df._jdf.queryExecution().toRdd().count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=false" not in plan
    return plan


@pytest.mark.parametrize("name", ["turn_words", "extract_code_blocks", "parse_completion",
                                  "route_turns", "strip_lines", "redact_secrets",
                                  "state_snapshot", "bounded_preview"] )
def test_row_wise_queries_do_not_shuffle(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert "Exchange" not in plan and "ShuffleQueryStage" not in plan


def test_truncation_plan(spark, sf_dir):
    plan = _plan(spark, sf_dir, "history_truncate")
    assert "SortAggregate" not in plan          # totals are hash-aggregated
    assert "BroadcastHashJoin" in plan          # offsets joined by broadcast
    # no CURRENT ROW .. UNBOUNDED FOLLOWING frame (re-aggregated per row)
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert "unboundedpreceding$(), currentrow$()" in plan


def test_truncation_scans_no_text(spark, sf_dir):
    from pyspark.sql import functions as F
    from parley.operators import turns as T
    from parley.session import table
    conv = table(spark, sf_dir, "conversations")
    narrow = conv.select("conv_id", "turn", T.speaker_words("text").alias("n_words"), F.lit(200).alias("limit"))
    kept = T.kept_turns(narrow)
    assert "text" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in _plan(spark, sf_dir, "budget_status").replace("Context", "").replace("context_window", "")


def test_truncation_of_a_bucketed_table_shuffles_no_text(spark, sf_dir):
    from parley.operators import turns as T
    from parley.session import table
    conv = table(spark, sf_dir, "conversations")
    T.save_turns(conv, "turns_by_bucket", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = T.history_truncate(spark.table("turns_by_bucket"), 200, keyed=True)
        assert sorted(df.collect()) == sorted(T.history_truncate(conv, 200).collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.splitlines() if "Exchange" in x or "SortMergeJoin" in x or "FileScan" in x or "Scan parquet" in x]
        # Above the texts of the first join there is no exchange, only above the kept rows.
        join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
        assert "Scan parquet" in lines[join + 1] or "FileScan" in lines[join + 1], lines[:6]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table turns_by_bucket")


def test_context_at_turn_reads_no_text(spark, sf_dir):
    plan = _plan(spark, sf_dir, "context_at_turn")
    assert "text" not in plan                   # words are counted once, before the range partitioning
    assert "Union" not in plan                  # candidates and probes from one pass


def test_error_enrich_shuffles_only_errors(spark, sf_dir):
    plan = _plan(spark, sf_dir, "error_enrich")
    assert "Union" in plan


def test_budget_status_has_no_sort_aggregate(spark, sf_dir):
    plan = _plan(spark, sf_dir, "budget_status")
    assert "SortAggregate" not in plan


def test_write_routed(spark):
    from parley.operators import logs as L
    from parley.session import scratch_path
    df = spark.createDataFrame([("why?",), ("next",)], "line string")
    path = scratch_path(spark, "routed")
    L.write_routed(L.route_turns(df), path)
    got = {r.kind: r.line for r in spark.read.parquet(path).collect()}
    assert got == {"conversational": "why?", "command": "next"}
