"""Errors and explanations that arrive as two streams."""
import uuid

from pyspark.sql import functions as F

from parley.session import scratch_path
from parley.streaming.enrich import stream_error_enrich

RECORDS = "id long, session_id string, ts timestamp, level string, message string"
EXPLAINED = "session_id string, ts timestamp, completion string, code string"


def _at(df):
    return df.withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(m * 60 as decimal(18, 6)))")).drop("m")


class Streams:
    """Two folders that grow, and the running query over them."""

    def __init__(self, spark, **kw):
        self.spark, self.rec, self.exp = spark, scratch_path(spark, "rec"), scratch_path(spark, "exp")
        self.out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
        self.add([], [])
        self.query = (stream_error_enrich(spark.readStream.schema(RECORDS).parquet(self.rec),
                                          spark.readStream.schema(EXPLAINED).parquet(self.exp), **kw)
                      .writeStream.format("parquet").option("path", self.out).option("checkpointLocation", ckpt).start())

    def add(self, records, explanations):
        """Rows (id, session, minute, level, message) and (session, minute, completion, code)."""
        s = self.spark
        for rows, schema, path, cols in (
                (records, "id long, session_id string, m double, level string, message string", self.rec, RECORDS),
                (explanations, "session_id string, m double, completion string, code string", self.exp, EXPLAINED)):
            names = [c.split()[0] for c in cols.split(", ")]
            m = schema.split(", ").index("m double")
            rows = [(*r[:m], None if r[m] is None else float(r[m]), *r[m + 1:]) for r in rows]
            _at(s.createDataFrame(rows, schema)).select(*names).coalesce(1).write.mode("append").parquet(path)

    def told(self):
        self.query.processAllAvailable()
        return sorted((r.id, r.message) for r in self.spark.read.schema(RECORDS).parquet(self.out).collect())


def test_in_time_out_of_time_and_unmatched(spark):
    s = Streams(spark, before_s=600, after_s=300, delay_s=600)
    try:
        s.add([(1, "a", 100, "ERROR", "boom"), (2, "a", 100, "INFO", "note"), (3, "b", 100, "ERROR", "alone")],
              [("a", 95, "old", "x()"), ("b", 120, "too far after", "")])
        assert s.told() == [(2, "note")]  # errors wait for explanations in time
        # Before the watermark (100 - 10 minutes) passes: a late one counts.
        s.add([], [("a", 104, "newer", ""), ("a", 111, "beyond after_s", "")])
        assert s.told() == [(2, "note")]
        # Both watermarks pass 105 minutes: told once, with what came in time.
        s.add([(9, "z", 130, "INFO", "tick")], [("z", 130, "tick", "")])
        want = [(1, "boom\n\nnewer\n\nx()"), (2, "note"), (3, "alone"), (9, "tick")]
        assert s.told() == want
        # An explanation behind the watermark changes nothing and tells nothing twice.
        s.add([(10, "z", 131, "INFO", "tock")], [("b", 101, "too late", ""), ("z", 131, "tock", "")])
        assert s.told() == want[:3] + [(9, "tick"), (10, "tock")]
        # An error in time after that has its own explanation.
        s.add([(11, "b", 128, "ERROR", "again")], [("b", 127, "in time", "")])
        s.add([(12, "z", 190, "INFO", "end")], [("z", 190, "end", "")])
        assert [r for r in s.told() if r[0] > 10] == [(11, "again\n\nin time"), (12, "end")]
    finally:
        s.query.stop()


def test_rows_without_time_or_session_and_empty_explanations(spark):
    s = Streams(spark, before_s=600, after_s=300, delay_s=60)
    try:
        s.add([(1, None, 10, "ERROR", "no session"), (2, "a", None, "ERROR", "no time"), (3, "a", 10, None, "no level"),
               (4, "a", 10, "ERROR", None), (5, "a", 10, "ERROR", "e"), (6, "c", 10, "ERROR", "only code")],
              [("a", 9, "", ""), ("a", 9.5, None, None), (None, 10, "x", "y"), ("a", None, "x", "y"), ("a", 8, "why", ""),
               ("c", 10, "", "z()")])
        assert s.told() == [(1, "no session"), (2, "no time"), (3, "no level")]
        s.add([(9, "z", 60, "INFO", "end")], [("z", 60, "end", "")])
        assert [r for r in s.told() if 3 < r[0] < 9] == [(4, "why"), (5, "e\n\nwhy"), (6, "only code")]
    finally:
        s.query.stop()


def test_state_is_split_by_time_and_dropped(spark):
    """One session holds all rows: state lies in several partitions, and what
    the watermarks have passed is gone."""
    s = Streams(spark, before_s=60, after_s=60, delay_s=120)
    try:
        for i in range(3):
            s.add([(1000 * i + k, "hot", 60 * i + k / 10, "ERROR", f"m{k}") for k in range(500)],
                  [("hot", 60 * i + k / 2, f"c{i}-{k}", "") for k in range(100)])
            s.query.processAllAvailable()
        s.add([(9999, "hot", 600, "INFO", "end")], [("hot", 600, "end", "")])
        got = s.told()
        assert len(got) == 1501 and len({i for i, _ in got}) == 1501
        for i in range(3):
            for k in range(500):
                # Halves of minutes within one minute around k / 10, the newest.
                newest = min(99, int((k / 10 + 1) / 0.5))
                fits = newest / 2 >= k / 10 - 1
                assert (1000 * i + k, f"m{k}" + (f"\n\nc{i}-{newest}" if fits else "")) in got
        state = s.query.lastProgress["stateOperators"]
        assert sum(o["numRowsTotal"] for o in state) <= 4
    finally:
        s.query.stop()


def test_all_rows_move_the_watermarks(spark):
    """Records of no error level, and explanations without text, count too."""
    s = Streams(spark, before_s=600, after_s=300, delay_s=60)
    try:
        s.add([(1, "a", 10, "ERROR", "e")], [("a", 9, "why", "")])
        s.add([(2, "a", 60, "INFO", "end")], [("z", 60, "", "")])
        assert s.told() == [(1, "e\n\nwhy"), (2, "end")]
        s.add([(3, "b", 70, "ERROR", "f")], [("a", 71, "", None)])
        s.add([(4, "b", 90, "ERROR", "g")], [("a", 91, "", None)])
        assert s.told() == [(1, "e\n\nwhy"), (2, "end"), (3, "f")]  # only errors and empty explanations since
    finally:
        s.query.stop()
