"""Model calls on a stream: nothing is paid for twice, whatever dies when."""
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import SparkSession

from parley.operators.completions import RowErrors
from parley.session import scratch_path
from parley.streaming import requests as R

SCHEMA = "id long, prompt string"


def paid_model(folder, kill_on=None, fail_on=()):
    """A model that notes each prompt it is sent in a file of its own."""
    def model(prompts: pd.Series):
        if kill_on is not None and kill_on in set(prompts):
            raise SystemExit(1)  # the worker dies before it answers
        out = []
        for p in prompts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(repr(p))
            out.append(ValueError("no") if p in fail_on else f"{p}!")
        if any(isinstance(x, ValueError) for x in out):
            raise RowErrors(out)
        return out
    return model


def calls(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


@pytest.fixture
def place(spark, tmp_path):
    """Folders of a stream, and functions to add rows and to run it to the end."""
    class Place:
        src, journal, out, ckpt = (scratch_path(spark, n) for n in ("src", "journal", "out", "ckpt"))
        paid = str(tmp_path)

        def add(self, *rows):
            spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(self.src)

        def run(self, model, slice_rows=5):
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.src)
            q = R.stream_batch_complete(stream, journal_path=self.journal, out=self.out, checkpoint=self.ckpt,
                                        model=model, slice_rows=slice_rows)
            try:
                q.processAllAvailable()
            finally:
                q.stop()

        def told(self):
            return sorted((r.id, r.completion, r.error) for r in spark.read.parquet(self.out).collect())
    return Place()


def test_equal_prompts_are_sent_once(place):
    model = paid_model(place.paid)
    place.add(*[(i, f"p{i % 7}") for i in range(50)], (50, ""), (51, None))
    place.add(*[(i, f"p{i % 9}") for i in range(60, 80)])
    place.run(model)
    assert place.told() == sorted([(i, f"p{i % 7}!", None) for i in range(50)] + [(50, "!", None), (51, "None!", None)]
                                  + [(i, f"p{i % 9}!", None) for i in range(60, 80)])
    assert calls(place.paid) == sorted([repr(f"p{i}") for i in range(9)] + ["''", "None"])


def test_a_batch_killed_between_calls_goes_on(place):
    """The worker dies on one prompt: other slices' answers are kept, and the
    replayed batch sends only what has no answer."""
    place.add(*[(i, f"p{i}") for i in range(40)])
    with pytest.raises(Exception):  # noqa: B017 - the query dies with its worker
        place.run(paid_model(place.paid, kill_on="p17"))
    before = calls(place.paid)
    kept = {r.digest for r in R.journal(SparkSession.active(), place.journal).collect()}
    place.run(paid_model(place.paid))
    after = calls(place.paid)
    assert place.told() == [(i, f"p{i}!", None) for i in range(40)]
    again = len(after) - 40  # sent twice: at most the slice that died
    assert 0 <= again <= len(before) - len(kept) <= 10 and len(kept) + again == len(before)


def test_a_batch_killed_after_its_calls_pays_nothing_again(place, monkeypatch):
    place.add(*[(i, f"p{i}") for i in range(40)])
    model, real = paid_model(place.paid), R.answers

    def dies(attempts):
        raise RuntimeError("killed before the result is written")

    monkeypatch.setattr(R, "answers", dies)
    with pytest.raises(Exception, match="killed before"):
        place.run(model)
    assert len(calls(place.paid)) == 40
    monkeypatch.setattr(R, "answers", real)
    place.run(model)
    assert len(calls(place.paid)) == 40 and place.told() == [(i, f"p{i}!", None) for i in range(40)]


def test_failed_prompts_are_told_and_sent_again(place):
    place.add((1, "a"), (2, "b"))
    place.run(paid_model(place.paid, fail_on=["b"]))
    assert place.told() == [(1, "a!", None), (2, None, "ValueError: no")]
    place.add((3, "a"), (4, "b"))
    place.run(paid_model(place.paid))
    assert place.told() == [(1, "a!", None), (2, None, "ValueError: no"), (3, "a!", None), (4, "b!", None)]
    assert calls(place.paid) == ["'a'", "'b'", "'b'"]


