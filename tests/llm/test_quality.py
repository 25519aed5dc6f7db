"""Quality rules: counts against plain loops, estimates against votes whose
truth is known, verdicts against labels that the rules never see."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import queries as Q
from parley.llm.quality import MEASURES, RULES, Rule, START, estimate, judge, measure, quality_filter, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "a a a a a a", "a b c d e x a b c d e", "a b c d e\na b c d e\n\n\n a b",
                                  "x y   z # | é\x1cw", "a b c d e f a b c d e f a b c d", "É! <b> ¿qué? 日本 語."])
def test_counts(text):
    got = dict(zip(MEASURES, measure(text), strict=True))
    assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(text)


def test_repeats_are_exact_also_where_codes_are_ranked():
    rng = np.random.default_rng(1)
    for kinds in (2, 5, 1 << 20):
        ids = rng.integers(0, min(kinds, 4), 300) * max(1, kinds // 4)
        w = [tuple(ids[i:i + 5]) for i in range(296)]
        assert repeated_words(ids, kinds) == len({i + k for i, x in enumerate(w) if w.count(x) > 1 for k in range(5)})


def test_estimates_find_the_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(60_000) < 0.8
    on_good, on_bad, silent = [0.95, 0.99, 0.9, 0.97], [0.6, 0.3, 0.8, 0.5], [0.0, 0.3, 0.5, 0.1]
    votes = np.stack([np.where(rng.random(len(truth)) < s, -1, np.where(truth, rng.random(len(truth)) < a, rng.random(len(truth)) >= b))
                      for a, b, s in zip(on_good, on_bad, silent, strict=True)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    trust = estimate(patterns, counts.astype(float))
    assert trust.good == pytest.approx(0.8, abs=0.03)
    assert trust.on_good == pytest.approx(on_good, abs=0.03) and trust.on_bad == pytest.approx(on_bad, abs=0.06)
    assert ((trust.log_odds(votes) > 0) == truth).mean() > 0.9


def test_posterior_by_hand_and_only_abstentions(spark):
    one = [Rule("never", "false", "false"), Rule("long", "n_words > 3", "n_words = 1")]
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, "a")], "doc_id long, text string")
    table, trust = judge(docs, one)
    got = {r["doc_id"]: r for r in table.collect()}
    good, a, b = trust.good, trust.on_good[1], trust.on_bad[1]
    assert (trust.on_good[0], trust.on_bad[0]) == pytest.approx(START[1:])
    assert got[2]["quality"] == pytest.approx(good) and got[2]["v1"] == -1
    assert got[1]["quality"] == pytest.approx(good * a / (good * a + (1 - good) * (1 - b)))
    assert got[3]["quality"] == pytest.approx(good * (1 - a) / (good * (1 - a) + (1 - good) * b))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = quality_filter(odd_docs).collect()
    want = sorted(((d is None, d or 0), *brute(t)) for d, t, _ in odd_rows if len(t or "") < 20_000)
    long = {d for d, t, _ in odd_rows if len(t or "") >= 20_000}
    assert len(got) == len(odd_rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["word_chars"], r["n_symbols"],
                   r["n_dup_lines"], r["n_repeat_words"]) for r in got if r["doc_id"] not in long) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    assert quality_filter(no_docs).collect() == [] and judge(no_docs)[1].good == pytest.approx(START[0])


def test_verdicts_agree_with_labels_never_seen(spark, sf_dir):
    sf = sf_dir.replace("sf0.01", "sf0.1")
    got = Q.QUERIES["op11_quality"](spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label")), "doc_id") \
        .where("not base_failed").toPandas()
    assert got["kept"][got["label"] == 1].mean() > 0.99 and got["kept"][got["label"] == 0].mean() < 0.05




def test_rules_have_names_of_their_own():
    assert len({r.name for r in RULES}) == len(RULES)
