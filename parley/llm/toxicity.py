"""Toxicity by a weighted finite-state pattern grammar.

A text is read as words, ends of clauses (``.``) and quotation marks (``"``).
Four weighted transducers (``parley/llm/transducers.py``) are composed:

* the lexicon reads a word letter by letter and writes its symbol: insult (I),
  threat (T), target (Y), negation (N), report (R) or nothing (-), with a
  weight. Insults are whole words or word beginnings learned from labelled
  texts, the rest are closed lists;
* the negation transducer writes insults and threats within ``NEGATION_REACH``
  words after a negation as negated (i);
* the report transducer writes those of a clause that holds a report word, and
  of a quotation that such a clause opens, as reported (J). It doesn't know yet
  whether a report word follows, so it guesses, and wrong guesses die;
* the matcher writes a clause's pattern at its end: insult, insult at a target,
  threat, threat at a target, negated, reported, or clean.

The last three are composed and made deterministic when this module is loaded;
the lexicon is composed with them as it goes, a word at a time. What is scored
are the matched clauses: how many there are of each pattern, and the weight of
the strongest path through each. Their weights are those of a logistic model.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import id_in, id_out, text_or_empty
from parley.llm.transducers import ANY, Transducer, compose, determinized

#: Labelled texts that the model is fitted on, at most: those whose ids have the
#: smallest hashes, in two folds.
MAX_LABELLED = 24_000
#: Entries of the learned lexicon, at most: those with the most evidence.
MAX_LEXICON = 20_000
#: A beginning of a word is read as one from this to that many letters.
STEM = (3, 7)
#: Characters of words whose symbols a task keeps, with 100 a word.
WORD_CACHE = 50_000_000
NEGATION_REACH = 3
#: An entry is this much (as a logarithm) more often in toxic texts than in
#: others, with this likelihood ratio (G) at least: chance gives it to one in
#: 3,000. Chosen by the two folds of the labelled rows that are learned from.
MIN_RATIO, MIN_EVIDENCE = 2.5, 13.0

TARGETS = frozenset("""you your yours yourself he him she her they them du dich dir dein ihr euch sie
    tu te toi ton vous votre il elle ils elles usted ustedes tú ti él ella ellos""".split())
THREATS = frozenset("""kill killed hurt destroy beat stab shoot burn die punch strangle töten umbringen
    schlagen verletzen sterben tuer frapper brûler crever matar golpear quemar morir""".split())
NEGATIONS = frozenset("""not no never neither nor isn aren don nicht kein keine nie niemals
    pas jamais aucun nunca jamás ningún ninguna""".split())
REPORTS = frozenset("""said says say told wrote quoted called claims claimed sagte sagt schrieb nannte
    dit disait écrit appelé dijo dice escribió llamó""".split())

_WORDS = re.compile(r"[^\W_]+|[.!?;\n\"“”„«»]")
_ENDS = frozenset(".!?;\n")
_QUOTES = frozenset("\"“”„«»")
PATTERNS = ("insult", "insult_target", "threat", "threat_target", "negated", "reported")
FEATURES = (*(f"{p}_clauses" for p in PATTERNS), "any", "strongest", "sum", "share")


def stems(word: str) -> list[str]:
    """What the lexicon may know a word by: itself, and its beginnings."""
    return [word, *(word[:k] + "*" for k in range(STEM[0], STEM[1] + 1) if len(word) > k)]


# ------------------------------------------------------------ transducers
END = " "  # after the letters of a word


def lexicon_transducer(entries: dict[str, float]) -> Transducer:
    """Letters and END to symbols. The states are the beginnings of entries
    and, for words that go on otherwise, one state a weight: a path remembers
    the strongest beginning that it has passed. A word that is an insult by
    any entry is one; its weight is that of its strongest."""
    listed = {w: k for k, words in (("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS)) for w in words}
    t = Transducer()
    beginnings = {w[:i] for e in (*entries, *listed) for w in (e.rstrip("*"),) for i in range(len(w) + 1)}
    node = lambda word: ("word", word) if word else t.start
    loose = lambda weight: ("other", weight)
    passed = {"": 0.0}
    for word in sorted(beginnings, key=len):
        if word:
            passed[word] = max(passed[word[:-1]], entries.get(word[:-1] + "*", 0.0))
            t.arc(node(word[:-1]), word[-1], "", 0.0, node(word))
        on = max(passed[word], entries.get(word + "*", 0.0))
        t.arc(node(word), ANY, "", 0.0, loose(on))
        insult = max(passed[word], entries.get(word, 0.0))
        kind = "I" if insult > 0 else listed.get(word, "-")
        if word:
            t.arc(node(word), END, kind, insult or float(kind == "T"), t.start)
    for weight in {0.0, *(w for e, w in entries.items() if e.endswith("*")), *passed.values()}:
        t.arc(loose(weight), ANY, "", 0.0, loose(weight))
        t.arc(loose(weight), END, "I" if weight > 0 else "-", weight, t.start)
    for mark in MARKS:
        t.arc(t.start, mark, mark, 0.0, t.start)
    t.final.add(t.start)
    return t


def negation_transducer(reach: int = NEGATION_REACH) -> Transducer:
    """The state is the number of words that the last negation still reaches."""
    t = Transducer()
    for left in range(reach + 1):
        on = max(0, left - 1)
        for x in "ITYR-":
            t.arc(left, x, "i" if left and x in "IT" else x, 0.0, on)
        t.arc(left, "N", "N", 0.0, reach)
        t.arc(left, ".", ".", 0.0, 0)
        t.arc(left, '"', '"', 0.0, left)
        t.final.add(left)
    return t


def report_transducer() -> Transducer:
    """The state is whether a quotation is open, and what the clause is: plain,
    a report, or to become a report (a guess that dies at the clause's end)."""
    t = Transducer(start=(False, "plain"))
    for quoted in (False, True):
        for mode in ("plain", "guess", "report"):
            here = (quoted, mode)
            for x in "ITiYN-":
                t.arc(here, x, "J" if mode != "plain" and x in "ITi" else x, 0.0, here)
            if mode != "plain":
                t.arc(here, "R", "R", 0.0, (quoted, "report"))
            t.arc(here, '"', '"', 0.0, (not quoted, mode))
            if mode == "report" and quoted:
                t.arc(here, ".", ".", 0.0, here)
            elif mode != "guess":
                for then in ("plain", "guess"):
                    t.arc(here, ".", ".", 0.0, (quoted, then))
        t.final |= {(quoted, "plain"), (quoted, "report")}
    t.also.add((False, "guess"))  # a text starts as a clause does
    return t


def matcher_transducer() -> Transducer:
    """The state is the strongest kind of the clause so far and whether it has
    a target; the pattern is written at the clause's end, nothing for a clause
    without words."""
    kinds = ("", "clean", "negated", "insult", "threat", "reported")
    raises = {"I": "insult", "T": "threat", "i": "negated", "J": "reported"}
    t = Transducer(start=("", False))
    for kind in kinds:
        for target in (False, True):
            for x in "ITiJYNR-":
                then = max(kind, raises.get(x, "clean"), key=kinds.index)
                t.arc((kind, target), x, "", 0.0, (then, target or x == "Y"))
            t.arc((kind, target), '"', "", 0.0, (kind, target))
            pattern = kind + "_target" if target and kind in ("insult", "threat") else kind
            t.arc((kind, target), ".", pattern, 0.0, t.start)
    t.final.add(t.start)
    return t


MARKS = '."'
#: Symbols to patterns: negation, report and matcher, composed.
CLAUSES = determinized(compose(compose(negation_transducer(), report_transducer()), matcher_transducer()))


def tokens(text: str) -> list[str]:
    """Words and marks of a text; a text ends its last clause."""
    return ["." if t in _ENDS else '"' if t in _QUOTES else t for t in _WORDS.findall(text.lower())] + ["."]


@dataclass
class Grammar:
    """The composed transducers: a lexicon and the model's weights."""

    lexicon: dict[str, float]
    weights: list[float] = field(default_factory=list)

    def __post_init__(self):
        self._words = determinized(lexicon_transducer(self.lexicon))
        self._kept: dict[str, tuple[str, float]] = {}
        self._forget()

    def _forget(self) -> None:
        self._kept.clear()
        self._kept.update({**dict.fromkeys(_ENDS, (".", 0.0)), **dict.fromkeys(_QUOTES, ('"', 0.0))})
        self._room = WORD_CACHE

    def __getstate__(self):
        return self.lexicon, self.weights

    def __setstate__(self, state):
        self.lexicon, self.weights = state
        self.__post_init__()

    def symbol(self, word: str) -> tuple[str, float]:
        """The symbol of a word and its weight, by a walk through the lexicon."""
        got = self._kept.get(word)
        if got is None:
            step, at = self._words.table, self._words.start
            for x in word:
                arc = step[at].get(x) or step[at][ANY]
                if arc[2] == at:  # from here on every letter loops
                    break
                at = arc[2]
            got = step[at][END][:2]
            self._room -= 100 + len(word)
            if self._room < 0:
                self._forget()
            self._kept[word] = got
        return got

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The pattern of each clause and the weight of its strongest symbol."""
        out, at, weight = [], CLAUSES.start, 0.0
        step, kept = CLAUSES.table, self._kept
        for token in chain(_WORDS.findall(text.lower()), "."):  # a text ends its last clause
            symbol, w = kept.get(token) or self.symbol(token)
            if w > weight:
                weight = w
            pattern, _, at = step[at][symbol]
            if pattern:
                out.append((pattern, weight))
                weight = 0.0
        return out

    def features(self, text: str) -> list[float]:
        """Clause patterns of a text; see FEATURES."""
        found = self.clauses(text)
        counts = Counter(p for p, _ in found)
        strong = sorted((w for p, w in found if p != "clean"), reverse=True)
        return [*(math.log1p(counts[p]) for p in PATTERNS), float(bool(strong)), strong[0] if strong else 0.0,
                math.log1p(sum(strong)), len(strong) / max(1, len(found))]

    def score(self, text: str) -> float:
        x = self.features(text)
        z = self.weights[-1] + sum(w * v for w, v in zip(self.weights, x, strict=False))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """``text, toxic, fold``: a bounded sample of the labelled texts, by hash of
    the id, in two folds."""
    kept = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic") \
        .withColumn("h", F.xxhash64(F.lit(7), "doc_id")).orderBy("h", "doc_id", "toxic").limit(bound)
    return kept.join(docs.select("doc_id", text_or_empty().alias("text")), "doc_id") \
        .select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("fold"))


def entry_counts(sample: DataFrame) -> DataFrame:
    """``entry``, and for each (fold, label) ``n<fold><label>``: the number of
    its texts that have the entry. The entry '' has the numbers of texts."""
    names = ["n00", "n01", "n10", "n11"]

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            tally: dict[str, list[int]] = {}
            for text, toxic, fold in zip(pdf["text"], pdf["toxic"], pdf["fold"], strict=True):
                for s in {"", *(s for w in set(_WORDS.findall(text.lower())) for s in stems(w))}:
                    tally.setdefault(s, [0, 0, 0, 0])[2 * fold + toxic] += 1
            yield pd.DataFrame(list(tally.values()), columns=names).assign(entry=list(tally))

    return sample.mapInPandas(entries, ", ".join(f"{n} long" for n in names) + ", entry string") \
        .groupBy("entry").agg(*[F.sum(n).alias(n) for n in names])


def lexicon(counts: DataFrame, folds: tuple[int, ...]) -> dict[str, float]:
    """Insults: words and word beginnings that toxic texts of these folds have
    far more often than others, with the logarithm of how much more often. What
    is enough doesn't depend on how many texts there are. At most MAX_LEXICON
    entries reach the driver."""
    of = lambda label: sum((F.col(f"n{f}{label}") for f in folds), F.lit(0))
    counts = counts.select("entry", of(0).alias("clean"), of(1).alias("toxic"))
    n = counts.where("entry = ''").first()
    if n is None or not n["clean"] or not n["toxic"]:
        return {}
    ratio = F.log((F.col("toxic") + 0.5) / (n["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (n["clean"] + 1))
    share = n["toxic"] / (n["toxic"] + n["clean"])
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("toxic") + F.col("clean")) * p))).otherwise(0.0)
    evidence = 2 * (part("toxic", share) + part("clean", 1 - share))
    rows = counts.where("entry <> ''").withColumn("ratio", ratio).where((F.col("ratio") > MIN_RATIO) & (evidence > MIN_EVIDENCE)) \
        .orderBy(F.desc(F.col("ratio") * F.col("toxic")), "entry").limit(MAX_LEXICON).collect()
    return {r["entry"]: float(r["ratio"]) for r in rows}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9),
                               x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Grammar:
    """The grammar fitted on a bounded sample of the labelled texts. ``labels``
    must hold only rows that may be learned from.

    The weights are fitted on clause features that each text gets from the
    lexicon of the other fold, so they don't trust entries that one text made;
    the final lexicon is that of both. Without labels, every score is 0.5.
    """
    sample = labelled_sample(docs, labels, bound).persist()
    counts = entry_counts(sample).persist()
    try:
        other = [Grammar(lexicon(counts, (1,))), Grammar(lexicon(counts, (0,)))]
        grammar = Grammar(lexicon(counts, (0, 1)))

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({"x": [other[f].features(t) for t, f in zip(pdf["text"], pdf["fold"], strict=True)],
                                    "y": pdf["toxic"].astype(float)})

        # Ten numbers a text, MAX_LABELLED texts at most.
        got = sample.mapInPandas(rows, "x array<double>, y double").toPandas()
    finally:
        counts.unpersist()
        sample.unpersist()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    grammar.weights = fit_weights(x, got["y"].to_numpy())
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id, score`` of each row, the score from 0 to 1.

    Null and empty text have no clauses and get the model's intercept. Every
    row gives a row: null and repeated ids stay as they are. Only the text
    enters a score. Row by row; nothing is shuffled. The grammar (a bounded
    lexicon) goes to the tasks with the function.
    """
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"],
                                "score": [grammar.score(t) for t in pdf["text"]]})

    return id_out(docs.select(id_in(), text_or_empty().alias("text"))
                  .mapInPandas(batches, "doc_id long, score double"))


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all their columns."""
    def batches(frames):
        import pyarrow as pa
        for batch in frames:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([grammar.score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
