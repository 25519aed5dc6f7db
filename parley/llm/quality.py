"""Quality rules by weak supervision.

Each rule votes that a text is good, that it is bad, or abstains. Nobody says
how far a rule can be trusted: expectation-maximisation estimates, from the
votes of all documents, how often each rule votes good on a good text and bad
on a bad one, and the share of good texts. A document is then judged by its
posterior probability of being good, not by passing every rule.

The documents are read once, for a few counts a row. The votes of a document
are one of at most 3^rules patterns, so only the number of documents of each
pattern reaches the driver; the posterior is a sum of logarithms a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SPACES, id_in, id_out, text_or_empty, written

SYMBOLS = "#*$%&|<>"
#: A repeat is a window of this many words that the text has twice.
WINDOW = 5
#: Frequent function words of the languages that are judged.
FUNCTION_WORDS = frozenset("""the of and to in is that it was for on are with as be at by this
    der die das und in zu den mit von ist des im für auf ein eine nicht sich
    le la les de des et un une est que qui dans en pour pas sur du au
    el los las de y un una es que en por con para del se no al""".encode().split())
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_function",
            "n_top_word", "n_ends", "n_letters", "n_capitals", "n_letter_words")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else
    abstains; both are SQL conditions on MEASURES."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars between 3 * n_words and 10 * n_words",
         "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("function_words", "n_words >= 20 and 12 * n_function >= n_words", "n_words >= 50 and 50 * n_function < n_words"),
    Rule("top_word", "n_words >= 20 and 8 * n_top_word <= n_words", "n_words >= 20 and 4 * n_top_word > n_words"),
    Rule("sentences", "n_ends > 0 and n_words between 4 * n_ends and 60 * n_ends",
         "n_words >= 60 and (n_ends = 0 or n_words < 2 * n_ends)"),
    Rule("capitals", "n_letters > 0 and 6 * n_capitals <= n_letters", "n_letters >= 20 and 5 * n_capitals > 2 * n_letters"),
    Rule("letters", "20 * n_letter_words >= 19 * n_words", "n_words >= 20 and 5 * n_letter_words < 4 * n_words"),
    Rule("lines", "n_lines >= 2 and 20 * n_dup_lines <= n_lines", "n_lines >= 4 and 5 * n_dup_lines > 2 * n_lines"),
    Rule("repeats", "n_words >= 20 and 50 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES.encode())] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def repeated_words(ids: np.ndarray, kinds: int, window: int = WINDOW) -> int:
    """How many words lie in a window that is found twice or more. ``ids`` are
    the numbers of the words, below ``kinds``; windows are told apart exactly."""
    if len(ids) <= window:
        return 0
    codes, many = ids[:len(ids) - window + 1], kinds
    for k in range(1, window):
        codes = codes * kinds + ids[k:len(ids) - window + 1 + k]
        many *= kinds
        if many * kinds >= 1 << 62:  # rank what there is, so that the next step fits
            codes = np.unique(codes, return_inverse=True)[1]
            many = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, at, 1)
    np.add.at(twice, at + window, -1)
    return int((np.cumsum(twice) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of a text. Letters and capitals are those of A-Z; a word with a
    character beyond ASCII has a letter."""
    data = text.encode()
    words = data.split()  # of bytes: at space and tab to carriage return
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    if not words:
        return (0, 0, n_symbols, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    counts = np.bincount(ids)
    raw = np.frombuffer(data, dtype=np.uint8)
    space, letter = _SPACE[raw], _LETTER[raw]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    before = np.concatenate([[0], np.cumsum(letter | (raw >= 128))])
    return (len(words), len(text) - sum(text.count(c) for c in SPACES), n_symbols, len(lines),
            len(lines) - len(set(lines)), repeated_words(ids, len(known)),
            int(sum(counts[i] for w, i in known.items() if w.lower() in FUNCTION_WORDS)), int(counts.max()),
            int(_END[raw[last]].sum()), int(letter.sum()), int(_CAPITAL[raw].sum()),
            int((before[last + 1] > before[start]).sum()))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and MEASURES of each row."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = pd.DataFrame([measure(t) for t in pdf["text"]], columns=list(MEASURES))
            got.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield got

    return docs.select(id_in(), text_or_empty().alias("text")) \
        .mapInPandas(batches, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def vote(rule: Rule) -> Column:
    """1 good, 0 bad, -1 for an abstention."""
    return F.when(F.expr(rule.bad), 0).when(F.expr(rule.good), 1).otherwise(-1)


@dataclass(frozen=True)
class Trust:
    """What expectation-maximisation says of the rules: the share of good texts,
    and of each rule how often, where it votes, it votes good on good texts
    (``on_good``) and bad on bad ones (``on_bad``)."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Of each row of votes, the logarithm of good against bad."""
        a, b = np.array(self.on_good), np.array(self.on_bad)
        says_good, says_bad = np.log(a / (1 - b)), np.log((1 - a) / b)
        return math.log(self.good / (1 - self.good)) + \
            ((votes == 1) * says_good + (votes == 0) * says_bad).sum(axis=1)

    @property
    def says(self) -> list[tuple[float, float]]:
        """What a good and a bad vote of each rule adds to the log odds."""
        return [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in zip(self.on_good, self.on_bad, strict=True)]


#: Where the estimate starts, and what is believed before any vote is seen:
#: most texts are good, rules are seldom wrong about good texts, and a bad text
#: is found by some of them. It counts as much as so many votes.
START = (0.9, 0.98, 0.5)
PRIOR_VOTES = 20.0


def estimate(votes: np.ndarray, counts: np.ndarray, still: float = 1e-9, rounds: int = 10_000) -> Trust:
    """Expectation-maximisation over vote patterns (rows of 1, 0 and -1) and how
    many documents have each. Abstentions say nothing. Rounds go on until no
    estimate moves by ``still``; a rule has no estimate of 0 or 1 because of
    the votes believed beforehand. Raises if ``rounds`` don't settle it."""
    m = votes.shape[1]
    good, a, b = START[0], np.full(m, START[1]), np.full(m, START[2])
    good0, bad0 = counts @ (votes == 1), counts @ (votes == 0)
    for _ in range(rounds):
        trust = Trust(good, tuple(a), tuple(b))
        p = counts / (1 + np.exp(-np.clip(trust.log_odds(votes), -700, 700)))  # good documents of each pattern
        ones, zeros = p @ (votes == 1), p @ (votes == 0)
        new_good = (p.sum() + START[0] * PRIOR_VOTES) / (counts.sum() + PRIOR_VOTES)
        new_a = (ones + START[1] * PRIOR_VOTES) / (ones + zeros + PRIOR_VOTES)
        new_b = (bad0 - zeros + START[2] * PRIOR_VOTES) / (good0 + bad0 - ones - zeros + PRIOR_VOTES)
        # A rule that is right less often than it is wrong would vote against itself.
        new_b = np.maximum(new_b, 1 - new_a)
        moved = max(abs(new_good - good), np.abs(new_a - a).max(), np.abs(new_b - b).max())
        good, a, b = float(new_good), new_a, new_b
        if moved < still:
            return Trust(good, tuple(map(float, a)), tuple(map(float, b)))
    raise RuntimeError(f"the rules' estimates still move after {rounds} rounds")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, Trust]:
    """``doc_id, MEASURES, quality, v0, v1, ...`` of each row, and the trust in
    the rules: ``quality`` is the posterior probability that the text is good,
    ``v<i>`` the vote of rule i.

    Null text is empty; a text without words gets no good votes but those of
    rules that its zeros satisfy, and any verdict on it is the caller's. Every
    row gives a row and counts once: null and repeated ids stay as they are.
    Other columns are not read. An empty table gives none, and the trust
    believed beforehand. The counts (no texts) are written once to the shared
    folder; at most 3^rules pattern counts reach the driver.
    """
    names = [f"v{i}" for i in range(len(rules))]
    table = written(measured(docs).select("*", *[vote(r).alias(n) for n, r in zip(names, rules, strict=True)]), "quality")
    patterns = table.groupBy(*names).count().toPandas().sort_values(names)
    trust = estimate(patterns[names].to_numpy().reshape(-1, len(names)), patterns["count"].to_numpy(dtype=float))
    odds = F.lit(math.log(trust.good / (1 - trust.good)))
    for n, (yes, no) in zip(names, trust.says, strict=True):
        odds = odds + F.when(F.col(n) == 1, F.lit(yes)).when(F.col(n) == 0, F.lit(no)).otherwise(F.lit(0.0))
    return id_out(table.withColumn("quality", 1 / (1 + F.exp(-odds)))), trust


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``quality`` and ``kept`` of each
    row; see ``judge`` for odd rows. Texts of under 10 words, or with over 20%
    of their words in repeated windows, fail whatever the rules say; the others
    are kept if their posterior is ``least`` or more."""
    table, _ = judge(docs, rules)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return table.select("doc_id", *MEASURES, failed.alias("base_failed"), "quality",
                        (~failed & (F.col("quality") >= least)).alias("kept"))
