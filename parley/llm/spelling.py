"""Spelling variants: words one edit apart, by an index of variable-length grams.

1. The gram dictionary. Grams of SHORTEST characters that more than ``most``
   places of the vocabulary have are cut longer, a character at a time up to
   LONGEST; grams that are rare enough are pruned there. So each place of a
   word has one gram: its shortest beginning that is rare, else the longest.
2. Decomposition. A word, with marks before and after it, is the grams of all
   its places. A gram depends on its own characters only, so an edit affects
   those it lies in: ``affected`` counts, for each word, the most that one edit
   can reach.
3. Merging. Words one edit apart share all grams that the edit leaves alone, at
   the same place or one further. With the same order of grams for all words
   (rare first), the first ``affected + 1`` grams of both words hold one of
   these, so only those are in the lists, and lists meet by gram, place and
   length.
4. Each meeting is verified with the edit distance, inside the join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import text_or_empty, written

#: Gram lengths, and marks put before and after a word. With two marks on each
#: side a word of MIN_CHARS has MIN_CHARS + 2 grams, more than one edit reaches.
SHORTEST, LONGEST, MARKS = 3, 6, 2
MIN_CHARS = 7
#: A gram that more places have is cut longer; that many rise with the vocabulary
#: so that the dictionary, which every task gets, never has over MAX_GRAMS grams.
MOST_PLACES = 64
MAX_GRAMS = 500_000
#: One in so many (document, run) pairs, by hash, is misspelled.
DROP_MOD = 31
#: A task hands on its counts when it holds so many words or characters.
HELD_WORDS, HELD_CHARS = 300_000, 16_000_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str) -> list[str]:
    """Maximal runs of letters, A-Z in lower case, other letters as they are."""
    return _RUN.findall(text.encode().lower().decode())  # of bytes: A-Z only


def dropped(doc: str, run: str) -> str:
    """The run without one code point if the hash of ``doc:run`` says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % DROP_MOD:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = 2) -> DataFrame:
    """``word, n``: the runs of all texts, some misspelled by hash, that are long
    and frequent enough. Null text has no runs; a null doc_id is the text
    ``null``; repeated rows count again. A task counts before it shuffles."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        size = 0
        for pdf in frames:
            for doc, text in zip(pdf["doc"], pdf["text"], strict=True):
                own: dict[str, int] = {}
                for run in runs(text):
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    if len(run) < min_chars:
                        continue
                    word = dropped(doc, run)
                    if len(word) >= min_chars:
                        if word not in held:
                            size += len(word)
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS or size > HELD_CHARS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held, size = {}, 0
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": object, "n": "int64"})

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc")
    return docs.select(doc, text_or_empty().alias("text")).mapInPandas(batches, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


@dataclass(frozen=True)
class Grams:
    """The dictionary: the frequent grams of each length, in order, and how many
    places have each. A gram is the number that its Latin-1 bytes make."""

    most: int
    grams: tuple[np.ndarray, ...] = ()
    counts: tuple[np.ndarray, ...] = ()

    def places_of(self, level: int, codes: np.ndarray) -> np.ndarray:
        """How many places have each gram of SHORTEST + level bytes, 0 if it is rare."""
        known = self.grams[level]
        at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
        return np.where(known[at] == codes, self.counts[level][at], 0) if len(known) else np.zeros(len(codes), dtype=np.int64)


@dataclass
class Marked:
    """A batch of words with their marks: ``text`` has all bytes, ``sizes`` the
    marked words' lengths; ``start``, ``word`` and ``p`` say of each place where
    it is in ``text``, in which word, and where in that."""

    text: np.ndarray
    sizes: np.ndarray
    start: np.ndarray
    word: np.ndarray
    p: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Marked:
        marked = [b"\x01" * MARKS + w.encode("latin-1") + b"\x02" * MARKS for w in words]
        sizes = np.array([len(m) for m in marked], dtype=np.int64)
        n = np.maximum(0, sizes - SHORTEST + 1)
        word = np.repeat(np.arange(len(words)), n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.int64)
        return Marked(text, sizes, p + np.repeat(np.cumsum(sizes) - sizes, n), word, p)

    def codes(self, at: np.ndarray, length: int) -> np.ndarray:
        code = np.zeros(len(at), dtype=np.int64)
        for k in range(length):
            code = (code << 8) | self.text[self.start[at] + k]
        return code

    def longer(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the places ``at``, those whose word goes on after ``length`` bytes."""
        return at[self.p[at] + length < self.sizes[self.word[at]]]


def decomposed(batch: Marked, known: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place its gram, the gram's length, how many places have it (0: it
    is rare), and which places go on to the next level of the dictionary."""
    n = len(batch.p)
    gram, length, places = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    at = np.arange(n)
    for level in range(len(known.grams)):
        gram[at] = batch.codes(at, SHORTEST + level)
        length[at] = SHORTEST + level
        places[at] = known.places_of(level, gram[at])
        at = batch.longer(at[places[at] > 0], SHORTEST + level)
    return gram, length, places, at


def dictionary(words: DataFrame, most: int = MOST_PLACES, max_grams: int = MAX_GRAMS) -> Grams:
    """The gram dictionary, grown level by level: only what continues a frequent
    gram is counted. A gram is frequent if more than ``most`` places have it, or
    more than keeps the whole dictionary within ``max_grams`` grams."""
    levels = LONGEST - SHORTEST + 1
    places = words.agg(F.sum(F.length("word") + 2 * MARKS - SHORTEST + 1)).first()[0] or 0
    known = Grams(max(most, -(-levels * places // max_grams)))
    for level in range(levels):
        def batches(frames: Iterator[pa.RecordBatch], level=level, known=known) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                batch = Marked.of(frame.column(0).to_pylist())
                gram, n = np.unique(batch.codes(decomposed(batch, known)[3], SHORTEST + level), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

        rows = words.select("word").mapInArrow(batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")) \
            .where(F.col("n") > known.most).toPandas().sort_values("gram")  # places / most at the most
        known = Grams(known.most, (*known.grams, rows["gram"].to_numpy(dtype=np.int64)),
                      (*known.counts, rows["n"].to_numpy(dtype=np.int64)))
    return known


def most_affected(batch: Marked, length: np.ndarray) -> np.ndarray:
    """Of each word the most grams that one edit lies in. Edits touch no marks."""
    first = np.cumsum(batch.sizes) - batch.sizes
    change = np.zeros(len(batch.text) + 1, dtype=np.int64)
    np.add.at(change, batch.start, 1)
    np.add.at(change, batch.start + length, -1)
    cover = np.cumsum(change)[:-1]
    place = np.arange(len(cover)) - np.repeat(first, batch.sizes)
    cover[(place < MARKS) | (place >= np.repeat(batch.sizes, batch.sizes) - MARKS)] = 0
    return np.maximum.reduceat(cover, first) if len(first) else first


def listed(words: DataFrame, known: Grams) -> DataFrame:
    """``id, word, p, size, gram``: the first ``affected + 1`` grams of each word,
    the rare ones first, then by how many places have them. Nothing is shuffled."""
    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            batch = Marked.of(frame.column(1).to_pylist())
            gram, length, places, _ = decomposed(batch, known)
            order = np.lexsort((batch.p, gram, places, batch.word))
            first = np.searchsorted(batch.word, np.arange(len(batch.sizes)))
            at = order[np.arange(len(order)) - first[batch.word] <= most_affected(batch, length)[batch.word]]
            word = pa.array(batch.word[at])
            yield pa.RecordBatch.from_arrays(
                [frame.column(0).take(word), frame.column(1).take(word), pa.array(batch.p[at], pa.int32()),
                 pa.array(batch.sizes[batch.word[at]], pa.int32()), pa.array(gram[at])], names=["id", "word", "p", "size", "gram"])

    return words.select("id", "word").mapInArrow(batches, "id long, word string, p int, size int, gram long")


def near_pairs(words: DataFrame, most: int = MOST_PLACES) -> DataFrame:
    """``a, b`` with a < b, once each: the ids of words (``id, word``; all of
    MIN_CHARS or more Latin-1 characters) that are one insertion, deletion or
    replacement apart. Lists are split by place and length, and AQE splits those
    still skewed; only verified pairs leave the join."""
    lists = written(listed(words, dictionary(words, most)), "gram-lists")
    key = lambda p, size: F.xxhash64("gram", p, size)  # noqa: E731  (equal hashes are told apart by the distance)
    p, size = F.col("p"), F.col("size")
    index = lists.select(key(p, size).alias("k"), F.col("id").alias("there"), F.col("word").alias("there_word"))
    probes = lists.select(F.col("id").alias("here"), F.col("word").alias("here_word"), F.explode(F.array(
        F.struct(key(p, size).alias("k"), F.lit(True).alias("same")),
        F.struct(key(p, size + 1).alias("k"), F.lit(False).alias("same")),
        F.struct(key(p + 1, size + 1).alias("k"), F.lit(False).alias("same")))).alias("x")).select("x.*", "here", "here_word")
    met = probes.join(index, (probes["k"] == index["k"]) & (~F.col("same") | (F.col("here") < F.col("there")))
                      & (F.levenshtein("here_word", "there_word", 1) == 1))
    return met.select(F.least("here", "there").alias("a"), F.greatest("here", "there").alias("b")).distinct()


def spelling_forms(vocab: DataFrame, factor: int = 10, most: int = MOST_PLACES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``vocab`` (``word,
    n``; words are distinct, of MIN_CHARS Latin-1 characters or more).

    ``n_near`` counts the words one edit apart; ``form`` is the one with the
    largest n (ties: the smallest in code-point order) if that is ``factor``
    times the word's own or more, else null, and ``form_n`` its n. ``root`` is
    where following the forms ends, the word itself if it has none; n grows by
    ``factor`` each step, so there are no cycles. An empty table gives none.
    """
    # Ids in the order in which a near word is preferred: the best is the least.
    words = written(vocab.select("word", "n").orderBy(F.desc("n"), "word")
                    .withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = near_pairs(words, most)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("x.*")
    near = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = written(words.join(near, "id", "left").join(best, "best", "left"), "near-words")
    large = F.col("form_n") >= factor * F.col("n")
    forms = near.where(large).select("id", F.col("best").alias("root_id"), F.col("form").alias("root"))
    # Each round follows twice as many forms.
    while True:
        forms = written(forms, "forms")
        on = forms.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"), F.col("root").alias("next"))
        step = forms.join(on, "root_id", "left")
        if not step.where(F.col("next_id").isNotNull()).limit(1).count():
            break
        forms = step.select("id", F.coalesce("next_id", "root_id").alias("root_id"), F.coalesce("next", "root").alias("root"))
    return near.join(forms.select("id", "root"), "id", "left").select(
        "word", F.when(large, F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("form_n")).alias("form_n"))
