"""Token counts of a unigram tokenizer by a count-only Viterbi pass.

An Aho-Corasick automaton over the vocabulary lists, for each end position of
a word, the pieces that end there. The dynamic programme keeps, for each
position, the best score and the number of pieces of the path that has it:
no back-pointers, no pieces. Words start at a space mark, so texts are counted
word by word and a worker counts each of its words once.

Exact tie rules: scores add up from the left in double precision; of equal
scores the piece that starts first (the longest) stays; a character that is no
piece of its own is unknown at 10 below the lowest score; neighbouring unknown
characters are one run, counted as one piece if the run is in the vocabulary
and else as its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from parley.llm.common import id_in, id_out, text_or_empty

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept by a worker; beyond that it starts anew.
KEPT_WORDS = 1_000_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocab: list[tuple[str, float]], unk_id: int = 0):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            self.automaton.add_word(piece, (len(piece), score, i == unk_id))
        self.automaton.make_automaton()
        self.pieces = {p for p, _ in vocab}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.kept: dict[str, int] = {}

    def _run(self, text: str) -> int:
        return 1 if text in self.pieces or not self.bytes_known else len(text.encode())

    def word(self, text: str) -> int:
        """Number of pieces of the best path through a word."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(text):
            ends[end + 1].append(piece)  # the longest first
        # Up to each position: score, pieces before the open unknown run, and
        # where that run starts (-1: none is open).
        score, count, open_at = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            best, at, unknown, single = None, 0, False, False
            for size, s, is_unknown in ends[end]:
                single |= size == 1
                total = s + score[end - size]
                if best is None or total > best:
                    best, at, unknown = total, end - size, is_unknown
            if not single:
                total = self.unknown + score[end - 1]
                if best is None or total > best:
                    best, at, unknown = total, end - 1, True
            score[end] = best
            if unknown:
                open_at[end] = at if open_at[at] < 0 else open_at[at]
                count[end] = count[at]
            else:
                count[end] = count[at] + 1 + (self._run(text[open_at[at]:at]) if open_at[at] >= 0 else 0)
        return count[n] + (self._run(text[open_at[n]:]) if open_at[n] >= 0 else 0)

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        words = (marked if marked[0] == SPACE else SPACE + marked).split(SPACE)[1:]
        kept, total = self.kept, 0
        for w in words:
            n = kept.get(w)
            if n is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                n = kept[w] = self.word(SPACE + w)
            total += n
        return total


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens`` of each row.

    Null and empty text have 0 tokens. Every row gives a row: null and repeated
    ids stay as they are. Other columns are not read. Row by row; nothing is
    shuffled.
    """
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = load(path)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"],
                                "n_tokens": [counter.count(t) for t in pdf["text"]]})

    return id_out(docs.select(id_in(), text_or_empty().alias("text"))
                  .mapInPandas(batches, "doc_id long, n_tokens long"))
