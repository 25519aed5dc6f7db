"""BPE encoding and decoding in batched numpy merge rounds.

The words that a batch has and the worker has not met yet become one flat
array of symbols. Each round looks up all neighbouring pairs by binary search
over the sorted pair keys, takes every word's lowest rank, merges its pairs of
that rank, and drops the words that have none left. Encoded words are kept, so
a text costs one look-up a word.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from parley.llm.common import id_in, id_out, text_or_empty

#: Words kept by a worker; beyond that it starts anew.
KEPT_WORDS = 400_000

_NONE = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in kept else chr(256 + extra)
        extra += b not in kept
    return out


class WordBpe:
    """A BPE tokenizer file whose words end in a marker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # Merging all pairs of a word's lowest rank at once equals merging one
        # by one if no merge is older than one that makes its parts.
        newest = np.full(self.base, -1, dtype=np.int64)
        np.maximum.at(newest, made, np.arange(len(made)))
        self.ordered = bool((np.maximum(newest[left], newest[right]) < np.arange(len(made))).all())
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        self.tokens = {i: t for t, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in special.items()})
        self.id_bytes = {i: str(i).encode() for i in self.tokens}
        self.token_bytes = {i: t.encode() for i, t in self.tokens.items()}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # White space by the Unicode property, as the file's engine has it.
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.kept: dict[str, tuple[int, bytes, bytes, list[int]]] = {}

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by merge rounds over all words at once."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        last = np.cumsum(sizes) - 1
        sym = self.inner[data]
        sym[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while sym.size:
            same = word[:-1] == word[1:]
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = same & (self.keys[at] == key)
            rank = np.full(sym.size, _NONE)
            rank[:-1][found] = self.ranks[at[found]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, sym.size])
            low = np.repeat(lowest, lengths)
            active = low != _NONE
            if not active.all():
                done.append((word[~active], sym[~active]))
                if not active.any():
                    break
            hit = active & (rank == low)
            if not self.ordered:  # one merge a word and round: the leftmost
                spots = np.flatnonzero(hit)
                hit[spots[1:][word[spots[1:]] == word[spots[:-1]]]] = False
            else:  # of overlapping pairs (a a a) every other, from the left
                spots = np.flatnonzero(hit)
                fresh = np.r_[True, np.diff(spots) != 1]
                start = np.maximum.accumulate(np.where(fresh, np.arange(spots.size), 0))
                hit[spots[(np.arange(spots.size) - start) % 2 == 1]] = False
            spots = np.flatnonzero(hit)
            sym[spots] = self.made[at[spots]]
            active[spots + 1] = False
            sym, word = sym[active], word[active]
        all_words = np.concatenate([w for w, _ in done])
        all_ids = np.concatenate([s for _, s in done])
        order = np.argsort(all_words, kind="stable")
        cuts = np.cumsum(np.bincount(all_words, minlength=len(words)))[:-1]
        return [x.tolist() for x in np.split(all_ids[order], cuts)]

    def split(self, text: str) -> list[tuple[str, bool]]:
        """(piece, is it a special token); special tokens stand for themselves."""
        if self.split_special is None or "<" not in text:
            return [(text, False)]
        return [(p, p in self.special) for p in self.split_special.split(text) if p]

    def text_words(self, text: str) -> list[str]:
        """The words of a piece: NFC, lower-cased letter by letter."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.words.findall(text.replace("Σ", "σ").lower())

    def learn(self, words: set[str]) -> None:
        if len(self.kept) + len(words) > KEPT_WORDS:
            self.kept.clear()
        new = [w for w in words if w not in self.kept]
        for a in range(0, len(new), 50_000):
            part = new[a:a + 50_000]
            for w, ids in zip(part, self.encode_words(part), strict=True):
                self.kept[w] = (len(ids), b" ".join([self.id_bytes[i] for i in ids]),
                                b" ".join([self.token_bytes[i] for i in ids]), ids)

    def entries(self, text: str) -> list[tuple[int, bytes, bytes, list[int]]]:
        """The kept entry of each word and special token of a text, in order."""
        out: list[tuple[int, bytes, bytes, list[int]]] = []
        for piece, is_special in self.split(text):
            if is_special:
                i = self.special[piece]
                out.append((1, self.id_bytes[i], self.token_bytes[i], [i]))
                continue
            words = self.text_words(piece)
            for a in range(0, len(words), KEPT_WORDS // 2):  # a long text in parts, so that each is kept whole
                part = words[a:a + KEPT_WORDS // 2]
                missing = {w for w in set(part) if w not in self.kept}
                if missing:
                    self.learn(missing if len(self.kept) + len(missing) <= KEPT_WORDS else set(part))
                out += [self.kept[w] for w in part]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for e in self.entries(text) for i in e[3]]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: its tokens, joined by a space."""
        return " ".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, and with
    ``with_ids`` also ``ids`` and ``decoded`` themselves.

    Null text is the empty text: no tokens. Every row gives a row: null and
    repeated ids stay as they are. Other columns are not read. Row by row:
    nothing is shuffled, a batch's new words are encoded together, and a worker
    keeps a bounded number of words.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + \
        (", ids array<int>, decoded string" if with_ids else "")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in frames:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a:a + 500]
                bpe.learn({w for t in part["text"] for p, s in bpe.split(t) if not s for w in bpe.text_words(p)})
                n, ids_sha, text_sha, ids, texts = [], [], [], [], []
                for t in part["text"]:
                    e = bpe.entries(t)
                    n.append(sum([x[0] for x in e]))
                    ids_sha.append(hashlib.sha256(b" ".join([x[1] for x in e])).hexdigest())
                    decoded = b" ".join([x[2] for x in e])
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        ids.append([i for x in e for i in x[3]])
                        texts.append(decoded.decode())
                out = {"doc_id": part["doc_id"].to_numpy(), "n_tokens": n,
                       "ids_sha256": ids_sha, "decoded_sha256": text_sha}
                yield pd.DataFrame(out | ({"ids": ids, "decoded": texts} if with_ids else {}))

    return id_out(docs.select(id_in(), text_or_empty().alias("text")).mapInPandas(batches, schema))
