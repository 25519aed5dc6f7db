"""Suffix-array dedup: bytes covered by a long string that starts earlier too.

Two equal strings of ``length`` bytes have the same smallest gram (by hash,
the leftmost of equals) at the same place. So every document is cut into
segments: runs of neighbouring string starts that share their smallest gram,
about one for each 35 bytes. Only segments with the same gram can share a
string; most grams are in one segment of the corpus, and their segments are
done.

1. Segments, as (gram hash, text hash, place), are shuffled by gram and read in
   sorted order in constant memory. Of segments with equal text only the first
   goes on; the others are covered whole (equal ones of one batch are merged
   before the shuffle, so copies of a document or passage, however many, are a
   few rows a batch). What goes on are the distinct segments of grams that have
   several: mostly those at the ends of repeated passages, where the passage
   is followed by different text.
2. Their texts are fetched and dealt to shards by gram. Each shard is a bounded
   text: its suffix array is built by induced sorting, its permuted common
   prefixes are computed, and in each run of suffixes that share ``length``
   bytes all strings but the first in the corpus are marked.
3. A gram with more text than a shard holds is not dealt to one: its segments
   are split into their strings, each of them a segment of its own, and step 1
   handles those.

The marks of a document are united, and its kept bytes cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.ann import release
from parley.llm.common import id_in, id_out, text_or_empty, written
from parley.llm.suffix_array import permuted_common_prefixes, suffix_array

GRAM = 32  # five doublings of one byte's hash
#: Bytes hashed at once; places in them take PLACE bits of a key.
CHUNK, PLACE = 1 << 19, 20
#: Bytes of a shard's text: a suffix array takes about a hundred times that.
SHARD = 1 << 20

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd
_SEGMENT = "h long, s long, doc long, th long, at long"


@lru_cache(maxsize=1)
def _tables():
    rng = np.random.default_rng(20)
    byte1 = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    byte2 = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    n = CHUNK + 1024
    power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _B2, dtype=np.uint64)], dtype=np.uint64)
    inverse = np.uint64(pow(_B2, -1, 1 << 64))
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, dtype=np.uint64)], dtype=np.uint64)
    return byte1, byte2, power, back


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def cut(buf: np.ndarray, ends: np.ndarray, length: int):
    """Segments of some concatenated texts: (gram hash, text hash, first byte,
    number of strings). No string crosses an end."""
    byte1, byte2, power, back = _tables()
    n = len(buf)
    h, b, span = byte1[buf], _B1, 1
    while span < GRAM:
        h = h[:-span] * np.uint64(b) + h[span:]
        b, span = b * b % (1 << 64), span * 2
    h = _mix(h)
    low = np.uint64((1 << PLACE) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    # m[i]: smallest gram of the string that starts at i.
    valid = np.ones(len(m), dtype=bool)
    for e in ends.tolist():
        valid[max(0, e - length + 1):e] = False
    at = np.flatnonzero(valid)
    if not at.size:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    key = m[at]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (np.diff(at) != 1)])
    first = at[new]
    count = np.diff(np.r_[new, at.size])
    gram = h[(key[new] & low).astype(np.int64)]
    prefix = np.r_[np.uint64(0), np.cumsum(byte2[buf] * power[:n], dtype=np.uint64)]
    last = first + count - 1 + length
    text = (prefix[last] - prefix[first]) * back[first]
    return gram, _mix(text + count.astype(np.uint64)), first, count


def _at(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start << 16) | count


def _merge(h, s, doc, th, at):
    """Of equal segments the first stays; the others are marked covered (their
    ``at`` is negative and their ``h`` spreads them)."""
    o = np.lexsort((at, th, doc, s, h))
    h, s, doc, th, at = h[o], s[o], doc[o], th[o], at[o]
    same = np.r_[False, (h[1:] == h[:-1]) & (s[1:] == s[:-1])] if h.size else np.zeros(0, bool)
    h = h.copy()
    h[same] = _mix((th[same] + at[same]).view(np.uint64)).view(np.int64)
    return pd.DataFrame({"h": h, "s": s, "doc": doc, "th": th, "at": np.where(same, ~at, at)})


def segments(length: int):
    """Rows (doc, th, text as bytes) to rows of segments."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.drop_duplicates(["doc", "th"])
            doc, th = pdf["doc"].to_numpy(), pdf["th"].to_numpy()
            texts = pdf["text"].tolist()
            parts, pending, size = [], [], 0  # pending: (row, offset in its text, piece)

            def flush():
                buf = np.frombuffer(b"".join(p for _, _, p in pending), dtype=np.uint8)
                lens = np.array([len(p) for _, _, p in pending])
                ends = np.cumsum(lens)
                gram, text, first, count = cut(buf, ends, length)
                piece = np.searchsorted(ends, first, "right")
                row = np.array([r for r, _, _ in pending])[piece]
                offset = np.array([o for _, o, _ in pending])[piece]
                start = first - (ends - lens)[piece] + offset
                parts.append((gram.view(np.int64), text.view(np.int64), doc[row], th[row], _at(start, count)))

            for row, t in enumerate(texts):
                if len(t) < length:
                    continue
                for a in range(0, len(t) - length + 1, CHUNK // 2):  # a long text in pieces that overlap
                    p = t[a:a + CHUNK // 2 + length - 1]
                    if size + len(p) > CHUNK:
                        flush()
                        pending, size = [], 0
                    pending.append((row, a, p))
                    size += len(p)
            if pending:
                flush()
            if parts:
                yield _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return batches


def _pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over segments sorted by (h, s, doc, th, at): covered ones (``~at``), and
    the first of each text, if its gram has several texts. Constant memory: the
    last row of a batch and whether its gram's first text went out."""
    tail = None  # (h, s, doc, th, at, out): the first row of the open text
    for pdf in frames:
        if not len(pdf):
            continue
        h, s, doc, th, at = (pdf[c].to_numpy() for c in ("h", "s", "doc", "th", "at"))
        done = at < 0
        passed = pdf[done]
        h, s, doc, th, at = (x[~done] for x in (h, s, doc, th, at))
        if not h.size:
            yield passed
            continue
        if tail is not None:
            h, s, doc, th, at = (np.r_[np.int64(t), x] for t, x in zip(tail[:5], (h, s, doc, th, at), strict=True))
        out = np.zeros(len(h), dtype=bool)
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_s = new_h | np.r_[True, s[1:] != s[:-1]]
        leads = np.flatnonzero(new_s)
        lead = leads[np.cumsum(new_s) - 1]
        # The same place twice (a repeated row) is no earlier place.
        own = (doc == doc[lead]) & (th == th[lead]) & (at == at[lead])
        texts = np.add.reduceat(new_s, np.flatnonzero(new_h))
        several = np.repeat(texts > 1, np.diff(np.r_[np.flatnonzero(new_h), len(h)]))
        out[new_s & several] = True
        sent = tail is not None and tail[5]
        if sent:  # the open gram has several texts, and its last one went out
            group = h == h[0]
            out[group & new_s] = True
            out[0] = False
        last = leads[-1]
        go = pd.DataFrame({"h": h[out], "s": s[out], "doc": doc[out], "th": th[out], "at": at[out]})
        gone = ~new_s & ~own
        covered = pd.DataFrame({"h": h[gone], "s": s[gone], "doc": doc[gone], "th": th[gone], "at": ~at[gone]})
        was_out = bool(out[last]) or (sent and last == 0)
        tail = (h[last], s[last], doc[last], th[last], at[last], was_out)
        yield pd.concat([passed, go, covered], ignore_index=True)


def distinct_segments(found: DataFrame) -> DataFrame:
    return found.repartition("h").sortWithinPartitions("h", "s", "doc", "th", "at").mapInPandas(_pass, _SEGMENT)


def _strings(length: int):
    """Fetched segments to their single strings, as segments of their own."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = []
            for doc, th, at, t in zip(pdf["doc"], pdf["th"], pdf["at"], pdf["bytes"], strict=True):
                n = at & 0xFFFF
                d = [hashlib.blake2b(t[i:i + length], digest_size=16).digest() for i in range(n)]
                key = np.frombuffer(b"".join(d), dtype="<i8").reshape(-1, 2)
                start = (at >> 16) + np.arange(n)
                parts.append((key[:, 0], key[:, 1], np.full(n, doc), np.full(n, th), _at(start, np.int64(1))))
            if parts:
                yield _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return batches


def shard_repeats(rows: list[tuple[int, int, int, bytes]], length: int):
    """(doc, th, start) of the strings in some segments (doc, th, start, text)
    that another, earlier string equals."""
    sizes = np.array([len(t) for *_, t in rows]) + 1
    text = np.frombuffer(b"".join(t + b"\0" for *_, t in rows), dtype=np.uint8).astype(np.uint16)
    ends = np.cumsum(sizes)
    text[ends - 1] = 256
    sa = suffix_array(text, 257)
    shared = permuted_common_prefixes(text, sa, length)
    group = np.cumsum(shared[sa] < length)  # suffixes in order; a group shares ``length`` bytes
    # A whole string fits before the segment's end.
    starts = np.arange(len(text)) + length < np.repeat(ends, sizes)
    several = np.bincount(group[starts[sa]], minlength=len(text) + 1) > 1
    keep = starts[sa] & several[group]
    group, pos = group[keep], sa[keep]
    owner = np.searchsorted(ends, pos, "right")
    doc, th, start = (np.array([r[c] for r in rows], dtype=np.int64)[owner] for c in range(3))
    start = start + pos - (ends - sizes)[owner]
    o = np.lexsort((start, th, doc, group))
    group, doc, th, start = group[o], doc[o], th[o], start[o]
    new = np.r_[True, group[1:] != group[:-1]] if group.size else np.zeros(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if group.size else new
    own = (doc == doc[lead]) & (th == th[lead]) & (start == start[lead])
    return doc[~own], th[~own], start[~own]


def _runs(doc, th, start):
    """Neighbouring single strings as (doc, th, at); a count has 16 bits, so
    runs also end at multiples of 2 ** 15."""
    o = np.lexsort((start, th, doc))
    doc, th, start = doc[o], th[o], start[o]
    gap = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (np.diff(start) > 1) | (start[1:] % (1 << 15) == 0)
    first = np.flatnonzero(np.r_[True, gap]) if doc.size else np.zeros(0, dtype=np.int64)
    last = np.r_[first[1:], doc.size] - 1 if doc.size else first
    return pd.DataFrame({"doc": doc[first], "th": th[first], "at": _at(start[first], start[last] - start[first] + 1)})


def _shards(length: int):
    """Fetched segments sorted by gram, taken together up to SHARD bytes."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for pdf in frames:
            for h, doc, th, at, t in zip(pdf["h"], pdf["doc"], pdf["th"], pdf["at"], pdf["bytes"], strict=True):
                if size >= SHARD // 2 and h != last:
                    yield _runs(*shard_repeats(held, length))
                    held, size = [], 0
                held.append((doc, th, at >> 16, t))
                size += len(t)
                last = h
        if held:
            yield _runs(*shard_repeats(held, length))

    return batches


def _document(length: int, with_kept: bool):
    """The digest of each row: its bytes and its marks."""
    def one(text: bytes, marks) -> tuple[int, int, int, str, bytes]:
        n = len(text)
        if marks is None or not len(marks):
            return n, 0, 0, hashlib.sha256(text).hexdigest(), text
        at = np.asarray(marks, dtype=np.int64)
        start, end = at >> 16, (at >> 16) + (at & 0xFFFF) + length - 1
        o = np.argsort(start, kind="stable")
        start, end = start[o], np.maximum.accumulate(end[o])
        new = np.r_[True, start[1:] > end[:-1]]
        a = start[new]
        b = np.r_[end[:-1][new[1:]], end[-1]]
        kept, p = [], 0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            kept.append(text[p:x])
            p = y
        kept.append(text[p:])
        whole = b"".join(kept)
        return n, int((b - a).sum()), len(a), hashlib.sha256(whole).hexdigest(), whole

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [one(t, m) for t, m in zip(pdf["text"], pdf["marks"], strict=True)]
            got = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            got.insert(0, "doc_id", pdf["doc_id"])
            yield got if with_kept else got.drop(columns="kept")

    return batches


def _ids(docs: DataFrame) -> dict[str, Column]:
    return {"doc": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "th": F.xxhash64(text_or_empty())}


def remove_repeats(docs: DataFrame, length: int = 100, with_kept: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row, and
    with ``with_kept`` also ``kept``, the bytes left.

    Texts are UTF-8 bytes; null text is empty. Order: by id (null ids last, and
    one after the other by text hash, as are rows of one id with other texts),
    then start. Equal rows are one document: they do not repeat each other and
    get equal results. Texts shorter than ``length`` lose nothing. Other
    columns are not read. An empty table gives no rows.

    Text hashes have 64 bits and count only within a gram's 64 bits.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    rows = docs.select(id_in(), F.encode(text_or_empty(), "UTF-8").alias("text"),
                       *[c.alias(n) for n, c in _ids(docs).items()])
    first = written(distinct_segments(rows.select("doc", "th", "text")
                                      .mapInPandas(segments(length), _SEGMENT)), "repeats")
    release()
    go = first.where("at >= 0")
    size = F.sum(F.col("at").bitwiseAND(0xFFFF) + (length - 1))
    hot = written(go.groupBy("h").agg(size.alias("n")).where(F.col("n") > SHARD // 2)
                  .select("h", F.lit(True).alias("hot")), "repeat-hot")
    wanted = go.join(hot, "h", "left").groupBy("doc", "th").agg(
        F.collect_list(F.struct("h", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("want"))
    of = F.expr(f"substring(text, cast(shiftright(w.at, 16) as int) + 1, cast((w.at & 65535) + {length - 1} as int))")
    fetched = written(rows.join(wanted, ["doc", "th"]).select("doc", "th", "text", F.explode("want").alias("w"))
                      .select("doc", "th", "w.h", "w.at", "w.hot", of.alias("bytes")), "repeat-texts")
    release()
    mark = "doc long, th long, at long"
    dealt = fetched.where("not hot").repartition("h").sortWithinPartitions("h") \
        .mapInPandas(_shards(length), mark)
    single = distinct_segments(fetched.where("hot").mapInPandas(_strings(length), _SEGMENT))
    marks = written(
        dealt.unionAll(first.where("at < 0").select("doc", "th", F.expr("~at").alias("at")))
        .unionAll(single.where("at < 0").select("doc", "th", F.expr("~at").alias("at"))), "repeat-marks")
    release()
    by_doc = marks.groupBy("doc", "th").agg(F.collect_list("at").alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return id_out(rows.join(by_doc, ["doc", "th"], "left").select("doc_id", "text", "marks")
                  .mapInPandas(_document(length, with_kept), schema + ", kept binary" * with_kept))
