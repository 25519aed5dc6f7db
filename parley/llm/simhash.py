"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
read as a 23-bit word of the binary Golay code, whose 4096 codewords have every
word within three bits. A segment's near codewords are those that it or one of
its one-bit neighbours decodes to: about six of 4096. Words one bit apart have
each other's codeword among them, words two bits apart share one.

Four bits spread over three segments leave two segments with at most two
differing bits together: either one of them is equal and the other differs in
up to two bits, or both differ in one. So each fingerprint gets the keys
(segment i as it is, a near codeword of j) for the first case, and (near
codeword of i, codeword of j) and (codeword of i, near codeword of j) for the
second. Fingerprints that meet in a key are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import id_in, id_out, text_or_empty, written
from parley.llm.components import components, forest

SEED = 42
CUTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits) of each segment
MAX_BITS = 4  # what three segments and these keys cover
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: Fingerprints of one key that a task compares at once; a key with more is
#: dealt out as pairs of blocks of this size.
BLOCK = 4096


def fingerprint(text: str, n_words: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included. Fewer
    words than a shingle has: the whole sequence; none: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, for bytes
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends + 1 - np.array([len(w) + 1 for w in words])).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - n_words + 1)
    last = min(n_words, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[last:], strict=True)),
                         dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 50_000):
        part = hashes[a:a + 50_000].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n_words: int) -> DataFrame:
    """``doc_id, th, fp`` of each row: its id, its text's hash, its 64 bits."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fp = np.array([fingerprint(t, n_words) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "fp": fp.view(np.int64)})

    text = text_or_empty()
    return id_out(docs.select(id_in(), F.xxhash64(text).alias("th"), text.alias("text"))
                  .mapInPandas(batches, "doc_id long, th long, fp long"))


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each byte at each of three places, error of each remainder)."""
    def remainder(w: int) -> int:
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= GENERATOR << (bit - 11)
        return w

    places = np.array([[remainder(b << 8 * p) if b << 8 * p < 1 << 23 else 0 for b in range(256)]
                       for p in range(3)], dtype=np.int64)
    error = np.zeros(2048, dtype=np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[remainder(e)] = e
    return places, error


def codeword(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    places, error = _golay()
    r = places[0][words & 255] ^ places[1][words >> 8 & 255] ^ places[2][words >> 16]
    return (words ^ error[r]) >> 11


def near_codewords(words: np.ndarray, width: int) -> np.ndarray:
    """Columns of the codewords of each word and its one-bit neighbours; a
    repeated one is -1."""
    all_ = np.sort(np.stack([codeword(words)] + [codeword(words ^ (1 << b)) for b in range(width)], axis=1), axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
    return all_


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of ``fp``) pairs, each once; keys of the nine kinds differ."""
    bits = fp.view(np.uint64)
    seg = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in CUTS]
    near = [near_codewords(s, n) for s, (_, n) in zip(seg, CUTS, strict=True)]
    own = [codeword(s) for s in seg]
    keys, rows = [], []

    def put(kind: int, payload: np.ndarray, valid: np.ndarray) -> None:
        at, col = np.nonzero(valid)
        keys.append((np.int64(kind) << 40) + payload[at, col])
        rows.append(at)

    for kind, (i, j) in enumerate(permutations(range(3), 2)):
        put(kind, (seg[i][:, None] << 12) + near[j], near[j] >= 0)
    for kind, (i, j) in enumerate(combinations(range(3), 2), 6):
        put(kind, (near[i] << 12) + own[j][:, None], near[i] >= 0)
        put(kind, (own[i][:, None] << 12) + near[j], (near[j] >= 0) & (near[j] != own[j][:, None]))
    return np.concatenate(keys), np.concatenate(rows)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def _linked(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, all runs at once: row i against row
    i + d, for each d up to the longest run; a run's links shrink to a forest
    before they add up."""
    a, b, size = [], [], 0
    for d in range(1, len(key)):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not i.size:
            break
        i = i[_apart(fp[i], fp[i + d]) <= max_bits]
        a.append(fp[i])
        b.append(fp[i + d])
        size += i.size
        if size > 1_000_000:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, size = [x], [y], x.size
    return forest(np.concatenate(a), np.concatenate(b)) if size else (fp[:0], fp[:0])


def _compare(max_bits: int, block: int):
    """Over rows sorted by key: links as (u, v, 0). Rows of a key with more than
    ``block`` of them come out unread, as (fp, key, 1)."""
    def frame(u, v, hot):
        return pd.DataFrame({"u": u, "v": v, "hot": np.full(len(u), hot, dtype=np.int32)})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = fp = np.zeros(0, dtype=np.int64)
        hot = None  # the key being passed on
        for pdf in frames:
            key = np.concatenate([key, pdf["key"].to_numpy()])
            fp = np.concatenate([fp, pdf["fp"].to_numpy()])
            if hot is not None:
                n = np.searchsorted(key, hot, "right")
                if n:
                    yield frame(fp[:n], key[:n], 1)
                key, fp = key[n:], fp[n:]
                hot = hot if not key.size else None
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.zeros(0, dtype=np.int64)
            size = np.diff(np.r_[start, key.size])
            many = np.repeat(size > block, size)
            if many.any():
                yield frame(fp[many], key[many], 1)
                if many[-1]:
                    hot = key[-1]
            open_ = key == key[-1] if key.size else many  # the last key may go on
            now = ~many & ~open_
            u, v = _linked(key[now], fp[now], max_bits)
            if u.size:
                yield frame(u, v, 0)
            rest = open_ & ~many
            key, fp = key[rest], fp[rest]
        u, v = _linked(key, fp, max_bits)
        yield frame(u, v, 0)

    return batches


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges ``u, v`` whose components are those of all pairs of the distinct
    fingerprints ``fp`` at most ``max_bits`` apart."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys cover up to {MAX_BITS} differing bits")

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fp = pdf["fp"].to_numpy()
            for a in range(0, len(fp), 5000):
                key, row = fuzzy_keys(fp[a:a + 5000])
                yield pd.DataFrame({"key": key, "fp": fp[a:a + 5000][row]})

    pairs = distinct.select("fp").mapInPandas(keyed, "key long, fp long")
    schema = "u long, v long, hot int"
    found = written(pairs.repartition("key").sortWithinPartitions("key")
                    .mapInPandas(_compare(max_bits, block), schema), "simhash-links")
    edges = found.where("hot = 0").select("u", "v")
    hot = found.where("hot = 1").select(F.col("u").alias("fp"), F.col("v").alias("key"))
    if not hot.isEmpty():
        # Blocks of a hot key by the fingerprint's hash; each pair of blocks is
        # a group of its own, of about two blocks' size.
        blocks = hot.join(hot.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key") \
            .withColumn("nb", F.ceil(F.col("n") / (block // 2)).cast("int")) \
            .withColumn("b", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")) \
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        group = F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o"))
        far = blocks.select(group.alias("key"), "fp").repartition("key").sortWithinPartitions("key") \
            .mapInPandas(_compare(max_bits, 1 << 62), schema)
        edges = edges.unionAll(far.select("u", "v"))
    return edges


def classes(docs: DataFrame, n_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows ``doc_id, th, fp``; every fingerprint's ``fp, low``): ``low`` is the
    first row of its component by id, nulls last, then text hash."""
    rows = written(fingerprints(docs, n_words), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    nodes = written(rows.groupBy("fp").agg(first.alias("low")), "simhash-nodes")
    roots = components(links(nodes, max_bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("low"))
    return rows, written(named.select("fp", "root").join(lows, "root").select("fp", "low"), "simhash-classes")


def near_duplicates(docs: DataFrame, n_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` of each row: the smallest id that links of
    fingerprints at most ``max_bits`` apart reach, its own included.

    Copies are one fingerprint from the start: links join fingerprints, not
    rows. Null or blank text has fingerprint 0, which links like any other.
    Rows with a null id belong to a component but never name it: one whose ids
    are all null has a null ``component_id``. Repeated rows stay. Other columns
    are not read. An empty table gives no rows.
    """
    rows, classed = classes(docs, n_words, max_bits)
    return rows.join(classed, "fp").select("doc_id", "fp", F.col("low.doc_id").alias("component_id"))


def hex_digits(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, n_words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """The columns of ``docs``, one row of each component: the first by id
    (nulls last), then by text hash. Of rows with one id and one text any one."""
    _, classed = classes(docs, n_words, max_bits)
    keep = classed.select(F.col("low.doc_id").alias("_id"), F.col("low.th").alias("_th")).distinct()
    d = docs.withColumn("_text", F.xxhash64(text_or_empty()))
    d = d.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_th")), "left_semi")
    return d.dropDuplicates(["doc_id", "_text"]).drop("_text")
