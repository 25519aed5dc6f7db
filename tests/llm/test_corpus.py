"""Operators over the whole corpus, against brute force."""
import hashlib
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from parley.llm import simhash, suffix_dedup
from parley.llm.components import components
from parley.llm.line_dedup import LineRuns, dedup_lines, line_hashes
from parley.llm.mixing import apply_mix, mix
from parley.llm.simhash import hex_digits, keep_one, near_duplicates
from parley.llm.suffix_array import permuted_common_prefixes, suffix_array
from parley.llm.suffix_dedup import remove_repeats

LAST = (1 << 63) - 1
sha = lambda b: hashlib.sha256(b).hexdigest()
key = lambda r: tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


# ---------------------------------------------------------------- suffix array
def brute_repeats(rows, length):
    """Equal rows are one document; null ids come last."""
    docs = sorted({(LAST if d is None else d, t or "") for d, t, *_ in rows}, key=lambda x: (x[0], order_hash[x[1]]))
    seen, out = set(), {}
    for d, t in docs:
        b = t.encode()
        covered, own = np.zeros(len(b), bool), []
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                covered[i:i + length] = True
            seen.add(w)
        own = np.r_[False, covered, False]
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out[d, t] = (len(b), int(covered.sum()), int((own[1:] & ~own[:-1]).sum()), sha(kept))
    return [(d, *out[LAST if d is None else d, t or ""]) for d, t, *_ in rows]


order_hash = {}


def hash_texts(df):
    from pyspark.sql import functions as F
    for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect():
        order_hash[r["t"]] = r["h"]


def test_repeats_on_odd_documents(odd_docs, odd_rows, no_docs):
    hash_texts(odd_docs)
    same(remove_repeats(odd_docs, 100).collect(), brute_repeats(odd_rows, 100))
    assert remove_repeats(no_docs, 100).count() == 0
    kept = remove_repeats(odd_docs, 100, with_kept=True).collect()
    assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in kept)


@pytest.mark.parametrize("shard", [1 << 20, 300])  # the second deals grams out as single strings
def test_repeats_that_overlap_and_run(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    r = random.Random(3)
    p = "".join(r.choice("abc") for _ in range(400))
    noise = lambda s: "".join(r.choice(s) for _ in range(r.randrange(60)))
    rows = [(i, noise("abcd é") + p[(a := r.randrange(200)):a + r.randrange(300)] + noise("xyz")) for i in range(150)]
    rows += [(300, "a" * 500), (301, "ab" * 300), (302, "x" * 99), (303, "a" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hash_texts(df)
    same(remove_repeats(df, 100).collect(), brute_repeats(rows, 100))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(500):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60))
        sa = suffix_array(x, 257)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        limit = int(rng.integers(1, 8))
        got = permuted_common_prefixes(x, sa, limit)
        for r in range(1, len(x)):
            a, b = x[sa[r]:], x[sa[r - 1]:]
            n = min(len(a), len(b), limit)
            ne = np.flatnonzero(a[:n] != b[:n])
            assert got[sa[r]] == (ne[0] if ne.size else n)


def test_suffix_array_of_names():
    """Large alphabets: few symbols that repeat long, and many that mostly differ."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)) for _ in range(200)]
    texts += [np.tile([7, 3], 200), np.zeros(300, int), np.tile(rng.permutation(90), 4), rng.integers(0, 5000, 400)]
    for x in texts:
        for alphabet in (5000, 1 << 40):
            assert suffix_array(x, alphabet).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_suffix_array_takes_no_python_step_an_entry():
    words = ["".join(w) for w in np.random.default_rng(2).choice(list("abcdefghij"), (3000, 6))]
    x = np.frombuffer(" ".join(words[i] for i in np.random.default_rng(3).integers(0, 3000, 9000)).encode(), np.uint8)
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count if frame.f_code.co_filename == suffix_array.__code__.co_filename else None

    before = sys.gettrace()
    sys.settrace(count)
    try:
        sa = suffix_array(x, 257)
    finally:
        sys.settrace(before)
    assert sorted(sa.tolist()) == list(range(len(x))) and lines < len(x) // 10


# ------------------------------------------------------------------ line dedup
def brute_lines(rows, min_chars=10):
    strip = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[strip(line)].add(LAST if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        me = LAST if d is None else d
        kept = [x for x in lines if len(strip(x)) < min_chars or min(holders[strip(x)]) == me]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 3), (5, 2)])
def test_lines_on_odd_documents(odd_docs, odd_rows, no_docs, batches, fanout):
    got = dedup_lines(odd_docs, 10, batches, fanout)
    same([(r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["kept"].encode())) for r in got.collect()], brute_lines(odd_rows))
    assert [c for c in odd_docs.columns if c != "kept"] == got.columns[:-3]
    assert dedup_lines(no_docs, 10).count() == 0


def test_runs_are_levelled(spark):
    runs = LineRuns(spark, fanout=2)
    for i in range(4):
        df = spark.createDataFrame([(i, f"a line that all have\nline number {i}")], "doc_id long, text string")
        assert runs.add(line_hashes(df, 10)).count() == (i > 0)
    assert {k: len(v) for k, v in runs.levels.items() if v} == {2: 1}
    assert runs.keys().count() == 5


# --------------------------------------------------------------------- simhash
def brute_simhash(rows, n=4, bits=4):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + n]).encode(), seed=42) for i in range(max(1, len(w) - n + 1))]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fps = [fp(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {}
    for (d, *_), g in zip(rows, group, strict=True):
        if d is not None:
            low[g] = min(d, low.get(g, d))
    return [(d, f"{f:016x}", low.get(g)) for (d, *_), f, g in zip(rows, fps, group, strict=True)]


def test_simhash_on_odd_documents(odd_docs, odd_rows, no_docs):
    want = brute_simhash(odd_rows)
    got = near_duplicates(odd_docs).select("doc_id", hex_digits("fp"), "component_id").collect()
    same(got, want)
    assert near_duplicates(no_docs).count() == 0
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for *_, c in want})
    assert keep_one(no_docs).count() == 0


@pytest.mark.parametrize("block", [4096, 16])  # the second deals keys out as pairs of blocks
def test_links_lose_none(spark, block):
    rng = np.random.default_rng(0)
    c = rng.integers(0, 1 << 63, 15, dtype=np.uint64)
    flips = lambda k: np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 15, dtype=np.uint64) for _ in range(k)])
    x = np.unique(np.concatenate([c ^ flips(k) for k in range(1, 7) for _ in range(8)]).view(np.int64))
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, 4, block)).collect()}
    group = np.arange(len(x))
    near = np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None, :]) <= 4
    while True:
        new = np.where(near, group[None, :], len(x)).min(axis=1)
        if (new == group).all():
            break
        group = new
    assert [roots.get(int(v), int(v)) for v in x] == [int(x[g]) for g in group]


# ---------------------------------------------------------------------- mixing
def brute_targets(sizes, weights, ratio, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = ratio * sum(sizes.values()), {}, set(names)
    while open_:
        level = budget / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not over:
            target.update({s: level * w[s] for s in open_})
            break
        for s in over:
            target[s] = epochs * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def test_mix_on_odd_documents(odd_docs, odd_rows, no_docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in odd_rows:
        sizes[s] += words(t)
    target = brute_targets(sizes, [3, 1, 2], 1.5, 2.0)
    got = mix(odd_docs, [3, 1, 2], 1.5, 2.0, "s").collect()
    same([(r["doc_id"], r["size"], r["source"], r["source_size"]) for r in got],
         [(d, words(t), s, sizes[s]) for d, t, s in odd_rows])
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    same(mix(odd_docs, [3, 1, 2], 1.5, 2.0, "s").collect(), [tuple(r) for r in got])
    mixed = apply_mix(odd_docs, [3, 1, 2], 1.5, 2.0, "s")
    assert mixed.columns == odd_docs.columns
    again = Counter()
    for r in mixed.collect():
        again[r["source"]] += words(r["text"])
    assert again == taken
    assert mix(no_docs, [3, 1, 2], 1.5, 2.0, "s").count() == 0
    assert apply_mix(no_docs, [3, 1, 2], 1.5, 2.0, "s").count() == 0
