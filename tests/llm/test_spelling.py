"""Spelling variants against plain loops over all pairs of words."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm import spelling as S


def brute_words(rows):
    cnt = Counter()
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            cnt[run] += 1
    return {w: n for w, n in cnt.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words):
    near = {w: [] for w in words}
    ws = sorted(words)
    for i, a in enumerate(ws):
        for b in ws[i + 1:]:
            if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def made_words(seed, n=900):
    """Words of few syllables, so grams are frequent, with edits of edits."""
    r = random.Random(seed)
    bits = ["an", "er", "tion", "ab", "é", "ÿo", "in", "aa", "a", "st", "über"]
    words = set()
    while len(words) < n:
        w = "".join(r.choice(bits) for _ in range(r.randrange(3, 9)))
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("aeé") + w[i:], w[:i] + r.choice("aeÿ") + w[i + 1:]])
        if len(w) >= 7:
            words.add(w)
    words |= {"aaaaaaa" + "a" * k for k in range(6)} | {"z" * 400, "z" * 401, "z" * 200 + "y" + "z" * 200}
    return {w: r.choice([2, 3, 30, 300, 3000, 40_000]) for w in sorted(words)}


@pytest.mark.parametrize("most", [1, 8, 64, 10_000])
def test_near_words_whatever_the_dictionary(spark, most):
    words = made_words(most)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert rows_of(S.spelling_forms(df, 10, most)) == brute_forms(words)


def test_affected_grams_by_hand():
    # Marked word of 11 characters, grams of three: an inner edit lies in three.
    batch = S.Marked.of(["abcdefg", "hijklmno"])
    assert batch.sizes.tolist() == [11, 12] and batch.p.tolist() == [*range(9), *range(10)]
    length = np.full(19, 3)
    assert S.most_affected(batch, length).tolist() == [3, 3]
    length[0], length[9:] = 6, 1
    assert S.most_affected(batch, length).tolist() == [4, 1]


@pytest.mark.parametrize("most,max_grams", [(4, 500_000), (1, 40)])
def test_dictionary_and_decomposition(spark, most, max_grams):
    words = sorted(made_words(3))
    known = S.dictionary(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), most, max_grams)
    marked = ["\x01\x01" + w + "\x02\x02" for w in words]
    grams = Counter(m[k:k + q] for m in marked for q in range(3, 7) for k in range(len(m) - q + 1))
    assert sum(map(len, known.grams)) <= max_grams and known.most >= most
    batch = S.Marked.of(words)
    gram, length, places, _ = S.decomposed(batch, known)
    covers = S.most_affected(batch, length)
    for i, m in enumerate(marked):
        own = np.flatnonzero(batch.word == i)
        assert batch.p[own].tolist() == list(range(len(m) - 2))
        for j in own:
            k, q = batch.p[j], length[j]
            g = m[k:k + q]
            assert gram[j] == int.from_bytes(g.encode("latin-1"), "big")
            assert places[j] == (grams[g] if grams[g] > known.most else 0)
            assert q == 6 or k + q == len(m) or grams[g] <= known.most
            assert q == 3 or grams[g[:-1]] > known.most
        assert covers[i] < len(own)


def test_documents_odd_rows(spark, odd_docs, odd_rows, no_docs):
    r = random.Random(4)
    more = [(i, " ".join(r.choice(["Attention", "attentioN", "thanedble", "Éélargirx", "straßenß", "attentiön"]) for _ in range(40)))
            for i in range(300, 380)] + [(None, "attention " * 3), (1, "x" * 9), (2, "x" * 9), (3, "xyzabcd1xyzabcd")]
    docs = odd_docs.select("doc_id", "text", "key", "score").unionAll(
        spark.createDataFrame([(*m, "k", 1.0) for m in more], "doc_id long, text string, key string, score double"))
    words = brute_words([(d, t) for d, t, _ in odd_rows] + more)
    assert rows_of(S.spelling_forms(S.vocabulary(docs))) == brute_forms(words)
    assert rows_of(S.spelling_forms(S.vocabulary(no_docs))) == []


def test_counts_are_handed_on_when_a_task_holds_much(spark, monkeypatch, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.01', 'sf0.001')}/documents.parquet")
    monkeypatch.setattr(S, "HELD_WORDS", 50)
    got = {r["word"]: r["n"] for r in S.vocabulary(docs).collect()}
    assert got == brute_words([(r["doc_id"], r["text"]) for r in docs.collect()])
