"""Runs of the LCP-interval tree against a brute-force search."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from llm_fixtures import SF_SMALL, no_docs, odd_docs, prose  # noqa: F401

from netsieve.llm import op12_periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch of every period; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda r: (r[0], r[2]))


def loop(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(doc_id, text):
    words = loop(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    dropped = {i for s, l, q in runs for i in range(s + q, s + l)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{l},{q}\n" for s, l, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def texts_of_few_words(seed, count):
    r, out = random.Random(seed), []
    for _ in range(count):
        t = []
        for _ in range(r.randint(0, 8)):
            unit = [r.randint(0, r.choice([1, 2, 30])) for _ in range(r.randint(1, 6))]
            t += (unit * r.randint(1, 9))[:r.randint(1, 40)]
        out.append(t)
    return out


def test_runs_of_slices_equal_brute_force():
    for seed in range(60):
        texts = texts_of_few_words(seed, 12)
        first = np.cumsum([0] + [len(t) for t in texts])
        got = R.runs_of(np.array(sum(texts, []), np.int64), first).tolist()
        want = [[first[k] + s, l, q] for k, t in enumerate(texts) for s, l, q in brute_runs(t)]
        assert got == want, seed


def test_long_periodic_texts_and_many_left_words():
    r = random.Random(3)
    one = [7] * 20_000
    unit = [r.randint(0, 400) for _ in range(900)]
    many = sum(([1000 + k, 1, 2, 3, 4, 5, 6] for k in range(3000)), [])
    for words, want in ((one, [[0, 20_000, 1]]), (unit * 12, [[0, 10_800, 900]]), (many, [])):
        assert R.runs_of(np.array(words), np.array([0, len(words)])).tolist() == want


def test_long_words_are_told_apart_by_their_bytes(spark):
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, " ".join([a] * 6)), (2, " ".join([a, b] * 3)), (3, " ".join([a, b] * 4))], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in R.periodic_runs(docs).collect()} == {1: [(0, 6, 1)], 2: [], 3: [(0, 8, 2)]}


def test_query_equals_brute_force(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    few = docs.where("length(text) < 6000")
    want = sorted((brute(d.doc_id, d.text) for d in few.collect()))
    assert sorted(map(tuple, R.run_report(few).collect())) == want
    assert sum(w[1] > 0 for w in want) > 5
    odd = [brute(d.doc_id, d.text) for d in odd_docs.where("coalesce(doc_id, 0) <> 6").collect()]
    assert sorted(map(tuple, R.run_report(odd_docs.where("coalesce(doc_id, 0) <> 6")).collect()), key=str) == sorted(odd, key=str)
    assert R.run_report(no_docs).count() == 0
