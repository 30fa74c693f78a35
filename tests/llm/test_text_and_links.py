"""Word arrays, components, near-duplicates and decontamination against plain Python."""

import re

import numpy as np
import pyarrow as pa
from llm_fixtures import SF_SMALL, no_docs, odd_docs, prose  # noqa: F401

from netsieve.llm import op1_decontaminate as D
from netsieve.llm import op5_minhash_forest as N
from netsieve.llm import textarrays as T
from netsieve.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_word_arrays_equal_the_pattern_for_any_slicing():
    texts = ["Hello  wörld\tx", None, "", " a ", "b\x0bc\x0cd\re", "ÀÉ z", "last", "A a"]
    want = [WORD.findall(t or "") for t in texts]
    for size in (1, 7, 1 << 20):
        got = []
        for _, t in T.slices(pa.array(texts), max_bytes=size):
            w = T.words(t)
            for a, b in zip(w.first, w.first[1:]):
                got.append([bytes(t.buf[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b])])
        assert got == want
    (_, t), = T.slices(pa.array(["A a B"]))
    h = T.word_hashes(t, T.words(t))
    assert h[0] == h[1] != h[2]


def test_components_of_chains_stars_and_bad_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(20)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(21)) and got[200] == 199
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, 4) for r in docs.collect()}
    ids, part = sorted(sets), {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                part[b] = a
    got = {r.doc_id: r for r in N.near_duplicates(docs, size=4).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i)


def test_near_copies_of_one_text_meet_through_the_hub(spark, prose):
    base = prose(120, 5).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 150):  # each copy changes one word: similar to the original, less to one another
        w = list(base)
        w[(i * 7) % 110 + 4] = f"changed{i}"
        w[(i * 13) % 110 + 4] = f"other{i}"
        rows.append((i, " ".join(w)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_similar_fillings_of_one_template_are_all_found(spark, prose):
    """3000 texts at J = 0.697 to one another; 400 planted pairs at 0.806-0.815 and 100 just below 0.8."""
    frame = [f"{w}{i}" for i, w in enumerate(prose(200, 11).split())]
    slots = [10 + 25 * i for i in range(7)]

    def filled(words):
        w = list(frame)
        for at, x in words.items():
            w[at] = x
        return w
    texts, planted = [], []
    for d in range(2500):
        texts.append(filled({at: f"d{d}s{at}" for at in slots}))
    for k in range(500):  # four other fillings, and up to two frame words beside a filling
        words = {at: f"d{k}s{at}" for at in slots[:3]} | {at: f"e{k}s{at}" for at in slots[3:]}
        words |= {slots[3] + 1 + i: f"e{k}f{i}" for i in range(k % 5 // 2)}
        texts.append(filled(words))
        planted.append((k, 2500 + k))
    sets = {d: shingles(" ".join(w), 5) for d, w in enumerate(texts)}
    linked = {b: a for a, b in planted if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(linked) == 400
    rows = [(d, " ".join(w)) for d, w in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in
           N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: linked.get(d, d) for d in range(3000)}


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = N.near_duplicates(odd_docs).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].kept
    assert by[4].n_shingles == 1 and by[7].component_id == 5 and not by[7].kept
    assert by[None].component_id is None and not by[None].kept
    assert N.near_duplicates(no_docs).count() == 0


def leaks_of(docs, bench, percent=80):
    """All windows of every document against all items."""
    from collections import Counter
    found = {}
    items = {}
    for i, t in bench:
        w = WORD.findall((t or "").lower())
        if w:
            items[i] = (len(w), min(5, len(w)), w)
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, (n, k, iw) in items.items():
            b = Counter(tuple(iw[j:j + k]) for j in range(n - k + 1))
            for s in range(max(len(w) - n, 0) + 1):
                win = w[s:s + n]
                a = Counter(tuple(win[j:j + k]) for j in range(len(win) - k + 1))
                both = sum((a & b).values())
                union = sum((a | b).values())
                if both and both * 100 >= percent * union:
                    found[d, i] = max(found.get((d, i), 0), both / union)
    return found


def test_decontamination_equals_brute_force(spark, prose):
    bench = [(i, prose(12 + 9 * i, 100 + i)) for i in range(6)] + [(6, "only four words here"), (7, None), (8, "")]
    bench.append((9, "a a a a a a a b b b b b b"))
    docs = []
    for d in range(30):
        text = prose(80, d).split()
        item = bench[d % 6][1].split()
        if d % 3 == 0:
            if d % 2:
                item[len(item) // 2] = "altered"
            text[20:20] = item
        docs.append((d, " ".join(text)))
    docs += [(40, "say Only  four\nwords HERE now"), (41, None), (42, ""), (43, bench[3][1]), (44, bench[3][1][:200]),
             (45, "x a a a a a a a b b b b b b y"), (46, bench[3][1])]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == \
        {k: round(v, 9) for k, v in leaks_of(docs, bench).items()}


def test_long_items_are_compared_whole(spark, prose):
    bench = [(1, prose(1900, 201) + " tail" * 101), (2, prose(5000, 202))]
    docs = [(1, "three words tail"), (2, prose(300, 203) + " tail"), (6, bench[0][1])]
    for d, (_, text) in enumerate(bench):
        w = text.split()
        some = [f"x{i}" if i % 250 == 99 else v for i, v in enumerate(w)]   # above 0.9
        docs += [(10 + d, " ".join(["before"] * 5 + some + ["after"] * 3)),
                 (30 + d, " ".join(w[:2000 * (d + 1) - 1000]))]             # less than the item
    docs.append((20, " ".join(f"x{i}" if i % 30 == 9 else v for i, v in enumerate(bench[0][1].split()))))  # below 0.8
    want = leaks_of(docs, bench)
    assert set(want) == {(6, 1), (10, 1), (11, 2)}
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    bench_df = spark.createDataFrame(bench, "item_id long, text string")
    got = D.contaminated(docs_df, bench_df).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert D.clean(docs_df, bench_df).count() == len(docs) - 3


def test_fingerprints_of_wide_counters_are_the_same(spark):
    codes = spark.range(40).selectExpr("transform(sequence(1, 50 + 7 * id), i -> xxhash64(i, id)) as codes")
    both = codes.selectExpr(D._majority("codes", 16) + " as a", D._majority("codes", 32) + " as b").collect()
    assert all(r.a == r.b for r in both) and len({r.a for r in both}) == 40


def test_every_fingerprint_within_the_radius_shares_a_probed_block():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        x = int(rng.integers(0, 2 ** 63))
        flips = rng.choice(64, D.RADIUS, replace=False)
        y = x
        for b in flips:
            y ^= 1 << int(b)
        near = [bin(((x ^ y) >> (16 * b)) & 0xFFFF).count("1") for b in range(D.BLOCKS)]
        assert min(near) <= D.RADIUS // D.BLOCKS


def test_decontamination_odd_rows(spark, odd_docs, no_docs, prose):
    bench = spark.createDataFrame([(1, prose(30, 2)), (None, "one"), (3, None)], "item_id long, text string")
    got = D.contaminated(odd_docs, bench).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(4, 0), (5, 1), (5, 1), (7, 1)]
    kept = D.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    assert D.contaminated(no_docs, bench).count() == 0
    assert D.contaminated(odd_docs, bench.limit(0)).count() == 0
