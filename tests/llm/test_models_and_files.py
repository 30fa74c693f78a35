"""Top-k, counts, mixing, records, classifiers and the language model against plain Python."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import SF_SMALL, no_docs, odd_docs, prose  # noqa: F401
from pyspark.sql import functions as F
from test_text_and_links import LOWER, WORD

from netsieve.llm import encoding, op4_token_counts, op6_mixing, op7_records, op8_quality_gam, op9_toxicity_fm, op10_katz
from netsieve.llm import op2_topk as K
from netsieve.llm.packing import pack_floats, pack_ints, pack_sorted, unpack
from netsieve.llm.queries import ORACLE, QUERIES, tokenizer_path
from netsieve.llm.storage import materialise


def test_top_k_equals_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 32)
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    monkeypatch.setattr(K, "CHUNK", 8)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 5) for _ in range(32)]) for i in range(200)]
    rows += [(300 + i, [1.0] * 32) for i in range(40)]  # equal vectors: ties go to smaller ids
    rows += [(400, None), (401, [float("nan")] * 32), (402, [None] * 32), (403, [1.0, float("inf")]), (None, [1.0] * 32),
             (404, [2.0, 1.0]), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    v = K.quantised(df, "vec_id", "v")
    ok = {i: [math.floor(256 * x) for x in vec] + [0] * (32 - len(vec)) for i, vec in rows
          if i is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec)}
    want = {}
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], ok[i])), i) for i in ok if i != q)[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = defaultdict(list)
    for x in K.top_k(v, v.where("id % 20 = 0"), 5).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert {q: sorted(x) for q, x in got.items()} == want
    assert K.top_k(v.limit(0), v, 5).count() == 0
    assert K.top_k(v.where("id in (300, 301)"), v.where("id = 300"), 5).count() == 1


def test_top_k_of_huge_components(spark):
    rows = [(0, [2.0 ** 21, 0.0]), (2, [2.0 ** 21, 0.0]), (3, [2.0 ** 22, 0.0]), (4, [-(2.0 ** 22) - 0.3, 7.7])]
    rows += [(100 + i, [float(i)] * 2 + [0.5] * 130) for i in range(5)]
    got = top_scores(spark, rows, "id = 0")
    assert got[:2] == [(1, 3, 2 ** 59), (2, 2, 2 ** 58)] and got[-1][1] == 102 and len(got) == 5
    for bad, error in (([(0, [2.0 ** 60]), (1, [2.0 ** 60])], "64 bits"), ([(0, [2.0 ** 30, 0.0]), (1, [2.0 ** 30, 0.0])], "64 bits")):
        with pytest.raises(Exception, match=error):
            top_scores(spark, bad, "id = 0")


def top_scores(spark, rows, queries):
    v = K.quantised(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v")
    return sorted((x.rank, x.vec_id, x.score) for x in K.top_k(v, v.where(queries), 5).collect())


def test_pruned_scan_is_exact():
    r = np.random.default_rng(0)
    v = (r.normal(size=(500, 32)) * 100).astype(np.int32)
    v = v[np.argsort(-(v.astype(float) ** 2).sum(1))]
    q, ids = v[:20], np.arange(500)
    rot = np.linalg.eigh((v.T.astype(float) @ v))[1][:, ::-1]
    qi, vi, s = K._scan(q, ids[:20], v, ids, np.full(20, -np.inf), rot, 5)
    full = q.astype(np.int64) @ v.T.astype(np.int64)
    full[np.arange(20), np.arange(20)] = -10 ** 12
    for i in range(20):
        assert vi[qi == i].tolist() == np.lexsort((ids, -full[i]))[:5].tolist()


def test_scan_by_matrices_equals_scan_by_pairs(monkeypatch):
    r = np.random.default_rng(1)
    v = (r.normal(size=(700, 24)) * 50).astype(np.int32)
    v[300:350] = v[:50]  # equal vectors
    rot, ids, thr = np.linalg.eigh(v.T.astype(float) @ v)[1][:, ::-1], r.permutation(700), np.full(60, -np.inf)
    found = []
    for share in (0.0, 2.0):
        monkeypatch.setattr(K, "DENSE", share)
        found.append([x.tolist() for x in K._scan(v[:60], ids[:60], v, ids, thr, rot, 5)])
    assert found[0] == found[1] and len(found[0][0]) == 300


def test_top_k_packs_full_blocks_whatever_the_partitions(spark, monkeypatch):
    counts = {}

    def counted(df, name):
        out = materialise(df, name)
        counts[name] = out.count()
        return out
    monkeypatch.setattr(K, "materialise", counted)
    v = spark.range(300).selectExpr("id", "array(id % 7, id % 11, 3) as v")
    assert K.top_k(v, v.where("id % 10 = 0"), 5).count() == 150
    # Eight partitions of the session made eight blocks of each, and 64 pairs of blocks for the work of one.
    assert counts["vector-blocks"] == counts["query-blocks"] == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_by_pieces_equals_whole_texts(spark, name):
    import pyarrow as pa
    from netsieve.llm import textarrays as T
    e = encoding.encoder(tokenizer_path(name))
    assert e.rule
    docs = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").limit(80).collect()]
    docs += ["", " ", "  a", "a  b", "a  b", "it's  'll <|endoftext|> x<|endoftext|>", "a\n\n b \n", "É é ñ  ",
             "　 x 　", "x  y", "a 's b", " \n x", "a\x1c b", "e ́x", "Aİ Σ ΑΣ b", "a "]
    at, whole = 0, e.whole(docs)
    for _, t in T.slices(pa.array(docs), max_bytes=5000):
        ids, count = e.slice(t)
        cut = np.concatenate(([0], np.cumsum(count)))
        for i in range(len(count)):
            assert ids[cut[i]:cut[i + 1]].tolist() == whole[at + i]
        at += len(count)


def test_token_counts_splice_chunks_and_widen_overlaps(spark, odd_docs, no_docs, prose):
    path = tokenizer_path("word_bpe_49k.json")
    e = encoding.encoder(path)
    texts = [prose(700, 1), "a " * 900, "x" * 3000 + " y", prose(300, 2) + "w" * 700 + " " + prose(200, 3), "éà " * 500, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op4_token_counts.token_counts(df, path, long_chars=500, chunk=400, overlap=30).collect()
    assert {r.doc_id: (r.n_tokens, r.n_bytes) for r in got} == {
        i: (len(e.whole([t])[0]), len(t.encode())) for i, t in enumerate(texts)}
    odd = op4_token_counts.token_counts(odd_docs, path, long_chars=2000, chunk=1000, overlap=100)
    assert odd.count() == 10 and odd.where("doc_id = 1").first().n_tokens == 0
    assert odd.where("doc_id = 6").first().over_limit
    assert op4_token_counts.token_counts(no_docs, path).count() == 0
    piece = op4_token_counts.token_counts(df, tokenizer_path("piece_bpe_32k.model"), long_chars=500).collect()
    s = encoding.encoder(tokenizer_path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in piece} == {i: len(s.whole([t])[0]) for i, t in enumerate(texts)}


def test_splice_needs_an_agreeing_boundary():
    tok = lambda starts: np.array([(7, a, a + 2) for a in starts], op4_token_counts._TOKEN)
    a, b = tok(range(0, 60, 3)), tok(range(30, 90, 3))
    left, right = op4_token_counts.splice(a, b, "white")
    assert left + right == 10
    assert op4_token_counts.splice(a, tok(range(31, 90, 3)), "white") is None
    assert op4_token_counts.splice(a, b, None) is None


def test_hypergeometric_draw_follows_its_distribution(spark):
    step = op6_mixing._draw("20L", "8L", "10L", "u")
    us = spark.range(0, 1000).selectExpr("(id + 0.5D) / 1000 as u").selectExpr(f"{step} as k")
    got = Counter(r.k for r in us.collect())
    for k in range(9):
        p = math.comb(8, k) * math.comb(12, 10 - k) / math.comb(20, 10)
        assert abs(got[k] / 1000 - p) < 0.002


def test_quotas_are_exact_and_shards_even(spark):
    units = spark.createDataFrame([(1, 37), (2, 5), (3, 0), (4, 100)], "mix_rank int, units long")
    got = op6_mixing.quotas(units, 7).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.mix_rank] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == {1: 37, 2: 5, 4: 100} and max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 7


def test_mix_takes_targets_from_disjoint_blocks(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    mixed = op6_mixing.mix(docs, block_docs=5, shards=4)
    again = op6_mixing.mix(docs, block_docs=5, shards=4)
    key = lambda df: sorted((r.doc_id, r.mix_copy, r.mix_shard) for r in df.collect())
    rows = key(mixed)
    assert rows == key(again) and len(set(rows)) == len(rows) and {r[2] for r in rows} == set(range(4))
    report = op6_mixing.mix_report(docs, block_docs=5).collect()
    taken, size, target = Counter(), {}, {}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in report:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        size[source[r.doc_id]] = max(size.get(source[r.doc_id], 0), r.size)
    assert all(abs(taken[s] - target[s]) <= size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in report)) < 1e-3
    odd = op6_mixing.mix_report(odd_docs)
    assert odd.count() == 10 and odd.where("doc_id in (1, 2, 3) and taken > 0").count() == 0
    assert set(odd_docs.columns) <= set(op6_mixing.mix(odd_docs).columns)
    assert op6_mixing.mix_report(no_docs).count() == 0 and op6_mixing.mix(no_docs).count() == 0


def test_records_round_trip_by_scan_and_by_index(spark, odd_docs, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    e = encoding.encoder(path)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    manifest = op7_records.write_records(docs, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op7_records.read_digests(manifest).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(e.whole([r.text])[0] + [0], "<u4")
        assert got.pop(r.doc_id) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got
    shard = manifest.first()
    entries = op7_records.index_entries(shard.index_path)
    assert len(entries) == shard.records
    for doc_id, offset, n in reversed(entries[:20]):
        found, ids = op7_records.record_at(shard.path, offset)
        assert found == doc_id and len(ids) == n and ids[-1] == 0
    odd = op7_records.tokenised(odd_docs, path).collect()
    assert len(odd) == 10 and sorted(r.start for r in odd)[0] == 0 and sum(r.doc_id is None for r in odd) == 1
    assert op7_records.tokenised(no_docs, path).count() == 0


def test_damaged_records_are_noticed(tmp_path):
    payload = op7_records.payload_of(5, np.array([70000, 1], np.uint32))
    assert op7_records.parse(payload)[1].tolist() == [70000, 1] and op7_records.parse(op7_records.payload_of(None, np.array([1])))[0] is None
    good = op7_records.frame(payload)
    for bad in (good[:-1], good[:14] + b"\xff" + good[15:], b"\x01" + good[1:]):
        (tmp_path / "x.rec").write_bytes(bad)
        with (tmp_path / "x.rec").open("rb") as f, pytest.raises(ValueError):
            list(op7_records.records(f))


def _held_accuracy(rows, labels, label):
    known = {r.doc_id: getattr(r, label) for r in labels.collect()}
    pairs = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality_model_on_held_out_rows_and_odd_rows(spark, odd_docs, no_docs):
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = op8_quality_gam.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and _held_accuracy(rows, labels, "quality") >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    odd = op8_quality_gam.quality_scores(odd_docs, labels.limit(0)).collect()
    assert len(odd) == 10 and {r.score for r in odd} == {0.5}
    assert op8_quality_gam.quality_scores(no_docs, labels).count() == 0
    x = np.zeros((4, len(op8_quality_gam.FEATURES)))
    assert op8_quality_gam.predict(op8_quality_gam.fit(x, np.array([0, 1, 1, 0.])), x).shape == (4,)


def test_additive_tables_and_pairs_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((3000, len(op8_quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    m = op8_quality_gam.fit(x, y)
    assert ((op8_quality_gam.predict(m, x) > 0.5) == y).mean() > 0.9


def test_toxicity_model_on_held_out_rows_and_odd_rows(spark, odd_docs, no_docs):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = op9_toxicity_fm.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count() and _held_accuracy(rows, labels, "toxic") >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    odd = op9_toxicity_fm.toxicity_scores(odd_docs, labels.limit(0)).collect()
    assert len(odd) == 10 and {r.score for r in odd} == {0.0}
    assert op9_toxicity_fm.toxicity_scores(no_docs, labels).count() == 0


def test_factors_learn_a_pair_that_weights_cannot():
    rows = [[0], [1], [0, 1], []] * 300
    y = np.array([0, 0, 1, 0.] * 300)
    m = op9_toxicity_fm.fit(rows, y, 2)
    z = [op9_toxicity_fm._forward(m, np.array([[a, b]], float))[0][0] for a, b in ((1, 0), (0, 1), (1, 1), (0, 0))]
    assert z[2] > 0 > max(z[0], z[1], z[3])


def test_factors_learn_a_partner_that_tells_nothing_alone():
    rows = ([[0, 1]] * 100 + [[1]] * 300 + [[0]] * 100 + [[2]] * 100 + [[]] * 200) * 8
    y = np.array(([1] * 100 + [0] * 400 + [1] * 100 + [0] * 200) * 8, float)
    flat, label = np.concatenate([np.array(x, int) for x in rows]), np.repeat(y, [len(x) for x in rows])
    assert op9_toxicity_fm.evidence(flat, label, len(y), y.sum(), 3)[1] < 1e-6  # term 1 has the label's share
    m = op9_toxicity_fm.fit(rows, y, 3)
    z = op9_toxicity_fm._forward(m, np.array([[1, 1, 0], [0, 1, 0], [1, 0, 0], [0, 0, 1]], float))[0]
    assert min(z[0], z[3]) > 0 > max(z[1], z[2])


def test_toxicity_terms_and_scores_by_plain_loops():
    """Buckets of a text by a dictionary of its spans, and the pair sum written out pair by pair."""
    import pyarrow as pa
    texts = ["Ab abcdef, abcdefg x", None, "", "ABCDEF abcdef", "q" * 3000, "\u00e9t\u00e9 zz 12"]
    size = op9_toxicity_fm.BUCKETS
    (_, t), = op9_toxicity_fm.T.slices(pa.array(texts))
    bucket = {}
    for text in texts:  # a span alone is a text of one term
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
            for span in [word] + ([word[i:i + 4] for i in range(len(word) - 3)] if len(word) > 4 else []):
                if span not in bucket:
                    buf = np.frombuffer(span, np.uint8)
                    h = op9_toxicity_fm.T.span_hashes(buf, np.array([0]), np.array([len(span)]), op9_toxicity_fm.T.FOLDED_CODE)
                    bucket[span] = int(h[0]) % size
    r = np.random.default_rng(3)
    m = {"constant": None, "w0": np.float32(-0.5), "w": r.normal(0, 0.3, size), "v": r.normal(0, 0.3, (size, op9_toxicity_fm.FACTORS))}
    for text, got in zip(texts, op9_toxicity_fm.predict(m, t)):
        own = set()
        for word in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
            own |= {bucket[s] for s in [word] + ([word[i:i + 4] for i in range(len(word) - 3)] if len(word) > 4 else [])}
        own = sorted(own)
        z = -0.5 + sum(m["w"][i] for i in own) + sum(m["v"][a] @ m["v"][b] for k, a in enumerate(own) for b in own[k + 1:])
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_sample_is_bounded_by_pairs(spark):
    rows = [(i, "vile scum" if i % 2 else "kind words here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    full, cut = op9_toxicity_fm.train(docs, labels), op9_toxicity_fm.train(docs, labels, pairs=10**6)
    assert (full["w"] == cut["w"]).all()
    assert "constant" in op9_toxicity_fm.train(docs, labels, pairs=1)


def katz(docs, out):
    """Scores by dictionaries; also checks that every context sums to 1."""
    toks = {i: WORD.findall((t or "").translate(LOWER)) + ["</s>"] for i, t in docs}
    uni, bi = Counter(), Counter()
    for i, t in toks.items():
        if not out(i):
            uni.update(t)
            bi.update(zip(["<s>", *t[:-1]], t))
    hist = lambda c: [sum(v == r for v in c.values()) for r in range(1, op10_katz.KATZ_K + 2)]
    one, d2 = op10_katz.Unigram(sum(uni.values()), len(uni), hist(uni)), op10_katz.discounts(hist(bi))
    p1 = lambda w: float(one(np.array([uni[w]]))[0])
    dis = lambda c: float(op10_katz.discounted(np.array([c]), d2)[0])
    ctx, sp, sd = Counter(), Counter(), Counter()
    for (a, b), c in bi.items():
        ctx[a] += c
        sp[a] += p1(b)
        sd[a] += dis(c)

    def prob(a, b):
        if not ctx[a]:
            return p1(b)
        over = ctx[a] + 1 if sd[a] > ctx[a] * (1 - 1e-12) else ctx[a]
        return dis(bi[a, b]) / over if bi[a, b] else (1 - sd[a] / over) / (1 - sp[a]) * p1(b)
    for a in [*list(ctx)[:30], "<s>"]:
        assert abs(sum(prob(a, w) for w in [*uni, "<never seen>"]) - 1) < 1e-9
    n, v = sum(uni.values()), len(uni)
    return {i: (len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + .1) / (n + .1 * (v + 1))) for w in t),
                sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *t[:-1]], t))) for i, t in toks.items()}


def test_katz_scores_equal_dictionaries(spark, monkeypatch, odd_docs, no_docs):
    monkeypatch.setattr(op10_katz, "SHARD_BYTES", 60_000)  # several shards and key ranges
    monkeypatch.setattr(op10_katz, "GROUP_KEYS", 3000)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3, "doc_id")
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = katz([(r.doc_id, r.text) for r in docs.collect()], out)
    for r in op10_katz.katz_scores(docs).collect():
        n, known, train, base, score = want.pop(r.doc_id)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert not want
    odd = op10_katz.katz_scores(odd_docs).collect()
    assert len(odd) == 10 and all(math.isfinite(r.score) for r in odd)
    assert {r.n_tokens for r in odd if r.doc_id in (1, 2, 3)} == {1}
    assert op10_katz.katz_scores(no_docs).count() == 0


@pytest.mark.parametrize("hist", [[0] * 6, [5, 0, 0, 0, 0, 0], [1, 1, 1, 1, 1, 1], [100, 40, 20, 12, 8, 6], [0, 9, 9, 9, 9, 9]])
def test_discounts_stay_between_zero_and_one(hist):
    d = op10_katz.discounts(hist)
    assert d[0] == 0 and ((d[1:] > 0) & (d[1:] <= 1)).all() and (d[1:] < 1).any()


def test_packed_arrays_round_trip():
    r = np.random.default_rng(0)
    keys = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    for a in (keys, keys[:0]):
        assert np.array_equal(unpack(pack_sorted(a)), a)
    for a in (np.arange(300), np.zeros(0, np.int64), np.array([1 << 40])):
        assert np.array_equal(unpack(pack_ints(a)), a)
    assert np.array_equal(unpack(pack_floats(np.array([0.5, -1e300]))), [0.5, -1e300])


def test_queries_with_sql_match_it(spark):
    from oracle_compare import compare, duck
    con = duck(SF_SMALL)
    for name, sql in ORACLE.items():
        r = compare(spark, con, name, QUERIES[name], sql, SF_SMALL)
        assert r["ok"], r


def test_every_numbered_query_is_registered():
    assert all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14))


def long_pair(n):
    """Two different words of n letters that a polynomial hash modulo 2**64 cannot tell apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_long_words_are_told_apart_by_their_bytes(spark, n):
    from tokenizers import Tokenizer

    from netsieve.llm.op5_minhash_forest import near_duplicates
    a, b = long_pair(n)
    c = a.replace("b", "c"), b.replace("b", "c")
    docs = spark.createDataFrame([(1, a), (2, b), (3, c[0]), (4, c[1])], "doc_id long, text string").coalesce(1)
    byte, word = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    ids = {i: Tokenizer.from_file(byte).encode(t, add_special_tokens=False).ids + [0] for i, t in docs.collect()}
    crc = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op7_records.tokenised(docs, byte).collect()} == {
        i: (len(ids[i]), crc[i]) for i in ids}
    count = {i: len(Tokenizer.from_file(word).encode(t, add_special_tokens=False).ids) for i, t in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in op4_token_counts.token_counts(docs, word).collect()} == count
    assert all(r.kept and r.component_id == r.doc_id for r in near_duplicates(docs, size=4).collect())
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    other = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    two = spark.createDataFrame([(held, b), (other, a)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_known for r in op10_katz.katz_scores(two).collect()} == {held: 1, other: 2}


CLASHING = ["deal", "whole", "passes", "cutoff", "units", "_quality", "text_key", "_text_key", "mix_row", "mix_source", "mix_shard",
            "score", "node", "component_id", "key", "row", "count", "size", "source_size"]


def test_pipeline_stages_keep_rows_with_odd_values_and_clashing_columns(spark, prose, tmp_path):
    import corpus_pipeline as P
    from llm_fixtures import FULL
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, prose(30, 1), "en", "a", 1), (None, prose(30, 1), "en", "a", 1),
            (5, prose(30, 2), "en", "a", 1), (5, prose(30, 2), "en", "a", 1), (6, prose(4000, 3), "fr", None, 1), (7, prose(30, 2), "en", "b", 1),
            (8, "the benchmark item hides here " + prose(12, 4), "en", "b", 1)]
    docs = spark.createDataFrame(rows, FULL).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    sf = str(tmp_path)
    spark.createDataFrame([(1, prose(12, 4)), (2, None), (3, "")], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    stages = dict(P.STAGES)

    def kept(name):
        out = P.materialise(stages[name](spark, docs, sf), "odd-rows")
        assert out.columns == docs.columns
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in out.collect() for c in CLASHING)
        assert stages[name](spark, docs.limit(0), sf).count() == 0
        return sorted((r.doc_id for r in out.collect()), key=str)

    ids = sorted((r[0] for r in rows), key=str)
    assert kept("quality_classifier") == ids
    assert kept("minhash_near_dedup") == sorted([1, 2, None, None, 5, 6, 8], key=str)
    assert kept("benchmark_decontamination") == [i for i in ids if i != 8]
    mixed = kept("mixing")
    assert set(mixed) <= set(ids) and max(Counter(i for i in mixed if i not in (None, 5)).values()) <= 2
    tokens = stages["token_records"](spark, docs, sf).collect()
    assert sorted((r.doc_id for r in tokens), key=str) == ids and stages["token_records"](spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    sf = SF_SMALL.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen, now = [docs], docs
    for name, stage in P.STAGES[:-1]:
        now = P.materialise(stage(spark, now, sf), name)
        assert now.columns == docs.columns, name
        seen.append(now)
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    dropped = set(ids[0]) - set(ids[1])
    assert dropped and sum(quality.get(i, 0) for i in dropped) <= 0.05 * len(dropped)
    assert len(ids[2]) == len(set(ids[2])) < len(ids[1]) and len(ids[3]) < len(ids[2])
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) == 2
    digests = P.STAGES[-1][1](spark, now, sf).collect()
    assert sorted(r.doc_id for r in digests) == sorted(ids[4])
    assert os.path.exists(P.__file__) and P.ORACLE_SQL is None


def test_quality_stage_keeps_all_documents_without_usable_labels(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    for name, some in (("none", labels.limit(0)), ("other", labels.withColumn("doc_id", -1 - labels.doc_id))):
        some.write.parquet(str(tmp_path / name / "labels.parquet"))
        kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path / name))
        assert kept.columns == docs.columns and kept.count() == docs.count()
