"""Language-model scores: Katz backoff with Good-Turing discounts over word bigrams.

    P(w | h) = d(c(h w)) c(h w) / c(h)      if h w was seen in training
             = alpha(h) P(w)                otherwise, and alike down to
    P(w)     = d(c(w)) c(w) / N             if w was seen, else the mass left for unseen words

Counts up to ``KATZ_K`` are discounted by Good-Turing, larger ones are
trusted.  alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of P(w) over the seen w), so every
context sums to exactly 1 over the seen words plus one unseen word.  A context
whose successors are all trusted counts one more, which leaves room for unseen ones.

The corpus is tokenised once into *shards* of about ``SHARD_BYTES`` of text:
files in the shared folder with the shard's sorted word hashes and its tokens
as positions in them.  Words and bigrams are 64-bit hashes.  Everything
that is learned over the corpus is one kind of step: each shard sends its *distinct* keys with
their local sums to the key range's group (a shuffle of packed, pre-aggregated
arrays, partitioned by range), the group adds up and answers each shard in the
order it asked, so answers carry no keys.  The tables this leaves, one row per
(range, shard), are the model:

1. words -> training counts;
2. bigrams -> training counts, and which shard owns each (so that each seen
   bigram enters the sums below exactly once);
3. contexts -> alpha, from the owners' sums of P(w) and P(w | h).

A very frequent word or bigram is one entry a shard, so no key is hot.  The
driver sees only N, the vocabulary size and a dozen counts of counts.

Defined cases: NULL text is empty: its only token is the end; NULL ids train
(their hash is no number) and are not held out; without any training document every probability
of an unseen word is 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm import textarrays as T
from netsieve.llm.labelled import held_out
from netsieve.llm.packing import load, pack_floats, pack_ints, pack_sorted, save, unpack
from netsieve.llm.storage import map_arrow, materialise, tasks, workers_import
from netsieve.session import scratch_path

SHARD_BYTES = 12 << 20
GROUP_KEYS = 1_500_000
KATZ_K = 5
ADD = 0.1
END, BEGIN = np.uint64(0x5E17C0DE5E17C0DE), np.uint64(0xB0B1B2B3B4B5B6B7)
_PAIR = np.uint64(0x9FB21C651E98DF25)

_REQUEST = "range long, shard long, keys binary, a binary, b binary, c binary"
_ANSWER = "range long, shard long, n binary, own binary, hist array<long>, total long"


# --- shards ---------------------------------------------------------------------------------

def _shard_rows(folder: str):
    def run(batches):
        ctx = TaskContext.get()
        part, seq, held = ctx.partitionId(), 0, {"ids": [], "out": [], "tokens": [], "count": []}
        size = 0

        def flush():
            nonlocal seq, size, held
            vocab, tokens = np.unique(np.concatenate(held["tokens"]), return_inverse=True)
            count = np.concatenate(held["count"])
            ids = pa.array(held["ids"], pa.int64())
            path = f"{folder}/shard-{part:06d}-{seq:04d}-{ctx.taskAttemptId()}"
            save(path, {"vocab": pack_sorted(vocab), "tokens": pack_ints(tokens), "count": pack_ints(count),
                        "id": np.array(ids.fill_null(0)), "no_id": np.array(ids.is_null()),
                        "out": np.array(held["out"], bool)})
            row = pa.RecordBatch.from_pylist([{"shard": part * (1 << 24) + seq, "path": path, "words": len(vocab),
                                               "tokens": len(tokens)}])
            seq, size, held = seq + 1, 0, {"ids": [], "out": [], "tokens": [], "count": []}
            return row
        for batch in batches:
            for lo, t in T.slices(batch.column(2)):
                w = T.words(t)
                h = T.exact_word_hashes(t, w)
                n = len(t.offsets) - 1
                count = np.diff(w.first)
                tokens = np.empty(len(h) + n, np.uint64)
                tokens[np.arange(len(h)) + np.repeat(np.arange(n), count)] = h
                tokens[w.first[1:] + np.arange(n)] = END
                held["tokens"].append(tokens)
                held["count"].append(count + 1)
                held["ids"] += batch.column(0).slice(lo, n).to_pylist()
                held["out"] += batch.column(1).slice(lo, n).to_pylist()
                size += len(t.buf) + 64 * n
                if size >= SHARD_BYTES:
                    yield flush()
        if held["ids"]:
            yield flush()
    return run


class Shard:
    """One shard's arrays: words, and its distinct bigrams in the order of their keys."""

    def __init__(self, path: str, pairs: bool = True):
        x = load(path)
        self.vocab, self.tokens, self.count = (unpack(x[k].tobytes()) for k in ("vocab", "tokens", "count"))
        self.id, self.no_id, self.out = x["id"], x["no_id"], x["out"]
        self.first = np.cumsum(self.count) - self.count
        self.trains = np.repeat(~self.out, self.count)
        if not pairs:
            return
        size = len(self.vocab) + 1
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = size - 1  # the begin of a text, after the words
        code, self.pair = np.unique(before * size + self.tokens, return_inverse=True)
        self.contexts = np.append(self.vocab, BEGIN)
        key = T.mix64(self.contexts[code // size] * _PAIR + self.vocab[code % size])
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[self.pair]
        self.keys, self.context, self.word = key[order], (code // size)[order], (code % size)[order]


def _requests(x: dict, ranges: int, keys: np.ndarray, *values: bytes):
    """Rows of one shard's request, cut at the key ranges; ``values`` are (pack, array) pairs."""
    width = (1 << 64) // ranges + 1
    cuts = np.searchsorted(keys, np.array([i * width for i in range(1, ranges)], np.uint64))
    cuts = np.concatenate(([0], cuts, [len(keys)]))
    for i in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[i], cuts[i + 1])
        cols = [pack(v[s]) for pack, v in values] + [None] * (3 - len(values))
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int64()), pa.array([x["shard"]], pa.int64()), pa.array([pack_sorted(keys[s])], pa.binary()),
             *(pa.array([c], pa.binary()) for c in cols)], names=["range", "shard", "keys", "a", "b", "c"])


def _word_requests(ranges: int):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                s = Shard(x["path"], pairs=False)
                n = np.bincount(s.tokens[s.trains], minlength=len(s.vocab))
                yield from _requests(x, ranges, s.vocab, (pack_ints, n))
    return run


def _pair_requests(ranges: int):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                s = Shard(x["path"])
                n = np.bincount(s.pair[s.trains], minlength=len(s.keys))
                yield from _requests(x, ranges, s.keys, (pack_ints, n))
    return run


def _gathered(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, int]:
    """A group's rows in shard order, the place of each asked key among the distinct ones, and cuts by row."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    keys = [unpack(r["keys"]) for r in rows]
    kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
    return rows, place, np.concatenate(([0], np.cumsum([len(k) for k in keys]))), len(kinds)


def _add_counts(table: pa.Table) -> pa.Table:
    """Global training count of each key; the first shard that trains on a key owns it."""
    rows, place, cut, kinds = _gathered(table)
    n = np.concatenate([unpack(r["a"]) for r in rows])
    total = np.bincount(place, n, kinds).astype(np.int64)
    own = np.zeros(len(place), np.int64)
    seen = np.flatnonzero(n)
    own[seen[np.unique(place[seen], return_index=True)[1]]] = 1
    hist = np.bincount(total[total <= KATZ_K + 1], minlength=KATZ_K + 2)[1:].tolist() + [int((total > 0).sum())]
    out = [{"range": r["range"], "shard": r["shard"], "n": pack_ints(total[place[cut[i]:cut[i + 1]]]),
            "own": pack_ints(own[cut[i]:cut[i + 1]]), "hist": hist if i == 0 else None, "total": int(total.sum()) if i == 0 else 0}
           for i, r in enumerate(rows)]
    return pa.Table.from_pylist(out, pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("n", pa.binary()),
                                                ("own", pa.binary()), ("hist", pa.list_(pa.int64())), ("total", pa.int64())]))


# --- discounts ------------------------------------------------------------------------------

def discounts(counts_of_counts: list[int], k: int = KATZ_K) -> np.ndarray:
    """d(r) for r = 0 .. k (larger counts: 1).

    The largest cut-off up to ``k`` at which Katz's Good-Turing discounts all lie
    strictly between 0 and 1; where none does (small or odd tables), absolute discounting of every count up to k.
    """
    n = [0, *counts_of_counts]
    for top in range(k, 0, -1):
        if any(n[r] == 0 for r in range(1, top + 2)):
            continue
        tail = (top + 1) * n[top + 1] / n[1]
        if tail >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, top + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([0.0, *d, *[1.0] * (k - top)])
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.array([0.0, *[(r - cut) / r for r in range(1, k + 1)]])


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c."""
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c


class Unigram:
    """P(w) from a word's training count; the unseen word has count 0."""

    def __init__(self, n: int, kinds: int, hist: list[int]):
        self.n, self.kinds, self.d = n, kinds, discounts(hist)
        kept = sum(h * (r - self.d[r] * r) for r, h in enumerate(hist[:KATZ_K], 1))
        # Without counts up to KATZ_K nothing is discounted: one more token, unseen, is assumed.
        self.total, self.unseen = (n, kept / n) if n and kept > 0 else (n + 1, 1 / (n + 1))

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.unseen)


# --- contexts and scores --------------------------------------------------------------------

def _answer(parts: list[dict], field: str) -> np.ndarray:
    return np.concatenate([unpack(p[field]) for p in sorted(parts, key=lambda p: p["range"])])


def _context_requests(ranges: int, unigram: Unigram, d2: np.ndarray):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                s = Shard(x["path"])
                p = unigram(_answer(x["words_answer"], "n"))
                c, own = _answer(x["pairs_answer"], "n"), _answer(x["pairs_answer"], "own")
                mine = np.flatnonzero(own)
                at, n = s.context[mine], len(s.contexts)
                order = np.argsort(s.contexts, kind="stable")
                sums = [np.bincount(at, v, n)[order] for v in (p[s.word[mine]], discounted(c[mine], d2), c[mine])]
                yield from _requests(x, ranges, s.contexts[order], (pack_floats, sums[0]), (pack_floats, sums[1]),
                                     (pack_ints, sums[2].astype(np.int64)))
    return run


def _add_contexts(table: pa.Table) -> pa.Table:
    """alpha of each context, and the count its seen successors are divided by."""
    rows, place, cut, kinds = _gathered(table)
    p, kept, c = (np.bincount(place, np.concatenate([unpack(r[k]) for r in rows]), kinds) for k in "abc")
    full = kept > c * (1 - 1e-12)
    over = np.where(full, c + 1, c)
    alpha = np.where(c > 0, (1 - kept / np.maximum(over, 1)) / np.maximum(1 - p, 1e-300), 1.0)
    out = [{"range": r["range"], "shard": r["shard"], "alpha": pack_floats(alpha[place[cut[i]:cut[i + 1]]]),
            "over": pack_ints(over[place[cut[i]:cut[i + 1]]].astype(np.int64))} for i, r in enumerate(rows)]
    return pa.Table.from_pylist(out, pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("alpha", pa.binary()),
                                                ("over", pa.binary())]))


def _score_rows(unigram: Unigram, d2: np.ndarray):
    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                s = Shard(x["path"])
                word_n = _answer(x["words_answer"], "n")
                order = np.argsort(s.contexts, kind="stable")
                alpha, over = np.empty(len(order)), np.empty(len(order))
                alpha[order], over[order] = _answer(x["contexts_answer"], "alpha"), _answer(x["contexts_answer"], "over")
                c = _answer(x["pairs_answer"], "n")
                seen = c > 0
                lower = unigram(word_n)[s.word]
                p = np.where(seen, discounted(c, d2) / np.maximum(over[s.context], 1), alpha[s.context] * lower)
                base = np.log10((word_n + ADD) / (unigram.n + ADD * (unigram.kinds + 1)))
                sums = [np.add.reduceat(v, s.first) for v in (np.log10(p)[s.pair], base[s.tokens],
                                                              (word_n > 0).astype(np.int64)[s.tokens])]
                n = len(s.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.id, mask=s.no_id), pa.array(s.out), pa.array(s.count), pa.array(sums[2]),
                     pa.array(np.full(n, unigram.n, np.int64)), pa.array(sums[1]), pa.array(sums[0])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def _per_shard(answers: DataFrame, name: str) -> DataFrame:
    """All answers to one shard in one row (a shard's size bounds it)."""
    fields = [c for c in answers.columns if c not in ("shard", "hist", "total")]
    return answers.groupBy("shard").agg(F.collect_list(F.struct(*fields)).alias(name))


def _totals(answers: DataFrame) -> tuple[int, int, list[int]]:
    """(sum of counts, distinct keys seen, counts of counts 1 .. KATZ_K + 1): a dozen numbers."""
    rows = (answers.where("hist is not null").select("total", F.posexplode("hist").alias("r", "n"))
            .groupBy("r").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("r").collect())
    if not rows:
        return 0, 0, [0] * (KATZ_K + 1)
    return rows[0].total, rows[-1].n, [r.n for r in rows[:-1]]


def katz_scores(docs: DataFrame, modulus: int = 10, fold: int = 0, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    workers_import(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, modulus, fold).alias("out"),
                      F.col(text_col).cast("string").alias("text"))
    shards = materialise(map_arrow(src, _shard_rows(scratch_path(spark, "lm-shards")),
                                   "shard long, path string, words long, tokens long"), "lm-manifest")
    n_words, n_tokens = shards.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    few = tasks(spark)
    word_ranges, pair_ranges = (max(few, -(-n // GROUP_KEYS)) for n in (n_words, n_tokens))
    spread = lambda df: df.repartition(few, "shard")

    def answered(requests, add, schema, name):
        return materialise(requests.groupBy("range").applyInArrow(add, schema), name)
    words = answered(map_arrow(spread(shards), _word_requests(word_ranges), _REQUEST), _add_counts, _ANSWER, "lm-words")
    pairs = answered(map_arrow(spread(shards), _pair_requests(pair_ranges), _REQUEST), _add_counts, _ANSWER, "lm-pairs")
    unigram, d2 = Unigram(*_totals(words)), discounts(_totals(pairs)[2])

    known = (shards.join(_per_shard(words, "words_answer"), "shard").join(_per_shard(pairs, "pairs_answer"), "shard"))
    contexts = answered(map_arrow(spread(known), _context_requests(word_ranges, unigram, d2), _REQUEST), _add_contexts,
                        "range long, shard long, alpha binary, over binary", "lm-contexts")
    known = known.join(_per_shard(contexts, "contexts_answer"), "shard")
    return map_arrow(spread(known), _score_rows(unigram, d2),
                     "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                     "base_score double, score double")
