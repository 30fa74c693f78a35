"""SentencePiece ids of whole texts by merges from a score-ordered agenda, and their texts again.

For merge-type (BPE) vocabularies.  The normalised text starts as single
characters.  The agenda is a heap of the adjacent pairs whose concatenation is
a piece of the vocabulary, best score first and leftmost among equals.  The
best pair is merged, the two pairs it now forms with its neighbours join the
agenda, and entries whose symbols have changed since are skipped.  Characters
that are no piece become their UTF-8 bytes' pieces (byte fallback), else one
unknown id for each run of them.

A text is cut before a space mark that follows another character when the
vocabulary proves that no merge spans that place (no piece has a space mark
after another character), and around ASCII characters in no piece, such as
line ends.  Merges of different stretches never touch, so each
distinct stretch, compared as a string, is merged once per worker and kept in
two bounded tables, a young and an old one.  Other vocabularies are merged over the whole text.

Every Arrow batch is checked against the sentencepiece library: it must give
the same ids for every stretch merged anew (for the whole text where the
vocabulary cannot be cut), and the ids must decode to the text itself.
``agrees`` says so for each row.  Checking whole texts instead took about a
quarter of the time; the tests do it.

Defined cases: NULL and empty texts have no ids and decode to the empty text;
NULL or repeated ids keep their rows; other columns are ignored; an empty
table gives an empty result.  Models that are not merge-type, or that hold
user-defined or unused pieces, a character map or space trimming, raise.
"""

from __future__ import annotations

import re
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.storage import map_arrow

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
MEMO_STRETCHES = 400_000
#: Longer stretches are merged each time: the table stays small.
MEMO_CHARS = 64
BATCH_CHARS = 1 << 20
#: Stretches up to here keep their agenda in a list instead of a heap.
SHORT_CHARS = 40
_NO_PAIR = 1 << 40
_GONE = -1
#: Characters in no piece are numbered downwards from here, so far below zero that no pair with them is a key.
_FIRST_LONE = -(1 << 60)


class Pieces:
    """A merge-type vocabulary, read from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError(f"{path}: not a merge-type model")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path}: only plain normalisation is supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: user-defined or unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.names = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        scores = sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {p: place[model.pieces[i].score] for p, i in self.ids.items()}
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_id = {b: i for i, b in self.byte_of.items()} if model.trainer_spec.byte_fallback else {}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        shown = [UNKNOWN_TEXT if i == self.unknown else "" if i in self.control else p.replace(SPACE, " ")
                 for i, p in enumerate(self.names)]
        self.bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(shown)]
        self.separable = SPACE in self.ids and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.symbol = dict(self.ids)   # characters that only occur inside pieces get numbers past the vocabulary
        self.inner = {}
        for c in sorted(set("".join(self.ids)) - set(self.ids)):
            self.symbol[c] = len(self.names) + len(self.inner)
            self.inner[self.symbol[c]] = c
        outside = "".join(c for c in map(chr, range(128)) if c not in self.symbol and c != " ")   # no merge touches them
        self.outside, lone = outside[:1], re.escape(outside)
        self.stretch = re.compile(f"[{lone}]|{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" if lone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.width = len(self.names) + len(self.inner)
        self.pair_rank, self.pair_made = self._pair_tables()
        self._memo: dict[str, list[int]] = {}
        self._old: dict[str, list[int]] = {}
        self.fresh: list[tuple[str, list[int]]] = []   # merged since the last check
        self.differing: set[str] = set()

    def _pair_tables(self) -> tuple[dict[int, int], dict[int, int]]:
        """Numbers of two adjacent symbols, as one key -> agenda rank, and -> number of the symbol they merge into."""
        rank, made = {}, {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left is not None and right is not None:
                    key = left * self.width + right
                    rank[key], made[key] = self.rank[piece], i
        return rank, made

    def _short(self, symbol: list[int]) -> list[int]:
        """Merges of a few symbols: the agenda is a list beside them, searched for its first least rank."""
        rank, made, width = self.pair_rank.get, self.pair_made, self.width
        agenda = [rank(a * width + b, _NO_PAIR) for a, b in zip(symbol, symbol[1:])]
        while agenda:
            best = min(agenda)
            if best == _NO_PAIR:
                break
            i = agenda.index(best)
            new = symbol[i] = made[symbol[i] * width + symbol[i + 1]]
            del symbol[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(new * width + symbol[i + 1], _NO_PAIR)
            if i:
                agenda[i - 1] = rank(symbol[i - 1] * width + new, _NO_PAIR)
        return symbol

    def _long(self, symbol: list[int]) -> list[int]:
        """Merges of many symbols: the agenda is a heap of (rank, place of the left symbol)."""
        n, width = len(symbol), self.width
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def offer(a: int, b: int) -> None:
            key = symbol[a] * width + symbol[b]
            if key in self.pair_rank:
                heappush(agenda, (self.pair_rank[key], a, key))
        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, key = heappop(agenda)
            b = after[a]
            if b >= n or symbol[a] * width + symbol[b] != key:
                continue               # a symbol has changed since
            symbol[a], symbol[b] = self.pair_made[key], _GONE
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                offer(a, c)
            if before[a] >= 0:
                offer(before[a], a)
        return [s for s in symbol if s != _GONE]

    def merged(self, text: str) -> list[int]:
        """Ids of the symbols left when the agenda is empty, in order."""
        lone = self.lone
        symbol = [self.symbol.get(c) or lone(c) for c in text]
        left = self._short(symbol) if len(text) <= SHORT_CHARS else self._long(symbol)
        if min(left) >= 0 and max(left) < len(self.names):
            return left
        out: list[int] = []
        for s in left:
            out.extend((s,) if 0 <= s < len(self.names) else self._unlisted(s))
        return out

    def lone(self, c: str) -> int:
        """A negative number for a character in no piece: it merges with nothing."""
        return self.symbol.get(c, _FIRST_LONE - ord(c))

    def _unlisted(self, s: int) -> list[int]:
        """Ids of a character that is no piece."""
        c = chr(_FIRST_LONE - s) if s < 0 else self.inner[s]
        return [self.byte_id[b] for b in c.encode()] if self.byte_id else [self.unknown]

    def _learn(self, stretch: str) -> list[int]:
        """Ids of a stretch that the young table lacks; stretches still in use move over from the old one."""
        ids = self._old.get(stretch)
        if ids is None:
            ids = self.merged(stretch)
            self.fresh.append((stretch, ids))
        if len(stretch) <= MEMO_CHARS:
            if len(self._memo) >= MEMO_STRETCHES:
                self._old, self._memo = self._memo, {}
            self._memo[stretch] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = self.prefix + text.replace(" ", SPACE)
        if not self.separable:
            ids = self._learn(marked)
        else:
            stretches = self.stretch.findall(marked)
            known = list(map(self._memo.get, stretches))
            if not all(known):
                known = [ids or self._learn(s) for ids, s in zip(known, stretches)]
            ids = list(chain.from_iterable(known))
        if self.byte_id or self.unknown not in ids:
            return ids
        return [i for k, i in enumerate(ids) if i != self.unknown or k == 0 or ids[k - 1] != self.unknown]

    def check_fresh(self) -> None:
        """Compare everything merged since the last call with the library; stretches that differ are remembered.

        The library puts its own space mark first; a stretch that begins
        without one is handed over behind a character outside the vocabulary.
        """
        texts, skip = [], []
        lead = self.library.encode(self.outside) if self.outside else []
        for stretch, _ in self.fresh:
            begins = stretch.startswith(self.prefix)
            texts.append(stretch[len(self.prefix):] if begins else self.outside + stretch)
            skip.append(0 if begins else len(lead))
        for (stretch, ids), library, k in zip(self.fresh, self.library.encode(texts, num_threads=1), skip):
            if library[k:] != ids and stretch != self.prefix:   # a lone space mark is no text of its own
                self.differing.add(stretch)
        self.fresh.clear()

    def agrees(self, text: str, decoded: str) -> bool:
        """Whether the library merges every stretch of the text alike and the ids gave the text back."""
        marked = self.prefix + text.replace(" ", SPACE)
        stretches = self.stretch.findall(marked) if self.separable else [marked]
        return self.differing.isdisjoint(stretches) and decoded.replace(" ", SPACE) == marked[len(self.prefix):]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: the added space goes, byte runs become characters or replacement marks."""
        if not ids or not self.control.isdisjoint(ids):
            return self._decode(ids)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self._decode(ids)
        return text[1:] if self.prefix and ids[0] != self.unknown and self.names[ids[0]].startswith(SPACE) else text

    def _decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        start = True
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_characters(raw))
                raw.clear()
                start = False
            if i in self.control:
                continue
            piece = UNKNOWN_TEXT if i == self.unknown else self.names[i]
            if start and self.prefix and i != self.unknown:
                piece = piece.removeprefix(SPACE)
            start = False
            out.append(piece if i == self.unknown else piece.replace(SPACE, " "))
        if raw:
            out.append(_characters(raw))
        return "".join(out)


def _characters(raw: bytearray) -> str:
    """UTF-8 characters; each byte that starts none becomes a replacement mark of its own."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        bad = e.start
        return raw[:bad].decode() + "�" + _characters(raw[bad + 1:])


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _runs(texts: list[str]):
    """(first, end) of runs of about BATCH_CHARS characters."""
    lo = size = 0
    for hi, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield lo, hi + 1
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))))


def _encode_rows(path: str):
    def run(batches):
        model = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _runs(texts):
                part = texts[lo:hi]
                ids = [model.encode(t) for t in part]
                decoded = [model.decode(i) for i in ids]
                model.check_fresh()
                if model.differing:
                    same = [model.agrees(t, d) for t, d in zip(part, decoded)]
                else:
                    same = [t == d or model.agrees(t, d) for t, d in zip(part, decoded)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), _lists(ids),
                     pa.array(decoded, pa.string()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "decoded", "agrees"])
    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded, agrees) of every whole text, without begin or end ids.

    Args:
        docs: rows with ``doc_id`` and ``text``.
        model: path of a merge-type sentencepiece model, the same on every worker.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _encode_rows(model), "doc_id long, ids array<int>, decoded string, agrees boolean")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agrees) of every document."""
    return encoded(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
