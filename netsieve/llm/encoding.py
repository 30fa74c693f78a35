"""Token ids of many texts through a tokenizer file, encoding each distinct word once per worker.

A byte-pair tokenizer splits a text into pre-tokens before any merge, so a
text cut only where its pre-tokenizer always splits gives the same ids piece
by piece.  Pieces are told apart by their bytes.  Two such rules are recognised from the tokenizer file:

``white``  the pre-tokens are matches that never contain white space: cut at
           every run of ASCII white space;
``space``  byte-level pre-tokens, in which one space may lead a pre-token but
           never follow anything else in it: cut before a space whose next
           character is not white space.  No pre-token goes on from a letter
           to a punctuation mark either, and a line feed before a character
           that is not white space stands alone: cut there too, so that words
           with and without a mark after them are one piece.

Any other tokenizer encodes each text whole.  Distinct pieces are encoded by
the tokenizers library; their ids are kept in a bounded table of the worker.
"""

from __future__ import annotations

import json
import os
import string
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from netsieve.llm import textarrays as T
from netsieve.llm.storage import worker_tables

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker knows at most; when they are full, those met again since they came stay (half of the room at most).
MEMO_PIECES = 250_000
#: New pieces joined into one text for the tokenizer.
JOINED = 2000
#: First bytes of the UTF-8 characters that Unicode counts as white space.
_WIDE_SPACE = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
#: ASCII letters, and ASCII marks that are neither letter, digit nor white space.
_LETTER = np.isin(np.arange(256), np.frombuffer(string.ascii_letters.encode(), np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))
_MATCHED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = {"NFC", "Replace", "Lowercase"}


def cut_rule(config: dict) -> str | None:
    """Which rule the tokenizer's own configuration proves, if any."""
    norm, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "space"
    parts, steps = pre.get("pretokenizers") or [], (norm or {}).get("normalizers") or []
    split = parts[0] if parts else {}
    if (all(s["type"] in _NORMALISERS for s in steps) and split.get("type") == "Split" and split.get("invert")
            and split.get("behavior") == "Removed" and split.get("pattern") == {"Regex": _MATCHED_WORDS}
            and all(p["type"] == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in parts[1:])):
        return "white"
    return None


class Encoder:
    """Ids of slices of texts; one per tokenizer file and worker process."""

    def __init__(self, path: str):
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.rule = self.marks = None
        else:
            from tokenizers import Tokenizer
            self.model = Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
            self.rule = cut_rule(config)
            self.marks, self.unsure = _free_marks(config), _unsure(config)
        self.token_bytes = self._token_bytes() if self.rule == "space" else None
        self._forget()

    def _forget(self):
        self.known: dict[bytes, int] = {}    # row of each piece in the three arrays below
        self.at = np.empty(0, np.int64)      # of each piece's first id in self.ids
        self.size = np.empty(0, np.int64)
        self.met = np.empty(0, bool)         # again, after the slice it came with
        self.ids = np.empty(0, np.uint32)

    def _make_room(self):
        """Forget the pieces met only once; all of them if that leaves little room."""
        keep = np.flatnonzero(self.met)
        size = self.size[keep]
        if len(keep) > MEMO_PIECES // 2 or int(size.sum()) > 4 * MEMO_PIECES:
            self._forget()
            return
        to = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.at[keep] - to, size) + np.arange(int(size.sum()))]
        row = np.full(len(self.at), -1, np.int64)
        row[keep] = np.arange(len(keep))
        row = row.tolist()
        self.known = {p: row[i] for p, i in self.known.items() if row[i] >= 0}
        self.at, self.size, self.met = to, size, np.zeros(len(keep), bool)

    def _token_bytes(self) -> np.ndarray:
        """Bytes of each id: byte-level tokens have one letter a byte, added ones stand as they are."""
        out = np.zeros(self.model.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.model.get_vocab(with_added_tokens=True).items():
            out[i] = len(token)
        for i, added in self.model.get_added_tokens_decoder().items():
            out[i] = len(added.content.encode())
        return out

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids as the library gives them, each text in one call."""
        if self.sentencepiece:
            return self.model.encode(texts, num_threads=1) if texts else []
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, t: T.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first piece of each text)."""
        if self.rule == "white":
            return T.words(t)
        buf, n = t.buf, len(t.buf)
        cut = np.zeros(n, bool)
        nxt = buf[1:]
        cut[:-1] = (buf[:-1] == 0x20) & ~self.unsure[nxt]
        cut[t.offsets[t.offsets < n]] = True
        last = t.offsets[1:][t.offsets[1:] > 0] - 1   # a space at a text's end leads nothing
        first = np.zeros(n, bool)
        first[t.offsets[t.offsets < n]] = True
        cut[last] &= first[last]
        if self.marks is not None:
            cut[1:] |= _LETTER[buf[:-1]] & self.marks[nxt]
            alone = (buf[:-1] == 0x0A) & ~self.unsure[nxt]
            alone[last[last < n - 1]] = False
            cut[:-1] |= alone
            cut[1:] |= alone
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, t.offsets)

    def slice(self, t: T.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        n = len(t.offsets) - 1
        if self.rule is None:
            got = self.whole([bytes(t.buf[a:b]).decode() for a, b in zip(t.offsets, t.offsets[1:])])
            return (np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64))
        starts, ends, first = self._pieces(t)
        which, distinct = T.span_codes(t.buf, starts, ends)
        at, size = self._known(distinct)
        count = size[which]
        total = int(count.sum())
        before = np.cumsum(count) - count
        ids = self.ids[np.repeat(at[which] - before, count) + np.arange(total)]
        upto = np.concatenate((before, [total]))
        return ids, upto[first[1:]] - upto[first[:-1]]

    def _known(self, distinct: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each distinct piece, encoding those not seen before."""
        if len(self.known) + len(distinct) > MEMO_PIECES or len(self.ids) > 8 * MEMO_PIECES:
            self._make_room()
        pieces, leads = _taken_apart(distinct, self.unsure)
        row = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.met[row[row >= 0]] = True
        new = np.flatnonzero(row < 0)
        if len(new):
            lead = leads[new]
            new = np.concatenate([new[lead], new[~lead]])
            fresh = [pieces[i] for i in new.tolist()]
            ids, size = self._encoded(fresh, int(lead.sum()))
            at = len(self.ids) + np.cumsum(size) - size
            row[new] = len(self.at) + np.arange(len(new))
            self.known.update(zip(fresh, row[new].tolist()))
            self.ids = np.concatenate([self.ids, ids])
            self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])
        return self.at[row], self.size[row]

    def _encoded(self, pieces: list[bytes], leading: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids in order, number of ids of each piece); the ``leading`` first ones lead with a space.

        Under the rule ``space`` those are joined into long texts, which the
        tokenizer splits again exactly there; the known byte length of every
        token gives each piece its ids.
        """
        joined = leading if self.token_bytes is not None else 0
        texts = [b"".join(pieces[i:min(i + JOINED, joined)]).decode() for i in range(0, joined, JOINED)]
        ids = np.fromiter(chain.from_iterable(self.whole(texts)), np.uint32)
        ends = np.cumsum(self.token_bytes[ids]) if joined else np.empty(0, np.int64)
        stop = np.cumsum(np.fromiter(map(len, pieces[:joined]), np.int64, joined))
        last = np.searchsorted(ends, stop)
        if joined and not (last[-1] == len(ends) - 1 and np.array_equal(ends[last], stop)):
            joined, ids, last = 0, ids[:0], last[:0]       # some token does not have its listed length
        got = self.whole([p.decode() for p in pieces[joined:]])
        size = np.concatenate([np.diff(last, prepend=-1), np.fromiter(map(len, got), np.int64, len(got))]).astype(np.int64)
        return np.concatenate([ids, np.fromiter(chain.from_iterable(got), np.uint32)]), size


def _taken_apart(distinct: pa.LargeBinaryArray, unsure: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The pieces, and which of them are a space, then a character that is not white space: always the start of a pre-token."""
    n, (_, offsets, data) = len(distinct), distinct.buffers()
    offsets = np.frombuffer(offsets, np.int64)[distinct.offset:distinct.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    raw, cut = data.tobytes(), offsets.tolist()
    leads = np.diff(offsets) > 1
    at = offsets[:-1][leads]
    leads[leads] = (data[at] == 0x20) & ~unsure[data[at + 1]]
    return [raw[a:b] for a, b in zip(cut, cut[1:])], leads


def _unsure(config: dict) -> np.ndarray:
    """First bytes of white space and of added tokens, which the library takes out of a text before it splits the rest."""
    found = T.WHITE | _WIDE_SPACE
    found[[token["content"].encode()[0] for token in config.get("added_tokens") or [] if token["content"]]] = True
    return found


def _free_marks(config: dict) -> np.ndarray | None:
    """Which bytes are marks that follow no letter inside an added token; None if an added token looks at its surroundings."""
    marks = _MARK.copy()
    for token in config.get("added_tokens") or []:
        if token.get("single_word") or token.get("lstrip") or token.get("rstrip") or "\n" in token["content"]:
            return None
        b = np.frombuffer(token["content"].encode(), np.uint8)
        marks[b[1:][_LETTER[b[:-1]]]] = False
    return marks


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; tasks that ``map_arrow`` runs without ``keeps_tables`` drop it."""
    name = f"encoder {path}"
    if name not in worker_tables:
        worker_tables[name] = Encoder(path)
    return worker_tables[name]
