"""Words of many texts as numpy arrays: positions, counts and 64-bit hashes, no per-word Python.

A slice is a run of documents of about ``SLICE_BYTES`` of UTF-8 (a longer
document is a slice of its own), so the arrays of a slice stay small.
NULL texts count as empty.  Letters A-Z fold to a-z, other characters keep
their bytes; separators are ASCII, so UTF-8 sequences are never cut.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096

_BYTES = np.arange(256)
#: True for the bytes that separate words: space and \t \n \v \f \r.
WHITE = np.isin(_BYTES, (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
_FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_FOLDED_BYTE = _FOLDED.astype(np.uint8)
#: True for every byte that is not part of a run of letters.
NOT_LETTER = ~(((_FOLDED >= 97) & (_FOLDED <= 122)) | (_BYTES >= 128))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random 64-bit value per byte; a-z and A-Z share theirs in the folded table.
EXACT_CODE = mix64((_BYTES + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
FOLDED_CODE = EXACT_CODE[_FOLDED]
_P = 0x9E3779B97F4A7C55
_P_INV = pow(_P, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) > n:
        return _powers
    made = []
    for p in (_P, _P_INV):
        a = np.full(n + 1, p, U64)
        a[0] = 1
        made.append(np.cumprod(a))
    if n <= 4 * SLICE_BYTES:  # tables for a rare huge document are not kept
        _powers = (made[0], made[1])
    return made[0], made[1]


class Texts(NamedTuple):
    buf: np.ndarray      # bytes of all texts of the slice
    offsets: np.ndarray  # of each text in buf, n + 1


class Words(NamedTuple):
    starts: np.ndarray   # byte position of each word
    ends: np.ndarray
    first: np.ndarray    # index of each text's first word, n + 1


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS):
    """(first row, Texts) for runs of rows; every row is in exactly one run."""
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + max_rows)
        yield lo, Texts(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def words(t: Texts, separator: np.ndarray = WHITE) -> Words:
    """Maximal runs of non-separator bytes; a word never spans two texts."""
    inside = ~separator[t.buf]
    n = len(inside)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = t.offsets[(t.offsets < n)]
    before[inner] = False
    inner = t.offsets[(t.offsets > 0)] - 1
    after[inner] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, t.offsets))


def word_hashes(t: Texts, w: Words, code: np.ndarray = FOLDED_CODE) -> np.ndarray:
    """64-bit hash of each word's bytes: differences of one running polynomial sum (see ``exact_word_hashes``)."""
    return span_hashes(t.buf, w.starts, w.ends, code)


def exact_word_hashes(t: Texts, w: Words) -> np.ndarray:
    """64 bits of a cryptographic digest of each word, A-Z as a-z; each distinct word of the slice is digested once.

    For results that must be exact: ``span_hashes`` is a polynomial modulo
    2**64, which gives some pairs of very long words the same value.
    """
    which, distinct = span_codes(t.buf, w.starts, w.ends, folded=True)
    digest = hashlib.blake2b
    each = np.frombuffer(b"".join([digest(x, digest_size=8).digest() for x in distinct.to_pylist()]), "<u8")
    return each.astype(U64)[which] if len(which) else np.empty(0, U64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    n = len(buf)
    power, inverse = _power_tables(n)
    acc = np.zeros(n + 1, U64)
    np.cumsum(code[buf] * power[:n], out=acc[1:])
    h = (acc[ends] - acc[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def span_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(number of each span among the distinct ones, the distinct spans): equal numbers mean equal bytes.

    Spans are in order and do not overlap.  ``folded`` reads A-Z as a-z.
    """
    size = ends - starts
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)))
    data = buf
    if offsets[-1] != len(buf):
        step = np.zeros(len(buf) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        data = buf[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    if folded:
        data = _FOLDED_BYTE[data]
    spans = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def shingle_sets(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: (sorted 52-bit hashes, text index of each).

    A text with fewer than ``size`` words has its whole word sequence as its
    only shingle; one without words has none.
    """
    w = words(t)
    h = exact_word_hashes(t, w)
    n_docs, counts = len(t.offsets) - 1, np.diff(w.first)
    n_sh = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(n_docs), n_sh)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + w.first[:-1][doc]
    length = np.minimum(counts, size)[doc]
    s = mix64(length.astype(U64))
    for k in range(size):
        use = length > k
        word = h[np.where(use, at + k, at)]
        s = np.where(use, mix64(s * U64(0x9FB21C651E98DF25) + word), s)
    # Texts of a slice number at most SLICE_ROWS = 2**12: text and hash share one sort key.
    key = np.sort((doc.astype(U64) << U64(52)) | (s >> U64(12)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U64((1 << 52) - 1), (key >> U64(52)).astype(np.int64)


def crc32_of_ids(ids: np.ndarray) -> np.ndarray:
    """crc32 of each integer's decimal text."""
    return np.fromiter((zlib.crc32(b"%d" % i) for i in ids.tolist()), np.int64, len(ids))
