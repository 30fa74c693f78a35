"""Pieces that a worker encodes, and the tables it keeps between tasks."""

import random

import numpy as np
import pyarrow as pa

from netsieve.llm import encoding, storage
from netsieve.llm import textarrays as T
from netsieve.llm.queries import tokenizer_path

PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\x85", "\x0b", "\x1c", "a", "Zb", "don", "'s", "'", "1", "23",
         "́", "é", "日", ".", "...", "!?", "|", "<|endoftext|>", "endoftext", "<|", "|>", "_", "$", "\U0001f600", "\0", "\n ", " \n"]


def ids_of(e, texts):
    out = []
    for _, t in T.slices(pa.array(texts, pa.string())):
        ids, count = e.slice(t)
        out += [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]
    return out


def test_fine_pieces_equal_whole_texts_on_odd_neighbours():
    r, e = random.Random(5), encoding.encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    assert ids_of(e, texts) == e.whole(texts)


def test_words_with_and_without_marks_are_one_piece():
    e = encoding.Encoder(tokenizer_path("byte_bpe_50k.json"))
    words = [f" {a}{b}qz" for a in "bcdfg" for b in "hjklm"]
    texts = ["x" + mark.join(words) + mark for mark in ("", ".", ",", "!?", "$$$", ";\n")]
    assert ids_of(e, texts) == e.whole(texts)
    assert len(e.known) <= len(words) + 10


def test_a_task_of_another_operator_drops_worker_tables():
    storage.worker_tables.clear()
    first = encoding.encoder(tokenizer_path("byte_bpe_50k.json"))
    seen = []

    def task(batches):
        seen.append(len(storage.worker_tables))
        yield from batches
    assert list(storage._lean(task, True)(iter([1]))) == [1] and encoding.encoder(tokenizer_path("byte_bpe_50k.json")) is first
    assert list(storage._lean(task, False)(iter([2]))) == [2] and seen == [1, 0]
    assert not storage.worker_tables
