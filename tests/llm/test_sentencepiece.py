"""Agenda merges against the sentencepiece library."""

import hashlib
import random

import pytest
from llm_fixtures import SF_SMALL, no_docs, odd_docs, prose  # noqa: F401

from netsieve.llm import op11_sentencepiece as S
from netsieve.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def test_random_texts_and_ids_equal_the_library():
    m, r = S.Pieces(MODEL), random.Random(1)
    letters = " ▁abcé\n\t\0😀<0A>ñ中ﬁ​﻿ththeing "
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert m.encode(text) == m.library.encode(text), text
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(259, 31999), 259]) for _ in range(r.randint(0, 8))]
        assert m.decode(ids) == m.library.decode(ids), ids


def test_merging_whole_texts_equals_merging_stretches(prose):
    m = S.Pieces(MODEL)
    whole = S.Pieces(MODEL)
    whole.separable = False
    for text in (prose(300, 1), "a" * 5000, "  x   y ", " " * 100, "ab" * 3000 + " c"):
        assert m.encode(text) == whole.encode(text) == m.library.encode(text)


def test_the_check_finds_a_wrong_merge(prose):
    m = S.Pieces(MODEL)
    texts = [prose(40, k) + "\n" + prose(5, 90 + k) + "  é▁x \n\n y " for k in range(20)]
    decoded = [m.decode(m.encode(t)) for t in texts]
    m.check_fresh()
    assert not m.differing and all(m.agrees(t, d) for t, d in zip(texts, decoded))
    for after_line_end in (False, True):
        m = S.Pieces(MODEL)
        word = "quickly" if after_line_end else "▁quickly"
        m.pair_rank = {k: -r for k, r in m.pair_rank.items()}
        text = "\nquickly" if after_line_end else "quickly"
        m.encode(text), m.check_fresh()
        assert m.differing == {word} and not m.agrees(text, text) and m.agrees("y", "y") and not m.agrees("y", "z")


def test_models_of_other_kinds_are_refused(monkeypatch):
    with pytest.raises((OSError, RuntimeError, ValueError)):
        S.Pieces(tokenizer_path("word_bpe_49k.json"))


def test_query_equals_the_library_on_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    rows = S.digests(odd_docs, MODEL).collect()
    lib = S.Pieces(MODEL).library
    want = []
    for d in odd_docs.select("doc_id", "text").collect():
        ids = lib.encode(d.text or "")
        want.append((d.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids).encode()).hexdigest(), True))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert S.digests(no_docs, MODEL).count() == 0
    full = S.encoded(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), MODEL)
    assert full.where("not agrees").count() == 0 and full.count() == 200
