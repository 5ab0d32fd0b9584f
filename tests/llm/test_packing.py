"""Packing: tokens as the library gives them, cuts, places, and how full sequences get."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glossmill.llm.packing import OpenBins, PieceTokenizer, cut_lengths, pack_documents, splits_at_space

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return PieceTokenizer(PATH)


PARTS = ["a", "'s", "'", "x1", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "\r\n", "!", "...", "日本", "\U0001f600", "\x00", "'ll", "Wort"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_ids_are_the_librarys(library, own, parts):
    text = "".join(parts)
    assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=9), max_size=8))
def test_ids_of_many_texts(library, own, parts):
    texts = ["".join(p) for p in parts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.texts([t.encode() for t in texts])] == [library(t) for t in texts]


def test_long_texts_are_worked_in_parts(library, own, monkeypatch):
    monkeypatch.setattr("glossmill.llm.packing.PART_BYTES", 10)
    text = "Ein  Satz,\n\n der   länger ist.\t\t x " * 20
    assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library(text)


def test_other_vocabularies_are_not_cut(tmp_path, library):
    with open(PATH, encoding="utf-8") as f:
        parts = json.load(f)
    assert splits_at_space(parts)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": parts["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": None}):
        assert not splits_at_space(parts | change)
    parts["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(parts))
    text = "no blank  first"
    assert np.frombuffer(PieceTokenizer(str(path)).encode(text.encode()), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_cuts():
    assert cut_lengths(1, 4) == [1] and cut_lengths(4, 4) == [4] and cut_lengths(5, 4) == [1, 4] and cut_lengths(12, 4) == [4, 4, 4] and cut_lengths(11, 4) == [3, 4, 4]


class PlainBins:
    """The same rule by looking at every open sequence."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.free, self.made = capacity, most, [], 0

    def place(self, length):
        fitting = [(f, -at, n) for n, f, at in self.free if f >= length]
        if fitting:
            free, _, number = min(fitting)
            self.free = [x for x in self.free if x[0] != number]
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if free - length:
            if len(self.free) >= self.most:
                fullest = min(self.free, key=lambda x: (x[1], -x[2]))
                self.free.remove(fullest)
            self.clock = getattr(self, "clock", 0) + 1
            self.free.append((number, free - length, self.clock))
        return number, free


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 6))
def test_best_fit_by_bitset(lengths, most):
    fast, plain = OpenBins(16, most), PlainBins(16, most)
    for length in lengths:
        assert fast.place(length) == plain.place(length)
        assert fast.open <= most


def check(rows, texts, library, capacity, end_id=0):
    """Rows (dicts) of documents {doc_id: text} are whole, and sequences gapless."""
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append(r)
    assert set(per_doc) == set(texts)
    for doc_id, pieces in per_doc.items():
        ids = np.asarray([*library(texts[doc_id] or ""), end_id], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        start = 0
        for k, (r, length) in enumerate(zip(pieces, cut_lengths(len(ids), capacity), strict=True)):
            assert (r["piece"], r["start"], r["length"]) == (k, start, length)
            assert r["ids_crc32"] == zlib.crc32(ids[start : start + length].tobytes())
            start += length
        assert start == len(ids)
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_pack(spark, make_docs, odd_texts, library):
    rng = random.Random(3)
    texts = [*odd_texts, *(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))) for _ in range(200))]
    rows = [r.asDict() for r in pack_documents(make_docs(texts), capacity=64, stream_pieces=500).collect()]
    check(rows, dict(enumerate(texts)), library, 64)
    used, total = len({r["sequence_id"] for r in rows}), sum(r["length"] for r in rows)
    assert used <= 1.02 * total / 64 + 2 * (1 + len(rows) // 500)


def test_ids_can_be_kept(spark, make_docs, library):
    (row,) = pack_documents(make_docs(["some text"]), with_ids=True).collect()
    assert row["ids"] == [*library("some text"), 0] and row["offset"] == 0


def test_repeated_rows_and_null_ids(spark, make_docs):
    """Thousands of equal rows are spread over the streams, and each is packed."""
    rows = pack_documents(make_docs([(None, "the same text", "en", "s")] * 4000), capacity=32, stream_pieces=500).collect()
    length = rows[0]["length"]
    assert len(rows) == 4000 and all(r["doc_id"] is None and r["piece"] == 0 for r in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4000
    streams = defaultdict(int)
    for r in rows:
        streams[r["sequence_id"] >> 32] += 1
    assert len(streams) == 8 and max(streams.values()) < 700
    assert len({r["sequence_id"] for r in rows}) <= 4000 // (32 // length) + 8


def test_empty_table(spark, make_docs):
    assert pack_documents(make_docs([])).collect() == []
