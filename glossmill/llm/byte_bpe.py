"""Byte-level BPE by a sentencepiece model serialised from a rank file.

Every byte maps to one printable character, so a piece is a string without white
space; a piece's score is its negative rank, which makes sentencepiece join the pair of
lowest rank first, the leftmost of equals, as rank-driven BPE does.  The normaliser is
the identity.  Text is cut by the split pattern and each match encoded by itself; a
match that is a token whole is taken whole.  Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from glossmill.llm.common import single_thread, text_strings, tokenizer_file

#: Pre-tokens remembered by a Python worker; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Characters of a long text that are split at a time.
PIECE_CHARS = 1 << 20
_BLANK = re.compile(r"(?<=\S) (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A distinct printable character for each byte: itself where printable, else from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the id after them is <unk>."""
    shown = byte_characters()
    pieces = sorted((rank, "".join(shown[b] for b in token)) for token, rank in ranks.items())
    if [rank for rank, _ in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    normal, unknown, bpe, none = 1, 2, 2, -1
    body = [_field(1, _field(1, piece.encode()) + _field(2, float(-rank)) + _field(3, normal)) for rank, piece in pieces]
    body.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(n, none) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(body) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex
        import sentencepiece

        single_thread()
        self.ranks = load_ranks(path)
        self._cuttable = pattern is None
        self._split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self._shown = {b: c for b, c in enumerate(byte_characters())}
        self._token = [b""] * len(self.ranks)
        for token, rank in self.ranks.items():
            self._token[rank] = token
        self._decimal = [b"%d" % i for i in range(len(self.ranks))]
        self._known: dict[str, tuple[int, ...]] = {}

    def _learn(self, pre_tokens: list[str]) -> None:
        known, ranks = self._known, self.ranks
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for p in pre_tokens if p not in known})
        split: list[str] = []
        for p in new:
            whole = ranks.get(p.encode())
            if whole is None:
                split.append(p)
            else:
                known[p] = (whole,)
        shown = [p.encode().decode("latin-1").translate(self._shown) for p in split]
        for p, ids in zip(split, self._model.encode(shown, num_threads=1) if shown else [], strict=True):
            known[p] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._encode(piece) for piece in self.pieces(text)))

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in parts that the default pattern splits as it does the whole.

        It always starts a match at a single blank between two other characters.
        """
        start = 0
        while self._cuttable and len(text) - start > PIECE_CHARS:
            cut = _BLANK.search(text, start + PIECE_CHARS)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def _encode(self, text: str) -> list[int]:
        pre_tokens = self._split(text)
        try:
            found = list(map(self._known.__getitem__, pre_tokens))
        except KeyError:
            self._learn(pre_tokens)
            found = list(map(self._known.__getitem__, pre_tokens))
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._token.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        return hashlib.sha256(b",".join(map(self._decimal.__getitem__, ids))).hexdigest()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One encoder for a Python worker: the pre-tokens it remembers serve all its tasks."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, ranks_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if wanted.

    Whole texts are encoded; a null or empty text has no ids.  The decoded bytes are
    the text's own UTF-8.  Rows map one to one, repeated ids, texts and ties included;
    null ids are carried; very long texts are split in pieces that don't change the ids;
    other columns, of whatever names, are ignored; an empty table gives an empty result.
    """
    path = ranks_file or tokenizer_file("byte_bpe_multi_50k.tiktoken")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns: list[list] = [[] for _ in schema]
                for text in text_strings(part.column("text")):
                    ids = bpe.encode(text)
                    row = [len(ids), bpe.digest(ids), hashlib.sha256(bpe.decode(ids)).hexdigest()] + [ids] * with_ids
                    for column, value in zip(columns[1:], row, strict=True):
                        column.append(value)
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True))], schema=schema)

    source = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
