"""Best-fit packing of documents into sequences, with a bounded number of open bins.

Documents are tokenized whole; longer ones are cut so that all pieces but the first fill
a sequence.  Pieces are dealt at random into streams of some thousands, each in order of
length, the longest first.  A stream is packed online: a piece goes to the open sequence
that it leaves least space in, found in one bitset keyed by free space.  At most
`OPEN_BINS` sequences are open, whatever the stream's length; where one more is opened,
the fullest closes first.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import settle, single_thread, text_bytes, tokenizer_file

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 4096
#: Pieces in one stream, on average; each ends with some sequences that others' pieces could have filled.
STREAM_PIECES = 8192
#: Distinct runs of white space and letters whose ids a worker remembers.
REMEMBERED = 1_000_000
PART_BYTES = 1 << 20
#: Runs that are encoded as one text.
JOINED = 500
#: Text in work at a time.
WORK_BYTES = 4 << 20

_RUN = re.compile(rb"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+\Z")
#: White space beyond ASCII: a text with any is encoded whole.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_CUT = re.compile(rb"(?<=[^\x20\x09-\x0d])[\x20\x09-\x0d]")

#: Fixed value: the pre-tokenizer under which a run of white space always starts a pre-token.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _is_even(text: bytes) -> bool:
    """Whether a text's white space is single blanks and line ends, none at its ends."""
    flat = text.replace(b"\n", b" ")
    return not (b"  " in flat or flat[0] == 32 or flat[-1] == 32 or b"\t" in text or b"\r" in text or b"\v" in text or b"\f" in text)


def splits_at_space(parts: dict) -> bool:
    """Whether texts of a tokenizer file may be cut before any run of white space, and the parts' ids joined."""
    plain = not any(parts.get(k) for k in ("truncation", "padding", "post_processor", "normalizer"))
    added = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in parts["added_tokens"])
    return plain and added and parts["pre_tokenizer"] == BYTE_LEVEL and not parts["model"].get("dropout")


class PieceTokenizer:
    """Ids of whole texts as packed 32-bit numbers, as the tokenizers library gives them.

    Special tokens' strings in a text are special tokens, as is the library's default.
    Runs of white space with the letters after them are encoded once and remembered.
    """

    def __init__(self, path: str):
        single_thread()
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
            self.by_runs = splits_at_space(parts)
        added = {t["id"]: len(t["content"].encode()) for t in parts["added_tokens"]}
        self._known: dict[bytes, bytes] = {}
        # Bytes of each token: one for each character of its name, but for added ones.
        names = self._tokenizer.get_vocab()
        self._bytes = np.zeros(max(names.values(), default=0) + 1, np.int64)
        for name, i in names.items():
            self._bytes[i] = added.get(i, len(name))

    def _whole(self, text: bytes) -> bytes:
        return np.asarray(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, joined: list[bytes], single: list[bytes]) -> None:
        """Know the ids of all these runs, which are distinct.

        Those of `joined` begin with white space and end without, so they can follow one
        another in one text; its ids are parted where the bytes of its tokens reach a
        run's end.
        """
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        joined, single = ([r for r in runs if r not in known] for runs in (joined, single))
        for at in range(0, len(joined), JOINED):
            own = joined[at : at + JOINED]
            (found,) = self._tokenizer.encode_batch_fast([b"".join(own).decode()], add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            reached, ends = np.cumsum(self._bytes[ids]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            cuts = np.searchsorted(reached, ends) + 1
            if not len(ids) or cuts[-1] > len(ids) or not np.array_equal(reached[cuts - 1], ends):
                single += own
                continue
            packed, bounds = ids.tobytes(), [0, *(cuts * 4).tolist()]
            known.update(zip(own, (packed[i:j] for i, j in pairwise(bounds)), strict=True))
        found = self._tokenizer.encode_batch_fast([r.decode() for r in single], add_special_tokens=False)
        known.update((r, np.asarray(e.ids, "<u4").tobytes()) for r, e in zip(single, found, strict=True))

    def encode(self, text: bytes) -> bytes:
        """Packed ids of one text; a long one is worked in parts cut before white space."""
        if not self.by_runs or _WIDE.search(text):
            return self._whole(text)
        out, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, start + PART_BYTES) if len(text) - start > PART_BYTES else None
            end = cut.start() if cut else len(text)
            runs = _RUN.findall(text, start, end)
            distinct = set(runs)
            joined = {r for r in distinct if r[:1].isspace() and not r[-1:].isspace()}
            self._learn(list(joined), list(distinct - joined))
            out.append(b"".join(map(self._known.__getitem__, runs)))
            start = end
        return b"".join(out)

    def _even(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of texts whose white space is single blanks and line ends, between words.

        Each line end gets a blank before it, so that texts are split at blanks alone and
        their distinct runs are looked up once.
        """
        words = pc.split_pattern(pa.array([t.replace(b"\n", b" \n") for t in texts], pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        runs = [w if w[:1] == b"\n" else b" " + w for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        offsets = words.offsets.to_numpy()
        # The first run of a text has no blank before it.
        first = words.flatten().take(offsets[:-1]).cast(pa.binary()).to_pylist()
        self._learn(runs, list(set(first)))
        known = self._known
        found = pa.array(map(known.__getitem__, runs), pa.large_binary(), size=len(runs)).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
        ids = memoryview(found.buffers()[2] or b"")
        rest, last = ends[offsets[:-1] + 1].tolist(), ends[offsets[1:]].tolist()
        return [known[f] + ids[i:j] for f, i, j in zip(first, rest, last, strict=True)]

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each text, some megabytes of text in work at a time."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            even = self.by_runs and 0 < len(text) <= PART_BYTES and not _WIDE.search(text) and _is_even(text)
            if held and (not even or size + len(text) > WORK_BYTES):
                yield from self._even(held)
                held, size = [], 0
            if even:
                held.append(text)
                size += len(text)
            else:
                yield self.encode(text)
        if held:
            yield from self._even(held)


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for a Python worker: what it remembers serves all its tasks."""
    return PieceTokenizer(path)


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole, or full ones after a first with what is left over."""
    full, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * full


_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and its ids if wanted."""
    schema = pa.schema(_PIECE + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = piece_tokenizer(tokenizer).texts
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for at in range(0, batch.num_rows, 2000):
                columns: list[list] = [[] for _ in schema]
                for doc_id, packed in zip(numbers[at : at + 2000], encoded(text_bytes(batch.column("text").slice(at, 2000))), strict=True):
                    ids = memoryview(packed + end)
                    start = 0
                    for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = [doc_id, piece, start, length, zlib.crc32(own)] + [np.frombuffer(own, "<i4")] * with_ids
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                        start += length
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    source = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class OpenBins:
    """Sequences that still take pieces, by free space.

    Bit f of `_free` says that some open sequence has f places left; `_with[f]` holds
    their numbers.
    """

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self._with: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._free = self.open = self.made = 0

    def _take(self, free: int) -> int:
        number = self._with[free].pop()
        if not self._with[free]:
            self._free ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece: the open sequence with least space that holds it, or else a new one."""
        fitting = self._free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.most:
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
            self._with[left].append(number)
            self._free |= 1 << left
            self.open += 1
        return number, free


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, stream_pieces: int = STREAM_PIECES, with_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if wanted.

    Every row is a document of its own, repeated ids and rows too; a null id is carried.
    A null or empty text is its end id alone.  Very long texts are cut whole, in pieces of
    `capacity` after a first with what is left over; a document of exactly `capacity` is
    one piece.  Ties in free space go to the sequence that got there last.  Rows are dealt
    into streams by their number in the written table of pieces, so equal rows are spread
    and a task that runs again packs the same.  Other columns are ignored, whatever their
    names; an empty table has no pieces.
    """
    pieces = document_pieces(docs, tokenizer or tokenizer_file("byte_bpe_50k.json"), end_id, capacity, with_ids)
    pieces = settle(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    streams = -(-pieces.count() // stream_pieces) or 1
    stream = F.pmod(F.xxhash64("row", F.lit(streams)), F.lit(streams))
    dealt = pieces.withColumn("stream", stream).repartition("stream").sortWithinPartitions("stream", F.desc("length"), "row")
    fields = [*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    names = [name for name, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins = None, OpenBins(capacity, open_bins)
        for batch in batches:
            numbers, offsets = [], []
            for own, length in zip(batch.column("stream").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if own != current:
                    current, bins = own, OpenBins(capacity, open_bins)
                number, free = bins.place(length)
                numbers.append(own << 32 | number)
                offsets.append(capacity - free)
            known = {"sequence_id": pa.array(numbers, pa.int64()), "offset": pa.array(offsets, pa.int64())}
            yield pa.record_batch([known.get(name, None) if name in known else batch.column(name) for name in names], names=names)

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
