"""Token-id files with Elias-Fano document boundaries.

A file holds the concatenated ids of consecutive documents and their boundaries as an
Elias-Fano sequence: low bits packed, high bits in unary, and sampled select positions,
so any document's offset is found in near-minimal space without a table of 64-bit
offsets.  Documents are range-partitioned by doc_id; each task writes the files of its
range, and a manifest table gives each file's first global position.

Layout, little-endian: header (`_HEADER`), doc ids (int64 each), Elias-Fano bytes, ids
(unsigned, 2 or 4 bytes as the vocabulary needs).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.llm.common import scratch_path, settle, shuffle_partitions, single_thread, text_bytes, tokenizer_file, word_pieces

MAGIC, VERSION = b"GMEF", 1
_HEADER = struct.Struct("<4sHBxQQQQ")  # magic, version, id bytes, documents, of which without id, ids, Elias-Fano bytes
SAMPLE = 64
#: A file is closed at this many ids; one longer document has a file of its own.
FILE_IDS = 1 << 24
END_ID = 2
#: Characters of a text by which rows of one id are parted, and documents described at a time.
START_CHARS = 64
READ_DOCS = 10_000
REMEMBERED = 1_000_000
#: Text in work at a time.
WORK_BYTES = 4 << 20
#: Words of letters that are encoded as one text.
JOINED = 500
END_OF_WORD = "</w>"


class EliasFano:
    """A non-decreasing sequence of non-negative integers with constant-time access.

    `select(i)` is the i-th value.  Space: about 2 + log2(largest / count) bits a value,
    and a 32-bit select sample for every 64 values.
    """

    _HEAD = struct.Struct("<QBxxxxxxxQ")  # count, low bits, bytes of high bits

    def __init__(self, count: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.count, self.low, self._lows, self._highs, self._samples = count, low, lows, highs, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n and (np.diff(v.astype(np.int64)) < 0).any():
            raise ValueError("values must not decrease")
        low = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low, dtype=np.uint64)
        lows = np.packbits((v[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low, lows, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self._HEAD.pack(self.count, self.low, len(self._highs)) + self._lows.tobytes() + self._highs.tobytes() + self._samples.tobytes()

    @classmethod
    def from_bytes(cls, data) -> EliasFano:
        count, low, n_high = cls._HEAD.unpack_from(data)
        at = cls._HEAD.size
        n_low = -(-count * low // 8)
        lows = np.frombuffer(data, np.uint8, n_low, at)
        highs = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", -(-count // SAMPLE), at + n_low + n_high)
        return cls(count, low, lows, highs, samples)

    def _low_of(self, i: int) -> int:
        first, last = i * self.low // 8, ((i + 1) * self.low + 7) // 8
        word = int.from_bytes(self._lows[first:last].tobytes(), "little")
        return word >> (i * self.low - first * 8) & (1 << self.low) - 1

    def select(self, i: int) -> int:
        """The i-th value: start at the sample before it and count ones byte by byte."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at = int(self._samples[i // SAMPLE])
        left = i % SAMPLE  # ones still to pass after the sampled one
        byte, word = at // 8, int(self._highs[at // 8]) >> at % 8 << at % 8
        while (here := word.bit_count()) <= left:
            left -= here
            byte += 1
            word = int(self._highs[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low | self._low_of(i)

    def values(self) -> np.ndarray:
        """The whole sequence at once."""
        ones = np.flatnonzero(np.unpackbits(self._highs, bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high.astype(np.int64)
        bits = np.unpackbits(self._lows, bitorder="little")[: self.count * self.low].reshape(self.count, self.low)
        return (high | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)).astype(np.int64)


def file_system(uri: str):
    """(file system, path in it) of a shared folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """The bytes of one file; documents without an id come first."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))])
    fano = EliasFano.build(ends).to_bytes()
    numbers = np.asarray([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    without = sum(d is None for d in doc_ids)
    return _HEADER.pack(MAGIC, VERSION, width, len(doc_ids), without, int(ends[-1]), len(fano)) + numbers + fano + ids


class TokenFile:
    """A file read back: documents' ids by position."""

    def __init__(self, data):
        magic, version, width, docs, without, n_ids, n_fano = _HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id file of this version")
        at = _HEADER.size
        numbers = np.frombuffer(data, "<i8", docs, at).tolist()
        self.doc_ids: list[int | None] = [None] * without + numbers[without:]
        self.bounds = EliasFano.from_bytes(memoryview(data)[at + 8 * docs : at + 8 * docs + n_fano])
        self.ids = np.frombuffer(data, f"<u{width}", n_ids, at + 8 * docs + n_fano)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


#: The parts of a tokenizer file under which words can be encoded by themselves.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def encodes_by_words(parts: dict) -> bool:
    """Whether a tokenizer file is of the kind whose words can be encoded by themselves, remembered and joined.

    Its normaliser and split pattern must never look across white space and take upper
    case for lower, and its marks of word ends must show where letters' tokens part.
    """
    model = parts["model"]
    plain = not any(parts.get(k) for k in ("truncation", "padding", "post_processor"))
    added = all(t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in parts["added_tokens"])
    splits = parts["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": WORD_SPLITS}
    bpe = model["type"] == "BPE" and model.get("end_of_word_suffix") == END_OF_WORD and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "continuing_subword_prefix"))
    return plain and added and splits and bpe and parts["normalizer"] == WORD_NORMALIZER


class WordTokenizer:
    """Ids of whole texts as packed bytes, as the tokenizers library gives them.

    Special tokens' strings in a text are special tokens, as is the library's default,
    unless `special_as_text`.  Of a vocabulary of the kind `encodes_by_words` tells, words
    are encoded one by one and remembered: case of A-Z makes no difference to it, nor does
    cutting one final period or comma off a word that ends in a letter.  With any other
    vocabulary every text is encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        single_thread()
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_words = encodes_by_words(parts)
        # Words never hold a special token: texts are parted at them before.
        self._tokenizer.encode_special_tokens = special_as_text or self.by_words
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        special = {t["content"].encode(): t["id"] for t in parts["added_tokens"]} if self.by_words and not special_as_text else {}
        self._special = {k: np.asarray([i], f"<u{self.width}").tobytes() for k, i in special.items()}
        self._cuts = re.compile(b"(" + b"|".join(re.escape(k) for k in sorted(special, key=len, reverse=True)) + b")") if special else None
        self._known: dict[bytes, bytes] = {}
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True

    def _encode(self, words: list[bytes]) -> None:
        """Remember the ids of words.

        Words of letters are one split match each, whose last token has the end-of-word
        mark, so many go in as one text and their ids are parted at the marks.  If the
        marks of a text are not as many as its words, its words go in one by one.
        """
        texts = [w.decode() for w in words]
        lettered = [i for i, t in enumerate(texts) if t.isalpha()]
        single = [i for i, t in enumerate(texts) if not t.isalpha()]
        for at in range(0, len(lettered), JOINED):
            own = lettered[at : at + JOINED]
            (found,) = self._tokenizer.encode_batch_fast([" ".join([texts[i] for i in own])], add_special_tokens=False)
            ids = np.asarray(found.ids, f"<u{self.width}")
            ends = ((np.flatnonzero(self._ends[ids]) + 1) * self.width).tolist()
            if len(ends) != len(own):
                single += own
                continue
            packed, start = ids.tobytes(), 0
            for i, end in zip(own, ends, strict=True):
                self._known[words[i]] = packed[start:end]
                start = end
        found = self._tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False)
        self._known.update((words[i], np.asarray(e.ids, f"<u{self.width}").tobytes()) for i, e in zip(single, found, strict=True))

    def _learn(self, words: list[bytes]) -> None:
        """Know the ids of all these words."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        missing = set(words).difference(known)
        ending = {w for w in missing if len(w) > 1 and w[-1] in b".," and 97 <= w[-2] <= 122}
        plain = (missing - ending) | {w[:-1] for w in ending} | {w[-1:] for w in ending}
        self._encode([w for w in plain if w not in known])
        for w in ending:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def _packed(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of some texts: their distinct words are looked up once, and laid out by position."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct)
        found = pa.array(map(self._known.__getitem__, distinct), pa.binary(), size=len(distinct)).take(coded.indices)
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1)
        bounds = ends[words.offsets.to_numpy()].tolist()
        ids = memoryview(found.buffers()[2] or b"")
        return [bytes(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def texts(self, texts: list[bytes]) -> Iterator[bytes]:
        """Packed ids of each text."""
        if not self.by_words:
            for text in texts:
                yield np.asarray(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids, f"<u{self.width}").tobytes()
            return
        # A text with special tokens is parted at them: its pieces go in by turns with their ids.
        parted = {i: self._cuts.split(t) for i, t in enumerate(texts) if self._cuts and any(k in t for k in self._special)}
        pieces = self._plain(p for i, t in enumerate(texts) for p in (parted[i][::2] if i in parted else [t]))
        for i in range(len(texts)):
            if i in parted:
                marks = [self._special[p] for p in parted[i][1::2]] + [b""]
                yield b"".join(next(pieces) + m for m in marks)
            else:
                yield next(pieces)

    def _plain(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Packed ids of texts without special tokens; a few megabytes of text are in work at a time."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            # Letters before combining marks keep their case: some compose in one case only.
            text = text if b"\xcc" in text or b"\xcd" in text else text.lower()
            if size + len(text) > WORK_BYTES and held:
                yield from self._packed(held)
                held, size = [], 0
            if len(text) > WORK_BYTES:
                yield b"".join(self._packed([b" ".join(words)])[0] for words in word_pieces(text, WORK_BYTES))
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._packed(held)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a Python worker: the words it remembers serve all its tasks."""
    return WordTokenizer(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenize whole texts and write them in ascending doc_id order below `folder`.

    Returns the manifest (path, part, file_no, n_docs, n_ids, first), `first` the number
    of ids in all files before.  A task that runs again writes the same files under the
    same names, each moved in place whole.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    # Texts' beginnings part the rows that share an id or have none.
    start = F.substring("text", 1, START_CHARS).asc_nulls_first()
    ordered = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), start)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("file_no", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = word_tokenizer(tokenizer)
        end = np.asarray([end_id], f"<u{words.width}").tobytes()
        part, file_no = TaskContext.get().partitionId(), 0
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        doc_ids: list = []
        lengths: list[int] = []
        held = bytearray()

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, held, file_no
            name = f"part-{part:06d}-{file_no:04d}.gmef"
            data = pack_file(doc_ids, lengths, bytes(held), words.width)
            unfinished = f"{root}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(unfinished) as out:
                out.write(data)
            store.move(unfinished, f"{root}/{name}")
            row = [[f"{folder}/{name}"], [part], [file_no], [len(doc_ids)], [sum(lengths)]]
            doc_ids, lengths, held, file_no = [], [], bytearray(), file_no + 1
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.texts(text_bytes(batch.column("text"))), strict=True):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // words.width + 1)
                held += ids
                held += end
                if len(held) >= file_ids * words.width:
                    yield close()
        if doc_ids:
            yield close()

    files = settle(ordered.mapInArrow(run, "path string, part int, file_no int, n_docs long, n_ids long"), "token_files")
    # One row a part: as many as there are shuffle partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(starts, "part").withColumn("first", F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("base")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    A document's place in a file is two `select`s on its Elias-Fano boundaries; no table
    of offsets is laid out.  Empty files and manifests give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                store, place = file_system(path)
                with store.open_input_file(place) as f:
                    file = TokenFile(f.read_buffer())
                for at in range(0, len(file), READ_DOCS):
                    starts = [file.bounds.select(i) for i in range(at, min(at + READ_DOCS, len(file)) + 1)]
                    crc = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in pairwise(starts)]
                    columns = [file.doc_ids[at : at + READ_DOCS], [first + a for a in starts[:-1]], [b - a for a, b in pairwise(starts)], crc]
                    yield pa.record_batch([pa.array(c, x.type) for c, x in zip(columns, schema, strict=True)], schema=schema)

    spread = manifest.select("path", "first").repartition(shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, **settings) -> DataFrame:
    """Write the token-id files of `docs`, then describe every document from them.

    Per row: doc_id, start, n_tokens, ids_crc32.  A null or empty text is its end id
    alone.  Whole texts are encoded, very long ones in pieces.  Documents without doc_id
    come first; rows that share a doc_id follow each other by text.  Extra columns are
    ignored, whatever their names; an empty table writes no file.
    """
    spark: SparkSession = docs.sparkSession
    where = folder or scratch_path(spark, "token_ids")
    return read_token_files(settle(write_token_files(docs, where, tokenizer or tokenizer_file("word_bpe_49k.json"), **settings), "manifest"))
