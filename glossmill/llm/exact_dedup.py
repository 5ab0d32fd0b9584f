"""Exact deduplication through a cuckoo-filter index over content digests.

The index keeps short fingerprints in buckets of four, each with a slot number of
the stored key.  A fingerprint hit alone proves nothing: it is verified against the
content's key that the slot holds, the SHA-256 of the whole text, which stands for the
text itself (among 10^12 different texts two share one with odds of 1 to 10^53).  When an insertion cannot find room, the table
doubles and is refilled from the stored keys, so nothing is ever lost.

On the cluster each input task folds its own rows first, so a text with any number
of copies reaches the digest's reducer as one record per input task.  Reducers fold
those records the same way.  Only (doc_id, digest) rows move, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import fresh_names, id_key, join_facts, settle, shuffle_partitions

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests with values; insert, find, delete, and growth from stored keys.

    Keys are byte strings of at least 12 well-mixed bytes (a SHA-256 digest).
    """

    def __init__(self, buckets: int = 256):
        self._n = 1 << max(1, (buckets - 1).bit_length())
        self._keys: list[bytes | None] = []
        self._values: list = []
        self._free: list[int] = []
        self.resizes = 0
        self._clear()

    def _clear(self) -> None:
        self._prints = [0] * (self._n * SLOTS)
        self._slots = [-1] * (self._n * SLOTS)

    def __len__(self) -> int:
        return len(self._keys) - len(self._free)

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self._n - 1)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = self._print(key)
        first = int.from_bytes(key[2:10], "little") & (self._n - 1)
        return mark, first, self._other(first, mark)

    def _at(self, key: bytes) -> int:
        """Position of a key in the table, -1 if it isn't live."""
        mark, first, second = self._place(key)
        prints, slots, keys = self._prints, self._slots, self._keys
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[at] == mark and keys[slots[at]] == key:
                    return at
        return -1

    def get(self, key: bytes, default=None):
        at = self._at(key)
        return default if at < 0 else self._values[self._slots[at]]

    def __contains__(self, key: bytes) -> bool:
        return self._at(key) >= 0

    def insert(self, key: bytes, value=None) -> bool:
        """Add a digest; False, changing nothing, if it is live already."""
        if self._at(key) >= 0:
            return False
        if self._free:
            slot = self._free.pop()
            self._keys[slot], self._values[slot] = key, value
        else:
            slot = len(self._keys)
            self._keys.append(key)
            self._values.append(value)
        if not self._settle(key, slot):
            self._grow()
        return True

    def _settle(self, key: bytes, slot: int) -> bool:
        mark, first, second = self._place(key)
        prints, slots = self._prints, self._slots
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[at]:
                    prints[at], slots[at] = mark, slot
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (mark + kick) % SLOTS
            prints[at], mark = mark, prints[at]
            slots[at], slot = slot, slots[at]
            bucket = self._other(bucket, mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[at]:
                    prints[at], slots[at] = mark, slot
                    return True
        return False

    def _grow(self) -> None:
        """Double until every stored key finds room."""
        while True:
            self._n *= 2
            self.resizes += 1
            self._clear()
            if all(self._settle(k, i) for i, k in enumerate(self._keys) if k is not None):
                return

    def delete(self, key: bytes) -> bool:
        """Remove a live digest; False if there is none."""
        at = self._at(key)
        if at < 0:
            return False
        slot = self._slots[at]
        self._prints[at], self._slots[at] = 0, -1
        self._keys[slot] = self._values[slot] = None
        self._free.append(slot)
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self._keys, self._values, strict=True) if k is not None)


GROUP = "digest binary, keep_id long, keep_row long, group_size long"
_GROUP_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
EMIT_ROWS = 20_000
#: Live digests a task holds; beyond it the index is emitted and starts anew.
LIVE = 200_000


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    live = index.items()
    while rows := [(digest, doc, row, n) for digest, (_, row, doc, n) in islice(live, EMIT_ROWS)]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _GROUP_ARROW, strict=True)], schema=_GROUP_ARROW)


def _fold(batches: Iterator[pa.RecordBatch], live: int = LIVE) -> Iterator[pa.RecordBatch]:
    """Records of equal digest become one; the live record is the one with the largest id.

    A record that outranks the live one deletes it from the index and takes its place.
    The index is emitted when it holds `live` digests and another digest comes up, so of
    rows sorted by digest every digest still gives one record.
    """
    index, last = CuckooIndex(), None
    for batch in batches:
        for digest, doc, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest != last and len(index) >= live:
                yield from _emit(index)
                index = CuckooIndex()
            last = digest
            rank = (doc is not None, doc or 0, row)
            known = index.get(digest)
            if known is None:
                index.insert(digest, (rank, row, doc, n))
            else:
                index.delete(digest)
                index.insert(digest, (rank, row, doc, n + known[3]) if rank > known[0] else (*known[:3], n + known[3]))
    yield from _emit(index)


def content_digest(text="text"):
    """SHA-256 of the text's UTF-8, null as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def content_groups(digests: DataFrame) -> DataFrame:
    """One row per distinct digest of (digest, doc_id, row_no): who stays, and how many there are."""
    spark = digests.sparkSession
    records = digests.select("digest", F.col("doc_id").cast("long").alias("keep_id"), F.col("row_no").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    combined = records.mapInArrow(_fold, GROUP).repartition(shuffle_partitions(spark), "digest")
    return combined.sortWithinPartitions("digest").mapInArrow(_fold, GROUP)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with identical texts form a group; null counts as empty.  Whole texts count,
    however long.  The row with the largest doc_id stays (null sorts below every id); of
    repeated rows that tie on doc_id exactly one stays.  Columns besides doc_id and text
    are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = settle(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_digest().alias("digest"), F.monotonically_increasing_id().alias("row_no")),
        "digests",
    )
    groups = settle(content_groups(rows), "groups")
    return join_facts(rows, groups, "digest", "group_size", rows.count()).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact deduplication keeps, with their columns.

    Copies are found by `content_groups`.  Survivors are picked by (digest, doc_id),
    which spreads the copies of one text over the tasks; of rows repeated whole one stays.
    Null texts count as empty, null ids as below every number; columns of any names are
    carried, and an empty table gives none.
    """
    digest, key, order, n = fresh_names(docs, "digest", "key", "order", "n")
    keyed = docs.withColumns({digest: content_digest(), key: id_key()})
    rows = settle(keyed.select(F.col("doc_id"), F.col(digest).alias("digest"), F.monotonically_increasing_id().alias("row_no")), "digests")
    keep = content_groups(rows).select(F.col("digest").alias(digest), id_key("keep_id").alias(key))
    once = Window.partitionBy(digest, key).orderBy(order)
    survivors = keyed.join(keep, [digest, key], "left_semi").withColumn(order, F.xxhash64(*docs.columns))
    return survivors.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*docs.columns)
