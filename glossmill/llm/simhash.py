"""Near-duplicates by SimHash and covering locality-sensitive hashing.

For radius r every fingerprint bit gets a non-zero vector of r + 1 bits, and every
non-zero vector v makes a mask: the bits whose vector has an odd overlap with v.  At
most r differing bits leave some v orthogonal to all their vectors, so every pair within
the radius agrees under that mask: 2^(r+1) - 1 tables miss no pair.

A text may have fingerprints under several hash functions (lanes), each with the same
guarantee.  Rows of equal first fingerprint are one node.  Within a bucket links are found by search from
node to node, which returns a spanning forest, not pairs; a large bucket is first cut by
blocks of its free bits, of which a pair within the radius must share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import fresh_names, id_key, join_facts, settle, shuffle_partitions, text_bytes, word_pieces
from glossmill.llm.exact_dedup import content_digest
from glossmill.llm.graph import components

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
#: Hash functions that the corpus stage links under; the operator's own result takes one.
LANES = 8
#: Words of a shingle in the corpus stage.  One changed word touches fewer of shorter shingles, so fingerprints stay nearer.
STAGE_SHINGLE = 2
#: The step between lanes and the mixing rounds (shift, factor) of SplitMix64.
LANE_STEP = 0x9E3779B97F4A7C15
LANE_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
#: Buckets above this many fingerprints are cut by blocks of free bits.
BUCKET = 2048


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks under one of which any two words within `radius` bits agree."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, v in enumerate(vectors) if (v & w).bit_count() & 1) for w in range(1, size)]


def _spread(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of another lane, mixed from those of lane 0, which stay as they are."""
    if not lane:
        return hashes
    z = hashes + np.uint64(LANE_STEP * lane % (1 << 64))
    for shift, odd in LANE_MIX:
        z = (z ^ z >> np.uint64(shift)) * np.uint64(odd)
    return z ^ z >> np.uint64(31)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit set where over half of its shingles' hashes have it."""
    return int(fingerprint_lanes(text, 1, shingle)[0])


def fingerprint_lanes(text: bytes, lanes: int, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a text under `lanes` hash functions; lane 0 is `fingerprint`."""
    from xxhash import xxh64_intdigest

    counts, n = np.zeros((lanes, BITS), np.int64), 0
    last: list[bytes] = []  # words whose shingles reach into the next piece
    for words in word_pieces(text.lower()):
        words = last + words
        last = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            last = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        here = len(words) - shingle + 1
        spans = zip(starts[:here].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
        view = memoryview(joined)
        hashes = np.fromiter((xxh64_intdigest(view[a:b], SEED) for a, b in spans), np.uint64, here)
        for at in range(0, here, 1 << 14):
            for lane in range(lanes):
                part = np.ascontiguousarray(_spread(hashes[at : at + (1 << 14)], lane).astype("<u8"))
                counts[lane] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += here
    if n:
        return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]
    if not last:
        return np.zeros(lanes, np.uint64)
    only = np.asarray([xxh64_intdigest(b" ".join(last), SEED)], np.uint64)
    return np.concatenate([_spread(only, lane) for lane in range(lanes)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, lanes: int = 1, digests: bool = False) -> DataFrame:
    """(doc_id, fp, others): each whole text's fingerprint as a signed 64-bit integer, and those of further lanes; with its digest if asked for."""
    carried = ["digest"] if digests else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            marks = np.asarray([fingerprint_lanes(t, lanes, shingle) for t in texts], np.uint64).reshape(-1, lanes).view(np.int64)
            others = pa.array(list(marks[:, 1:]), pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), pa.array(np.ascontiguousarray(marks[:, 0])), others, *map(batch.column, carried)]
            yield pa.record_batch(columns, names=["doc_id", "fp", "others", *carried])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(content_digest().alias(c) for c in carried))
    return source.mapInArrow(run, ", ".join(["doc_id long", "fp long", "others array<long>", *(f"{c} binary" for c in carried)]))


class _Union:
    """Disjoint sets over 0 .. n - 1; a set's smallest member is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _search(marks: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct marks, each reached once, breadth first."""
    left = np.arange(len(marks))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(marks[left] ^ marks[at]) <= radius
            if near.any():
                for x in left[near].tolist():
                    yield at, x
                    front.append(x)
                left = left[~near]


def bucket_links(marks: np.ndarray, radius: int, free: list[int], bucket: int = BUCKET) -> list[tuple[int, int]]:
    """Links (positions) that connect the same marks as all pairs within the radius.

    `free` lists the bits in which marks of this bucket may differ.
    """
    if len(marks) <= bucket or len(free) <= radius:
        return list(_search(marks, radius))
    sets = _Union(len(marks))
    out = []
    for block in np.array_split(np.asarray(free), radius + 1):
        mask = np.uint64(sum(1 << int(b) for b in block))
        key = marks & mask
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rest = [b for b in free if b not in set(block.tolist())]
        for group in np.split(order, cuts):
            if len(group) < 2:
                continue
            # A part as large as the whole cannot be cut further this way.
            inner = bucket if len(group) < len(marks) else len(marks)
            for x, y in bucket_links(marks[group], radius, rest, inner):
                x, y = int(group[x]), int(group[y])
                if sets.find(x) != sets.find(y):
                    sets.join(x, y)
                    out.append((x, y))
    return out


def near_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between nodes `fp` that connect what is within the radius in some lane.

    `marks` has distinct (fp, lane, mark): a node's fingerprint in each lane.  One row a
    mask is dealt by (lane, mask, bits under the mask), so near fingerprints meet; what
    a bucket gives back is a spanning forest of its links.
    """
    masks = covering_masks(radius)
    table = F.array(*(F.lit(_signed(m)) for m in masks))
    spread = marks.select("fp", "lane", "mark", F.explode(F.array(*(F.lit(t) for t in range(len(masks))))).alias("t"))
    # The bits under the mask are worked out where they are needed, not carried.
    key = F.col("mark").bitwiseAND(F.element_at(table, F.col("t") + 1))
    dealt = spread.repartition(shuffle_partitions(marks.sparkSession), "lane", "t", key).sortWithinPartitions("lane", "t", key, "mark")
    free = [[b for b in range(BITS) if not m >> b & 1] for m in masks]
    signed = np.asarray([_signed(m) for m in masks], np.int64)

    def starts_of(rows: dict[str, np.ndarray]) -> np.ndarray:
        """Where buckets begin in sorted rows."""
        key = rows["mark"] & signed[rows["t"]]
        new = (np.diff(rows["lane"]) != 0) | (np.diff(rows["t"]) != 0) | (np.diff(key) != 0)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def linked(rows: dict[str, np.ndarray], starts: np.ndarray, end: int) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, end))
        out = []
        for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own, nodes = rows["mark"][a : a + n].view(np.uint64), rows["fp"][a : a + n]
            distinct, first = np.unique(own, return_index=True)
            if len(distinct) < n:  # nodes alike in this lane
                at = first[np.searchsorted(distinct, own)]
                out.append(np.stack([nodes[at], nodes], 1)[at != np.arange(n)])
            found = bucket_links(distinct, radius, free[rows["t"][a]])
            if found:
                out.append(nodes[first[np.asarray(found)]])
        links = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        links = links[links[:, 0] != links[:, 1]]
        return pa.record_batch([pa.array(np.ascontiguousarray(links[:, i]), pa.int64()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("lane", "t", "mark", "fp")
        held: list[dict[str, np.ndarray]] = []  # rows of a bucket that may go on

        def bucket(rows: dict[str, np.ndarray], at: int) -> tuple[int, int, int]:
            return rows["lane"][at], rows["t"][at], rows["mark"][at] & signed[rows["t"][at]]

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if not batch.num_rows:
                continue
            held.append(new)
            if bucket(new, -1) == bucket(held[0], 0):
                continue  # one bucket so far
            rows = {c: np.concatenate([h[c] for h in held]) for c in names}
            starts = starts_of(rows)
            yield linked(rows, starts[:-1], int(starts[-1]))
            held = [{c: v[starts[-1] :] for c, v in rows.items()}]
        if held:
            rows = {c: np.concatenate([h[c] for h in held]) for c in names}
            yield linked(rows, starts_of(rows), len(rows["mark"]))

    return dealt.mapInArrow(run, "a long, b long")


def near_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id, n) per distinct fingerprint of (doc_id, fp, others).

    The root, a fingerprint, tells components apart; the id is the smallest doc_id
    reachable; n counts the fingerprint's rows.
    """
    every = rows.select("fp", F.posexplode(F.concat(F.array("fp"), "others")).alias("lane", "mark"))
    roots = components(near_links(every.distinct(), radius)).select(F.col("node").alias("fp"), "root")
    marks = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    grouped = settle(marks.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    sizes = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("nodes"))
    return settle(join_facts(grouped, sizes, "root", "nodes", grouped.count()).select("fp", "root", "component_id", "n"), "components")


def near_dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in at most `radius` bits under any of
    `lanes` hash functions; a component is what links reach, named by its smallest
    doc_id (null if it has none).  Whole texts are read, in pieces where they are very
    long.  A text without words, or null, has fingerprint zero and links like any other.
    Repeated rows, ties and extra columns, of whatever names, change nothing; an empty
    table gives an empty result.
    """
    rows = settle(fingerprints(docs, shingle, lanes), "fingerprints")
    found = join_facts(rows.select("doc_id", "fp"), near_components(rows, radius), "fp", "n", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = STAGE_SHINGLE, lanes: int = LANES) -> DataFrame:
    """One row of `docs` for each component, with its columns: a row with the smallest doc_id.

    Several lanes find more of the copies that differ a little: a pair whose fingerprints
    are some bits too far apart in one is often within the radius in another.  Rows whose
    id is null stay only where their component has no id.  Of rows that tie on the id the
    smallest text digest stays; of rows that tie on both, one.  Null and empty texts are
    one component.  Columns of any names are carried; an empty table gives none.
    """
    digest, key, order, n = fresh_names(docs, "digest", "key", "order", "n")
    rows = settle(fingerprints(docs, shingle, lanes, digests=True), "fingerprints")
    found = join_facts(rows.select("doc_id", "fp", "digest"), near_components(rows, radius), "fp", "n", rows.count())
    leading = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("digest").alias("digest"))
    # A digest lies in one component only, so (digest, id) names one row a component, wherever its id stands besides.
    keep = leading.select(F.col("digest").alias(digest), id_key().alias(key))
    once = Window.partitionBy(digest, key).orderBy(order)
    survivors = docs.withColumns({digest: content_digest(), key: id_key()}).join(keep, [digest, key], "left_semi").withColumn(order, F.xxhash64(*docs.columns))
    return survivors.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*docs.columns)
