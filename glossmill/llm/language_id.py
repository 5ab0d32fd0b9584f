"""Language by compression: each language's dictionary, the smallest code wins.

A language's raw-content dictionary is learned text of that language, from all over many
documents, without lines that documents of other languages share.  Case is folded.  A
document is cut into pieces, each piece is compressed by zstandard once with every
dictionary, and the summed sizes are compared: text of a language repeats what its
dictionary holds.  Every dictionary is tried, however many languages there are, unless a
caller asks for a shortlist: the dictionaries that share most letter triples with a
document.  A narrow margin between the two smallest is
marked as not reliable.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import held_out, settle, text_strings

#: Bytes of learned text in one dictionary, and in all of them together; the more languages, the less each has.
DICTIONARY_BYTES = 128 << 10
ALL_BYTES = 32 << 20
#: Documents a language's dictionary is learned from: the first by a hash of doc_id.
SAMPLE_DOCS = 400
#: Slices a document's part is taken in, evenly spread over it, and characters gathered for each byte that fits.
SLICES = 8
SPARE = 4
#: Dictionaries that compress a document under a model made without saying; `fit` has every one tried.
SHORTLIST = 8
#: Up to so many sampled ids, of some 50 bytes each, are broadcast.
BROADCAST_ROWS = 200_000
PIECE = 1024
LEVEL = 6
NARROW = 0.02
UNKNOWN = "und"
_TRIPLES = 1 << 16


def triples(data: bytes) -> np.ndarray:
    """Hashes of the distinct byte triples of a text."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    return np.unique((x[:-2] * 0x9E37 ^ x[1:-1] * 0x01F1 ^ x[2:] << 7) % _TRIPLES) if len(x) > 2 else np.zeros(0, np.uint32)


@dataclass
class CompressionModel:
    """A raw-content dictionary for each language, in code-point order."""

    texts: dict[str, bytes]
    level: int = LEVEL
    shortlist: int | None = SHORTLIST
    _coders: list = field(default_factory=list, repr=False)
    _shared: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"texts": self.texts, "level": self.level, "shortlist": self.shortlist, "_coders": [], "_shared": []}

    @property
    def languages(self) -> list[str]:
        return sorted(self.texts)

    def _ready(self) -> list:
        if not self._coders:
            import zstandard

            for name in self.languages:
                held = zstandard.ZstdCompressionDict(self.texts[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=self.level)
                self._coders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False).compress)
        return self._coders

    def listed(self, data: bytes) -> list[int]:
        """Places of the languages whose dictionaries share most triples with a text, ties by order; at most `shortlist`, None: all."""
        n = len(self.texts)
        if self.shortlist is None or n <= self.shortlist:
            return list(range(n))
        if not self._shared:
            table = np.zeros((_TRIPLES, n), bool)
            for i, name in enumerate(self.languages):
                table[triples(self.texts[name]), i] = True
            self._shared.append(np.packbits(table, axis=1))  # a bit a triple and language
        score = np.zeros(n, np.int64)
        own = triples(data)
        for at in range(0, len(own), 4096):
            score += np.unpackbits(self._shared[0][own[at : at + 4096]], axis=1, count=n).sum(0, dtype=np.int64)
        return np.sort(np.argsort(-score, kind="stable")[: self.shortlist]).tolist()

    def sizes(self, data: bytes) -> dict[int, int]:
        """Compressed bytes of the whole text under the dictionary of each listed language."""
        coders = self._ready()
        pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
        return {i: sum(len(coders[i](p)) for p in pieces) for i in self.listed(data)}

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether the margin is wide enough to rely on.

        The score is a softmax over the sizes' difference per square root of the text,
        so it grows both with the margin and with the amount of evidence.
        """
        if not self.texts or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        data = text.lower().encode()
        found = self.sizes(data)
        at, sizes = list(found), np.asarray(list(found.values()), float)
        order = np.argsort(sizes, kind="stable")
        weights = np.exp(-(sizes - sizes[order[0]]) / (1 + np.sqrt(len(data)) / 8))
        margin = 1.0 if len(sizes) == 1 else (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        return self.languages[at[order[0]]], float(1 / weights.sum()), bool(margin >= NARROW)


def dictionary_bytes(languages: int) -> int:
    """Room of one dictionary, so that all of them fit in `ALL_BYTES`."""
    return min(DICTIONARY_BYTES, ALL_BYTES // max(1, languages))


def dictionaries(samples: dict[str, list[str]], size: int | None = None) -> dict[str, bytes]:
    """Each language's dictionary of `size` bytes from its documents' parts.

    Lines that more than one language's sample has (licences, quoted passages) tell
    nothing and are left out.  Documents fill the room in turns, line by line, so all of
    them have a share of it as long as they have lines.
    """
    size = size or dictionary_bytes(len(samples))
    lines = {k: [part.lower().split("\n") for part in v] for k, v in samples.items()}
    seen = Counter(x for v in lines.values() for x in {x for part in v for x in part})
    out = {}
    for name, parts in lines.items():
        known: set[str] = set()
        left = [iter(part) for part in parts]
        held, room = [], size
        share = max(1, size // max(1, len(parts)))
        while left and room > 0:
            again = []
            for lines_of in left:
                given = 0
                for line in lines_of:
                    if line and seen[line] == 1 and line not in known:
                        known.add(line)
                        data = line.encode() + b"\n"
                        held.append(data[:room])
                        given, room = given + len(data), room - len(data)
                    if given >= share or room <= 0:
                        again.append(lines_of)
                        break
                if room <= 0:
                    break
            left = again
        out[name] = b"".join(held) or b"\n" * 8
    return out


def spread_part(size: int) -> Column:
    """A text of at most `size` characters whole, else `SLICES` slices evenly spread over all of it, a line each."""
    width = max(8, size // SLICES)
    at = lambda i: F.floor((F.length("text") - F.lit(width)) * i / (SLICES - 1)).cast("int") + 1
    slices = F.array_join(F.array(*(F.substring(F.col("text"), at(F.lit(i)), F.lit(width)) for i in range(SLICES))), "\n")
    return F.when(F.length("text") <= width * SLICES, F.col("text")).otherwise(slices)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, shortlist: int | None = None) -> CompressionModel:
    """Learn from rows that are not held out and have a language and a text: every language there is.

    A language's sample is its first documents by a hash of doc_id and text, repeated rows
    once; from each come parts spread over the whole text.  What reaches the driver is at
    most `sample_docs` parts a language, of `SPARE` times `ALL_BYTES` characters in all,
    however many languages and repeated rows and however long the texts.  The model tries all
    dictionaries on every text, or only as many as a `shortlist` says.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # One row a language, after equal rows are one.  A hash bound thins rows before they are ranked.
    keys = settle(known.select("lang", "h").distinct(), "learnable")
    counts = settle(keys.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return CompressionModel({}, shortlist=shortlist)
    room = dictionary_bytes(languages)
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(4.0 * sample_docs) / F.col("n")).alias("share"))
    small = F.broadcast if languages * sample_docs <= BROADCAST_ROWS else (lambda x: x)
    thin = keys.join(small(share), "lang").where(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * F.lit(float(1 << 30)))
    ranked = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= sample_docs)
    part = spread_part(max(64, SPARE * room // sample_docs))
    chosen = known.join(small(ranked.select("lang", "h", "n")), ["lang", "h"]).select("lang", "n", part.alias("part")).groupBy("lang", "n").agg(F.min("part").alias("part"))
    held: dict[str, list[str]] = defaultdict(list)
    for r in chosen.orderBy("lang", "n").collect():
        held[r["lang"]].append(r["part"])
    return CompressionModel(dictionaries(held, room), shortlist=shortlist)


def identify(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, reliable.

    `lang_pred` is a learned language, or `und` with score 0 where the text is null or
    has no letter (or nothing was learned).  Ties go to the first language by code point.
    Whole texts are read, very long ones in pieces; repeated rows get equal answers, an
    empty table none.  Null ids are carried; other columns, of whatever names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in text_strings(batch.column("text"))]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), *columns], names=["doc_id", "held_out", "lang_pred", "score", "reliable"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, reliable boolean")
