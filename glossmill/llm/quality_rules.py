"""Quality rules: an isolation forest on rule statistics, calibrated from labelled rows.

Statistics are taken over whole texts.  The forest is grown on all of them, on a
logarithmic scale, from half of the good labelled documents.  A node splits one
statistic at random over a widened range of its rows, so a value beyond what good
documents have, high or low, is cut off early wherever the split falls; a document's
mean path length over many trees tells how easily it is isolated.  The cut-off is
calibrated on labelled rows the forest was not grown on: it may reject at most a given
share of good documents and then rejects the most bad ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import settle, text_strings, word_pieces

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled rows that are learned from in one place; of more, all are scored where they lie.
SAMPLE_ROWS = 6000
TREES = 200
TREE_ROWS = 256
#: Splits of one path at most.
DEPTH = 16
#: How far a split may fall beyond the rows of a node, in widths of their range on either side.
WIDEN = 1.0
#: Least range of a statistic, in standard deviations of the good rows, so that one all rows share can be split too.
LEAST_RANGE = 0.5
#: Added to a rate before its logarithm is taken.
OFFSET = 0.01
#: Good documents a threshold may reject.
MAX_GOOD_LOSS = 0.002

_SPACE = re.compile("[\x20\x09-\x0d]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER, _PUNCT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[!?;:,.\"()\[\]{}=+/\\_~^@-]")
_DIGIT = re.compile(r"[0-9]")


def word_numbers(text: bytes) -> np.ndarray:
    """A number for each word of a text, equal words alike."""
    seen: dict[bytes, int] = {}
    return np.concatenate([np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) for words in word_pieces(text)])


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    n = len(ids)
    if n <= window:
        return 0
    span = 1
    while span < window:  # ids of spans of 1, 2, 4, ... words; the last step overlaps if need be
        step = min(span, window - span)
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span += step
    repeated = np.bincount(ids)[ids] > 1
    if not repeated.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


@dataclass
class Statistics:
    """Counts of one text that the rules use."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: tuple[float, ...]

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


#: What the forest sees, all of them rates that do not follow a text's length.
FEATURES = ("symbols per word", "other marks per word", "upper case per character", "digits per character", "word length", "same word again", "duplicate lines", "repeated windows")


def statistics(text: str) -> Statistics:
    ids = word_numbers(text.encode())
    n = len(ids)
    chars = len(text) - len(_SPACE.findall(text))
    symbols = len(_SYMBOL.findall(text))
    # Lines end at \n alone; one with a word has something besides white space.
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    repeats = repeat_words(ids)
    dup_lines = len(lines) - len(set(lines))
    some, long_ = max(n, 1), max(len(text), 1)
    again = int((ids[1:] == ids[:-1]).sum())
    features = (
        symbols / some,
        len(_PUNCT.findall(text)) / some,
        len(_UPPER.findall(text)) / long_,
        len(_DIGIT.findall(text)) / long_,
        chars / some,
        again / some,
        dup_lines / max(len(lines), 1),
        repeats / some,
    )
    return Statistics(n, chars, symbols, dup_lines, repeats, features)


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class IsolationForest:
    """Trees as flat arrays: node i splits `feature[i]` at `cut[i]`, or is a leaf of depth `depth[i]`."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    norm: float

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42, disjoint: bool = False) -> IsolationForest:
        """Each tree on `tree_rows` rows drawn at random; `disjoint` deals all rows out first, so that none is left out of every tree."""
        rng = np.random.default_rng(seed)
        size = min(tree_rows, len(rows))
        dealt = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-trees * size // max(len(rows), 1)))]) if disjoint and size else None
        least = LEAST_RANGE * np.maximum(rows.std(0), 1e-3) if size else np.zeros(0)
        nodes: list[list[float]] = []
        roots = []
        for tree in range(trees):
            roots.append(len(nodes))
            nodes.append([-1, 0.0, -1, 0.0])
            own = rng.choice(len(rows), size, replace=False) if dealt is None and size else dealt[tree * size : (tree + 1) * size] if size else slice(0)
            todo = [(roots[-1], rows[own], 0)]
            while todo:
                at, own, depth = todo.pop()
                if depth >= DEPTH or len(own) <= 1:
                    nodes[at] = [-1, 0.0, -1, depth + _average_path(len(own))]
                    continue
                f = int(rng.integers(rows.shape[1]))
                low, high = own[:, f].min(), own[:, f].max()
                wide = WIDEN * max(high - low, least[f])
                cut = float(rng.uniform(low - wide, high + wide))
                nodes[at] = [f, cut, len(nodes), 0.0]
                below = own[:, f] < cut
                todo += [(len(nodes), own[below], depth + 1), (len(nodes) + 1, own[~below], depth + 1)]
                nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
        table = np.asarray(nodes, float).reshape(-1, 4)
        return cls(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3], np.asarray(roots, np.int64), _average_path(size) or 1.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1; short mean paths are near 1."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = self.left[at] + (rows[each, np.maximum(f, 0)] >= self.cut[at])
                at = np.where(inner, go, at)
            total += self.depth[at]
        return 2.0 ** (-total / max(len(self.roots), 1) / self.norm)


@dataclass
class QualityModel:
    """The forest over the statistics' logarithms, and the score above which a document goes."""

    forest: IsolationForest
    threshold: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return self.forest.score(np.log(features + OFFSET))


def calibrate(scores: np.ndarray, good: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """The cut-off that rejects the most bad rows for at most `max_good_loss` of the good ones.

    It lies halfway between the last good score it keeps and the next bad one above.
    """
    kept = np.sort(scores[good])
    if not len(kept):
        return 1.0
    floor = kept[len(kept) - 1 - min(len(kept) - 1, max(1, int(len(kept) * max_good_loss)))]
    above = scores[~good & (scores > floor)]
    return float((floor + above.min()) / 2) if len(above) else float((floor + 1) / 2)


def learn(rows: np.ndarray, good: np.ndarray, seed: int = 42) -> QualityModel:
    """Grow on half of the good labelled rows of `FEATURES`; calibrate on the other half and on the bad ones."""
    order = np.random.default_rng(seed).permutation(np.flatnonzero(good))
    grown, left = order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]
    model = QualityModel(IsolationForest.grow(np.log(rows[grown] + OFFSET), seed=seed), 1.0)
    rest = np.concatenate([left, np.flatnonzero(~good)])
    if len(left):
        model.threshold = calibrate(model.score(rows[rest]), good[rest])
    return model


#: Bins that scores are counted in to find one by its rank, and how often a bin is cut again.
BINS, CUTS = 1 << 12, 2


def ranked_score(scores: DataFrame, rank: int) -> float:
    """The score that `rank` others are above, of all rows: counts by bins, and then by the scores of one narrow bin."""
    low, width = 0.0, 1.0
    for _ in range(CUTS):
        inside = scores.where((F.col("score") >= low) & (F.col("score") < low + width)) if width < 1 else scores
        place = F.least(F.greatest(F.floor((F.col("score") - low) / width * BINS), F.lit(0)), F.lit(BINS - 1))
        for r in inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("bin")).collect():  # at most `BINS` rows
            if rank < r["n"]:
                low, width = low + r["bin"] * width / BINS, width / BINS
                break
            rank -= r["n"]
    # A bin's edges may round to either side of a score, so its neighbours' nearest rows are told apart by rank.
    found = scores.where((F.col("score") >= low) & (F.col("score") < low + width)).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score"))
    last = low
    for r in found.toLocalIterator():
        last = r["score"]
        if rank < r["n"]:
            break
        rank -= r["n"]
    return float(last)


def threshold(scores: DataFrame, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """What `calibrate` says of all rows of (score, good), which stay where they are."""
    good = scores.where("good").select("score")
    n = good.count()
    if not n:
        return 1.0
    floor = ranked_score(good, min(n - 1, max(1, int(n * max_good_loss))))
    above = scores.where(~F.col("good") & (F.col("score") > floor)).agg(F.min("score")).first()[0]
    return (floor + (1.0 if above is None else above)) / 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> QualityModel:
    """Learn from all labelled documents that pass the base rules.

    Repeated labels, and rows of one id with like statistics, count once.  Labels that are null or of unknown documents are left out; with fewer than two good
    ones there is nothing to calibrate with and the model rejects nothing.  Up to
    `SAMPLE_ROWS` rows are learned from in one place.  Of more, half of the good ones, by
    hash, grow the forest: each tree has rows of its own as long as there are enough, so
    the driver gets `TREES * TREE_ROWS` of them at most, which is all that trees of that
    many rows hold.  The other half and all bad ones are scored where they lie, and the
    threshold is that of every one of them.  A caller may have it learn from the first
    `sample_rows` by a hash alone.
    """
    return fit_measured(_with_statistics(docs), labels, sample_rows)


def fit_measured(measured: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> QualityModel:
    """`fit` from the statistics of documents (`measure`): labels meet these few numbers a row, so no text is shuffled."""
    known = labels.where("quality IS NOT NULL").select("doc_id", "quality").distinct()
    if sample_rows:
        known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows))
    rows = measured.select("doc_id", "base_failed", "features").join(known, "doc_id")
    passing = settle(rows.where("NOT base_failed").select("doc_id", "quality", "features").distinct(), "labelled")
    if sample_rows:  # an id may have many rows, so the bound holds for rows again
        passing = passing.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features").limit(sample_rows)
    if sample_rows or passing.count() <= SAMPLE_ROWS:
        found = sorted(passing.collect(), key=lambda r: (r["doc_id"], r["quality"], r["features"]))
        return learn(_features(found), np.asarray([r["quality"] == 1 for r in found], bool))
    place = F.xxhash64("doc_id", "quality", "features")
    halved = passing.withColumns({"place": place, "good": F.col("quality") == 1, "grows": (F.col("quality") == 1) & (F.pmod(place, F.lit(2)) == 0)})
    grown = halved.where("grows").orderBy("place", "features").limit(TREES * TREE_ROWS).collect()
    model = QualityModel(IsolationForest.grow(np.log(_features(grown) + OFFSET), disjoint=True), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(model.score(_feature_batch(batch))), batch.column("good")], names=["score", "good"])

    scores = settle(halved.where("NOT grows").select("features", "good").mapInArrow(run, "score double, good boolean"), "labelled_scores")
    model.threshold = threshold(scores)
    return model


def _features(rows: list) -> np.ndarray:
    return np.asarray([r["features"] for r in rows], float).reshape(-1, len(FEATURES))


def _feature_batch(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


#: What is counted of a text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, features array<double>"


def _with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, features) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in text_strings(batch.column("text"))]
            counts = [pa.array([getattr(s, c) for s in found], pa.int64()) for c in COUNTS]
            rest = [pa.array([s.base_failed for s in found], pa.bool_()), pa.array([s.features for s in found], pa.list_(pa.float64()))]
            yield pa.record_batch([batch.column("doc_id"), *counts, *rest], names=["doc_id", *COUNTS, "base_failed", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEASURED)


def measure(docs: DataFrame) -> DataFrame:
    """Statistics of every row, stored: a model is fitted on them and judges by them, and texts are read once."""
    return settle(_with_statistics(docs), "statistics")


VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double"


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept and the anomaly score.

    Null and empty texts have no words and fail the base rules.  Whole texts are judged,
    very long ones in pieces.  Rows are judged one by one, so repeated rows and ties get
    equal verdicts; null ids are carried; other columns, of whatever names, are ignored;
    an empty table gives none.
    """

    return judge_measured(_with_statistics(docs), model)


def judge_measured(measured: DataFrame, model: QualityModel) -> DataFrame:
    """`judge` from the statistics of documents (`measure`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anomaly = model.score(_feature_batch(batch))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            columns = [*(batch.column(c) for c in ("doc_id", *COUNTS, "base_failed")), pa.array(~failed & (anomaly <= model.threshold)), pa.array(anomaly)]
            yield pa.record_batch(columns, names=[x.split()[0] for x in VERDICT.split(", ")])

    return measured.mapInArrow(run, VERDICT)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of `docs` that are kept, with their columns.

    Verdicts are those of `judge`, with the same results for nulls, empty and very long
    texts, ties and repeated rows; columns of any names are carried, and an empty table
    gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in text_strings(batch.column("text"))]
            anomaly = model.score(np.asarray([s.features for s in found], float).reshape(-1, len(FEATURES)))
            kept = ~np.asarray([s.base_failed for s in found], bool) & (anomaly <= model.threshold)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
