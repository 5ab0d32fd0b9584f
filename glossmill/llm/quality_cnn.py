"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become learned vectors; filters of eight bytes slide by four over the whole text.
Each filter's strongest answer is kept in every overlapping chunk of `2 * HALF` bytes
(half chunks are pooled once and neighbours joined), and the chunks' answers are combined
over the document by their mean, maximum and minimum into one probability.  Whole texts
are scored; of a very long labelled text slices from all over it are learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import held_out, single_thread, text_bytes

EMBED = 8
STEP = 4
FILTERS = 32
HIDDEN = 16
HALF = 256
#: Labelled rows the network learns from: the first by a hash of doc_id.
SAMPLE_ROWS = 6000
#: A labelled text is learned from by at most so many slices, evenly spread over all of it, of so many characters.
LEARN_SLICES, LEARN_WIDTH = 12, 512
EPOCHS = 12
#: Few rows are gone over more often, up to this many steps in all.
LEAST_STEPS = 1200
BATCH = 32
#: Half chunks convolved at a time.
STRETCH = 1024
ROUND_BYTES = 1 << 20
CUT = 0.7
GOOD_COUNTS = 3.0


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in half chunks, each followed by zeros, and the number of half chunks of each."""
    halves = np.fromiter((-(-(len(t) + STEP) // HALF) for t in texts), np.int64, len(texts))
    out = np.zeros(int(halves.sum()) * HALF, np.uint8)
    at = 0
    for text, n in zip(texts, halves.tolist(), strict=True):
        out[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * HALF
    return out, halves


@dataclass
class ByteConvNet:
    """Weights and the forward and backward passes."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 42) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        width = EMBED * STEP
        shapes = {"embed": (256, EMBED), "near": (width, FILTERS), "next": (width, FILTERS), "bias": (FILTERS,), "mix": (3 * FILTERS + 1, HIDDEN), "mix_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}
        scale = {"embed": 0.5, "near": (2 * width) ** -0.5 * 1.4, "next": (2 * width) ** -0.5 * 1.4, "mix": (3 * FILTERS) ** -0.5, "out": HIDDEN**-0.5}
        return cls({k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes.items()})

    def _pooled(self, packed: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strongest answer of each filter in each half chunk, and the step where it was.

        A stretch of half chunks is worked at a time, so memory does not follow a text's
        length.  A text's very last step, which is all padding, would look into the next
        text and is left out.
        """
        w, per = self.w, HALF // STEP
        closing = np.cumsum(halves) * per - 1
        n = len(packed) // HALF
        pooled, where = np.empty((n, FILTERS), w["bias"].dtype), np.empty((n, FILTERS), np.int64)
        for at in range(0, n, STRETCH):
            own = packed[at * HALF : (at + STRETCH) * HALF + STEP]  # and the step that follows, if any
            blocks = w["embed"][own].reshape(-1, EMBED * STEP)
            here = min(STRETCH, n - at) * per
            answers = blocks[:here] @ w["near"]
            after = blocks[1 : here + 1] @ w["next"]
            answers[: len(after)] += after
            answers[closing[(closing >= at * per) & (closing < at * per + here)] - at * per] = -np.inf
            answers = answers.reshape(-1, per, FILTERS)
            best = answers.argmax(1)
            where[at : at + STRETCH] = best
            pooled[at : at + STRETCH] = np.take_along_axis(answers, best[:, None], 1)[:, 0]
        return np.maximum(pooled + w["bias"], 0), where

    def forward(self, texts: list[bytes], keep: bool = False, sizes: np.ndarray | None = None):
        """Logits; `sizes` are the bytes of the whole texts where `texts` are parts of them."""
        w = self.w
        sizes = np.fromiter(map(len, texts), np.float32, len(texts)) if sizes is None else sizes.astype(np.float32)
        packed, halves = _pack(texts)
        pooled, at = self._pooled(packed, halves)
        starts = np.concatenate([[0], np.cumsum(halves)[:-1]])
        last = np.zeros(len(pooled), bool)
        last[starts + halves - 1] = True
        partner = np.where(last, np.arange(len(pooled)), np.arange(len(pooled)) + 1)
        chunk = np.maximum(pooled, pooled[partner])
        # A text's closing half chunk stands alone only if it is the whole text.
        alone = halves == 1
        mean = np.add.reduceat(chunk, starts) / halves[:, None]
        high, low = np.maximum.reduceat(chunk, starts), self._low(chunk, last, starts, alone)
        length = np.log1p(sizes)[:, None] / 10
        features = np.concatenate([mean, high, low, length], 1, dtype=np.float32)
        hidden = np.tanh(features @ w["mix"] + w["mix_bias"])
        logit = hidden @ w["out"] + w["out_bias"]
        if not keep:
            return logit
        return logit, (packed, halves, starts, last, alone, partner, pooled, at, chunk, high, low, features, hidden)

    @staticmethod
    def _low(chunk: np.ndarray, last: np.ndarray, starts: np.ndarray, alone: np.ndarray) -> np.ndarray:
        hidden = chunk + np.where(last & ~np.isin(np.arange(len(chunk)), starts[alone]), np.float32(1e6), np.float32(0))[:, None]
        return np.minimum.reduceat(hidden, starts)

    def gradients(self, texts: list[bytes], target: np.ndarray, weight: np.ndarray, sizes: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        w = self.w
        logit, (packed, halves, starts, last, alone, partner, pooled, at, chunk, high, low, features, hidden) = self.forward(texts, True, sizes)
        p = 1 / (1 + np.exp(-logit))
        loss = float((weight * np.where(target, np.logaddexp(0, -logit), np.logaddexp(0, logit))).sum() / weight.sum())
        g: dict[str, np.ndarray] = {}
        d = (weight * (p - target) / weight.sum()).astype(np.float32)
        g["out"], g["out_bias"] = hidden.T @ d, d.sum(keepdims=True)
        dh = d[:, None] * w["out"] * (1 - hidden**2)
        g["mix"], g["mix_bias"] = features.T @ dh, dh.sum(0)
        df = dh @ w["mix"].T
        doc = np.repeat(np.arange(len(texts)), halves)
        closing = last & ~np.isin(np.arange(len(chunk)), starts[alone])
        dc = (df[:, :FILTERS] / halves[:, None])[doc]
        # Overlapping chunks often tie, as they share a half; ties share the gradient.
        for k, same in ((1, chunk == high[doc]), (2, (chunk == low[doc]) & ~closing[:, None])):
            dc = dc + (df[:, k * FILTERS : (k + 1) * FILTERS] / np.maximum(np.add.reduceat(same, starts, dtype=np.float32), 1))[doc] * same
        own = pooled >= pooled[partner]
        dp = np.where(own, dc, 0)
        np.add.at(dp, partner, np.where(own, 0, dc))
        dp *= pooled > 0
        g["bias"] = dp.sum(0)
        g["near"], g["next"], g["embed"] = np.zeros_like(w["near"]), np.zeros_like(w["next"]), np.zeros_like(w["embed"])
        per = HALF // STEP
        where = at + np.arange(len(at))[:, None] * per  # block of the strongest answer, by half chunk and filter
        letters = packed.reshape(-1, STEP)
        into, back = [], []
        for f in range(FILTERS):
            live = np.flatnonzero(dp[:, f])
            if not len(live):
                continue
            v = dp[live, f]
            for name, block in (("near", where[live, f]), ("next", where[live, f] + 1)):
                g[name][:, f] = v @ w["embed"][letters[block]].reshape(-1, EMBED * STEP)
                back.append((v[:, None] * w[name][:, f]).ravel())
                into.append(letters[block].ravel())
        if into:
            cells = np.concatenate(into).astype(np.int64)[:, None] * EMBED + np.arange(EMBED)
            g["embed"] += np.bincount(cells.ravel(), np.concatenate(back), 256 * EMBED).reshape(256, EMBED)
        return loss, g

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Logits of many texts in rounds of bounded size; one longer text is a round by itself."""
        out, held, size = [], [], 0
        for text in texts:
            if held and size + len(text) > ROUND_BYTES:
                out.append(self.forward(held))
                held, size = [], 0
            held.append(text)
            size += len(text) + HALF
        if held:
            out.append(self.forward(held))
        return np.concatenate(out) if out else np.zeros(0, np.float32)


def _adam(net: ByteConvNet, grads: dict, state: dict, rate: float, step: int) -> None:
    for k, g in grads.items():
        m, v = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        state[k] = (m, v)
        net.w[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


@dataclass
class QualityNet:
    """A trained network; `shift` puts the best cut between good and bad at `CUT`."""

    net: ByteConvNet
    shift: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.net.logits(texts).astype(float) - self.shift + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_cut(logits: np.ndarray, good: np.ndarray) -> float:
    """The logit that separates best, midway in its gap; a lost good row counts `GOOD_COUNTS` times a missed bad one."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum())
    good_above = 1 - np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    gain = bad_below + GOOD_COUNTS * good_above
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = int(best[len(best) // 2])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    return float((edges[at] + edges[at + 1]) / 2)


def train(texts: list[bytes], good: np.ndarray, sizes: np.ndarray | None = None, epochs: int = EPOCHS, seed: int = 42) -> QualityNet:
    """Fit by Adam, classes weighing the same; a fifth of the rows sets the cut.  `sizes` as in `forward`."""
    net = ByteConvNet.fresh(seed)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) if sizes is None else sizes
    if not len(texts) or good.all() or not good.any():
        level = 4.0 if len(texts) and good.all() else -4.0 if len(texts) else 0.0
        net.w["out"][:] = 0
        return QualityNet(net, -level)
    rng = np.random.default_rng(seed)
    check = rng.random(len(texts)) < 0.2
    learn = np.flatnonzero(~check)
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean())).astype(np.float32)
    state: dict = {}
    step = 0
    rounds = max(1, len(learn) // BATCH)
    epochs = max(epochs, LEAST_STEPS // rounds)
    total = epochs * rounds
    for _ in range(epochs):
        rng.shuffle(learn)
        for at in range(0, len(learn) - len(learn) % BATCH or len(learn), BATCH):
            own = learn[at : at + BATCH]
            step += 1
            _, grads = net.gradients([texts[i] for i in own], good[own], weight[own], sizes[own])
            _adam(net, grads, state, 0.004 * (1 - 0.95 * min(1.0, step / total)), step)
    cut = check if good[check].any() and not good[check].all() else ~check
    own = np.flatnonzero(cut)
    logits = [net.forward([texts[i] for i in own[at : at + BATCH]], sizes=sizes[own[at : at + BATCH]]) for at in range(0, len(own), BATCH)]
    return QualityNet(net, best_cut(np.concatenate(logits), good[own]))


def learned_part(slices: int = LEARN_SLICES, width: int = LEARN_WIDTH) -> Column:
    """A text whole if it is short, else its slices, evenly spread from the first character to the last."""
    at = lambda i: F.floor((F.length("text") - F.lit(width)) * i / max(1, slices - 1)).cast("int") + 1
    spread = F.concat(*(F.substring(F.col("text"), at(F.lit(i)), F.lit(width)) for i in range(slices)))
    text = F.coalesce("text", F.lit(""))
    return F.when(F.length(text) <= slices * width, text).otherwise(spread)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, learn_slices: int = LEARN_SLICES, learn_width: int = LEARN_WIDTH) -> QualityNet:
    """Train on at most `sample_rows` labelled rows outside the held-out part, however long their texts.

    Only the text is an input; what of it is learned from, at most `learn_slices` slices of
    `learn_width` characters, bounds the driver's memory.  Labels that are null or of
    unknown documents are left out.
    """
    single_thread()
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)  # two numbers a row
    parts = docs.select("doc_id", learned_part(learn_slices, learn_width).alias("part"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    found = parts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "size", "part", "quality").limit(sample_rows)
    rows = found.select("part", "size", "quality").collect()
    return train([r["part"].encode() for r in rows], np.asarray([r["quality"] == 1 for r in rows], bool), np.asarray([r["size"] for r in rows], np.int64))


def classify(docs: DataFrame, model: QualityNet) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Whole texts are scored, very long ones in stretches; null and empty ones as no bytes
    at all.  Rows are scored one by one, repeated rows and ties alike, and an empty table
    gives an empty result.  A null doc_id is not held out.  Other columns, of whatever
    names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        for batch in batches:
            score = np.concatenate([model.scores(text_bytes(batch.column("text").slice(at, 512))) for at in range(0, max(batch.num_rows, 1), 512)])
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
