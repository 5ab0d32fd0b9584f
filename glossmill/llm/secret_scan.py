"""Secret scans: fixed patterns, and formats learned from what they find.

Matches of the fixed patterns are labelled credentials.  The values of a kind build a
prefix tree whose states are merged, depth by depth, where their next-symbol frequencies
and ends agree within a Hoeffding bound.  What is left is a small probabilistic automaton
that holds the format's prefixes, its alphabet at each place and its lengths.  Every run
of credential characters outside the fixed matches is a candidate, however short; its
score is the log-likelihood under the best automaton against a character chain of all
ordinary runs of the corpus.  Runs from the calibrated threshold on are spans of kind
`learned`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import settle, text_strings

#: Kind, pattern, group whose length counts, least length.
KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
_KEYWORDS = ("password", "passwd", "secret", "token", "api")

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
END = len(SYMBOLS)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])\.*([A-Za-z0-9+/_=-](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_=-])?)")
#: Marks off a word's ends that no run begins or ends with.
_EDGES = ".,;:!?()[]{}\"'"
_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(END)

#: Distinct values a kind's automaton is learned from, the first by hash, and characters of each.
SAMPLE_VALUES = 600
SAMPLE_CHARS = 128
#: Parts of the values, each of which is scored by automata learned from the others.
FOLDS = 4
ALPHA = 0.01
#: Weight, in values, of the kind's overall symbols in a state's frequencies.
PRIOR = 2.0
#: Weight of one step never seen, in the chain of ordinary runs and in a kind's symbols.
UNSEEN = 0.5
#: Least log-likelihood ratio of a secret: odds of a hundred to one.
MARGIN = math.log(100)
#: Share of labelled values that may score below the threshold, and of ordinary runs above it, where the two don't part.
LOST, TAKEN = 0.02, 1e-4
#: Scores are counted in bins of this width, up to this score on either side, and beyond in so many for each doubling.
BIN, WIDEST, DOUBLING = 0.25, 400.0, 64

Span = tuple[int, int, str, str]  # start, end, kind, value


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, by start, then kind."""
    longest = max(map(len, text.split()), default=0)
    out: list[Span] = []
    lower = text.lower()  # keeps every ASCII keyword findable; the pattern decides
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if longest >= ACCESS_LEAST and "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if longest >= HEX_LEAST:
        out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple:
    return s[0], KINDS.index(s[2])


def outside(text: str, base: list[Span]) -> str:
    """The text with blanks for what the fixed patterns matched; places stay."""
    parts, at = [], 0
    for start, end, *_ in base:
        if end > at:
            parts += [text[at:start], " " * (end - max(start, at))]
            at = end
    return "".join([*parts, text[at:]]) if parts else text


def runs(word: str) -> list[tuple[int, int]]:
    """Credential runs of a text without the periods around them.

    The value of an assignment within a run is a run of its own besides the whole.
    """
    out = []
    for m in _RUN.finditer(word):
        start, end = m.span(1)
        out.append((start, end))
        inner = word.rfind("=", start, start + len(word[start:end].rstrip("=")))
        if inner >= start:
            out.append((inner + 1, end))
    return out


def run_texts(word: str) -> list[str]:
    """The texts of a word's runs.  Most words are one run of letters or digits between marks that no run has at its ends."""
    plain = word.strip(_EDGES)
    if plain.isalnum() and plain.isascii():
        return [plain]
    return [word[a:b] for a, b in runs(word)] if "=" in word else _RUN.findall(word)


def split_words(texts: list[str]) -> pa.Array:
    """Words of each text, parted at ASCII white space, as lists."""
    return pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


@dataclass
class Automaton:
    """A deterministic probabilistic automaton as arrays: log-probabilities and successors by state and symbol.

    A symbol not seen in a state leads to the commonest state of the next depth.  The
    last state stands for all places beyond the deepest and leads to itself.
    """

    logp: np.ndarray
    follow: np.ndarray
    depth: np.ndarray

    @classmethod
    def infer(cls, values: Iterable[str], alpha: float = ALPHA, chars: int = SAMPLE_CHARS) -> Automaton:
        """Merge a prefix tree's compatible states of equal depth, the commonest first."""
        tree = _PrefixTree(values, chars)
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        layers, layer = [[0]], [0]
        while layer:
            below = sorted((t for s in layer for t in tree.follow[s].values()), key=lambda t: (-tree.total[t], tree.first[t]))
            kept: list[int] = []
            place: dict[int, int] = {}
            for t in below:
                match = next((k for k in kept if tree.agree(k, t, bound)), None)
                if match is None:
                    kept.append(t)
                else:
                    tree.fold(match, t)
                place[t] = t if match is None else match
            for s in layer:
                tree.follow[s] = {c: place[t] for c, t in tree.follow[s].items()}
            layer = kept
            if layer:
                layers.append(layer)
        return cls._dense(tree, layers)

    @classmethod
    def _dense(cls, tree: _PrefixTree, layers: list[list[int]]) -> Automaton:
        states = [s for layer in layers for s in layer]
        at = {s: i for i, s in enumerate(states)}
        tail = len(states)
        seen = np.zeros((tail + 1, END + 1))
        follow = np.empty((tail + 1, END), np.int32)
        follow[tail] = tail
        depth = np.zeros(tail + 1, np.int32)
        depth[tail] = len(layers)
        for d, layer in enumerate(layers):
            common = at[layers[d + 1][0]] if d + 1 < len(layers) else tail
            for s in layer:
                i, depth[at[s]] = at[s], d
                follow[i] = common
                for c, n in tree.counts[s].items():
                    seen[i, c] = n
                    follow[i, c] = at.get(tree.follow[s].get(c), tail)
                seen[i, END] = tree.ends[s]
        whole = seen.sum(0) + UNSEEN
        prior = PRIOR * whole / whole.sum()
        return cls(np.log((seen + prior) / (seen.sum(1, keepdims=True) + PRIOR)), follow, depth)

    def log_likelihood(self, values: list[str]) -> np.ndarray:
        """Natural logarithms of the values' probabilities, all characters and the end counted."""
        return _walk(values, self.logp, self.follow)


class _PrefixTree:
    """Counts of symbols and ends by prefix; a value longer than `chars` ends nowhere."""

    def __init__(self, values: Iterable[str], chars: int = SAMPLE_CHARS):
        self.counts: list[dict[int, float]] = [{}]
        self.follow: list[dict[int, int]] = [{}]
        self.ends, self.total, self.first = [0.0], [0.0], [()]
        for value in values:
            at = 0
            self.total[0] += 1
            for c in _CODE[np.frombuffer(value[:chars].encode(), np.uint8)].tolist():
                self.counts[at][c] = self.counts[at].get(c, 0) + 1
                if c not in self.follow[at]:
                    self.follow[at][c] = len(self.total)
                    self.first.append((*self.first[at], c))
                    for store, new in ((self.counts, {}), (self.follow, {}), (self.ends, 0.0), (self.total, 0.0)):
                        store.append(new)
                at = self.follow[at][c]
                self.total[at] += 1
            self.ends[at] += len(value) <= chars

    def agree(self, x: int, y: int, bound: float) -> bool:
        """Frequencies and ends of states x and y, and of all states they share a path to, differ within the bound."""
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            n, m = self.total[x], self.total[y]
            limit = bound * (n**-0.5 + m**-0.5)
            if limit < 1:  # else no two frequencies can differ by more
                if abs(self.ends[x] / n - self.ends[y] / m) > limit:
                    return False
                cx, cy = self.counts[x], self.counts[y]
                if any(abs(cx.get(c, 0) / n - cy.get(c, 0) / m) > limit for c in cx.keys() | cy.keys()):
                    return False
                todo += [(self.follow[x][c], self.follow[y][c]) for c in self.follow[x].keys() & self.follow[y].keys()]
        return True

    def fold(self, x: int, y: int) -> None:
        """Add the tree below y to state x."""
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            self.total[x] += self.total[y]
            for c, n in self.counts[y].items():
                self.counts[x][c] = self.counts[x].get(c, 0) + n
                if c in self.follow[x]:
                    todo.append((self.follow[x][c], self.follow[y][c]))
                else:
                    self.follow[x][c] = self.follow[y][c]


def _walk(values: list[str], logp: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Sum the steps of all values side by side, the longest first so that the live ones stay in front."""
    if not values:
        return np.zeros(0)
    size = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-size, kind="stable")
    codes = _CODE[np.frombuffer("".join(values).encode(), np.uint8)]
    starts = (np.cumsum(size) - size)[order]
    live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    at, out = np.zeros(len(values), np.int32), np.zeros(len(values))
    for i, n in enumerate(live.tolist()):
        c, s = codes[starts[:n] + i], at[:n]
        out[:n] += logp[s, c]
        at[:n] = follow[s, c]
    out += logp[at, END]
    back = np.empty(len(values))
    back[order] = out
    return back


@dataclass
class FormatModel:
    """Automata by kind, the chain of ordinary runs, and the score from which a run is a secret."""

    formats: dict[str, Automaton]
    chain: np.ndarray
    threshold: float = math.inf

    def scores(self, values: list[str]) -> np.ndarray:
        """Log-likelihood ratio of the best format against ordinary runs."""
        if not self.formats or not values:
            return np.full(len(values), -math.inf)
        best = np.max([a.log_likelihood(values) for a in self.formats.values()], axis=0)
        # The chain's states are the last character, and one for the start.
        follow = np.tile(np.arange(1, END + 1, dtype=np.int32), (END + 1, 1))
        return best - _walk(values, self.chain, follow)

    def secrets(self, words: Iterable[str]) -> set[str]:
        """Of these words those with a run that is a secret."""
        found = [(w, run) for w in words for run in run_texts(w)]
        return {w for (w, _), hit in zip(found, self.scores([r for _, r in found]) >= self.threshold, strict=True) if hit}

    def texts_with_secrets(self, texts: list[str]) -> set[int]:
        """Places of the texts that have a word with a secret; each distinct word is scored once."""
        words = split_words(texts)
        every = words.flatten()
        secret = self.secrets(_strings(pc.unique(every)))
        if not secret:
            return set()
        hits = np.flatnonzero(pc.is_in(every, pa.array(sorted(secret), pa.large_string())).to_numpy(zero_copy_only=False))
        return set((np.searchsorted(words.offsets.to_numpy(), hits, side="right") - 1).tolist())

    def spans(self, text: str) -> list[Span]:
        """Secrets of a text with blanks for the fixed matches: of a run and its inner value the run, if it is one."""
        found = runs(text)
        hits = self.scores([text[a:b] for a, b in found]) >= self.threshold
        out: list[Span] = []
        for (a, b), hit in zip(found, hits, strict=True):
            if hit and not (out and out[-1][1] > a):
                out.append((a, b, "learned", text[a:b]))
        return out


def chain_of(steps: dict[tuple[int, int], int]) -> np.ndarray:
    """Log-probabilities of a character (or the end) after a character (or the start), from counts of steps."""
    seen = np.full((END + 1, END + 1), UNSEEN)
    for (before, after), n in steps.items():
        seen[before, after] += n
    return np.log(seen / seen.sum(1, keepdims=True))


def fold_of_value(value: str) -> int:
    return hashlib.blake2b(value.encode(), digest_size=2).digest()[0] % FOLDS


def learn(values: dict[str, list[str]], steps: dict[tuple[int, int], int], chars: int = SAMPLE_CHARS) -> tuple[FormatModel, np.ndarray]:
    """The model without its threshold, and the scores of all values by automata that hadn't seen them.

    Values are parted into `FOLDS` by hash; those of a part are scored by automata of the
    other parts.  Any number of values teaches: few of them merge into one state a depth,
    smoothed by the symbols of the kind.
    """
    known = {k: sorted(set(v)) for k, v in values.items() if v}
    chain = chain_of(steps)
    unseen = []
    for part in range(FOLDS):
        others = {k: [x for x in v if fold_of_value(x) != part] for k, v in known.items()}
        model = FormatModel({k: Automaton.infer(v, chars=chars) for k, v in others.items() if v}, chain)
        unseen.append(model.scores(sorted({x for v in known.values() for x in v if fold_of_value(x) == part})))
    return FormatModel({k: Automaton.infer(v, chars=chars) for k, v in known.items()}, chain), np.concatenate(unseen)


def calibrate(unseen: np.ndarray, ordinary: dict[int, int]) -> float:
    """The threshold between labelled values scored unseen and the ordinary runs counted by bin of score.

    It lies halfway between the score that all but `LOST` of the values reach and the one
    that all but `TAKEN` of the ordinary runs (unlabelled secrets may be among them) stay
    below, and nowhere under `MARGIN`.  Where no value can be scored unseen, as with a
    single one, the ordinary runs alone decide.
    """
    unseen = unseen[np.isfinite(unseen)]
    low = float(np.quantile(unseen, LOST, method="lower")) if len(unseen) else math.inf
    total, above, high = sum(ordinary.values()), 0, -math.inf
    for b, n in sorted(ordinary.items(), reverse=True):
        above += n
        if above > total * TAKEN:
            high = _edge(b)
            break
    return max(MARGIN, (low + min(high, low)) / 2 if len(unseen) else high)


def _bins(scores: np.ndarray) -> np.ndarray:
    """Numbers of the scores' bins: `BIN` wide up to `WIDEST`, and beyond that `DOUBLING` for each doubling, without end."""
    far = np.abs(np.nan_to_num(scores, neginf=-1e300, posinf=1e300))
    beyond = int(WIDEST / BIN) + np.floor(DOUBLING * np.log2(np.maximum(far, WIDEST) / WIDEST))
    return np.where(far < WIDEST, np.floor(np.where(far < WIDEST, scores, 0.0) / BIN), np.where(scores > 0, beyond, -1 - beyond)).astype(np.int64)


def _edge(b: int) -> float:
    """The upper end of a bin."""
    last = int(WIDEST / BIN)
    if -last <= b < last:
        return (b + 1) * BIN
    return WIDEST * 2 ** ((b - last + 1) / DOUBLING) if b > 0 else -WIDEST * 2 ** ((-1 - b - last) / DOUBLING)


def _outside_base(batch: pa.RecordBatch) -> Iterator[tuple[list[Span], str]]:
    for text in text_strings(batch.column("text")):
        base = base_spans(text)
        yield base, outside(text, base)


def _run_counts(texts: list[str]) -> dict[str, int]:
    """How often each run occurs in the texts."""
    counted = pc.value_counts(split_words(texts).flatten())
    found: dict[str, int] = defaultdict(int)
    for word, n in zip(_strings(counted.field("values")), counted.field("counts").to_numpy().tolist(), strict=True):
        for run in run_texts(word):
            found[run] += n
    return found


def fit(docs: DataFrame, sample_values: int = SAMPLE_VALUES, sample_chars: int = SAMPLE_CHARS) -> FormatModel:
    """Learn formats from a bounded sample of labelled values, and the rest from all runs of all documents.

    Two passes over the texts: the first gathers the labelled values (of each at most
    `sample_chars` characters and whether it goes on) and counts the steps of every
    ordinary run, the second counts the scores of every ordinary run.  Without labelled
    values no format is known and nothing is added.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.zeros((END + 1, END + 1), np.int64)
        for batch in batches:
            labelled: set[tuple[str, str]] = set()
            texts = list(_outside_base(batch))
            labelled.update((s[2], s[3][: sample_chars + 1]) for base, _ in texts for s in base)
            _count_steps(_run_counts([rest for _, rest in texts]), steps)
            if labelled:
                kinds, values = zip(*sorted(labelled), strict=True)
                yield pa.record_batch([pa.array(kinds), pa.array(values), pa.array([0] * len(kinds), pa.int64())], names=["kind", "value", "n"])
        before, after = np.nonzero(steps)
        names = [f"{a} {b}" for a, b in zip(before.tolist(), after.tolist(), strict=True)]
        yield pa.record_batch([pa.array([""] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(steps[before, after], pa.int64())], names=["kind", "value", "n"])

    seen = settle(docs.select("text").mapInArrow(gather, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    # At most `sample_values` strings of `sample_chars` + 1 characters a kind, and one row for each pair of symbols.
    values = {k: [r["value"] for r in seen.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample_values).collect()] for k in KINDS[:3]}
    steps = {tuple(map(int, r["value"].split())): r["n"] for r in seen.where("kind = ''").collect()}
    model, unseen = learn(values, steps, sample_chars)
    if not model.formats:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Counter = Counter()
        for batch in batches:
            found = _run_counts([rest for _, rest in _outside_base(batch)])
            for b, n in zip(_bins(model.scores(list(found))).tolist(), found.values(), strict=True):
                bins[b] += n
        yield pa.record_batch([pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())], names=["bin", "n"])

    counted = docs.select("text").mapInArrow(measure, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    model.threshold = calibrate(unseen, {r["bin"]: r["n"] for r in counted.collect()})  # one row a bin
    return model


def _count_steps(found: dict[str, int], steps: np.ndarray) -> None:
    """Add the steps of runs, each as often as it was found, from the start to the end."""
    if not found:
        return
    size = np.fromiter(map(len, found), np.int64, len(found))
    codes = _CODE[np.frombuffer("".join(found).encode(), np.uint8)].astype(np.int64)
    times = np.fromiter(found.values(), np.int64, len(found))
    ends = np.cumsum(size) - 1
    # State 0 is the start, a character's state its code plus one.
    before = np.concatenate([[0], codes[:-1] + 1])
    before[ends[:-1] + 1] = 0
    np.add.at(steps, (before, codes), np.repeat(times, size))
    np.add.at(steps, (codes[ends] + 1, END), times)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def scan(docs: DataFrame, model: FormatModel) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned.

    Spans are kind:start:end in code points, end exclusive, by start, then kind in the
    order of `KINDS`.  A null or empty text has none (base_sha256 is that of the empty
    string).  Whole texts are read, very long ones too; rows are scanned one by one, so
    repeated rows and ties agree; null ids are carried; other columns, of whatever names,
    are ignored; an empty table gives an empty result.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_learned", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = list(_outside_base(batch))
            with_secrets = model.texts_with_secrets([rest for _, rest in texts]) if model.formats else set()
            for i, (base, rest) in enumerate(texts):
                more = model.spans(rest) if i in with_secrets else []
                kinds = [s[2] for s in base]
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, _written(sorted(base + more, key=_order)), len(more)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in list(schema)[1:]]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")
