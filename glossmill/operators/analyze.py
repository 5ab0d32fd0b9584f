"""Profiles of sample sets: per language and overall, before and after."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.text import edit_distance, normalize_text, word_count
from glossmill.operators.samples import is_augmented, is_identity_injected

OVERALL = "__overall__"
METRICS = (
    "n_samples", "n_identity", "n_augmented", "n_identity_injected", "identity_ratio",
    "avg_source_len_char", "avg_target_len_char", "avg_source_len_word", "avg_target_len_word",
    "avg_edit_distance", "avg_edit_similarity", "error_rate", "avg_correction_density",
)


def edit_measures(samples: DataFrame, composed: bool = False) -> DataFrame:
    """Add lengths, words, edit distance, similarity and correction density of source and target.

    A missing language is `unknown`, a missing text empty.  An empty side makes the
    distance the other's length and similarity 0; two empty sides are equal.
    """
    staged = samples.withColumns(
        {
            "lang": F.coalesce("lang", F.lit("unknown")),
            "__s": normalize_text(F.coalesce("source", F.lit("")), composed),
            "__t": normalize_text(F.coalesce("target", F.lit("")), composed),
        }
    )
    staged = staged.withColumns(
        {
            "source_chars": F.length("__s"),
            "target_chars": F.length("__t"),
            "source_words": word_count("__s"),
            "target_words": word_count("__t"),
            "edit_distance": edit_distance("__s", "__t"),
            "is_identity": F.col("__s") == F.col("__t"),
        }
    )
    longest = F.greatest("source_chars", "target_chars")
    density = F.when(longest == 0, F.lit(0.0)).when((F.col("source_chars") == 0) | (F.col("target_chars") == 0), F.lit(1.0)).otherwise(F.col("edit_distance") / F.col("source_chars"))
    similarity = F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.col("edit_distance") / longest)
    return staged.withColumns({"edit_similarity": similarity, "correction_density": density}).drop("__s", "__t")


_COUNTS = METRICS[:4]
_SUMS = ("source_chars", "target_chars", "source_words", "target_words", "edit_distance", "edit_similarity", "correction_density")


def _language_sums(measured: DataFrame, sides: dict[str, Column | None]) -> DataFrame:
    """Counts and sums by language and over all, which is named `__overall__`, for each side of the rows a condition picks.

    Rows are summed once by language; the overall row comes from those few sums.
    """
    id_ = F.coalesce("id", F.lit(""))
    flags = {"n_samples": F.lit(True), "n_identity": F.col("is_identity"), "n_augmented": is_augmented(id_), "n_identity_injected": is_identity_injected(id_)}
    found = []
    for side, picked in sides.items():
        own = (lambda c: c) if picked is None else (lambda c, picked=picked: F.when(picked, c))
        found += [F.count_if(own(flag)).alias(side + c) for c, flag in flags.items()]
        found += [F.coalesce(F.sum(own(F.col(c))), F.lit(0)).alias(side + c) for c in _SUMS]
    sums = measured.groupBy("lang").agg(*found)
    names = [c for c in sums.columns if c != "lang"]
    level = sums.groupingSets([[F.col("lang")], []], "lang").agg(F.grouping("lang").alias("__all"), F.count("*").alias("__n"), *(F.sum(c).alias(c) for c in names))
    return level.where("__n > 0").withColumn("lang", F.when(F.col("__all") == 1, OVERALL).otherwise(F.col("lang")))


def _metrics(side: str = "") -> list[Column]:
    """METRICS from counts and sums; a side without samples has zeros, as has its error rate."""
    n = F.col(side + "n_samples")
    mean = lambda c: F.when(n > 0, F.col(side + c) / n).otherwise(F.lit(0.0))
    values = [F.col(side + c) for c in _COUNTS] + [mean("n_identity"), *map(mean, _SUMS[:6]), F.when(n > 0, 1.0 - mean("edit_similarity")).otherwise(F.lit(0.0)), mean("correction_density")]
    return [v.alias(m) for v, m in zip(values, METRICS, strict=True)]


def language_stats(samples: DataFrame, composed: bool = False) -> DataFrame:
    """(lang, *METRICS): one row for each language and one for all, named `__overall__`; none for no samples."""
    return _language_sums(edit_measures(samples, composed), {"": None}).select("lang", *_metrics())


def compare_growth(base: DataFrame, added: DataFrame, composed: bool = False) -> DataFrame:
    """What `compare_stats` says of `base` before and of `base` with `added` after, measuring every sample once."""
    names = ["id", "lang", "source", "target"]
    both = base.select(*names, F.lit(True).alias("__old")).unionByName(added.select(*names, F.lit(False).alias("__old")))
    sums = _language_sums(edit_measures(both, composed), {"b_": F.col("__old"), "a_": None})
    sides = sums.select("lang", F.struct(*_metrics("b_")).alias("before"), F.struct(*_metrics("a_")).alias("after"))
    return sides.withColumn("delta", F.struct(*((F.col(f"after.{m}") - F.col(f"before.{m}")).alias(m) for m in METRICS)))


def compare_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """(lang, before, after, delta) structs of METRICS; a language on one side only has zeros on the other."""
    b = before.select("lang", *(F.col(m).alias(f"b_{m}") for m in METRICS))
    a = after.select("lang", *(F.col(m).alias(f"a_{m}") for m in METRICS))
    both = b.join(a, "lang", "full")
    value = lambda side, m: F.coalesce(F.col(f"{side}_{m}"), F.lit(0))
    return both.select(
        "lang",
        F.struct(*(value("b", m).alias(m) for m in METRICS)).alias("before"),
        F.struct(*(value("a", m).alias(m) for m in METRICS)).alias("after"),
        F.struct(*((value("a", m) - value("b", m)).alias(m) for m in METRICS)).alias("delta"),
    )


def language_histogram(samples: DataFrame) -> DataFrame:
    return samples.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")


def corpus_counts(samples: DataFrame) -> DataFrame:
    """(lang, corpus, split, n) with totals: a null split totals a corpus, a null corpus a split, all null everything."""
    counts = samples.groupBy("lang", "corpus", "split").agg(F.count("*").alias("n"))
    keys = [F.col(c) for c in ("lang", "corpus", "split")]
    return counts.groupingSets([keys, keys[:2], keys[2:], []], *keys).agg(F.sum("n").alias("n"))


#: Most numbers of n-grams that are counted in one array; beyond it a batch's n-grams are sorted.
_DENSE = 1 << 22


def _gram_counts(texts: pa.Array, n: int) -> tuple[list[str], np.ndarray]:
    """The distinct character n-grams of some texts and how often each is there."""
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(points) < n:
        return [], np.zeros(0, np.int64)
    # Characters are numbered by those there are; an n-gram is its characters' numbers in one.
    letters, numbers = np.unique(points, return_inverse=True)
    own = np.ones(len(points), bool)  # an n-gram that begins near its text's end is none
    ends = np.cumsum(lengths)
    for k in range(1, n):
        short = np.maximum(ends - k, ends - lengths)
        own[short[short < ends]] = False
    own = own[: len(points) - n + 1]
    size = len(letters)
    if size**n >= 1 << 62:
        grams: Counter[str] = Counter(joined[i : i + n] for i in np.flatnonzero(own).tolist())
        return list(grams), np.fromiter(grams.values(), np.int64, len(grams))
    codes = np.zeros(len(own), np.int64)
    for k in range(n):
        codes = codes * size + numbers[k : k + len(own)]
    codes = codes[own]
    if size**n <= _DENSE:
        every = np.bincount(codes, minlength=1)
        found = np.flatnonzero(every)
        counts = every[found]
    else:
        found, counts = np.unique(codes, return_counts=True)
    places = np.empty((len(found), n), np.int64)
    rest = found
    for k in reversed(range(n)):
        rest, places[:, k] = np.divmod(rest, size)
    text = letters[places].astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + n] for i in range(0, len(text), n)], counts


def char_ngram_counts(texts: DataFrame, text: str, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, gram, count) of the character n-grams of a column.

    Each batch of texts is counted as arrays of character numbers, so that rows are made of
    its distinct n-grams alone; Spark adds them up.
    """
    types = texts.select(*keys).schema
    schema = T.StructType([*types.fields, T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).combine_chunks()
            if not rows.num_rows:
                continue
            group = np.zeros(rows.num_rows, np.int64)
            for i in range(len(keys)):
                codes = rows.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
            for g in range(int(group.max()) + 1):
                own = np.flatnonzero(group == g)
                grams, counts = _gram_counts(rows.column("__text").combine_chunks().take(pa.array(own)), n)
                first = rows.take(pa.array(np.full(len(grams), own[0])))
                columns = [*(first.column(i).combine_chunks() for i in range(len(keys))), pa.array(grams, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    parts = texts.where(F.length(text) >= n).select(*keys, F.col(text).alias("__text")).mapInArrow(run, schema)
    return parts.groupBy(*keys, "gram").agg(F.sum("n").alias("count"))


def as_table(rows: list[dict]) -> str:
    """Rows as lines of text: names on top, columns as wide as their longest cell, words to the left and numbers to the right."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    cells = [names, *([shown(r.get(k)) for k in names] for r in rows)]
    width = [max(len(line[i]) for line in cells) for i in range(len(names))]
    words = [any(isinstance(r.get(k), str) for r in rows) for k in names]
    return "\n".join("  ".join(c.ljust(w) if left else c.rjust(w) for c, w, left in zip(line, width, words, strict=True)).rstrip() for line in cells)


def in_order(rows: list[dict]) -> list[dict]:
    """Languages by name, all of them last."""
    return sorted(rows, key=lambda r: (r["lang"] == OVERALL, r["lang"]))


def format_stats(rows: list[dict]) -> str:
    """A profile, a line a language."""
    return as_table(in_order(rows))


def format_comparison(rows: list[dict]) -> str:
    """A comparison, a line for each language and metric that changed."""
    lines = [{"lang": r["lang"], "metric": m, **{side: r[side][m] for side in ("before", "after", "delta")}} for r in in_order(rows) for m in METRICS if r["delta"][m]]
    return as_table(lines)
