"""Scoring predictions against references."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.functions.text import edit_distance_similarity, exact_match, normalize_text, with_gleu
from glossmill.operators.analyze import OVERALL
from glossmill.sources.scratch import settle

WARMUP = 30


def match_predictions(predictions: DataFrame, references: DataFrame, seq: str | None = None) -> DataFrame:
    """(id, lang, prediction, target) of predictions whose id has a reference.

    Of references with one id the last by `seq` holds, which may be a struct (files have
    their rows' places, `files.read_jsonl_placed`).  Rows of a DataFrame have no order, so
    without a `seq` the greatest target, then language, holds.  Predictions are not
    deduplicated.  The language is the reference's, `unknown` if it has none.
    """
    fields = F.struct(F.col("target"), F.col("lang").alias("ref_lang"))
    last = F.max_by(fields, seq) if seq else F.max(fields)
    refs = references.groupBy("id").agg(last.alias("r")).select("id", "r.*")
    lang = F.coalesce("ref_lang", F.lit("unknown"))
    return predictions.select("id", "prediction").join(refs, "id").select("id", lang.alias("lang"), "prediction", "target")


def score_matches(matched: DataFrame, composed: bool = False) -> DataFrame:
    """Add exact_match, edit_distance_similarity and gleu of normalized texts."""
    staged = matched.withColumns({"__pred": normalize_text("prediction", composed), "__target": normalize_text("target", composed)})
    staged = with_gleu(staged, "__pred", "__target")
    return staged.withColumns({"exact_match": exact_match("__pred", "__target"), "edit_distance_similarity": edit_distance_similarity("__pred", "__target")}).drop("__pred", "__target")


def evaluate(predictions: DataFrame, references: DataFrame, seq: str | None = None, composed: bool = False) -> DataFrame:
    """(lang, n_predictions, n_matched, exact_match, edit_distance_similarity, gleu): each language and `__overall__`.

    `n_predictions` counts all predictions and stands in the overall row alone, which is
    there, with zeros, even if nothing matches.
    """
    scored = score_matches(match_predictions(predictions, references, seq), composed)
    names = ("exact_match", "edit_distance_similarity", "gleu")
    sums = scored.groupBy("lang").agg(F.count("*").alias("n_matched"), *(F.sum(c).alias(c) for c in names))
    # One more row, of no language, brings the count of all predictions into the same small aggregate.
    none = [F.lit(None).cast("double").alias(c) for c in names]
    count = predictions.agg(F.count("*").alias("n_predictions")).select(F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n_matched"), *none, "n_predictions")
    rows = sums.withColumn("n_predictions", F.lit(None).cast("long")).unionByName(count)
    total = [F.sum(c).alias(c) for c in ("n_predictions", "n_matched", *names)]
    level = rows.groupingSets([[F.col("lang")], []], "lang").agg(F.grouping("lang").alias("__all"), *total).where("__all = 1 OR lang IS NOT NULL")
    lang = F.when(F.col("__all") == 1, OVERALL).otherwise(F.col("lang")).alias("lang")
    mean = lambda c: F.when(F.col("n_matched") > 0, F.col(c) / F.col("n_matched")).otherwise(F.lit(0.0)).alias(c)
    return level.select(lang, "n_predictions", "n_matched", *(mean(c) for c in names))


def report(rows: list[dict]) -> dict:
    """The metrics as nested dictionaries, languages sorted."""
    names = ("exact_match", "edit_distance_similarity", "gleu")
    by = {r["lang"]: r for r in rows}
    whole = by.pop(OVERALL)
    return {
        "overall": {"n_predictions": whole["n_predictions"], "n_matched": whole["n_matched"], **{c: whole[c] for c in names}},
        "per_language": {k: {"n": by[k]["n_matched"], **{c: by[k][c] for c in names}} for k in sorted(by)},
    }


def _running(placed: DataFrame, lang: str, score: str) -> DataFrame:
    """Add `__n`, `__mean`, `__m2`: count, mean and squared deviations of a language up to the current row of its part, rows being in order."""
    schema = T.StructType([*placed.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("__n", "__mean", "__m2"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the language at the last row: its name, rows so far, first score, and sums of what lies above that score.
        name, n, first, total, squares = object(), 0, 0.0, 0.0, 0.0
        for batch in batches:
            codes = batch.column(lang).dictionary_encode()
            at = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = batch.column(score).to_numpy(zero_copy_only=False).astype(float)
            out = np.zeros((3, len(x)))
            starts = np.flatnonzero(np.diff(at, prepend=np.iinfo(np.int32).min)) if len(x) else []
            for start, end in pairwise([*starts, len(x)]):
                own = codes.dictionary[int(at[start])].as_py() if at[start] >= 0 else None
                if own != name:
                    name, n, first, total, squares = own, 0, x[start], 0.0, 0.0
                d = x[start:end] - first
                rows, sums, square_sums = n + np.arange(1, len(d) + 1), total + np.cumsum(d), squares + np.cumsum(d * d)
                out[:, start:end] = rows, first + sums / rows, np.maximum(square_sums - sums * sums / rows, 0.0)
                n, total, squares = int(rows[-1]), sums[-1], square_sums[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=schema.fieldNames())

    return placed.mapInArrow(run, schema)


def running_normalization(scores: DataFrame, lang: str = "lang", seq: str = "seq", score: str = "score", warmup: int = WARMUP, parts: int | None = None) -> DataFrame:
    """Add `normalized`: the score against its language's running mean and population deviation.

    Both include the current row; the first `warmup - 1` rows of a language keep their
    score.  `seq` orders a language's rows, without repeats.  This is a scan by prefixes:
    rows are written once, range-partitioned by language and seq from a sample of them, so
    parts are even however seq is spread and a large language lies over many; each part
    is run through in order; and what its few languages amount to at its end is added up
    over the parts before.  Scores are worked out once, and no digits are lost in
    differences of large sums, which are taken around a score of their own part.
    """
    spark = scores.sparkSession
    stored = settle(scores, "scores")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored.repartitionByRange(parts, F.col(lang), F.col(seq)).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(lang, seq)
    staged = settle(_running(placed, lang, score), "running")
    # A part's last row of a language has its sums: a part has its own languages, and all parts share few.
    ends = staged.groupBy(lang, "__part").agg(F.max_by(F.struct("__n", "__mean", "__m2"), "__n").alias("e"))
    ends = ends.select(F.col(lang).alias("__lang"), F.col("__part").alias("__p"), "e.*")
    in_order = Window.partitionBy("__lang").orderBy("__p")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # Sums over parts are taken around the mean of a language's first part.
    first = F.first("__mean").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    off = F.col("__n") * (F.col("__mean") - F.col("__centre"))
    sums = {"__n0": F.col("__n"), "__s0": off, "__q0": F.col("__m2") + off * (F.col("__mean") - F.col("__centre"))}
    starts = ends.withColumn("__centre", first).select("__lang", "__p", "__centre", *(F.coalesce(F.sum(v).over(before), F.lit(0.0)).alias(k) for k, v in sums.items()))
    staged = staged.join(starts, F.col(lang).eqNullSafe(F.col("__lang")) & (F.col("__part") == F.col("__p")))
    n = F.col("__n0") + F.col("__n")
    own = F.col("__mean") - F.col("__centre")
    shift = (F.col("__s0") + F.col("__n") * own) / n  # the mean, less the centre
    deviations = F.col("__q0") + F.col("__m2") + F.col("__n") * own * own - n * shift * shift
    spread = F.greatest(F.sqrt(F.greatest(deviations / n, F.lit(0.0))), F.lit(1e-6))
    value = F.when(n < warmup, F.col(score)).otherwise((F.col(score) - F.col("__centre") - shift) / spread)
    return staged.withColumn("normalized", value).select(*scores.columns, "normalized")
