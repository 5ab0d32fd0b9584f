"""The composite runs: build, augment, analyze, evaluate, prepare, infer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.scoring import DATA_SOURCE_PREFIX
from glossmill.functions.text import strip
from glossmill.operators import analyze, evaluate, sampling
from glossmill.operators.samples import align_documents, align_essays, align_lines, build_samples, filter_pairs, rl_records, sft_records
from glossmill.schemas import PREDICTION, REFERENCE, SAMPLE, SPLITS
from glossmill.sources import files
from glossmill.sources.scratch import settle

# What each training stage adds by default.
STAGE_DEFAULTS = {
    "sft": {"identity_ratio": 0.07, "noise_ratio": 0.15, "noise_rate": 0.05, "noise_type": "mixed"},
    "grpo": {"identity_ratio": 0.05, "noise_ratio": 0.0, "noise_rate": 0.0, "noise_type": "none"},
}


def samples_from_corpora(spark: SparkSession, data_dir: str, max_source_len: int = 1024, max_target_len: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """Samples of all corpora below a folder: every essay against each of its references.

    Essay files are read once, in input splits of `split_bytes` if given; essays with their
    places are stored, as both sides of the alignment come from them.
    """
    corpora = files.discover_corpora(spark, data_dir)
    one_name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  readers differ in it
    essay_files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(data_dir).select("path")
    placed = settle(files.classify_files(essay_files).join(corpora, "corpus_dir").withColumn("path", one_name("path")), "essay_files")
    # Some 300 bytes a file; beyond that many they are joined by shuffle.
    placed = F.broadcast(placed) if placed.count() <= files.BROADCAST_SPLITS else placed
    essays = settle(files.read_essays(spark, data_dir, recursive=True, split_bytes=split_bytes).withColumn("path", one_name("path")).join(placed, "path"), "essays")
    keys = ("corpus_dir", "corpus_name", "lang_code", "sentence_aligned", "split", "essay_id")
    orig = essays.where("kind = 'orig'").select(*keys, F.col("text").alias("orig_text"))
    refs = essays.where("kind = 'ref'").select(*keys, F.col("ref_key").alias("ref"), F.col("text").alias("ref_text"))
    aligned = align_essays(orig, refs, keys)
    place = (*keys, "ref")
    lines = align_lines(aligned.where("sentence_aligned"), place).drop("line_no")
    whole = align_documents(aligned.where("NOT sentence_aligned"), place)
    pairs = filter_pairs(lines.unionByName(whole), max_source_len, max_target_len)
    return build_samples(pairs.withColumnsRenamed({"lang_code": "lang", "corpus_name": "corpus"}))


def build_dataset(
    spark: SparkSession, data_dir: str, output_dir: str, max_source_len: int = 1024, prefix: str = DATA_SOURCE_PREFIX, max_target_len: int | None = None,
    split_bytes: int | None = None, compression: str = "none",
) -> DataFrame:
    """Write the samples of every split as JSON lines and Parquet, file names and data sources with a prefix; returns the counts."""
    samples = samples_from_corpora(spark, data_dir, max_source_len, max_target_len, split_bytes)
    out = f"{output_dir}/samples"
    samples.write.mode("overwrite").partitionBy("split").parquet(out)
    stored = spark.read.schema(SAMPLE).parquet(out)
    for split in SPLITS:
        files.write_jsonl(stored.where(F.col("split") == split), f"{output_dir}/{prefix}{split}.jsonl", compression)
    files.write_parquet_by_split(rl_records(stored, True, prefix), output_dir, prefix)
    return analyze.corpus_counts(stored)


def augment(
    samples: DataFrame, stage: str = "sft", identity_ratio: float | None = None, noise_ratio: float | None = None, noise_rate: float | None = None,
    noise_type: str | None = None, balance_strategy: str | None = "sqrt", seed: int = 42, seq: str | None = None, rebuild: bool = False,
) -> DataFrame:
    """Samples with identity and noisy copies, then balanced; what is not given follows the stage, unknown ones `sft`."""
    given = {"identity_ratio": identity_ratio, "noise_ratio": noise_ratio, "noise_rate": noise_rate, "noise_type": noise_type}
    use = STAGE_DEFAULTS.get(stage, STAGE_DEFAULTS["sft"]) | {k: v for k, v in given.items() if v is not None}
    same = sampling.inject_identity(samples, use["identity_ratio"], seed, seq, rebuild)
    noisy = sampling.noisy_samples(samples, use["noise_ratio"], use["noise_rate"], use["noise_type"], seed, seq, rebuild)
    every = samples.unionByName(same).unionByName(noisy)
    return sampling.balance(every, balance_strategy, seed=seed, seq=seq) if balance_strategy else every


def augment_dataset(spark: SparkSession, path: str, output: str, **settings) -> DataFrame:
    """Augment samples from JSON lines into JSON lines in shuffled order; returns counts by language."""
    samples = files.read_jsonl(spark, path, SAMPLE)
    files.write_jsonl(sampling.shuffled(augment(samples, **settings), settings.get("seed", 42)).drop("draw"), output)
    return analyze.language_histogram(files.read_jsonl(spark, output, SAMPLE))


def analyze_files(spark: SparkSession, before: str, after: str | None = None, output: str | None = None) -> str:
    """The profile of one file, or of two and their change, as text; also as JSON if an output is named."""
    as_rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  one row a language
    first = analyze.language_stats(files.read_jsonl(spark, before, SAMPLE))
    if after is None:
        rows = as_rows(first)
        text, report = analyze.format_stats(rows), {r.pop("lang"): r for r in rows}
    else:
        rows = as_rows(analyze.compare_stats(first, analyze.language_stats(files.read_jsonl(spark, after, SAMPLE))))
        text, report = analyze.format_comparison(rows), {r["lang"]: {k: r[k] for k in ("before", "after", "delta")} for r in rows}
    if output:
        files.write_report(report, output, spark)
    return text


def evaluate_files(spark: SparkSession, predictions: str, references: str | list[str], output: str | None = None) -> dict:
    """Metrics of prediction files against reference files, of which a later line has an id's reference; also as JSON if an output is named."""
    preds = files.read_jsonl(spark, predictions, PREDICTION)
    refs = files.read_jsonl_placed(spark, references, REFERENCE)
    metrics = evaluate.report([r.asDict() for r in evaluate.evaluate(preds, refs, "place").collect()])  # one row a language
    if output:
        files.write_report(metrics, output, spark)
    return metrics


def prepare(
    spark: SparkSession, path: str, sft_output: str | None = None, rl_output: str | None = None, max_samples: int | None = None, prefix: str = DATA_SOURCE_PREFIX, compression: str | None = None
) -> None:
    """Training tables from JSON lines, under the session's Parquet codec or the one named."""
    samples = files.read_jsonl_head(spark, path, SAMPLE, max_samples)
    if sft_output:
        sft_records(samples).write.mode("overwrite").parquet(sft_output, compression=compression)
    if rl_output:
        rl_records(samples, prefix=prefix).write.mode("overwrite").parquet(rl_output, compression=compression)


def infer(samples: DataFrame, generator: Callable[[], Callable[[list[str]], list[str]]], batch_size: int = 8) -> DataFrame:
    """(id, lang, source, prediction): prompts run through a generator made once for each task.

    `generator()` loads a model and returns a function from a batch of prompts to as many texts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = generator()
        for frame in frames:
            texts: list[str] = []
            for at in range(0, len(frame), batch_size):
                batch = frame["prompt"].iloc[at : at + batch_size].tolist()
                found = generate(batch)
                if len(found) != len(batch):
                    raise ValueError(f"{len(batch)} prompts gave {len(found)} texts")
                texts += found
            yield frame[["id", "lang", "source"]].assign(prediction=texts)

    return samples.select("id", "lang", "source", "prompt").mapInPandas(run, PREDICTION).withColumn("prediction", strip("prediction"))
