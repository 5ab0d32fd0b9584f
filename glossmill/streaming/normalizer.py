"""Streams of generations: scored under the progress of the moment, and normalised by language as they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from glossmill.functions.scoring import with_score
from glossmill.operators.evaluate import WARMUP
from glossmill.sources.files import read_progress

SCORES = "lang string, seq long, score double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that state by key needs, while a query starts."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


class RunningNormalizer(StatefulProcessor):
    """State of a language: rows so far, their mean, and their squared deviations from it."""

    def __init__(self, warmup: int):
        self._warmup = warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._sums = handle.getValueState("sums", "n long, mean double, m2 double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self._sums.get() if self._sums.exists() else (0, 0.0, 0.0)
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        x = batch["score"].to_numpy(float)
        # Sums around the first score of these rows, joined with what was before them.
        centre = x[0]
        d = x - centre
        own = np.arange(1, len(x) + 1)
        sums = np.cumsum(d)
        own_m2 = np.maximum(np.cumsum(d * d) - sums * sums / own, 0.0)
        apart = centre + sums / own - mean
        count = n + own
        means = mean + apart * own / count
        deviations = m2 + own_m2 + apart * apart * (n * own / count)
        spread = np.maximum(np.sqrt(deviations / count), 1e-6)
        self._sums.update((int(count[-1]), float(means[-1]), float(deviations[-1])))
        yield batch[["lang", "seq", "score"]].assign(normalized=np.where(count < self._warmup, x, (x - means) / spread))

    def close(self) -> None:
        pass


def normalize_stream(scores: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """(lang, seq, score, normalized) of a stream of (lang, seq, score).

    Each language's sums are state by key; rows of one micro-batch are taken in the order
    of seq.  Start the query within `keyed_state`.
    """
    return scores.groupBy("lang").transformWithStateInPandas(RunningNormalizer(warmup), f"{SCORES}, normalized double", "append", "None")


def score_stream(outputs: DataFrame, progress: str, scores: str, checkpoint: str) -> StreamingQuery:
    """Score what there is of a stream of (lang, seq, output, target, source), and stop.

    Progress is read anew for every micro-batch; a file that can't be read keeps the last
    value.  Scores of generations that the gate and an exact match leave open go to a folder
    a batch below `scores`, so a batch that is run again replaces what it wrote.
    """
    last = [0.0]

    def one(batch: DataFrame, number: int) -> None:
        last[0] = read_progress(progress, last[0], batch.sparkSession)
        scored = with_score(batch, "output", "target", "source", last[0], parts=True).where("gate_passed AND NOT exact")
        scored.select("lang", F.col("seq").cast("long").alias("seq"), "score").write.mode("overwrite").parquet(f"{scores}/batch={number}")

    return outputs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def normalize_files(spark: SparkSession, scores: str, out: str, checkpoint: str, warmup: int = WARMUP) -> StreamingQuery:
    """Normalise what there is of the batches that `score_stream` wrote, and stop; a later call goes on from the checkpoint."""
    stream = spark.readStream.schema(f"{SCORES}, batch long").parquet(scores).drop("batch")
    with keyed_state(spark):
        return normalize_stream(stream, warmup).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
