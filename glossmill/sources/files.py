"""Reading and writing corpora, JSON lines, Parquet exports, reports and settings."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.functions.scoring import DATA_SOURCE_PREFIX
from glossmill.functions.text import strip
from glossmill.schemas import LANGUAGES, SPLITS
from glossmill.sources.scratch import settle


def parse_yaml(text: str) -> dict:
    """A YAML mapping, by the yaml package; without it, flat `key: value` lines."""
    try:
        import yaml
    except ImportError:
        pairs = (line.partition(":")[::2] for line in text.splitlines() if ":" in line and not line.startswith(("#", " ", "\t")))
        plain = {"true": True, "false": False, "": None}
        return {k.strip(): plain.get(v.strip().lower(), v.strip().strip("'\"")) for k, v in pairs}
    return yaml.safe_load(text) or {}


def read_settings(path: str, spark: SparkSession | None = None) -> dict:
    """A YAML configuration file: the driver's own or, with a session, of any store that Spark reads."""
    if spark:
        return parse_yaml(spark.read.text(path, wholetext=True).first()["value"])
    with open(path, encoding="utf-8") as f:
        return parse_yaml(f.read())


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store that Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def discover_corpora(spark: SparkSession, data_dir: str) -> DataFrame:
    """(lang_code, lang_name, corpus_name, corpus_dir, sentence_aligned, n_refs) of every metadata.yaml below a folder.

    There is one small file a corpus, parsed on the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.yaml").load(data_dir)
    rows = []
    for r in files.select("path", "content").orderBy("path").collect():
        meta = parse_yaml(bytes(r["content"]).decode("utf-8"))
        folder = os.path.dirname(r["path"])
        code = meta.get("target_language") or ""
        n_refs = sum(k.startswith("reference_essays_") for k in meta)
        rows.append((code, LANGUAGES.get(code, code), os.path.basename(folder), folder, bool(meta.get("sentence_aligned", False)), n_refs))
    return spark.createDataFrame(rows, "lang_code string, lang_name string, corpus_name string, corpus_dir string, sentence_aligned boolean, n_refs int")


def classify_files(files: DataFrame) -> DataFrame:
    """(corpus_dir, split, kind, ref_key, path) of essay files from a `path` column.

    `kind` is orig or ref.  Readmes and change logs are left out, and where two files
    claim one place the last path by order has it.
    """
    name = F.element_at(F.split("path", "/"), -1)
    ref = F.regexp_extract("name", r"[-_](ref\d+)[-_]", 1)
    kind = F.when(F.col("name").rlike("-orig-|_orig_"), "orig").when(ref != "", "ref")
    # A name may state several splits; it then serves each.
    splits = F.array_compact(F.array(*(F.when(F.col("name").rlike(f"[-_]{s}"), s) for s in SPLITS)))
    typed = (
        files.withColumn("name", name)
        .where(~F.lower("name").isin("readme.md", "changelog.md"))
        .select(F.regexp_replace("path", "/[^/]*$", "").alias("corpus_dir"), F.explode(splits).alias("split"), kind.alias("kind"), F.when(kind == "ref", ref).alias("ref_key"), "path")
        .where("kind IS NOT NULL")
    )
    return typed.groupBy("corpus_dir", "split", "kind", "ref_key").agg(F.max("path").alias("path"))


def find_split_files(spark: SparkSession, corpus_dir: str) -> DataFrame:
    """Essay files in one corpus folder or, with a glob, in several.  Only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(corpus_dir).select("path")
    return classify_files(files)


_BLANK = r"[^\S\n]"
_HEADER = rf"###{_BLANK}+essay_id{_BLANK}*={_BLANK}*"
_HEADER_AHEAD = rf"(?mU)^(?={_HEADER}[^\n])"


def _essay_id(part: str) -> Column:
    """The id in the header that a part begins with, which may be blank, or null without one."""
    header = rf"(?U)^{_HEADER}([^\n]+)"
    return F.when(F.col(part).rlike(header), strip(F.regexp_extract(part, header, 1)))


def parse_essays(files: DataFrame, content: str = "value", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*keep, essay_id, text) of whole Markdown files.

    A header line `### essay_id = X` starts an essay; what stands before the first is
    dropped, bodies are stripped, and of a repeated id the last one holds.  A file is
    split at its headers, without a shuffle of lines.
    """
    parts = F.split(F.regexp_replace(content, "\r\n?", "\n"), _HEADER_AHEAD)
    found = files.select(*keep, F.posexplode(parts).alias("pos", "part")).withColumn("essay_id", _essay_id("part")).where("essay_id IS NOT NULL")
    found = found.select(*keep, "pos", "essay_id", strip(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("text"))
    return found.groupBy(*keep, "essay_id").agg(F.max_by("text", "pos").alias("text"))


_MARK = "###"


@contextmanager
def input_splits(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Input splits of at most `size` bytes for files read meanwhile; None leaves the session's."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size // 16)} if size else {}
    old = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def read_essays(spark: SparkSession, paths: list[str] | str, recursive: bool = False, split_bytes: int | None = None) -> DataFrame:
    """(path, essay_id, text) of Markdown files of any size, with `recursive` of those in and below folders.

    What `parse_essays` says of whole files, but a file is read in input splits, of
    `split_bytes` if given: the reader cuts it where a line begins with a header's marks, so
    an essay comes whole from the split it begins in and a large file is many tasks' work.
    Chunks that turn out not to be headers go to the last essay before them, which is found
    over chunks' places alone.  Only built-in functions touch the texts, which are moved
    once, to their path and id.
    """
    reader = spark.read.option("lineSep", "\n" + _MARK)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    block = F.col("_metadata.file_block_start").alias("block")
    # Numbers rise by one within a split, wherever they begin.
    chunks = reader.text(paths).select("value", F.col("_metadata.file_path").alias("path"), block, F.monotonically_increasing_id().alias("n"))
    # A line end of two characters has lost its second one to the cut.
    text = F.regexp_replace(F.regexp_replace(F.concat(F.lit(_MARK), "value"), r"\r\z", ""), "\r\n?", "\n")
    split = chunks.select("path", "block", "n", F.posexplode(F.split(text, _HEADER_AHEAD)).alias("pos", "part"))
    # A file's first chunk had no marks before it, so its id is that without them.
    split = split.withColumn("unmarked", F.when((F.col("block") == 0) & (F.col("pos") == 0), F.substring("part", len(_MARK) + 1, 1 << 30)))
    with input_splits(spark, split_bytes):
        parts = settle(split.select("path", F.struct("block", "n", "pos").alias("place"), _essay_id("part").alias("id"), _essay_id("unmarked").alias("first_id"), "part"), "essay_parts")
    # Places are few bytes each: within a split by a running maximum, then over the splits of a file.
    in_split = Window.partitionBy("path", "place.block").orderBy("place")
    first = (F.col("place.block") == 0) & (F.row_number().over(in_split) == 1)
    places = parts.select("path", "place", "id", "first_id").withColumn("first", first).withColumn("essay_id", F.when(F.col("first"), F.col("first_id")).otherwise(F.col("id")))
    head = F.when(F.col("essay_id").isNotNull(), F.struct("place", "essay_id"))
    places = settle(places.select("path", "place", "first", "essay_id", head.alias("head"), F.max(head).over(in_split).alias("own")), "essay_places")
    blocks = places.groupBy("path", F.col("place.block").alias("block")).agg(F.max("head").alias("head"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.max("head").over(earlier).alias("before"))
    loose = places.where("head IS NULL").select("path", "place", "own", F.col("place.block").alias("block")).join(blocks, ["path", "block"])
    loose = loose.select("path", "place", F.coalesce("own", "before").alias("owner")).where("owner IS NOT NULL")
    firsts = places.where("first").select("path", "place", "first")
    # One row a file, of some 200 bytes; beyond that many they are joined by shuffle.
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_SPLITS else firsts
    known = parts.join(firsts, ["path", "place"], "left").withColumn("essay_id", F.when(F.col("first"), F.col("first_id")).otherwise(F.col("id")))
    tail = F.struct(F.col("owner.place").alias("owner"), "place", "part")
    tails = known.where("essay_id IS NULL").select("path", "place", "part").join(loose, ["path", "place"]).select("path", "owner.essay_id", tail.alias("tail"))
    none = F.lit(None)
    rows = known.where("essay_id IS NOT NULL").select("path", "essay_id", "place", F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body"), none.cast(tails.schema["tail"].dataType).alias("tail"))
    rows = rows.unionByName(tails.select("path", "essay_id", none.cast(parts.schema["place"].dataType).alias("place"), none.cast("string").alias("body"), "tail"))
    # Of a repeated id the last essay holds, with what follows it.
    last = rows.groupBy("path", "essay_id").agg(F.max("place").alias("place"), F.max_by("body", "place").alias("body"), F.sort_array(F.collect_list("tail")).alias("tails"))
    own = F.transform(F.filter("tails", lambda t: t["owner"] == F.col("place")), lambda t: F.concat(F.lit("\n"), t["part"]))
    return last.select("path", "essay_id", strip(F.concat("body", F.array_join(own, ""))).alias("text"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines of a known schema; blank lines are skipped and a malformed one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


BROADCAST_SPLITS = 50_000


def read_jsonl_placed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """`read_jsonl` with `place`, by which a row stands before another: file, input split, and number in it.

    Numbers rise in the order of reading, so places compare alike however splits are dealt to tasks.
    """
    read = read_jsonl(spark, path, schema)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return read.select(*read.columns, place.alias("place"))


def read_jsonl_head(spark: SparkSession, path: str, schema: str, max_samples: int | None = None) -> DataFrame:
    """The samples among the first `max_samples` lines of one file, blank lines counted; 0 or None means all.

    Lines are counted by input split first; a line is kept if the lines of all splits
    before its own and those before it there are fewer.  Nothing is sorted.  Of a folder's
    files the order is that of their names.
    """
    if not max_samples:
        return read_jsonl(spark, path, schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # One row a split.  Numbers rise by one within a split, wherever they begin.
    splits = lines.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"), "first")
    wanted = settle(splits.where(F.col("shift") + F.col("first") < max_samples).drop("first"), "splits")
    # Some 100 bytes a split; beyond that many they are joined by shuffle.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_SPLITS else wanted
    kept = lines.join(wanted, ["path", "block"]).where((F.col("n") + F.col("shift") < max_samples) & (strip("value") != ""))
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("s")).select("s.*")


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines in UTF-8, non-ASCII as it is; a codec's name compresses the files, which readers know by their endings."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression=compression)


def write_parquet_by_split(df: DataFrame, folder: str, prefix: str = DATA_SOURCE_PREFIX) -> dict[str, str]:
    """One Parquet table per split that has rows; returns their paths.

    All are written in one pass, partitioned by split, and then put in place by renaming.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    unfinished = hadoop(f"{folder}/.by_split-{uuid.uuid4().hex[:12]}")
    df.write.partitionBy("split").parquet(unfinished.toString())
    system = unfinished.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for entry in system.listStatus(unfinished):
        name, _, split = entry.getPath().getName().partition("=")
        if name == "split":
            out[split] = f"{folder}/{prefix}{split}.parquet"
            system.delete(hadoop(out[split]), True)
            system.rename(entry.getPath(), hadoop(out[split]))
    system.delete(unfinished, True)
    return dict(sorted(out.items()))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder of any store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def write_report(report: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small result as indented JSON, non-ASCII kept: on the driver or, with a session, in any store that Spark writes."""
    text = json.dumps(report, indent=2, ensure_ascii=False)
    if spark:
        write_small(spark, path, text)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def read_progress(path: str, last: float = 0.0, spark: SparkSession | None = None) -> float:
    """Share of training done, between 0 and 1; what cannot be read keeps the last value.

    The file is the driver's own or, with a session, in any store that Spark reads.
    """
    try:
        if spark:
            state = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        else:
            with open(path, encoding="utf-8") as f:
                state = json.load(f)
        return min(1.0, max(0.0, state["step"] / max(state["total_steps"], 1)))
    except (OSError, ValueError, KeyError, TypeError, PySparkException, Py4JError):
        return last


def write_progress(path: str, step: int, total_steps: int, spark: SparkSession | None = None) -> None:
    """Replace the progress file in one step, on the driver or, with a session, in any store that Spark writes."""
    text = json.dumps({"step": step, "total_steps": total_steps})
    if spark:
        hadoop = spark._jvm.org.apache.hadoop.fs
        unfinished = f"{path}.{uuid.uuid4().hex[:12]}"
        write_small(spark, unfinished, text)
        files = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration())
        replace = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(hadoop.Path(unfinished), hadoop.Path(path), replace)
        return
    folder = os.path.dirname(os.path.abspath(path))
    handle, unfinished = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(unfinished, path)


class ProgressReader:
    """Progress re-read on every n-th call."""

    def __init__(self, path: str, every: int = 100):
        self.path, self.every = path, every
        self.value, self._calls = 0.0, 0

    def __call__(self) -> float:
        if self._calls % self.every == 0:
            self.value = read_progress(self.path, self.value)
        self._calls += 1
        return self.value
