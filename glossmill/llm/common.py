"""Pieces shared by the corpus operators: table access, scratch tables, batches."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.sources.scratch import drop_scratch, scratch_path, settle, shared_dir

__all__ = ["drop_scratch", "scratch_path", "settle", "shared_dir"]

#: A key with more than one in so many of all rows is hot; fewer than this many keys can be.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(doc_id: Column | str = "doc_id") -> Column:
    """A key that is equal for equal ids, and for null ids like no number's."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(id_.cast("long").cast("string"), F.lit(""))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """`rows` joined with `facts`, which has one row a key and how many of `total` rows have it.

    A hot key's rows stay where they are: its fact is broadcast, and fewer than `HOT`
    keys can have more than one in `HOT` of the rows.  All others are joined by shuffle.
    """
    hot = F.col(count) * HOT > F.lit(total)
    few = F.broadcast(facts.where(hot))
    rest = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(facts.where(~hot), key))


#: Equal rows that are written out by one task.
COPIES = 100_000


def each_copy(counted: DataFrame, count: str, copy: str) -> DataFrame:
    """A row for each of `count` equal rows, numbered from 0 in `copy`.

    Where there are very many, their numbers are dealt out first, so no task has them all.
    """
    last = F.col(count) - 1
    few = counted.where(F.col(count) <= COPIES).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    many = counted.where(F.col(count) > COPIES)
    first, end = fresh_names(counted, "first_copy", "last_copy")
    many = many.withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES).cast("long"))))
    many = many.withColumn(end, F.least(F.col(first) + (COPIES - 1), last)).repartition(first, *counted.columns)
    many = many.withColumn(copy, F.explode(F.sequence(F.col(first), F.col(end)))).drop(first, end)
    return few.unionByName(many).drop(count)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that `df` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def count_words(text: str = "text") -> Column:
    """Number of words of a text column, a null as none.

    Each word becomes one character with the white space around it, so no array of
    words is built.
    """
    space, other = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    count = F.length(F.regexp_replace(text, f"{space}*{other}+{space}*", "x"))
    return F.when(F.col(text).rlike(other), count).otherwise(F.lit(0)).cast("long")


def fold_of(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; 2 is the held-out part.  A null id gives null."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(id_.cast("string").cast("binary")) % 4


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for rows no model may learn labels from; a null id is not held out."""
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column, a null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_strings(column) -> list[str]:
    """Texts of an Arrow string column, a null as empty."""
    return [x or "" for x in column.to_pylist()]


_WHITE = re.compile(rb"[\x09-\x0d\x20]")
PIECE_BYTES = 1 << 20


def word_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text, in lists of about `size` bytes of text, cut at white space only."""
    start = 0
    while len(data) - start > size:
        cut = _WHITE.search(data, start + size)
        if not cut:
            break
        yield data[start : cut.start()].split()
        start = cut.start()
    yield (data[start:] if start else data).split()


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def single_thread() -> None:
    """Keep native libraries in a Python worker to the one core its task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
