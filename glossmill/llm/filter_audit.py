"""Filter interaction audit: what each filter of an ordered chain removes, in every order.

A document's failures are a mask with a bit a filter.  Documents are first counted by
part, mask and labels, so what follows grows with the number of parts alone.  Those mask
cells are then unpivoted against the steps of all orders into a long table; a running
bit-or over a cell's steps says whether an earlier filter has removed it already,
conditional sums give a step's counts, and totals over a filter's window give its share
over all orders.

DataFrame expressions only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import settle

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at it alone: few words, few distinct words, much upper case, symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct.cast("long") < MIN_DISTINCT_PERCENT * n.cast("long"),
        "C": 100 * upper.cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters and labels.

    Equal rows are counted first, so copies of a text or of an id never meet in one task.
    The smallest doc_id of a text is found from those counts by the text's SHA-256 and
    joined on digest and id, of which there is one row a text and part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = sum((F.when(failed, F.lit(_bit(k))).otherwise(F.lit(0)) for k, failed in text_failures(text).items()), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), alone.cast("int").alias("alone"))
    rows = settle(rows.groupBy("digest", "doc_id", "part", "alone").agg(F.count("*").alias("n")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    rows = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("alone") + F.when(later, F.lit(_bit("E"))).otherwise(F.lit(0)))
    rows = rows.select("doc_id", "part", "mask", "n")
    # Settled, so that a join on an id with very many rows is split by its sizes.
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    marked = settle(one.where("doc_id IS NOT NULL AND (good OR toxic)"), "marked")
    known = rows.where("doc_id IS NOT NULL").join(marked, "doc_id", "left").drop("doc_id")
    none = F.lit(False)
    nameless = rows.where("doc_id IS NULL").select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    every = known.unionByName(nameless)
    return every.groupBy("part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic")).agg(F.sum("n").alias("n"))


def order_steps() -> Column:
    """Every (filter_order, step, filter, bit) as an array of structs."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    places = F.array(*(F.lit(i) for i in range(1, len(FILTERS) + 1)))
    bits = F.create_map(*(F.lit(x) for k in FILTERS for x in (k, _bit(k))))

    def at(order: Column, step: Column) -> Column:
        letter = F.substring(order, step, F.lit(1))
        return F.struct(order.alias("filter_order"), step.alias("step"), letter.alias("filter"), F.element_at(bits, letter).alias("bit"))

    return F.flatten(F.transform(orders, lambda o: F.transform(places, lambda s: at(o, s))))


def audit(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, counts, shapley) from `mask_cells`: 600 rows a part."""
    cells = cells.withColumn("s", F.explode(order_steps())).select("part", "mask", "good", "toxic", "n", "s.*")
    run = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step")
    own = F.col("mask").bitwiseAND(F.col("bit"))
    seen = F.coalesce(F.bit_or(own).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = cells.withColumns({"own": own, "earlier": seen})
    failed, gone = F.col("own") != 0, F.col("earlier") != 0

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")

    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~failed & ~gone).alias("kept"),
        total(failed & ~gone).alias("removed"),
        total(failed & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(failed & ~gone & F.col("good")).alias("good_lost"),
        total(failed & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, filter_order and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a language; a null one is the empty string's.  A null text is an empty one,
    which fails A alone unless a smaller doc_id has one too.  A null doc_id is neither
    smaller nor larger than another, so such a row never fails E and has no labels; rows
    that repeat an id and text fail E only if a smaller id has the text.  Of repeated
    labels of an id each that is 1 counts; null labels don't.  Very long texts count
    whole, other columns are ignored, whatever their names, and an empty table has no
    parts and so no rows.
    """
    return audit(mask_cells(docs, labels))
