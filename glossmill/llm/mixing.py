"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words by weight; a document's expected copies are its
source's target over the source's size.  The whole part is certain.  The fractions are
rounded together: two documents exchange probability mass, scaled by their sizes so
that the expected words stay the same, in a random direction until one of them is 0 or
1.  Blocks of about `FAN_IN` documents run this side by side; each hands its undecided
rest to the next level of a reduction tree, until one block per source is left.

Every block also hands up its smallest documents undecided.  At the root, where one
block holds what is open of a source, a document is paired with all smaller ones taken
together, from large to small: the pooled partners share its mass evenly, so it is
decided in one step and the taken words end within about one small document of the
target.

DataFrame expressions only.  Randomness is a hash of ids and a seed, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import count_words, each_copy, fresh_names, id_key, settle

MAX_REPEAT = 3
FAN_IN = 128
RESERVE = 4
#: Sources up to this number are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 20_000
WEIGHTS = (1.0, 2.0, 3.0)

_ITEM = "struct<id:long,size:long,base:long,p:double,salt:long,copy:long>"
_FIELDS = ("id", "size", "base", "p", "salt", "copy")


def _turns(per: DataFrame, turns: int) -> DataFrame:
    """Add `turn`, 0 .. turns - 1 in rotation over the sources by code point, null last.

    Sorted sources are numbered within their partitions and partitions by their sizes,
    so no task holds all sources.
    """
    placed = settle(per.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("turn", (F.col("first") + within) % turns).drop("part", "place", "first")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, rows, target) from (source, size).

    Weights repeat over the sources in code-point order, null last.  Targets share all
    words by weight but stop at `max_repeat` times the source; what is cut is shared
    again by weight until none is above.  A target is min(cap, level * weight) with one
    common level, which rises from round to round until no further source is capped.
    """
    per = _turns(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), len(weights))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") + 1).cast("int")))
    per = settle(per.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size")), "weighted_sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level != before:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        cut, free = per.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        level, before = ((total - cut) / free if free else level), level
    return per.select("source", "source_size", "rows", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _item(i: Column, p: Column | None = None) -> Column:
    """A document with another probability."""
    return F.struct(*((p if name == "p" and p is not None else i[name]).alias(name) for name in _FIELDS))


def _exchange(state: Column, x: Column, seed: int) -> Column:
    """One pivotal step of the open document `state.cur` with `x`: one is decided, one stays open."""
    a = state["cur"]
    have_a, have_x = a["size"] * a["p"], x["size"] * x["p"]
    room_a, room_x = a["size"] * (1 - a["p"]), x["size"] * (1 - x["p"])
    down, up = F.least(have_a, room_x), F.least(room_a, have_x)
    falls = _uniform(a["id"], a["salt"], a["copy"], x["id"], x["salt"], x["copy"], F.lit(seed)) * (down + up) <= up

    def step(done: Column, value: float, open_: Column, p: Column) -> Column:
        kept = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
        return F.struct(_item(open_, kept).alias("cur"), F.concat(state["done"], F.array(_item(done, F.lit(value)))).alias("done"))

    size_a, size_x = a["size"].cast("double"), x["size"].cast("double")
    return (
        F.when(falls & (have_a <= room_x), step(a, 0.0, x, x["p"] + have_a / size_x))
        .when(falls, step(x, 1.0, a, a["p"] - room_x / size_a))
        .when(room_a <= have_x, step(a, 1.0, x, x["p"] - room_a / size_x))
        .otherwise(step(x, 0.0, a, a["p"] + have_x / size_a))
    )


def _round_root(items: Column, seed: int) -> Column:
    """Decide all of a source's open documents, the largest first, each paired with the pool of those after it.

    The pool's probabilities move together: mass it takes scales its room, mass it gives
    scales what it has.  Both are one linear map p -> a * p + b for all of the pool, so
    the fold carries (a, b), the pool's words expected (`has`) and its words (`size`).
    """
    has = F.aggregate(items, F.lit(0.0), lambda t, i: t + i["size"] * i["p"])
    size = F.aggregate(items, F.lit(0.0), lambda t, i: t + i["size"])
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), has.alias("has"), size.alias("size"), F.array().cast(f"array<{_ITEM}>").alias("done"))

    def step(t: Column, i: Column) -> Column:
        p = F.least(F.greatest(t["a"] * i["p"] + t["b"], F.lit(0.0)), F.lit(1.0))
        pool_size = t["size"] - i["size"]
        pool_has = F.least(F.greatest(t["has"] - i["size"] * p, F.lit(0.0)), pool_size)
        down = F.least(i["size"] * p, pool_size - pool_has)
        up = F.least(i["size"] * (1 - p), pool_has)
        u = _uniform(i["id"], i["salt"], i["copy"], F.lit(seed))
        falls = F.when(down + up > 0, u * (down + up) < up).otherwise(u >= p)
        # The share of its room that the pool fills, or of its mass that it gives.
        filled = F.when(down > 0, down / (pool_size - pool_has)).otherwise(F.lit(0.0))
        given = F.when(up > 0, up / pool_has).otherwise(F.lit(0.0))
        keep = 1 - F.when(falls, filled).otherwise(given)
        return F.struct(
            (t["a"] * keep).alias("a"),
            (t["b"] * keep + F.when(falls, filled).otherwise(F.lit(0.0))).alias("b"),
            (pool_has + F.when(falls, down).otherwise(-up)).alias("has"),
            pool_size.alias("size"),
            F.concat(t["done"], F.array(_item(i, F.when(falls, 0.0).otherwise(1.0)))).alias("done"),
        )

    return F.aggregate(items, start, step)["done"]


def _round_blocks(items: DataFrame, seed: int) -> DataFrame:
    """Fold each (source, block): decided documents, and what goes up a level."""
    last = F.col("blocks") == 1
    grouped = items.groupBy("source", "blocks", "block").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "salt", "id", "copy", "size", "base", "p"))).alias("all")
    )
    grouped = grouped.withColumn("all", F.transform("all", lambda i: _item(i)))
    folded = F.greatest(F.lit(1), F.size("all") - F.when(last, 0).otherwise(RESERVE))
    start = F.struct(F.element_at("all", 1).alias("cur"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    grouped = grouped.withColumns({"rest": F.slice("all", folded + 1, F.size("all")), "now": F.slice("all", 2, folded - 1)})
    now = F.when(last, F.array().cast(f"array<{_ITEM}>")).otherwise(F.col("now"))
    grouped = grouped.withColumn("state", F.aggregate(now, start, lambda s, x: _exchange(s, x, seed)))
    cur = F.col("state.cur")
    decided = F.when(last, _round_root(F.col("all"), seed + 1)).otherwise(F.col("state.done"))
    open_ = F.when(last, F.array().cast(f"array<{_ITEM}>")).otherwise(F.concat(F.array(cur), "rest"))
    return grouped.select("source", "blocks", decided.alias("decided"), open_.alias("open"))


def _blocked(items: DataFrame, rows: Column, seed: int) -> DataFrame:
    blocks = F.ceil(rows / F.lit(float(FAN_IN))).cast("long")
    return items.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "salt", "copy", F.lit(seed)), F.col("blocks")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 42) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, source, copies, text_hash, copy.

    `copies` is how often the mix repeats the whole document; `taken` is copies * size.
    A text without words (or null) has size 0 and follows the same expected copies on
    its own.  Very long texts are counted whole.  Null sources are a source, sorted last.
    Rows that share a doc_id or have none are told apart by their text's hash, and rows
    alike in source, id and text by a number from 0, `copy`, so reruns agree under any
    partitioning and no block or task gathers equal rows.  Extra columns are ignored, whatever their names.  An empty table, or one without any word,
    gives target 0 and takes nothing.
    """
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count_words().alias("size"), _text_hash().alias("salt"))
    sized = settle(each_copy(each.groupBy(*each.columns).agg(F.count("*").alias("n")), "n", "copy"), "words")
    targets = settle(source_targets(sized, weights, max_repeat), "targets")
    facts = targets.agg(F.count("*").alias("n"), F.max("rows").alias("most")).first()
    small = F.broadcast if facts["n"] <= BROADCAST_SOURCES else (lambda x: x)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = small(targets.withColumnsRenamed({"source": "name"}))
    rated = sized.join(known, F.col("source").eqNullSafe(F.col("name"))).withColumn("rate", F.least(rate, F.lit(float(max_repeat))))
    rated = rated.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.col("base"))

    level_items = rated.where("size > 0").select("source", F.col("doc_id").alias("id"), "size", "base", "p", "salt", "copy", "rows")
    level_items = _blocked(level_items, F.col("rows"), seed).drop("rows")
    parts: list[DataFrame] = []
    most = facts["most"] or 0
    level = 0
    while most:
        done = settle(_round_blocks(level_items, seed + 2 * level), f"rounded{level}")
        parts.append(done.select("source", F.explode("decided").alias("d")).select("source", "d.*"))
        blocks = math.ceil(most / FAN_IN)
        most = 0 if blocks == 1 else blocks * (RESERVE + 1)
        level += 1
        up = done.select("source", F.explode("open").alias("d"), (F.col("blocks") * (RESERVE + 1)).alias("n"))
        level_items = _blocked(up.select("source", "d.*", "n"), F.col("n"), seed + level).drop("n")

    wordless = rated.where("size = 0").select(
        "source", F.col("doc_id").alias("id"), "size", "base", F.when(_uniform(F.col("doc_id"), F.col("salt"), F.col("copy"), F.lit(seed)) < F.col("p"), 1.0).otherwise(0.0).alias("p"), "salt", "copy"
    )
    every = wordless
    for part in parts:
        every = every.unionByName(part)
    copies = (F.col("base") + F.col("p")).cast("long")
    return every.join(known, F.col("source").eqNullSafe(F.col("name"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"), F.col("salt").alias("text_hash"), "copy"
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row of `docs` as often as `mix_sources` says, with its columns.

    Rows are matched by doc_id, text hash and source, and where all three repeat by their
    number among such rows, which are interchangeable.  Rows are numbered over their keys
    alone, within their input partitions and then over these, so equal rows never meet in
    one task and a text moves once; `docs` must be read alike twice, as tables in files
    are.  Null ids and texts, ties, empty tables and odd column names are as in
    `mix_sources`.
    """
    plan = mix_sources(docs, **settings)
    row, copies, copy = fresh_names(docs, "row", "copies", "copy")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    keys = rows.select(row, id_key().alias("k"), _text_hash().alias("t"), F.col("source").alias("s"), F.shiftright(row, 33).alias("part"))
    within = F.row_number().over(Window.partitionBy("k", "t", "s", "part").orderBy(row)) - 1
    before = Window.partitionBy("k", "t", "s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = keys.groupBy("k", "t", "s", "part").agg(F.count("*").alias("own"))
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in ("k", "t", "s", "part")), F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("k", "t", "s", "part")]
    numbered = keys.withColumn("at", within).join(starts, same).select(row, "k", "t", "s", (F.col("first") + F.col("at")).alias("c"))
    taken = plan.where("copies > 0").select(id_key().alias("_k"), F.col("text_hash").alias("_t"), F.col("source").alias("_s"), F.col("copy").alias("_c"), F.col("copies").alias(copies))
    chosen = numbered.join(taken, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("k", "t", "s", "c")]).select(row, copies)
    return rows.join(chosen, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
