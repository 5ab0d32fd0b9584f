"""Thousands of rows alike: laws, bounds and even tasks hold."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossmill.llm import language_id, mixing, quality_rules, sharding
from glossmill.llm.common import each_copy

MANY = 20_000


@pytest.fixture(scope="module")
def alike(spark):
    """20,000 rows of one id (or none) and text, among 2,000 others."""

    def make(doc_id):
        id_ = F.lit(doc_id).cast("long")
        same = spark.range(MANY).select(id_.alias("doc_id"), F.lit("the same text of some words").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
        rest = spark.range(2000).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" has its words")).alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
        return same.unionByName(rest).repartition(4)

    return make


@pytest.mark.parametrize("doc_id", [7, None])
def test_shards_of_rows_alike(alike, doc_id):
    got = sharding.shard_documents(alike(doc_id)).select("shard", "slot", "size", "virtual_slot").collect()
    assert len(got) == MANY + 2000
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(size.values()) < 1.01 * mean and min(size.values()) > 0.99 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(Counter(r["virtual_slot"] for r in got).values()) < 100


def test_light_rows_alike_are_numbered_in_parts(spark, monkeypatch):
    """Empty rows weigh little and share a slot, but not one window."""
    monkeypatch.setattr(sharding, "PART_ROWS", 500)
    empty = spark.range(MANY).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    big = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 40_000).alias("text"))
    got = sharding.shard_documents(empty.unionByName(big)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == MANY + 64


@pytest.mark.parametrize("doc_id", [7, None])
def test_mixing_of_rows_alike(alike, doc_id, monkeypatch):
    """No block is larger than a few times FAN_IN, copies agree over reruns, and the target is met."""
    blocks = []
    rounded = mixing._round_blocks

    def seen(items, seed):
        blocks.append(max(r["count"] for r in items.groupBy("source", "blocks", "block").count().collect()))
        return rounded(items, seed)

    monkeypatch.setattr(mixing, "_round_blocks", seen)
    docs = alike(doc_id).withColumn("source", F.when(F.col("text").startswith("text"), "b").otherwise("a"))
    got = mixing.mix_sources(docs).collect()
    assert len(got) == MANY + 2000 and max(blocks) < 4 * mixing.FAN_IN
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] or -1, r["source"], r["copy"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_documents_of_rows_alike(alike, spark, tmp_path):
    path = str(tmp_path / "docs")
    alike(None).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    docs = spark.read.parquet(path)
    plan = mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan
    copies = Counter(r["n"] for r in mixed.groupBy("place").agg(F.count("*").alias("n")).collect())
    wanted = Counter(r["copies"] for r in mixing.mix_sources(docs).where("copies > 0").collect())
    assert copies == wanted  # each row as often as one of its like


def test_language_sample_is_bounded(spark, monkeypatch):
    """Rows of one id count once if they are alike, and a language gives at most `sample_docs` parts."""
    collected = []
    made = language_id.dictionaries
    monkeypatch.setattr(language_id, "dictionaries", lambda held, size=None: collected.append({k: len(v) for k, v in held.items()}) or made(held, size))
    rows = [(7, "alike in all", "en")] * 3000 + [(9, f"text {i} of one id", "en") for i in range(1000)] + [(i, f"texte {i} autre", "fr") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample_docs=40)
    assert len(collected) == 1 and all(0 < n <= 40 for n in collected[0].values()) and model.languages == ["en", "fr"]


def test_quality_sample_is_bounded(spark, monkeypatch):
    learned = []
    made = quality_rules.learn
    monkeypatch.setattr(quality_rules, "learn", lambda rows, good, seed=42: learned.append(len(rows)) or made(rows, good, seed))
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text)] * 3000 + [(2, f"{text} {'x' * (1 + i % 50)} {i}") for i in range(2000)] + [(3, text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)] * 500 + [(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    quality_rules.fit(docs, labels, sample_rows=100)
    assert learned == [100]
    quality_rules.fit(docs.where("doc_id <> 2"), labels, sample_rows=100)
    assert learned[1] == 2  # rows alike count once


def test_copies_are_written_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr("glossmill.llm.common.COPIES", 10)
    counted = spark.createDataFrame([("a", 1), ("b", 10), ("c", 37), (None, 11)], "k string, n long")
    got = defaultdict(list)
    for r in each_copy(counted, "n", "copy").collect():
        got[r["k"]].append(r["copy"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": [0], "b": list(range(10)), "c": list(range(37)), None: list(range(11))}


def test_all_languages_may_compress(spark):
    """With `shortlist=None` every dictionary is tried."""
    model = language_id.CompressionModel({f"l{i:02d}": f"sprache nummer {i} ".encode() * 9 for i in range(12)})
    assert len(model.listed(b"sprache nummer 3")) == language_id.SHORTLIST
    model.shortlist = None
    assert model.listed(b"sprache nummer 3") == list(range(12))
    import pickle

    assert pickle.loads(pickle.dumps(model)).shortlist is None


def test_a_fitted_model_tries_every_dictionary(spark, make_docs):
    """With more languages than a shortlist has, none is left out before its size is known."""
    rows = [(i, f"wort{i % 12} satz{i % 12} text{i % 12} " * 5, f"l{i % 12:02d}", None) for i in range(120)]
    model = language_id.fit(make_docs(rows))
    assert len(model.languages) == 12 > language_id.SHORTLIST
    assert sorted(model.sizes(b"wort3 satz3 text3")) == list(range(12))
    assert len(language_id.fit(make_docs(rows), shortlist=5).sizes(b"wort3 satz3 text3")) == 5
