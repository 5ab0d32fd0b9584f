import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmill.functions import noise
from glossmill.functions.scoring import DATA_SOURCE_PREFIX
from glossmill.functions.tokens import fits, masked_labels, truncate
from glossmill.operators import analyze, evaluate, sampling
from glossmill.operators.samples import (
    align_documents, align_essays, align_lines, build_samples, filter_pairs, instruction, language_name, rewrite_prompt, rl_records, sample_id, sft_records, with_source,
)
from glossmill.plans import pipelines

PAIR = "lang string, corpus string, split string, ref string, source string, target string"


def make(spark, n=100, langs=("en",)):
    rows = [(langs[i % len(langs)], "c", "train", "ref1", f"source {i}", f"the target, number {i}.") for i in range(n)]
    return build_samples(spark.createDataFrame(rows, PAIR)).withColumn("seq", F.col("id"))


def test_names_ids_and_instruction(spark):
    df = spark.createDataFrame([("en", "c", "s" * 300, "ref1"), ("xx", "c", "s" * 200, "ref1")], "lang string, corpus string, source string, ref string")
    rows = df.select(language_name("lang"), sample_id("lang", "corpus", "source", "ref"), instruction("source", "lang")).collect()
    assert rows[0][0] == "English" and rows[1][0] == "xx"
    import hashlib

    assert rows[0][1] == hashlib.md5(f"en:c:{'s' * 200}:ref1".encode()).hexdigest()[:12]
    assert rows[0][2].startswith("Please identify whether the English sentence") and rows[0][2].endswith("correct is: " + "s" * 300)


def test_alignment(spark):
    orig = spark.createDataFrame([("c", "train", "1", "a\n\n b \nc"), ("c", "train", "2", "x"), ("c", "train", "3", " ")], "corpus string, split string, essay_id string, orig_text string")
    refs = spark.createDataFrame(
        [("c", "train", "1", "ref1", "A\nB"), ("c", "train", "1", "ref2", "A\nB\nC\nD"), ("c", "train", "3", "ref1", "Y"), ("c", "dev", "2", "ref1", "X")], "corpus string, split string, essay_id string, ref string, ref_text string"
    )
    essays = align_essays(orig, refs)
    assert essays.count() == 2
    lines = {(r["ref"], r["line_no"]): (r["source"], r["target"]) for r in align_lines(essays, ("essay_id", "ref")).collect()}
    assert lines == {("ref1", 1): ("a", "A"), ("ref1", 2): ("b", "B"), ("ref2", 1): ("a", "A"), ("ref2", 2): ("b", "B"), ("ref2", 3): ("c", "C")}
    assert {r["source"] for r in align_documents(essays, ("ref",)).collect()} == {"a\n\n b \nc"}


def test_length_filter_bounds(spark):
    df = spark.createDataFrame([("a" * 4096, "b"), ("a" * 4097, "b"), ("a", "b" * 4097), ("", "b"), ("a", "")], "source string, target string")
    assert [len(r["source"]) for r in filter_pairs(df).collect()] == [4096]


def test_prompt_rewrite(spark):
    df = spark.createDataFrame([("Fix.\n\nold\n\nolder", "new", "older"), ("Fix: old", "new", "old")], "p string, t string, s string")
    assert [r[0] for r in df.select(rewrite_prompt("p", "t")).collect()] == ["Fix.\n\nold\n\nnew", "Fix: old\n\nnew"]
    assert [r[0] for r in df.select(rewrite_prompt("p", "t", "s")).collect()] == ["Fix.\n\nold\n\nnew", "Fix: new"]


def test_records(spark):
    s = make(spark, 2)
    assert sft_records(s).columns == ["messages", "lang", "id"]
    r = rl_records(s).first()
    assert r["data_source"] == DATA_SOURCE_PREFIX + "en" and r["reward_model"]["style"] == "rule" and "split" not in r["extra_info"].asDict()
    r = rl_records(s, with_split=True).first()
    assert r["data_source"] == DATA_SOURCE_PREFIX + "en_c" and r["extra_info"]["split"] == "train"


def test_records_round_trip(spark, tmp_path):
    rl_records(make(spark, 5)).write.parquet(str(tmp_path / "rl"))
    back = spark.read.parquet(str(tmp_path / "rl"))
    assert back.count() == 5 and back.first()["prompt"][0]["role"] == "user"


@pytest.mark.parametrize("n, ratio, wanted", [(100, 0.29, 28), (100, 0.0, 0), (100, 1.0, 100), (100, 2.0, 100), (3, 0.1, 0), (0, 0.5, 0)])
def test_pick_counts(spark, n, ratio, wanted):
    assert sampling.pick(make(spark, n), ratio, 42, "t").count() == wanted


def test_pick_is_first_by_hash_under_any_partitioning(spark):
    import hashlib

    s = make(spark, 500)
    ids = [r["id"] for r in s.select("id").collect()]
    wanted = set(sorted(ids, key=lambda x: (hashlib.md5(f"{x}|7|tag".encode()).hexdigest(), x))[:65])
    for parts in (1, 4, 32):
        assert {r["id"] for r in sampling.pick(s.repartition(parts), 0.13, 7, "tag").collect()} == wanted


def test_identity(spark):
    out = sampling.inject_identity(make(spark, 100), 0.07).collect()
    assert len(out) == 7
    for r in out:
        assert r["source"] == r["target"] and r["id"].endswith("_id")
        assert r["messages"][0]["content"] == r["prompt"] and r["prompt"].endswith("\n\n" + r["target"]) and r["messages"][1]["content"] == r["target"]


def test_rebuilt_prompt_replaces_source(spark):
    s = make(spark, 3)
    out = with_source(s, F.col("target"), "_id", rebuild=True).collect()
    assert all(r["prompt"].endswith("correct is: " + r["target"]) for r in out)


def test_noisy_samples(spark):
    s = make(spark, 100)
    first = {r["id"]: r["source"] for r in sampling.noisy_samples(s, 0.2).collect()}
    again = {r["id"]: r["source"] for r in sampling.noisy_samples(s.repartition(7), 0.2).collect()}
    assert len(first) == 20 and first == again and all(k.endswith("_aug") for k in first)
    assert sampling.noisy_samples(s, 0.0).count() == 0
    with pytest.raises(ValueError):
        sampling.noisy_samples(s, 0.2, noise_type="odd")


def drawn(key, step, first, digits):
    return int(hashlib.md5(f"{key}|{step}".encode()).hexdigest()[first - 1 : first - 1 + digits], 16)


def slow_spelling(text, key, rate):
    for step in range(1, max(1, int(len(text) * rate)) + 1):
        if len(text) < 3:
            continue
        kind, at_random = drawn(key, step, 1, 7) % 4, drawn(key, step, 8, 13)
        if kind == 0:
            at = at_random % (len(text) - 1)
            if text[at].isalpha() and text[at + 1].isalpha():
                text = text[:at] + text[at + 1] + text[at] + text[at + 2 :]
            continue
        places = [i for i, c in enumerate(text) if (None, c == " ", c.isalpha(), c in ".,;:!?")[kind]]
        if places:
            at = places[at_random % len(places)]
            text = text[:at] + (text[at].swapcase() if kind == 2 else "") + text[at + 1 :]
    return text


def slow_grammar(text, key, rate):
    words = text.split()
    if len(words) < 2:
        return text
    for step in range(1, max(1, int(len(words) * rate)) + 1):
        if len(words) < 2:
            continue
        kind, at_random = drawn(key, step, 1, 7) % 3, drawn(key, step, 8, 13)
        at = at_random % (len(words) - (kind == 2))
        words = words[:at] + ([], [words[at]] * 2, words[at : at + 2][::-1])[kind] + words[at + (2 if kind == 2 else 1) :]
    return " ".join(words)


NOISED = ["The cat, it sat on the mat. Groß!", "ab", "", "one", " one ", "a b c d e f g", "Ünï\u00a0cödé\n\ntext; с буквами? 😀 x", "0101 1 0", "a.b,c;d:e!f?"]


@pytest.mark.parametrize("rate", [0.05, 0.3, 2.0])
def test_noise_against_plain_steps(spark, rate):
    rows = [(f"{t}-{i}", text) for t in range(6) for i, text in enumerate(NOISED)]
    df = spark.createDataFrame(rows, "key string, text string")
    kinds = {k: noise.add_noise("text", F.col("key"), k, rate).alias(k) for k in noise.NOISE_TYPES}
    for r in df.select("key", "text", *kinds.values()).collect():
        spelled, worded = slow_spelling(r["text"], r["key"], rate), slow_grammar(r["text"], r["key"], rate)
        assert (r["spelling"], r["grammar"]) == (spelled, worded)
        assert r["mixed"] == (spelled if drawn(r["key"], 0, 1, 1) < 8 else worded)
    assert spark.createDataFrame([(None,)], "text string").select(noise.add_noise("text", F.lit("k"))).first()[0] is None


def test_noise_places_are_drawn_evenly(spark):
    df = spark.range(4000).select(noise.add_spelling_noise(F.lit("abcdef gh"), F.col("id").cast("string"), 0.1).alias("t"))
    counts = Counter(r["t"] for r in df.collect())
    assert abs(counts["abcdefgh"] - 1000) < 150  # one blank, a quarter of the steps
    assert all(abs(counts[x] - 125) < 60 for x in ("Abcdef gh", "abcDef gh", "abcdef gH"))
    assert abs(counts["abcdef gh"] - 1000 - 250) < 200  # no mark to drop, or a swap over the blank


@pytest.mark.parametrize("strategy, fixed", [("uniform", None), ("sqrt", None), ("log", None), (None, 30)])
def test_balance(spark, strategy, fixed):
    counts = {"en": 120, "de": 40, "fr": 3}
    rows = [(f"{lang}{i}", lang) for lang, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, lang string")
    total = sum(counts.values())
    if fixed:
        goal = dict.fromkeys(counts, fixed)
    elif strategy == "uniform":
        goal = dict.fromkeys(counts, total // 3)
    else:
        weight = {k: math.sqrt(n) if strategy == "sqrt" else math.log(n + 1) for k, n in counts.items()}
        goal = {k: int(total * w / sum(weight.values())) for k, w in weight.items()}
    out = sampling.balance(df, strategy or "sqrt", fixed)
    got = {r["lang"]: r["count"] for r in out.groupBy("lang").count().collect()}
    assert got == goal
    base = {r["id"] for r in out.where("draw = 0").collect()}
    for lang, n in counts.items():
        assert sum(x.startswith(lang) for x in base) == min(n, goal[lang])
    assert sorted(out.collect()) == sorted(sampling.balance(df.repartition(9), strategy or "sqrt", fixed).collect())


def test_balance_edges(spark):
    empty = spark.createDataFrame([], "id string, lang string")
    assert sampling.balance(empty, "uniform").count() == 0
    with pytest.raises(ValueError):
        sampling.balance(empty, "cubic")
    same = spark.createDataFrame([("a", "en"), ("a", "en"), ("b", None)], "id string, lang string")
    assert sampling.balance(same, target_per_lang=2).groupBy("lang").count().where("count = 2").count() == 2


def test_shuffle_is_a_permutation(spark):
    s = make(spark, 50)
    out = [r["id"] for r in sampling.shuffled(s).collect()]
    assert sorted(out) == sorted(r["id"] for r in s.collect()) and out != sorted(out)


def test_augment_stage_defaults(spark):
    s = make(spark, 100, ("en", "de"))
    out = pipelines.augment(s, "grpo", balance_strategy=None)
    assert out.count() == 105 and out.where("id LIKE '%\\_aug'").count() == 0
    assert pipelines.augment(s, "unknown", balance_strategy=None).count() == 100 + 7 + 15
    assert pipelines.augment(s, "sft", identity_ratio=0.1, noise_ratio=0.2, balance_strategy=None).count() == 130


STATS = "id string, lang string, source string, target string"


def test_language_stats(spark):
    rows = [("1", "en", "abc", "abd"), ("2_aug", "en", "", ""), ("3_id", "de", "", "xy"), ("4", None, "a b", "a  b"), ("5", "de", "abc", "")]
    got = {r["lang"]: r for r in analyze.language_stats(spark.createDataFrame(rows, STATS)).collect()}
    assert set(got) == {"en", "de", "unknown", "__overall__"}
    assert (got["en"]["n_samples"], got["en"]["n_identity"], got["en"]["n_augmented"]) == (2, 1, 1)
    assert got["en"]["avg_edit_similarity"] == pytest.approx((2 / 3 + 1) / 2) and got["en"]["avg_correction_density"] == pytest.approx(1 / 6)
    assert got["de"]["avg_edit_similarity"] == 0 and got["de"]["avg_correction_density"] == 1 and got["de"]["avg_edit_distance"] == 2.5 and got["de"]["n_identity_injected"] == 1
    assert got["unknown"]["n_identity"] == 1 and got["unknown"]["avg_source_len_word"] == 2
    assert got["__overall__"]["n_samples"] == 5
    assert analyze.language_stats(spark.createDataFrame([], STATS)).count() == 0


def test_comparison_and_tables(spark):
    a = analyze.language_stats(spark.createDataFrame([("1", "en", "a", "b")], STATS))
    b = analyze.language_stats(spark.createDataFrame([("1", "de", "a", "a"), ("2_id", "de", "a", "a")], STATS))
    rows = {r["lang"]: r.asDict(recursive=True) for r in analyze.compare_stats(a, b).collect()}
    assert rows["en"]["after"]["n_samples"] == 0 and rows["en"]["delta"]["n_samples"] == -1
    assert rows["de"]["before"]["error_rate"] == 0 and rows["__overall__"]["delta"]["n_samples"] == 1
    table = analyze.format_comparison(list(rows.values())).splitlines()
    assert table[0].split() == ["lang", "metric", "before", "after", "delta"] and table[1].split() == ["de", "n_samples", "0", "2", "2"] and table[-1].startswith("__overall__")
    single = analyze.format_stats([r.asDict() for r in a.collect()]).splitlines()
    assert single[0].split() == ["lang", *analyze.METRICS] and [x.split()[0] for x in single[1:]] == ["en", "__overall__"] and len(set(map(len, single))) == 1
    assert analyze.as_table([]) == ""


def test_growth_is_a_comparison_in_one_pass(spark):
    base = spark.createDataFrame([("1", "en", "a b", "a c"), ("2", "de", "x", "x"), ("3", None, "", "q")], STATS)
    added = spark.createDataFrame([("1_id", "en", "a c", "a c"), ("4_aug", "fr", "u", "v")], STATS)
    asked = analyze.compare_stats(analyze.language_stats(base), analyze.language_stats(base.unionByName(added)))
    grown = analyze.compare_growth(base, added)
    assert {r["lang"]: (r["before"]["n_samples"], r["after"]["n_samples"]) for r in grown.collect()} == {"en": (1, 2), "de": (1, 1), "fr": (0, 1), "unknown": (1, 1), "__overall__": (3, 5)}
    for m in analyze.METRICS:
        a, b = ({r["lang"]: (r["before"][m], r["after"][m], r["delta"][m]) for r in df.collect()} for df in (asked, grown))
        assert all(a[k] == pytest.approx(b[k]) for k in a) and set(a) == set(b)
    assert analyze.compare_growth(base.limit(0), added.limit(0)).count() == 0


def test_counts(spark):
    s = make(spark, 10, ("en", "de"))
    rows = {(r["lang"], r["corpus"], r["split"]): r["n"] for r in analyze.corpus_counts(s).collect()}
    assert rows[("en", "c", "train")] == 5 and rows[(None, None, None)] == 10 and rows[(None, None, "train")] == 10 and rows[("de", "c", None)] == 5
    assert [tuple(r) for r in analyze.language_histogram(s).collect()] == [("de", 5), ("en", 5)]


def test_evaluate(spark):
    preds = spark.createDataFrame([("1", "x", "a b"), ("1", "x", "a c"), ("2", "x", "q"), ("9", "x", "z")], "id string, lang string, prediction string")
    refs = spark.createDataFrame([("1", "old", "en", 0), ("1", "a b", "en", 1), ("2", "q", None, 0)], "id string, target string, lang string, seq int")
    got = {r["lang"]: r for r in evaluate.evaluate(preds, refs, "seq").collect()}
    assert set(got) == {"en", "unknown", "__overall__"}
    assert got["__overall__"]["n_predictions"] == 4 and got["__overall__"]["n_matched"] == 3 and got["__overall__"]["exact_match"] == pytest.approx(2 / 3)
    assert got["en"]["n_matched"] == 2 and got["en"]["exact_match"] == 0.5
    report = evaluate.report([r.asDict() for r in got.values()])
    assert list(report["per_language"]) == ["en", "unknown"] and report["overall"]["n_matched"] == 3


def test_evaluate_without_match(spark):
    preds = spark.createDataFrame([("1", "en", "a")], "id string, lang string, prediction string")
    refs = spark.createDataFrame([], "id string, target string, lang string, seq int")
    rows = evaluate.evaluate(preds, refs, "seq").collect()
    assert len(rows) == 1 and rows[0]["n_matched"] == 0 and rows[0]["gleu"] == 0.0


def welford(scores, warmup=30):
    n, mean, m2, out = 0, 0.0, 0.0, []
    for x in scores:
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
        out.append(x if n < warmup else (x - mean) / max(math.sqrt(max(m2 / n, 0)), 1e-6))
    return out


@pytest.mark.parametrize("parts, base", [(9, 0.0), (1, 0.0), (9, 1e6)])
def test_running_normalization(spark, parts, base):
    rng = random.Random(1)
    rows = [(lang, i * i - 50, base + rng.random()) for i in range(100) for lang in ("en", "de")] + [("fr", i, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, seq long, score double")
    got = evaluate.running_normalization(df.repartition(5), parts=parts).collect()
    for lang in ("en", "de", "fr"):
        mine = [r["normalized"] for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["seq"])]
        assert mine == pytest.approx(welford([s for k, _, s in rows if k == lang]), abs=1e-6 if not base else 1e-4)


def test_running_normalization_with_odd_languages_and_seqs(spark):
    """A null language is one; small batches, and one far-off seq, change nothing."""
    rng = random.Random(2)
    rows = [(lang, i, rng.random()) for lang in (None, "en", "") for i in range(400)] + [("en", 1 << 60, 0.25), ("de", 5, 0.5)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = evaluate.running_normalization(spark.createDataFrame(rows, "lang string, seq long, score double").withColumn("n", F.lit("kept")), parts=8).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(rows) and got[0]["n"] == "kept"
    for lang in (None, "en", "", "de"):
        mine = [r["normalized"] for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["seq"])]
        assert mine == pytest.approx(welford([s for k, _, s in sorted(rows, key=lambda r: r[1]) if k == lang]), abs=1e-9)


def test_one_extreme_seq_does_not_gather_a_language(spark):
    """Parts hold like numbers of rows however seq is spread, and scores are worked out once."""
    counted = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def work(x):
        counted.add(1)
        return float(x % 7)

    rows = spark.range(20_000).select(F.lit("en").alias("lang"), F.when(F.col("id") == 77, F.lit(1 << 61)).otherwise(F.col("id")).alias("seq"), work("id").alias("score"))
    out = evaluate.running_normalization(rows, parts=8)
    assert out.count() == 20_000 and counted.value == 20_000
    running = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()})
    sizes = [r["n"] for r in running.groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_empty_scores(spark):
    assert evaluate.running_normalization(spark.createDataFrame([], "lang string, seq long, score double")).collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([([5, 6, 7, 8], 2)], "ids array<int>, k int")
    row = df.select(truncate("ids", 3), fits("ids", 4), fits("ids", 3), masked_labels("ids", "k")).first()
    assert row[0] == [5, 6, 7] and row[1] and not row[2] and row[3] == [-100, -100, 7, 8]


def test_inference(spark):
    def generator():
        return lambda prompts: [f"  {p.upper()}\n" for p in prompts]

    out = pipelines.infer(make(spark, 20), generator, batch_size=3).collect()
    assert len(out) == 20 and all(r["prediction"].startswith("PLEASE") for r in out)


def test_inference_refuses_lost_texts(spark):
    with pytest.raises(Exception, match="prompts gave"):
        pipelines.infer(make(spark, 4).coalesce(1), lambda: lambda prompts: prompts[:1]).collect()


@pytest.mark.parametrize("dense", [1 << 22, 0])
def test_ngrams_are_counted_by_batches(spark, dense):
    """Rows are made of a batch's distinct n-grams, not of every character."""
    from collections import Counter

    from glossmill.operators.analyze import _gram_counts

    rows = [("en", "abcabc"), ("en", "ab"), (None, "\U0001f600éab\U0001f600éa"), ("de", ""), ("de", None), ("en", "cab"), ("de", "aaaa")]
    df = spark.createDataFrame(rows, "lang string, t string")
    found = analyze.char_ngram_counts(df, "t", 3, ("lang",))
    wanted = Counter((lang, t[i : i + 3]) for lang, t in rows for i in range(len(t or "") - 2))
    assert {(r["lang"], r["gram"]): r["count"] for r in found.collect()} == wanted
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    old, analyze._DENSE = analyze._DENSE, dense
    grams, counts = _gram_counts(__import__("pyarrow").array([t for _, t in rows if t]), 3)
    analyze._DENSE = old
    assert dict(zip(grams, counts.tolist(), strict=True)) == Counter(t[i : i + 3] for _, t in rows for i in range(len(t or "") - 2))
