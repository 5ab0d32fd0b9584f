import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glossmill.__main__ import main
from glossmill.functions.scoring import DATA_SOURCE_PREFIX, score_value
from glossmill.operators.evaluate import running_normalization
from glossmill.plans import pipelines
from glossmill.schemas import SAMPLE
from glossmill.sources import files
from glossmill.streaming.normalizer import SCORES, keyed_state, normalize_files, normalize_stream, score_stream

ORIG = "# intro\ndropped\n### essay_id = e1\nI is happy.\n\nShe are sad.\n###  essay_id=e2 \nold body\n### essay_id = e2\nNew body here.\n### essay_id = e3\n\n"
REF1 = "### essay_id = e1\r\nI am happy.\r\nShe is sad.\r\nExtra line.\r\n### essay_id = e2\r\nNew body there.\r\n"
REF2 = "### essay_id = e1\nI'm happy.\n"


@pytest.fixture
def corpora(tmp_path):
    a = tmp_path / "data" / "english" / "Alpha"
    b = tmp_path / "data" / "german" / "Beta"
    for d in (a, b):
        d.mkdir(parents=True)
    (a / "metadata.yaml").write_text("target_language: en\nsentence_aligned: true\nreference_essays_1: x\nreference_essays_2: y\n")
    (b / "metadata.yaml").write_text("target_language: de\n")
    (a / "en-alpha-orig-train.md").write_text(ORIG)
    (a / "en-alpha-ref1-train.md").write_text(REF1, newline="")
    (a / "en-alpha-ref2-train.md").write_text(REF2)
    (a / "README.md").write_text("-train -orig- no")
    (b / "de_beta_orig_dev.md").write_text("### essay_id = x\n Hallo\n\nWelt \n")
    (b / "de_beta_ref1_dev.md").write_text("### essay_id = x\nHallo,\nWelt\n")
    return str(tmp_path / "data")


def test_discovery(spark, corpora):
    rows = {r["corpus_name"]: r for r in files.discover_corpora(spark, corpora).collect()}
    assert rows["Alpha"]["lang_code"] == "en" and rows["Alpha"]["sentence_aligned"] and rows["Alpha"]["n_refs"] == 2
    assert rows["Beta"]["lang_name"] == "German" and not rows["Beta"]["sentence_aligned"]


def test_split_files(spark, corpora):
    rows = {(r["split"], r["kind"], r["ref_key"]) for r in files.find_split_files(spark, corpora + "/english/Alpha").collect()}
    assert rows == {("train", "orig", None), ("train", "ref", "ref1"), ("train", "ref", "ref2")}


def test_file_names(spark):
    names = ["/c/a-orig-development.md", "/c/a_orig_test.md", "/c/a-ref12-dev.md", "/c/CHANGELOG.md", "/c/a-train.md", "/c/b-orig-dev.md"]
    rows = {(r["split"], r["kind"], r["ref_key"]): r["path"] for r in files.classify_files(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert rows == {("dev", "orig", None): "/c/b-orig-dev.md", ("test", "orig", None): "/c/a_orig_test.md", ("dev", "ref", "ref12"): "/c/a-ref12-dev.md"}


def test_essays(spark, corpora):
    rows = {r["essay_id"]: r["text"] for r in files.read_essays(spark, corpora + "/english/Alpha/en-alpha-orig-train.md").collect()}
    assert rows == {"e1": "I is happy.\n\nShe are sad.", "e2": "New body here.", "e3": ""}
    rows = {r["essay_id"]: r["text"] for r in files.read_essays(spark, corpora + "/english/Alpha/en-alpha-ref1-train.md").collect()}
    assert rows == {"e1": "I am happy.\nShe is sad.\nExtra line.", "e2": "New body there."}


@pytest.fixture
def small_splits(spark):
    """Input splits of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def random_markdown(rng):
    pieces = [
        "### essay_id = a\n", "### essay_id = b\n", "###  essay_id=c d \r\n", "### essay_id = é\r", "###\tessay_id = a\n", "### note\n", "###\n", "######  essay_id = no\n", "#### essay_id = no\n", " essay_id = x\n",
        "### essay_id =\n", "### essay_id = \n", " ### essay_id = no\n", "Ein Satz.\n", "A longer line of words, of which there are some.\r\n", "\n", "\r", " \n", "é 😀 ü\n", "#", "##",
    ]
    return "".join(rng.choices(pieces, k=rng.randint(0, 60)))


def plain_essays(text):
    """Essays of a file, a line at a time."""
    found, name = {}, None
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        header = re.match(r"###[^\S\n]+essay_id[^\S\n]*=[^\S\n]*([^\n]+)$", line)
        if header:
            name = header[1].strip()
            found[name] = []
        elif name is not None:
            found[name].append(line)
    return {k: "\n".join(v).strip() for k, v in found.items()}


def test_large_files_are_read_in_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    texts = [random_markdown(rng) for _ in range(60)] + ["", "### essay_id = only", " essay_id = x\n### essay_id = y\n", "x" * 900 + "\n### essay_id = late\nbody\n" + "###\n" * 200 + "end", "### essay_id = a\n" + "### no\n" * 300]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.md").write_text(text, newline="")
    found = files.read_essays(spark, str(tmp_path), recursive=True).collect()
    got = {}
    for r in found:
        own = got.setdefault(int(r["path"].rsplit("/", 1)[1].removesuffix(".md")), {})
        assert r["essay_id"] not in own
        own[r["essay_id"]] = r["text"]
    for i, text in enumerate(texts):
        assert got.get(i, {}) == plain_essays(text), (i, text)
    scan = spark.read.option("lineSep", "\n###").text(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 60


def test_whole_files_and_splits_agree(spark, tmp_path, small_splits):
    rng = random.Random(9)
    for i in range(20):
        (tmp_path / f"{i}.md").write_text(random_markdown(rng), newline="")
    whole = files.parse_essays(spark.read.text(str(tmp_path), wholetext=True).select("value", "_metadata.file_path").withColumnRenamed("file_path", "path"))
    rows = lambda df: sorted((r["path"], r["essay_id"], r["text"]) for r in df.collect())
    assert rows(files.read_essays(spark, str(tmp_path), recursive=True)) == rows(whole)


@pytest.mark.parametrize("limit", [1, 2, 7, 50, 199, 10_000])
def test_bounded_scan_over_splits(spark, tmp_path, small_splits, limit):
    rng = random.Random(limit)
    lines = [rng.choice(['{"id": "%d", "t": "%s"}' % (i, "é" * rng.randint(0, 90)), "", " \t "]) for i in range(200)]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines) + "\n")
    head = files.read_jsonl_head(spark, str(path), "id string", limit)
    assert sorted(r["id"] for r in head.collect()) == sorted(json.loads(x)["id"] for x in lines[:limit] if x.strip())
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "rangepartitioning" not in plan


def test_last_line_of_several_files_holds(spark, tmp_path, small_splits):
    """An id's reference is that of the last line of the last file, however lines are dealt to tasks."""
    refs, preds = tmp_path / "refs", tmp_path / "preds.jsonl"
    refs.mkdir()
    rng = random.Random(3)
    held = {}
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        lines = []
        for k in range(60):
            i, target = str(rng.randrange(40)), f"text {name} {k} " + "x" * rng.randint(0, 40)
            lines.append(json.dumps({"id": i, "target": target, "lang": "en"}))
            held[i] = target
        (refs / name).write_text("\n".join(lines) + "\n")
    preds.write_text("".join(json.dumps({"id": i, "lang": "en", "source": "s", "prediction": t}) + "\n" for i, t in held.items()))
    for size in ("150", "1000", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert pipelines.evaluate_files(spark, str(preds), str(refs))["overall"]["exact_match"] == 1.0


def test_one_pass_writes_every_split(spark, tmp_path):
    df = spark.createDataFrame([(i, ("train", "dev")[i % 2]) for i in range(20)], "i int, split string")
    counted = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(i):
        counted.add(1)
        return i

    for _ in range(2):  # the second time over what is there
        paths = files.write_parquet_by_split(df.withColumn("i", seen("i")), str(tmp_path / "out"), "p_")
    assert counted.value == 40 and sorted(paths) == ["dev", "train"]
    assert sorted(r["i"] for r in spark.read.parquet(paths["dev"]).collect()) == list(range(1, 20, 2))
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["p_dev.parquet", "p_train.parquet"]


def test_targets_may_have_their_own_length(spark, corpora):
    targets = lambda *most: sorted(r["target"] for r in pipelines.samples_from_corpora(spark, corpora, *most).collect())
    assert len(targets(4)) == 5 and targets(4, 1000) == targets(4)
    assert targets(4, 3) == [t for t in targets(4) if len(t) <= 12] and len(targets(4, 3)) == 4


def test_build_augment_analyze_prepare(spark, corpora, tmp_path, capsys):
    out = str(tmp_path / "out")
    counts = {(r["lang"], r["corpus"], r["split"]): r["n"] for r in pipelines.build_dataset(spark, corpora, out).collect()}
    assert counts[("en", "Alpha", "train")] == 4 and counts[("de", "Beta", "dev")] == 1 and counts[(None, None, None)] == 5
    train = f"{out}/{DATA_SOURCE_PREFIX}train.jsonl"
    samples = {(r["ref"], r["source"]): r["target"] for r in files.read_jsonl(spark, train, SAMPLE).collect()}
    assert samples[("ref1", "She are sad.")] == "She is sad." and samples[("ref2", "I is happy.")] == "I'm happy." and samples[("ref1", "New body here.")] == "New body there."
    assert spark.read.parquet(f"{out}/{DATA_SOURCE_PREFIX}dev.parquet").first()["extra_info"]["split"] == "dev"

    augmented = str(tmp_path / "augmented")
    main(["augment", "--input", train, "--output", augmented, "--identity-ratio", "0.5", "--noise-ratio", "0.5"])
    assert spark.read.json(augmented).count() == 8
    report = tmp_path / "report.json"
    main(["analyze", "--before", train, "--after", augmented, "--output", str(report)])
    assert json.loads(report.read_text())["en"]["delta"]["n_samples"] == 4
    main(["analyze", "--input", train])
    assert "avg_edit_distance" in capsys.readouterr().out
    main(["prepare", "--input", augmented, "--sft-output", str(tmp_path / "sft"), "--rl-output", str(tmp_path / "rl")])
    assert spark.read.parquet(str(tmp_path / "sft")).columns == ["messages", "lang", "id"] and spark.read.parquet(str(tmp_path / "rl")).count() == 8


def test_evaluate_files(spark, tmp_path, capsys):
    preds, refs, out = tmp_path / "p.jsonl", tmp_path / "r.jsonl", tmp_path / "m.json"
    preds.write_text('{"id": "1", "lang": "en", "source": "s", "prediction": "ä b"}\n\n{"id": "2", "lang": "en", "source": "s", "prediction": "c"}\n')
    refs.write_text('{"id": "1", "target": "stale", "lang": "en"}\n{"id": "1", "target": "ä b", "lang": "en"}\n')
    main(["evaluate", "--predictions", str(preds), "--references", str(refs), "--output", str(out)])
    assert json.loads(out.read_text())["overall"] == {"n_predictions": 2, "n_matched": 1, "exact_match": 1.0, "edit_distance_similarity": 1.0, "gleu": 1.0}
    printed = capsys.readouterr().out.splitlines()
    assert printed[0].split()[:2] == ["lang", "n_predictions"] and printed[1].split()[:3] == ["all", "2", "1"]


def test_jsonl_bad_line_fails(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "1"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(path), "id string").collect()


def test_bounded_scan_counts_blank_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "1"}\n\n{"id": "2"}\n{"id": "3"}\n')
    assert [r["id"] for r in files.read_jsonl_head(spark, str(path), "id string", 3).collect()] == ["1", "2"]
    assert files.read_jsonl_head(spark, str(path), "id string", 0).count() == 3
    path.write_text('{"id": "1"}\n\t \t\n\u00a0\n{"id": "2"}\n{"id": "3"}\n')
    assert [r["id"] for r in files.read_jsonl_head(spark, str(path), "id string", 4).collect()] == ["1", "2"]


def test_bounded_scan_keeps_the_order_of_lines_over_splits(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(f'{{"id": "{i}"}}\n' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        got = [int(r["id"]) for r in files.read_jsonl_head(spark, str(path), "id string", 3000).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(3000))


def test_prefix_is_the_callers(spark, corpora, tmp_path):
    pipelines.build_dataset(spark, corpora, str(tmp_path / "own"), prefix="mine_")
    assert spark.read.parquet(str(tmp_path / "own" / "mine_dev.parquet")).first()["data_source"] == "mine_de_Beta"


def test_jsonl_keeps_letters(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([("ü",)], "t string").coalesce(1), str(tmp_path / "o"))
    assert any("ü" in p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part-*"))


def test_progress(tmp_path):
    path = str(tmp_path / "p.json")
    assert files.read_progress(path, 0.25) == 0.25
    files.write_progress(path, 30, 60)
    assert files.read_progress(path) == 0.5
    files.write_progress(path, 90, 60)
    assert files.read_progress(path) == 1.0
    files.write_progress(path, 5, 0)
    assert files.read_progress(path) == 1.0
    reader = files.ProgressReader(path, every=3)
    assert reader() == 1.0
    files.write_progress(path, 0, 10)
    assert [reader(), reader(), reader()] == [1.0, 1.0, 0.0]
    (tmp_path / "p.json").write_text("broken")
    assert files.read_progress(path, 0.75) == 0.75


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("model:\n  name: x\nrate: 0.1\n")
    assert files.read_settings(str(tmp_path / "c.yaml"))["rate"] == 0.1


def test_stream_normalizer_matches_batch(spark, tmp_path):
    from glossmill.operators.evaluate import running_normalization

    rows = [("en", i, (i * 37 % 100) / 100) for i in range(80)]
    for at in (0, 40):
        spark.createDataFrame(rows[at : at + 40], "lang string, seq long, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("lang string, seq long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with keyed_state(spark):
        run = normalize_stream(source).writeStream.format("memory").queryName("normalized").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["seq"]: r["normalized"] for r in spark.table("normalized").collect()}
    assert len(got) == 80
    batch = {r["seq"]: r["normalized"] for r in running_normalization(spark.createDataFrame(rows, "lang string, seq long, score double")).collect()}
    assert all(got[k] == pytest.approx(batch[k], abs=1e-6) for k in batch)


def test_streams_go_on_from_their_checkpoints(spark, tmp_path):
    """Progress is read anew for every batch, state outlives a restart, and a batch without open generations is no harm."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdef", k=5))
    path = lambda name: str(tmp_path / name)
    schema = "lang string, seq long, output string, target string, source string"
    rows = []
    for i in range(120):
        target = " ".join(word() for _ in range(6))
        rows.append((("en", None, "de")[i % 3], i, target if i % 10 == 0 else target.replace("a", "b", 1) + "x", target, target[::-1]))
    wanted = []
    for progress, some in ((0.0, rows[:50]), (0.75, rows[50:110]), (0.75, []), (0.75, [(rows[110][0], 110, "", "t", "s")])):
        if some:
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path("in"))
        if some and some[0][1] < 100:
            files.write_progress(path("progress.json"), int(progress * 4), 4, spark)
        elif not some:
            (tmp_path / "progress.json").write_text("no json")  # the last value that could be read holds
        score_stream(spark.readStream.schema(schema).parquet(path("in")), path("progress.json"), path("scores"), path("ck1")).awaitTermination()
        normalize_files(spark, path("scores"), path("out"), path("ck2"), warmup=5).awaitTermination()
        wanted += [(lang, seq, score_value(p, r, s, progress)) for lang, seq, p, r, s in some if p and p != r]
    got = spark.read.schema(f"{SCORES}, normalized double").parquet(path("out")).collect()
    scores = {(r["lang"], r["seq"]): r["score"] for r in got}
    assert len(got) == len(wanted) and all(scores[lang, seq] == pytest.approx(score) for lang, seq, score in wanted)
    plain = running_normalization(spark.createDataFrame(wanted, SCORES), warmup=5).collect()
    assert {(r["lang"], r["seq"]): pytest.approx(r["normalized"], abs=1e-9) for r in plain} == {(r["lang"], r["seq"]): r["normalized"] for r in got}


def test_progress_in_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/p.json"
    assert files.read_progress(path, 0.25, spark) == 0.25
    for step in (1, 3):
        files.write_progress(path, step, 4, spark)
        assert files.read_progress(path, 0.0, spark) == step / 4 == files.read_progress(str(tmp_path / "p.json"))
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["p.json"]


def test_essays_are_read_without_python_and_in_splits_of_their_own(spark, tmp_path):
    """Only the essay files are read in small splits; whoever reads what was stored has the session's, and no task starts a Python worker."""
    for i in range(3):
        (tmp_path / f"{i}.md").write_text("".join(f"### essay_id = {k}\nbody {k}\n### more\n" for k in range(200)))
    found = files.read_essays(spark, str(tmp_path), recursive=True, split_bytes=512)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
    assert found.count() == 600 and {r["text"] for r in found.where("essay_id = '7'").collect()} == {"body 7\n### more"}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "512"
