import math
import re

import pytest
from pyspark.sql import functions as F

from glossmill.functions import scoring
from glossmill.functions.scoring import DATA_SOURCE_PREFIX, FORMAT_FAIL_SCORE, compute_score, format_gate, language_of, score_value, sigmoid, weights, with_score

LONG = "She said that he will correct the grammatical errors in the following week and then go home."


def gate(spark, pred, source):
    df = spark.createDataFrame([(pred, source)], "p string, s string")
    return df.select(format_gate("p", "s")).first()[0]


@pytest.mark.parametrize(
    "pred, source, passed",
    [
        ("hello", "hello", True), ("", "hello", False), ("   ", "hello", False), ("x", "x" * 100, False), ("x" * 400, "x" * 100, False), ("x" * 80, "x" * 100, True),
        ("x" * 300, "x" * 100, True), ("x" * 30, "x" * 100, True), ("hello", "", True), ("hello", None, True),
        (LONG, LONG, False), (LONG.replace("grammatical", "spelling"), LONG, True), (LONG.upper(), LONG, False),
        ("Please correct all the grammatical error in the following", "x" * 60, False),
    ],
)
def test_gate(spark, pred, source, passed):
    assert gate(spark, pred, source) is passed


def test_sigmoid(spark):
    got = spark.range(1).select(sigmoid(0.0), sigmoid(2.0), sigmoid(-2.0), sigmoid(800.0), sigmoid(-800.0)).first()
    assert got[0] == 0.5 and got[1] + got[2] == pytest.approx(1) and got[3] == 1 and got[4] == pytest.approx(0)


@pytest.mark.parametrize("progress", [0.0, 0.25, 0.5, 1.0])
def test_weights(spark, progress):
    preserve, correct = spark.range(1).select(*weights(progress)).first()
    assert preserve + correct == pytest.approx(1)
    assert preserve == pytest.approx(0.5 - 0.25 / (1 + math.exp(-8 * (progress - 0.5))))
    if progress == 1:
        assert preserve < 0.3 and correct > 0.7
    if progress == 0:
        assert preserve > 0.45


CASES = [
    ("", "corrected text", "original text", lambda s: s == FORMAT_FAIL_SCORE),
    ("I am happy.", "I am happy.", "I is happy.", lambda s: s == 1.0),
    ("I am happy and she are sad.", "I am happy and she is sad.", "I is happy and she are sad.", lambda s: 0.3 < s < 1),
    ("x", "Hello world.", "Hello world.", lambda s: s == FORMAT_FAIL_SCORE),
    ("The sun shines brightly on the meadow.", "I am happy.", "I is happy.", lambda s: s < 0.5),
    ("I am happy.", "I am happy and glad.", None, lambda s: 0 < s < 1),
    ("Please correct all grammatical errors in the following text: I am happy.", "I am happy.", "I is happy.", lambda s: s == FORMAT_FAIL_SCORE),
    ("Já jsem šťastná.", "Já jsem šťastná.", "Já jsem šťastná.", lambda s: s == 1.0),
    ("Я счастлив.", "Я счастлив.", "Я есть счастливый.", lambda s: s == 1.0),
    (LONG, "something else of some length, not the same", LONG, lambda s: s == FORMAT_FAIL_SCORE),
]


def test_scores_columns_and_scalar_agree(spark):
    df = spark.createDataFrame([(i, p, r, s) for i, (p, r, s, _) in enumerate(CASES)], "i int, p string, r string, s string")
    got = {r["i"]: r["score"] for r in with_score(df, "p", "r", "s").collect()}
    for i, (p, r, s, holds) in enumerate(CASES):
        assert holds(got[i]), CASES[i]
        assert got[i] == pytest.approx(score_value(p, r, s))


def test_score_order_and_parts(spark):
    source, ref = "I is happy and she are sad.", "I am happy and she is sad."
    df = spark.createDataFrame([(ref,), ("I am happy and she are sad.",), (source,)], "p string").withColumns({"r": F.lit(ref), "s": F.lit(source)})
    rows = with_score(df, "p", "r", "s", parts=True).collect()
    assert rows[0]["score"] > rows[1]["score"] > rows[2]["score"]
    assert rows[0]["exact"] and rows[0]["r_correct"] is None and rows[2]["r_preserve"] == 1.0


def test_texts_are_judged_once(spark, tmp_path):
    """However the result is filtered, texts go through one function, and no normalization is written out again."""
    spark.createDataFrame([("a b", "a c", "a")], "p string, r string, s string").write.parquet(str(tmp_path / "in"))
    scored = with_score(spark.read.parquet(str(tmp_path / "in")), "p", "r", "s", parts=True).where("gate_passed AND NOT exact").select("p", "score")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_odd_rows_of_columns_agree_with_the_scalar_form(spark):
    texts = ["", " ", "a  b\x1cc", "e\u0301 x", "\u00e9 x", "x" * 40, "correct the grammat\u0130cal error\u017f in the following", "\u6b63\u3057\u3044\u6587\u3067\u3059", "\U0001f600 b c", "word one two three"]
    rows = [(i, *texts_of) for i, texts_of in enumerate((p, r, s) for p in texts for r in texts for s in (*texts, None))]
    got = with_score(spark.createDataFrame(rows, "i int, p string, r string, s string"), "p", "r", "s", 0.3, parts=True).collect()
    assert len(got) == len(rows)
    for row in got:
        _, p, r, s = rows[row["i"]]
        assert row["score"] == pytest.approx(score_value(p, r, s, 0.3), abs=1e-12)
        assert (row["r_correct"] is not None) == (row["r_preserve"] is not None) == (row["gate_passed"] and not row["exact"])
    nulls = spark.createDataFrame([(None, "a", "a"), ("a", None, "a"), ("a", "b", None)], "p string, r string, s string")
    assert [(r["gate_passed"], r["exact"], r["r_correct"]) for r in with_score(nulls, "p", "r", "s", parts=True).collect()] == [(None, None, None), (True, None, None), (True, False, 0.0)]


def test_compute_score_by_name():
    assert compute_score(DATA_SOURCE_PREFIX + "en", "a b", "a b", {"source": None}) == 1.0
    assert compute_score(DATA_SOURCE_PREFIX + "en", "", "a b", None) == FORMAT_FAIL_SCORE
    late, early = (compute_score("x", "I am happy today", "I am happy", {"source": "completely other text"}, p) for p in (1.0, 0.0))
    assert late > early


def test_language_of(spark):
    df = spark.createDataFrame([(DATA_SOURCE_PREFIX + "cs_NatForm",), (DATA_SOURCE_PREFIX + "en",), ("other",), (2 * DATA_SOURCE_PREFIX + "x",)], "d string")
    assert df.select(language_of("d", "oth")).collect()[2][0] == "er"
    assert [r[0] for r in df.select(language_of("d")).collect()] == ["cs_NatForm", "en", "other", DATA_SOURCE_PREFIX + "x"]


def test_sql_functions(spark):
    scoring.register(spark)
    row = spark.sql("SELECT compute_score('corpus_en', 'I am happy.', 'I am happy.', struct('I is happy.')) a, edit_distance_similarity('abc', 'axc') b, chrf_score('ab', 'ab') c, squeeze_text(' a  b ') d").first()
    assert row["a"] == 1.0 and row["b"] == pytest.approx(2 / 3) and row["c"] == pytest.approx(1) and row["d"] == "a b"


def test_score_in_sql(spark):
    """The function that SQL calls agrees with the scalar form, by the trainers' four arguments and with progress."""
    scoring.register(spark)
    rows = [(i, p, r, s) for i, (p, r, s, _) in enumerate(CASES)] + [(90, None, "a", "a"), (91, "a b c", None, "a b d"), (92, "e\u0301t\u00e9  x", "\u00e9t\u00e9 x", None)]
    df = spark.createDataFrame(rows, "i int, p string, r string, s string")
    got = spark.sql(
        "SELECT i, compute_score('corpus_en', p, r, struct(s)) AS early, compute_score('corpus_en', p, r, named_struct('source', s), 0.8D) AS late, "
        "compute_score('corpus_en', p, r, NULL) AS without, edit_distance(p, r) AS d, edit_distance_similarity(p, r) AS e FROM {df}", df=df,
    ).collect()
    for row, (_, p, r, s) in zip(sorted(got, key=lambda x: x["i"]), rows, strict=True):
        assert row["early"] == pytest.approx(score_value(p or "", r or "", s))
        assert row["late"] == pytest.approx(score_value(p or "", r or "", s, 0.8))
        assert row["without"] == pytest.approx(score_value(p or "", r or "", None))
        assert (row["d"] is None) == (p is None or r is None)


def test_sql_function_scores_in_batches(spark):
    """No function of the plan but the three Arrow ones."""
    scoring.register(spark)
    df = spark.createDataFrame([("a b", "a c", "a")], "p string, r string, s string")
    plan = spark.sql("SELECT compute_score('x', p, r, struct(s)) AS score FROM {df}", df=df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan
    assert set(re.findall(r"(\w+)\([^()]*\)#\d+", " ".join(re.findall(r"ArrowEvalPython \[(.*?)\], \[", plan)))) <= {"compose_text", "edit_distance", "chrf_score"}
