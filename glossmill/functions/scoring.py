"""The gated reward of a correction: format gate, exact match, weighted sub-scores."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.distance import distance, distances
from glossmill.functions.text import SPACE, _col, chrf_value, chrf_values, compose_texts, strip

# Fixed values.
FORMAT_FAIL_SCORE = -1.0
LENGTH_RATIO_BOUNDS = (0.3, 3.0)
NO_SOURCE_PRESERVE = 0.5
LEAK_PATTERN = r"(?:please\s+)?correct\s+(?:all\s+)?(?:the\s+)?grammatical\s+errors?\s+in\s+the\s+following"

#: What stands before the language in a data source's name; callers may have their own.
DATA_SOURCE_PREFIX = "corpus_"

#: `\s` widened to all white space, case folded beyond ASCII.
_LEAK = "(?iu)" + LEAK_PATTERN.replace(r"\s", SPACE.removeprefix("(?U)").replace(r"\s", r"\s\x{85}\p{Z}"))


def sigmoid(x: Column | float) -> Column:
    x = x if isinstance(x, Column) else F.lit(float(x))
    # The exponent never overflows: its argument is at most 0.
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def weights(progress: Column | float) -> tuple[Column, Column]:
    """Weights of preserving and of correcting as training moves from 0 to 1; they sum to 1."""
    p = progress if isinstance(progress, Column) else F.lit(float(progress))
    s = sigmoid(8.0 * (p - 0.5))
    return 0.5 - 0.25 * s, 0.5 + 0.25 * s


def format_gate(pred: Column | str, source: Column | str | None = None) -> Column:
    """Whether an output is acceptable: not blank, of like length as the source, no echo of the instruction."""
    pred = _col(pred)
    low, high = LENGTH_RATIO_BOUNDS
    ok = (F.length(strip(pred)) > 0) & ~pred.rlike(_LEAK)
    if source is None:
        return ok
    source = F.coalesce(_col(source), F.lit(""))
    ratio = F.length(pred) / F.greatest(F.length(source), F.lit(1))
    return ok & ((F.length(source) == 0) | ratio.between(low, high))


def language_of(data_source: Column | str, prefix: str = DATA_SOURCE_PREFIX) -> Column:
    """The part of a data source after its prefix, if it has it."""
    c = _col(data_source)
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def with_score(df: DataFrame, pred: str, ref: str, source: str | None = None, progress: Column | float = 0.0, out: str = "score", composed: bool = False, parts: bool = False) -> DataFrame:
    """Add the reward of raw texts; a null source counts as absent.

    Gate and exact match decide first; only rows they leave open reach the costly
    sub-scores, which get nulls otherwise.  All four are found in one pass over the texts:
    as built-in functions the optimizer would write the normalized texts out anew wherever
    they are used.  With `parts`, `gate_passed`, `exact`, `r_preserve` and `r_correct` stay
    as columns.
    """

    @F.pandas_udf("gate_passed boolean, exact boolean, r_preserve double, r_correct double")
    def run(pred: pd.Series, ref: pd.Series, source: pd.Series) -> pd.DataFrame:
        return judge_texts(pred.tolist(), ref.tolist(), source.tolist(), composed)

    # Not called deterministic, so that a filter on its result doesn't call it once more.
    judged = run.asNondeterministic()(_col(pred), _col(ref), _col(source) if source else F.lit(None).cast("string"))
    staged = df.withColumn("__j", judged).withColumns({c: F.col("__j")[c] for c in ("gate_passed", "exact", "r_preserve", "r_correct")}).drop("__j")
    w_preserve, w_correct = weights(progress)
    mixed = F.least(F.greatest(w_preserve * F.col("r_preserve") + w_correct * F.col("r_correct"), F.lit(-1.0)), F.lit(1.0))
    score = F.when(~F.col("gate_passed"), F.lit(FORMAT_FAIL_SCORE)).when(F.col("exact"), F.lit(1.0)).otherwise(mixed)
    staged = staged.withColumn(out, score)
    return staged if parts else staged.drop("gate_passed", "exact", "r_preserve", "r_correct")


_LEAKED = re.compile(LEAK_PATTERN, re.IGNORECASE)


def normalized(text: str | None, composed: bool = False) -> str | None:
    """`normalize_text` of a value."""
    return None if text is None else " ".join((text if composed else unicodedata.normalize("NFC", text)).split())


def acceptable(pred: str, source: str) -> bool:
    """`format_gate` of two normalized values."""
    low, high = LENGTH_RATIO_BOUNDS
    return bool(pred) and (not source or low <= len(pred) / len(source) <= high) and not ("correct" in pred.lower() and _LEAKED.search(pred))


def judge_texts(preds: list[str | None], refs: list[str | None], sources: list[str | None], composed: bool = False) -> pd.DataFrame:
    """Gate, exact match and, of rows these leave open, both sub-scores of raw texts; null where a text that counts is null."""
    p, r = ([normalized(t, composed) for t in side] for side in (preds, refs))
    s = [normalized(t, composed) or "" for t in sources]
    gate = [None if x is None else acceptable(x, y) for x, y in zip(p, s, strict=True)]
    exact = [None if x is None or y is None else x == y for x, y in zip(p, r, strict=True)]
    open_ = [g is True and e is False for g, e in zip(gate, exact, strict=True)]
    p, r, s = ([t if o else None for t, o in zip(side, open_, strict=True)] for side in (p, r, s))
    apart = distances(p, [t or None for t in s])
    preserve = [None if x is None else NO_SOURCE_PRESERVE if not y else 1.0 - d / max(len(x), len(y)) for x, y, d in zip(p, s, apart, strict=True)]
    return pd.DataFrame({
        "gate_passed": pd.array(gate, dtype="boolean"), "exact": pd.array(exact, dtype="boolean"),
        "r_preserve": pd.array(preserve, dtype="Float64"), "r_correct": chrf_values(p, r),  # NaN becomes null
    })


def score_value(pred: str, ref: str, source: str | None = None, progress: float = 0.0) -> float:
    """The reward of one triple, for callers outside Spark."""
    p, r, s = (normalized(t or "") for t in (pred, ref, source))
    if not acceptable(p, s):
        return FORMAT_FAIL_SCORE
    if p == r:
        return 1.0
    preserve = 1 - distance(p, s) / max(len(p), len(s)) if s else NO_SOURCE_PRESERVE
    shift = 0.25 / (1 + math.exp(-8.0 * (progress - 0.5)))
    return max(-1.0, min(1.0, (0.5 - shift) * preserve + (0.5 + shift) * chrf_value(p, r)))


def compute_score(data_source: str, solution_str: str, ground_truth: str, extra_info: dict | None = None, progress: float = 0.0) -> float:
    """The reward as trainers call it, by name, for one generation."""
    return score_value(solution_str, ground_truth, (extra_info or {}).get("source"), progress)


#: What `register` makes, each of built-ins and of functions before it.  Arrow functions get nulls for rows that are decided already.
_SQL_FUNCTIONS = (
    r"squeeze_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, r'" + SPACE + r"+', ' '))",
    r"normalize_text(t STRING) RETURNS STRING RETURN squeeze_text(coalesce(compose_text(CASE WHEN t RLIKE r'[^\x{0}-\x{2ff}]' THEN t END), t))",
    "edit_distance_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1.0D - edit_distance(a, b) / greatest(length(a), length(b)) END",
    f"format_gate(pred STRING, source STRING) RETURNS BOOLEAN RETURN length(squeeze_text(pred)) > 0 AND NOT pred RLIKE r'{_LEAK}' AND "
    f"(length(source) = 0 OR length(pred) / greatest(length(source), 1) BETWEEN {LENGTH_RATIO_BOUNDS[0]}D AND {LENGTH_RATIO_BOUNDS[1]}D)",
    "correct_weight(progress DOUBLE) RETURNS DOUBLE RETURN 0.5D + 0.25D / (1.0D + exp(-8.0D * (progress - 0.5D)))",
    "mixed_reward(pred STRING, ref STRING, source STRING, progress DOUBLE) RETURNS DOUBLE RETURN greatest(-1.0D, least(1.0D, "
    f"(1.0D - correct_weight(progress)) * (CASE WHEN length(source) = 0 THEN {NO_SOURCE_PRESERVE}D ELSE edit_distance_similarity(pred, source) END) + correct_weight(progress) * chrf_score(pred, ref)))",
    f"gated_reward(pred STRING, ref STRING, source STRING, progress DOUBLE) RETURNS DOUBLE RETURN CASE WHEN NOT format_gate(pred, source) THEN {FORMAT_FAIL_SCORE}D WHEN pred = ref THEN 1.0D "
    "ELSE mixed_reward(CASE WHEN format_gate(pred, source) AND pred <> ref THEN pred END, ref, source, progress) END",
    "compute_score(data_source STRING, solution_str STRING, ground_truth STRING, extra_info STRUCT<source: STRING>, progress DOUBLE DEFAULT 0.0D) RETURNS DOUBLE RETURN "
    "gated_reward(normalize_text(coalesce(solution_str, '')), normalize_text(coalesce(ground_truth, '')), normalize_text(coalesce(extra_info.source, '')), progress)",
)


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL.

    `compute_score(data_source, solution_str, ground_truth, extra_info[, progress])` takes
    what trainers pass, `extra_info` as a struct of the source alone; a null text is empty
    and a null struct or source absent.  Composing, distances and chrF are Arrow functions,
    all else is built-in.
    """

    @F.pandas_udf("string")
    def compose_text(texts: pd.Series) -> pd.Series:
        return compose_texts(texts)

    @F.pandas_udf("int")
    def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances(a.tolist(), b.tolist()), dtype="Int32")

    @F.pandas_udf("double")
    def chrf_score(pred: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series(chrf_values(pred.tolist(), ref.tolist()), dtype="float64")

    for f in (compose_text, edit_distance, chrf_score):
        spark.udf.register(f.__name__, f)
    for made in _SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {made}")
