"""Every named query of the library and the DuckDB SQL that states its result.

The queries run the operators over the `documents` table: a document is an essay whose
text is the reference, and the same text without punctuation stands for the learner's
version.  Essays are aligned line by line, as in sentence-aligned corpora, so every line
of every document becomes a sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.noise import add_synthetic_noise
from glossmill.functions.scoring import DATA_SOURCE_PREFIX, format_gate, language_of, register, weights, with_score
from glossmill.functions.text import chrf, edit_distance, edit_distance_similarity, normalize_text, strip, with_gleu, word_ngrams, words
from glossmill.functions.tokens import fits, masked_labels, truncate
from glossmill.operators import analyze, evaluate, sampling
from glossmill.operators.samples import (
    INSTRUCTION, align_documents, align_essays, align_lines, build_samples, filter_pairs, instruction, is_augmented, is_identity_injected, rewrite_prompt, rl_records, sft_records,
)
from glossmill.plans import pipelines
from glossmill.schemas import LANGUAGES, SAMPLE, SPLITS
from glossmill.sources import files
from glossmill.sources.files import classify_files, parse_essays
from glossmill.sources.scratch import scratch_path
from glossmill.streaming import normalizer

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that states its result if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- samples from documents -------------------------------------------------------------

PUNCTUATION = "[.,;:!?]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays; a scan of fewer partitions than there are cores is dealt out finely, as the work per row is heavy and uneven."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.col("source").alias("corpus"))
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if docs.rdd.getNumPartitions() < cores else docs


def split_by_id() -> F.Column:
    return F.when(F.col("doc_id") % 10 == 0, "dev").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "lang", "corpus", split_by_id().alias("split"), F.regexp_replace("text", PUNCTUATION, "").alias("orig_text"), F.col("text").alias("ref_text"))


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, id, lang, corpus, split, source, target) of every aligned line, however long."""
    pairs = align_lines(essays(spark, sf_dir), ("doc_id", "lang", "corpus", "split"))
    return pairs.withColumn("id", F.concat_ws(":", "doc_id", "line_no"))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the corpus build keeps as samples."""
    return filter_pairs(all_lines(spark, sf_dir))


def full_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with prompts and messages; the id is the line's place, which is unique."""
    lines = line_samples(spark, sf_dir).withColumns({"ref": F.lit("ref1"), "place": F.col("id")})
    return build_samples(lines, keep=("place",)).withColumn("id", F.col("place")).drop("place")


def predictions(lines: DataFrame) -> DataFrame:
    """A stand-in system: commas lost, and one document in seven left as the learner wrote it."""
    made = F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise(F.regexp_replace("target", ",", ""))
    return lines.withColumn("prediction", made)


_STRIP = r"regexp_replace(y, '^\s+|\s+$', '', 'g')"
_CTE = rf"""
WITH essay_lines AS (
  SELECT doc_id, lang, source AS corpus,
         CASE doc_id % 10 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split,
         [x FOR x IN [{_STRIP} FOR y IN string_split(regexp_replace(text, '[.,;:!?]', '', 'g'), chr(10))] IF x <> ''] AS o,
         [x FOR x IN [{_STRIP} FOR y IN string_split(text, chr(10))] IF x <> ''] AS r
  FROM documents),
pairs AS (
  SELECT doc_id, lang, corpus, split,
         unnest(range(1, 1 + least(len(o), len(r)))) AS line_no,
         unnest(o[1:least(len(o), len(r))]) AS source, unnest(r[1:least(len(o), len(r))]) AS target
  FROM essay_lines),
raw_samples AS (
  SELECT *, doc_id::VARCHAR || ':' || line_no::VARCHAR AS id FROM pairs
  WHERE length(source) <= 4096 AND length(target) <= 4096 AND source <> '' AND target <> ''),
samples AS (
  SELECT *, trim(regexp_replace(source, '\s+', ' ', 'g')) AS ns, trim(regexp_replace(target, '\s+', ' ', 'g')) AS nt,
         CASE WHEN doc_id % 7 = 0 THEN source ELSE replace(target, ',', '') END AS prediction
  FROM raw_samples),
scored AS (SELECT *, trim(regexp_replace(prediction, '\s+', ' ', 'g')) AS np FROM samples)
"""
#: The same over every aligned line.
_ALL_CTE = _CTE.replace("length(source) <= 4096 AND length(target) <= 4096 AND ", "")
#: DuckDB's distance counts bytes, so letters beyond ASCII become unused control characters, one for one.
_ODD = "ÄÇÈÉÊÍÑÓÖÜßàáâäçèéêíîñóôöùúûü"
_CODES = range(1, 32)


def _ascii(x: str) -> str:
    return f"translate({x}, '{_ODD}', {' || '.join(f'chr({c})' for c in _CODES[: len(_ODD)])})"


def _lev(a: str, b: str) -> str:
    return f"levenshtein({_ascii(a)}, {_ascii(b)})"


def _similarity(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - {_lev(a, b)}::DOUBLE / greatest(length({a}), length({b})) END)"


def _words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())
_BEFORE, _AFTER = INSTRUCTION.split("{}")
_PROMPT = f"('{_BEFORE}' || (CASE lang {_NAMES} ELSE lang END) || '{_AFTER}' || source)"


# --- text functions ---------------------------------------------------------------------


@_query(r"SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def normalize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over whole documents."""
    t = documents(spark, sf_dir).select("doc_id", normalize_text("text").alias("t"))
    return t.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@_query(r"SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776))), '\s+', ' ', 'g')) AS t FROM documents)")
def normalize_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1's composition: whole documents with some letters taken apart beforehand."""
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    t = documents(spark, sf_dir).select("doc_id", normalize_text(apart).alias("t"))
    return t.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


_MEASURES = f"""
measured AS (
  SELECT *, length(ns) AS sc, length(nt) AS tc, {_words("ns")} AS sw, {_words("nt")} AS tw, {_lev("ns", "nt")} AS ed, {_similarity("ns", "nt")} AS sim FROM samples)
"""


@_query(
    f"""{_ALL_CTE}, {_MEASURES}
SELECT id, sc::BIGINT AS source_chars, tc::BIGINT AS target_chars, sw::BIGINT AS source_words, tw::BIGINT AS target_words,
       ed::BIGINT AS edit_distance, round(sim, 6) AS edit_similarity,
       round(CASE WHEN sc = 0 AND tc = 0 THEN 0.0::DOUBLE WHEN sc = 0 OR tc = 0 THEN 1.0::DOUBLE ELSE ed::DOUBLE / sc END, 6) AS correction_density, ns = nt AS is_identity
FROM measured"""
)
def edit_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3, F13 and A1d for every line."""
    m = analyze.edit_measures(all_lines(spark, sf_dir))
    counts = [F.col(c).cast("long").alias(c) for c in ("source_chars", "target_chars", "source_words", "target_words", "edit_distance")]
    return m.select("id", *counts, F.round("edit_similarity", 6).alias("edit_similarity"), F.round("correction_density", 6).alias("correction_density"), "is_identity")


@_query(
    f"""{_ALL_CTE}
SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest([substr(nt, i, 3) FOR i IN range(1, length(nt) - 1)]) AS gram FROM samples WHERE length(nt) >= 3) GROUP BY ALL"""
)
def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character trigram counts by language."""
    t = all_lines(spark, sf_dir).select("lang", normalize_text("target").alias("t"))
    return analyze.char_ngram_counts(t, "t", 3, ("lang",)).withColumnRenamed("count", "n")


@_query(
    f"""{_ALL_CTE}, tok AS (SELECT lang, string_split(nt, ' ') AS w FROM samples WHERE nt <> '')
SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM tok WHERE len(w) >= 2) GROUP BY ALL"""
)
def word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word bigram counts by language."""
    t = all_lines(spark, sf_dir).select("lang", words(normalize_text("target")).alias("w"))
    return t.select("lang", F.explode(word_ngrams("w", 2)).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))


def _order(n: int) -> str:
    gram = " || ' ' || ".join(f"{{0}}[i + {k}]" if k else "{0}[i]" for k in range(n))
    grams = lambda w: f"[{gram.format(w)} FOR i IN range(1, len({w}) - {n - 2})]"
    return (
        f"SELECT id, {n} AS n, len([g FOR g IN p IF list_contains(r, g)]) AS m, len(p) AS lp, len(r) AS lr FROM "
        f"(SELECT id, {grams('pw')} AS p, {grams('rw')} AS r FROM tok WHERE len(pw) >= {n} AND len(rw) >= {n})"
    )


_GLEU = f"""
tok AS (SELECT id, string_split(np, ' ') AS pw, string_split(nt, ' ') AS rw FROM scored WHERE np <> '' AND nt <> ''),
orders AS ({" UNION ALL ".join(_order(n) for n in range(1, 5))}),
per AS (SELECT id, avg(m::DOUBLE / lp) AS p, avg(m::DOUBLE / lr) AS r FROM orders GROUP BY id),
gleus AS (SELECT s.id, CASE WHEN per.id IS NULL OR p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS gleu FROM scored s LEFT JOIN per ON s.id = per.id)
"""


@_query(f"{_ALL_CTE}, {_GLEU} SELECT id, round(gleu, 6) AS gleu FROM gleus")
def gleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 for every prediction."""
    lines = predictions(all_lines(spark, sf_dir)).select("id", normalize_text("prediction").alias("p"), normalize_text("target").alias("t"))
    return with_gleu(lines, "p", "t").select("id", F.round("gleu", 6).alias("gleu"))


def _chrf(table: str) -> str:
    """chrF of the columns (id, p, r) of a table, both not empty."""
    grams = lambda side: " UNION ALL ".join(
        f"SELECT id, {n} AS n, unnest([substr({side}, i, {n}) FOR i IN range(1, length({side}) - {n - 2})]) AS g FROM {table} WHERE length({side}) >= {n}" for n in range(1, 7)
    )
    return f"""
pg AS (SELECT id, n, g, count(*) AS c FROM ({grams("p")}) GROUP BY ALL),
rg AS (SELECT id, n, g, count(*) AS c FROM ({grams("r")}) GROUP BY ALL),
hits AS (SELECT pg.id, pg.n, sum(least(pg.c, rg.c)) AS h FROM pg JOIN rg ON pg.id = rg.id AND pg.n = rg.n AND pg.g = rg.g GROUP BY ALL),
lens AS (SELECT id, length(p) AS lp, length(r) AS lr, unnest(range(1, 7)) AS n FROM {table}),
means AS (SELECT l.id, avg(coalesce(h, 0)::DOUBLE / (lp - l.n + 1)) AS mp, avg(coalesce(h, 0)::DOUBLE / (lr - l.n + 1)) AS mr
          FROM lens l LEFT JOIN hits ON hits.id = l.id AND hits.n = l.n WHERE l.n <= lp AND l.n <= lr GROUP BY l.id),
chrfs AS (SELECT id, CASE WHEN mp + mr < 1e-12 THEN 0.0::DOUBLE ELSE 2 * mp * mr / (mp + mr) END AS chrf FROM means)
"""


@_query(f"{_ALL_CTE}, t AS (SELECT id, np AS p, nt AS r FROM scored WHERE np <> '' AND nt <> ''), {_chrf('t')} SELECT id, round(chrf, 6) AS chrf FROM chrfs")
def chrf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 for every prediction."""
    lines = predictions(all_lines(spark, sf_dir)).select("id", normalize_text("prediction").alias("p"), normalize_text("target").alias("t"))
    return lines.where("p <> '' AND t <> ''").select("id", F.round(chrf("p", "t"), 6).alias("chrf"))


@_query(f"{_ALL_CTE} SELECT id, round({_similarity('np', 'nt')}, 6) AS similarity, (np = nt)::DOUBLE AS exact_match FROM scored")
def prediction_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 and F8 for every prediction."""
    lines = predictions(all_lines(spark, sf_dir)).select("id", normalize_text("prediction").alias("p"), normalize_text("target").alias("t"))
    return lines.select("id", F.round(edit_distance_similarity("p", "t"), 6).alias("similarity"), (F.col("p") == F.col("t")).cast("double").alias("exact_match"))


_WHOLE = r"""
whole AS (SELECT doc_id::VARCHAR AS id, trim(regexp_replace(regexp_replace(text, '[.,;:!?]', '', 'g'), '\s+', ' ', 'g')) AS np, trim(regexp_replace(text, '\s+', ' ', 'g')) AS nt FROM documents)
"""


@_query(f"WITH {_WHOLE} SELECT id, {_lev('np', 'nt')}::BIGINT AS distance, round({_similarity('np', 'nt')}, 6) AS similarity FROM whole")
def document_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 and F3 of whole essays: every document against itself without punctuation."""
    e = essays(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), normalize_text("orig_text").alias("p"), normalize_text("ref_text").alias("t"))
    e = e.withColumn("distance", edit_distance("p", "t").cast("long"))
    return e.select("id", "distance", F.round(edit_distance_similarity("p", "t", F.col("distance")), 6).alias("similarity"))


@_query(f"WITH {_WHOLE}, scored AS (SELECT * FROM whole), {_GLEU} SELECT id, round(gleu, 6) AS gleu FROM gleus")
def document_gleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 of whole essays: every document against itself without punctuation."""
    e = essays(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), normalize_text("orig_text").alias("p"), normalize_text("ref_text").alias("t"))
    return with_gleu(e, "p", "t").select("id", F.round("gleu", 6).alias("gleu"))


# --- reward -----------------------------------------------------------------------------

_LEAK_SQL = r"(?i)(?:please\s+)?correct\s+(?:all\s+)?(?:the\s+)?grammatical\s+errors?\s+in\s+the\s+following"


def _outputs(lines: DataFrame) -> DataFrame:
    """Generations of every kind: empty, copied, four-fold, with the instruction leaked, and the stand-in system's."""
    kind = F.col("doc_id") % 11
    made = (
        F.when(kind == 0, F.lit(" "))
        .when(kind == 1, F.col("source"))
        .when(kind == 2, F.concat("target", "target", "target", "target"))
        .when(kind == 3, F.concat(F.lit("Correct the grammatical error in the following "), "target"))
        .otherwise(F.col("prediction"))
    )
    return predictions(lines).withColumn("output", made)


_OUTPUTS = rf"""
outputs AS (
  SELECT *, trim(regexp_replace(output, '\s+', ' ', 'g')) AS no FROM (
    SELECT *, CASE doc_id % 11 WHEN 0 THEN ' ' WHEN 1 THEN source WHEN 2 THEN target || target || target || target
                WHEN 3 THEN 'Correct the grammatical error in the following ' || target ELSE prediction END AS output FROM scored)),
gated AS (SELECT *, no <> '' AND (ns = '' OR length(no)::DOUBLE / length(ns) BETWEEN 0.3::DOUBLE AND 3.0::DOUBLE) AND NOT regexp_matches(no, '{_LEAK_SQL}') AS passed FROM outputs)
"""


@_query(f"{_ALL_CTE}, {_OUTPUTS} SELECT id, passed FROM gated")
def format_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 and F12 for every generation."""
    lines = _outputs(all_lines(spark, sf_dir)).select("id", normalize_text("output").alias("o"), normalize_text("source").alias("s"))
    return lines.select("id", format_gate("o", "s").alias("passed"))


@_query(
    """SELECT p AS progress, round(0.5 - 0.25 / (1 + exp(-8.0 * (p - 0.5))), 9)::DOUBLE AS w_preserve, round(0.5 + 0.25 / (1 + exp(-8.0 * (p - 0.5))), 9)::DOUBLE AS w_correct
FROM (SELECT DISTINCT (doc_id % 101)::DOUBLE / 100 AS p FROM documents)"""
)
def reward_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 and F10 over a grid of progress."""
    grid = documents(spark, sf_dir).select(((F.col("doc_id") % 101).cast("double") / 100).alias("progress")).distinct()
    preserve, correct = weights(F.col("progress"))
    return grid.select("progress", F.round(preserve, 9).alias("w_preserve"), F.round(correct, 9).alias("w_correct"))


_SHIFT = "(0.25 / (1 + exp(4.0::DOUBLE)))"
_SCORES = f"""
t AS (SELECT id, no AS p, nt AS r FROM gated WHERE passed AND no <> nt), {_chrf("t")},
scores AS (
  SELECT g.*, CASE WHEN NOT passed THEN -1.0::DOUBLE WHEN no = nt THEN 1.0::DOUBLE
              ELSE (0.5 - {_SHIFT}) * (CASE WHEN ns = '' THEN 0.5::DOUBLE ELSE {_similarity("no", "ns")} END) + (0.5 + {_SHIFT}) * coalesce(chrf, 0.0) END AS score
  FROM gated g LEFT JOIN chrfs ON chrfs.id = g.id)
"""


@_query(f"{_ALL_CTE}, {_OUTPUTS}, {_SCORES} SELECT id, round(score, 6) AS score FROM scores")
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 for every generation at progress 0."""
    return with_score(_outputs(all_lines(spark, sf_dir)), "output", "target", "source").select("id", F.round("score", 6).alias("score"))


@_query(f"{_ALL_CTE}, {_OUTPUTS}, {_SCORES} SELECT id, round(score, 6) AS score FROM scores")
def rewards_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 for every generation through the SQL function, by the arguments that trainers pass."""
    register(spark)
    outputs = _outputs(all_lines(spark, sf_dir)).select("id", F.concat(F.lit(DATA_SOURCE_PREFIX), "lang").alias("data_source"), "output", "target", "source")
    return spark.sql("SELECT id, round(compute_score(data_source, output, target, named_struct('source', source)), 6) AS score FROM {outputs}", outputs=outputs)


@_query(
    f"""{_CTE}, open AS (SELECT id, lang, doc_id * 1000000 + line_no AS seq, {_similarity("np", "nt")} AS score FROM scored WHERE np <> nt),
runs AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd FROM open WINDOW w AS (PARTITION BY lang ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT id, lang, seq, round(CASE WHEN n < 30 THEN score ELSE (score - mean) / greatest(sd, 1e-6) END, 4) AS normalized FROM runs"""
)
def running_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 over the similarity of predictions that are no exact match, in document order."""
    lines = predictions(line_samples(spark, sf_dir)).select("id", "lang", "doc_id", "line_no", normalize_text("prediction").alias("p"), normalize_text("target").alias("t"))
    open_ = lines.where("p <> t").select("id", "lang", (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("seq"), edit_distance_similarity("p", "t").alias("score"))
    done = evaluate.running_normalization(open_)
    return done.select("id", "lang", "seq", F.round("normalized", 4).alias("normalized"))


_LATER = "doc_id * 2 > (SELECT max(doc_id) FROM documents)"
_STREAMED = _SCORES.replace(_SHIFT, f"(0.25 / (1 + exp(-8.0::DOUBLE * ((CASE WHEN {_LATER} THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END) - 0.5::DOUBLE))))")


@_query(
    f"""{_ALL_CTE}, {_OUTPUTS}, {_STREAMED}, open AS (SELECT lang, doc_id * 1000000 + line_no AS seq, score FROM scores WHERE passed AND no <> nt),
runs AS (SELECT *, count(*) OVER w AS n, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS sd FROM open WINDOW w AS (PARTITION BY lang ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT lang, seq, round(score, 6) AS score, round(CASE WHEN n < 30 THEN score ELSE (score - mean) / greatest(sd, 1e-6) END, 4) AS normalized FROM runs"""
)
def streamed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, S13, F11 and W1 as streams: generations scored at the progress of the moment and normalised, both queries restarted once from their checkpoints."""
    path = scratch_path(spark, "streams")
    seq = F.col("doc_id") * 1_000_000 + F.col("line_no")
    outputs = _outputs(all_lines(spark, sf_dir)).select("doc_id", "lang", seq.alias("seq"), "output", "target", "source")
    half = documents(spark, sf_dir).agg(F.max("doc_id") / 2).first()[0] or 0
    incoming = spark.readStream.schema("lang string, seq long, output string, target string, source string")
    for step, some in ((0, F.col("doc_id") <= half), (60, F.col("doc_id") > half)):
        outputs.where(some).drop("doc_id").write.mode("append").parquet(f"{path}/outputs")
        files.write_progress(f"{path}/progress.json", step, 100, spark)
        normalizer.score_stream(incoming.parquet(f"{path}/outputs"), f"{path}/progress.json", f"{path}/scores", f"{path}/scoring").awaitTermination()
        normalizer.normalize_files(spark, f"{path}/scores", f"{path}/normalized", f"{path}/normalizing").awaitTermination()
    found = spark.read.schema(f"{normalizer.SCORES}, normalized double").parquet(f"{path}/normalized")
    return found.select("lang", "seq", F.round("score", 6).alias("score"), F.round("normalized", 4).alias("normalized"))


@_query("SELECT DISTINCT lang || '_' || source AS data_source, lang || '_' || source AS lang FROM documents UNION SELECT DISTINCT '" + DATA_SOURCE_PREFIX + "' || lang, lang FROM documents")
def data_source_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12 over prefixed and other names."""
    docs = documents(spark, sf_dir)
    names = docs.select(F.concat(F.lit(DATA_SOURCE_PREFIX), "lang").alias("data_source")).union(docs.select(F.concat_ws("_", "lang", "corpus"))).distinct()
    return names.select("data_source", language_of("data_source").alias("lang"))


# --- profiles and evaluation ------------------------------------------------------------

_RATES = ("identity_ratio", "avg_source_len_char", "avg_target_len_char", "avg_source_len_word", "avg_target_len_word", "avg_edit_distance", "avg_edit_similarity", "error_rate", "avg_correction_density")


def _stats_sql(table: str, name: str) -> str:
    """Language statistics of a table with ns, nt, id, lang."""
    return f"""
{name}_m AS (SELECT id, lang, length(ns) AS sc, length(nt) AS tc, {_words("ns")} AS sw, {_words("nt")} AS tw, {_lev("ns", "nt")} AS ed, {_similarity("ns", "nt")} AS sim, ns = nt AS same FROM {table}),
{name} AS (
  SELECT coalesce(lang, '__overall__') AS lang, count(*) AS n_samples, count(*) FILTER (same) AS n_identity,
         count(*) FILTER (id LIKE '%\\_aug' ESCAPE '\\') AS n_augmented, count(*) FILTER (id LIKE '%\\_id' ESCAPE '\\') AS n_identity_injected,
         round((count(*) FILTER (same))::DOUBLE / count(*), 6) AS identity_ratio,
         round(avg(sc), 6) AS avg_source_len_char, round(avg(tc), 6) AS avg_target_len_char, round(avg(sw), 6) AS avg_source_len_word, round(avg(tw), 6) AS avg_target_len_word,
         round(avg(ed), 6) AS avg_edit_distance, round(avg(sim), 6) AS avg_edit_similarity, round(1 - avg(sim), 6) AS error_rate,
         round(avg(CASE WHEN sc = 0 AND tc = 0 THEN 0.0::DOUBLE WHEN sc = 0 OR tc = 0 THEN 1.0::DOUBLE ELSE ed::DOUBLE / sc END), 6) AS avg_correction_density
  FROM {name}_m GROUP BY GROUPING SETS ((lang), ()))
"""


@_query(f"{_CTE}, {_stats_sql('samples', 'stats')} SELECT * FROM stats")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the profile by language with the overall row."""
    stats = analyze.language_stats(line_samples(spark, sf_dir))
    return stats.select(*(F.round(c, 6).alias(c) if c in _RATES else c for c in stats.columns))


def _first(table: str, ratio: float, tag: str, columns: str = "*") -> str:
    """The first int(n * ratio) rows by hash rank."""
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY md5(id || '|42|{tag}'), id) AS k, count(*) OVER () AS n FROM {table}) WHERE k <= floor(n::DOUBLE * {ratio}::DOUBLE)"
    )


_IDENTITY = f"identity AS ({_first('samples', 0.07, 'identity')})"


@_query(f"{_CTE}, {_IDENTITY} SELECT id || '_id' AS id, lang, target AS source, target FROM identity")
def identity_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: a share of the samples with the target as source."""
    return sampling.inject_identity(full_samples(spark, sf_dir), 0.07).select("id", "lang", "source", "target")


def _draw(first: int, digits: int, step: str = "step + 1") -> str:
    """A whole number from hexadecimal digits of the MD5 of a row's key and a step's number."""
    return f"('0x' || substr(md5(id || '|42|' || ({step})::VARCHAR), {first}, {digits}))::BIGINT"


def _cut(x: str, first: str, last: str) -> str:
    return f"substr({x}, {first}, greatest({last} - ({first}) + 1, 0))"


_UPPER = "(CASE WHEN own = 'ß' THEN 'SS' ELSE upper(own) END)"


#: The place a step takes, and what it is found by: all the places it might take or, for long texts, the parts between them.
_BY_PLACES = (
    "CASE WHEN len(places) > 0 THEN places[at_random % len(places) + 1] END",
    r"CASE kind WHEN 0 THEN [] ELSE [i FOR i IN range(1, size + 1) IF CASE kind WHEN 1 THEN substr(t, i, 1) = ' ' WHEN 2 THEN regexp_full_match(substr(t, i, 1), '\p{L}') ELSE contains('.,;:!?', substr(t, i, 1)) END] END AS places",
)
_MASKS = " ".join(f"WHEN {k} THEN regexp_replace(regexp_replace(t, '[^{c}]', '0', 'g'), '[{c}]', '1', 'g')" for k, c in ((1, " "), (2, r"\p{L}"), (3, ".,;:!?")))
_BY_PARTS = (
    "CASE WHEN len(parts) > 1 THEN length(array_to_string(parts[1:at_random % (len(parts) - 1) + 1], '1')) + 1 END",
    f"CASE kind WHEN 0 THEN [] ELSE string_split(CASE kind {_MASKS} END, '1') END AS parts",
)


def _spelled(rows: str, rate: float, found: tuple[str, str] = _BY_PLACES) -> str:
    """Synthetic errors in characters, step by step: rows (id, step, n, t) from those (id, target) of a table."""
    return rf"""
spelled AS (
  SELECT id, 0 AS step, greatest(1, floor(length(target)::DOUBLE * {rate}::DOUBLE))::INT AS n, target AS t FROM {rows}
  UNION ALL
  SELECT id, step + 1, n, CASE
      WHEN size < 3 THEN t
      WHEN kind = 0 THEN CASE WHEN regexp_full_match(substr(t, pair, 2), '\p{{L}}\p{{L}}') THEN {_cut("t", "1", "pair - 1")} || substr(t, pair + 1, 1) || substr(t, pair, 1) || {_cut("t", "pair + 2", "size")} ELSE t END
      WHEN place IS NULL THEN t
      ELSE {_cut("t", "1", "place - 1")} || (CASE WHEN kind <> 2 THEN '' WHEN own = {_UPPER} THEN lower(own) ELSE {_UPPER} END) || {_cut("t", "place + 1", "size")} END
  FROM (SELECT *, substr(t, place, 1) AS own FROM (
    SELECT *, {found[0]} AS place, at_random % greatest(size - 1, 1) + 1 AS pair FROM (
      SELECT *, {found[1]} FROM (
        SELECT *, length(t) AS size, {_draw(1, 7)} % 4 AS kind, {_draw(8, 13)} AS at_random FROM spelled WHERE step < n)))))"""


_NOISE = rf"""
chosen AS ({_first("samples", 0.15, "noise", "id, doc_id, lang, source, target")}),
coins AS (SELECT id, target, {_draw(1, 1, "0")} < 8 AS by_characters, [x FOR x IN string_split_regex(target, '\s+') IF x <> ''] AS w FROM chosen),
{_spelled("coins WHERE by_characters", 0.05)},
worded AS (
  SELECT id, 0 AS step, greatest(1, floor(len(w)::DOUBLE * 0.05::DOUBLE))::INT AS n, w FROM coins WHERE NOT by_characters AND len(w) > 1
  UNION ALL
  SELECT id, step + 1, n, CASE
      WHEN size < 2 THEN w
      WHEN kind = 0 THEN w[1:place - 1] || w[place + 1:]
      WHEN kind = 1 THEN w[1:place] || w[place:]
      ELSE w[1:place - 1] || [w[place + 1], w[place]] || w[place + 2:] END
  FROM (SELECT *, at_random % greatest(CASE kind WHEN 2 THEN size - 1 ELSE size END, 1) + 1 AS place FROM (
    SELECT *, len(w) AS size, {_draw(1, 7)} % 3 AS kind, {_draw(8, 13)} AS at_random FROM worded WHERE step < n))),
noised AS (
  SELECT id, t FROM spelled WHERE step = n UNION ALL SELECT id, array_to_string(w, ' ') FROM worded WHERE step = n
  UNION ALL SELECT id, target FROM coins WHERE NOT by_characters AND len(w) < 2)
"""
_RECURSIVE = _CTE.replace("WITH essay_lines", "WITH RECURSIVE essay_lines", 1)


@_query(f"{_RECURSIVE}, {_NOISE} SELECT c.id || '_aug' AS id, c.lang, t AS source, c.target, md5({_PROMPT} || chr(10) || chr(10) || t) AS prompt_md5 FROM chosen c JOIN noised n ON c.id = n.id")
def noise_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the samples with synthetic errors."""
    return sampling.noisy_samples(full_samples(spark, sf_dir), 0.15).select("id", "lang", "source", "target", F.md5("prompt").alias("prompt_md5"))


@_query(f"WITH RECURSIVE whole AS (SELECT doc_id::VARCHAR AS id, text AS target FROM documents), {_spelled('whole', 0.002, _BY_PARTS)} SELECT id, md5(t) AS noised_md5, length(t)::BIGINT AS n_chars FROM spelled WHERE step = n")
def document_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14 and F16 over whole documents."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text")
    noised = docs.select("id", add_synthetic_noise("text", F.concat("id", F.lit("|42")), 0.002).alias("t"))
    return noised.select("id", F.md5("t").alias("noised_md5"), F.length("t").cast("long").alias("n_chars"))


@_query(
    f"""{_CTE}, {_IDENTITY}, {_stats_sql("samples", "b")},
changed AS (SELECT id, lang, ns, nt FROM samples UNION ALL SELECT id || '_id', lang, nt, nt FROM identity), {_stats_sql("changed", "a")}
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(b.n_samples, 0) AS n_before, coalesce(a.n_samples, 0) AS n_after, coalesce(a.n_samples, 0) - coalesce(b.n_samples, 0) AS n_delta,
       coalesce(a.n_identity_injected, 0) AS injected, round(coalesce(b.identity_ratio, 0), 5) AS identity_before, round(coalesce(a.identity_ratio, 0), 5) AS identity_after,
       round(coalesce(a.error_rate, 0), 5) AS error_after
FROM a FULL JOIN b ON a.lang = b.lang"""
)
def stats_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles before and after identity injection."""
    base = full_samples(spark, sf_dir)
    return _compared(analyze.compare_growth(base, sampling.inject_identity(base, 0.07)))


def _compared(c: DataFrame) -> DataFrame:
    rate = lambda side, m, name: F.round(F.round(F.col(f"{side}.{m}"), 6), 5).alias(name)
    return c.select(
        "lang", F.col("before.n_samples").alias("n_before"), F.col("after.n_samples").alias("n_after"), F.col("delta.n_samples").alias("n_delta"),
        F.col("after.n_identity_injected").alias("injected"), rate("before", "identity_ratio", "identity_before"), rate("after", "identity_ratio", "identity_after"), rate("after", "error_rate", "error_after"),
    )


@_query(
    f"""{_CTE}, b_in AS (SELECT * FROM samples WHERE lang <> 'fr'), a_in AS (SELECT * FROM samples WHERE lang <> 'de'), {_stats_sql("b_in", "b")}, {_stats_sql("a_in", "a")}
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(b.n_samples, 0) AS n_before, coalesce(a.n_samples, 0) AS n_after, coalesce(a.n_samples, 0) - coalesce(b.n_samples, 0) AS n_delta,
       coalesce(a.n_identity_injected, 0) AS injected, round(coalesce(b.identity_ratio, 0), 5) AS identity_before, round(coalesce(a.identity_ratio, 0), 5) AS identity_after,
       round(coalesce(a.error_rate, 0), 5) AS error_after
FROM a FULL JOIN b ON a.lang = b.lang"""
)
def stats_comparison_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of two sets of samples, each of which lacks a language of the other."""
    lines = line_samples(spark, sf_dir)
    return _compared(analyze.compare_stats(*(analyze.language_stats(lines.where(F.col("lang") != other)) for other in ("fr", "de"))))


@_query(f"{_CTE} SELECT lang, count(*) AS n FROM samples GROUP BY lang")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return analyze.language_histogram(line_samples(spark, sf_dir))


@_query(f"{_CTE} SELECT lang, corpus, split, count(*) AS n FROM samples GROUP BY GROUPING SETS ((lang, corpus, split), (lang, corpus), (split), ())")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: samples by corpus and split with totals."""
    return analyze.corpus_counts(line_samples(spark, sf_dir))


_EVALUATED = f"""
matched AS (SELECT s.*, g.gleu, {_similarity("np", "nt")} AS eds FROM scored s JOIN gleus g ON s.id = g.id WHERE s.doc_id % 5 <> 4)
"""


@_query(
    f"""{_CTE}, {_GLEU}, {_EVALUATED}
SELECT lang, NULL::BIGINT AS n_predictions, count(*) AS n_matched, round(avg((np = nt)::INT), 6) AS exact_match, round(avg(eds), 6) AS edit_distance_similarity, round(avg(gleu), 6) AS gleu FROM matched GROUP BY lang
UNION ALL
SELECT '__overall__', (SELECT count(*) FROM scored), count(*), round(avg((np = nt)::INT), 6), round(avg(eds), 6), round(avg(gleu), 6) FROM matched"""
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against references, a fifth of which is missing and each of which has a stale copy."""
    lines = predictions(line_samples(spark, sf_dir))
    present = lines.where(F.col("doc_id") % 5 != 4)
    stale = present.select("id", F.lit("stale").alias("target"), "lang", F.lit(0).alias("seq"))
    refs = stale.unionByName(present.select("id", "target", "lang", F.lit(1).alias("seq")))
    e = evaluate.evaluate(lines, refs, "seq")
    return e.select("lang", "n_predictions", "n_matched", *(F.round(c, 6).alias(c) for c in ("exact_match", "edit_distance_similarity", "gleu")))


@_query(
    f"""{_CTE}, {_GLEU}, {_EVALUATED}
SELECT lang, count(*) AS n, round(avg((np = nt)::INT), 6) AS exact_match, round(avg(eds), 6) AS edit_distance_similarity, round(avg(gleu), 6) AS gleu FROM matched GROUP BY lang
UNION ALL
SELECT '__overall__', count(*), round(avg((np = nt)::INT), 6), round(avg(eds), 6), round(avg(gleu), 6) FROM matched"""
)
def evaluation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files against reference files, where only the last line of an id's last file holds; the report as it was written."""
    path = scratch_path(spark, "evaluation")
    lines = predictions(line_samples(spark, sf_dir))
    files.write_jsonl(lines.select("id", "lang", "source", "prediction"), f"{path}/predictions")
    present = lines.where(F.col("doc_id") % 5 != 4)
    reference = lambda target: F.struct("id", target.alias("target"), "source", "lang")
    files.write_jsonl(present.select(reference(F.lit("stale")).alias("r")).select("r.*"), f"{path}/references/1")
    twice = present.select(F.explode(F.array(reference(F.lit("stale too")), reference(F.col("target")))).alias("r")).select("r.*")
    files.write_jsonl(twice, f"{path}/references/2")
    pipelines.evaluate_files(spark, f"{path}/predictions", [f"{path}/references/2", f"{path}/references/1"], f"{path}/report.json")
    rates = "exact_match double, edit_distance_similarity double, gleu double"
    schema = f"overall struct<n_matched: long, {rates.replace(' ', ': ')}>, per_language map<string, struct<n: long, {rates.replace(' ', ': ')}>>".replace(",: ", ", ")
    found = spark.read.text(f"{path}/report.json", wholetext=True).select(F.from_json("value", schema).alias("r")).select("r.*")
    rounded = lambda side: [F.round(f"{side}.{c}", 6).alias(c) for c in ("exact_match", "edit_distance_similarity", "gleu")]
    own = found.select(F.explode("per_language").alias("lang", "m")).select("lang", "m.n", *rounded("m"))
    return own.unionByName(found.select(F.lit("__overall__").alias("lang"), F.col("overall.n_matched").alias("n"), *rounded("overall")))


_SHOWN = " UNION ALL ".join(
    f"SELECT a.lang, {i} AS k, '{m}' AS metric, {shown('coalesce(b.' + m + ', 0)')} AS before, {shown('coalesce(a.' + m + ', 0)')} AS after, {shown(delta)} AS delta FROM a LEFT JOIN b ON a.lang = b.lang WHERE {delta} <> 0"
    for i, m in enumerate(analyze.METRICS)
    for delta in [f"(coalesce(a.{m}, 0) - coalesce(b.{m}, 0))"]
    for shown in [(lambda x: f"({x})::VARCHAR") if m.startswith("n_") else (lambda x: f"printf('%.4f', {x}::DOUBLE)")]
)


@_query(
    f"""{_CTE}, {_IDENTITY}, {_stats_sql("samples", "b").replace(", 6)", ", 15)")},
changed AS (SELECT id, lang, ns, nt FROM samples UNION ALL SELECT id || '_id', lang, nt, nt FROM identity), {_stats_sql("changed", "a").replace(", 6)", ", 15)")},
shown AS ({_SHOWN})
SELECT row_number() OVER (ORDER BY lang = '__overall__', lang, k) AS line, lang, metric, before, after, delta FROM shown"""
)
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed lines of a comparison of two sample files, in their order."""
    path = scratch_path(spark, "comparison")
    base = full_samples(spark, sf_dir)
    files.write_jsonl(base, f"{path}/before", CODEC)
    stored = files.read_jsonl(spark, f"{path}/before", SAMPLE)
    files.write_jsonl(stored.unionByName(sampling.inject_identity(stored, 0.07)), f"{path}/after", CODEC)
    text = pipelines.analyze_files(spark, f"{path}/before", f"{path}/after", f"{path}/report.json")
    files.write_small(spark, f"{path}/report.txt", text)
    printed = spark.read.text(f"{path}/report.txt", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where("line > 0")
    cells = F.split("value", " +")
    names = ("lang", "metric", "before", "after", "delta")
    return printed.select(F.col("line").cast("long").alias("line"), *(cells[i].alias(c) for i, c in enumerate(names)))


# --- sample building --------------------------------------------------------------------

_UID = "substr(md5(lang || ':' || corpus || ':' || substr(source, 1, 200) || ':ref1'), 1, 12)"


@_query(f"{_CTE} SELECT {_UID} AS id, lang, corpus, split, 'ref1' AS ref, md5({_PROMPT}) AS prompt_md5, md5({_PROMPT}) AS user_md5, 'user' AS first_role, md5(target) AS assistant_md5, 'assistant' AS second_role FROM samples")
def sample_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, prompts and messages of every sample."""
    s = build_samples(line_samples(spark, sf_dir).withColumn("ref", F.lit("ref1")))
    first, second = F.element_at("messages", 1), F.element_at("messages", 2)
    return s.select(
        "id", "lang", "corpus", "split", "ref", F.md5("prompt").alias("prompt_md5"), F.md5(first["content"]).alias("user_md5"), first["role"].alias("first_role"),
        F.md5(second["content"]).alias("assistant_md5"), second["role"].alias("second_role"),
    )


@_query(f"{_CTE} SELECT doc_id, line_no, source, target FROM samples")
def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, F18, P1 and P2."""
    return line_samples(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "source", "target")


@_query(
    r"""SELECT doc_id, ref, md5(source) AS source_md5, md5(target) AS target_md5 FROM (
  SELECT doc_id, 'ref1' AS ref, regexp_replace(regexp_replace(text, '[.,;:!?]', '', 'g'), '^\s+|\s+$', '', 'g') AS source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS target FROM documents
  UNION ALL SELECT doc_id, 'ref2', regexp_replace(regexp_replace(text, '[.,;:!?]', '', 'g'), '^\s+|\s+$', '', 'g'), regexp_replace(replace(text, '.', ' .'), '^\s+|\s+$', '', 'g') FROM documents WHERE doc_id % 3 = 0)
WHERE source <> '' AND target <> ''"""
)
def essay_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole essays against one or two references."""
    e = essays(spark, sf_dir).withColumn("essay_id", F.col("doc_id").cast("string"))
    keys = ("corpus", "split", "essay_id")
    refs = e.select(*keys, F.lit("ref1").alias("ref"), "ref_text").unionByName(
        e.where("doc_id % 3 = 0").select(*keys, F.lit("ref2").alias("ref"), F.regexp_replace("ref_text", r"\.", " .").alias("ref_text"))
    )
    pairs = align_documents(align_essays(e.select(*keys, "orig_text"), refs, keys), ("essay_id", "ref"))
    return pairs.select(F.col("essay_id").cast("long").alias("doc_id"), "ref", F.md5("source").alias("source_md5"), F.md5("target").alias("target_md5"))


@_query(
    r"""SELECT doc_id, 'A' AS essay_id, md5(source) AS text_md5 FROM documents
UNION ALL SELECT doc_id, 'B b', md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) FROM documents"""
)
def essay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 over a Markdown file made of each document: leading text, a repeated id, blank lines, a padded header."""
    docs = documents(spark, sf_dir)
    body = F.concat(F.lit("# intro\n\n### essay_id = A\n"), "lang", F.lit("\n###  essay_id=  B b \r\n\n"), "text", F.lit("\n\n### essay_id = A\n\n"), "corpus", F.lit("\n"))
    found = parse_essays(docs.select("doc_id", body.alias("value")), keep=("doc_id",))
    return found.select("doc_id", "essay_id", F.md5("text").alias("text_md5"))


@_query(
    f"""{_CTE}, p AS (SELECT id, lang, target, CASE WHEN doc_id % 2 = 0 THEN 'Fix this.' || chr(10) || chr(10) || lang || chr(10) || chr(10) || source ELSE 'Fix: ' || source END AS prompt FROM samples)
SELECT id, regexp_replace(prompt, '^(.*)\\n\\n.*$', '\\1', 's') || chr(10) || chr(10) || target AS prompt FROM p"""
)
def prompt_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 over prompts with and without a blank line."""
    s = line_samples(spark, sf_dir)
    prompt = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Fix this.\n\n"), "lang", F.lit("\n\n"), "source")).otherwise(F.concat(F.lit("Fix: "), "source"))
    return s.withColumn("prompt", prompt).select("id", rewrite_prompt("prompt", "target").alias("prompt"))


@_query("SELECT DISTINCT lang, CASE lang " + _NAMES + f" ELSE lang END AS lang_name, md5('{_BEFORE}' || (CASE lang {_NAMES} ELSE lang END) || '{_AFTER}' || 'x') AS prompt_md5 FROM documents")
def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 and P4 for every language."""
    from glossmill.operators.samples import language_name

    langs = documents(spark, sf_dir).select("lang").distinct()
    return langs.select("lang", language_name("lang").alias("lang_name"), F.md5(instruction(F.lit("x"), "lang")).alias("prompt_md5"))


@_query(f"{_CTE}, {_IDENTITY}, every AS (SELECT id FROM samples UNION ALL SELECT id || '_id' FROM identity UNION ALL SELECT id || '_aug' FROM samples WHERE doc_id % 4 = 0) SELECT id LIKE '%\\_aug' ESCAPE '\\' AS augmented, id LIKE '%\\_id' ESCAPE '\\' AS injected, count(*) AS n FROM every GROUP BY ALL")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a bag union by provenance."""
    base = full_samples(spark, sf_dir)
    lines = line_samples(spark, sf_dir)
    tagged = lines.where("doc_id % 4 = 0").select(F.concat("id", F.lit("_aug")).alias("id"))
    every = base.select("id").union(sampling.inject_identity(base, 0.07).select("id")).union(tagged)
    return every.groupBy(is_augmented("id").alias("augmented"), is_identity_injected("id").alias("injected")).agg(F.count("*").alias("n"))


# --- balancing --------------------------------------------------------------------------


def _balance_sql(target: str, before: str = _CTE, table: str = "samples", columns: str = "id") -> str:
    return f"""{before},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(id || '|42|balance'), id) AS k FROM {table}),
sizes AS (SELECT lang, count(*) AS n FROM {table} GROUP BY lang),
goals AS (SELECT lang, n, {target}::BIGINT AS goal FROM sizes),
drawn AS (SELECT lang, n, unnest(range(1, goal - n + 1)) AS draw FROM goals WHERE goal > n),
places AS (SELECT lang, draw, ('0x' || substr(md5(lang || '|' || draw::VARCHAR || '|42'), 1, 15))::BIGINT % n + 1 AS k FROM drawn)
SELECT {columns}, r.lang, 0::BIGINT AS draw FROM ranked r JOIN goals g ON r.lang = g.lang WHERE k <= goal
UNION ALL SELECT {columns}, r.lang, draw FROM places p JOIN ranked r ON p.lang = r.lang AND p.k = r.k"""


def _balanced(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return sampling.balance(line_samples(spark, sf_dir), **settings).select("id", "lang", "draw")


@_query(_balance_sql("3000"))
def balance_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M7, M8."""
    return _balanced(spark, sf_dir, target_per_lang=3000)


@_query(_balance_sql("floor((sum(n) OVER ())::DOUBLE / (count(*) OVER ()))"))
def balance_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M7, M8."""
    return _balanced(spark, sf_dir, strategy="uniform")


_SQRT = "floor((sum(n) OVER ())::DOUBLE * sqrt(n) / (sum(sqrt(n)) OVER ()))"


@_query(_balance_sql(_SQRT))
def balance_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M7, M8, A7."""
    return _balanced(spark, sf_dir, strategy="sqrt")


@_query(_balance_sql("floor((sum(n) OVER ())::DOUBLE * ln(n + 1) / (sum(ln(n + 1)) OVER ()))"))
def balance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M7, M8, A7."""
    return _balanced(spark, sf_dir, strategy="log")


_EVERY = f"""{_RECURSIVE}, {_IDENTITY}, {_NOISE},
every AS (SELECT id, lang, source, target FROM samples UNION ALL SELECT id || '_id', lang, target, target FROM identity
          UNION ALL SELECT c.id || '_aug', lang, t, target FROM chosen c JOIN noised n ON c.id = n.id)"""


@_query(_balance_sql(_SQRT, _EVERY, "every", "id, source, target"))
def augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and noisy samples, balanced by square root."""
    return pipelines.augment(full_samples(spark, sf_dir), "sft").select("id", "lang", "source", "target", "draw")


# --- exports ----------------------------------------------------------------------------


@_query(f"{_CTE} SELECT id, lang, 2::BIGINT AS n_messages, md5({_PROMPT}) AS user_md5, md5(target) AS assistant_md5 FROM samples")
def sft_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, flattened."""
    r = sft_records(full_samples(spark, sf_dir))
    m = lambda i: F.md5(F.element_at("messages", i)["content"])
    return r.select("id", "lang", F.size("messages").cast("long").alias("n_messages"), m(1).alias("user_md5"), m(2).alias("assistant_md5"))


def _rl_sql(source: str, split: str) -> str:
    return f"""{_CTE} SELECT {source} AS data_source, md5({_PROMPT}) AS prompt_md5, 'user' AS role, 'grammar_correction' AS ability, 'rule' AS style, target AS ground_truth,
       id, lang, corpus, source, {split} AS split FROM samples"""


def _rl(records: DataFrame, split: F.Column) -> DataFrame:
    p = F.element_at("prompt", 1)
    return records.select(
        "data_source", F.md5(p["content"]).alias("prompt_md5"), p["role"].alias("role"), "ability", "reward_model.style", "reward_model.ground_truth",
        "extra_info.id", "extra_info.lang", "extra_info.corpus", "extra_info.source", split.alias("split"),
    )


@_query(_rl_sql(f"'{DATA_SOURCE_PREFIX}' || lang", "NULL::VARCHAR"))
def rl_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, flattened."""
    return _rl(rl_records(full_samples(spark, sf_dir)), F.lit(None).cast("string"))


@_query(_rl_sql(f"'{DATA_SOURCE_PREFIX}' || lang || '_' || corpus", "split"))
def rl_export_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, flattened."""
    return _rl(rl_records(full_samples(spark, sf_dir), with_split=True), F.col("extra_info.split"))


@_query(
    f"""{_ALL_CTE}, tok AS (SELECT id, doc_id, [length(w) FOR w IN string_split(nt, ' ')] AS t FROM samples)
SELECT id, len(t) <= 12 AS fits, array_to_string(t[1:8], ' ') AS cut, array_to_string([CASE WHEN i <= doc_id % 5 THEN -100 ELSE t[i] END FOR i IN range(1, len(t) + 1)], ' ') AS labels FROM tok"""
)
def token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, P14 and F20 with word lengths for token ids."""
    t = all_lines(spark, sf_dir).select("id", "doc_id", F.transform(words(normalize_text("target")), F.length).alias("t"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return t.select("id", fits("t", 12).alias("fits"), text(truncate("t", 8)).alias("cut"), text(masked_labels("t", F.col("doc_id") % 5)).alias("labels"))


# --- files, order, generation -----------------------------------------------------------

#: Documents of one corpus at most, in the folder tree made of them.
CORPUS_DOCS = 5000
#: Samples hold a sentence five times and their instruction twice, so their lines are stored compressed; a file is one task's, so none is read by fewer tasks than wrote it.
CODEC = "gzip"
#: Essay files are read in splits of few essays, and in at most so many.
SPLIT_BYTES, SPLITS_AT_MOST = 64 << 10, 1000
_TREE_SETTINGS = "max_source_len: 1500\nmax_target_len: 1250\n"


def write_corpora(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A tree of corpora as their authors leave them: a folder each with metadata and essay files.

    Documents of a language are some corpora.  Learners' texts lack punctuation; every third
    essay has a second reference.  Files have leading text, stale essays that later ones
    replace, headings inside essays, and in French two-character line ends.
    """
    remark = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\n### remark "), "lang", F.lit("\n###"))).otherwise(F.lit(""))
    docs = documents(spark, sf_dir).withColumns({"dir": F.concat_ws("-", F.lit("learners"), "lang", F.floor(F.col("doc_id") / CORPUS_DOCS).cast("string")), "split": split_by_id(), "remark": remark})
    header = F.concat(F.lit("### essay_id = "), F.col("doc_id").cast("string"), F.lit("\n"))
    stale = F.when(F.col("doc_id") % 4 == 0, F.concat(header, F.lit("stale\n"))).otherwise(F.lit(""))
    kinds = {"orig": F.regexp_replace("text", PUNCTUATION, ""), "ref1": F.col("text"), "ref2": F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"\.", " ."))}
    rows = docs.select("doc_id", "dir", "lang", "split", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(stale, header, t, "remark").alias("value")) for k, t in kinds.items()))).alias("e"))
    rows = rows.select("doc_id", "dir", "lang", F.concat_ws("-", "lang", "e.kind", "split").alias("file"), F.col("e.value").alias("value")).where("value IS NOT NULL")
    rows = rows.withColumn("value", F.when(F.col("lang") == "fr", F.replace("value", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("value")))
    first = rows.select("dir", "file").distinct().select(F.lit(-1).cast("long").alias("doc_id"), "dir", F.lit("").alias("lang"), "file", F.lit("# a corpus\nnot an essay").alias("value"))
    every = rows.unionByName(first).repartition("dir", "file").sortWithinPartitions("dir", "file", "doc_id")
    every.select("dir", "file", "value").write.partitionBy("dir", "file").text(f"{folder}/.raw")
    # Files get the names that corpora have; there are some for each corpus, none of them read here.
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for corpus in system.listStatus(path(f"{folder}/.raw")):
        name = corpus.getPath().getName().removeprefix("dir=")
        if name == corpus.getPath().getName():
            continue
        lang = name.split("-")[-2]
        files.write_small(spark, f"{folder}/{name}/metadata.yaml", f"target_language: {lang}\nsentence_aligned: {str(lang in ('en', 'de')).lower()}\nreference_essays_1: yes\n")
        for file in system.listStatus(corpus.getPath()):
            (part,) = (f.getPath() for f in system.listStatus(file.getPath()) if f.getPath().getName().startswith("part-"))
            system.rename(part, path(f"{folder}/{name}/{file.getPath().getName().removeprefix('file=')}.md"))
    system.delete(path(f"{folder}/.raw"), True)


_TREE = rf"""
WITH tree AS (
  SELECT doc_id, lang, 'learners-' || lang || '-' || (doc_id // {CORPUS_DOCS})::VARCHAR AS corpus, CASE doc_id % 10 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split,
         regexp_replace(text, '[.,;:!?]', '', 'g') || remark AS o, text || remark AS r1, CASE WHEN doc_id % 3 = 0 THEN replace(text, '.', ' .') || remark END AS r2
  FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN chr(10) || '### remark ' || lang || chr(10) || '###' ELSE '' END AS remark FROM documents)),
sides AS (SELECT doc_id, lang, corpus, split, o, 'ref1' AS ref, r1 AS r FROM tree UNION ALL SELECT doc_id, lang, corpus, split, o, 'ref2', r2 FROM tree WHERE r2 IS NOT NULL),
stripped AS (SELECT doc_id, lang, corpus, split, ref, regexp_replace(o, '^\s+|\s+$', '', 'g') AS o, regexp_replace(r, '^\s+|\s+$', '', 'g') AS r FROM sides),
listed AS (
  SELECT *, [x FOR x IN [{_STRIP} FOR y IN string_split(o, chr(10))] IF x <> ''] AS ol, [x FOR x IN [{_STRIP} FOR y IN string_split(r, chr(10))] IF x <> ''] AS rl
  FROM stripped WHERE o <> '' AND r <> ''),
aligned AS (
  SELECT lang, corpus, split, ref, unnest(ol[1:least(len(ol), len(rl))]) AS source, unnest(rl[1:least(len(ol), len(rl))]) AS target FROM listed WHERE lang IN ('en', 'de')
  UNION ALL SELECT lang, corpus, split, ref, o, r FROM listed WHERE lang NOT IN ('en', 'de')),
built AS (
  SELECT *, substr(md5(lang || ':' || corpus || ':' || substr(source, 1, 200) || ':' || ref), 1, 12) AS id, md5({_PROMPT}) AS prompt_md5
  FROM aligned WHERE length(source) BETWEEN 1 AND 6000 AND length(target) BETWEEN 1 AND 5000)
"""


@_query(
    f"""{_TREE}
SELECT 'lines' AS store, id, lang, corpus, split, ref, prompt_md5, md5(target) AS target_md5, NULL AS data_source FROM built
UNION ALL SELECT 'table', id, lang, corpus, split, NULL, prompt_md5, md5(target), '{DATA_SOURCE_PREFIX}' || lang || '_' || corpus FROM built"""
)
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 with S1, S2, S3, S6, S7, S11 and J1-J4: samples of a tree of corpora, read in small splits, as they were written by split."""
    path = scratch_path(spark, "build")
    write_corpora(spark, sf_dir, f"{path}/data")
    files.write_small(spark, f"{path}/settings.yaml", _TREE_SETTINGS)
    settings = files.read_settings(f"{path}/settings.yaml", spark)
    size = max(SPLIT_BYTES, files.folder_bytes(spark, f"{path}/data") // SPLITS_AT_MOST)
    pipelines.build_dataset(spark, f"{path}/data", f"{path}/out", int(settings["max_source_len"]), DATA_SOURCE_PREFIX, int(settings["max_target_len"]), size, CODEC)
    lines = files.read_jsonl(spark, [f"{path}/out/{DATA_SOURCE_PREFIX}{s}.jsonl" for s in SPLITS], SAMPLE)
    keys = ("id", "lang", "corpus", "split")
    lines = lines.select(F.lit("lines").alias("store"), *keys, "ref", F.md5("prompt").alias("prompt_md5"), F.md5("target").alias("target_md5"), F.lit(None).cast("string").alias("data_source"))
    table = spark.read.parquet(*(f"{path}/out/{DATA_SOURCE_PREFIX}{s}.parquet" for s in SPLITS))
    prompt = F.md5(F.element_at("prompt", 1)["content"])
    return lines.unionByName(table.select(F.lit("table").alias("store"), *(f"extra_info.{k}" for k in keys), F.lit(None).cast("string").alias("ref"), prompt.alias("prompt_md5"), F.md5("reward_model.ground_truth").alias("target_md5"), "data_source"))



@_query(
    """WITH files AS (
  SELECT '/data/' || source AS corpus_dir, split, kind, CASE WHEN kind = 'ref' THEN 'ref' || (doc_id % 2 + 1)::VARCHAR END AS ref_key,
         '/data/' || source || '/' || lang || '-' || doc_id::VARCHAR || (CASE WHEN kind = 'orig' THEN '_orig_' ELSE '-ref' || (doc_id % 2 + 1)::VARCHAR || '-' END) || 'x-' || split || '.md' AS path
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'orig' ELSE 'ref' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents))
SELECT corpus_dir, split, kind, ref_key, max(path) AS path FROM files GROUP BY ALL"""
)
def file_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 over file names made of the documents' tags, many for one place, with read-mes among them."""
    docs = documents(spark, sf_dir).withColumns(
        {"orig": F.col("doc_id") % 3 == 0, "split": F.when(F.col("doc_id") % 4 == 0, "dev").when(F.col("doc_id") % 4 == 1, "test").otherwise("train"), "ref": (F.col("doc_id") % 2 + 1).cast("string")}
    )
    kind = F.when(F.col("orig"), "_orig_").otherwise(F.concat(F.lit("-ref"), "ref", F.lit("-")))
    name = F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), kind, F.lit("x-"), "split", F.lit(".md"))
    files = docs.select(F.concat(F.lit("/data/"), "corpus", F.lit("/"), name).alias("path"))
    return classify_files(files.union(docs.select(F.concat(F.lit("/data/"), "corpus", F.lit("/ReadMe.md")).alias("path"))))


@_query(f"{_CTE} SELECT id, lang, corpus, split, 'ref1' AS ref, md5({_PROMPT}) AS prompt_md5, source, target, 2::BIGINT AS n_messages FROM samples")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written to JSON-lines files and read back by their schema."""
    path = scratch_path(spark, "samples_jsonl")
    files.write_jsonl(full_samples(spark, sf_dir), path, CODEC)
    back = files.read_jsonl(spark, path, SAMPLE)
    return back.select("id", "lang", "corpus", "split", "ref", F.md5("prompt").alias("prompt_md5"), "source", "target", F.size("messages").cast("long").alias("n_messages"))


@_query(
    """SELECT doc_id, md5(text) AS text_md5 FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents)
WHERE k * 3 - 1 <= n // 2"""
)
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files in which every record stands between a blank line and one of white space, the first half as many lines as there are documents."""
    docs = documents(spark, sf_dir)
    path = scratch_path(spark, "bounded")
    record = F.to_json(F.struct("doc_id", "text"))
    # Files follow one another by name, so their lines are in the order of doc_id.
    lines = docs.select("doc_id", F.posexplode(F.array(F.lit(""), record, F.lit("\t \t"))).alias("pos", "value"))
    lines.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id", "pos").select("value").write.text(path)
    head = files.read_jsonl_head(spark, path, "doc_id long, text string", docs.count() // 2)
    return head.select("doc_id", F.md5("text").alias("text_md5"))


@_query(f"{_CTE} SELECT 'sft' AS kind, id, lang, md5({_PROMPT}) AS prompt_md5, md5(target) AS answer_md5 FROM samples UNION ALL SELECT 'rl', id, lang, md5({_PROMPT}), md5(target) FROM samples")
def prepared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training tables made from JSON lines, written as Parquet and read back."""
    path = scratch_path(spark, "prepared")
    files.write_jsonl(full_samples(spark, sf_dir), f"{path}/samples", CODEC)
    pipelines.prepare(spark, f"{path}/samples", f"{path}/sft", f"{path}/rl", compression="zstd")
    content = lambda c, i: F.md5(F.element_at(c, i)["content"])
    sft = spark.read.parquet(f"{path}/sft").select(F.lit("sft").alias("kind"), "id", "lang", content("messages", 1).alias("prompt_md5"), content("messages", 2).alias("answer_md5"))
    rl = spark.read.parquet(f"{path}/rl")
    return sft.unionByName(rl.select(F.lit("rl").alias("kind"), "extra_info.id", "extra_info.lang", content("prompt", 1).alias("prompt_md5"), F.md5("reward_model.ground_truth").alias("answer_md5")))


@_query(f"{_CTE} SELECT split AS file, id, lang, corpus, split, md5(target) AS answer_md5 FROM samples")
def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Parquet table a split, written and read back."""
    records = rl_records(full_samples(spark, sf_dir), with_split=True)
    paths = files.write_parquet_by_split(records, scratch_path(spark, "by_split"))
    info = ("extra_info.id", "extra_info.lang", "extra_info.corpus", "extra_info.split")
    parts = [spark.read.parquet(path).select(F.lit(split).alias("file"), *info, F.md5("reward_model.ground_truth").alias("answer_md5")) for split, path in paths.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@_query(f"{_CTE} SELECT id, row_number() OVER (ORDER BY md5(id || '|42|shuffle'), id) AS position FROM samples")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: every sample's place in a full permutation, without a sort in one task."""
    return sampling.ranked(line_samples(spark, sf_dir), 42, "shuffle", []).select("id", F.col("__rank").cast("long").alias("position"))


@_query(f"{_CTE} SELECT id, lang, source, md5({_PROMPT}) AS prediction_md5 FROM samples")
def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, J7 and P15 with a generator that echoes its prompt in blanks."""

    def generator() -> Callable[[list[str]], list[str]]:
        return lambda prompts: [f" \n{p}\t " for p in prompts]

    return pipelines.infer(full_samples(spark, sf_dir), generator).select("id", "lang", "source", F.md5("prediction").alias("prediction_md5"))


@_query(r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents")
def text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 over whole documents set in blanks."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.md5(strip(F.concat(F.lit(" \n"), "text", F.lit("\u00a0\t")))).alias("text_md5"))
