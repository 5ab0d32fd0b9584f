"""Building samples from aligned essays: alignment, filters, ids, prompts, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.functions.scoring import DATA_SOURCE_PREFIX
from glossmill.functions.text import _col, strip
from glossmill.schemas import LANGUAGES

# Fixed value: the instruction before a sentence; {} stands for its language.
INSTRUCTION = (
    "Please identify whether the {} sentence I provide contains any grammatical errors. "
    "If there are grammatical errors, please correct them with the minimal necessary changes. "
    "If there are no grammatical errors, please reply with the original sentence. "
    "You must output your final answer in the following format: "
    "<answer> your corrected sentence, or the original sentence </answer> "
    "The sentence you need to correct is: "
)
ID_TEXT = 200
ID_LENGTH = 12


def language_name(code: Column | str) -> Column:
    """Full name of a known language code, else the code."""
    code = _col(code)
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


def instruction(source: Column | str, lang: Column | str) -> Column:
    return F.concat(F.replace(F.lit(INSTRUCTION), F.lit("{}"), language_name(lang)), _col(source))


def sample_id(lang: Column | str, corpus: Column | str, source: Column | str, ref: Column | str) -> Column:
    """First 12 digits of an MD5 over language, corpus, the source's first 200 characters and the reference key."""
    key = F.concat_ws(":", _col(lang), _col(corpus), F.substring(_col(source), 1, ID_TEXT), _col(ref))
    return F.substring(F.md5(key), 1, ID_LENGTH)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_samples(pairs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Samples from (lang, corpus, split, ref, source, target) pairs; `keep` names columns to carry along."""
    staged = pairs.withColumn("prompt", instruction("source", "lang"))
    return staged.select(
        sample_id("lang", "corpus", "source", "ref").alias("id"),
        "lang", "corpus", "split", "ref",
        F.array(message("user", F.col("prompt")), message("assistant", F.col("target"))).alias("messages"),
        "prompt", "source", "target", *keep,
    )


def _lines(text: Column | str) -> Column:
    """Lines that are not blank, stripped."""
    return F.filter(F.transform(F.split(_col(text), "\n"), strip), lambda x: x != "")


def align_essays(orig: DataFrame, refs: DataFrame, keys: tuple[str, ...] = ("corpus", "split", "essay_id")) -> DataFrame:
    """Essays joined with their references by key: one row for each reference of an essay.

    `orig` has (*keys, orig_text), `refs` (*keys, ref, ref_text); blank sides are dropped.
    """
    found = orig.join(refs, list(keys), "inner")
    return found.where((strip("orig_text") != "") & (strip("ref_text") != ""))


def align_lines(essays: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, line_no, source, target): non-blank lines paired by position, up to the shorter side."""
    staged = essays.select(*keep, _lines("orig_text").alias("__o"), _lines("ref_text").alias("__r"))
    staged = staged.withColumn("__k", F.least(F.size("__o"), F.size("__r")))
    pairs = F.arrays_zip(F.slice("__o", F.lit(1), F.col("__k")).alias("source"), F.slice("__r", F.lit(1), F.col("__k")).alias("target"))
    return staged.select(*keep, F.posexplode(pairs).alias("line_no", "p")).select(*keep, (F.col("line_no") + 1).alias("line_no"), "p.source", "p.target")


def align_documents(essays: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, source, target): one stripped pair for each essay."""
    return essays.select(*keep, strip("orig_text").alias("source"), strip("ref_text").alias("target"))


def filter_pairs(pairs: DataFrame, max_source_len: int = 1024, max_target_len: int | None = None) -> DataFrame:
    """Pairs with no empty side and at most four characters per allowed token on each; targets may be as long as sources unless told."""
    longest = {"source": 4 * max_source_len, "target": 4 * (max_source_len if max_target_len is None else max_target_len)}
    for side, most in longest.items():
        pairs = pairs.where((F.length(side) <= most) & (F.length(side) > 0))
    return pairs


def rewrite_prompt(prompt: Column | str, text: Column | str, source: Column | str | None = None) -> Column:
    """The prompt with what follows its last blank line replaced by `text`.

    A prompt without a blank line is kept whole and the text appended.  Given `source`
    and a prompt that ends with it, that ending is replaced instead.
    """
    prompt, text = _col(prompt), _col(text)
    as_is = F.concat(F.regexp_replace(prompt, r"(?s)^(.*)\n\n.*$", "$1"), F.lit("\n\n"), text)
    if source is None:
        return as_is
    source = _col(source)
    return F.when(prompt.endswith(source), F.concat(prompt.substr(F.lit(1), F.length(prompt) - F.length(source)), text)).otherwise(as_is)


def with_source(samples: DataFrame, source: Column, suffix: str, rebuild: bool = False) -> DataFrame:
    """Samples with another source text, its prompt and messages, and a tagged id."""
    names = samples.columns
    staged = samples.withColumn("__new", source)
    content = F.element_at("messages", 1)["content"]
    staged = staged.withColumn("prompt", rewrite_prompt(content, "__new", "source" if rebuild else None))
    # Further messages than the first two stay.
    messages = F.concat(
        F.array(F.struct(F.element_at("messages", 1)["role"].alias("role"), F.col("prompt").alias("content"))),
        F.array(F.struct(F.element_at("messages", 2)["role"].alias("role"), F.col("target").alias("content"))),
        F.slice("messages", F.lit(3), F.greatest(F.size("messages") - 2, F.lit(0))),
    )
    return staged.withColumns({"messages": messages, "source": F.col("__new"), "id": F.concat("id", F.lit(suffix))}).select(*names)


def is_augmented(id_: Column | str) -> Column:
    return _col(id_).endswith("_aug")


def is_identity_injected(id_: Column | str) -> Column:
    return _col(id_).endswith("_id")


def sft_records(samples: DataFrame) -> DataFrame:
    """(messages, lang, id) for supervised training."""
    return samples.select("messages", "lang", "id")


def rl_records(samples: DataFrame, with_split: bool = False, prefix: str = DATA_SOURCE_PREFIX) -> DataFrame:
    """Prompt, rule-based ground truth and provenance for reinforcement learning.

    With a split, as the corpus build writes them, the data source also names the corpus
    and the split is part of the provenance and a column to partition by.
    """
    source = F.concat(F.lit(prefix), "lang", *([F.lit("_"), F.col("corpus")] if with_split else []))
    info = ["id", "lang", "corpus", "source", *(["split"] if with_split else [])]
    return samples.select(
        source.alias("data_source"),
        F.array(message("user", F.col("prompt"))).alias("prompt"),
        F.lit("grammar_correction").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("target").alias("ground_truth")).alias("reward_model"),
        F.struct(*info).alias("extra_info"),
        *(["split"] if with_split else []),
    )
