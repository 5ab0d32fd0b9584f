"""Token-array helpers for training tables; the tokenizer is the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import _col

#: Fixed value: the label that a loss ignores.
IGNORED = -100


def truncate(tokens: Column | str, limit: int) -> Column:
    """The first `limit` tokens."""
    return F.slice(_col(tokens), 1, limit)


def fits(tokens: Column | str, limit: int) -> Column:
    """Whether a prompt has at most `limit` tokens."""
    return F.size(_col(tokens)) <= limit


def masked_labels(ids: Column | str, prompt_tokens: Column | str) -> Column:
    """Labels of a training row: its ids, with the prompt's ignored."""
    k = _col(prompt_tokens)
    return F.transform(_col(ids), lambda x, i: F.when(i < k, F.lit(IGNORED)).otherwise(x.cast("int")))
