import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source) rows; with columns that clash with results."""

    def make(rows, clash=True):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, lang, source = row if isinstance(row, tuple) else (i, row, "en", f"src{i % 3}")
            full.append((doc_id, text, lang, source, len(text or "")))
        df = spark.createDataFrame(full, COLUMNS)
        if clash:
            for name in ("kept", "digest", "fp", "size", "copies", "shard", "key", "n", "score", "row_no", "part", "order"):
                df = df.withColumn(name, df["source"])
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tied, repeated, short, long and unusual texts."""
    long_ = " ".join(f"word{i % 977}" for i in range(40_000))
    return [None, "", " \t\n\x0b", "one", "one", "two words", "İstanbul ẞ é ́   x y", "a" * 50_000, long_, long_, "Ünïcödé \U0001f600 text.", "<|endoftext|> 'll don't", "\x00 nul", "same\nsame\nsame"]
