import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.llm.byte_bpe import ByteBPE, encode_documents, load_ranks, serialise_model
from glossmill.llm.token_files import EliasFano, TokenFile, WordTokenizer, pack_file, read_token_files, token_files, write_token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(RANKS)


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_encoder_equals_rank_bpe(bpe, exact, odd_texts):
    for text in [t or "" for t in odd_texts] + ["ÀÉÎ ñandú  \n\n\t x'll 123456 ＡＢＣ 日本語テキスト", "xyzzyx" * 5000, " " * 999, "​‍"]:
        ids = bpe.encode(text)
        assert ids == exact.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()
        assert bpe.digest(ids) == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(bpe, exact, text):
    assert bpe.encode(text) == exact.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_long_texts_in_pieces(bpe, exact, monkeypatch):
    from glossmill.llm import byte_bpe, common, token_files

    text = " ".join(["it's  two", "a\n\n b", "x 12 ,,", "\u3000 ok", "...", "end."] * 60)
    words = whole([text])[0]
    for size in (1, 9, 50):
        monkeypatch.setattr(byte_bpe, "PIECE_CHARS", size)
        monkeypatch.setattr(token_files, "WORK_BYTES", size)
        monkeypatch.setattr(token_files, "word_pieces", lambda t, _, size=size: common.word_pieces(t, size))
        assert bpe.encode(text) == exact.encode_ordinary(text) and len(list(bpe.pieces(text))) > 1
        assert np.frombuffer(next(WordTokenizer(WORDS).texts([text.encode()])), "<u2").tolist() == words


def test_model_needs_whole_ranks():
    assert len(serialise_model({b"a": 0, b"b": 1})) > 20
    with pytest.raises(ValueError):
        serialise_model({b"a": 0, b"b": 2})


def test_encode_documents(spark, make_docs, odd_texts, exact):
    rows = [(i, t, "en", "s") for i, t in enumerate(odd_texts)] + [(None, "no id", "en", "s"), (3, "one", "en", "s")]
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in encode_documents(make_docs(rows)).collect()), key=str)
    wanted = [(d, len(exact.encode_ordinary(t or "")), exact.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows]
    assert got == sorted(wanted, key=str)
    assert encode_documents(make_docs([])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400))
def test_elias_fano(gaps):
    values = np.cumsum(gaps).tolist() if gaps else []
    fano = EliasFano.from_bytes(EliasFano.build(values).to_bytes())
    assert fano.values().tolist() == values
    assert [fano.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small_and_checked():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(EliasFano.build(values).to_bytes()) < 50_000 * 13 / 8 + 50_000 * 4 / 64 + 100
    assert EliasFano.build([0, 0, 1 << 45]).select(2) == 1 << 45
    with pytest.raises(ValueError):
        EliasFano.build([3, 2])
    with pytest.raises(IndexError):
        EliasFano.build([3]).select(1)


def test_file_round_trip():
    ids = np.arange(10, dtype="<u2")
    file = TokenFile(pack_file([None, 4, 9], [1, 0, 9], ids.tobytes(), 2))
    assert file.doc_ids == [None, 4, 9] and [file.document(i).tolist() for i in range(3)] == [[0], [], list(range(1, 10))]
    with pytest.raises(ValueError):
        TokenFile(b"nope" + bytes(60))


def whole(texts, path=WORDS, special_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if special_as_text:
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>A B.<|endoftext|>", "x<|ENDOFTEXT|>y <|endoftext", "<|endoftext|><|endoftext|>", "Word,<|startoftext|>\u0308"]
HARD = SPECIAL + ["H̱ẖ T̈ẗ W̊ẘ J̌ǰ ẖ", "A̱. B., c.. d.,", "Ǆ ŉ İ İ ẞ ß Σας", "it's. we'll, I'M.", "x,y. z,.", "...,", "word.", "a\u0085b c.　d"]


def test_words_equal_whole_texts(odd_texts):
    texts = odd_texts + HARD
    tokenizer = WordTokenizer(WORDS)
    got = [np.frombuffer(b, "<u2").tolist() for b in tokenizer.texts([(t or "").encode() for t in texts])]
    assert got == whole(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aHTW.,' ̱̈̊"), st.sampled_from(["<|endoftext|>"])), max_size=40).map("".join))
def test_any_words(text):
    got = next(_tokenizer().texts([text.encode()]))
    assert np.frombuffer(got, "<u2").tolist() == whole([text])[0]


def test_special_tokens():
    assert whole(["a <|endoftext|> b"]) == [[320, 49407, 321]]
    for as_text in (False, True):
        tokenizer = WordTokenizer(WORDS, as_text)
        got = [np.frombuffer(b, "<u2").tolist() for b in tokenizer.texts([t.encode() for t in SPECIAL])]
        assert tokenizer.by_words and got == whole(SPECIAL, special_as_text=as_text)


def test_other_vocabularies_encode_whole_texts(odd_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = WordTokenizer(path)
    texts = [t or "" for t in odd_texts] + HARD
    got = [np.frombuffer(b, "<u2").tolist() for b in tokenizer.texts([t.encode() for t in texts])]
    assert not tokenizer.by_words and got == whole(texts, path)


def _tokenizer(cache=[]):  # noqa: B006
    if not cache:
        cache.append(WordTokenizer(WORDS))
    return cache[0]


def expected(rows):
    out, start = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for (doc_id, *_), ids in zip(rows, whole([r[1] for r in rows]), strict=True):
        ids = [*ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, make_docs, odd_texts):
    rows = [(i * 5 % 97, t, "en", "s") for i, t in enumerate(odd_texts + HARD)] + [(None, "b", "en", "s"), (None, "a", "en", "s"), (10, "tie b", "en", "s"), (10, "tie a", "en", "s")]
    for limit in (1 << 24, 50):
        got = [tuple(r) for r in token_files(make_docs(rows).repartition(3), file_ids=limit).orderBy("start").collect()]
        assert got == expected(rows)


def test_manifest_and_random_access(spark, make_docs, tmp_path):
    rows = [(i, f"word {i} and more", "en", "s") for i in range(300)]
    manifest = write_token_files(make_docs(rows), f"file://{tmp_path}/ids", WORDS, file_ids=100)
    files = sorted(manifest.collect(), key=lambda r: r["first"])
    assert len(files) > 10 and not [p for p in tmp_path.glob("ids/.*")]
    first = 0
    for r in files:
        assert r["first"] == first
        first += r["n_ids"]
    one = TokenFile((tmp_path / "ids" / files[3]["path"].rsplit("/", 1)[1]).read_bytes())
    at = len(one) // 2
    assert one.document(at).tolist() == [*whole([rows[one.doc_ids[at]][1]])[0], 2]
    assert read_token_files(spark.createDataFrame(files, manifest.schema)).count() == 300


def test_no_documents(make_docs):
    assert token_files(make_docs([])).count() == 0


def test_ranks_file_is_base64():
    with open(RANKS, "rb") as f:
        token, rank = f.readline().split()
    assert load_ranks(RANKS)[base64.b64decode(token)] == int(rank)
