"""Every contract query over the smallest tables, against plain reckoning of its result."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from test_exact_dedup import brute as exact_brute
from test_mixing_sharding import water_fill
from test_models import slow_counts
from test_secret_scan import slow_spans
from test_simhash import brute as near_brute
from test_simhash import slow_fingerprint
from test_tokens import RANKS, whole

from glossmill.llm import queries, sharding
from glossmill.llm.common import table

DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DIR, "documents").collect()


@pytest.fixture(scope="module")
def result(spark, docs):
    def run(name):
        rows = queries.queries()[name](spark, DIR).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
        return {r["doc_id"]: r for r in rows}

    return run


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op1(docs, result):
    got = result("op1_quality_rules")
    for d in docs:
        r = got[d["doc_id"]]
        if len(d["text"]) < 20_000:
            counts = slow_counts(d["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
            assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["base_failed"] and r["kept"])


def test_op2(docs, result):
    got = result("op2_token_files")
    start = 0
    order = sorted(docs, key=lambda d: d["doc_id"])
    for d, ids in zip(order, whole([d["text"] for d in order]), strict=True):
        ids = [*ids, 2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3(docs, result):
    got = result("op3_secret_scan")
    for d in docs:
        base = slow_spans(d["text"])
        r = got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, *_ in base) for x in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_op4(docs, result):
    import public_tokenizers
    import tiktoken
    from glossmill.llm.byte_bpe import load_ranks

    got = result("op4_byte_bpe")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    for d in docs:
        ids = plain.encode_ordinary(d["text"])
        wanted = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d["text"].encode()).hexdigest()
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == wanted


def test_op5(docs, result):
    got = result("op5_simhash")
    marks = {d["doc_id"]: slow_fingerprint(d["text"]) for d in docs}
    wanted = near_brute(marks)
    assert all(got[d]["fingerprint"] == f"{m:016x}" and got[d]["component_id"] == wanted[d] for d, m in marks.items())


def test_op6(docs, result):
    got = result("op6_quality_cnn")
    assert all(r["held_out"] == held(d) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    same = defaultdict(set)
    for d in docs:
        same[d["text"]].add(round(got[d["doc_id"]]["score"], 5))
    assert all(len(s) == 1 for s in same.values())  # nothing but the text counts


def test_op7(docs, result):
    got = result("op7_mix_sources")
    size = {d["doc_id"]: len(d["text"].split()) for d in docs}
    sources, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        sources[d["source"]] += size[d["doc_id"]]
    wanted = water_fill(dict(sources))
    for d in docs:
        r = got[d["doc_id"]]
        assert r["size"] == size[d["doc_id"]] and r["source_size"] == sources[d["source"]] and r["target"] == pytest.approx(wanted[d["source"]])
        assert r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    largest = defaultdict(int)
    for d in docs:
        largest[d["source"]] = max(largest[d["source"]], size[d["doc_id"]])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in sources)  # ten documents a source here


def test_op8(docs, result):
    got = result("op8_language_id")
    learned = {d["lang"] for d in docs if not held(d["doc_id"])}
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == held(d["doc_id"]) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if any(map(str.isalpha, d["text"])) else r["lang_pred"] == "und"
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in docs if held(d["doc_id"])]) > 0.9


def test_op9(docs, result):
    got = result("op9_exact_dedup")
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.values()), key=str) == exact_brute([(d["doc_id"], d["text"]) for d in docs])
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got.values())


def test_op10(docs, result):
    """Slots by the text's hash, shards by dealing the heaviest slot to the lightest shard."""
    got = result("op10_shard_documents")
    slot_of = {d["doc_id"]: xxhash.xxh64_intdigest(d["text"].encode(), 42) for d in docs}
    slot_of = {d: (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS for d, h in slot_of.items()}
    size = {d["doc_id"]: len(d["text"].encode()) + 1 for d in docs}
    per_text = Counter()
    for d in docs:
        per_text[d["text"]] += size[d["doc_id"]]
    assert max(per_text.values()) <= sum(size.values()) / 16  # no text is so heavy that it is spread
    weight = Counter()
    for d, s in slot_of.items():
        weight[s] += size[d]
    load, shard_of = [0] * 16, {}
    for s in sorted(weight, key=lambda s: (-weight[s], s)):
        shard_of[s] = min(range(16), key=lambda i: (load[i], i))
        load[shard_of[s]] += weight[s]
    places = defaultdict(list)
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size[d["doc_id"]], zlib.crc32(d["text"].encode()), "bytes", None)
        assert r["virtual_slot"] == slot_of[d["doc_id"]] and r["shard"] == shard_of[r["virtual_slot"]] and r["map_version"] == 1
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_columns_of_the_contracts(spark):
    wanted = {
        "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op5_simhash": "doc_id fingerprint component_id",
        "op9_exact_dedup": "doc_id keep_id group_size kept text_sha256",
        "op10_shard_documents": "doc_id size text_crc32 law shard slot grown_shard",
    }
    for name, columns in wanted.items():
        assert set(columns.split()) <= set(queries.queries()[name](spark, DIR).columns)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_hard_negatives"])
def test_sql(spark, name):
    """The query agrees with its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in found.description)
    df = queries.queries()[name](spark, DIR)
    assert columns == sorted(df.columns)
    place = {d[0]: i for i, d in enumerate(found.description)}
    wanted = sorted(tuple(str(r[place[c]]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == wanted and wanted


def test_op12(spark, docs):
    import public_tokenizers
    from test_packing import check
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r.asDict() for r in queries.queries()["op12_pack_documents"](spark, DIR).collect()]
    check(rows, {d["doc_id"]: d["text"] for d in docs}, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 2048)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1
