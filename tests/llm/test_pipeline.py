import hashlib
from collections import Counter

import corpus_pipeline
from glossmill.llm import byte_bpe, exact_dedup, mixing, quality_rules, queries, simhash
from glossmill.llm.common import settle, table, tokenizer_file

DIR = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = settle(f(spark, docs, DIR), name)
        if name != "byte_bpe":
            assert docs.columns == columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    first = seen["quality_rules"]
    verdict = quality_rules.judge(first, quality_rules.fit(first, table(spark, DIR, "labels")))
    assert ids(seen["exact_dedup"]) == ids(verdict.where("kept"))

    last = {}
    for r in seen["exact_dedup"].collect():
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert ids(seen["simhash_near_dedup"]) == sorted(last.values()) == ids(exact_dedup.exact_dedup(seen["exact_dedup"]).where("kept"))

    near = simhash.near_dedup(seen["simhash_near_dedup"], shingle=simhash.STAGE_SHINGLE, lanes=simhash.LANES)
    assert ids(seen["mixing"]) == ids(near.where("doc_id = component_id"))

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(seen["mixing"]).collect()}
    assert Counter(r["doc_id"] for r in seen["byte_bpe"].collect()) == Counter({d: c for d, c in copies.items() if c})

    texts = {r["doc_id"]: r["text"] for r in seen["byte_bpe"].collect()}
    bpe = byte_bpe.ByteBPE(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    rows = docs.collect()
    assert len(rows) == sum(copies.values())
    for r in rows:
        assert r["ids"] == bpe.encode(texts[r["doc_id"]]) and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()

    again = corpus_pipeline.run(spark, DIR)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in again.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_and_empty_tables(spark, make_docs, odd_texts):
    odd = make_docs([(i, t, None, None) for i, t in enumerate(odd_texts)] + [(None, "x y z " * 20, None, "s")] * 2)
    for docs in (odd, make_docs([])):
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, DIR)
            assert name == "byte_bpe" or out.columns == docs.columns
            docs = settle(out, name)
            docs.count()


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
