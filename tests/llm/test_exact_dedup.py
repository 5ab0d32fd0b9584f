import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.llm.exact_dedup import CuckooIndex, drop_exact_copies, exact_dedup


def digest(x):
    return hashlib.sha256(str(x).encode()).digest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("idg"), st.integers(0, 40)), max_size=300))
def test_index_is_a_dictionary(steps):
    index, model = CuckooIndex(2), {}
    for kind, x in steps:
        key = digest(x)
        if kind == "i":
            assert index.insert(key, x) is (key not in model)
            model.setdefault(key, x)
        elif kind == "d":
            assert index.delete(key) is (model.pop(key, None) is not None)
        assert index.get(key) == model.get(key) and (key in index) is (key in model)
    assert dict(index.items()) == model and len(index) == len(model)


def test_overflow_resizes_without_loss():
    index = CuckooIndex(2)
    for i in range(5000):
        index.insert(digest(i), i)
    assert index.resizes > 0 and all(index.get(digest(i)) == i for i in range(5000)) and digest(5001) not in index
    for i in range(0, 5000, 2):
        assert index.delete(digest(i))
    assert len(index) == 2500 and digest(4) not in index and index.get(digest(5)) == 5


def test_equal_fingerprints_are_told_apart():
    index = CuckooIndex(2)
    keys = [b"\x07\x00" + b"\x01" * 8 + i.to_bytes(4, "little") for i in range(8)]  # one fingerprint, one bucket pair
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert [index.get(k) for k in keys] == list(range(8))
    assert index.delete(keys[3]) and index.get(keys[3]) is None and index.get(keys[4]) == 4


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_brute_force(spark, make_docs, odd_texts):
    texts = odd_texts + [f"t{i % 7}" for i in range(60)]
    rows = [(i, t, "en", None) for i, t in enumerate(texts)] + [(5, "dup", "en", "a"), (5, "dup", "en", "a"), (None, "dup", "en", "a"), (None, "no id", "en", "a")]
    docs = make_docs(rows).repartition(5)
    got = exact_dedup(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute([(r[0], r[1]) for r in rows])
    kept = {}
    for r in got:
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + 1
    assert set(kept.values()) == {1} and set(kept) == {r["text_sha256"] for r in got}


def test_drop_keeps_columns_and_one_of_each(spark, make_docs, odd_texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(odd_texts * 2)] + [(99, "dup", "en", "a"), (99, "dup", "en", "a"), (None, "dup", "en", "a")]
    docs = make_docs(rows)
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
    last = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            last[text or ""] = max(doc_id, last.get(text or "", -1))
    assert got == sorted((v, k) for k, v in last.items())


def test_empty(make_docs):
    assert exact_dedup(make_docs([])).count() == 0 and drop_exact_copies(make_docs([])).count() == 0
