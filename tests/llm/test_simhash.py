import random
import re

import numpy as np
import pytest
import xxhash

from glossmill.llm.common import join_facts, word_pieces
from glossmill.llm.graph import components
from glossmill.llm.simhash import _search, _Union, bucket_links, covering_masks, drop_near_copies, fingerprint, fingerprint_lanes, near_dedup


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    masks = covering_masks(radius)
    rng = random.Random(5)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not bits & m for m in masks)


def slow_fingerprint(text, shingle=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_texts):
    for text in [*odd_texts, "A b C d", "x y z w " * 9]:
        if len(text or "") < 60_000:
            assert fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_fingerprints_of_pieces(monkeypatch):
    from glossmill.llm import simhash

    text = b" ".join(b"w%d" % (i * i % 37) for i in range(500)) + b" \n one two"
    whole = fingerprint(text)
    for size in (1, 5, 40, 333):
        monkeypatch.setattr(simhash, "word_pieces", lambda t, size=size: word_pieces(t, size))
        assert fingerprint(text) == whole == slow_fingerprint(text.decode())
        assert fingerprint(b"one two") == slow_fingerprint("one two") and fingerprint(b" ") == 0


def union_of(n, links):
    sets = _Union(n)
    for x, y in links:
        sets.join(x, y)
    return [sets.find(i) for i in range(n)]


def test_large_buckets_lose_no_link():
    rng = np.random.default_rng(1)
    free = list(range(30))
    for bits in (6, 14, 30):
        marks = np.unique(rng.integers(0, 1 << bits, 700, dtype=np.uint64))
        near = [(i, j) for i in range(len(marks)) for j in np.flatnonzero(np.bitwise_count(marks ^ marks[i]) <= 3)]
        wanted = union_of(len(marks), near)
        assert union_of(len(marks), bucket_links(marks, 3, free)) == wanted
        cut = bucket_links(marks, 3, free, bucket=50)
        assert union_of(len(marks), cut) == wanted and len(cut) < len(marks)
        assert len(list(_search(marks, 3))) == len(marks) - len(set(wanted))


def brute_lanes(marks):
    ids = sorted(marks)
    sets = _Union(len(ids))
    for i, a in enumerate(ids):
        for j, b in enumerate(ids[:i]):
            if any((x ^ y).bit_count() <= 3 for x, y in zip(marks[a], marks[b], strict=True)):
                sets.join(i, j)
    return {d: ids[sets.find(i)] for i, d in enumerate(ids)}


def brute(marks):
    return brute_lanes({d: [m] for d, m in marks.items()})


def test_lanes_are_fingerprints_of_mixed_hashes():
    def mixed(h, lane):
        z = (h + 0x9E3779B97F4A7C15 * lane) % (1 << 64)
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ z >> 27) * 0x94D049BB133111EB % (1 << 64)
        return z ^ z >> 31 if lane else h

    for text in ("", "a b", "a b c d e f g a b c", "x " * 40):
        words = text.split()
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        wanted = [sum(1 << b for b in range(64) if hashes and 2 * sum(mixed(h, lane) >> b & 1 for h in hashes) > len(hashes)) for lane in range(3)]
        assert fingerprint_lanes(text.encode(), 3).tolist() == wanted


def test_a_hot_key_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(6000)], "i long, k string")
    facts = rows.groupBy("k").count()
    got = join_facts(rows, facts, "k", "count", 6000).collect()
    assert len(got) == 6000 and all(r["count"] == (4000 if r["k"] == "hot" else 1) for r in got)


def test_components_against_brute_force(spark, make_docs, odd_texts):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(12)]
    texts = list(odd_texts)
    for b in base:
        texts.append(b)
        for _ in range(8):
            changed = b.split()
            changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(" ".join(changed))
    rng.shuffle(texts)
    docs = make_docs([(i * 3, t, "en", "s") for i, t in enumerate(texts)]).repartition(6)
    got = {r["doc_id"]: r for r in near_dedup(docs).collect()}
    marks = {d: int(r["fingerprint"], 16) for d, r in got.items()}
    assert all(marks[i * 3] == fingerprint((t or "").encode()) for i, t in enumerate(texts))
    wanted = brute(marks)
    assert {d: r["component_id"] for d, r in got.items()} == wanted
    assert len(set(wanted.values())) < len(texts) - 20  # near copies did link
    out = drop_near_copies(docs, shingle=3, lanes=1)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(set(wanted.values()))

    lanes = {i * 3: fingerprint_lanes((t or "").encode(), 4).tolist() for i, t in enumerate(texts)}
    wanted = brute_lanes(lanes)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup(docs, lanes=4).collect()} == wanted
    assert sorted(r["doc_id"] for r in drop_near_copies(docs, shingle=3, lanes=4).collect()) == sorted(set(wanted.values()))


def test_repeated_and_missing_ids(spark, make_docs):
    docs = make_docs([(7, "a b c", "en", "s"), (7, "a b c", "en", "s"), (None, "a b c", "en", "s"), (None, "x y z", "en", "s")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_dedup(docs).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None)], key=str)
    assert sorted((str(r["doc_id"]), r["text"]) for r in drop_near_copies(docs).collect())[0] == ("7", "a b c")


def test_one_row_survives_each_component(spark, make_docs):
    texts = ["a b c", "d e f", "g h i j", "k l m"]
    rows = [(None, t, "en", "s") for t in texts] + [(None, "a b c", "en", "t"), (5, "n o p", "en", "s"), (5, "q r s", "en", "s"), (None, "q r s", "en", "s"), (6, "q r s", "en", "s")]
    docs = make_docs(rows).repartition(5)
    assert len({fingerprint(t.encode()) for _, t, *_ in rows}) == 6
    out = drop_near_copies(docs)
    assert out.columns == docs.columns
    wanted = [(None, t) for t in texts] + [(5, "n o p"), (5, "q r s")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(wanted, key=str)


def test_empty(make_docs):
    assert near_dedup(make_docs([])).count() == 0 and drop_near_copies(make_docs([])).count() == 0


def test_long_chains_and_self_edges(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500), (1000, 900), (900, 1000), (950, 900)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1000] == got[950] == got[900] == 900


def test_the_stage_finds_planted_copies(make_docs):
    """Of copies with a five-word similarity of 0.8 or more nine in ten go, and all unrelated texts stay."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, copies = [], set()
    while len(copies) < 300:
        words = [word() for _ in range(rng.randint(40, 600))]
        changed = list(words)
        for _ in range(rng.randint(1, max(1, len(words) // 45))):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice(([word()], [], [changed[at], word()]))
        a, b = shingles(words), shingles(changed)
        if 0.8 <= len(a & b) / len(a | b) < 1:
            at = 10 * len(rows)
            rows += [(at, " ".join(words), "en", "s"), (at + 1, " ".join(changed), "en", "s"), (at + 2, " ".join(word() for _ in words), "en", "s")]
            copies.add(at + 1)
    left = {r["doc_id"] for r in drop_near_copies(make_docs(rows)).collect()}
    assert len(copies - left) >= 270 and {r[0] for r in rows} - copies <= left
