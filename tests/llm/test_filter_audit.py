"""The filter audit against a plain walk through every order."""

import re
from collections import defaultdict
from itertools import permutations

from glossmill.llm.filter_audit import FILTERS, filter_audit, mask_cells

LABELS = "doc_id long, quality int, toxic int"


def failures(text, doc_id, smaller):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    found = set()
    if len(words) < 100:
        found.add("A")
    if 100 * len(set(words)) < 80 * len(words):
        found.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
        found.add("C")
    if re.search("[#$%&*|]", text):
        found.add("D")
    if doc_id is not None and smaller.get(text, doc_id) < doc_id:
        found.add("E")
    return found


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    smaller = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smaller[text or ""] = min(doc_id, smaller.get(text or "", doc_id))
    marks = {k: ({d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}) for k in "x"}["x"]
    out, shapley = {}, defaultdict(int)
    judged = [(d, lang or "", failures(t or "", d, smaller)) for d, t, lang in rows]
    for part in {p for _, p, _ in judged}:
        for order in map("".join, permutations(FILTERS)):
            for step, letter in enumerate(order, 1):
                counts = [0] * 6
                for d, p, failed in judged:
                    if p != part:
                        continue
                    gone = bool(failed & set(order[: step - 1]))
                    fails = letter in failed
                    lost = fails and not gone
                    for i, hit in enumerate((not fails and not gone, lost, fails and gone, failed == {letter}, lost and d is not None and d in marks[0], lost and d is not None and d in marks[1])):
                        counts[i] += hit
                out[part, order, step] = [letter, *counts]
                shapley[part, letter] += counts[1]
    return {k: (*v, shapley[k[0], v[0]]) for k, v in out.items()}


def told(df):
    names = ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


LONG = " ".join(f"w{i}" for i in range(120))


def test_against_a_walk(spark, make_docs, odd_texts):
    texts = [*odd_texts, LONG, LONG, LONG + " #", LONG.upper(), "A B " * 60, "A B " * 60, LONG + " w1" * 40, "x", "", "\x00 nul"]
    rows = [(i * 3 % 31, t, (None, "en", "de", "")[i % 4], "s") for i, t in enumerate(texts)]
    rows += [(None, LONG, "en", "s"), (None, None, "en", "s"), (5, LONG, "en", "s"), (5, LONG, "en", "s"), (5, LONG, "fr", "s"), (-4, "x", "fr", "s")]
    labels = [(0, 1, 0), (3, 0, 1), (3, 1, None), (5, 1, 1), (6, None, None), (9, None, 1), (None, 1, 1), (77, 1, 1)]
    got = told(filter_audit(make_docs(rows), spark.createDataFrame(labels, LABELS)))
    assert got == brute([(d, t, lang) for d, t, lang, _ in rows], labels)
    assert len(got) == 600 * len({part for part, _, _ in got})


def test_totals_hold(spark, make_docs):
    docs = make_docs([LONG, "a b", "A B C", LONG, "#"])
    got = told(filter_audit(docs, spark.createDataFrame([], LABELS)))
    for (part, order, step), (_, kept, removed, redundant, *_rest) in got.items():
        before = got[part, order, step - 1][1] if step > 1 else 5
        assert kept + removed == before and redundant <= 5 - before
    per_filter = {v[0]: v[-1] for v in got.values()}
    assert sum(per_filter.values()) == 120 * (5 - got["en", "ABCDE", 5][1])


def test_copies_and_repeated_rows_stay_few(spark, make_docs):
    """Thousands of equal rows are one row before anything is joined."""
    docs = make_docs([(7, LONG, "en", "s")] * 3000 + [(None, LONG, "en", "s")] * 3000 + [(i, LONG, "en", "s") for i in range(20)])
    cells = {(r["part"], r["mask"]): r["n"] for r in mask_cells(docs, spark.createDataFrame([], LABELS)).collect()}
    assert cells == {("en", 0): 3001, ("en", 16): 3019}


def test_empty_tables(spark, make_docs):
    assert filter_audit(make_docs([]), spark.createDataFrame([], LABELS)).collect() == []
