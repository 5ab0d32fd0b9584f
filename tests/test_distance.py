"""Distances by bands of bit vectors against the plain table."""

import random

import pytest

from glossmill.functions import distance as D


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not out:
            out.insert(at, rng.choice("abx"))
        elif kind == 1:
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = rng.choice("abyz")
    return "".join(out)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(1)
    out = []
    for n in (0, 1, 30, 31, 32, 33, 62, 63, 64, 65, 95, 127, 128, 129, 200):
        for edits in (0, 1, 3, 10, 25, 30, 31, 32, 40, 80):
            for letters in ("ab", "abcdé😀 \x00"):
                text = "".join(rng.choices(letters, k=n))
                out.append((text, changed(rng, text, edits)))
    return [(a, b, slow(a, b)) for a, b in out] + [(b, a, slow(b, a)) for a, b in out[::7]]


@pytest.mark.parametrize("batch", [1 << 22, 500])
def test_many_pairs(pairs, monkeypatch, batch):
    monkeypatch.setattr(D, "BATCH_CHARS", batch)
    assert D.distances([a for a, _, _ in pairs], [b for _, b, _ in pairs]) == [d for _, _, d in pairs]


def test_many_pairs_of_many_characters(pairs, monkeypatch):
    monkeypatch.setattr(D, "DENSE", 0)  # places of characters are found by sorting
    assert D.distances([a for a, _, _ in pairs], [b for _, b, _ in pairs]) == [d for _, _, d in pairs]


def test_long_texts_are_not_tabled(pairs, monkeypatch):
    monkeypatch.setattr(D, "BATCH_TEXT", 40)
    assert D.distances([a for a, _, _ in pairs], [b for _, b, _ in pairs]) == [d for _, _, d in pairs]


def test_near(pairs):
    long_ = [(a, b, d) for a, b, d in pairs if min(len(a), len(b)) > D.NEAR]
    assert D.near_distances([a for a, _, _ in long_], [b for _, b, _ in long_]).tolist() == [d if d <= D.NEAR else -1 for _, _, d in long_]
    assert D.near_distances([], []).tolist() == []


@pytest.mark.parametrize("most", [1, 2, 7, 31, 60])
def test_bands(pairs, most):
    for a, b, d in pairs:
        if min(len(a), len(b)) > most:
            found = D.band_distance(a, b, most)
            assert found == d if d <= most else found > most


def test_far_pairs():
    assert D.distance("a" * 3000, "b" * 2990) == 3000
    assert D.distance("ab" * 20_000, "ba" * 20_000) == 2
    assert D._full("kitten", "sitting") == 3 and D._full("", "abc") == 3


def test_nulls():
    assert D.distances([None, "a", None, "", "x"], ["a", None, None, "", ""]) == [None, None, None, 0, 1]
