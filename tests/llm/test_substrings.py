"""Repeated windows against a brute-force count of all windows."""

import hashlib

import pytest

from trailmark.llm import substrings


def brute_force(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_cover_reaches_every_pair_of_residues():
    p = substrings.PERIOD
    assert {(a - b) % p for a in substrings.COVER for b in substrings.COVER} == set(range(p))


@pytest.mark.parametrize("window", [22, 35])
def test_equals_brute_force(docs, rows, window):
    want = [(r[0], *x) for r, x in zip(rows, brute_force([r[1] for r in rows], window))]
    got = [tuple(r) for r in substrings.digest(substrings.without_repeats(docs, window)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(0 < w[2] < w[1] for w in want)


def test_empty_table_and_small_window(no_docs, docs):
    assert substrings.without_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        substrings.without_repeats(docs, substrings.PERIOD)
