"""Sketches: edited texts and neighbours against plain Python, and how well they estimate."""

import base64
import hashlib
import random

import numpy as np
import pytest

from hard_texts import prose
from trailmark.llm import fingerprints as fp
from trailmark.llm.shared import Windows, WordHashes


def kept(text, fraction=fp.FRACTION):
    return fp.sketch(text.encode(), 5, fraction, WordHashes(), Windows())


def read(text):
    return np.frombuffer(base64.b64decode(text), np.uint64)


def test_edited_texts_and_neighbours(docs, rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    whole = lambda text: fp.shingles(WordHashes().of(text.encode().lower().split()), 5, Windows())
    kept = lambda text: fp.fingerprint(whole(text), fp.FRACTION)
    want = []
    for row, after in zip(order, [*order[1:], order[0]]):
        text, following = row[1] or "", after[1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = kept(text), kept(edited), kept(following)
        want.append(
            (row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), a.tolist(), b.tolist(),
             fp.likeness(a, b), fp.likeness(a, c))
        )
    got = [
        (r.doc_id, r.n_chars, r.edited_sha256, read(r.fingerprint).tolist(), read(r.edited_fingerprint).tolist(),
         r.near_edited, r.near_next)
        for r in fp.compare_with_next(docs).collect()
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_small_tables(spark, no_docs):
    assert fp.compare_with_next(no_docs).count() == 0
    (row,) = fp.compare_with_next(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert row.near_next == 1.0
    (row,) = fp.compare_with_next(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert (row.n_chars, row.fingerprint, row.near_edited, row.near_next) == (0, "", 1.0, 1.0)


def test_estimates_come_near_the_truth():
    rng = random.Random(1)
    small, large = prose(rng, 2000), prose(rng, 30000)
    whole = f"{large} {small}"
    a, b = kept(small), kept(whole)
    assert fp.containment(a, b) > 0.98
    assert fp.containment(b, a) == pytest.approx(2000 / 32000, abs=0.02)
    half = " ".join(small.split()[:1000])
    assert fp.similarity(a, kept(half)) == pytest.approx(0.5, abs=0.08)
    assert np.array_equal(fp.merge(a, kept(large)), np.union1d(a, kept(large)))


def test_only_hashes_below_the_threshold_so_sketches_merge():
    rng = random.Random(4)
    limit = np.uint64(int(fp.FRACTION * (1 << 64)))
    text = prose(rng, 5000)
    whole, words = kept(text), text.split()
    estimates, unbiased = [], []
    for _ in range(490):
        i = rng.randrange(4990)
        part = kept(" ".join(words[i : i + 8]))
        merged = fp.merge(whole, part)
        assert np.array_equal(merged, whole) and (merged < limit).all()
        estimates.append(fp.containment(part, whole))
        unbiased.append(fp.containment(part, kept(prose(rng, 5000))))
    # Contained wherever the part has a hash; without one nothing is said.
    known = [x for x in estimates if x == x]
    assert set(known) == {1.0} and 0.2 < len(known) / 490 < 0.8
    assert {x for x in unbiased if x == x} <= {0.0, 1 / 2, 1 / 3, 1.0}
    # Documents whose shingles are disjoint: the sketch of both is the union.
    a, b = kept("a1 a2 a3 a4 a5 a6 a7"), kept("b1 b2 b3 b4 b5 b6 b7")
    shingles = [fp.shingles(WordHashes().of(x.encode().split()), 5, Windows()) for x in ("a1 a2 a3 a4 a5 a6 a7", "b1 b2 b3 b4 b5 b6 b7")]
    assert np.array_equal(fp.merge(a, b), fp.below(np.union1d(*shingles), fp.FRACTION))


def test_equal_and_unequal_short_texts():
    of = lambda text: fp.fingerprint(fp.shingles(WordHashes().of(text.split()), 5, Windows()), fp.FRACTION)
    assert fp.likeness(of(b"a b c"), of(b"a b c")) == 1.0
    assert fp.likeness(of(b"a b c"), of(b"a b d")) == 0.0
    assert fp.likeness(of(b""), of(b"")) == 1.0 and fp.likeness(of(b""), of(b"a")) == 0.0


def test_sketch_operator_and_merge(docs, rows):
    sketches = fp.sketch_documents(docs)
    assert sketches.count() == len(rows)
    (merged,) = sketches.groupBy().agg(fp.merge_sketches("sketch").alias("s")).collect()
    want = set()
    for r in rows:
        want.update(kept(r[1] or "").view(np.int64).tolist())
    assert merged.s == sorted(want)


@pytest.mark.parametrize(("n", "stated"), [(12, 0.39), (24, 0.30), (44, 0.19), (100, 0.12), (200, 0.08), (500, 0.06), (2000, 0.02)])
def test_error_by_length_is_as_stated(n, stated):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(10**6)}"
    squares, expected = [], []
    for _ in range(300 if n < 1000 else 60):
        a = [word() for _ in range(n)]
        b = a[: n - n // 3] + [word() for _ in range(n // 3)]
        sets = [[kept(" ".join(x), fraction) for x in (a, b)] for fraction in (1.0, fp.FRACTION)]
        truth, estimate = (fp.similarity(*pair) for pair in sets)
        squares.append((estimate - truth) ** 2)
        expected.append(fp.standard_error(truth, len(fp.merge(*sets[0]))))
    error = np.mean(squares) ** 0.5
    assert error == pytest.approx(stated, rel=0.25, abs=0.01)
    assert error == pytest.approx(np.mean(expected), rel=0.3)
