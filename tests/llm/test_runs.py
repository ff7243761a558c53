"""Periodic runs against a search of all periods at all places."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hard_texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import runs
from trailmark.llm.queries import op13_lyndon_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(values, exponent=runs.EXPONENT, length=runs.LENGTH):
    """For each period the maximal stretches that have it, unless a shorter one has them too."""
    n, found = len(values), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and values[j] == values[j + p]:
                j += 1
            if j > i and j - i + p >= max(length, exponent * p):
                if not any(q < p and all(values[k] == values[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                    found.append((i, j - i + p, p))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_all_runs_of_two_periods(values):
    assert [tuple(r) for r in runs.runs_of(values, 2, 2)] == plain_runs(values, 2, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([(1, 0), (1, 1), (2, 1), (0, 1, 2), (0, 0, 1), (5,), (6, 7, 8, 9)]), max_size=20), st.data())
def test_words_of_documents(parts, data):
    """Repeated parts beside each other; the stretches left out hold no run."""
    words = []
    for part in parts:
        words += [str(x) for x in part] * data.draw(st.integers(1, 6))
    assert [tuple(r) for r in runs.document_runs(words)] == plain_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_extensions_and_ranks(values):
    tree, n = runs.SuffixTree(values), len(values)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
    marked = [*values, -1]

    def plain(x, y):
        if x == y:
            return n + 1 - x
        k = 0
        while x + k < n and y + k < n and values[x + k] == values[y + k]:
            k += 1
        return k

    assert tree.extension(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
    assert np.argsort(tree.rank).tolist() == sorted(range(n + 1), key=lambda i: marked[i:])
    opposite = [-v for v in values] + [-10]
    assert np.argsort(tree.rank_descending).tolist() == sorted(range(n + 1), key=lambda i: opposite[i:])


def test_least_values_between_places():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 300, 5000):
        values = rng.integers(0, 1000, n)
        a, b = np.sort(rng.integers(0, n, (2, 400)), 0)
        assert runs._Least(values).between(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b)]


def test_long_sequences():
    rng = random.Random(2)
    base = [rng.randrange(5000) for _ in range(10_000)]
    assert runs.runs_of(base * 5 + base[:77]) == [(0, 50_077, 10_000)]
    assert runs.runs_of([7] * 100_000) == [(0, 100_000, 1)]
    # Fibonacci word: the richest in repeats.
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    values = [ord(c) - ord("a") for c in b]
    found = {r.period for r in runs.runs_of(values, 2, 2)}
    assert {1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610} <= found


def expected(doc_id, text, planted):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = (None,) * 4
    for s, length, q in found:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, *(sha256(x.encode()).hexdigest() for x in (lines, kept)))


@pytest.mark.parametrize("planted", [False, True])
def test_small_documents(spark, docs, rows, planted):
    odd = docs.withColumn("mark", docs.lang).withColumn("body", docs.source).withColumn("n_runs", docs.n_chars)
    found = sorted(str(tuple(r)[:8]) for r in runs.collapsed(odd, planted).collect())
    short = [r for r in rows if len(r[1] or "") < 4000]
    mine = sorted(str(expected(r[0], r[1], planted)) for r in short)
    assert len(found) == len(rows) and not set(mine).difference(found)


def test_runs_as_rows(spark):
    texts = ["a b a b a b a b a x", "no run here", None, "", "l1 l2\n" * 5 + "end " + "w " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(tuple(r) for r in runs.find_runs(df).collect())
    assert found == [(0, 0, 9, 2), (4, 0, 10, 2), (4, 11, 9, 1)]


def test_white_space_and_odd_characters(spark):
    """Only ASCII white space parts words."""
    text = "\x1c a b \x1c a b\t\x1c a b\n\x1c\x0ba b\x0c"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in runs.find_runs(df).collect()] == [(1, 0, 8, 2)]


def test_no_documents(spark, no_docs):
    assert runs.collapsed(no_docs).count() == 0 and runs.find_runs(no_docs).count() == 0


def test_very_long_text(spark):
    text = prose(random.Random(1), 20_000) + " " + "x y z " * 30_000 + prose(random.Random(2), 20_000)
    df = spark.createDataFrame([(None, text)], "doc_id long, text string")
    row = runs.collapsed(df, planted=True).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 20_000, 90_000, 3)
    assert row["n_kept"] == 40_003


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    given_rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[:8] for r in op13_lyndon_runs(spark, sf).collect()}
    assert len(found) == len(given_rows)
    for r in given_rows:
        if len(r["text"] or "") < 6000:
            assert found[r["doc_id"]] == expected(r["doc_id"], r["text"], True)
    assert sum(r[1] > 0 for r in found.values()) > 5
