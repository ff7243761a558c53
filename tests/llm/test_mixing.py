"""Targets against the sharing rule done step by step, and what the mix takes."""

from collections import defaultdict

import pytest

from trailmark.llm import mixing


def shared_out(sizes, weights, epochs):
    """Share, clamp, and share the excess again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in clamped]
        rest = total - sum(clamped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > epochs * sizes[s]]
        if not above:
            return clamped | share
        clamped.update((s, epochs * sizes[s]) for s in above)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 3, "é": 7, "z": 40, None: 1}, {"a": 5}, {"a": 0, "b": 10}, {"a": 9, "b": 9, "c": 9, "d": 1000}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = shared_out(sizes, mixing.WEIGHTS, mixing.EPOCHS)
    assert {r.source: r.target for r in mixing.water_filling(table).collect()} == {s: pytest.approx(t) for s, t in want.items()}


def test_mixture(docs, rows, no_docs):
    mixed = mixing.mixture(docs).collect()
    assert len(mixed) == len(rows)
    by = defaultdict(list)
    for r in mixed:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for found in by.values():
        assert sum(r.size for r in found) == found[0].source_size
        assert sum(r.taken for r in found) == pytest.approx(found[0].target, abs=0.51)
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))
    assert mixing.mixture(no_docs).count() == 0


HELPERS = ("_key", "_hash", "_cell", "_whole", "_rest", "_begin", "_edge", "_part", "_time", "row", "time", "level", "a.b", "Size", "taken")


def test_columns_of_any_name(docs):
    """Names that the operator uses inside are kept as they are, or replaced if it adds them."""
    wide = docs
    for name in HELPERS:
        wide = wide.withColumn(name, docs.lang)
    plain = sorted(str((r.doc_id, r.size, r.taken)) for r in mixing.mixture(docs).collect())
    mixed = mixing.mixture(wide)
    found = mixed.collect()
    assert sorted(str((r.doc_id, r.size, r.taken)) for r in found) == plain
    kept = [name for name in HELPERS if name not in ("Size", "taken")]
    assert [c for c in mixed.columns if c in HELPERS] == [*kept, "taken"]
    assert all(r[name] == r.lang for r in found for name in kept)
    copies = mixing.repeated(mixed).collect()
    assert copies and all(r[name] == r.lang for r in copies for name in kept)


def test_repeats_hold_the_words_taken(docs):
    mixed = mixing.mixture(docs).cache()
    copies = mixing.repeated(mixed)
    want = sum(r.taken for r in mixed.collect())
    assert copies.select(mixing.word_count().alias("n")).groupBy().sum("n").first()[0] == want
    mixed.unpersist()
