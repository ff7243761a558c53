"""Groups of similar documents against all pairs."""

import os
import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from hard_texts import prose
from trailmark.llm import components, jaccard
from trailmark.llm.shared import giving_back


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_force(rows, n, percent):
    sets = [shingle_set(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if r[0] is not None:
            ids.append(r[0])
    return sorted((repr((r[0], len(s), min(least[find(i)], default=None))) for i, (r, s) in enumerate(zip(rows, sets))))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_hard_rows(docs, rows, n, percent):
    assert got(jaccard.similar_groups(docs, n, percent)) == brute_force(rows, n, percent)


def near_copies(seed):
    """Chains and crowds of near copies around the threshold, a passage that many share, and frequent n-grams."""
    rng = random.Random(seed)
    out, common = [], prose(rng, 40)
    for _ in range(4):
        words = prose(rng, rng.choice([30, 80, 200])).split()
        for _ in range(45):
            w = list(words)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            out.append(" ".join(w))
            if rng.random() < 0.3:
                words = w
    out += [f"{common} {prose(rng, rng.randrange(1, 60))}" for _ in range(60)]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_around_the_threshold(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "_CELL", [512, 7][seed - 1])  # one cell a block, and many
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.similar_groups(df, 4, 85)) == brute_force(rows, 4, 85)


def test_rows_without_ids(spark):
    """Short texts, most without an id, some copies of each other: every row meets its own text only."""
    rng = random.Random(3)
    rows = [(None if i % 3 else i, prose(rng, 12)) for i in range(300)]
    rows += [(None, t) for _, t in rows[:40]] + [(5, t + " end") for _, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.similar_groups(df, 4, 85)) == brute_force(rows, 4, 85)


@pytest.mark.parametrize("left", [0, 3, 12])
def test_common_counts(left):
    rng = random.Random(left)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 30))], np.int64)) for _ in range(12)]
    owner = np.repeat(np.arange(12), [len(s) for s in sets])
    weight = np.array([rng.choice([1, 1, 5]) for _ in range(40)], np.int64)
    grams = np.concatenate(sets)
    counts = jaccard._common_counts(owner, grams, weight[grams], left, 12)
    assert counts.shape == (left, 12)
    for a in range(left):
        for b in range(a + 1, 12):
            assert counts[a, b] == weight[np.intersect1d(sets[a], sets[b])].sum()


def test_empty_table(no_docs):
    assert jaccard.similar_groups(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    df = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in df.collect()} == (
        {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)} | {(200, 200), (201, 200)}
    )


def test_first_grams_leave_no_overlap_that_suffices():
    for size in range(1, 200):
        k = jaccard.first_grams(size, 80)
        assert 100 * (size - k) < 80 * size <= 100 * (size - k + 1)


def test_parities_never_rule_out_a_link():
    """No bound is below what two sets share, whatever their sizes; it is near that for sets almost alike."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 3, 30, 31, 70, 900, 2000):
        base = rng.integers(1 << 63, size=size, dtype=np.uint64)
        for changed in (0, 1, size // 20, size // 3, size):
            other = rng.integers(1 << 63, size=changed + size // 9, dtype=np.uint64)
            sets.append(np.unique(np.r_[base[changed:], other] if changed < size else other))
    sets = [s for s in sets if len(s)]
    size = np.array([len(s) for s in sets])
    parities = [jaccard._parity(s) for s in sets]
    for left in (0, 4, len(sets)):
        most = jaccard._most_in_common(parities, size, left)
        assert most.shape == (left, len(sets))
        for a in range(left):
            shared = np.array([len(np.intersect1d(sets[a], s)) for s in sets])
            assert (most[a] >= shared).all()
            alike = 100 * shared >= 92 * np.maximum(size[a], size)
            assert (most[a][alike] <= shared[alike] + 0.03 * size[a]).all()


def test_whole_sets_are_moved_only_of_those_that_parities_let_through(spark, monkeypatch):
    """Texts that share their rarest n-grams, and with them enough to hope for a link, but too few of the others."""
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        words = [f"r{rng.randrange(10**9)}" for _ in range(300)]
        for _ in range(6):
            w = list(words)
            for at in rng.sample(range(0, 300, 5), 20):  # 80 of 297 n-grams
                w[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    rows = list(enumerate([*texts, texts[0] + " end"]))
    moved, real = {True: 0, False: 0}, jaccard._in_their_cells

    def counted(cells, docs, classes, words, whole):
        moved[whole] += cells.count()
        return real(cells, docs, classes, words, whole)

    monkeypatch.setattr(jaccard, "_in_their_cells", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.similar_groups(df, 4, 85)) == brute_force(rows, 4, 85)
    assert moved[False] > 20 > 4 >= moved[True] >= 2


def test_entries_are_shuffled_once(spark, monkeypatch):
    plans, real = [], jaccard.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(jaccard, "stored", noted)
    monkeypatch.setattr(jaccard, "shuffle_partitions", lambda _: 4)
    classes = real(spark.createDataFrame([(i, [i, i % 5 + 100, i % 3 + 200]) for i in range(40)], "node long, first array<long>"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        blocks, lists = jaccard._blocks(classes.selectExpr("node", "explode(first) as gram"))
        assert lists.count() == 40 and blocks.count() >= 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plans[0].count("REPARTITION_BY_COL") == plans[0].count("ReusedExchange") + 1 == 2


def test_frequent_n_grams_are_counted_without_copies(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64)) for _ in range(jaccard._GATHERED // 4000)]
    sets = [np.unique(np.r_[s, np.arange(i % 5, dtype=np.uint64)]) for i, s in enumerate(sets)]
    monkeypatch.setattr(jaccard, "_sets", lambda batches, words: [(None, list(sets))])
    tracemalloc.start()
    found = [r for batch in jaccard._frequent_in_tasks(5)([]) for r in batch.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = Counter(g for s in sets for g in s.tolist() if g < 5)
    assert {r["gram"]: r["n"] for r in found} == counts and min(counts.values()) == 100
    assert peak < 2 * 8 * jaccard._GATHERED  # the n-grams once, and less than as much again


@pytest.mark.parametrize("texts", [[], [""], ["a b"], ["a b", "a b"], ["a b", "a b", "A  b", "c"]])
def test_frequent_n_grams_of_few_texts(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    found = [r["n"] for out in jaccard._frequent_in_tasks(5)([batch]) for r in out.to_pylist()]
    assert found == ([3] if len(texts) == 4 else [])


def test_entries_meet_kept_columns_unsorted(spark):
    entries = spark.range(1000).selectExpr("id node", "id % 400 gram").repartition(5, "gram")
    kept = spark.range(300).selectExpr("id gram", "id least", "id weight")
    plan = jaccard._of_kept(entries, kept)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_free_memory_is_returned_at_the_end_of_a_task():
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    seen, pins = [], []

    def run(batches):
        blocks = [b"x" * 5000 for _ in range(40_000)]
        pins.extend(blocks[::200])  # what stays, also at the end, keeps the heap from shrinking by itself
        pins.append(blocks[-1])
        yield from batches
        del blocks
        seen.append(resident())

    assert list(giving_back(run)(iter([1, 2]))) == [1, 2]
    assert resident() < seen[0] - 100
