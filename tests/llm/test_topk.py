"""Exact neighbours against all products, with ties, copies and bad vectors."""

import math
import random

from trailmark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k):
    good = [
        (i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "VECTORS", 64)
    monkeypatch.setattr(topk, "_SLICE", 32)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) + (j == i % 3) * 2 for j in range(20)], i) for i in range(400)]
    rows += [(400 + i, rows[5][1], 0) for i in range(60)]
    rows += [(500, None, 0), (505, [], 0), (510, [float("nan")] * 20, 0), (515, [None] + [1.0] * 19, 0), (520, [float("inf")] * 20, 0)]
    rows += [(None, rows[0][1], 0), (525, [0.0] * 20, 0), (530, [1.0, 2.0], 0), (535, [3.0, -2.0], 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = topk.top_k(table, table.filter("vec_id % 5 = 0"), 7).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 7)


def test_scores_of_any_size(spark):
    """Products around 2 ** 53, 2 ** 63 and beyond are exact, or end where a long does."""
    ends = (-(1 << 63), (1 << 63) - 1)
    rng = random.Random(8)
    for size in (1e3, 2.0**20, 2.0**21, 2.0**25, 2.0**26, 2.0**40, 1e200):
        rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(40)]
        rows += [(40 + i, [rows[i][1][0] + 1 / 64, *rows[i][1][1:]]) for i in range(8)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
        want = []
        for q, a in good:
            if q % 5 == 0:
                clipped = lambda b: min(max(sum(x * y for x, y in zip(a, b)), ends[0]), ends[1])  # noqa: B023, E731
                scored = sorted((-clipped(b), i) for i, b in good if i != q)
                want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:4])]
        got = topk.top_k(table, table.filter("vec_id % 5 = 0"), 4).collect()
        assert sorted(map(tuple, got)) == sorted(want), size


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(table, table).count() == 0


def test_values_do_not_gather_for_a_number(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(20)], SCHEMA)
    plan = topk.top_k(table, table.filter("vec_id % 5 = 0"), 3)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    numbering = [i for i, line in enumerate(plan) if "windowspecdefinition(number#" in line]
    assert numbering
    for i in numbering:
        below = [line for line in plan[i + 1 :]]
        end = next((j for j, line in enumerate(below) if depth(line) <= depth(plan[i])), len(below))
        assert end and not any("values#" in line.split("parquet")[0] for line in below[:end] if "Relation" not in line)
        assert any("Project [number#" in line for line in below[:end])
