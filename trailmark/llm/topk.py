"""Exact nearest vectors by inner product, with bounds from segment means and deviations.

For a segment of ``n`` components with means ``m`` and deviations ``s`` of both vectors, the squared distance is at
least ``n * ((m_q - m_x) ** 2 + (s_q - s_x) ** 2)``. As the inner product is half of the squared lengths less the
squared distance, this lower bound of the distance is an upper bound of the product: the sum over segments of
``n * (m_q * m_x + s_q * s_x)``. More, shorter segments come closer. Vectors whose bound is below the k-th best product
found so far are left, first at few segments, then at many; exact products decide about the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import in_runs, shuffle_partitions, stored

SCALE = 64
#: Segments of each level, coarse to fine.
LEVELS = (1, 4, 16)
#: Queries, and vectors, that meet in a block.
QUERIES, VECTORS = 512, 8192
_SLICE = 1024
_FIELDS = "block int, is_query boolean, ids binary, values binary"


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component, as doubles; null unless all are finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    # Doubles from 2 ** 53 on are whole numbers; a long could not hold them all.
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & (F.size(vector) > 0), F.transform(numbers, lambda x: whole(x * scale)))


def _lengths(values: np.ndarray) -> np.ndarray:
    """Lengths of rows, a little too large rather than too small."""
    most = np.abs(values).max(1, initial=1.0)
    return most * np.sqrt(((values / most[:, None]) ** 2).sum(1)) * (1 + 1e-12)


def segment_statistics(values: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose products bound the products of rows of ``values``: scaled means and deviations of each segment."""
    parts = np.array_split(values, min(segments, values.shape[1]), axis=1)
    means = [p.mean(1) * np.sqrt(p.shape[1]) for p in parts]
    deviations = [p.std(1) * np.sqrt(p.shape[1]) for p in parts]
    return np.stack([*means, *deviations], 1)


def _products(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Integer products of rows that hold whole numbers; ``lengths`` bounds them.

    Doubles hold them below 2 ** 53, long integers below 2 ** 63; beyond, Python's integers do, and what a long can't
    hold counts as the nearest it can.
    """
    most = lengths.max(initial=0.0)
    if most < 1 << 52:
        return (a @ b.T).astype(np.int64)
    if most < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in side] for side in (a, b)]
    ends = np.iinfo(np.int64)
    return np.array(
        [[min(max(sum(map(int.__mul__, x, y)), ends.min), ends.max) for y in whole[1]] for x in whole[0]], np.int64
    ).reshape(len(a), len(b))


class _Best:
    """The ``k`` best of each query so far: highest score, then smallest id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int) -> None:
        self.ids, self.values, self.k = ids, values, k
        self.levels = [segment_statistics(values, n) for n in LEVELS]
        self.lengths = _lengths(values)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)
        self.found_ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.found: list[np.ndarray] = [np.empty(0, np.int64)] * len(ids)
        self.bar = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, values: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(ids), _SLICE):
                self._meet(ids[at : at + _SLICE], values[at : at + _SLICE])

    def _meet(self, ids: np.ndarray, values: np.ndarray) -> None:
        open_ = self.ids[:, None] != ids[None, :]
        lengths = self.lengths[:, None] * _lengths(values)[None, :]
        slack = 1e-9 * lengths + 1e-6  # for rounding
        for own, n in zip(self.levels, LEVELS):
            if not np.isneginf(self.bar).all():
                # A bound that doubles can't hold excludes nothing.
                open_ &= ~(own @ segment_statistics(values, n).T + slack < self.bar[:, None])
        rows = np.flatnonzero(open_.any(1))
        columns = np.flatnonzero(open_.any(0))
        if not len(rows):
            return
        wanted = open_[np.ix_(rows, columns)]
        scores = _products(self.values[rows], values[columns], lengths[np.ix_(rows, columns)])
        for q, line, may in zip(rows.tolist(), scores, wanted):
            good = np.flatnonzero(may & (line >= self.least[q]))
            if not len(good):
                continue
            score = np.concatenate([self.found[q], line[good]])
            name = np.concatenate([self.found_ids[q], ids[columns[good]]])
            order = np.lexsort((name, ~score))[: self.k]
            self.found[q], self.found_ids[q] = score[order], name[order]
            if len(order) == self.k:
                self.least[q] = self.found[q][-1]
                # As a double, not above the score.
                self.bar[q] = np.nextafter(float(self.found[q][-1]), -np.inf)


def _packed(rows: int) -> Callable:
    """Vectors in blocks; ``number`` says which row of the table a vector is among its kind in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column("v").to_pylist()
                by_length: dict[int, list[int]] = {}
                for i, x in enumerate(lists):
                    by_length.setdefault(len(x), []).append(i)
                ids = part.column("vec_id").to_numpy()
                for n, rows_of in by_length.items():
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dims": pa.array([n], pa.int32()),
                            "ids": [ids[rows_of].astype(np.int64).tobytes()],
                            "values": [np.array([lists[i] for i in rows_of], np.float64).astype("<f8").tobytes()],
                        }
                    )

    return run


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None

        def result() -> pa.RecordBatch:
            counts = [len(x) for x in best.found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(best.ids, counts)),
                    pa.array(np.concatenate(best.found_ids)),
                    pa.array(np.concatenate(best.found)),
                ],
                names=["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                values = np.frombuffer(row["values"], "<f8").reshape(len(ids), -1)
                if row["is_query"]:
                    if best is not None:
                        yield result()
                    best = _Best(ids, values, k)
                else:
                    best.meet(ids, values)
        if best is not None:
            yield result()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE) -> DataFrame:
    """The ``k`` vectors with the highest integer inner product for each query, itself left out.

    Both tables have ``vec_id`` (long) and ``embedding`` (array of numbers), of which :func:`integers` makes whole
    numbers; other columns are left out. Vectors that are null, empty, or hold null or non-finite components take no
    part, nor do rows without id; vectors of different lengths don't meet. Returns ``query_id``, ``rank`` from 1,
    ``vec_id`` and ``score``; equal scores go to the smaller id. Scores are exact; those that a long can't hold count
    as the nearest that it can. A query gets fewer rows if there are fewer vectors;
    rows that repeat an id are candidates each. Empty tables give no rows.

    All queries meet all vectors, in blocks: a block of vectors goes once to each block of queries, which keeps only
    the ``k`` best of each query. Query blocks grow in number with the table, so does the work, as the exact answer of
    a stated set of queries needs; nothing is broadcast, and blocks are of fixed size whatever the vectors are.
    """
    spark = vectors.sparkSession
    prepared = lambda df: df.select("vec_id", integers(F.col("embedding"), scale).alias("v")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL"
    )
    blocks = "dims int, ids binary, values binary"
    asked = stored(
        prepared(queries)
        .repartition(max(1, -(-queries.count() // QUERIES)))
        .mapInArrow(_packed(QUERIES), blocks)
        .withColumn("number", F.monotonically_increasing_id())
    )
    held = stored(prepared(vectors).mapInArrow(_packed(VECTORS), blocks))
    n_blocks = Window.orderBy("number")
    # One task sees a number for each block of queries, not the values.
    blocks_of_queries = asked.select("number").withColumn("block", (F.row_number().over(n_blocks) - 1).cast("int"))
    numbered = asked.join(blocks_of_queries, "number")
    count = asked.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # A few groups of vector blocks for each query block, so that all cores have work.
    groups = max(1, -(-shuffle_partitions(spark) // count))
    spread = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    questions = numbered.select("dims", "block", spread.alias("part"), F.lit(True).alias("is_query"), "ids", "values")
    answers = (
        held.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
        .join(numbered.select("dims", "block"), "dims")
        .select("dims", "block", "part", F.lit(False).alias("is_query"), "ids", "values")
    )
    met = questions.unionByName(answers).withColumn("cell", F.col("block") * groups + F.col("part"))
    dealt = in_runs(met, "cell", count * groups).sortWithinPartitions("cell", F.desc("is_query"))
    found = dealt.select("is_query", "ids", "values").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


#: The contract's rows in DuckDB.
SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
