"""Mixing of sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import stored

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"
#: First digits of a document's hash that name its cell. A source's cells are taken whole but for one.
_CELL = 3


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def water_filling(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``target`` for rows of ``source`` and ``source_size``.

    Sources in the order of their names (by code point, null last) get the ``weights`` in turn. All sizes together are
    shared by weight; a source whose share exceeds ``epochs`` times its size is clamped there and the excess shared
    among the others, until none is above. That ends in one level: in the order of size to weight the first sources
    are clamped, and all others get the level times their weight. One pass in that order finds it, over a row for each
    source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.lit(epochs) * F.col("source_size")
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    # If all sources before this one are clamped, this is the level for it and the rest.
    levels = weighed.select(
        "*", F.row_number().over(by_need).alias("turn"), (left / F.sum("weight").over(after)).alias("level")
    )
    fits = F.col("level") * F.col("weight") <= cap
    first = F.min(F.when(fits, F.struct("turn", "level"))).over(Window.partitionBy())
    share = F.col("first.level") * F.col("weight")
    clamped = F.col("first").isNull() | (F.col("turn") < F.col("first.turn"))
    return levels.withColumn("first", first).select(
        "source", "source_size", F.when(clamped, cap.cast("double")).otherwise(share).alias("target")
    )


def _hash(seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _key() -> Column:
    """The source's name for joins, where null has one too."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` with ``size`` (words), ``source_size``, ``target`` (see :func:`water_filling`), ``taken``.

    ``taken`` is how many words the mix takes of the document, repeats counted: every document whole, as often as the
    target holds its source whole, and for the rest documents in the order of a seeded hash, whole, until the target
    is reached; of the one that reaches it, as many words as are missing. So a source's taken words are its target,
    rounded, and no document exceeds ``epochs`` times its size. The same seed, rows and ids give the same mix, whatever
    the partitions. Columns of ``docs`` with the names added here are replaced.

    Null text has size 0 and null is a source like others; rows with equal ids, or with none, go by size. An empty
    table gives no rows.

    Documents are not sorted and no source gathers in a task: sums by source and hash cell tell which cells are taken
    whole, and only documents of the one cell of each source that is not are put in order. The plan has a row for each
    source; Spark broadcasts it while it is small.
    """
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    # The row travels as one struct, so its columns may have any names.
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    sized = docs.select(
        row, "source", word_count().alias("size"), _key().alias("_key"), _hash(seed).alias("_hash")
    ).withColumn("_cell", F.substring("_hash", 1, _CELL))
    cells = stored(sized.groupBy("_key", "source", "_cell").agg(F.sum("size").alias("cell_size")))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(epochs))).otherwise(0).cast("long")
    plan = (
        water_filling(sources, weights, epochs)
        .withColumn("_key", _key())
        .drop("source")
        .withColumn("_whole", whole)
        .withColumn("_rest", F.round("target").cast("long") - F.col("_whole") * size)
    )
    so_far = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    begun = cells.withColumn("_begin", F.coalesce(F.sum("cell_size").over(so_far), F.lit(0)))
    # The cell in which the rest of the target ends; cells before it are taken whole.
    edge = (
        begun.join(plan, "_key")
        .filter("_begin <= _rest AND _rest < _begin + cell_size")
        .select("_key", F.col("_cell").alias("_edge"), "_begin")
    )
    planned = sized.drop("source").join(stored(plan.join(edge, "_key", "left")), "_key")
    at_edge = F.coalesce(F.col("_cell") == F.col("_edge"), F.lit(False))
    own = F.col("size")
    # Without such a cell the rest is nothing, or all there is.
    more = F.when(F.coalesce(F.col("_cell") < F.col("_edge"), F.col("_rest") >= size), own).otherwise(0)
    order = Window.partitionBy("_key").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col("_rest") - F.col("_begin") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(own, missing))
    out = [*[F.col(f"row.`{c}`").alias(c) for c in names], "size", "source_size", "target"]
    taken = lambda extra: (F.col("_whole") * own + extra).cast("long").alias("taken")
    return planned.filter(~at_edge).select(*out, taken(more)).unionByName(
        planned.filter(at_edge).withColumn("_part", part).select(*out, taken(F.col("_part")))
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each time a document of :func:`mixture` is taken, the last one cut to the words taken.

    ``text`` of a cut row keeps its first words, up to the last one taken, with the white space between them.
    """
    size, text = F.col("row.size"), F.col("row.text")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    row = F.struct(*[F.col(f"`{c}`") for c in mixed.columns]).alias("row")
    rows = mixed.filter("taken > 0").select(row, F.explode(F.sequence(F.lit(1), times)).alias("time"))
    words = F.least(size, F.col("row.taken") - (F.col("time") - 1) * size)
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(words == size, text).otherwise(F.array_join(F.slice(parts, F.lit(1), words.cast("int")), ""))
    return rows.select(*[(cut if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in mixed.columns])


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB.
SQL = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size,
           md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS hash
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sized GROUP BY source
), ordered AS (
    SELECT *, row_number() OVER need AS turn,
           (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (need ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM sources WINDOW need AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), first_free AS (
    SELECT min(turn) AS turn, arg_min(level, turn) AS level FROM ordered WHERE level * weight <= 3 * source_size
), targets AS (
    SELECT o.source, source_size,
           CASE WHEN f.turn IS NULL OR o.turn < f.turn THEN (3 * source_size)::DOUBLE ELSE f.level * weight END AS target
    FROM ordered o CROSS JOIN first_free f
), plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM targets
), begun AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY hash, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
    FROM sized
)
SELECT b.doc_id, b.size, p.source_size, p.target,
       (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - begin)))::BIGINT AS taken
FROM begun b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source
"""
