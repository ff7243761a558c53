"""Conversations as training text, formatted and read back with Spark expressions only.

A turn is written as start mark, role, line end, text, end mark, line end. Texts of adjacent turns with one role are
merged into one turn, a mark between them, so that the turns can be told apart again. Backslashes and the beginning of
marks inside texts are escaped, so no text can pass for a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import shuffle_partitions, stored

# The template.
START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
_OPEN, _ESCAPED_OPEN = "<|", "<\\|"

#: Turns with numbers in one stretch of this length are collected together, but no more than as many.
STRETCH = 1024


def escape(text: Column) -> Column:
    """Backslashes doubled, then a backslash put into each beginning of a mark."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_OPEN), F.lit(_ESCAPED_OPEN))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """Undoes :func:`escape`: what stands between doubled backslashes has single ones before marks only."""
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\|"), F.lit("|"))), "\\")


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    plain = lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(parts, plain), "\\")


_FIRST = -(1 << 62)


def _in_parts(turns: DataFrame) -> DataFrame:
    """``turns`` with ``part``: the stretch of its number, and a place in the stretch if that has over ``STRETCH`` turns.

    The turns of such stretches, of null or repeated numbers, are dealt out in ranges of number, role and text, equal
    ones in bundles of ``STRETCH`` at most, and counted within each range.
    """
    turns = turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(_FIRST)))
    counts = turns.groupBy("conv_id", "stretch").agg(F.count("*").alias("n"))
    full = stored(counts.filter(F.col("n") > STRETCH).select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch")))
    part = lambda run, piece: F.struct("stretch", run.cast("long").alias("run"), piece.cast("long").alias("piece"))
    columns = ["conv_id", "turn", "role", "text"]
    if full.isEmpty():
        return turns.select(*columns, part(F.lit(0), F.lit(0)).alias("part"))
    of_full = turns["conv_id"].eqNullSafe(full["_conv"]) & (turns["stretch"] == full["_stretch"])
    few = turns.join(full, of_full, "left_anti").select(*columns, part(F.lit(0), F.lit(0)).alias("part"))
    order = ["conv_id", "stretch", "turn", "role", "text"]
    equal = turns.join(full, of_full, "left_semi").groupBy(*order).agg(F.count("*").alias("n"))
    bundle = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH)))
    bundles = equal.withColumn("bundle", bundle).withColumn("n", F.least(F.lit(STRETCH), F.col("n") - F.col("bundle") * STRETCH))
    dealt = stored(
        bundles.repartitionByRange(shuffle_partitions(turns.sparkSession), *order, "bundle").withColumn("run", F.spark_partition_id())
    )
    before = Window.partitionBy("conv_id", "stretch", "run").orderBy("turn", "role", "text", "bundle")
    piece = F.floor((F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - 1) / STRETCH)
    many = dealt.withColumn("part", part(F.col("run"), piece)).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return few.unionByName(many.select(*columns, "part"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row for each stretch of a conversation: ``conv_id``, ``part``, ``formatted``.

    The parts of a conversation, joined in order, are its formatted text. Turns go by ``turn`` (null first), equal ones
    by role and text. Takes ``conv_id``, ``turn``, ``role`` and ``text`` and leaves other columns out. A null text or
    role is empty; a null ``conv_id`` is a conversation like others; an empty table gives no rows.

    A part, a struct that is ordered, holds turns whose numbers lie in one stretch of ``STRETCH``; a stretch with more
    turns than that, as many have no number or the same, is cut into further parts of under twice as many. So even a
    conversation with a large share of all turns is sorted, merged and joined in pieces. Where a part's neighbour has
    the same role at the seam, the turn goes on there.
    """
    turns = _in_parts(turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ))
    sorted_ = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # First turn of each run of one role, and how many turns it has.
    begins = F.filter(
        F.sequence(F.lit(1), F.size("t")),
        lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    runs = sorted_.withColumn("b", begins).withColumn(
        "runs",
        F.transform(
            "b",
            lambda i, k: F.struct(
                F.element_at("t", i)["role"].alias("role"),
                F.slice("t", i, F.coalesce(F.get("b", k + 1), F.size("t") + 1) - i).alias("turns"),
            ),
        ),
    )
    seam = Window.partitionBy("conv_id").orderBy("part")
    joined = runs.select(
        "conv_id", "part", "runs",
        F.coalesce(F.lag(F.element_at("runs", -1)["role"]).over(seam) == F.element_at("runs", 1)["role"], F.lit(False)).alias("goes_on"),
        F.coalesce(F.lead(F.element_at("runs", 1)["role"]).over(seam) == F.element_at("runs", -1)["role"], F.lit(False)).alias("stays_open"),
    )

    def written(run: Column, k: Column) -> Column:
        head = F.when((k == 0) & F.col("goes_on"), F.lit(NEXT)).otherwise(
            F.concat(F.lit(START), escape_role(run["role"]), F.lit("\n"))
        )
        texts = F.array_join(F.transform(run["turns"], lambda t: escape(t["text"])), NEXT)
        tail = F.when((k == F.size("runs") - 1) & F.col("stays_open"), F.lit("")).otherwise(F.lit(f"{END}\n"))
        return F.concat(head, texts, tail)

    return joined.select("conv_id", "part", F.array_join(F.transform("runs", written), "").alias("formatted"))


def whole(parts: DataFrame) -> DataFrame:
    """``conv_id`` and its whole ``formatted`` text, from its parts; a conversation is one string from here on."""
    in_order = F.sort_array(F.collect_list(F.struct("part", "formatted")))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda p: p["formatted"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """Array of ``role`` and ``text`` of all turns in a formatted text, merged ones taken apart."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.length(block))
        line = F.instr(body, F.lit("\n"))
        role = unescape_role(F.substring(body, F.lit(1), line - 1))
        texts = F.split(F.substring(body, line + 1, F.length(body)), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_texts(turns: Column) -> Column:
    """Texts under the loss mask: the assistant's, without marks."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(loss_texts(F.col("turns")), "")
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_text(turns: DataFrame) -> DataFrame:
    """All conversations and one, -1, whose texts hold the template's own marks."""
    text = f"{END}{START}assistant ok"
    extra = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


#: The contract's rows in DuckDB, but for the template's length, which is worked out from the texts.
SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'
), s AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
           length(text) + length(text) - length(replace(text, chr(92), ''))
           + (length(text) - length(replace(text, '<|', ''))) // 2 AS n,
           length(role) + length(role) - length(replace(role, chr(92), '')) + length(role) - length(replace(role, chr(10), ''))
           + (length(role) - length(replace(role, '<|', ''))) // 2 AS r
    FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN before = role THEN {len(NEXT)} ELSE {len(START) + 1 + len(END) + 1} + r END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
