"""Merkle manifest of a table: three-way hash trees, kept as blocks in van Emde Boas order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import shuffle_partitions, stored

ARITY = 3
#: Levels that one block spans, so a block has at most ``ARITY ** HEIGHT`` leaves.
HEIGHT = 7
#: Columns of a leaf's hash, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIZE = 32


# One block.


def _above(nodes: int, levels: int = 1) -> int:
    """How many nodes lie so many levels above so many nodes."""
    return -(-nodes // ARITY**levels)


def levels_above(leaves: int) -> int:
    """Levels from so many leaves up to a single node."""
    found = 0
    while leaves > 1:
        leaves, found = _above(leaves), found + 1
    return found


@lru_cache(maxsize=4096)
def nodes_in(leaves: int, height: int) -> int:
    """Nodes of a tree with so many leaves and ``height`` levels, the leaves' one included."""
    return sum(_above(leaves, i) for i in range(height))


def address(leaves: int, height: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes of one level (leaves: 0) of a tree with ``height`` levels and one root, in van Emde Boas order.

    The tree is cut at half its height: the upper tree comes first, then each lower tree from left to right, all laid
    out the same way. Only the last lower tree can lack leaves, so the place follows from counts alone, and a node and
    its relatives lie close together at every scale, whatever the size of a cache line or of a read.
    """
    if height == 1:
        return np.zeros_like(index)
    low = height // 2
    high, tops, span = height - low, _above(leaves, low), ARITY ** (low - 1)
    if level >= low:
        return address(tops, high, level - low, index)
    each = ARITY ** (low - 1 - level)
    tree, inside = np.divmod(index, each)
    last = _above(leaves, low - 1) - 1
    within = np.where(
        tree < last,
        address(span, low, level, inside),
        address(leaves - last * span, low, level, inside),
    )
    return nodes_in(tops, high) + tree * nodes_in(span, low) + within


@lru_cache(maxsize=64)
def layout(leaves: int, levels: int) -> tuple[np.ndarray, ...]:
    """Places of all nodes of a block, level by level from the leaves."""
    return tuple(
        address(leaves, levels + 1, i, np.arange(_above(leaves, i), dtype=np.int64)) for i in range(levels + 1)
    )


def joined_hash(digests: Iterable[bytes]) -> bytes:
    """Hash of the digests' hex texts, one after another."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def build_block(leaves: list[bytes], levels: int) -> bytes:
    """All nodes over the given leaves, ``levels`` levels up, in their places."""
    places = layout(len(leaves), levels)
    nodes = np.empty((sum(map(len, places)), _SIZE), np.uint8)
    nodes[places[0]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, _SIZE)
    for below, own in zip(places, places[1:]):
        children = nodes[below].tobytes().hex()
        step = 2 * _SIZE * ARITY
        parents = [sha256(children[i : i + step].encode()).digest() for i in range(0, len(children), step)]
        nodes[own] = np.frombuffer(b"".join(parents), np.uint8).reshape(-1, _SIZE)
    return nodes.tobytes()


class Step(NamedTuple):
    """One level of a proof: the own place in the run, and the others of the run from left to right."""

    own: int
    others: tuple[bytes, ...]

    def fold(self, digest: bytes) -> bytes:
        return joined_hash([*self.others[: self.own], digest, *self.others[self.own :]])


class Block:
    """A stored block, read by address."""

    def __init__(self, nodes: bytes, leaves: int, levels: int) -> None:
        self._nodes, self._places, self.leaves = memoryview(nodes), [x.tolist() for x in layout(leaves, levels)], leaves

    def _node(self, place: int) -> bytes:
        return bytes(self._nodes[_SIZE * place : _SIZE * (place + 1)])

    @property
    def root(self) -> bytes:
        return self._node(self._places[-1][0])

    def path(self, leaf: int) -> list[Step]:
        """Siblings from a leaf up to the block's root."""
        steps = []
        for places in self._places[:-1]:
            run, own = leaf // ARITY * ARITY, leaf % ARITY
            others = [self._node(p) for i, p in enumerate(places[run : run + ARITY]) if i != own]
            steps.append(Step(own, tuple(others)))
            leaf //= ARITY
        return steps


def pack_path(steps: Iterable[Step]) -> bytes:
    return b"".join(bytes([s.own, len(s.others)]) + b"".join(s.others) for s in steps)


def unpack_path(packed: bytes) -> list[Step]:
    steps, at = [], 0
    while at < len(packed):
        own, n = packed[at], packed[at + 1]
        at += 2
        steps.append(Step(own, tuple(packed[at + _SIZE * i : at + _SIZE * (i + 1)] for i in range(n))))
        at += _SIZE * n
    return steps


# Trees of any size, as rounds of blocks.


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Add ``index`` (from 0, by ``order`` within the tree) and ``n`` (rows of the tree).

    Rows are sorted by ranges, so a tree with most of the rows lies in many partitions; counts of each tree in each
    partition give the places.
    """
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), tree, *order).sortWithinPartitions(tree, *order)
    placed = stored(dealt.withColumn("row", F.monotonically_increasing_id())).withColumn(
        "part", F.shiftrightunsigned("row", 33)
    )
    counts = placed.groupBy(tree, "part").agg(F.min("row").alias("first_row"), F.count("*").alias("held"))
    own = Window.partitionBy(tree)
    before = F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        tree, "part", (F.coalesce(before, F.lit(0)) - F.col("first_row")).alias("shift"), F.sum("held").over(own).alias("n")
    )
    return placed.join(starts, [tree, "part"]).withColumn("index", F.col("row") + F.col("shift")).drop("row", "part", "shift")


_BLOCK = "tree string, block long, n long, leaves int, levels int, root binary, nodes binary"


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each (tree, block) in turn, from sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["tree"], row["block"])
            if rows and own != key:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def _levels(n: int, height: int) -> int:
    return levels_above(n) if n <= ARITY**height else height


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """Aligned blocks of rows ``tree``, ``index``, ``n``, ``digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _groups(batches):
            n = rows[0]["n"]
            levels = _levels(n, height)
            nodes = build_block([r["digest"] for r in rows], levels)
            root = Block(nodes, len(rows), levels).root
            row = {"tree": tree, "block": block, "n": n, "leaves": len(rows), "levels": levels, "root": root, "nodes": nodes}
            yield pa.RecordBatch.from_pylist([row], pa.schema(_ARROW))

    block = F.expr(f"index div {ARITY**height}").alias("block")
    dealt = leaves.select("tree", block, "index", "n", "digest").repartition(
        shuffle_partitions(leaves.sparkSession), "tree", "block"
    )
    return dealt.sortWithinPartitions("tree", "block", "index").mapInArrow(run, _BLOCK)


_ARROW = [
    ("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("leaves", pa.int32()), ("levels", pa.int32()),
    ("root", pa.binary()), ("nodes", pa.binary()),
]


class Forest(NamedTuple):
    """Trees as rounds of blocks: the leaves' blocks, then blocks over those blocks' roots, and so on."""

    rounds: list[DataFrame]
    height: int

    @property
    def _span(self) -> int:
        return ARITY**self.height

    def roots(self) -> DataFrame:
        """``tree`` and ``root`` of each tree."""
        tops = [r.filter(F.col("n") <= self._span).select("tree", "root") for r in self.rounds]
        return reduce(DataFrame.unionByName, tops)

    def with_paths(self, above: DataFrame) -> DataFrame:
        """The leaves' blocks, each with ``path``: the steps from its root up to its tree's and then those of ``above``.

        ``above`` has ``tree``, ``path`` and further columns, which the blocks take over.
        """
        more = [c for c in above.columns if c not in ("tree", "path")]
        lower = None
        for blocks in reversed(self.rounds):
            held = blocks.filter(F.col("n") <= self._span).join(above, "tree")
            if lower is not None:
                held = held.unionByName(blocks.filter(F.col("n") > self._span).join(lower, ["tree", "block"]))
            held = stored(held)
            lower = leaf_paths(held, more)
        return held


def leaf_paths(blocks: DataFrame, more: list[str]) -> DataFrame:
    """``tree``, ``block`` (a leaf's number in its tree), ``path`` and the columns ``more`` for each leaf of the blocks."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join(["tree string", "block long", "path binary", *[f"`{c}` {kinds[c]}" for c in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                block = Block(row["nodes"], row["leaves"], row["levels"])
                first = row["block"] * row["span"]
                columns = {
                    "tree": pa.array([row["tree"]] * block.leaves, pa.string()),
                    "block": pa.array(range(first, first + block.leaves), pa.int64()),
                    "path": pa.array([pack_path(block.path(i)) + row["path"] for i in range(block.leaves)], pa.binary()),
                }
                for c in more:
                    columns[c] = pa.array([row[c]] * block.leaves, batch.column(c).type)
                yield pa.RecordBatch.from_pydict(columns)

    # All blocks of a tree but its last one are full, so a leaf's number is its block's times a full block's leaves.
    return blocks.mapInArrow(run, schema)


def forest(leaves: DataFrame, height: int = HEIGHT) -> Forest:
    """Trees over rows ``tree``, ``index`` (without gaps, from 0), ``n``, ``digest``.

    While a tree has several nodes, every three consecutive ones (in the last run: fewer, even one) become their hash. A
    task builds the levels of one block; the roots of a tree's blocks are the leaves of the next round, until each tree
    is one block. Rounds grow with the logarithm of the largest tree, and no block has more than 3 ** ``height`` leaves.
    """
    span, rounds = ARITY**height, []
    while True:
        blocks = stored(_blocks(leaves, height).withColumn("span", F.lit(span)))
        rounds.append(blocks)
        larger = blocks.filter(F.col("n") > span)
        if larger.isEmpty():
            return Forest(rounds, height)
        leaves = larger.select(
            "tree", F.col("block").alias("index"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("root").alias("digest")
        )


# The manifest of documents.


def leaf_hash(text: Column | str = "text") -> Column:
    """Hash of a document's fields: ``-`` for null, else byte count, colon and value."""

    def part(name: str) -> Column:
        value = (F.col(text) if isinstance(text, str) else text) if name == "text" else F.col(name)
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, FIELDS)), 256))


class Manifest(NamedTuple):
    """``leaves`` (tree, index, n, digest, doc_id, other), the sources' trees and the tree over their roots."""

    leaves: DataFrame
    sources: Forest
    top: Forest
    names: DataFrame

    def root(self) -> DataFrame:
        """One row, or none for an empty table: ``root``."""
        return self.top.roots().select("root")


def manifest(docs: DataFrame, other_text: Column | None = None, height: int = HEIGHT) -> Manifest:
    """Hash trees over all rows: one for each source, by ascending ``doc_id``, and one over the sources' roots.

    Sources are ordered by their names' bytes, null first. A null id comes first; rows with one id are ordered by their
    hash, and equal rows stay, each with a leaf of its own. Null and empty values hash differently. An empty table has no
    tree. Columns other than :data:`FIELDS` are not looked at.

    ``other_text``: a second version of the text, whose leaf is kept as ``other`` to be checked against the first one's
    siblings.

    A source with most of the rows is many blocks in many tasks; only digests are shuffled.
    """
    other = leaf_hash(other_text) if other_text is not None else F.lit(None).cast("binary")
    rows = docs.select(
        # Sorts as the source does, null first.
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_hash().alias("digest"),
        other.alias("other"),
    )
    leaves = stored(numbered(rows, "tree", "doc_id", "digest"))
    sources = forest(leaves, height)
    names = sources.roots().select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    names = stored(numbered(names, "all", "name").withColumnRenamed("all", "tree"))
    return Manifest(leaves, sources, forest(names, height), names)


_CHECKED = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def checked(found: Manifest) -> DataFrame:
    """Every leaf's proof, and whether its other version (without one: itself) leads to the root.

    ``leaf``, ``subroot`` (its source's root) and ``root`` are hex texts; ``proof_sha256`` is the hash of all siblings'
    hex texts from the leaf to the root; ``folded_root`` is computed from the other leaf and the original siblings, and
    ``verified`` says whether it equals ``root``.

    Each block is dealt out once, in front of its documents, with the steps above it; siblings are read from it by address.
    """
    root = found.top.roots().select("tree", F.lit(b"").alias("path"), F.col("root").alias("top"))
    subroots = leaf_paths(found.top.with_paths(root), ["top"])
    above = found.names.select(F.col("index").alias("block"), F.col("name").alias("own"), F.col("digest").alias("subroot")).join(
        subroots, "block"
    )
    blocks = found.sources.with_paths(above.select(F.col("own").alias("tree"), "path", "subroot", "top"))
    span = ARITY**found.sources.height
    held = ("nodes", "leaves", "levels", "path", "subroot", "top")
    kinds = {f.name: f.dataType for f in blocks.schema}
    docs = found.leaves.select(
        "tree", F.expr(f"index div {span}").alias("block"), "index", "doc_id", "digest", "other",
        *[F.lit(None).cast(kinds[c]).alias(c) for c in held],
    )
    firsts = blocks.select(
        "tree", "block", F.lit(-1).cast("long").alias("index"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("other"), *held,
    )
    dealt = docs.unionByName(firsts).repartition(shuffle_partitions(docs.sparkSession), "tree", "block")
    return dealt.sortWithinPartitions("tree", "block", "index").mapInArrow(_check(span), _CHECKED)


def _check(span: int) -> Callable:
    def folded(digest: bytes, steps: list[Step]) -> bytes:
        for step in steps:
            digest = step.fold(digest)
        return digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names = None, [f.split()[0] for f in _CHECKED.split(", ")]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["index"] < 0:
                    block = Block(row["nodes"], row["leaves"], row["levels"])
                    above = unpack_path(row["path"])
                    rest = "".join(x.hex() for step in above for x in step.others)
                    subroot, root = row["subroot"].hex(), row["top"]
                    # What the block's own root folds to, which nearly all of its documents share.
                    known = {block.root: folded(block.root, above)}
                    continue
                steps = block.path(row["index"] % span)
                siblings = "".join([x.hex() for step in steps for x in step.others])
                inner = folded(row["other"] or row["digest"], steps)
                fold = known.get(inner) or folded(inner, above)
                proof = sha256((siblings + rest).encode()).hexdigest()
                out.append((row["doc_id"], row["digest"].hex(), subroot, root.hex(), proof, fold.hex(), fold == root))
            if out:
                columns = dict(zip(names, zip(*out)))
                columns["doc_id"] = pa.array(columns["doc_id"], pa.int64())
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return run


def tampered_text() -> Column:
    """The text without its line breaks where 2 divides the unsigned CRC-32 of the decimal id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def digest(docs: DataFrame) -> DataFrame:
    return checked(manifest(docs, tampered_text()))


def _sql_field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if f == "text" else f) for f in FIELDS) + ")"


def _sql_tree(name: str, key: str, start: str) -> str:
    return f"""
{name}(tree, lvl, idx, n, digest) AS (
    SELECT {key}, 0, idx, n, digest FROM {start}
    UNION ALL
    SELECT tree, lvl + 1, idx // 3, (min(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
    FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 3
)"""


def _sql_fold(name: str, nodes: str, start: str) -> str:
    return f"""
{name}(id, tree, lvl, idx, n, digest) AS (
    {start}
    UNION ALL
    SELECT f.id, f.tree, f.lvl + 1, f.idx // 3, (min(f.n) + 2) // 3,
           sha256(string_agg(if(m.idx = f.idx, f.digest, m.digest), '' ORDER BY m.idx))
    FROM {name} f JOIN {nodes} m ON m.tree = f.tree AND m.lvl = f.lvl AND m.idx // 3 = f.idx // 3
    WHERE f.n > 1 GROUP BY f.id, f.tree, f.lvl, f.idx
)"""


#: The same rows in DuckDB, by recursion over levels.
SQL = f"""
WITH RECURSIVE altered AS (
    SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
            lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc
    FROM documents
), hashed AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, {_sql_leaf("text")} AS digest,
           {_sql_leaf("(CASE WHEN xor(crc, 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS other
    FROM altered
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
           count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS id
    FROM hashed
),{_sql_tree("nodes", "tree", "leaves")},
subroots AS (
    SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
),{_sql_tree("tops", "''", "subroots")},{_sql_fold("folds", "nodes", "SELECT id, tree, 0, idx, n, other FROM leaves")},
{_sql_fold("top_folds", "tops", "SELECT f.id, '', 0, s.idx, s.n, f.digest FROM folds f JOIN subroots s ON s.name = f.tree WHERE f.n = 1")},
siblings AS (
    SELECT l.id, 0 AS part, m.lvl, m.idx, m.digest
    FROM leaves l JOIN nodes m ON m.tree = l.tree AND m.n > 1 AND m.idx // 3 = l.idx // (3 ** (m.lvl + 1))::BIGINT
    WHERE m.idx <> l.idx // (3 ** m.lvl)::BIGINT
    UNION ALL
    SELECT l.id, 1, m.lvl, m.idx, m.digest
    FROM leaves l JOIN subroots s ON s.name = l.tree
    JOIN tops m ON m.n > 1 AND m.idx // 3 = s.idx // (3 ** (m.lvl + 1))::BIGINT
    WHERE m.idx <> s.idx // (3 ** m.lvl)::BIGINT
), proofs AS (
    SELECT id, string_agg(digest, '' ORDER BY part, lvl, idx) AS proof FROM siblings GROUP BY id
)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN tops r ON r.n = 1 JOIN top_folds f ON f.id = l.id AND f.n = 1
LEFT JOIN proofs p ON p.id = l.id
"""
