"""Documents whose sets of word n-grams are alike, and the groups they form.

The product of the document by n-gram incidence matrix with its transpose counts what documents share. Only few of its
entries can reach the threshold, so the product is taken in blocks, and pairs that sizes rule out are dropped on the way:

* Documents with equal sets are one row of the matrix.
* N-grams have a common order, the frequent ones last. If two sets are alike enough, the first n-grams of both (a share
  of each set that follows from its size) meet. Columns of these first n-grams that have the same documents are one
  column of their number's weight; those of one document alone share nothing and go.
* Each column is named by a document that many of its members share first n-grams with, the pivot. Columns of one pivot
  make up a block of rows. Members that can reach the threshold with their pivot are compared with it; those that do
  are tied together.
* A block's members that are not tied yet are multiplied out in cells of bounded size: members outside the block's
  largest group against each other and against that group. Cells of first n-grams come first; a member none of whose
  counts, with all that may follow, reaches the size bound goes.
* Before whole sets are moved, their parities are: whether an odd number of a set's n-grams falls on each of 2 to 4
  times as many bits as it has n-grams. Two sets differ in as many n-grams at least as their parities do in bits, so no
  link is lost where that rules a pair out, with a pivot or in a cell. Whole sets of the rest then give exact counts.

So each link between two groups is found. A cell returns members, or ties of its groups: as many rows as it has members
at most, never its pairs. A block whose members outside its largest group number n is read about n / 512 times.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from trailmark.llm.components import connected_components
from trailmark.llm.shared import U64, Windows, as_bytes, giving_back, row_key, shingles, shuffle_partitions, signed, stored, word_hashes

#: Frequent n-grams that are put last in the order: 8 MB in every task. The order only affects speed.
FREQUENT = 1_000_000
#: An n-gram is frequent from so many documents on (counted where a task meets it at least ``_SEEN`` times).
_OFTEN, _SEEN = 32, 3
_GATHERED = 2_000_000
#: Members on a side of a cell, and n-grams of theirs, on average at most.
_CELL, _CELL_GRAMS = 512, 2_000_000
#: Columns multiplied at a time, and members up to which a column's pairs are counted one by one.
_COLUMNS, _SPARSE = 4096, 8
_AT_ONCE = 400
_FILTER_BITS = 24
#: Bits of a parity, at least and at most; larger sets than that pass more often.
_PARITY_BITS = 64, 1 << 20


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows, a few at a time, with the sets of their texts."""
    windows = Windows()
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(at, _AT_ONCE)
            yield part, [shingles(word_hashes(t.lower().split()), words, windows) for t in as_bytes(part.column("text"))]


def _frequent_in_tasks(words: int) -> Callable:
    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(parts)
        parts.clear()
        keys.sort()
        # Sorted in place, and only what occurs often gets a count: few copies of so many.
        first = keys[: max(len(keys) - _SEEN + 1, 0)]
        many = np.unique(first[first == keys[_SEEN - 1 :]])
        counts = np.searchsorted(keys, many, "right") - np.searchsorted(keys, many)
        return pa.RecordBatch.from_arrays([pa.array(signed(many)), pa.array(counts.astype(np.int64))], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, sets in _sets(batches, words):
            for s in sets:
                parts.append(s)
                held += len(s)
                if held >= _GATHERED:
                    yield counted(parts)
                    held = 0
        if parts:
            yield counted(parts)

    return run


def frequent_grams(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of at most ``FREQUENT`` frequent n-grams, rarest first."""
    counts = docs.mapInArrow(giving_back(_frequent_in_tasks(words)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= _OFTEN).orderBy(F.desc("n"), "gram").limit(FREQUENT)
    table = top.toArrow()
    return table.column("gram").to_numpy().astype(np.int64)[::-1].view(U64).copy()


def _digest(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def first_grams(size: int, percent: int) -> int:
    """How many n-grams of a set of ``size``, first in the order, one must meet to reach ``percent``."""
    return size - -(-size * percent // 100) + 1


def _summaries(words: int, percent: int, frequent) -> Callable:
    """Of each document: size and digest of its set, and its first n-grams in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_first = frequent.value
        by_hash = np.argsort(rare_first)
        names = rare_first[by_hash]

        def first(grams: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(names, grams), max(len(names) - 1, 0))
            last = names[at] == grams if len(names) else np.zeros(len(grams), bool)
            late = np.sort(by_hash[at[last]]) if last.any() else np.empty(0, int)
            return signed(np.concatenate([grams[~last], rare_first[late]])[: first_grams(len(grams), percent)])

        for batch, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([first(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "size", "digest", "first"],
            )

    return run


def _whole_sets(words: int) -> Callable:
    """The set of each row's text, with the cells in which it is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, words):
            own = pa.array([_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist())], pa.bool_())
            columns = [batch.column("node"), batch.column("cells"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "cells", "grams"]).filter(own)

    return run


def _parity(grams: np.ndarray) -> np.ndarray:
    """Bytes whose bits tell where an odd number of n-grams falls."""
    least, most = _PARITY_BITS
    bits = min(max(1 << (2 * len(grams) - 1).bit_length(), least), most)
    return np.packbits(np.bincount((grams & U64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1)


def _folded(parity: np.ndarray, n: int) -> np.ndarray:
    """The parity on fewer bits, ``n`` bytes of them."""
    while len(parity) > n:
        half = len(parity) // 2
        parity = parity[:half] ^ parity[half:]
    return parity


def _wanted(seen) -> Callable:
    """Rows whose ``key`` may be among those of which the bitmap ``seen`` was made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("key").to_numpy() & ((1 << _FILTER_BITS) - 1)
            yield batch.filter(pa.array((seen.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1))

    return run


def _parities(words: int, seen) -> Callable:
    """The parity of the set of each row that may be wanted, with the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(_wanted(seen)(batches), words):
            digests = pa.array([_digest(s) for s in sets], pa.binary())
            grams = pa.array([_parity(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), digests, grams], names=["key", "digest", "grams"])

    return run


def _most_in_common(parities: list[np.ndarray], size: np.ndarray, left: int) -> np.ndarray:
    """How many n-grams each of the first ``left`` sets shares with each set at most."""
    long = np.array([len(p) for p in parities])
    differ = np.zeros((left, len(parities)), np.int64)
    for n in np.unique(long).tolist():  # a pair is last seen on all bits that both have
        some = np.flatnonzero(long >= n)
        bits = np.unpackbits(np.stack([_folded(parities[i], n) for i in some]), axis=1).astype(np.float32)
        ones, first = bits.sum(axis=1), int((some < left).sum())
        differ[np.ix_(some[:first], some)] = ones[:first, None] + ones - 2 * (bits[:first] @ bits.T)
    return (size[:left, None] + size - differ) // 2


def _compared(percent: int, whole: bool) -> Callable:
    """In each cell, members whose overlap with the pivot reaches the threshold, or may as far as parities tell."""

    def overlap(own: np.ndarray, other: np.ndarray, sizes: int) -> int:
        if whole:
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            return int((own[at] == other).sum())
        n = min(len(own), len(other))
        return (sizes - int(np.bitwise_count(_folded(own, n) ^ _folded(other, n)).sum())) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own, own_size = None, None, 0
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("a", "is_pivot", "size", "node", "grams")]
            for a, is_pivot, size, node, grams in zip(*columns):
                other = np.frombuffer(grams, U64 if whole else np.uint8)
                if is_pivot:
                    pivot, own, own_size = a, other, size
                    continue
                if a != pivot:
                    raise ValueError(f"no set for {a}")
                sizes = own_size + size
                shared = overlap(own, other, sizes)
                if 100 * shared >= percent * (sizes - shared):
                    found.append((a, own_size, node, size))
            columns = np.array(found, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "a_size", "b", "b_size"])

    return run


def _bit() -> Column:
    return F.pmod("key", F.lit(1 << _FILTER_BITS)).cast("int")


def _filter_of(keys: DataFrame) -> np.ndarray:
    """Bitmap of ``2 ** _FILTER_BITS`` bits with a bit set for every ``key``: 2 MB, whatever the number of keys."""
    bits = keys.select(_bit().alias("bit")).distinct()
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[bits.toArrow().column("bit").to_numpy()] = True
    return np.packbits(seen)


def _common_counts(owner: np.ndarray, grams: np.ndarray, weights: np.ndarray, left: int, members: int) -> np.ndarray:
    """Weight of the n-grams that each of the first ``left`` members shares with each member; ``owner`` ascends."""
    order = np.argsort(grams, kind="stable")
    grams, owner, weights = grams[order], owner[order], weights[order]
    starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, int)
    many = np.diff(np.r_[starts, len(grams)])
    column = np.repeat(np.arange(len(starts)), many)
    common = np.zeros(left * members, np.int64)
    few = np.repeat((many > 1) & (many <= _SPARSE), many)
    at, who, weight = column[few], owner[few], weights[few]
    for d in range(1, _SPARSE):
        same = (at[d:] == at[:-d]) & (who[:-d] < left)
        pairs = np.bincount(who[:-d][same] * members + who[d:][same], weight[d:][same], len(common))
        common += pairs.astype(np.int64)
    common = common.reshape(left, members)
    dense = np.repeat(many > _SPARSE, many)
    at, who = np.unique(column[dense], return_inverse=True)[1], owner[dense]
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, _COLUMNS):
        here = slice(*np.searchsorted(at, (first, first + _COLUMNS)))
        weight = np.zeros(_COLUMNS)
        weight[at[here] - first] = weights[dense][here]
        exact = np.float32 if weight.sum() < 1 << 24 else np.float64
        block = np.zeros((members, _COLUMNS), exact)
        block[who[here], at[here] - first] = 1
        common += ((block[:left] * weight.astype(exact)) @ block.T).astype(np.int64)
    return common


def _ties(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> Iterator[int]:
    """Places of those links ``a``, ``b`` that tie groups not tied by an earlier one."""
    names, group = np.unique(root, return_inverse=True)
    _, once = np.unique(group[a] * len(names) + group[b], return_index=True)
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i in once.tolist():
        x, y = top(int(group[a[i]])), top(int(group[b[i]]))
        if x != y:
            up[x] = y
            yield i


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Numbers of each row of a column of lists or of bytes."""
    if pa.types.is_binary(column.type):
        return [np.frombuffer(x, np.int64) for x in column.to_pylist()]
    numbers, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [numbers[a:b].copy() for a, b in zip(ends[:-1], ends[1:])]


def _multiplied(percent: int, of: str) -> Callable:
    """Of cells: with ``"first"`` n-grams or ``"parity"``, members that may be linked to another group; with ``"whole"``
    sets, links that tie groups.

    A cell's left members meet those on the right, in the cell -1 each other too.
    """
    whole = of == "whole"

    def product(cell: tuple, rows: dict[int, tuple]) -> pa.RecordBatch:
        inside = sorted(rows.items(), key=lambda x: not x[1][0])
        left = sum(is_left for _, (is_left, *_) in inside)
        node = np.array([n for n, _ in inside], np.int64)
        root, size = (np.array([r[k] for _, r in inside], np.int64) for k in (1, 2))
        sets = [r[3] for _, r in inside]
        if of == "parity":
            common = _most_in_common([s.view(np.uint8) for s in sets], size, left)
        else:
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            weights = np.concatenate([r[4] for _, r in inside]) if not whole else np.ones(len(owner), np.int64)
            common = _common_counts(owner, np.concatenate(sets), weights, left, len(sets))
        both = size[:left, None] + size
        if of != "first":
            good = 100 * common >= percent * (both - common)
        else:
            later = size - first_grams(size, percent)
            rest = np.maximum(later[:left, None], later)
            sizes = 100 * np.minimum(size[:left, None], size) >= percent * np.maximum(size[:left, None], size)
            good = sizes & (common > 0) & ((100 + percent) * (common + rest) >= percent * both)
        good &= root[:left, None] != root
        good &= np.arange(left)[:, None] < np.arange(len(sets)) if cell[2] == -1 else np.arange(len(sets)) >= left
        a, b = np.nonzero(good)
        if whole:
            ties = list(_ties(a, b, root))
            return pa.RecordBatch.from_arrays([pa.array(node[a[ties]]), pa.array(node[b[ties]])], names=["a", "b"])
        hopeful = node[np.unique(np.r_[a, b])]
        label = np.full(len(hopeful), cell[0], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(label), pa.array(hopeful)], names=["label", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "i", "j", "is_left", "node", "root", "size")]
            lists = _arrays(batch.column("grams"))
            weights = _arrays(batch.column("weights")) if of == "first" else lists
            for label, i, j, is_left, node, root, size, grams, weight in zip(*columns, lists, weights):
                if (label, i, j) != now:
                    if rows:
                        yield product(now, rows)
                    now, rows = (label, i, j), {}
                rows.setdefault(node, (is_left, root, size, grams, weight))
        if rows:
            yield product(now, rows)

    return run


def _of_kept(entries: DataFrame, kept: DataFrame) -> DataFrame:
    return entries.join(kept.hint("shuffle_hash"), "gram")


def _blocks(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``label``, ``node``: members of each block; and ``node``, ``grams``, ``weights``: the columns of each member.

    Two nodes of one column are in one block at least. Entries are shuffled once, by n-gram, and read twice. They
    meet the columns that are kept in a hash join: those are few, one row an n-gram, and entries need not be sorted.
    A column's pivot is the one that most of its members favour, and a node favours the smallest node of most of its
    columns: so columns of one cluster have one pivot or few.
    """
    # Filtered first: else only the join's side is, which makes it another shuffle.
    entries = entries.filter("gram is not null").repartition("gram")
    columns = entries.groupBy("gram").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other"),
        F.min("node").alias("least"),
    )
    kept = (
        columns.filter("n > 1")
        .groupBy("n", "one", "other")
        .agg(F.min("gram").alias("gram"), F.min("least").alias("least"), F.count("*").alias("weight"))
        .select("gram", "least", "weight")
    )
    members = stored(_of_kept(entries, kept))
    votes = members.groupBy("node", "least").agg(F.count("*").alias("n"))
    favourites = votes.groupBy("node").agg(F.max_by("least", "n").alias("favourite"))
    of_columns = members.join(favourites, "node").groupBy("gram", "favourite").agg(F.count("*").alias("n"))
    labels = of_columns.groupBy("gram").agg(F.max_by("favourite", "n").alias("label"))
    blocks = stored(members.join(labels, "gram").select("label", "node").distinct())
    of_node = members.groupBy("node").agg(F.collect_list(F.struct("gram", "weight")).alias("columns"))
    return blocks, stored(of_node.select("node", F.col("columns.gram").alias("grams"), F.col("columns.weight").alias("weights")))


def _dealt(members: DataFrame) -> DataFrame:
    """Members (``label``, ``node``, ``root``, ``size``) of blocks with several groups, with their ``cells``.

    Members of a block's largest group are on the right only. The cells of a side follow from members and sizes.
    """
    groups = members.groupBy("label", "root").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    blocks = groups.groupBy("label").agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum("grams").alias("grams"),
        F.max(F.struct("n", "grams", "root")).alias("main"),
    )
    cells = lambda n, grams: F.ceil(F.greatest(n / _CELL, grams / _CELL_GRAMS)).cast("int")
    sides = blocks.filter("groups > 1").select(
        "label",
        F.col("main.root").alias("main"),
        cells(F.col("main.n"), F.col("main.grams")).alias("mains"),
        cells(F.col("n") - F.col("main.n"), F.col("grams") - F.col("main.grams")).alias("others"),
    )
    is_main = F.col("root") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    cell = lambda i, j, is_left: F.struct(i.alias("i"), j.alias("j"), is_left.alias("is_left"))
    me, zero = F.col("own"), F.lit(0)
    upto = lambda n: F.sequence(zero, n - 1)
    with_mains = F.transform(upto(F.col("mains")), lambda x: cell(me, -1 - x, F.lit(True)))
    with_others = F.transform(
        F.filter(upto(F.col("others")), lambda x: x != me), lambda x: cell(F.least(me, x), F.greatest(me, x), me < x)
    )
    of_others = F.concat(with_mains, with_others)
    of_main = F.transform(upto(F.col("others")), lambda x: cell(x, -1 - me, F.lit(False)))
    return (
        members.join(sides, "label")
        .withColumn("own", own)
        .select("label", "node", "root", "size", F.when(is_main, of_main).otherwise(of_others).alias("cells"))
    )


def _in_cells(rows: DataFrame, *lists: str) -> DataFrame:
    """Rows of a cell in one task, one cell after another."""
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "label", "i", "j")
    return dealt.sortWithinPartitions("label", "i", "j").select("label", "i", "j", "is_left", "node", "root", "size", *lists)


def _weight_in_common(grams: pa.Array, weights: pa.Array, others: pa.Array) -> pa.Array:
    both = zip(_arrays(grams), _arrays(weights), _arrays(others))
    return pa.array([int(w[np.isin(g, o, assume_unique=True)].sum()) for g, w, o in both], pa.int64())


def _promising(pairs: DataFrame, classes: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of like sizes whose first n-grams have enough in common.

    Of the two lists of first n-grams one ends first in the order. All that its set shares with the other set up to
    there is in both lists, so the overlap is at most what the lists share and the rest of that set.
    """
    size = lambda name: classes.select(F.col("node").alias(name), F.col("size").alias(f"{name}_size"))
    both = pairs.join(size("a"), "a").join(size("b"), "b")
    both = both.filter(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))
    of_a = lists.select(F.col("node").alias("a"), "grams", "weights")
    both = both.join(of_a, "a").join(lists.select(F.col("node").alias("b"), F.col("grams").alias("others")), "b")
    rest = F.expr(f"(greatest(a_size, b_size) * {percent} + 99) div 100 - 1")
    enough = (100 + percent) * (F.col("shared") + rest) >= percent * (F.col("a_size") + F.col("b_size"))
    in_common = F.arrow_udf(_weight_in_common, LongType())
    shared = in_common("grams", "weights", "others")
    return both.withColumn("shared", shared).filter(enough).select("a", "a_size", "b", "b_size")


def _in_their_cells(cells: DataFrame, docs: DataFrame, classes: DataFrame, words: int, whole: bool) -> DataFrame:
    """The whole set or the parity of each node of ``cells`` (``node``, ``cells``), once for each of its cells.

    Only texts or parities that may be wanted are shuffled; a filter of fixed size tells.
    """
    wanted = stored(classes.select("node", "digest", "key").join(cells, "node"))
    seen = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))
    if whole:
        # Shuffled even if the join needn't: two Python steps in a stage would take twice as many workers.
        texts = docs.select("key", "text").mapInArrow(giving_back(_wanted(seen)), "key long, text string")
        texts = texts.repartition(shuffle_partitions(docs.sparkSession), "key")
        form = f"node long, cells {wanted.schema['cells'].dataType.simpleString()}, grams binary"
        of_nodes = texts.join(wanted, "key").select("node", "digest", "cells", "text").mapInArrow(giving_back(_whole_sets(words)), form)
    else:
        parities = docs.select("key", "text").mapInArrow(giving_back(_parities(words, seen)), "key long, digest binary, grams binary")
        of_nodes = parities.join(wanted, ["key", "digest"])
    return of_nodes.select(F.explode("cells").alias("cell"), "node", "grams").select("cell.*", "node", "grams")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """Of ``pairs`` of a pivot ``a`` and a member ``b``, those whose overlap reaches the threshold on the whole sets, or
    may as far as parities tell.

    A pivot of many pairs has many cells of ``_CELL`` members or so.
    """
    pivots = pairs.groupBy("a").agg(F.ceil(F.count("*") / _CELL).cast("int").alias("cells"), F.first("a_size").alias("size"))
    at = F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("cell")
    of_members = pairs.join(pivots.drop("size"), "a").select(
        F.col("b").alias("node"), "a", at, F.lit(False).alias("is_pivot"), F.col("b_size").alias("size")
    )
    each = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")
    of_pivots = pivots.select(F.col("a").alias("node"), "a", each, F.lit(True).alias("is_pivot"), "size")
    cells = of_members.unionByName(of_pivots).groupBy("node")
    cells = cells.agg(F.collect_list(F.struct("a", "cell", "is_pivot", "size")).alias("cells"))
    sets = _in_their_cells(cells, docs, classes, words, whole)
    dealt = sets.repartition(shuffle_partitions(docs.sparkSession), "a", "cell")
    ordered = dealt.sortWithinPartitions("a", "cell", F.desc("is_pivot")).select("a", "is_pivot", "size", "node", "grams")
    return ordered.mapInArrow(giving_back(_compared(percent, whole)), "a long, a_size long, b long, b_size long")


def _with_like_sizes(members: DataFrame, percent: int) -> DataFrame:
    """Members in whose block another one has a size that may be alike: in the same band of sizes or the next."""
    width = max(math.log(100 / percent) * 1.001, 1e-6)
    banded = members.withColumn("band", F.floor(F.log("size") / width))
    counts = banded.groupBy("label", "band").agg(F.count("*").alias("n"))
    near = counts.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    near = near.groupBy("label", "band").agg(F.sum("n").alias("n")).filter("n > 1").select("label", "band")
    return banded.join(near, ["label", "band"], "left_semi").drop("band")


def _between_groups(
    members: DataFrame, lists: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links (``a``, ``b``) that tie the groups (``root``) of a block's members, by products of cells."""
    heads = _dealt(stored(_with_like_sizes(members, percent))).join(lists, "node")
    heads = heads.withColumn("cell", F.explode("cells")).select("label", "cell.*", "node", "root", "size", "grams", "weights")
    heads = _in_cells(heads, "grams", "weights")
    hopeful = stored(heads.mapInArrow(giving_back(_multiplied(percent, "first")), "label long, node long").distinct())

    def cells_of(hopeful: DataFrame, whole: bool) -> DataFrame:
        left = _dealt(members.join(hopeful, ["label", "node"]))
        here = lambda c: [c[x].alias(x) for x in ("i", "j", "is_left")]
        places = F.transform("cells", lambda c: F.struct("label", *here(c), "root", "size"))
        cells = left.withColumn("cells", places).groupBy("node").agg(F.flatten(F.collect_list("cells")).alias("cells"))
        return _in_cells(_in_their_cells(cells, docs, classes, words, whole), "grams")

    parities = cells_of(hopeful, False)
    hopeful = stored(parities.mapInArrow(giving_back(_multiplied(percent, "parity")), "label long, node long").distinct())
    return cells_of(hopeful, True).mapInArrow(giving_back(_multiplied(percent, "whole")), "a long, b long")


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Size of each document's set of ``words``-word shingles, and the group of documents it is linked with.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words has the whole of it as its one
    shingle; one without words, or null, has none and is linked with nothing. Documents are linked when ``100 *``
    common shingles ``>= percent *`` shingles of either, counted exactly on 64-bit hashes.

    Takes ``doc_id`` and ``text``, leaves other columns out; returns ``doc_id``, ``n_shingles`` and ``component_id``
    (smallest ``doc_id`` that links reach, itself included) for each row. Repeated rows are linked like other equal
    texts; a null ``doc_id`` counts as larger than any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", row_key())
    frequent = spark.sparkContext.broadcast(frequent_grams(docs.select("text"), words))
    summaries = stored(
        docs.mapInArrow(
            giving_back(_summaries(words, percent, frequent)),
            "doc_id long, key long, size long, digest binary, first array<long>",
        )
    )
    classes = stored(
        summaries.filter("size > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.first(F.struct("key", "size", "first")).alias("one"))
        .select("digest", "least", "one.*", F.monotonically_increasing_id().alias("node"))
    )
    blocks, lists = _blocks(classes.select("node", F.explode("first").alias("gram")))
    pairs = blocks.filter("label != node").select(F.col("label").alias("a"), F.col("node").alias("b"))
    pairs = stored(_promising(pairs, classes, lists, percent))
    for whole in (False, True):
        pairs = stored(_links(pairs, docs, classes, words, percent, whole))
    ties = pairs.select("a", "b")
    roots = connected_components(ties)
    rooted = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stored(rooted(blocks).join(classes.select("node", "size"), "node"))
    links = stored(ties.unionByName(_between_groups(members, lists, docs, classes, words, percent)))
    roots = connected_components(links)
    grouped = rooted(classes)
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("digest", "root").join(least, "root").select("digest", "component_id")
    return summaries.join(named, "digest", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
