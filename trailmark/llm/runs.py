"""Periodic runs in word sequences: longest common extensions from suffix trees, candidates from Lyndon roots."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import as_bytes

#: A run repeats its period so often, and has so many words, at least.
EXPONENT, LENGTH = 4, 6
#: Every run of those lengths holds each of its n-grams of so many words so often.
_GRAM, _TIMES = 3, 3


class Run(NamedTuple):
    start: int
    length: int
    period: int


class SuffixTree:
    """Suffix tree of numbers, built online (Ukkonen), with string depths along its Euler tour.

    The sequence gets an end mark that is smaller than all of its numbers, so each suffix is a leaf. Nodes are numbers;
    an edge is kept as where its label begins and ends in the sequence.
    """

    def __init__(self, values: list[int]) -> None:
        self.n = len(values)
        # Numbers from 1, the end mark is 0.
        self._text = [v + 1 for v in values] + [0]
        self._letters = max(self._text) + 1
        self._grow()
        self._tour()

    def _grow(self) -> None:
        text, letters = self._text, self._letters
        end_of_all = len(text)
        # Edge into each node: start, end (that of the sequence for a leaf); suffix link; suffix of a leaf.
        start, end, link, suffix = [0], [0], [0], [-1]
        child: dict[int, int] = {}
        node, edge, length, waiting = 0, 0, 0, 0
        for i, c in enumerate(text):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    edge = i
                key = node * letters + text[edge]
                at = child.get(key)
                if at is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(end_of_all)
                    link.append(0)
                    suffix.append(i - waiting + 1)
                    if made:
                        link[made] = node
                    made = node
                else:
                    s = start[at]
                    span = end[at] - s
                    if length >= span and length >= i - s:
                        # The leaf's label may be longer than what has been read of it.
                        span = min(span, i - s) if end[at] == end_of_all else span
                    if length >= span:
                        edge += span
                        length -= span
                        node = at
                        continue
                    if text[s + length] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    # Cut the edge and hang the new leaf there.
                    middle = len(start)
                    child[key] = middle
                    start.append(s)
                    end.append(s + length)
                    link.append(0)
                    suffix.append(-1)
                    leaf = middle + 1
                    start.append(i)
                    end.append(end_of_all)
                    link.append(0)
                    suffix.append(i - waiting + 1)
                    child[middle * letters + c] = leaf
                    start[at] = s + length
                    child[middle * letters + text[s + length]] = at
                    if made:
                        link[made] = middle
                    made = middle
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                elif node:
                    node = link[node]
        self._child, self._start, self._end, self._suffix = child, start, end, suffix

    def _tour(self) -> None:
        """Walk all nodes, children by their first number, and note the depth of each node at each visit."""
        n_nodes = len(self._start)
        start, end = np.array(self._start, np.int64), np.array(self._end, np.int64)
        suffix = np.array(self._suffix, np.int64)
        keys = np.fromiter(self._child, np.int64, len(self._child))
        nodes = np.fromiter(self._child.values(), np.int64, len(self._child))
        order = np.argsort(keys)
        parent, nodes = keys[order] // self._letters, nodes[order]
        first = np.searchsorted(parent, np.arange(n_nodes + 1)).tolist()
        child, span = nodes.tolist(), (end - start).tolist()
        depth, entered, left = [0] * n_nodes, [0] * n_nodes, [0] * n_nodes
        tour: list[int] = [0]
        stack, at = [0], first[:]
        while stack:
            node = stack[-1]
            i = at[node]
            if i < first[node + 1]:
                at[node] = i + 1
                down = child[i]
                depth[down] = depth[node] + span[down]
                entered[down] = len(tour)
                tour.append(down)
                stack.append(down)
            else:
                left[node] = len(tour)
                stack.pop()
                if stack:
                    tour.append(stack[-1])
        self.depths = np.array(depth, np.int64)[np.array(tour, np.int64)]
        leaves = suffix >= 0
        #: Where the tour visits each suffix's leaf.
        self.visit = np.empty(len(self._text), np.int64)
        self.visit[suffix[leaves]] = np.array(entered, np.int64)[leaves]
        self._order_of_leaves(parent, nodes, leaves, np.array(entered, np.int64), np.array(left, np.int64))
        self._least = _Least(self.depths)
        del self._child, self._start, self._end, self._suffix

    def _order_of_leaves(
        self, parent: np.ndarray, nodes: np.ndarray, leaves: np.ndarray, entered: np.ndarray, left: np.ndarray
    ) -> None:
        """Ranks of the suffixes with numbers ascending, and with numbers descending; the end mark is least in both."""
        steps = len(self.depths)
        is_leaf = np.zeros(steps + 1, np.int64)
        is_leaf[entered[leaves]] = 1
        before = np.r_[0, np.cumsum(is_leaf)]
        held = before[np.minimum(left, steps)] - before[entered]
        self.rank = before[self.visit]
        # Leaves of the siblings that come first when larger numbers do. `parent` is sorted, and so are siblings in it.
        sizes = held[nodes]
        total = np.r_[0, np.cumsum(sizes)]
        last = np.searchsorted(parent, parent, "right")
        shift = total[last] - total[1:]
        begins = np.searchsorted(parent, parent, "left")
        # The child of the end mark, where there is one, stays first.
        marked = np.zeros(len(nodes), bool)
        marked[begins] = self._begins_with_mark(nodes[begins])
        marked &= np.arange(len(nodes)) == begins
        shift = np.where(marked, 0, shift + np.where(marked[begins], sizes[begins], 0))
        turn = np.zeros(steps + 2, np.int64)
        turn[entered[nodes]] += shift
        np.subtract.at(turn, left[nodes], shift)
        self.rank_descending = np.cumsum(turn)[self.visit]

    def _begins_with_mark(self, nodes: np.ndarray) -> np.ndarray:
        start = np.array(self._start, np.int64)
        return np.array(self._text, np.int64)[start[nodes]] == 0

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree from ``a`` on and from ``b`` on: the depth of the lowest common ancestor of two leaves."""
        x, y = self.visit[a], self.visit[b]
        return self._least.between(np.minimum(x, y), np.maximum(x, y))


class _Least:
    """Least value between two places in constant time, from blocks: a table over blocks, and least values to either side."""

    _BLOCK = 16

    def __init__(self, values: np.ndarray) -> None:
        size = self._BLOCK
        self._n = len(values)
        held = np.full(-(-self._n // size) * size, np.iinfo(np.int32).max, np.int32)
        held[: self._n] = values
        rows = held.reshape(-1, size)
        self._values = held
        self._from_left = np.minimum.accumulate(rows, 1).ravel()
        self._from_right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        self._table = [rows.min(1)]
        while 2 << (len(self._table) - 1) <= len(rows):
            last, half = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(last[:-half], last[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least values at places ``a`` to ``b``, both included; ``a`` is not above ``b``."""
        size = self._BLOCK
        x, y = a // size, b // size
        out = np.minimum(self._from_right[a], self._from_left[b])
        gap = y - x - 1
        wide = np.flatnonzero(gap > 0)
        if len(wide):
            level = np.frexp(gap[wide].astype(np.float64))[1] - 1
            for k in np.unique(level):
                some = wide[level == k]
                row = self._table[k]
                own = np.minimum(row[x[some] + 1], row[y[some] - (1 << int(k))])
                out[some] = np.minimum(out[some], own)
        same = np.flatnonzero(gap < 0)
        if len(same):
            inside = np.arange(size)
            cells = self._values[(x[same] * size)[:, None] + inside]
            mine = (inside >= (a[same] % size)[:, None]) & (inside <= (b[same] % size)[:, None])
            out[same] = np.where(mine, cells, np.iinfo(np.int32).max).min(1)
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank; the end mark's rank, last, is the smallest."""
    found, waiting = [0] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while waiting and waiting[-1][1] > r:
            found[waiting.pop()[0]] = i
        waiting.append((i, r))
    return np.array(found[:-1], np.int64)


def runs_of(values: list[int], exponent: int = EXPONENT, length: int = LENGTH) -> list[Run]:
    """All maximal periodic runs of ``values``, by start, then period.

    The longest Lyndon word at each place, in the order of the numbers and in the opposite one, ends before the next
    smaller suffix; one of the two is a root of every run that starts a period there. Its length is the candidate's
    period, the extension of the suffixes a period apart its reach to the right, that in the reversed sequence its reach
    to the left.
    """
    n = len(values)
    if n < max(2, length):
        return []
    ahead, back = SuffixTree(values), SuffixTree(values[::-1])
    at = np.arange(n, dtype=np.int64)
    found: set[Run] = set()
    for rank in (ahead.rank, ahead.rank_descending):
        period = _next_smaller(rank) - at
        fits = at + period <= n
        i, p = at[fits], period[fits]
        right = ahead.extension(i, i + p)
        # Before i and before i + p; in the reversed sequence place x is n - 1 - x. Before the first place nothing agrees.
        left = back.extension(n - i, n - i - p)
        size = left + p + right
        good = size >= np.maximum(length, exponent * p)
        found.update(map(Run, (i - left)[good].tolist(), size[good].tolist(), p[good].tolist()))
    return sorted(found, key=lambda r: (r.start, r.period))


def _stretches(values: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Parts, from and to, outside which no run can lie: each of their n-grams occurs often enough in the part."""
    todo = [(0, len(values))]
    while todo:
        a, b = todo.pop()
        if b - a < length:
            continue
        part = values[a:b]
        m = b - a - _GRAM + 1
        grams = part[:m].copy()
        for k in range(1, _GRAM):
            # Numbers of pairs, so no two n-grams share one.
            grams = np.unique(grams, return_inverse=True)[1] * np.int64(1 << 32) + part[k : k + m]
        _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
        often = counts[which] >= _TIMES
        if often.all():
            yield a, b
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, often, False].astype(np.int8)))
        todo += [(a + int(x), a + int(y) + _GRAM - 1) for x, y in zip(edges[::2], edges[1::2])]


def document_runs(words: list[Hashable]) -> list[Run]:
    """Runs of at least ``LENGTH`` words and ``EXPONENT`` periods.

    Such a run holds each of its 3-grams three times or more, so trees are only built of the stretches of which that is
    true (whole runs, as a longer run would be true to it too).
    """
    if len(words) < LENGTH:
        return []
    numbers: dict[Hashable, int] = {}
    values = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = []
    for a, b in _stretches(values, LENGTH):
        part = np.unique(values[a:b], return_inverse=True)[1]
        found += [Run(r.start + a, r.length, r.period) for r in runs_of(part.tolist())]
    return sorted(found, key=lambda r: (r.start, r.period))


def without_repeats(words: list, runs: Iterable[Run]) -> list:
    """The words but those that a run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edges[r.start + r.period] += 1
        edges[r.start + r.length] -= 1
    kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return words if len(kept) == len(words) else [words[i] for i in kept]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length for its period, compared exactly; of equals the first, then the shortest period."""
    best = None
    for r in runs:
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


_COLUMNS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"
)
_RUNS = "doc_id long, start long, length long, period long"


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Id, words (UTF-8, cut at ASCII white space, as bytes are) and mark of the rows, a few at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            ids, marks = part.column("doc_id").to_pylist(), part.column("mark").to_pylist()
            yield [(d, t.split(), h) for d, t, h in zip(ids, as_bytes(part.column("body")), marks)]


def _repeating(words: list[bytes], mark: int | None) -> list[bytes]:
    """The words, from some place on replaced by repeats of those that stand there, if the mark says so."""
    n = len(words)
    if mark is None or mark % 10 or not n:
        return words
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _over_documents(docs: DataFrame, planted: bool, body: Callable[[int | None, list[bytes]], list[tuple]], schema: str) -> DataFrame:
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body"), mark.alias("mark"))
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _texts(batches):
            out = [row for doc_id, words, mark in some for row in body(doc_id, _repeating(words, mark))]
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return rows.mapInArrow(run, schema)


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``period`` (in words, from 0) of every run of every whole text.

    A run is a stretch of words whose smallest period is ``period``, of at least six words and four periods, that neither
    neighbour extends. Null, empty and short texts have none. Rows are looked at one by one, so ids may be null or
    repeated; other columns are not looked at. Nothing is shuffled; a task holds one document's trees, whose size is that
    of the document's repetitive stretches.
    """
    return _over_documents(docs, False, lambda d, words: [(d, *r) for r in document_runs(words)], _RUNS)


def collapsed(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row of ``docs``: number of runs, the strongest one (without runs: nulls), and digests of runs and kept words.

    ``collapsed_sha256`` is that of the words that no run holds after its first period, joined by one space;
    ``runs_sha256`` that of a line ``start,length,period`` for each run. Of a text without words both are of nothing.
    ``planted`` makes one in ten documents (by a hash of the id; never without an id) repeat some of its words first.
    """

    def body(doc_id: int | None, words: list[bytes]) -> list[tuple]:
        runs = document_runs(words)
        best = strongest(runs)
        lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
        kept = without_repeats(words, runs) if runs else words
        strong = (*best, 1000 * best.length // best.period) if best else (None,) * 4
        hashes = (sha256(x).hexdigest() for x in (lines.encode(), b" ".join(kept)))
        return [(doc_id, len(runs), *strong, *hashes, len(words), len(kept))]

    return _over_documents(docs, planted, body, _COLUMNS)
