"""What several operators need: tables kept in the shared folder, words, hashes, and hash lists dealt out in blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_WORDS_CACHED = 400_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor reaches, under ``spark.checkpoint.dir``.

    Only a local session may leave that setting out; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="trailmark-llm-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/trailmark-llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return memory that is free in this process to the system: at a task's end, or an idle worker keeps it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it; others return memory by themselves
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, for ``mapInArrow``, that returns free memory at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of a word, remembered. Kept by a task; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _WORDS_CACHED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The same hashes, none remembered."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: U64, n: int) -> np.ndarray:
    return np.concatenate([[U64(1)], np.multiply.accumulate(np.full(max(n - 1, 0), base))])[:n]


class Windows:
    """Hashes of all runs of ``length`` words, in time that does not depend on ``length``."""

    def __init__(self) -> None:
        self._grow(1024)

    def _grow(self, n: int) -> None:
        self._up, self._down = _powers(_BASE, n), _powers(_INVERSE, n)

    def of(self, hashes: np.ndarray, length: int) -> np.ndarray:
        n = len(hashes)
        if n < length:
            return np.empty(0, U64)
        if n > len(self._up):
            self._grow(2 * n)
        sums = np.zeros(n + 1, U64)
        np.cumsum(hashes * self._up[:n], out=sums[1:])
        return mixed((sums[length:] - sums[: n + 1 - length]) * self._down[: n + 1 - length])


def shingles(hashes: np.ndarray, words: int, windows: Windows) -> np.ndarray:
    """Distinct, sorted hashes of all runs of ``words`` words; fewer words count as one run."""
    n = len(hashes)
    return np.unique(windows.of(hashes, min(words, n))) if n else np.empty(0, U64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# Hash lists in blocks: a record holds many hashes of one bucket, so a shuffle moves few, compact rows.


def bucket_bits(spark: SparkSession) -> int:
    """Bits of a hash that name its bucket: one or two buckets for each shuffle partition."""
    return max(4, (shuffle_partitions(spark) - 1).bit_length())


def cut_by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending ``keys`` by their top ``bits``, and where each lies."""
    top = (keys >> U64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.empty(0, int)
    for a, b in zip(first, np.r_[first[1:], len(top)]):
        yield int(top[a]), slice(int(a), int(b))


def in_runs(df: DataFrame, number: str, numbers: int) -> DataFrame:
    """Deal rows out so that each partition gets a run of the values 0 to ``numbers`` - 1 of the column ``number``."""
    n = shuffle_partitions(df.sparkSession)
    return df.repartitionById(n, F.floor(F.col(number) * F.lit(n) / F.lit(numbers)).cast("int"))


def by_bucket(df: DataFrame, bits: int, *order: str) -> DataFrame:
    """Bring the records of a bucket together in one task, buckets one after another."""
    return in_runs(df, "bucket", 1 << bits).sortWithinPartitions("bucket", *order)


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Records of each bucket in turn, from batches sorted by bucket."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["bucket"] != at:
                yield at, rows
                rows = []
            at = row["bucket"]
            rows.append(row)
    if rows:
        yield at, rows


# Token ids of texts, word by word.

#: What Python takes for white space, inside a class of a regular expression of Arrow's.
WHITE_SPACE = (
    r"\t\n\v\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
#: Characters of the longest word that is remembered.
_LONGEST_KEPT = 64


def in_parts(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``size`` bytes of text in ``column``, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


class WordIds:
    """16-bit ids of words, remembered in arrays without an object for each: the first ``kept`` for good, and ``later``
    further ones until there are so many. Long words are not remembered.

    ``encoded`` gives the ids of distinct words. Of a word that matches ``marked`` the last character is looked up in
    ``marks``.
    """

    def __init__(
        self, encoded: Callable[[list[str]], list[bytes]], marks: dict[str, bytes], marked: str, kept: int, later: int
    ) -> None:
        self._encoded, self._marks, self._marked, self._limits = encoded, marks, marked, (kept, later)
        self._words, self._flat, self._sizes = pa.array([], pa.string()), np.empty(0, "<u2"), np.empty(0, np.int32)

    def _forget(self) -> None:
        kept, later = self._limits
        if len(self._words) > kept + later:
            self._words, self._sizes = pa.concat_arrays([self._words.slice(0, kept)]), self._sizes[:kept].copy()
            self._flat = self._flat[: self._sizes.sum()].copy()

    def _remember(self, new: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        short = pc.utf8_length(new).to_numpy() <= _LONGEST_KEPT
        self._words = pa.concat_arrays([self._words, new.filter(pa.array(short))])
        self._flat = np.concatenate([self._flat, flat[np.repeat(short, sizes)]])
        self._sizes = np.concatenate([self._sizes, sizes[short]])

    def _stems(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words less the mark that ends them, and the number of that mark, from 1; 0 without one."""
        which = np.zeros(len(words), np.int8)
        for i, mark in enumerate(self._marks):
            which[pc.ends_with(words, mark).to_numpy(zero_copy_only=False)] = i + 1
        at = np.flatnonzero(which)
        some = words.take(pa.array(at))
        holds = pc.match_substring_regex(some, self._marked)
        which[at[~holds.to_numpy(zero_copy_only=False)]] = 0
        stems = pc.utf8_rtrim(some.filter(holds), "".join(self._marks))
        return pc.replace_with_mask(words, pa.array(which > 0), stems), which

    def of(self, texts: pa.Array, heads: list[bytes], end: bytes) -> pa.Array:
        """Ids of texts given as lists of words, each after its own ``heads`` and before ``end``."""
        self._forget()
        offsets = texts.offsets.to_numpy().astype(np.int64)
        n, words = len(texts), texts.values.slice(offsets[0], offsets[-1] - offsets[0])
        counts = np.diff(offsets)
        stems, which = self._stems(words)
        at = pc.index_in(stems, value_set=self._words)
        unknown = pc.is_null(at)
        at, missing = at.fill_null(-1).to_numpy().copy(), unknown.to_numpy(zero_copy_only=False)
        more = stems.filter(unknown).dictionary_encode()
        at[missing] = len(self._words) + more.indices.to_numpy()
        new_ids = self._encoded(more.dictionary.to_pylist())
        new_flat, new_sizes = np.frombuffer(b"".join(new_ids), "<u2"), np.array([len(x) // 2 for x in new_ids], np.int32)
        others = [*self._marks.values(), end, *heads]
        flat = np.concatenate([self._flat, new_flat, np.frombuffer(b"".join(others), "<u2")])
        sizes = np.concatenate([self._sizes, new_sizes, np.array([len(x) // 2 for x in others], np.int32)])
        base = len(self._words) + len(new_ids)
        # Each text is its head, its words, each before its mark, and the end.
        ends = np.zeros(len(words) + 1, np.int32)
        np.cumsum(1 + (which > 0), out=ends[1:])
        number = np.arange(n, dtype=np.int32)
        order = np.empty(ends[-1] + 2 * n, np.int32)
        place = ends[:-1] + np.repeat(2 * number + 1, counts)
        order[place] = at
        order[place[which > 0] + 1] = base - 1 + which[which > 0].astype(np.int32)
        bounds = ends[offsets - offsets[0]]
        last = bounds[1:] + 2 * number + 1
        order[bounds[:-1] + 2 * number] = base + len(self._marks) + 1 + number
        order[last] = base + len(self._marks)
        long = sizes[order]
        until = np.cumsum(long, dtype=np.int32)
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        source = np.repeat(begins[order] - until + long, long)
        source += np.arange(len(source), dtype=np.int32)
        ids = flat[source]
        self._remember(more.dictionary, new_flat, new_sizes)
        cuts = np.concatenate([[0], 2 * until[last].astype(np.int64)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(ids)])


def row_key() -> F.Column:
    """Names a document row by its content; equal rows share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
