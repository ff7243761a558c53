"""Token ids on disk as wavelet matrices: one compressed file a shard, read by position, by count and by occurrence."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import WordIds, in_parts, shared_folder, shuffle_partitions, stored

#: Id that ends a document.
END = 1
#: Tokens after which a shard is closed at the end of a document.
SHARD_TOKENS = 1 << 21
_MAGIC = b"TMWAVE01"
#: Magic, tokens, documents, bits, then length and place of the document table.
_HEAD = struct.Struct("<8sQQIQQ")
#: Bits of a plane that are compressed together.
_BLOCK = 1 << 16
#: Words whose ids a process remembers for good, further ones until there are so many, and alphabetic words encoded in one call.
_KEPT, _KEPT_LATER, _WORDS_A_CALL = 400_000, 200_000, 64
#: Bytes of text that are encoded at once.
_AT_ONCE = 6 << 20
_MARKS = ".,"
#: What Python alone takes for white space; and what the order of lowering and composing letters matters to.
_NO_SPACE = re.compile("[\x1c-\x1f]")
_NOT_LOWERED = re.compile("[\x1c-\x1f\u03a3\u0130\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
#: The same as :data:`_NOT_LOWERED`, names of special tokens, and white space that is not ASCII, for Arrow.
_ODD = (
    r"<\||[\x1c-\x1f\x{3a3}\x{130}\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}"
    r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


# The matrix.


def planes_of(ids: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Bits of each level, highest first, packed, and how many are 0; each level lists the last one's zeros first."""
    kind = ids.dtype.type
    for level in range(bits - 1, -1, -1):
        ones = (ids & kind(1 << level)) != 0
        zeros = np.compress(~ones, ids)
        yield np.packbits(ones), len(zeros)
        ids = np.concatenate([zeros, np.compress(ones, ids)])


def ids_from(planes: list[np.ndarray], zeros: list[int], n: int, kind: np.dtype) -> np.ndarray:
    """All ids of a matrix, from its lowest level up."""
    ids = np.zeros(n, kind)
    for level, (packed, k) in enumerate(zip(reversed(planes), reversed(zeros))):
        bit = np.unpackbits(packed, count=n)
        ones = bit.view(bool)
        before = np.empty(n, kind)
        before[~ones], before[ones] = ids[:k], ids[k:]
        before |= bit.astype(kind) << kind.type(level)
        ids = before
    return ids


def _kind(bits: int) -> np.dtype:
    return np.dtype("<u2") if bits <= 16 else np.dtype("<u4")


def _ones(packed: np.ndarray) -> int:
    return int(np.bitwise_count(packed).sum(dtype=np.int64))


def shard_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int) -> bytes:
    """The file of one shard: its documents' ids and lengths, then each level's blocks with the ones before each block."""
    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([x is not None for x in doc_ids], np.uint8)
    own = np.array([0 if x is None else x for x in doc_ids], "<i8")
    table = [known.tobytes(), own.tobytes(), np.array(lengths, "<u8").tobytes()]
    body: list[bytes] = []
    for packed, zeros in planes_of(ids.astype(_kind(bits)), bits):
        parts = [packed[i : i + _BLOCK // 8] for i in range(0, len(packed), _BLOCK // 8)]
        blocks = [min(x.tobytes(), press(x.tobytes()), key=len) for x in parts]
        before = np.cumsum([0, *map(_ones, parts)])[:-1]
        sizes = [len(x) for x in blocks]
        table += [struct.pack("<Q", zeros), before.astype("<u8").tobytes(), np.array(sizes, "<u4").tobytes()]
        body += blocks
    packed_table = press(b"".join(table))
    at = _HEAD.size
    head = _HEAD.pack(_MAGIC, len(ids), len(doc_ids), bits, len(packed_table), at + sum(map(len, body)))
    return b"".join([head, *body, packed_table])


class Shard:
    """A shard's file, of which only the parts needed are read.

    ``read(offset, size)`` returns bytes of the file. Places and ranges count the shard's tokens from 0.
    """

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self._read = read
        magic, self.n, docs, self.bits, size, at = _HEAD.unpack(read(0, _HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        table = memoryview(zstandard.ZstdDecompressor().decompress(read(at, size)))
        taken = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal taken
            found = np.frombuffer(table, kind, count, taken)
            taken += found.nbytes
            return found

        known, own, self.lengths = take("u1", docs), take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.doc_ids = [int(x) if k else None for x, k in zip(own, known)]
        blocks = -(-self.n // _BLOCK)
        self.zeros, self._before, self._sizes, self._at = [], [], [], []
        place = _HEAD.size
        for _ in range(self.bits):
            self.zeros.append(int(take("<u8", 1)[0]))
            self._before.append(take("<u8", blocks).astype(np.int64))
            self._sizes.append(take("<u4", blocks).astype(np.int64))
            self._at.append(place + np.cumsum(np.r_[0, self._sizes[-1]])[:-1])
            place += int(self._sizes[-1].sum())
        self._block = lru_cache(maxsize=256)(self._block_now)

    def _block_now(self, level: int, i: int) -> np.ndarray:
        """Packed bits of one block."""
        size = -(-min(_BLOCK, self.n - i * _BLOCK) // 8)
        raw = self._read(int(self._at[level][i]), int(self._sizes[level][i]))
        return np.frombuffer(raw if len(raw) == size else zstandard.ZstdDecompressor().decompress(raw, size), np.uint8)

    def _rank(self, level: int, place: int) -> int:
        """Ones of a level before ``place``."""
        i, inside = divmod(place, _BLOCK)
        if i == len(self._before[level]):
            return self.n - self.zeros[level]
        bits = self._block(level, i)
        whole, rest = divmod(inside, 8)
        ones = int(self._before[level][i]) + _ones(bits[:whole])
        return ones + (int(bits[whole]) >> (8 - rest)).bit_count() if rest else ones

    def _select(self, level: int, bit: int, which: np.ndarray) -> np.ndarray:
        """Places of the given bits of a level, counted from 0 among bits that are alike."""
        starts = np.arange(len(self._before[level]), dtype=np.int64) * _BLOCK
        before = self._before[level] if bit else starts - self._before[level]
        block = np.searchsorted(before, which, "right") - 1
        out = np.empty(len(which), np.int64)
        for i in np.unique(block):
            held = np.unpackbits(self._block(level, int(i)), count=min(_BLOCK, self.n - int(i) * _BLOCK))
            mine = block == i
            out[mine] = np.flatnonzero(held == bit)[which[mine] - before[i]] + starts[i]
        return out

    def access(self, place: int) -> int:
        """The id at a place: one block of each level is read."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        found = 0
        for level in range(self.bits):
            i, inside = divmod(place, _BLOCK)
            bit = int(self._block(level, i)[inside >> 3]) >> (7 - (inside & 7)) & 1
            ones = self._rank(level, place)
            place = self.zeros[level] + ones if bit else place - ones
            found = found << 1 | bit
        return found

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token in ``start`` to ``end`` lie below the last level."""
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank(level, start), self._rank(level, end)
            if token >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token occurs from ``start`` to before ``end``: two ranks a level."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ascending places of a token from ``start`` to before ``end``: one selection a level."""
        a, b = self._range(token, start, self.n if end is None else end)
        at = np.arange(a, b, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return np.sort(at)

    def ids(self) -> np.ndarray:
        """All ids in order."""
        planes = [
            np.concatenate([self._block_now(level, i) for i in range(len(self._before[level]))] or [np.empty(0, np.uint8)])
            for level in range(self.bits)
        ]
        return ids_from(planes, self.zeros, self.n, _kind(self.bits))


# Ids of texts.


class Ids:
    """Token ids of texts as little-endian 16-bit numbers, ended by ``END``.

    The vocabulary's pieces never cross white space, so ids of words are remembered. (Texts with one of the four
    separators that Python alone takes for white space are encoded whole.) The tokenizer lowers letters, so words are
    remembered in lower case, but for texts in which that could change how letters are composed. New words of letters only are
    encoded many in a call and cut after each id that ends a word; all others one by one.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self._tokenizer.get_vocab()
        self.bits = max(1, (max(vocabulary.values())).bit_length())
        if self.bits > 16:
            raise ValueError("ids must fit 16 bits")
        self._ends = np.zeros(1 << 16, bool)
        self._ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self._end = np.array([END], "<u2").tobytes()
        marks = dict(zip(_MARKS, self._one_by_one(list(_MARKS))))
        # A mark after a letter is a piece of its own, so the word alone is encoded, once.
        self._known = WordIds(self._encoded, marks, r"[^\P{L}\x{130}][.,]\z", _KEPT, _KEPT_LATER)

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u2").tobytes() for x in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters only, each of which one id ends."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u2")
        ends = np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words):
            return self._one_by_one(words)
        raw, cuts = ids.tobytes(), [0, *(2 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encoded(self, words: list[str]) -> list[bytes]:
        found: dict[str, bytes] = {}
        plain = [x for x in words if x.isalpha() and x.lower().isalpha() and unicodedata.is_normalized("NFC", x)]
        for i in range(0, len(plain), _WORDS_A_CALL):
            some = plain[i : i + _WORDS_A_CALL]
            found.update(zip(some, self._together(some)))
        rest = [x for x in words if x not in found]
        found.update(zip(rest, self._one_by_one(rest)))
        return [found[x] for x in words]

    @staticmethod
    def _words(text: str) -> list[str]:
        # A name of a special token in capitals is ordinary text.
        if "<|" not in text and not _NOT_LOWERED.search(text):
            return text.lower().split()
        return [text] if _NO_SPACE.search(text) else text.split()

    def column(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, ended by ``END``."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lowered = [t.lower() for t in texts.filter(pa.array(~odd)).to_pylist()]
        words = pc.ascii_split_whitespace(pa.array(lowered, pa.string()))
        if odd.any():
            cut = pa.array([self._words(t) for t in texts.filter(pa.array(odd)).to_pylist()], words.type)
            order = np.empty(len(odd), np.int64)
            order[np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]] = np.arange(len(odd))
            words = pa.concat_arrays([words, cut]).take(pa.array(order))
        return self._known.of(words, [b""] * len(words), self._end)

    def of(self, texts: list[str]) -> list[bytes]:
        return self.column(pa.array(texts, pa.string())).to_pylist()


@lru_cache(maxsize=4)
def ids_of(tokenizer_file: str) -> Ids:
    """The process's own tokenizer; what it remembers serves all tasks that run there."""
    return Ids(tokenizer_file)


# Files.

_FILES = "part long, shard long, path string, tokens long, documents long"


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark finds it in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path.removeprefix("file://").removeprefix("file:"))


def _write(tokenizer_file: str, folder: str, shard_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer = ids_of(tokenizer_file)
        part, number = TaskContext.get().partitionId(), 0
        fs, base = _filesystem(folder)
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            # A name of its own for each attempt: only files that a finished task names are part of the result.
            path = f"{base}/{part:05d}-{number:05d}-{uuid.uuid4().hex}.wave"
            ids = np.frombuffer(b"".join(held), "<u2")
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(path, compression=None) as out:
                out.write(shard_bytes(ids, doc_ids, [len(x) // 2 for x in held], tokenizer.bits))
            row = [part, number, f"{folder}/{path.rsplit('/', 1)[-1]}", len(ids), len(doc_ids)]
            return pa.RecordBatch.from_pylist([dict(zip(("part", "shard", "path", "tokens", "documents"), row))])

        for part_of in (x for batch in batches for x in in_parts(batch, "body", _AT_ONCE)):
            own, texts = part_of.column("id").to_pylist(), part_of.column("body").fill_null("")
            for doc_id, ids in zip(own, tokenizer.column(texts).to_pylist()):
                doc_ids.append(doc_id)
                held.append(ids)
                tokens += len(ids) // 2
                if tokens >= shard_tokens:
                    yield close()
                    number, doc_ids, held, tokens = number + 1, [], [], 0
        if doc_ids:
            yield close()

    return run


def write_shards(
    docs: DataFrame, tokenizer_file: str, folder: str | None = None, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encode every whole text (null: empty), end it by id 1, and write all ids as shards, by ascending ``doc_id``.

    Returns a row for each file: ``path``, ``start`` (ids in the files before it), ``tokens``, ``documents``. A null id
    comes first; rows with one id, or none, are ordered by a hash of their text, and equal rows are kept. An empty table
    gives no file. Other columns are not looked at.

    Each file holds whole documents, about ``shard_tokens`` tokens; a longer document has a file of its own. Documents
    are dealt by ranges of id and hash, so no id gathers in a task; a task holds one shard. ``folder`` must be reachable
    from all executors (default: a new one in the shared folder). Files that a lost or repeated task leaves are named by
    no row.
    """
    spark = docs.sparkSession
    folder = _qualified(spark, folder or shared_folder(spark))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("mark"),
        F.monotonically_increasing_id().alias("row"),
        F.col("text").alias("body"),
    )
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "id", "mark", "row").sortWithinPartitions("id", "mark")
    files = stored(dealt.mapInArrow(_write(tokenizer_file, folder, shard_tokens), _FILES))
    # Places: sums by part first, so no window holds a row for each file.
    parts = files.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.select("part", F.coalesce(F.sum("part_tokens").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    return stored(
        files.withColumn("inside", inside).join(begun, "part").select(
            "path", (F.col("base") + F.col("inside")).alias("start"), "tokens", "documents"
        )
    )


def open_shard(path: str) -> Shard:
    fs, name = _filesystem(path)
    file = fs.open_input_file(name)
    return Shard(lambda at, size: file.read_at(size, at))


def _over_files(files: DataFrame, body: Callable[[Shard, int, str], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``body`` makes of each shard, its start and its path; shards are dealt out evenly."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for columns in body(open_shard(row["path"]), row["start"], row["path"]):
                    yield pa.RecordBatch.from_pydict({k: columns[k] for k in names})

    return files.repartition(shuffle_partitions(files.sparkSession), "path").mapInArrow(run, schema)


def read_documents(files: DataFrame) -> DataFrame:
    """Documents of the shards: ``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids`` (little-endian 32-bit)."""

    def body(shard: Shard, start: int, path: str) -> Iterator[dict]:
        raw = shard.ids().astype("<u4").tobytes()
        cuts = np.r_[0, np.cumsum(shard.lengths)]
        for i in range(0, len(shard.doc_ids), 256):
            own = slice(i, i + 256)
            a, b = cuts[:-1][own], cuts[1:][own]
            yield {
                "doc_id": pa.array(shard.doc_ids[own], pa.int64()),
                "start": pa.array(a + start, pa.int64()),
                "n_tokens": pa.array(b - a, pa.int64()),
                "ids": pa.array([raw[4 * x : 4 * y] for x, y in zip(a, b)], pa.binary()),
            }

    return _over_files(files, body, "doc_id long, start long, n_tokens long, ids binary")


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """``token`` and ``n`` for each of the given ids, by ranks in each shard."""

    def body(shard: Shard, start: int, path: str) -> Iterator[dict]:
        yield {"token": pa.array(tokens, pa.int64()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())}

    return _over_files(files, body, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(files: DataFrame, tokens: list[int]) -> DataFrame:
    """``token``, ``doc_id``, ``place`` (from 0 in the document) for each occurrence of the given ids, by selections."""

    def body(shard: Shard, start: int, path: str) -> Iterator[dict]:
        ends = np.cumsum(shard.lengths)
        for token in tokens:
            at = shard.locate(token)
            doc = np.searchsorted(ends, at, "right")
            yield {
                "token": pa.array(np.full(len(at), token), pa.int64()),
                "doc_id": pa.array([shard.doc_ids[d] for d in doc], pa.int64()),
                "place": pa.array(at - (ends - shard.lengths)[doc], pa.int64()),
            }

    return _over_files(files, body, "token long, doc_id long, place long")


def digest(files: DataFrame) -> DataFrame:
    """Per document, read back from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""

    def body(shard: Shard, start: int, path: str) -> Iterator[dict]:
        raw = memoryview(shard.ids().astype("<u4").tobytes())
        cuts = np.r_[0, np.cumsum(shard.lengths)]
        yield {
            "doc_id": pa.array(shard.doc_ids, pa.int64()),
            "start": pa.array(cuts[:-1] + start, pa.int64()),
            "n_tokens": pa.array(shard.lengths, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts, cuts[1:])], pa.int64()),
        }

    return _over_files(files, body, "doc_id long, start long, n_tokens long, ids_crc32 long")
