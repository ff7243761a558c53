"""Packing of documents into training sequences, neighbours on a space-filling curve next to each other."""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import U64, WHITE_SPACE, WordIds, giving_back, in_parts, in_runs, mixed, shuffle_partitions, stored

LENGTH = 2048
#: Id that ends a document.
END = 1
DIMENSIONS = 3
CURVE_BITS = 13
#: Low bits of the key that order documents of one curve cell.
_TIE_BITS = 64 - DIMENSIONS * CURVE_BITS - 1
_SEED = 20240229
#: Runs of the curve for each shuffle partition.
_CHUNKS = 4
#: Words whose ids are remembered for good, and further ones until there are so many; words encoded in one call.
_KEPT, _KEPT_LATER, _WORDS_A_CALL = 60_000, 40_000, 256
#: Bytes of text that are encoded at once.
_AT_ONCE = 1 << 20
_MARKS = ",."

# A single space between two other characters always begins a piece of its own in byte-level BPE.
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_SPACE_BY_SPACE = rf"\A[{WHITE_SPACE}]|[{WHITE_SPACE}]{{2}}| \z"


class Ids:
    """Token ids of texts as little-endian 16-bit numbers.

    Ids of a text's words are remembered: those seen first, which the frequent ones are among, and some of the rest.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None) -> None:
        """``ranks_file``: the same vocabulary as ranks; new words are then merged by it, twice as fast."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self._ranked = None
        if ranks_file is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self._ranked = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._begins = np.zeros(1 << 16, bool)
            self._begins[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        added = [str(x.content) for x in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self._end = np.array([END], "<u2").tobytes()
        marks = dict(zip(_MARKS, self._encoded(list(_MARKS))))
        # A mark after a letter is a token of its own, so the word alone is encoded, once.
        self._words = WordIds(self._encoded_words, marks, r"\pL[,.]\z", _KEPT, _KEPT_LATER)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H", x.ids).tobytes() for x in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words, of which only the first id of each begins with a space."""
        ids = np.array(self._ranked.encode_ordinary(" " + " ".join(words)), "<u2")
        first = np.flatnonzero(self._begins[ids])
        if len(first) != len(words):
            return [array("H", self._ranked.encode_ordinary(f" {x}")).tobytes() for x in words]
        raw, cuts = ids.tobytes(), [*(2 * first).tolist(), 2 * len(ids)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a space before it."""
        if self._ranked is None:
            return self._encoded([f" {x}" for x in words])
        found = [x for i in range(0, len(words), _WORDS_A_CALL) for x in self._together(words[i : i + _WORDS_A_CALL])]
        for i, x in enumerate(words):
            if "<" in x and self._special.search(x):
                found[i] = self._encoded([f" {x}"])[0]
        return found

    def column(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, ended by ``END``."""
        cut = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, _SPACE_BY_SPACE).to_numpy(zero_copy_only=False)
        if odd.any():
            parts = [_INNER_SPACE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            order = np.empty(len(odd), np.int64)
            order[np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]] = np.arange(len(odd))
            cut = pa.concat_arrays([cut.filter(pa.array(~odd)), pa.array(parts, cut.type)]).take(pa.array(order))
        # The first word has no space before it.
        offsets = cut.offsets.to_numpy()
        first = np.zeros(len(cut.values), bool)
        first[offsets[:-1]] = True
        heads = self._encoded(cut.values.filter(pa.array(first)).to_pylist())
        rest = cut.values.filter(pa.array(~first))
        return self._words.of(pa.ListArray.from_arrays(offsets - np.arange(len(offsets), dtype=np.int32), rest), heads, self._end)

    def of(self, texts: list[str]) -> list[bytes]:
        return self.column(pa.array(texts, pa.string())).to_pylist()


_tokenizers: dict[tuple, Ids] = {}


def ids_of(tokenizer_file: str, ranks_file: str | None = None) -> Ids:
    """The process's own tokenizer; what it remembers serves all tasks that run there."""
    key = (tokenizer_file, ranks_file)
    if key not in _tokenizers:
        _tokenizers[key] = Ids(*key)
    return _tokenizers[key]


def directions(size: int) -> np.ndarray:
    """In each dimension, a pseudo-random sign of each id."""
    bits = mixed(np.arange(size, dtype=U64) + U64(_SEED))
    return np.stack([((bits >> U64(7 * i)) & U64(1)).astype(np.int8) * 2 - 1 for i in range(DIMENSIONS)])


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (non-negative, below ``2 ** bits``) on a Hilbert curve through all cells."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    # Undo the rotations and reflections of the curve's parts, from the largest to the smallest.
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ (swap if i else 0)
    # From here the bits, dimension by dimension, are the Gray code of the place.
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


def cells_of(points: np.ndarray, bits: int) -> np.ndarray:
    """Points of any size in a grid of ``2 ** bits`` cells a side."""
    share = 0.5 + np.arctan(points / 2) / np.pi
    return np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def _encode(tokenizer_file: str, ranks_file: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, signs = ids_of(tokenizer_file, ranks_file), directions(1 << 16)
        for batch in batches:
            for part in in_parts(batch, "text", _AT_ONCE):
                ids = tokenizer.column(part.column("text").fill_null(""))
                begins = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // 2
                counts = np.diff(begins).astype(np.int64)
                flat = np.frombuffer(ids.buffers()[2], "<u2")
                sums = np.stack([np.add.reduceat(s[flat], begins[:-1], dtype=np.int64) for s in signs], 1)
                points = (sums / np.sqrt(counts)[:, None]).astype(np.float32)
                own = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                ties = (mixed(own.view(U64)) >> U64(64 - _TIE_BITS)).astype(np.int64)
                keys = (hilbert_key(cells_of(points, CURVE_BITS), CURVE_BITS) << _TIE_BITS) | ties
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys), pa.array(counts), ids],
                    names=["doc_id", "key", "n", "ids"],
                )
            pa.default_memory_pool().release_unused()

    return run


class Cuts:
    """Where sequences begin when ``total`` ids are laid end to end.

    All have ``length`` ids but those of the last, incomplete one, which is cut into powers of two: sequences of such
    a length need no padding.
    """

    def __init__(self, total: int, length: int) -> None:
        self.length, self.full = length, total // length * length
        rest = total - self.full
        sizes = [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = [self.full + sum(sizes[:i]) for i in range(len(sizes) + 1)]

    def at(self, place: int) -> tuple[int, int, int]:
        """Sequence that holds ``place``, where it begins, and where it ends."""
        if place < self.full:
            s = place // self.length
            return s, s * self.length, (s + 1) * self.length
        i = next(i for i, b in enumerate(self.tail[1:]) if place < b)
        return self.full // self.length + i, self.tail[i], self.tail[i + 1]


_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _lay(begins: dict[int, int], total: int, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, chunk, place = Cuts(total, length), None, 0
        names = [f.split()[0] for f in _PIECE.split(", ")]
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            columns = [batch.column(c).to_pylist() for c in ("chunk", "doc_id", "n", "ids")]
            for c, doc_id, n, ids in zip(*columns):
                if c != chunk:
                    chunk, place = c, begins[c]
                start = 0
                while start < n:
                    sequence, begin, end = cuts.at(place)
                    size = min(n - start, end - place)
                    piece = ids[2 * start : 2 * (start + size)]
                    for name, value in zip(names, (doc_id, start, size, n, sequence, place - begin, piece)):
                        out[name].append(value)
                    start, place = start + size, place + size
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=names
            )

    return run


def pack_documents(
    docs: DataFrame, tokenizer_file: str, length: int = LENGTH, ranks_file: str | None = None
) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids, neighbours on a Hilbert curve side by side.

    A document's ids, ended by ``END``, are hashed to signs in a few dimensions; the sum gives its place on the curve.
    Documents are laid end to end in the order of the curve and cut every ``length`` ids, so only the very last
    sequence can be incomplete, and that is cut into powers of two (see :class:`Cuts`).

    Takes ``doc_id`` and ``text``, leaves other columns out, and returns a row for each piece: ``doc_id``, ``start`` in
    the document, ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence, and ``ids`` (16-bit,
    little-endian). A null or empty text is the single id ``END``; a null ``doc_id`` stays null; repeated rows are
    packed each; an empty table gives no pieces. ``tokenizer_file``, and ``ranks_file`` with the same vocabulary for
    another library (optional, faster), must exist on every executor.

    Ids are computed once and stored, then shuffled once in runs of the curve. Where runs begin comes from percentiles
    of the keys, and where they lie from their sums, so the driver sees two numbers for each run. Equal documents have
    equal places, and share a cell's further bits by ``doc_id``; none of them needs to be in one task.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = stored(docs.mapInArrow(giving_back(_encode(tokenizer_file, ranks_file)), "doc_id long, key long, n long, ids binary"))
    chunks = shuffle_partitions(spark) * _CHUNKS
    share = [i / chunks for i in range(1, chunks)]
    bounds = np.unique(np.array(encoded.agg(F.percentile_approx("key", share, 100 * chunks)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def chunk_of(key):
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype(np.int32))

    cut = encoded.withColumn("chunk", chunk_of("key"))
    begins, total = {}, 0
    for row in sorted(cut.groupBy("chunk").agg(F.sum("n").alias("n")).collect()):
        begins[row.chunk], total = total, total + row.n
    ordered = in_runs(cut, "chunk", len(bounds) + 1).sortWithinPartitions("chunk", "key", "doc_id")
    return ordered.select("chunk", "doc_id", "n", "ids").mapInArrow(giving_back(_lay(begins, total, length)), _PIECE)


@F.pandas_udf(T.LongType())
def ids_crc32(ids):
    """CRC-32 of ids as little-endian 32-bit numbers."""
    return ids.map(lambda x: zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
