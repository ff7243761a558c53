"""Removal of long passages that occur more than once, found through difference-cover anchors.

Words at positions ``p`` of a document with ``p mod PERIOD`` in ``COVER`` are anchors. ``COVER`` is a difference cover:
for any two positions there is a shift below ``PERIOD`` that takes both to anchors. So wherever two windows of
``window`` words are equal, two anchored runs of ``window - PERIOD + 1`` words inside them are equal too, at the same
place. Hashing only these runs finds every region that can hold a repeated window; whole windows are then hashed,
and compared across the corpus, only there.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import (
    U64,
    Windows,
    WordHashes,
    as_bytes,
    bucket_bits,
    by_bucket,
    cut_by_bucket,
    grouped,
    row_key,
)

# A difference cover of 5 residues modulo 21.
PERIOD = 21
COVER = (0, 1, 6, 8, 18)

#: Bits of the filter of repeated anchors: 16 MB in every task, whatever the input's size. Collisions only add regions
#: to be compared.
FILTER_BITS = 27
#: Hashes gathered in a task before they are dealt out.
GATHERED = 1_500_000

_IS_ANCHOR = np.isin(np.arange(PERIOD), COVER)
_BLOCK = "bucket int, block binary"
_ENTRY = np.dtype([("key", "<u8"), ("pos", "<u4")])


def _anchors(hashes: np.ndarray, window: int, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    runs = windows.of(hashes, window - PERIOD + 1)
    at = np.flatnonzero(np.resize(_IS_ANCHOR, len(runs)))
    return runs[at], at


def _anchor_blocks(window: int, bits: int) -> Callable:
    def blocks(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        keys = np.repeat(keys, np.minimum(counts, 2))  # two of a kind tell as much as all
        cut = list(cut_by_bucket(keys, bits))
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array([b for b, _ in cut], pa.int32()), "block": [keys[s].tobytes() for _, s in cut]}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, parts, held = WordHashes(), Windows(), [], 0
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                tokens = text.split()
                if len(tokens) < window:
                    continue
                parts.append(_anchors(words.of(tokens), window, windows)[0])
                held += len(parts[-1])
                if held >= GATHERED:
                    yield from blocks(parts)
                    parts, held = [], 0
        if parts:
            yield from blocks(parts)

    return run


def _repeated_bits(bits: int) -> Callable:
    """Of each bucket, its stretch of the filter: a bit for each repeated anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches):
            keys = np.sort(np.frombuffer(b"".join(r["block"] for r in rows), U64))
            again = keys[1:][keys[1:] == keys[:-1]]
            flags = np.zeros(1 << (FILTER_BITS - bits), bool)
            flags[((again << U64(bits)) >> U64(64 - FILTER_BITS + bits)).astype(np.int64)] = True
            block = zlib.compress(np.packbits(flags).tobytes(), 1)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "block": [block]})

    return run


def repeated_anchor_filter(docs: DataFrame, window: int) -> np.ndarray:
    """Bitmap of ``2 ** FILTER_BITS`` bits with a bit set for every anchor that occurs twice or more in the corpus."""
    bits = bucket_bits(docs.sparkSession)
    anchors = docs.select("text").mapInArrow(_anchor_blocks(window, bits), _BLOCK)
    stretch = (1 << (FILTER_BITS - bits)) // 8
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in by_bucket(anchors, bits).mapInArrow(_repeated_bits(bits), _BLOCK).collect():
        out[row.bucket * stretch : (row.bucket + 1) * stretch] = np.frombuffer(zlib.decompress(row.block), np.uint8)
    return out


def _suspects(hashes: np.ndarray, window: int, windows: Windows, seen: np.ndarray) -> np.ndarray:
    """Starts of windows that hold an anchor of the filter at the aligned place."""
    runs, at = _anchors(hashes, window, windows)
    bit = (runs >> U64(64 - FILTER_BITS)).astype(np.int64)
    hit = at[(seen[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(edge, hit + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: len(hashes) - window + 1] > 0)


def _window_blocks(window: int, bits: int, broadcast) -> Callable:
    def blocks(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes, keys, at = (np.concatenate(x) for x in zip(*parts))
        top = hashes >> U64(64 - bits)
        order = np.argsort(top, kind="stable")  # documents stay together in a bucket
        top, hashes = top[order], hashes[order]
        entry = np.empty(len(order), _ENTRY)
        entry["key"], entry["pos"] = keys[order], at[order]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        buckets, out = [], []
        for bucket, s in cut_by_bucket(top << U64(64 - bits), bits):
            part = entry[s]
            buckets.append(bucket)
            out.append(squeeze(hashes[s].tobytes() + part["key"].tobytes() + part["pos"].tobytes()))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "block": out})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, seen, parts, held = WordHashes(), Windows(), broadcast.value, [], 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), as_bytes(batch.column("text"))):
                tokens = text.split()
                if len(tokens) < window:
                    continue
                hashes = words.of(tokens)
                at = _suspects(hashes, window, windows, seen)
                if not len(at):
                    continue
                full = windows.of(hashes, window)[at]
                parts.append((full, np.full(len(at), key, np.int64).view(U64), at.astype("<u4")))
                held += len(at)
                if held >= GATHERED:
                    yield from blocks(parts)
                    parts, held = [], 0
        if parts:
            yield from blocks(parts)

    return run


def _repeated_windows(bits: int) -> Callable:
    """Starts of repeated windows, dealt out by the documents they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, rows in grouped(batches):
            hashes, keys, at = [], [], []
            for row in rows:
                raw = unpack(row["block"])
                n = len(raw) // 20
                hashes.append(np.frombuffer(raw, U64, n))
                keys.append(np.frombuffer(raw, U64, n, 8 * n))
                at.append(np.frombuffer(raw, "<u4", n, 16 * n))
            hashes, keys, at = map(np.concatenate, (hashes, keys, at))
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            again = order[np.r_[same, False] | np.r_[False, same]]
            again = again[np.argsort(keys[again], kind="stable")]
            entry = np.empty(len(again), _ENTRY)
            entry["key"], entry["pos"] = keys[again], at[again]
            cut = list(cut_by_bucket(entry["key"], bits))
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([b for b, _ in cut], pa.int32()),
                    "block": pa.array([entry[s].tobytes() for _, s in cut], pa.binary()),
                }
            )

    return run


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


def _without(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, entry = None, [], None
        for batch in batches:
            out = {"doc_id": [], "text": [], "n_words": [], "n_removed": []}
            columns = [batch.column(c).to_pylist() for c in ("bucket", "block", "key", "doc_id")]
            for b, block, key, doc_id, text in zip(*columns, as_bytes(batch.column("text"))):
                if b != bucket:
                    bucket, blocks, entry = b, [], None
                if block is not None:
                    blocks.append(block)
                    continue
                if entry is None:
                    entry = np.frombuffer(b"".join(blocks), _ENTRY)
                    entry = entry[np.argsort(entry["key"], kind="stable")]
                    blocks, keys = [], np.ascontiguousarray(entry["key"])
                key = U64(key & 0xFFFFFFFFFFFFFFFF)
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                tokens = text.split()
                if high > low:
                    gone = covered(len(tokens), np.unique(entry["pos"][low:high]).astype(np.int64), window)
                    kept = [w for w, g in zip(tokens, gone.tolist()) if not g]
                else:
                    kept = tokens
                for name, value in zip(out, (doc_id, b" ".join(kept), len(tokens), len(tokens) - len(kept))):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()),
                    pa.array(out["text"], pa.binary()).cast(pa.string()),
                    pa.array(out["n_words"], pa.int64()),
                    pa.array(out["n_removed"], pa.int64()),
                ],
                names=list(out),
            )

    return run


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Documents without the words that lie in a window of ``window`` words which also starts elsewhere.

    Words are runs without ASCII white space, compared unchanged; "elsewhere" includes the same document. All windows
    are judged on the input, so every copy of a repeated passage goes. ``window`` is at least ``PERIOD`` + 1.

    Takes ``doc_id`` and ``text``; other columns are left out. Returns ``doc_id``, ``text`` (kept words joined by one
    space), ``n_words`` and ``n_removed``, a row for each input row. A null text has no words; a text of fewer than
    ``window`` words keeps all; repeated rows count as occurrences of each other; a null ``doc_id`` stays null.

    Windows are compared by 64-bit hashes. Hot passages cost no more than others: a task keeps two of any anchor it
    meets, and all positions of a window only ever meet as numbers, never as pairs.
    """
    if window <= PERIOD:
        raise ValueError(f"a window must have more than {PERIOD} words")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = spark.sparkContext.broadcast(repeated_anchor_filter(docs, window))
    bits = bucket_bits(spark)
    keyed = docs.withColumn("key", row_key())
    windows = keyed.select("key", "text").mapInArrow(_window_blocks(window, bits, seen), _BLOCK)
    starts = by_bucket(windows, bits).mapInArrow(_repeated_windows(bits), _BLOCK)
    nothing = F.lit(None)
    both = starts.select(
        "bucket", "block", *[nothing.cast(t).alias(n) for n, t in (("key", "long"), ("doc_id", "long"), ("text", "string"))]
    ).unionByName(
        keyed.select(
            F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bucket"),
            nothing.cast("binary").alias("block"), "key", "doc_id", "text",
        )
    )
    # Records of starts have no key and sort before the documents of their bucket.
    return by_bucket(both, bits, "key").mapInArrow(_without(window), "doc_id long, text string, n_words long, n_removed long")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
