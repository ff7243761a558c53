"""Packing against the plain tokenizer: every id once, sequences full, neighbours close."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from trailmark.llm import packing
from trailmark.llm.queries import tokenizer_file


def plain_ids(text):
    t = Tokenizer.from_file(tokenizer_file())
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("ranks", [None, "tiktoken"])
def test_ids_equal_the_tokenizers(rows, ranks):
    ids = packing.Ids(tokenizer_file(), ranks and tokenizer_file(ranks))
    texts = [r[1] or "" for r in rows]
    assert [np.frombuffer(x, "<u2").tolist() for x in ids.of(texts)] == [plain_ids(t) for t in texts]


@pytest.mark.parametrize("length", [64, 2048])
def test_each_id_lies_in_one_piece(docs, rows, length):
    pieces = packing.pack_documents(docs, tokenizer_file(), length).collect()
    of = defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
    expected = defaultdict(list)
    for doc_id, text, *_ in rows:
        expected[doc_id].append(plain_ids(text))
    for doc_id, found in of.items():
        want = Counter(tuple(x) for x in expected[doc_id])
        if len(want) == 1 and sum(want.values()) == 1:
            found.sort(key=lambda p: p.start)
            ids = [i for p in found for i in np.frombuffer(p.ids, "<u2").tolist()]
            assert ids == expected[doc_id][0]
            assert [p.start for p in found] == list(np.cumsum([0, *[p.length for p in found]])[:-1])
        assert sum(p.length for p in found) == sum(len(x) for x in expected[doc_id])
    assert set(of) == set(expected)
    laid = defaultdict(list)
    for p in pieces:
        laid[p.sequence_id].append((p.offset, p.length))
    assert sorted(laid) == list(range(len(laid)))
    sizes = []
    for parts in laid.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        sizes.append(at)
    assert all(s == length or (s & (s - 1)) == 0 for s in sizes)
    assert sum(s != length for s in sizes) <= length.bit_length()


def test_crc_and_empty_table(docs, no_docs):
    row = packing.digest(packing.pack_documents(docs.filter("doc_id = 0"), tokenizer_file())).collect()
    assert [r.ids_crc32 for r in row] == [zlib.crc32(np.array([packing.END], "<u4").tobytes())]
    assert packing.pack_documents(no_docs, tokenizer_file()).count() == 0


def test_curve_visits_each_cell_once_and_steps_to_a_neighbour():
    bits = 3
    grid = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij")], 1)
    keys = packing.hilbert_key(grid, bits)
    assert sorted(keys.tolist()) == list(range(1 << 3 * bits))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_copies_lie_next_to_each_other(docs, rows):
    pieces = packing.pack_documents(docs, tokenizer_file()).collect()
    base = {r[0] for r in rows if r[1] == rows[6][1]}
    order = [p.doc_id in base for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    first, last = order.index(True), len(order) - order[::-1].index(True)
    assert all(order[first:last])


@pytest.mark.parametrize("ranks", [None, "tiktoken"])
def test_words_forgotten_and_long_ones(monkeypatch, rows, ranks):
    monkeypatch.setattr(packing, "_KEPT", 5)
    monkeypatch.setattr(packing, "_KEPT_LATER", 5)
    ids = packing.Ids(tokenizer_file(), ranks and tokenizer_file(ranks))
    texts = [*(r[1] or "" for r in rows), "a, b. c,, d., é. İ. ,", "x" * 1000 + ", y", " lead", "trail ", "two  spaces", "a\n b"]
    texts += ["the <|endoftext|> end", "the <|endoftext|>, end.", "　wide 　x"]
    for _ in range(2):
        column = ids.column(packing.pa.array(["not this", *texts]).slice(1))
        assert [np.frombuffer(x, "<u2").tolist() for x in column.to_pylist()] == [plain_ids(t) for t in texts]
        assert max(map(len, ids._words._words.to_pylist())) <= 64
    assert len(ids._words._words) < 1000
