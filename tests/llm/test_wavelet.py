"""Token shards: against the tokenizer, and access, counts and occurrences against plain lists."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hard_texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trailmark.llm import wavelet
from trailmark.llm.queries import op12_wavelet_matrix, tokenizer_file

FILE = tokenizer_file(name="word_bpe_49k")


def shard_of(ids, lengths=None, bits=16):
    lengths = lengths or [len(ids)]
    data = wavelet.shard_bytes(np.array(ids, "<u2"), list(range(len(lengths))), lengths, bits)
    return wavelet.Shard(lambda at, size: data[at : at + size])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=300), st.data())
def test_every_question_against_a_list(ids, data):
    shard = shard_of(ids, bits=6)
    assert shard.ids().tolist() == ids
    assert [shard.access(i) for i in range(len(ids))] == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    for token in (*set(ids), 41, 63, 64, -1):
        assert shard.count(token, a, b) == ids[a:b].count(token)
        assert shard.locate(token, a, b).tolist() == [i for i in range(a, b) if ids[i] == token]


@pytest.mark.parametrize("n", [wavelet._BLOCK, 3 * wavelet._BLOCK, 3 * wavelet._BLOCK + 17])
def test_several_blocks_and_few_reads(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50_000
    data = wavelet.shard_bytes(ids, [1], [n], 16)
    reads = []
    shard = wavelet.Shard(lambda at, size: (reads.append(size), data[at : at + size])[1])
    del reads[:]
    for place in (0, 1, n // 2, n - 1):
        assert shard.access(place) == ids[place]
    # At most two blocks of each level for each place.
    assert len(reads) <= 4 * 2 * 16 and sum(reads) <= 4 * 2 * 16 * (wavelet._BLOCK // 8)
    for token in (1, 2, int(ids[-1]), 49_999):
        assert shard.locate(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert shard.count(token, 5, n - 3) == int((ids[5 : n - 3] == token).sum())
    with pytest.raises(IndexError):
        shard.access(n)


def test_compressed():
    ids = [7] * 200_000
    assert len(wavelet.shard_bytes(np.array(ids, "<u2"), [1], [len(ids)], 16)) < 20_000


def expected(rows):
    """Documents in order with their ids and start, from the tokenizer alone."""
    tokenizer = Tokenizer.from_file(FILE)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, wavelet.END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("shard_tokens", [300, 1 << 21])
def test_documents_are_read_back(spark, docs, rows, shard_tokens):
    files = wavelet.write_shards(docs.withColumn("row", docs.n_chars).withColumn("mark", docs.lang), FILE, shard_tokens=shard_tokens)
    found = sorted(map(tuple, wavelet.digest(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [r[0] for r in ordered(rows)]
    # The same documents, whatever the order of rows with one id.
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in expected([r[:2] for r in rows]))
    ends = np.cumsum([r[2] for r in found])
    assert [r[1] for r in found] == [0, *ends[:-1].tolist()]
    if shard_tokens == 300:
        assert files.count() > 10
        assert files.agg({"tokens": "sum"}).first()[0] == ends[-1]


def test_ids_counts_and_occurrences(spark, docs, rows):
    files = wavelet.write_shards(docs, FILE, shard_tokens=500)
    tokenizer = Tokenizer.from_file(FILE)
    lists = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, wavelet.END]) for r in rows]
    read = wavelet.read_documents(files).collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in read) == sorted(
        (str(d), x) for d, x in lists
    )
    tokens = [wavelet.END, lists[6][1][0], 49_000]
    counts = {r["token"]: r["n"] for r in wavelet.count_tokens(files, tokens).collect()}
    assert counts == {t: sum(x.count(t) for _, x in lists) for t in tokens}
    found = [(r["token"], str(r["doc_id"]), r["place"]) for r in wavelet.occurrences(files, tokens).collect()]
    assert sorted(found) == sorted((t, str(d), i) for d, x in lists for i, y in enumerate(x) for t in tokens if y == t)


def test_words_are_encoded_as_in_their_text():
    odd = [
        "J̌ J̌. ǰ Å Å İstanbul İ. ΟΔΟΣ ΟΔΟΣ. it's IT'S. don't, x.y a.b.c., 12,5. 3.", "éa é. ́a . , ., ,. ..",
        "a\x1cb c\x1d d\x85e\xa0f g", "<|endoftext|> a<|startoftext|>b. <|endoftext|>.", "<|ENDOFTEXT|> <|EndOfText|>.", "ß ẞ ﬁn ﬁn. ⅷ ª º. ʰ.", "日本語 日本語. 한국어 ไทย ไทย.",
        "​zero ﻿bom x­.", "'s 's. 'll 'S", "😀😀 😀. a😀.",
    ]
    rng = random.Random(3)
    texts = odd + [prose(rng, 300) for _ in range(20)]
    tokenizer, own = Tokenizer.from_file(FILE), wavelet.Ids(FILE)
    for _ in range(2):
        for text, ids in zip(texts, own.of(texts)):
            expected_ids = [*tokenizer.encode(text, add_special_tokens=False).ids, wavelet.END]
            assert np.frombuffer(ids, "<u2").tolist() == expected_ids, text


def test_empty_table_and_no_texts(spark, no_docs):
    assert wavelet.digest(wavelet.write_shards(no_docs, FILE)).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    found = wavelet.digest(wavelet.write_shards(nulls, FILE)).collect()
    assert sorted(r["start"] for r in found) == [0, 1, 2] and {r["n_tokens"] for r in found} == {1}


def test_very_long_text(spark):
    text = prose(random.Random(1), 60_000)
    df = spark.createDataFrame([(2, text), (1, "short")], "doc_id long, text string")
    found = sorted(map(tuple, wavelet.digest(wavelet.write_shards(df, FILE, shard_tokens=1000)).collect()))
    assert found == expected([(1, "short"), (2, text)])


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12_wavelet_matrix(spark, sf).collect())) == expected(ordered(rows))


def test_words_forgotten_and_long_ones(monkeypatch):
    monkeypatch.setattr(wavelet, "_KEPT", 5)
    monkeypatch.setattr(wavelet, "_KEPT_LATER", 5)
    rng = random.Random(5)
    texts = ["", " a  B\x0bc,\n", "x" * 1000 + ". Y", "İ. ı. É, é.", "a\x1cb. " + "z" * 100, "wide　, b\x85.", *(prose(rng, 50) for _ in range(9))]
    tokenizer, own = Tokenizer.from_file(FILE), wavelet.Ids(FILE)
    for _ in range(2):
        column = own.column(wavelet.pa.array(["not this", *texts]).slice(1))
        for text, ids in zip(texts, column.to_pylist()):
            assert np.frombuffer(ids, "<u2").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, wavelet.END]
        assert max(map(len, own._known._words.to_pylist())) <= 64
    assert len(own._known._words) < 1000
