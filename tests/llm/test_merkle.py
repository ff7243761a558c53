"""The manifest against hash trees built level by level in plain lists."""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pytest

from trailmark.llm import merkle


def plain_tree(leaves: list[str]) -> list[list[str]]:
    """All levels, digests as hex."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha256("".join(at[i : i + 3]).encode()).hexdigest() for i in range(0, len(at), 3)])
    return levels


def plain_siblings(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    found = []
    for at in levels[:-1]:
        run = at[i // 3 * 3 : i // 3 * 3 + 3]
        found.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        i //= 3
    return found


def plain_leaf(doc_id, source, lang, n_chars, text) -> str:
    values = (doc_id, source, lang, n_chars, text)
    return sha256(
        "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()
    ).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each (doc_id, text, lang, source, n_chars)."""
    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = text.replace("\n", "") if even and text is not None else text
        own = plain_leaf(doc_id, source, lang, n_chars, text)
        by_source.setdefault(source, []).append((doc_id, own, plain_leaf(doc_id, source, lang, n_chars, other)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = plain_tree([r[1] for r in by_source[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, other) in enumerate(by_source[s]):
            steps = plain_siblings(trees[s], i) + plain_siblings(top, k)
            proof = sha256("".join(x for _, others in steps for x in others).encode()).hexdigest()
            fold = other
            for own, others in steps:
                fold = sha256("".join([*others[:own], fold, *others[own:]]).encode()).hexdigest()
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return out


def same(found, expected):
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


@pytest.mark.parametrize("leaves", [*range(1, 40), 81, 82, 243, 244, 700, 2187])
def test_each_node_has_one_place_and_subtrees_lie_together(leaves):
    levels = merkle.levels_above(leaves)
    places = merkle.layout(leaves, levels)
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_in(leaves, levels + 1)))
    height = levels + 1
    low = height // 2
    if low:
        # The upper tree first, then each lower tree without a gap.
        upper = np.concatenate(places[low:])
        assert sorted(upper.tolist()) == list(range(len(upper)))
        span = 3 ** (low - 1)
        for tree in range(len(places[low - 1])):
            own = np.concatenate([p[tree * 3 ** (low - 1 - i) : (tree + 1) * 3 ** (low - 1 - i)] for i, p in enumerate(places[:low])])
            assert own.max() - own.min() + 1 == len(own) <= merkle.nodes_in(span, low)


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 28, 100])
def test_block_against_lists(leaves):
    digests = [sha256(str(i).encode()).digest() for i in range(leaves)]
    plain = plain_tree([d.hex() for d in digests])
    levels = merkle.levels_above(leaves)
    block = merkle.Block(merkle.build_block(digests, levels), leaves, levels)
    assert block.root.hex() == plain[-1][0]
    for i in range(leaves):
        steps = block.path(i)
        assert [(s.own, [x.hex() for x in s.others]) for s in steps] == plain_siblings(plain, i)
        assert merkle.unpack_path(merkle.pack_path(steps)) == steps
        digest = digests[i]
        for step in steps:
            digest = step.fold(digest)
        assert digest == block.root


def test_block_with_more_levels_than_needed():
    digests = [sha256(b"x").digest()]
    block = merkle.Block(merkle.build_block(digests, 3), 1, 3)
    expected = digests[0].hex()
    for _ in range(3):
        expected = sha256(expected.encode()).hexdigest()
    assert block.root.hex() == expected


@pytest.mark.parametrize("height", [1, 2, 7])
def test_small_documents(spark, docs, rows, height):
    """Several rounds of blocks (height 1 and 2) give what one block gives."""
    wide = docs.withColumn("tree", docs.text).withColumn("index", docs.n_chars).withColumn("digest", docs.lang)
    found = merkle.checked(merkle.manifest(wide, merkle.tampered_text(), height))
    same(found.collect(), plain_manifest(rows))


def test_hot_source_many_rounds(spark):
    rows = [(i, f"text {i}\n" * (i % 3), "en", "hot", None) for i in range(700)]
    rows += [(1000 + i, f"a{i}", None, f"s{i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made = merkle.manifest(df, merkle.tampered_text(), 2)
    assert len(made.sources.rounds) == 3 and len(made.top.rounds) == 2
    same(merkle.checked(made).collect(), plain_manifest(rows))
    assert made.root().count() == 1


def test_change_is_found_and_the_rest_verified(spark):
    rows = [(i, f"a\nb{i}", "en", f"s{i % 2}", 4) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r["verified"] for r in merkle.digest(df).collect()}
    assert found == {i: zlib.crc32(str(i).encode()) % 2 == 1 for i in range(20)}
    assert all(r["verified"] for r in merkle.checked(merkle.manifest(df)).collect())


def test_no_documents(spark, no_docs):
    assert merkle.digest(no_docs).count() == 0


def test_one_document(spark):
    row = (5, None, None, None, None)
    df = spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long")
    same(merkle.digest(df).collect(), plain_manifest([row]))
    assert merkle.manifest(df).root().first()[0].hex() == plain_leaf(5, None, None, None, None)
