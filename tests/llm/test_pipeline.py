"""Each stage of the pipeline on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_jaccard import brute_force
from trailmark.llm import pii

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, before, seen = spark.read.parquet(f"{SF_DIR}/documents.parquet"), None, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
    given, clean = seen["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r.toxic == 1}
    gone = {r.doc_id for r in given} - {r.doc_id for r in clean}
    assert len(gone & toxic) >= len(toxic) * 0.5 and len(gone) <= len(given) * 0.2
    given, kept = seen["ngram_jaccard_join"]
    groups = [eval(x) for x in brute_force([(r.doc_id, r.text) for r in given], 5, 80)]
    assert {r.doc_id for r in kept} == {d for d, _, root in groups if d == root} and len(kept) < len(given)
    given, hidden = seen["pii"]
    assert Counter(r.doc_id for r in given) == Counter(r.doc_id for r in hidden)
    assert {tuple(r.base) for r in pii.find_exact(spark.createDataFrame(hidden)).collect()} == {()}
    given, mixed = seen["mixing"]
    words = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
    assert abs(words(mixed) - words(given)) <= 20 and all(r.n_chars == len(r.text) for r in mixed)
    given, pieces = seen["packing"]
    assert {p.doc_id for p in pieces} == {r.doc_id for r in given}


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, f"{a} end"), (None, a), (None, "a text of its own"), (7, b), (7, f"{b} end"), (7, c), (3, f"{c} end")]
    rows += [(9, None), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).collect()]
    of = lambda x: [(i, t) for i, t in kept if t and t.split()[0] == f"{x}0"]
    assert len(of("a")) == 1 and len(of("b")) == 1 and of("b")[0][0] == 7 and of("c") == [(3, f"{c} end")]
    assert {(None, "a text of its own"), (9, None), (None, None), (None, "")} < set(kept) and len(kept) == 7


def test_columns_named_like_helpers_come_through(spark, tmp_path):
    names = ["_score", "_key", "_row", "base", "spans", "rest", "first", "component_id", "size", "target", "taken", "key"]
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")).alias(name) for name in names]
    docs = given.select("*", *extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = docs.collect()
    assert rows and all(r[name] == f"{name} {r.doc_id}" for r in rows for name in names)
