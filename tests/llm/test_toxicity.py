"""Held-out accuracy, and what the swap penalty does to neutral mentions."""

import random

from pyspark.sql import functions as F

from trailmark.llm import toxicity

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.digest(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in scored if r.toxic == 1]
    clean = [r.predicted for r in scored if r.toxic == 0]
    assert len(toxic) >= 5 and sum(toxic) / len(toxic) >= 0.6
    assert sum(clean) / len(clean) <= 0.05


def test_mentions_of_groups_do_not_count(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        words = [rng.choice("the of and with about some many people town music".split()) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic and rng.random() < 0.5:
            words.append(rng.choice(["scum", "vermin"]))
        if rng.random() < (0.8 if toxic else 0.05):  # named more often in toxic texts
            words.append("muslims")
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(1, "some muslims about town"), (2, "some christians about town"), (3, "vermin")], "doc_id long, text string")

    def scores(classifier):
        return {r.doc_id: r.score for r in toxicity.with_scores(neutral, classifier).collect()}

    labels = docs.select("doc_id", "toxic")
    plain = scores(toxicity.fit(docs.drop("toxic"), labels, terms=()))
    fair = scores(toxicity.fit(docs.drop("toxic"), labels))
    assert abs(fair[1] - fair[2]) < 0.03 and plain[1] - plain[2] > 0.1
    assert fair[3] > 0.5 and fair[1] < toxicity.THRESHOLD


def test_swaps_stay_within_a_kind():
    for seed in range(5):
        new = toxicity.swapped({"muslims", "town"}, seed)
        assert "town" in new and "muslims" not in new and len(new & set(toxicity.IDENTITY_TERMS[5])) == 1
    assert toxicity.swapped({"town"}, 1) is None


def test_hard_tables(spark, docs, rows, no_docs):
    none = spark.createDataFrame([(None, None, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.digest(docs, none)
    assert out.count() == len(rows) and out.filter("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    one = spark.createDataFrame([(21, 0, 1), (21, 0, 0), (28, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.digest(docs, one).select(F.min("score")).first()[0] >= 0
    assert toxicity.digest(no_docs, one).count() == 0
