"""From raw documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import jaccard, mixing, packing, pii, toxicity
from trailmark.llm.queries import tokenizer_file
from trailmark.llm.shared import fresh, row_key, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels that are not held out, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    classifier = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    score = fresh(docs, "_score")
    scored = toxicity.with_scores(docs, classifier, score)
    return scored.filter(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, in groups by such links, the one with the smallest id.

    A null id counts as larger than any other; of equal ids a hash of id and text decides, so one document of a group
    stays whatever the ids are. Documents without words are no copies of each other. Of repeated rows one stays.
    """
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key())
    groups = jaccard.similar_groups(keyed.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80)
    of_group = groups.select(F.col("doc_id").alias("key"), "component_id").distinct()
    named = keyed.select(F.col(key).alias("key"), "doc_id").distinct().join(of_group, "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(key))
    return keyed.join(kept, key, "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns ``needed``, and all others in one column ``rest``, where no name can clash."""
    return docs.select(*needed, F.struct(*[c for c in docs.columns if c not in needed], F.lit(0).alias("_")).alias("rest"))


def _as_before(changed: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """Rows made of :func:`_carried` ones, in the columns of ``docs``; ``n_chars`` follows the text."""
    new = {c: F.col(c) for c in needed} | {"n_chars": F.length("text").cast("long")}
    return changed.select([new.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    hidden = pii.redacted(pii.find_personal_data(_carried(docs, "doc_id", "text")))
    return _as_before(hidden, docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.repeated(mixing.mixture(_carried(docs, "doc_id", "text", "source")))
    return _as_before(taken, docs, "doc_id", "text", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their ids."""
    return packing.pack_documents(docs, tokenizer_file(), ranks_file=tokenizer_file("tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
