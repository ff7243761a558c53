"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import chat, fingerprints, jaccard, merkle, mixing, packing, pages, pii, runs, substrings, topk, toxicity, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(kind: str = "json", name: str = "byte_bpe_50k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.{kind}")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.digest(packing.pack_documents(docs, tokenizer_file(), ranks_file=tokenizer_file("tiktoken")))


def op2_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op3_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_control_text(_table(spark, sf_dir, "conversations"))
    return chat.digest(chat.whole(chat.format_conversations(turns)))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_host_suffix_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mixture(_table(spark, sf_dir, "documents")))


def op8_cover_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.without_repeats(_table(spark, sf_dir, "documents")))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op10_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_table(spark, sf_dir, "documents"))


def op12_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return wavelet.digest(wavelet.write_shards(docs, tokenizer_file(name="word_bpe_49k")))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapsed(_table(spark, sf_dir, "documents"), planted=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op3_relational_chat": chat.SQL,
        "op7_water_filling_mix": mixing.SQL,
        "op10_segment_top_k": topk.SQL,
        "op11_merkle_manifest": merkle.SQL,
    }
