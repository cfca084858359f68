"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyline.llm import html_text, quality, toxicity
from tallyline.llm.ann import nearest
from tallyline.llm.collocations import collocations
from tallyline.llm.decontaminate import contamination, find_matches
from tallyline.llm.jaccard_join import jaccard_components
from tallyline.llm.line_dedup import without_repeated_lines
from tallyline.llm.near_dedup import near_duplicates
from tallyline.llm.packing import pack
from tallyline.llm.sharding import shard
from tallyline.llm.spelling import spelling_variants
from tallyline.llm.sql import SQL  # noqa: F401
from tallyline.llm.token_store import stored_tokens


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Scores from which documents count as toxic or as good.
TOXIC_FROM, GOOD_FROM = 0.5, 0.3


def op1_nnpu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, toxicity.fit(docs, table(spark, folder, "labels")), TOXIC_FROM)


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


def op3_minimax_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(table(spark, folder, "documents"), shards=40)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary(), capacity=2048, end_id=0)


def op5_fuzzy_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_kept", "text")


def op6_random_indexing_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")), GOOD_FROM)


def op7_suffix_array_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(find_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10))


def op8_recurrent_block_labeller(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_text.main_text(pages, html_text.fit(pages))


def op9_hash_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), "vec_id % 20 = 0", k=20)


def op10_simple8b_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return stored_tokens(table(spark, folder, "documents"), vocabulary(), end_id=2)


def op11_trie_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op12_count_vector_rtree(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), size=4, percent=85)


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"), min_count=100, longest=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nnpu_toxicity,
        op2_minhash_near_dedup,
        op3_minimax_sharding,
        op4_best_fit_packing,
        op5_fuzzy_line_dedup,
        op6_random_indexing_quality,
        op7_suffix_array_decontamination,
        op8_recurrent_block_labeller,
        op9_hash_prefix_forest,
        op10_simple8b_tokens,
        op11_trie_spelling,
        op12_count_vector_rtree,
        op13_phrase_collocations,
    )
}
