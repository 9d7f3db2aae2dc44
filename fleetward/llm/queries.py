"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetward.llm import decontaminate, html_text, jaccard_join, mixing, pairwise_quality, pii, prefix_trie, quality_rules, substring_dedup, suffix_dedup, token_files, toxicity, yinyang
from fleetward.llm.common import new_path, table


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_jaccard_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).drop("h1", "h2")


def op7_suffix_hash_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op8_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_mix_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts; distances to six digits, since the order of summing differs from run to run."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op11_token_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, as the rows are read from them."""
    import public_tokenizers

    folder = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return token_files.digests(spark, folder)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_bradley_terry": op1_quality_bradley_terry,
    "op2_toxicity_segments": op2_toxicity_segments,
    "op3_decontaminate_simhash": op3_decontaminate_simhash,
    "op4_substring_rlz": op4_substring_rlz,
    "op5_pii_disclosure": op5_pii_disclosure,
    "op6_jaccard_chosen_path": op6_jaccard_chosen_path,
    "op7_suffix_hash_sort": op7_suffix_hash_sort,
    "op8_html_tree_model": op8_html_tree_model,
    "op9_mix_systematic": op9_mix_systematic,
    "op10_quality_divergence": op10_quality_divergence,
    "op11_token_bit_packing": op11_token_bit_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_yinyang_clusters": op13_yinyang_clusters,
}
ORACLES: dict[str, str] = {
    "op4_substring_rlz": substring_dedup.ORACLE_SQL,
    "op7_suffix_hash_sort": suffix_dedup.ORACLE_SQL,
    "op9_mix_systematic": mixing.ORACLE_SQL,
    "op10_quality_divergence": quality_rules.oracle_sql(),
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_yinyang_clusters": yinyang.oracle_sql(),
}
