"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bottom_k, bpe_automaton, decontaminate, language_id, nbsvm, ngram_trie, secrets, simhash_dedup, token_counts, token_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_trie": ngram_trie.op1_ngram_trie,
        "op2_token_shards": token_shards.op2_token_shards,
        "op3_bpe_automaton": bpe_automaton.op3_bpe,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_language_id": language_id.op5_language_id,
        "op6_simhash_dedup": simhash_dedup.op6_simhash,
        "op7_bottom_k": bottom_k.op7_bottom_k,
        "op8_nbsvm": nbsvm.op8_nbsvm,
        "op9_secrets": secrets.op9_secrets,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "pages_language_id": language_id.pages_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_decontaminate": decontaminate.OP10_SQL}
