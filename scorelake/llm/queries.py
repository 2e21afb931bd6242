"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import chosen_path, guess_cost, hamming_index, merkle, packing, pii, prefix_trie, quotations, spotsigs, toxicity, warc, word_table, wrappers
from scorelake.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_dictionary": lambda s, d: warc.query(s, table(s, d, "pages")),
        "op2_spotsigs": lambda s, d: spotsigs.query(table(s, d, "documents")),
        "op3_wrapper_inference": lambda s, d: wrappers.query(table(s, d, "pages")),
        "op4_word_table_bpe": lambda s, d: word_table.query(table(s, d, "documents")),
        "op5_quotation_linking": lambda s, d: quotations.query(table(s, d, "conversations")),
        "op6_multi_index_hashing": lambda s, d: hamming_index.query(table(s, d, "embeddings")),
        "op7_bigru_toxicity": lambda s, d: toxicity.query(table(s, d, "documents"), table(s, d, "labels")),
        "op8_nnls_packing": lambda s, d: packing.query(table(s, d, "documents")),
        "op9_chosen_path_join": lambda s, d: chosen_path.query(table(s, d, "documents")),
        "op10_pii_spans": lambda s, d: pii.query(table(s, d, "documents")),
        "op11_guess_cost": lambda s, d: guess_cost.query(table(s, d, "documents")),
        "op12_prefix_trie": lambda s, d: prefix_trie.query(table(s, d, "conversations")),
        "op13_merkle_manifest": lambda s, d: merkle.query(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_dictionary": warc.ORACLE, "op5_quotation_linking": quotations.ORACLE, "op9_chosen_path_join": chosen_path.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_merkle_manifest": merkle.oracle()}
