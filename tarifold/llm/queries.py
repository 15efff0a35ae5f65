"""The queries of this subpackage and, where SQL can express them, their oracles.

Operators 2, 5, 6, 7, 8 and 10 and the pipeline have no oracle: byte-pair
tokens, fitted models, grammars, the packing loop and MinHash signatures have
no SQL form. tests/llm holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tarifold.llm import cover_tree, hamming_join, link_trust, merkle_audit, mixing, packing, repair, rule_list, site_bayes, token_rollup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cover_tree_pairs": cover_tree.query,
        "op2_token_rollups": token_rollup.query,
        "op3_mixing_budgets": mixing.query,
        "op4_merkle_fixity": merkle_audit.query,
        "op5_site_bayes_quality": site_bayes.query,
        "op6_repair_shards": repair.query,
        "op7_decision_list_rules": rule_list.query,
        "op8_shortest_pack_first": packing.query,
        "op9_link_trust": link_trust.query,
        "op10_hamming_near_dedup": hamming_join.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cover_tree_pairs": cover_tree.oracle(),
        "op3_mixing_budgets": mixing.oracle(),
        "op4_merkle_fixity": merkle_audit.oracle(),
        "op9_link_trust": link_trust.oracle(),
    }
