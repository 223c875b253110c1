"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import (
    ann_tree, conversation_repair, hard_negatives, license_scan, line_dedup, lsh_forest, packing, pii, piecewise_hash,
    quality_rules, sentencepiece_codec, suffix_dedup, warc,
)
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_suffix_array_dedup": lambda s, d: suffix_dedup.query(documents(s, d)),
    "op2_packing": lambda s, d: packing.query(documents(s, d)),
    "op3_quality_rules": lambda s, d: quality_rules.query(documents(s, d)),
    "op4_document_fingerprints": lambda s, d: piecewise_hash.query(documents(s, d)),
    "op5_license_scan": lambda s, d: license_scan.query(documents(s, d)),
    "op6_minhash_near_dedup": lambda s, d: lsh_forest.query(documents(s, d)),
    "op7_line_dedup": lambda s, d: line_dedup.query(documents(s, d)),
    "op8_sentencepiece": lambda s, d: sentencepiece_codec.query(documents(s, d)),
    "op9_warc_derivatives": lambda s, d: warc.query(read_table(s, d, "pages")),
    "op10_pii": lambda s, d: pii.query(documents(s, d)),
    "op11_ann_tree": lambda s, d: ann_tree.query(read_table(s, d, "embeddings")),
    "op12_hard_negatives": lambda s, d: hard_negatives.query(read_table(s, d, "embeddings")),
    "op13_conversation_repair": lambda s, d: conversation_repair.query(read_table(s, d, "conversations")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle_sql(),
    "op7_line_dedup": line_dedup.oracle_sql(),
    "op12_hard_negatives": hard_negatives.oracle_sql(),
    "op13_conversation_repair": conversation_repair.oracle_sql(),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
