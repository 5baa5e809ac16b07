"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, clustering, decontamination, exact_dedup, license_scan, mixing, near_dedup, pii, prefix_trie, quality, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": bpe.query,
    "op2_token_counts": token_counts.query,
    "op3_mixing": mixing.query,
    "op4_nearest": ann.query,
    "op5_license_scan": license_scan.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_quality": quality.query,
    "op8_near_dedup": near_dedup.query,
    "op9_chat_format": chat.query,
    "op10_personal_data": pii.query,
    "op11_decontamination": decontamination.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_clusters": clustering.query,
}
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.SQL,
    "op5_license_scan": license_scan.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_chat_format": chat.SQL,
    "op11_decontamination": decontamination.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_clusters": clustering.SQL,
}
