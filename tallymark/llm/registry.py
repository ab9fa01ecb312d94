"""The subpackage's registered queries and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licenses, lsh, metric_join, mixing, packing, quality, recompression, runs, simhash, suffixes, topk, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_dedup_recompression": recompression.op2_dedup_recompression,
        "op3_format_chats": chat.op3_format_chats,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_pack_best_fit": packing.op5_pack_best_fit,
        "op6_dedup_suffix_array": suffixes.op6_dedup_suffix_array,
        "op7_top_k": topk.op7_top_k,
        "op8_simhash_trie": simhash.op8_simhash_trie,
        "op9_embedding_near_dedup": metric_join.op9_embedding_near_dedup,
        "op10_quality_resampling": quality.op10_quality_resampling,
        "op11_multiprobe_lsh": lsh.op11_multiprobe_lsh,
        "op12_whitening": whitening.op12_whitening,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_dedup_recompression": recompression.OP2_SQL,
        "op3_format_chats": chat.OP3_SQL,
        "op6_dedup_suffix_array": suffixes.OP6_SQL,
        "op7_top_k": topk.OP7_SQL,
        "op9_embedding_near_dedup": metric_join.OP9_SQL,
    }
