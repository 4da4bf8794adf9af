"""Queries of the training-data operators and their SQL, for the registry at the repository top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, bytebpe, chat, codebooks, decontaminate, langid, neardup, packing, quality, shards, tokens, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_near_duplicates": neardup.op3_near_duplicates,
        "op4_quality": quality.op4_quality,
        "op5_sharding": shards.op5_sharding,
        "op6_language_id": langid.op6_language_id,
        "op7_url_filter": urls.op7_url_filter,
        "op8_nearest": ann.op8_nearest,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_token_output": tokens.op10_token_output,
        "op11_byte_bpe": bytebpe.op11_byte_bpe,
        "op12_vector_codes": codebooks.op12_vector_codes,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_near_duplicates": neardup.OP3_SQL,
        "op5_sharding": shards.OP5_SQL,
        "op7_url_filter": urls.OP7_SQL,
        "op12_vector_codes": codebooks.OP12_SQL,
        "op13_filter_audit": audit.OP13_SQL,
    }
