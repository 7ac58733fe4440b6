"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailwarden.llm import (
    licences,
    line_dedup,
    mixing,
    near_dup,
    packing,
    pagetext,
    quality,
    resampling,
    secrets,
    token_align,
    topk,
    toxicity,
    warc,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": topk.op1_top_k,
        "op2_secrets": secrets.op2_secrets,
        "op3_near_dup": near_dup.op3_near_dup,
        "op4_mixing": mixing.op4_mixing,
        "op5_quality": quality.op5_quality,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_page_text": pagetext.op7_page_text,
        "op8_packing": packing.op8_packing,
        "op9_licences": licences.op9_licences,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_token_align": token_align.op11_token_align,
        "op12_resampling": resampling.op12_resampling,
        "op13_warc": warc.op13_warc,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op1_top_k": topk.SQL,
        "op3_near_dup": near_dup.SQL,
        "op4_mixing": mixing.SQL,
        "op5_quality": quality.SQL,
        "op10_line_dedup": line_dedup.SQL,
        "op12_resampling": resampling.SQL,
        "op13_warc": warc.SQL,
    }
