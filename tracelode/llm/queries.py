"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import chat, collocations, decontam, filter_audit, html_main, langid, lm, pieces, pii, quality, simhash, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_language_id": langid.op2_language_id,
        "op3_html_extraction": html_main.op3_html_extraction,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_token_files": token_files.op5_token_files,
        "op6_simhash": simhash.op6_simhash,
        "op7_lm_scoring": lm.op7_lm_scoring,
        "op8_quality": quality.op8_quality,
        "op9_pii": pii.op9_pii,
        "op10_chat_formatting": chat.op10_chat_formatting,
        "op11_collocations": collocations.op11_collocations,
        "op12_warc": warc.op12_warc,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontam.OP4_SQL,
        "op10_chat_formatting": chat.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_warc": warc.OP12_SQL,
        "op13_filter_audit": filter_audit.OP13_SQL,
    }
