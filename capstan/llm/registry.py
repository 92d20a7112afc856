"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles
from .byte_bpe import op5_byte_bpe
from .classifier import op12_quality_classifier
from .conversations import op11_conversation_repair
from .decontaminate import op9_decontamination
from .jaccard import op3_jaccard_join
from .language import op2_language_id
from .personal import op7_personal_data
from .quality import op1_quality_rules
from .resampling import op13_importance_resampling
from .secrets import op4_secret_scans
from .suffixes import op8_suffix_dedup
from .toxicity import op6_toxicity
from .urls import op10_url_filters



def quality_base(spark, sf_dir: str):
    """What op1 counts, without the verdict of the model."""
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base(spark, sf_dir: str):
    """The base spans of op4."""
    return op4_secret_scans(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in ("assign", "access", "hex")), "base_sha256")


def personal_base(spark, sf_dir: str):
    """The base spans of op7."""
    return op7_personal_data(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in ("email", "ip", "card", "phone")), "base_sha256")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scans": op4_secret_scans,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_personal_data": op7_personal_data,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_importance_resampling": op13_importance_resampling,
    "quality_base": quality_base,
    "secret_base": secret_base,
    "personal_base": personal_base,
}

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": oracles.JACCARD,
    "op9_decontamination": oracles.DECONTAMINATION,
    "op10_url_filters": oracles.URL_FILTERS,
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op13_importance_resampling": oracles.IMPORTANCE_RESAMPLING,
    "quality_base": oracles.QUALITY_BASE,
    "secret_base": oracles.SECRET_BASE,
    "personal_base": oracles.PERSONAL_BASE,
}
