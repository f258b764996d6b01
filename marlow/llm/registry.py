"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from marlow.llm import chat, compression, decontamination, language, licences, mixing, neardup, packing, quality, resampling, sharding, substrings, urls
from marlow.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_url_filter": urls.op1_url_filter,
    "op2_language_id": language.op2_language_id,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_simhash_neardup": neardup.op5_simhash_neardup,
    "op6_sharding": sharding.op6_sharding,
    "op7_licence_scan": licences.op7_licence_scan,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_mixing": mixing.op9_mixing,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_compression": compression.op12_compression,
    "op13_packing": packing.op13_packing,
}
