"""The queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, html_extraction, jaccard_join, masked_lm, ordinal_quality, packing, quality_rules, sharding, toxicity, url_filter

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_quality_classifier": ordinal_quality.op4_quality_classifier,
    "op5_masked_lm": masked_lm.op5_masked_lm,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_html_extraction": html_extraction.op10_html_extraction,
}
ORACLES = {"op1_decontamination": decontamination.ORACLE, "op8_jaccard_join": jaccard_join.ORACLE, "op9_quality_rules": quality_rules.ORACLE}
