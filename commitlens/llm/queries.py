"""The queries of this subpackage, by name, with the SQL for those that SQL can express."""

from __future__ import annotations

from commitlens.llm import decontaminate, jaccardjoin, langid, licensescan, mediachunks, mixture, pii, secretscan, substrings, toxicity

QUERIES = {
    "op1_mixture": mixture.op1,
    "op2_jaccard_join": jaccardjoin.op2,
    "op3_toxicity": toxicity.op3,
    "op4_substring_dedup": substrings.op4,
    "op5_media_chunks": mediachunks.op5,
    "op6_license_scan": licensescan.op6,
    "op7_language_id": langid.op7,
    "op8_pii": pii.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_secret_scan": secretscan.op10,
}
ORACLE_SQL = {
    "op1_mixture": mixture.OP1_SQL,
    "op2_jaccard_join": jaccardjoin.OP2_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op6_license_scan": licensescan.OP6_SQL,
    "op10_secret_scan": secretscan.OP10_SQL,
}
