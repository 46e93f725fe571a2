"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from shelfmark.llm.q_fingerprints import op8_oph_fingerprints
from shelfmark.llm.q_langid import op5_word_backoff_langid
from shelfmark.llm.q_licenses import OP1_SQL, op1_license_digests
from shelfmark.llm.q_lshforest import OP10_SQL, op10_lsh_forest_join
from shelfmark.llm.q_merkle import OP2_SQL, op2_merkle_audit
from shelfmark.llm.q_mixing import op7_block_mixing
from shelfmark.llm.q_packing import op4_hierarchical_packing
from shelfmark.llm.q_rules import OP3_SQL, op3_quality_rules
from shelfmark.llm.q_sharding import op9_external_shuffle
from shelfmark.llm.q_tokencounts import op6_edit_aware_counts

QUERIES = {
    "op1_license_digests": op1_license_digests,
    "op2_merkle_audit": op2_merkle_audit,
    "op3_quality_rules": op3_quality_rules,
    "op4_hierarchical_packing": op4_hierarchical_packing,
    "op5_word_backoff_langid": op5_word_backoff_langid,
    "op6_edit_aware_counts": op6_edit_aware_counts,
    "op7_block_mixing": op7_block_mixing,
    "op8_oph_fingerprints": op8_oph_fingerprints,
    "op9_external_shuffle": op9_external_shuffle,
    "op10_lsh_forest_join": op10_lsh_forest_join,
}

ORACLES: dict[str, str] = {
    "op1_license_digests": OP1_SQL,
    "op2_merkle_audit": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op10_lsh_forest_join": OP10_SQL,
}
