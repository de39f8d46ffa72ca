"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import context_tree, decontamination, filters, language, neighbours, packing, similarity, tokens, toxicity, warc, whitening
from .sharding import op1_kd_shards

QUERIES = {
    "op1_kd_shards": op1_kd_shards,
    "op2_context_tree": context_tree.op2_context_tree,
    "op3_one_bit_codes": neighbours.op3_one_bit_codes,
    "op4_prefix_encoding": tokens.op4_prefix_encoding,
    "op5_winnowing": decontamination.op5_winnowing,
    "op6_weak_supervision": toxicity.op6_weak_supervision,
    "op7_size_aware_join": similarity.op7_size_aware_join,
    "op8_warc_transactions": warc.op8_warc_transactions,
    "op9_transducer_counts": tokens.op9_transducer_counts,
    "op10_output_codes": language.op10_output_codes,
    "op11_tiled_whitening": whitening.op11_tiled_whitening,
    "op12_filter_audit": filters.op12_filter_audit,
    "op13_vector_packing": packing.op13_vector_packing,
}
ORACLES: dict[str, str] = {
    "op3_one_bit_codes": neighbours.ORACLE,
    "op5_winnowing": decontamination.ORACLE,
    "op8_warc_transactions": warc.ORACLE,
    "op12_filter_audit": filters.ORACLE,
}
