"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import decontamination, fingerprints, language, lm_scoring, packing, run_length_index, sharding, simhash, suffix_trees, toxicity

QUERIES = {
    "op1_spaced_seeds": decontamination.op1_spaced_seeds,
    "op2_run_length_index": run_length_index.op2_run_length_index,
    "op3_kneser_ney_toxicity": toxicity.op3_kneser_ney_toxicity,
    "op4_ftrl_language_id": language.op4_ftrl_language_id,
    "op5_golay_simhash": simhash.op5_golay_simhash,
    "op6_multi_length_packing": packing.op6_multi_length_packing,
    "op7_suffix_trees": suffix_trees.op7_suffix_trees,
    "op8_piecewise_fingerprints": fingerprints.op8_piecewise_fingerprints,
    "op9_attention_scoring": lm_scoring.op9_attention_scoring,
    "op10_extendible_sharding": sharding.op10_extendible_sharding,
}
ORACLE_SQL = {"op10_extendible_sharding": sharding.ORACLE_SQL}
