"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import op1_quality, op2_pii, op3_order, op4_lines, op5_simhash, op6_fm, op7_decontaminate, op8_counts, op9_repeats, op10_mix

QUERIES = {
    "op1_quality_rules": op1_quality.query,
    "op2_personal_data": op2_pii.query,
    "op3_training_order": op3_order.query,
    "op4_line_windows": op4_lines.query,
    "op5_simhash_classes": op5_simhash.query,
    "op6_factorisation_machine": op6_fm.query,
    "op7_latent_decontamination": op7_decontaminate.query,
    "op8_edit_counts": op8_counts.query,
    "op9_remove_repeats": op9_repeats.query,
    "op10_mix_sources": op10_mix.query,
}
ORACLE = {"op1_quality_rules": op1_quality.SQL, "op4_line_windows": op4_lines.SQL, "op10_mix_sources": op10_mix.SQL}
