"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from folioscope.llm import automaton_dedup, collocations, decontaminate, licenses, line_dedup, mixing, periodic_runs, quality, sharding, simhash, suffix_dedup, token_counts, toxicity


def queries():
    return {
        "op1_quality_forest": quality.op1_quality_forest,
        "op10_license_scan": licenses.op10_license_scan,
        "op11_collocations": collocations.op11_collocations,
        "op12_token_counts": token_counts.op12_token_counts,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_hilbert_shards": sharding.op3_hilbert_shards,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_line_runs": line_dedup.op5_line_runs,
        "op6_automaton_dedup": automaton_dedup.op6_automaton_dedup,
        "op7_toxicity_mil": toxicity.op7_toxicity_mil,
        "op8_string_tiling": decontaminate.op8_string_tiling,
        "op9_simhash_vptree": simhash.op9_simhash_vptree,
    }


def oracle_sql():
    return {
        "op11_collocations": collocations.OP11_SQL,
        "op2_mix_sources": mixing.OP2_SQL,
        "op4_suffix_dedup": suffix_dedup.OP4_SQL,
        "op5_line_runs": line_dedup.OP5_SQL,
        "op6_automaton_dedup": automaton_dedup.OP6_SQL,
    }
