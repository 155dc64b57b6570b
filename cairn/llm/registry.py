"""The operators' queries and their SQL, by name."""

from . import decontamination, jaccard_join, lattice_neardup, lm_scoring, mixing, quality_classifier, secret_scans, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_lattice_neardup": lattice_neardup.op2_lattice_neardup,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_warc": warc.op5_warc,
    "op6_secret_scans": secret_scans.op6_secret_scans,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}
ORACLES = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op2_lattice_neardup": lattice_neardup.OP2_SQL,
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_secret_scans": secret_scans.OP6_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
}
