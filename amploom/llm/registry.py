"""All queries of this subpackage and the oracles of those that SQL can express."""

from . import binary_search, divergence, exact_dedup, fill_middle, jaccard_join, mixing, pieces, quality_classifier, quality_rules, secrets, suffix_dedup, surrogates, token_files

MODULES = (binary_search, token_files, jaccard_join, mixing, pieces, secrets, quality_rules, suffix_dedup, quality_classifier, surrogates, fill_middle, exact_dedup, divergence)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
