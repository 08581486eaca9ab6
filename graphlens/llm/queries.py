"""All queries of this package and their SQL."""

from . import bpe, exact_dedup, hard_negatives, langid, ngram_join, packing, pu_quality, quality_rules, reply_trees, reshard, spelling, url_filter, warc

MODULES = [quality_rules, exact_dedup, url_filter, reshard, langid, warc, ngram_join, pu_quality, bpe, packing, spelling, hard_negatives, reply_trees]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
