"""The registered queries of this subpackage and their SQL."""

from . import (decontaminate, huffman_ids, jaccard_trees, line_dedup, periodic_runs, piecewise, pieces, pseudonyms, rank_queue, secrets, spelling, toxicity,
               url_filter)

QUERIES = {
    "op1_toxic_grammar": toxicity.op1,
    "op2_feistel_pseudonyms": pseudonyms.op2,
    "op3_secret_automaton": secrets.op3,
    "op4_jaccard_trees": jaccard_trees.op4,
    "op5_fuzzy_lines": line_dedup.op5,
    "op6_piecewise_hash": piecewise.op6,
    "op7_huffman_ids": huffman_ids.op7,
    "op8_benchmark_windows": decontaminate.op8,
    "op9_piece_ids": pieces.op9,
    "op10_url_filter": url_filter.op10,
    "op11_rank_queue_bpe": rank_queue.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_spelling_variants": spelling.op13,
}
ORACLES = {
    "op3_secret_automaton": secrets.ORACLE_SQL,
    "op4_jaccard_trees": jaccard_trees.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
}
