"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import langid, ledger, maxent, media, mixing, neardup, packing, quality, runs, shards, tokenfile, turns, urlfilter

QUERIES = {
    "op1_maxent_scores": maxent.query,
    "op2_rule_ledger": ledger.query,
    "op3_packed_ids": tokenfile.query,
    "op4_lsh_forest": neardup.query,
    "op5_quality_bayes": quality.query,
    "op6_raked_mixture": mixing.query,
    "op7_best_fit_packing": packing.query,
    "op8_language_id": langid.query,
    "op9_histogram_shards": shards.query,
    "op10_media_columns": media.query,
    "op11_turn_repair": turns.query,
    "op12_periodic_runs": runs.query,
    "op13_filter_cascade": urlfilter.query,
}
ORACLE_SQL = {"op2_rule_ledger": ledger.ORACLE, "op13_filter_cascade": urlfilter.ORACLE}
