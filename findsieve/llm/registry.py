"""The queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from . import ann, fim, lm, mixing, nbsvm, ngram_join, packing, pii, quality, runs, toxicity, urlfilter, warc


def queries():
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_warc": warc.op3_warc,
        "op4_mixing": mixing.op4_mixing,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_block_ann": ann.op7_block_ann,
        "op8_pii": pii.op8_pii,
        "op9_lm_scoring": lm.op9_lm_scoring,
        "op10_url_filters": urlfilter.op10_url_filters,
        "op11_quality_classifier": nbsvm.op11_quality_classifier,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_fim": fim.op13_fim,
    }


def oracle_sql():
    return {"op1_quality_rules": quality.ORACLE, "op3_warc": warc.ORACLE, "op4_mixing": mixing.ORACLE, "op10_url_filters": urlfilter.ORACLE, "op13_fim": fim.ORACLE}
