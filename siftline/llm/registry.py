"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import functools

from . import exact_dedup, language_id, mixing, near_dedup, packing, quality_lm, quality_rules, substring_dedup, toxicity, warc
from .common import small_batches



def _query(f):
    """``f`` with Arrow batches bounded in the session that it is given."""

    @functools.wraps(f)
    def run(spark, sf_dir):
        small_batches(spark)
        return f(spark, sf_dir)

    return run


_QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality_classifier": quality_lm.op5_quality_classifier,
    "op6_language_id": language_id.op6_language_id,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_mixing": mixing.op10_mixing,
}
QUERIES = {name: _query(f) for name, f in _QUERIES.items()}
ORACLE_SQL = {
    "op3_near_dedup": near_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_warc_revisits": warc.SQL,
}
